import pytest
from pyspark.sql import functions as F

from siftwell.operators import html as H

PAGE = """<html><head><title>t</title><script type="application/ld+json"> {"a": 1} </script>
<script>var x = "<p>no</p>";</script><script type="application/ld+json">{"b": "</p>"}
</script><style>p{}</style></head><body class="main  page"><h2 class="big  red"> Firm <b>One</b> </h2><h2>Second</h2>
<!-- note --><div id="application-section">Apply<br>now<p>here</div>
<section data-sentry-component='Qualification'>Q1</section><section data-sentry-component='Qualification'>Q2</section>
<ul><li>Card <a href="/Recruit/GI_Read/1?x=1&amp;y=2" class="t u" data-sentry-component="Title">Job <i>A</i></a> text</li></ul>
<a href="">  </a><a name="n">named</a><a href="Recruit/GI_Read/2" data-sentry-component="Title">B</a>
<div><img src=x/>end &amp; more</div></body></html>"""


def parsed(spark, html, **needs):
    rows = [(i, h) for i, h in enumerate(html if isinstance(html, list) else [html])]
    return spark.createDataFrame(rows, "page_id int, html string").withColumn("dom", H.parse_html(F.col("html"), **needs))


def one(df, column):
    return df.orderBy("page_id").select(column.alias("r")).first()["r"]


def test_first_text_and_json_ld(spark):
    df = parsed(spark, PAGE, tags=["h2", "script", "h4"])
    assert one(df, H.first_text(F.col("dom"), "h2")) == "FirmOne"
    assert one(df, H.first_text(F.col("dom"), "h4")) == ""
    assert one(df, H.json_ld_documents(F.col("dom"))) == ['{"a": 1}', '{"b": "</p>"}']
    assert one(df, H.json_ld_text(F.col("dom"))) == '{"a": 1}\n{"b": "</p>"}'


def test_sections_follow_the_selectors(spark):
    df = parsed(spark, PAGE, **H.selector_needs(H.SECTION_SELECTORS))
    assert one(df, H.section_text(F.col("dom"))) == "Q1\n\nApply\nnow\nhere"


def test_body_text(spark):
    df = parsed(spark, [PAGE, "no <b>body</b> here", "<body> <p>a</p>\n <p>b</p></body>"], tags=["body"])
    texts = [r["r"] for r in df.orderBy("page_id").select(H.body_text(F.col("dom")).alias("r")).collect()]
    assert texts[0].startswith("Firm\nOne\nSecond\nApply\nnow\nhere\nQ1\nQ2\nCard\nJob\nA\ntext\nnamed\nB\nend & more")
    assert texts[1] == "no\nbody\nhere"
    plain = [r["r"] for r in df.orderBy("page_id").select(H.body_text(F.col("dom"), None).alias("r")).collect()]
    assert plain[1:] == ["no body here", " a\nb"]


def test_headings_and_links(spark):
    df = parsed(spark, PAGE, tags=["a", *H.HEADING_TAGS])
    assert [tuple(h) for h in one(df, H.headings(F.col("dom")))] == [("H2", "FirmOne", "big red"), ("H2", "Second", "")]
    assert [tuple(a) for a in one(df, H.links(F.col("dom")))] == [
        ("JobA", "/Recruit/GI_Read/1?x=1&y=2", "t u"), ("named", "", ""), ("B", "Recruit/GI_Read/2", "")]


def test_title_links_carry_their_card(spark):
    df = parsed(spark, PAGE, tags=("a", *H.CARD_TAGS), outer_size=H.WHOLE_SOURCE)
    marker = ("data-sentry-component", "Title")
    found = one(df, H.title_links(F.col("dom"), "https://h", "/GI_Read/", marker))
    assert [(f["text"], f["href"], f["parentText"]) for f in found] == [
        ("JobA", "https://h/Recruit/GI_Read/1?x=1&y=2", "Card Job A text"), ("B", "https://h/Recruit/GI_Read/2", "")]
    assert found[1]["outerHTML"] == '<a href="Recruit/GI_Read/2" data-sentry-component="Title">B</a>'


def test_blocks_are_the_longest_and_ties_keep_their_order(spark):
    sizes = [301 + i % 3 for i in range(40)] + [300]
    html = "".join(f"<div id=d{i}>{'x' * n}</div>" for i, n in enumerate(sizes))
    blocks = one(parsed(spark, html, tags=H.BLOCK_TAGS, outer_size=1500), H.text_blocks(F.col("dom")))
    expected = sorted((i for i, n in enumerate(sizes) if n > 300), key=lambda i: (-sizes[i], i))[:30]
    assert [b["index"] for b in blocks] == expected
    assert blocks[0]["tag"] == "DIV" and blocks[0]["textLength"] == 303 and blocks[0]["outerHTMLPreview"].startswith("<div id=d2>xx")


def test_previews_are_cut(spark):
    html = f"<section class='a b'><article>{'y' * 2000}</article></section>"
    blocks = one(parsed(spark, html, tags=H.BLOCK_TAGS, outer_size=1500), H.text_blocks(F.col("dom")))
    assert [(b["tag"], len(b["textPreview"]), len(b["outerHTMLPreview"])) for b in blocks] == [("SECTION", 1000, 1500), ("ARTICLE", 1000, 1500)]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_no_page_is_lost(spark, partitions):
    pages = [(i, f"u{i}", None if i % 3 == 0 else PAGE) for i in range(20)]
    df = spark.createDataFrame(pages, "id int, url string, html string").repartition(partitions)
    rows = H.extract_or_quarantine(df).orderBy("id").collect()
    assert [r["status"] for r in rows] == ["fail" if i % 3 == 0 else "success" for i in range(20)]
    assert rows[0]["error"] == "no page stored" and rows[0]["company"] == rows[0]["json_ld"] == ""
    assert rows[1]["company"] == "FirmOne" and rows[1]["main_jd_text"] == "Q1\n\nApply\nnow\nhere" and rows[1]["error"] == ""


def test_body_may_come_from_a_frame(spark):
    df = spark.createDataFrame([("u", PAGE, "<body>frame\n\n\n\n<p>text</body>"), ("v", PAGE, None)], "url string, html string, frame string")
    rows = H.extract_or_quarantine(df, frame_html="frame").orderBy("url").collect()
    assert [(r["iframe_jd_text"], r["status"]) for r in rows] == [("frame\ntext", "success"), ("", "success")]


def test_unclosed_and_stray_tags(spark):
    df = parsed(spark, "<div><p>a<p>b</div></span><div>c</div>", tags=["div", "p"], outer_size=100)
    dom = one(df, F.col("dom"))
    assert [(n["tag"], n["outer"]) for n in dom["nodes"]] == [
        ("div", "<div><p>a<p>b</div>"), ("p", "<p>a<p>b"), ("p", "<p>b"), ("div", "<div>c</div>")]
    assert dom["texts"] == ["a", "b", "c"]


def test_selector_for_any_value_and_frames(spark):
    html = "<iframe title='x' src='/a'></iframe><iframe title='d'></iframe><p data-x='1'>one</p><p data-x=''>two</p>"
    df = spark.createDataFrame([(html, "https://h.example/p/q")], "html string, url string")
    needs = H.selector_needs(["[data-x]", "[data-x='']"])
    dom = df.select("url", H.parse_html(F.col("html"), ["iframe", *needs["tags"]], attrs=["title", "src", *needs["attrs"]]).alias("dom"))
    row = dom.select(
        H.section_text(F.col("dom"), ["[data-x]"]).alias("any"), H.section_text(F.col("dom"), ["[data-x='']"]).alias("empty"),
        H.frame_address(F.col("dom"), F.col("url"), "x").alias("frame"), H.frame_address(F.col("dom"), F.col("url"), "d").alias("bare"),
        H.frame_address(F.col("dom"), F.col("url")).alias("none"),
    ).first()
    assert tuple(row) == ("one", "two", "https://h.example/a", None, None)
