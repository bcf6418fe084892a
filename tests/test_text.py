import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.tokens import USER_TERMS, pretokenize, segment_forms


def apply(spark, operator, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("r", operator(F.col("t")))
    return [r["r"] for r in df.orderBy("i").collect()]


GOLDEN = [
    ("ㆍ면접일정은 추후 통보됩니다.\nPython 경험", "Python 경험"),
    ("① 구직자는 알린다", "1 구직자는 알린다"),
    ("( 1명 )\n( ○명 )\n(１명)", ""),
    ("제 11 조 (채용서류의 반환) 본문", ""),
    ("제11조(채용서류", ""),
    ("대통령령으로 정하는 바", ""),
    ("포지션 및 자격요건：\n개발", "포지션 및 자격요건:\n개발"),
    ("학력 : 학력무관\nㆍ경력 : 경력무관", ""),
    ("･근무지", "・근무지"),
    ("a·b", "a b"),
    ("a  b　c\td", "a b c d"),
    ("B2B ＭＤ ㎡", "B2B MD m2"),
    ("  \n\n x \n", "x"),
    ("x\r\ny", "x\ny"),
    ("채용서류의 반환 안내", ""),
    ("", ""),
    (None, None),
]


def test_clean_text_golden(spark):
    assert apply(spark, T.clean_text, [g[0] for g in GOLDEN]) == [g[1] for g in GOLDEN]


def test_clean_text_is_idempotent_but_for_halfwidth_dot(spark):
    once = [g[1] for g in GOLDEN if g[1] is not None]
    again = apply(spark, T.clean_text, once)
    changed = [(a, b) for a, b in zip(once, again) if a != b]
    assert changed == [("・근무지", "근무지")]


def test_clause_numbers_can_be_dropped(spark):
    out = apply(spark, lambda c: T.clean_text(c, strip_clause_numbers=True), ["① 구직자는 알린다\n본문 ② x"])
    assert out == ["본문 2 x"]


def test_length_edge(spark):
    assert apply(spark, T.long_enough, ["가" * 29, "가" * 30, "가" * 14 + "\n" + "나" * 15]) == [False, True, True]


def test_whitespace_is_what_python_strips():
    assert set(T.WHITESPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_nfkc_equals_python(spark):
    values = ["é", "ﬁ ㈜ Ａ", "plain", "각", "한글 본문", "한", "½ ㎏ ①", None, "Ωμέγα", "日本語 テスト"]
    assert apply(spark, T.normalize_nfkc, values) == [v and unicodedata.normalize("NFKC", v) for v in values]


def test_strip_covers_unicode(spark):
    values = ["  a b\x1c", "\x85x ", "﻿x"]
    assert apply(spark, T.strip, values) == [v.strip() for v in values]


@pytest.mark.parametrize("blanks, expected", [(False, "a  \t b\n\nc"), (True, "a b\n\nc")])
def test_collapse_blank_lines(spark, blanks, expected):
    assert apply(spark, lambda c: T.collapse_blank_lines(c, blanks), ["\na  \t b\n\n\n\nc \n"]) == [expected]


def test_only_one_whole_json_document_is_accepted(spark):
    values = ['{"a": 1}', '{"a": 1}\n{"b": 2}', "", None, "1, 2", "1],[2", '1},{"x":2', '{"a"', "[1, 2]", '"x"', '1, "x": 2', " 7 "]
    good = [True, False, False, False, False, False, False, False, True, True, False, True]
    assert apply(spark, T.is_json_document, values) == good
    parsed = apply(spark, lambda c: T.parse_json_ld(c).isNotNull(), values)
    assert parsed == good


def test_url_keys_and_detail_url(spark):
    urls = ["https://x/Recruit/GI_Read/491?a=1&Oem_Code=K9&b", "https://x/Recruit/GI_Read/7", "https://x/other"]

    def keys(c):
        number, code = T.extract_url_keys(c)
        return F.concat_ws("|", F.coalesce(number, F.lit("-")), code)

    assert apply(spark, keys, urls) == ["491|K9", "7|C1", "-|C1"]
    detail = apply(spark, lambda c: T.build_detail_url(*T.extract_url_keys(c)), urls)
    assert detail[0].endswith("?Oem_Code=K9&Gno=491&isHiringCenter=false&hideMapView=false") and detail[2] is None


def test_links_are_made_absolute(spark):
    hrefs = ["/a", "b", "http://z/c", "?q=1", "../up"]
    assert apply(spark, lambda c: T.absolutize_url(c, "https://h"), hrefs) == [
        "https://h/a", "https://h/b", "http://z/c", "https://h/?q=1", "https://h/../up"]
    resolved = apply(spark, lambda c: T.resolve_url(F.lit("https://h/x/y/z"), c), [*hrefs, None])
    assert resolved == ["https://h/a", "https://h/x/y/b", "http://z/c", "https://h/x/y/z?q=1", "https://h/x/up", None]


def test_join_parts_skips_missing(spark):
    assert apply(spark, lambda c: T.join_parts(F.array(F.lit("x"), F.lit(None), c), "\n\n"), ["y", None]) == ["x\n\ny", "x"]


def test_pretokenize(spark):
    values = ["B2B 영업, café (3년)!", "a​b\x00c�", "x　y\tz", "理事 C++ $5"]
    assert apply(spark, pretokenize, values) == [
        ["B2B", "영업", ",", "café", "(", "3년", ")", "!"], ["abc"], ["x", "y", "z"], ["理事", "C", "+", "+", "$", "5"]]
    special = apply(spark, lambda c: pretokenize(c, ["[UNK]", "[MASK]"]), ["a [MASK]b [X]"])
    assert special == [["a", "[MASK]", "b", "[", "X", "]"]]


def test_user_terms_stay_whole(spark):
    forms = apply(spark, segment_forms, ["4대보험, B2B영업 백엔드개발자 주5일 2년차"])[0]
    assert forms == ["4대보험", ",", "B2B", "영업", "백엔드", "개발자", "주5일", "2", "년차"]
    assert all(apply(spark, segment_forms, [t]) == [[t]] for t in USER_TERMS[:4])
