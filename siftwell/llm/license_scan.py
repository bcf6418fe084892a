"""Licence scan: ordered signature rules behind a keyword filter, with suppression of contained detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.columns import ascii_lower, only
from siftwell.llm.license_rules import Rule, build_rules

#: Everything that is neither 0-9, a-z nor wide, after A-Z is lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"  # never inside normalised words


def normalised_words(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased and one blank between them; null counts as empty."""
    return F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, " "))


def _spans(words: Column, pattern: Column) -> Column:
    """First and last word of every match: the matches are marked, then the marked words are numbered."""
    marked = F.split(F.regexp_replace(words, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), " ", -1)
    at = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    return F.arrays_zip(
        at(lambda w: w.startswith(_OPEN)).alias("first"), at(lambda w: w.endswith(_CLOSE)).alias("last")
    )


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """Detections (row, doc_id, n_words, rule, label, priority, base, first, last, kept, fresh) of all rules.

    Every row of ``docs`` has one detection of rule -1 (no label), so that texts without a licence are not lost; a null
    or empty text has no words. Repeated rows are scanned each for itself. A detection is kept unless it lies inside
    another of the same or a higher priority (of two equal ones, the rule listed first); base detections are always
    counted, kept or not. ``fresh`` is the number of its words that no detection in front of it covers.

    Texts meet only the rules whose gate they contain, inside their own task; what is shuffled is one narrow row per
    detection. The rules are a fixed list, so sending them to all tasks is safe.
    """
    rules = build_rules() if rules is None else rules
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(i, *rule) for i, rule in enumerate(rules)] + [(-1, None, "", None, -1, False)],
        "rule int, label string, gate string, pattern string, priority int, base boolean",
    )
    gates = sorted({rule.gate for rule in rules})
    found_gates = F.filter(F.array(*map(F.lit, gates)), lambda gate: F.contains(F.col("words"), gate))
    texts = only(docs, doc_id=doc_id, text=text).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", normalised_words(F.col("text")).alias("words")
    )
    spaces = F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit("")))
    texts = texts.select(
        "row", "doc_id", "words", F.when(F.length("words") > 0, spaces + 1).otherwise(0).cast("long").alias("n_words")
    ).withColumn("gate", F.explode(F.concat(F.array(F.lit("")), found_gates)))
    tried = texts.join(F.broadcast(table), "gate").where(F.col("pattern").isNull() | F.rlike(F.col("words"), F.col("pattern")))
    places = tried.withColumn(
        "place", F.explode_outer(F.when(F.col("pattern").isNotNull(), _spans(F.col("words"), F.col("pattern"))))
    ).select("row", "doc_id", "n_words", "rule", "label", "priority", "base", "place.first", "place.last")
    before = (
        Window.partitionBy("row")
        .orderBy("first", F.desc("last"), F.desc("priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    levels = sorted({rule.priority for rule in rules})
    covers = [
        (F.col("priority") == level)
        & (F.max(F.when(F.col("priority") >= level, F.col("last"))).over(before) >= F.col("last"))
        for level in levels
    ]
    reached = F.greatest(F.coalesce(F.max("last").over(before), F.lit(-1)), F.col("first") - 1)
    return places.withColumns(
        {
            "kept": ~F.coalesce(reduce(lambda a, b: a | b, covers), F.lit(False)),
            "fresh": F.coalesce(F.greatest(F.col("last") - reached, F.lit(0)), F.lit(0)),
        }
    )


def license_digest(detections: DataFrame) -> DataFrame:
    """One row per scanned row: counts and places of base phrases, labels, and the share of words under a detection."""
    base = F.col("base")
    labels = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return (
        detections.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count_if(base).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(base | F.col("kept")).alias("labels"),
            F.sum("fresh").alias("covered"),
        )
        .withColumn(
            "score", F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0).cast("double")
        )
        .drop("row", "covered")
    )
