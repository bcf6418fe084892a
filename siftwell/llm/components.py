"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.columns import sent_if_small
from siftwell.session import stage, unstage

#: Most bytes of a node and its label in memory.
ROW_BYTES = 80


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the smallest node of its component.

    Each round takes the smallest label among the neighbours, then the label of that label, so long chains shrink by
    half or more per round. ``start`` (node, label) may name for some nodes another of the same component, which saves
    rounds. Every state is a written table, the one before is deleted; nothing is collected but the number of changes.
    Labels are sent to all tasks if they are few; else a hot node is split by the skew join, since both sides are plain
    scans.
    """
    both = stage(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "neighbours"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label"))
    if start is not None:
        known = sent_if_small(start.select("node", F.col("label").alias("known")), ROW_BYTES)
        labels = labels.join(known, "node", "left").select("node", F.least("label", "known").alias("label"))
    state = stage(labels, "labels")
    nodes = state.count()
    while True:
        near = state.select(F.col("node").alias("b"), F.col("label").alias("near"))
        own = state.select(F.col("node").alias("a"), F.col("label").alias("old"))
        nearest = both.join(sent_if_small(near, ROW_BYTES, nodes), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = stage(
            nearest.join(sent_if_small(own, ROW_BYTES, nodes), "a").select(
                F.col("a").alias("node"), F.least("old", "near").alias("next"), "old"
            ),
            "hooked",
        )
        up = hooked.select(F.col("node").alias("next"), F.col("next").alias("label"))
        jumped = stage(hooked.join(sent_if_small(up, ROW_BYTES, nodes), "next").select("node", "label", "old"), "labels")
        changes = jumped.where("label <> old").limit(1).count()
        unstage(state, hooked)
        state = jumped
        if not changes:
            unstage(both)
            found = state.select("node", "label")
            found.staged_path = state.staged_path
            return found
