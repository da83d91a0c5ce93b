"""Connected components of a table of links, for operators that return classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetext.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a long, b long); nodes of a component share a label.

    Contraction: every node moves to the neighbour first in a fixed random order, one jump further where that
    neighbour moves too, and links are renamed, until none is left between different labels. The nodes shrink
    by a constant factor a round, stars in two. Each round is written to the shared folder; all joins are
    sort-merge joins of two exchanges, which adaptive execution splits at a hub.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.filter("a <> b").distinct(), "edges")
    moved = None
    while not edges.isEmpty():
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        step = written(edges.groupBy("a").agg(F.min(first("b")).alias("m")).select("a", F.least("m", first("a")).getField("v").alias("to")), "step")
        jump = step.select(F.col("a").alias("to"), F.col("to").alias("then")).hint("merge")
        step2 = written(step.join(jump, "to").select("a", F.col("then").alias("to")), "jump")
        to = lambda c, t: step2.select(F.col("a").alias(c), F.col("to").alias(t)).hint("merge")
        then = written(edges.join(to("a", "x"), "a").join(to("b", "y"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if moved is None:
            now = written(step2.select(F.col("a").alias("node"), F.col("to").alias("label")), "labels")
        else:
            now = written(moved.join(to("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            drop_written(moved)
        for old in (edges, step, step2):
            drop_written(old)
        edges, moved = then, now
    return moved if moved is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
