"""Connected components by hooking and contraction, as joins over an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import join_hot, work_table


def _flipped(pairs: DataFrame) -> DataFrame:
    """Every pair in both directions: (node, other)."""
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))


def _hooks(pairs: DataFrame, total: int, turn: int) -> DataFrame:
    """(node, up, n): the least node, in an order drawn anew each turn, within two links of the node; n
    is the node's number of links."""
    drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("node"))
    ends = _flipped(pairs)
    near = ends.groupBy("node").agg(F.count("*").alias("n"), F.min(drawn("other")).alias("m"))
    near = work_table(near.select("node", "n", F.least("m", drawn("node")).alias("m")), "near")
    around = join_hot(ends, near.withColumnRenamed("node", "other"), ["other"], total).groupBy("node").agg(F.min("m").alias("far"))
    return work_table(near.join(around, "node").select("node", F.least("m", "far").getField("node").alias("up"), "n"), "hooks")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any orderable type -> (node, root); root is the smallest node of the
    component. Nodes without an edge to another node don't appear. Null ends are ignored.

    In each round every node hooks to the least node within two links, hooks are followed once, and
    the edges become those between the nodes reached. "Least" is by a hash drawn anew each round, so
    ids in an unlucky order cost nothing: on a path about one node of five is left a round, on a
    star one. Rounds are logarithmic in the number of nodes. At the end the rounds' maps, each a
    fraction of the one before, are composed from the last to the first. Every round is written;
    nodes with very many links are joined apart (join_hot).
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    rest = work_table(edges.where("a is not null and b is not null").select(*pair).where("a < b").distinct(), "edges")
    kind, maps = rest.schema["a"].dataType, []
    while total := rest.count():
        hook = _hooks(rest, total, len(maps))
        again = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = work_table(hook.join(again, "up").select("node", F.col("top").alias("up"), "n"), "map")
        maps.append(step)
        at = lambda c: step.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"), "n")  # noqa: E731, B023
        moved = join_hot(rest, at("a"), ["a"], total).select("b", "a_up")
        moved = join_hot(moved, at("b"), ["b"], total).select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        rest = work_table(moved.where("a < b").distinct(), "edges")
    if not maps:
        return rest.select(F.col("a").alias("node"), F.col("b").cast(kind).alias("root"))

    def below(later: DataFrame, earlier: DataFrame) -> DataFrame:
        on = later.select(F.col("node").alias("up"), F.col("up").alias("top"))
        return work_table(earlier.select("node", "up").join(on, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "tops")

    tops = reduce(below, reversed(maps[:-1]), maps[-1].select("node", "up"))
    least = work_table(tops.groupBy("up").agg(F.min("node").alias("root"), F.count("*").alias("n")), "roots")
    return join_hot(tops, least, ["up"], tops.count()).select("node", "root")
