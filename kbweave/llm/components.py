"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregate-and-join steps over the edge table; the table is
written to the shared checkpoint folder after every round, so the plan stays
short and a lost executor costs one round at most. No component or edge list
ever reaches the driver or a single task: a node's smallest neighbour is a
partial aggregate, and the join back is an ordinary one that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. ``edges`` has (u, v), u != v, each link once."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.where("v > u") if large else both
    out = linked.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(low.select("u", F.col("m").alias("v")))
    else:
        # A node's own link to its smallest neighbour is kept as well.
        out = out.union(low.where("m < u").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` for every node of an edge, root being
    the smallest node reachable (the root's own row included).

    Null ends are ignored, repeated links and loops have no effect; no edges
    give no rows. Raises if ``max_rounds`` rounds do not settle the table."""
    def digest(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        return (r["n"], r["h"])

    cur = saved(edges.where("u is not null and v is not null and u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = digest(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        cur = saved(_star(_star(cur, True), False), "cc")
        now = digest(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
