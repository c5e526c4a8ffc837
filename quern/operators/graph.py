"""Graph operators over edge tables: components and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialize import materialize

#: Rows that pass one node in one task of the closure.
HUB = 1000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest node of each connected component: (node, component).

    Alternates large-star and small-star contraction, so the number of rounds
    grows with the logarithm of a component's diameter and a hub only ever
    contributes one row per neighbour. Each round is written to the shared
    folder. Self loops and null ends are ignored; nodes without an edge to
    another node don't appear. An empty edge table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    cur = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cur = materialize(cur, "edges")
    before = None
    own = Window.partitionBy("u")
    while True:
        # large star: every larger neighbour of u points at u's smallest neighbour
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(own), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: u and its smaller neighbours point at the smallest of them
        small = large.withColumn("m", F.min("v").over(own)).select("m", F.explode(F.array("u", "v")).alias("u"))
        cur = materialize(small.where("u != m").select("u", F.col("m").alias("v")).distinct(), "edges")
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def transitive_closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) reachable by one or more steps, cycles included.

    Pairs keep the length of their shortest way. A round takes the pairs that are
    exactly as long as the rounds before could reach and goes on from their ends
    by all pairs found, which gives the pairs of up to twice that length, so the
    rounds grow with the logarithm of the longest, and pairs found before are not
    joined with each other again. Rows that pass a hub are dealt over several tasks.
    """
    first = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct()
    found = materialize(first.withColumn("steps", F.lit(1).cast("long")), "closure")
    reach = 1
    while True:
        front = found.where(F.col("steps") == reach).select("src", F.col("dst").alias("mid"))
        longer = _onwards(front, found.select(F.col("src").alias("mid"), "dst", "steps"))
        longer = longer.groupBy("src", "dst").agg((F.min("steps") + reach).alias("steps"))
        new = materialize(longer.join(found, ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return found.select("src", "dst")
        found = found.unionByName(new)
        reach *= 2


def _onwards(front: DataFrame, onward: DataFrame) -> DataFrame:
    """Join on ``mid``; the rows of front at a hub meet copies of its onward rows in several tasks."""
    hubs = front.groupBy("mid").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
    hubs = F.broadcast(materialize(hubs.select("mid", F.ceil(F.col("n") / HUB).cast("int").alias("lots")), "hubs"))  # at most one for HUB rows
    lots = F.coalesce("lots", F.lit(1))
    a = front.join(hubs, "mid", "left").select("src", "mid", F.pmod(F.xxhash64("src"), lots).cast("int").alias("lot"))
    b = onward.join(hubs, "mid", "left").select("mid", "dst", "steps", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    return a.join(b, ["mid", "lot"]).select("src", "dst", "steps")
