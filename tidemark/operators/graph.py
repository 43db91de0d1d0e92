"""Edges, chains and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shared import park, unpark


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, each once."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the smallest node reached from it.

    Alternating star operations; each round is parked in the shared folder, and as trees are flattened on the way, few
    rounds are needed. Each operation is a group-by and a join on nodes, combined before the shuffle. The roots of all
    edges only ever fall, so a round that leaves their number and checksum as they were was the last.
    """
    e = park(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    was = _checksum(e)
    for _ in range(200):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        then = park(small, "components")
        now = _checksum(then)
        unpark(e)
        e = then
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components do not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _checksum(e: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def ends_of_chains(pointers: DataFrame) -> DataFrame:
    """``node, end`` of pointers ``node, next``: where a chain ends; nodes of a cycle end at its smallest node.

    Pointers are doubled, so a chain of n steps takes log n rounds; cycles are recognised by nodes that never end.
    """
    p = park(pointers.where("node is not null and next is not null and node <> next").groupBy("node").agg(F.min("next").alias("end")).withColumn("low", F.least("node", "end")), "chains")
    last = None
    for _ in range(200):
        to = p.select(F.col("node").alias("end"), F.col("end").alias("then"), F.col("low").alias("least"))
        p = park(p.join(to, "end", "left").select("node", F.coalesce("then", "end").alias("end"), F.least("low", F.coalesce("least", "low")).alias("low")), "chains")
        open_ = p.join(p.select(F.col("node").alias("end")), "end", "left_semi").count()
        if open_ == 0 or open_ == last and last is not None and _settled(p):
            break
        last = open_
    else:
        raise RuntimeError("chains do not end")
    cyclic = p.join(p.select(F.col("node").alias("end")), "end", "left_semi").select("node").withColumn("cyclic", F.lit(True))
    return p.join(cyclic, "node", "left").select("node", F.when(F.col("cyclic"), F.col("low")).otherwise(F.col("end")).alias("end"))


def _settled(p: DataFrame) -> bool:
    """True when every node that still points on has seen the smallest node of its cycle."""
    to = p.select(F.col("node").alias("end"), F.col("low").alias("least"))
    return p.join(to, "end").where("least < low").isEmpty()
