"""Editions: histories of items, references, tracked state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import urls as U


def appearances(items: DataFrame) -> DataFrame:
    """One row per item and edition: the one with the smallest appearance id (repeated rows count once)."""
    keep = items.groupBy("item_id", "edition_id").agg(F.min("appearance_id").alias("appearance_id")).select("appearance_id")
    return items.join(keep, "appearance_id", "left_semi")


def latest_edition(items: DataFrame, now: str) -> DataFrame:
    """The newest edition that is not in the future."""
    items = items.where(F.col("published_at") <= F.lit(now).cast("timestamp_ntz"))
    top = items.agg(F.max("published_at").alias("published_at"))
    return items.join(F.broadcast(top), "published_at")  # one row


def history(items: DataFrame, now: str, days: int = P.ARCHIVE_DAYS) -> DataFrame:
    """Appearances of the last days, open at the start and closed at the end."""
    end = F.lit(now).cast("timestamp_ntz")
    return items.where((F.col("published_at") > end - F.expr(f"interval {days} days")) & (F.col("published_at") <= end))


def lifecycle(items: DataFrame) -> DataFrame:
    """Every appearance with its number and the change of score from the one before and from the first."""
    a = appearances(items)
    w = Window.partitionBy("item_id").orderBy("published_at", "appearance_id")
    return a.select(
        "appearance_id", "item_id", "edition_id", "relevance_score", F.row_number().over(w).alias("appearance"),
        F.round(F.col("relevance_score") - F.lag("relevance_score").over(w), 4).alias("from_previous"),
        F.round(F.col("relevance_score") - F.first("relevance_score").over(w), 4).alias("from_first"),
    )


def latest_versions(items: DataFrame) -> DataFrame:
    """The newest appearance of every item; combined before the shuffle, so no window over an item."""
    best = items.groupBy("item_id").agg(F.max_by("appearance_id", F.struct("published_at", "appearance_id")).alias("appearance_id"))
    return items.join(best.select("appearance_id"), "appearance_id", "left_semi")


def tracked_state(items: DataFrame) -> DataFrame:
    """Running count of editions and earliest first sight at every appearance."""
    w = Window.partitionBy("item_id").orderBy("published_at", "appearance_id").rowsBetween(Window.unboundedPreceding, 0)
    return appearances(items).select("appearance_id", "item_id", F.count(F.lit(1)).over(w).alias("editions_so_far"), F.min("first_seen").over(w).alias("seen_so_far"))


def material_changes(items: DataFrame) -> DataFrame:
    """Appearances whose summary or category differs from the one before; scores are no change."""
    w = Window.partitionBy("item_id").orderBy("published_at", "appearance_id")
    a = appearances(items).withColumn("was", F.lag(F.struct("summary", "category")).over(w))
    return a.where(F.col("was").isNotNull() & ~F.struct("summary", "category").eqNullSafe(F.col("was"))).select("appearance_id", "item_id", "edition_id")


def score_history(items: DataFrame) -> DataFrame:
    a = appearances(items)
    at = F.struct("published_at", "appearance_id")
    return a.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("appearances"), F.min_by("relevance_score", at).alias("first_score"), F.max_by("relevance_score", at).alias("last_score"),
        F.round(F.max_by("relevance_score", at) - F.min_by("relevance_score", at), 4).alias("delta"),
    )


def clusters(urls: Column) -> Column:
    return F.size(F.array_compact(F.array_distinct(F.transform(F.coalesce(urls, F.array().cast("array<string>")), U.source_cluster))))


def _candidates(items: DataFrame, now: str) -> DataFrame:
    end = F.lit(now).cast("timestamp_ntz")
    cut = end - F.expr(f"interval {P.ARCHIVE_DAYS} days")
    a = items.where(F.col("published_at") <= end)
    recent = a.where(F.col("published_at") > cut).select("item_id").distinct()
    return latest_versions(a.where(F.col("published_at") <= cut)).join(recent, "item_id", "left_anti").withColumn("clusters", clusters(F.col("source_urls")))


def references(items: DataFrame, now: str) -> DataFrame:
    """Aged-out items worth keeping: strict ones, and the best of one cluster for each category that has none."""
    c = _candidates(items, now).where((F.col("edition_count") >= P.REFERENCE_EDITIONS) & (F.col("relevance_score") >= P.PUBLICATION_FLOOR))
    strict = c.where(F.col("clusters") >= P.REFERENCE_CLUSTERS)
    weak = c.where(F.col("clusters") == 1).join(strict.select("category").distinct(), "category", "left_anti")
    order = F.struct("relevance_score", "edition_count", "published_at", (-F.col("appearance_id")).alias("a"))
    best = weak.groupBy("category").agg(F.max_by("appearance_id", order).alias("appearance_id"))
    fallback = weak.join(best.select("appearance_id"), "appearance_id", "left_semi")
    cols = ["appearance_id", "item_id", "category", "relevance_score"]
    return strict.select(*cols, F.lit("strict").alias("kind")).unionByName(fallback.select(*cols, F.lit("fallback").alias("kind")))


def fallback_per_category(items: DataFrame, now: str) -> DataFrame:
    """The best aged-out item of each category, strict or not."""
    order = F.struct("relevance_score", "edition_count", "published_at", (-F.col("appearance_id")).alias("a"))
    return _candidates(items, now).where("relevance_score is not null").groupBy("category").agg(F.max_by("item_id", order).alias("item_id"), F.max("relevance_score").alias("relevance_score"))


def union_of_editions(*parts: DataFrame) -> DataFrame:
    """Union by item and edition in which the later part wins."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    keep = out.groupBy("item_id", "edition_id").agg(F.max(F.struct("part", "appearance_id")).alias("k")).select("k.part", "k.appearance_id")
    return out.join(keep, ["part", "appearance_id"], "left_semi")


def reference_order(references: DataFrame, items: DataFrame) -> DataFrame:
    """References with their place: score, editions and time falling, then the name. There are few."""
    r = references.join(items.select("appearance_id", "edition_count", "published_at", "item_name"), "appearance_id")
    w = Window.orderBy(F.desc("relevance_score"), F.desc("edition_count"), F.desc("published_at"), F.lower("item_name"), "appearance_id")
    return r.select("appearance_id", "item_id", F.row_number().over(w).alias("place"))


def since_checkpoint(items: DataFrame, checkpoint: str, task: str) -> DataFrame:
    """``item_id, change, matched``: items of editions after a checkpoint that a task is about and that are new to the consumer or changed in their summary.

    Words of the task of more than two letters are sought in name and summary. An item is compared with its last appearance
    at or before the checkpoint.
    """
    at = F.lit(checkpoint).cast("timestamp_ntz")
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(w for w in re.split(r"\W+", task.lower()) if len(w) > 2)])
    old = items.where(F.col("published_at") <= at).groupBy("item_id").agg(F.max_by("summary", F.struct("published_at", "appearance_id")).alias("was"), F.lit(True).alias("known"))
    new = items.where(F.col("published_at") > at).groupBy("item_id").agg(F.max_by(F.struct("summary", "item_name"), F.struct("published_at", "appearance_id")).alias("x"))
    j = new.select("item_id", "x.*").join(old, "item_id", "left")
    low = F.lower(F.concat_ws(" ", "item_name", "summary"))
    j = j.withColumn("matched", F.array_join(F.filter(terms, lambda t: F.contains(low, t)), ","))
    change = F.when(F.col("known").isNull(), "new_to_consumer").when(~F.col("summary").eqNullSafe(F.col("was")), "material_change")
    return j.where("matched <> ''").select("item_id", change.alias("change"), "matched").where("change is not null")
