"""From fetched mentions to scored items, gates and exclusions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T


def edition_day(ts: Column, zone: str = "UTC") -> Column:
    """Day of the edition that a time belongs to: it opens at the slot hour of the day before, in local time."""
    ts = ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)
    return F.to_date(ts + F.expr(f"interval {24 - P.SLOT_HOUR} hours"))


def delivered_once(records: DataFrame) -> DataFrame:
    """The first of the deliveries of one external id by one adapter (smallest record id)."""
    keep = records.groupBy("adapter_id", "external_id").agg(F.min("record_id").alias("record_id")).select("record_id")
    return records.join(keep, "record_id", "left_semi")


def signals(records: DataFrame) -> DataFrame:
    """Integer signals of 0 to 100 per record; null where a signal is not observed."""
    hours = F.floor((F.unix_timestamp("fetched_at") - F.unix_timestamp("published_at")) / 3600.0)
    m = F.col("metrics")
    social = m["upvotes"] + m["comments"] + m["shares"]
    return records.select(
        "record_id", "adapter_id", "source_id", "source_type", "title", "source_url", "category", "published_at", "fetched_at", "source_authority",
        F.coalesce(m["mentions"], F.lit(1)).alias("mention_count"),
        F.when(F.col("published_at").isNotNull(), S.recency(hours.cast("double"))).alias("recency"),
        S.clamp(T.round_half_up(F.col("source_authority"))).alias("authority"),
        S.saturating(F.coalesce(m["mentions"], F.lit(1)), P.SATURATION["mentions"]).alias("mentions"),
        F.when(F.col("source_type") == "github", S.saturating(m["upvotes"], P.SATURATION["stars"])).alias("github"),
        F.when(F.col("source_type").isin("x", "reddit"), S.saturating(social, P.SATURATION["social"])).alias("social"),
    )


def scored(records: DataFrame, scorer: Callable[[dict[str, Column]], Column] = S.relevance) -> DataFrame:
    """Records with their score; ``scorer`` makes it of the signals by name."""
    s = signals(records)
    parts = {k: F.col(k) for k in P.WEIGHTS}
    return s.withColumn("score", scorer(parts)).withColumns({f"weight_{k}": S.effective_weight(parts, k) for k in P.WEIGHTS})


def gated(records: DataFrame, sources: DataFrame, allow: Column | None = None, needs_approval: Column | None = None, scorer: Callable[[dict[str, Column]], Column] = S.relevance) -> DataFrame:
    """Scored records with the reason they are excluded for, null if they are published.

    ``allow`` leaves out records that are not for this edition before anything is scored, ``needs_approval`` says whose
    sources must be approved, ``scorer`` makes the score.

    The registry has a fixed number of rows per source; it is joined without a hint, so its size decides the strategy.
    """
    registry = sources.select("source_id", F.col("status"), F.col("authority_score"), F.lit(True).alias("registered"))
    records = records if allow is None else records.where(allow)
    s = scored(records, scorer).join(registry, "source_id", "left")
    minimum = F.coalesce(*[F.when(F.col("source_type") == k, F.lit(float(max(P.MIN_AUTHORITY, v)))) for k, v in P.DESCRIPTOR_MINIMUM.items()], F.lit(float(P.MIN_AUTHORITY)))
    approval = F.col("source_type").isin(*P.APPROVAL_KINDS) if needs_approval is None else needs_approval
    effective = F.greatest("source_authority", "authority_score")
    status = F.coalesce("status", F.lit("unknown"))
    reason = (
        F.when(effective < minimum, "source_authority_below_threshold")
        .when(approval & (status != "approved"), "source_not_approved")
        .when(status == "retired", "source_retired")
        .when(F.col("score") < P.PUBLICATION_FLOOR, "relevance_below_threshold")
    )
    return s.withColumn("effective_authority", effective).withColumn("minimum_authority", minimum).withColumn("reason", reason)


def exclusions(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per excluded record: edition day, item (name as slug), category, kind, reason, time."""
    g = gated(records, sources).where("reason is not null")
    return g.select(
        edition_day(F.col("fetched_at")).alias("edition"), F.coalesce(T.slug(F.col("title")), F.lit("-")).alias("item"), F.col("title").alias("name"),
        F.coalesce("category", F.lit("technique")).alias("category"), F.col("source_type").alias("kind"), "reason", F.col("fetched_at").alias("ts"), "record_id", "adapter_id",
    )


def curated_top(records: DataFrame, sources: DataFrame, k: int = 100) -> DataFrame:
    """The first ``k`` published records in curated order, with their rank."""
    g = gated(records, sources).where("reason is null")
    order = [
        F.desc("score"), F.desc("source_authority"), F.desc("mention_count"), F.desc_nulls_last("published_at"), F.desc("fetched_at"),
        F.asc(F.lower("title")), F.asc("source_url"), F.asc("record_id"),
    ]
    # a limit before the rank keeps the sort to k rows a task
    top = g.orderBy(*order).limit(k)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "record_id", "score", "title")


# ---- aggregates over exclusions


def by_field(e: DataFrame, field: str) -> DataFrame:
    return e.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("exclusions"), F.countDistinct("item").alias("items"), F.countDistinct("edition").alias("editions"))


def by_pair(e: DataFrame) -> DataFrame:
    return e.groupBy("category", "reason").agg(
        F.count(F.lit(1)).alias("exclusions"), F.countDistinct("edition").alias("editions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def recurring(e: DataFrame, editions: int = P.RECURRING_EDITIONS) -> DataFrame:
    """Items excluded in several editions, named as in the newest."""
    r = e.groupBy("item").agg(
        F.countDistinct("edition").alias("editions"), F.count(F.lit(1)).alias("exclusions"),
        F.max_by("name", F.struct("ts", "record_id")).alias("name"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )
    return r.where(F.col("editions") >= editions)


def blind_spots(e: DataFrame, editions: int = P.RECURRING_EDITIONS) -> DataFrame:
    return e.groupBy("category", "reason").agg(F.countDistinct("edition").alias("editions"), F.count(F.lit(1)).alias("exclusions")).where(F.col("editions") >= editions)


def totals(e: DataFrame) -> DataFrame:
    return e.agg(
        F.count(F.lit(1)).alias("exclusions"), F.countDistinct("item").alias("items"), F.countDistinct("edition").alias("editions"),
        F.countDistinct("category").alias("categories"), F.countDistinct("reason").alias("reasons"), F.countDistinct("kind").alias("kinds"),
    )


def summary_sets(e: DataFrame) -> DataFrame:
    """Counts by category, by reason, by both and over all, in one pass."""
    sets = e.groupingSets([["category"], ["reason"], ["category", "reason"], []], "category", "reason")
    got = sets.agg(F.grouping("category").cast("int").alias("all_categories"), F.grouping("reason").cast("int").alias("all_reasons"), F.count(F.lit(1)).alias("n"))
    return got.select("category", "reason", "all_categories", "all_reasons", "n")


def edition_report(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Per edition the published and excluded records; editions without exclusions count 0."""
    g = gated(records, sources).select(edition_day(F.col("fetched_at")).alias("edition"), F.col("reason"))
    return g.groupBy("edition").agg(
        F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("reason").isNull(), 1)).alias("published"), F.count("reason").alias("excluded")
    )
