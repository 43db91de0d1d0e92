"""Sources: coverage, signals, authority, lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators.records import edition_day, scored


def active(sources: DataFrame) -> DataFrame:
    return sources.where("status = 'approved' and not coalesce(seed, false)")


def coverage(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Active sources of every category, none left out: blind, fragile or covered."""
    of = records.where("category is not null").select("source_id", "category").distinct().join(active(sources).select("source_id"), "source_id")
    counts = of.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.createDataFrame([(c,) for c in P.CATEGORIES], "category string")
    got = every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("active_sources"))
    return got.withColumn("status", F.when(F.col("active_sources") == 0, "blind").when(F.col("active_sources") < P.MIN_ACTIVE_PER_CATEGORY, "fragile").otherwise("covered"))


def guarded(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Active sources that are the only one of a category on a source kind, which protects them from retirement."""
    of = records.where("category is not null").select("source_id", "source_type", "category").distinct().join(active(sources).select("source_id"), "source_id")
    only = of.groupBy("source_type", "category").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("source_id")).where("n = 1")
    return only.select("source_type", "category", "source_id")


def evidence(records: DataFrame, sources: DataFrame) -> DataFrame:
    """What the mentions say about each candidate source that their outbound links lead to."""
    # what a text says of the topics is a few bits; the text itself goes no further
    low = F.lower(F.concat_ws(" ", "title", "summary"))
    topics = sum(F.when(F.contains(low, F.lit(k)), 1 << i).otherwise(0) for i, k in enumerate(P.TOPICAL_KEYWORDS))
    links = records.select("record_id", F.col("source_id").alias("referrer"), F.col("source_type").alias("platform"), edition_day(F.col("fetched_at")).alias("cycle"), topics.alias("topics"), F.explode("outbound_urls").alias("u"))
    links = links.withColumn("candidate", U.source_candidate(F.col("u"))).where("candidate is not null").drop("u").distinct()
    links = links.join(scored(records).select("record_id", "score"), "record_id")
    # first by referrer, so that what is counted apart is combined before it meets in one place
    near = links.groupBy("candidate", "referrer", "platform", "cycle").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("topics").alias("topics"), F.sum("score").alias("score_sum"), F.count(F.when(F.col("score") >= P.HIGH_SIGNAL, 1)).alias("high")
    )
    return near.groupBy("candidate").agg(
        F.sum("n").alias("mentions"), F.countDistinct("referrer").alias("referrers"), F.countDistinct("platform").alias("platforms"), F.countDistinct("cycle").alias("cycles"),
        F.bit_count(F.bit_or("topics")).cast("bigint").alias("topics"), F.sum("score_sum").alias("score_sum"), F.sum("high").alias("high"),
    )


def signal_scores(records: DataFrame, sources: DataFrame) -> DataFrame:
    e = evidence(records, sources)
    score = S.source_signal(F.col("mentions"), F.col("referrers"), F.col("platforms"), F.col("cycles"), F.col("topics"), F.col("score_sum") / F.col("mentions"), F.col("high"))
    e = e.withColumn("signal", score)
    return e.select("candidate", "mentions", "referrers", "signal", (F.col("signal") >= P.MIN_SIGNAL).alias("eligible"))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources in order: status, weighted authority, authority, id."""
    rank = F.when(F.col("status") == "approved", 0).when(F.col("status") == "candidate", 1).otherwise(2)
    weight = F.when(F.col("status") == "approved", 1.0).when(F.col("status") == "retired", 0.0).otherwise(P.PROBATION_WEIGHT)
    s = sources.withColumn("weighted", T.round_half_up(F.coalesce("authority_score", F.lit(0.0)) * weight))
    # the registry is small and has a row per source; a global rank is its purpose
    w = Window.orderBy(rank, F.desc("weighted"), F.desc_nulls_last("authority_score"), "source_id")
    return s.select("source_id", "status", F.col("weighted").cast("bigint").alias("weighted"), F.row_number().over(w).alias("rank"))


def cycles(records: DataFrame) -> DataFrame:
    """Best score of each source in each cycle (edition day)."""
    s = scored(records).where("source_id is not null")
    return s.select("source_id", edition_day(F.col("fetched_at")).alias("cycle"), "score").groupBy("source_id", "cycle").agg(F.max("score").alias("best"))


def low_signal_streaks(records: DataFrame) -> DataFrame:
    """Runs of consecutive days on which a source had no item of high signal."""
    low = cycles(records).where(F.col("best") < P.HIGH_SIGNAL)
    w = Window.partitionBy("source_id").orderBy("cycle")
    runs = low.withColumn("island", F.date_sub("cycle", F.row_number().over(w)))
    return runs.groupBy("source_id", "island").agg(F.min("cycle").alias("starts"), F.max("cycle").alias("ends"), F.count(F.lit(1)).alias("days")).where(F.col("days") >= P.RETIREMENT_CYCLES).drop("island")


def qualifying(records: DataFrame) -> DataFrame:
    """Days on which a source has at least three qualifying cycles within the trailing window."""
    q = cycles(records).where(F.col("best") >= P.PROMOTION_SCORE).withColumn("day", F.unix_date("cycle"))
    w = Window.partitionBy("source_id").orderBy("day").rangeBetween(-(P.PROMOTION_DAYS - 1), 0)
    return q.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= P.PROMOTION_CYCLES).select("source_id", "cycle", "n")


def expertise(items: DataFrame) -> DataFrame:
    """Retention of a source's items of high score: mean outcome and the adjustment of authority it gives."""
    best = items.where("relevance_score is not null and source_id is not null").groupBy("source_id", "item_id", "edition_id").agg(F.max("relevance_score").alias("score"))
    per = best.groupBy("source_id", "item_id").agg(
        F.min_by("score", "edition_id").alias("first"), F.max_by("score", "edition_id").alias("latest"), F.count(F.lit(1)).alias("n")
    ).where(F.col("first") >= P.HIGH_SIGNAL)
    kept = F.when(F.col("latest") < 60, 0.0).when(F.col("first") <= 60, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("latest") - 60) / (F.col("first") - 60))))
    outcome = F.when(F.col("n") < 2, -1.0).otherwise(F.when(F.col("n") >= 3, 1.0).otherwise(0.5) * kept)
    per = per.withColumn("outcome", T.round_half_up(outcome * 10000).cast("bigint"))
    got = per.groupBy("source_id").agg(F.count(F.lit(1)).alias("items"), F.sum("outcome").alias("total"))
    return got.select("source_id", "items", "total", T.round_half_up(F.col("total") * 12 / (F.col("items") * 10000)).cast("bigint").alias("adjustment"))


def fetch_report(records: DataFrame) -> DataFrame:
    """Per cycle: records and kinds fetched, kinds missing, status."""
    kinds = F.array_sort(F.collect_set("source_type"))
    r = records.groupBy(edition_day(F.col("fetched_at")).alias("cycle")).agg(F.count(F.lit(1)).alias("records"), kinds.alias("kinds"))
    missing = F.array_except(F.array(*[F.lit(k) for k in sorted(P.SOURCE_KINDS)]), F.col("kinds"))
    return r.select("cycle", "records", F.array_join("kinds", ",").alias("kinds"), F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) == 0, "ok").otherwise("partial").alias("status"))
