"""What the connectors of the source families do after fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as T


def merged_repositories(rows: DataFrame) -> DataFrame:
    """Rows of one repository merged: most stars and forks, longest summary, latest push, channels that saw it."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.trim("external_id"), r"^(?:https?://)?(?:www\.)?github\.example/", ""), r"(?:\.git)?/*$", ""))
    return rows.groupBy(key.alias("repository")).agg(
        F.count(F.lit(1)).alias("fetches"), F.max("stars").alias("stars"), F.max("forks").alias("forks"), F.max("pushed_at").alias("pushed_at"), F.min("created_at").alias("created_at"),
        F.max_by("summary", F.when(F.col("summary").isNotNull(), F.struct(F.length("summary"), -F.col("record_id")))).alias("summary"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.bool_or("archived").alias("archived"),
    )


def activity(rows: DataFrame) -> DataFrame:
    """Activity of each fetch from the days since the last push, stars and forks."""
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp("ingested_at") - F.unix_timestamp("pushed_at")) / 86400.0))
    return rows.select("record_id", S.github_activity(days, F.col("stars"), F.col("forks")).cast("bigint").alias("activity"))


def repository_risk(rows: DataFrame) -> DataFrame:
    """Risk by what is known of a repository."""
    risk = F.when(F.col("archived"), "high").when((F.col("channel") == "search") & F.col("license").isNull(), "medium").when(F.col("channel") == "trending", "unknown").otherwise("low")
    return rows.groupBy("channel", risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


def latest_papers(rows: DataFrame) -> DataFrame:
    """The newest version of each paper."""
    base = F.regexp_replace("external_id", r"v\d+$", "")
    version = F.coalesce(F.nullif(F.regexp_extract("external_id", r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    return rows.groupBy(base.alias("paper")).agg(F.count(F.lit(1)).alias("rows"), F.max(version).alias("version"), F.max_by("paper_id", F.struct(version, F.col("paper_id"))).alias("paper_id"))


def paper_window(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Papers published within a window, both ends included, newest first by rank within the day."""
    return rows.where(F.col("published_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).groupBy(F.to_date("published_at").alias("day"), "primary_category").agg(F.count(F.lit(1)).alias("papers"))


def with_authors(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with the registry entry of their account; records of unknown accounts stay."""
    s = sources.select("source_id", "display_name", "authority_score")
    return records.select("record_id", "source_id").join(s, "source_id", "left").select("record_id", F.coalesce("display_name", "source_id").alias("author"), "authority_score")


def authority_of_accounts(records: DataFrame) -> DataFrame:
    """Records, authority and engagement by source type."""
    m = F.col("metrics")
    return records.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.coalesce(m["upvotes"] + m["comments"] + m["shares"], F.lit(0))).alias("engagement"), F.max("source_authority").alias("authority")
    )


def tags(records: DataFrame) -> DataFrame:
    """Distinct sorted tags of each record that has any."""
    return records.where(F.size("tags") > 0).select("record_id", F.array_join(F.array_sort(F.array_distinct("tags")), ",").alias("tags"))


def text_facts(records: DataFrame) -> DataFrame:
    """Comparable title, slug, inferred category and topics."""
    text = F.concat_ws(" ", "title", "summary")
    return records.select("record_id", T.comparable(F.col("title")).alias("comparable"), T.slug(F.col("title")).alias("slug"), T.category_of(text).alias("category"), F.array_join(T.topic_hits(text), ",").alias("topics"))
