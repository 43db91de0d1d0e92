"""Records as items of an edition: ids, categories, mentions, and the checks that an item must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators.identity import paper_id


def stable_id(category: Column, url: Column, name: Column) -> Column:
    """Category group with the repository or the paper that the link leads to, else with the name without its common words, else with the name."""
    repository = F.regexp_extract(U.repository(url), r"([^/]+/[^/]+)$", 1)
    return F.concat_ws("-", T.category_group(category), T.slug(F.coalesce(F.nullif(repository, F.lit("")), paper_id(url), T.alias(name), name)))


def normalised(records: DataFrame) -> DataFrame:
    """One item a record, with defaults in place: category by the rules of its kind, at least one mention, links each once in their best spelling.

    Records without a title or a link that is a URL make no item. Mentions count the different sources behind the links.
    """
    none = F.array().cast("array<string>")
    links = F.array_distinct(F.filter(F.concat(F.array("source_url"), F.coalesce("source_urls", none)), U.is_url))
    rows = records.where(U.is_url(F.col("source_url")) & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    text = F.concat_ws(" ", "title", "summary")
    category = F.when(F.col("category").isin(*P.CATEGORIES), F.col("category")).otherwise(T.kind_category(F.col("source_type"), text))
    rows = rows.withColumn("kept", category).withColumn("links", links)
    return rows.select(
        "record_id", stable_id(F.col("kept"), F.col("source_url"), F.col("title")).alias("item_id"), F.trim("title").alias("name"), F.col("kept").alias("category"),
        F.greatest(F.lit(1), F.size(F.array_compact(F.array_distinct(F.transform("links", U.source_cluster))))).alias("mention_count"), F.size(F.array_distinct(F.transform("links", U.dedupe_key))).alias("pages"),
        F.least("published_at", "fetched_at").alias("first_seen"), "source_authority",
    )


def best_links(rows: DataFrame, key: str) -> DataFrame:
    """``key, page, url``: of the spellings of a page that a group has the best one, then the more specific, then the first in order."""
    none = F.array().cast("array<string>")
    each = rows.select(key, F.explode(F.concat(F.array("source_url"), F.coalesce("source_urls", none))).alias("url")).where(U.is_url(F.col("url")))
    each = each.withColumn("page", U.dedupe_key(F.col("url")))
    return each.groupBy(key, "page").agg(F.min_by("url", F.struct(-U.variant_score(F.col("url")), -U.specificity(F.col("url")), "url")).alias("url"))


def violations(items: DataFrame) -> DataFrame:
    """``rule, n``: how many rows of an edition break each rule of an item; rules that hold have none."""
    rules = {
        "name": F.trim(F.coalesce("item_name", F.lit(""))) == "",
        "link": ~U.is_url(F.coalesce("source_url", F.lit(""))),
        "category": ~F.coalesce(F.col("category").isin(*P.CATEGORIES), F.lit(False)),
        "score": ~F.coalesce(F.col("relevance_score").between(0, 100), F.lit(False)),
        "mentions": F.coalesce(F.col("mention_count"), F.lit(0)) < 1,
        "editions": F.coalesce(F.col("edition_count"), F.lit(0)) < 1,
        "first_seen": F.coalesce(F.col("first_seen") > F.col("published_at"), F.lit(True)),
        "links_once": F.size(F.array_distinct("source_urls")) < F.size("source_urls"),
    }
    each = F.explode(F.filter(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]), lambda r: r.isNotNull())).alias("rule")
    twice = items.groupBy("item_id", "edition_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("once_an_edition").alias("rule"), "n").where("n > 0")
    return items.select(each).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).unionByName(twice)
