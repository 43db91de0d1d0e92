"""Storylines: what an appearance adds to an item's story, and how the story stands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.functions.ladders import reference_score
from tidemark.operators.editions import appearances, latest_versions
from tidemark.operators.graph import ends_of_chains
from tidemark.plans.shared import park

#: Fixed value: columns of a lifecycle step.
STATE = "appearance_id bigint, item_id string, decision string, status string, evolutions bigint, repetitions bigint, streak bigint"


def storyline_ids(items: DataFrame) -> DataFrame:
    """Storyline id of each item from its category group and the first three telling tokens of its name, else of its summary."""
    told = lambda c: F.slice(T.storyline_tokens(F.col(c)), 1, P.STORYLINE_TOKENS)
    name = F.array_join(F.when(F.size(told("item_name")) > 0, told("item_name")).otherwise(told("summary")), "-")
    return items.select("appearance_id", F.concat(F.lit("storyline-"), T.category_group(F.col("category")), F.lit("-"), name).alias("storyline_id"))


def _novel_facts(a: DataFrame) -> DataFrame:
    """``appearance_id, facts``: the clauses that are not like any clause of an earlier appearance of the item.

    Clauses with the same words are alike, so each set of words stands once, where it first appears. Two sets that are alike
    share one of the first ``n - ceil(t n) + 1`` words of each in any common order; long words first, as they are rarer.
    """
    told = a.select("item_id", "published_at", "appearance_id", F.explode("clauses").alias("clause"))
    words = F.transform(F.sort_array(F.transform(F.array_distinct(T.material_tokens(F.col("clause"))), lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))), asc=False), lambda x: x.t)
    told = told.groupBy("item_id", "published_at", "appearance_id", words.alias("words")).agg(F.count(F.lit(1)).alias("n"))
    sets = park(told.groupBy("item_id", "words").agg(F.min(F.struct("published_at", "appearance_id", "n")).alias("at")).select("item_id", "words", "at.*"), "storyline-facts")
    n = F.size("words")
    index = sets.select("item_id", "published_at", "appearance_id", "words", F.explode(F.slice("words", 1, n - F.ceil(n * P.FACT_SIMILARITY - 1e-9).cast("int") + 1)).alias("word"))
    now, then = index.alias("now"), index.alias("then")
    earlier = F.struct("then.published_at", "then.appearance_id") < F.struct("now.published_at", "now.appearance_id")
    alike = F.size(F.array_intersect("now.words", "then.words")) / F.greatest(F.size("now.words"), F.size("then.words")) >= P.FACT_SIMILARITY
    known = now.join(then, F.col("now.item_id").eqNullSafe(F.col("then.item_id")) & (F.col("now.word") == F.col("then.word")) & earlier & alike, "left_semi")
    known = known.select("appearance_id", "words").distinct()
    return sets.join(known, ["appearance_id", "words"], "left_anti").groupBy("appearance_id").agg(F.sum("n").alias("facts"))


def decisions(items: DataFrame) -> DataFrame:
    """Origin, evolution or repetition of each appearance against those before.

    Novelty is the share of material tokens that no earlier appearance had, facts the number of clauses unlike all earlier
    ones; overlap is measured against the latest.
    """
    w = Window.partitionBy("item_id").orderBy("published_at", "appearance_id")
    a = appearances(items).select("appearance_id", "item_id", "published_at", F.array_distinct(T.material_tokens(F.col("summary"))).alias("tokens"), T.fact_clauses(F.col("summary")).alias("clauses"))
    a = park(a, "storyline-appearances")
    # the first appearance of each token of an item: what is new is what begins here
    begins = a.select("item_id", "appearance_id", "published_at", F.explode("tokens").alias("token")).groupBy("item_id", "token").agg(F.min_by("appearance_id", F.struct("published_at", "appearance_id")).alias("appearance_id"))
    new = begins.groupBy("appearance_id").agg(F.count(F.lit(1)).alias("new"))
    a = a.drop("clauses").withColumn("before", F.lag("tokens").over(w)).join(new, "appearance_id", "left").join(_novel_facts(a), "appearance_id", "left")
    a = a.withColumns({"new": F.coalesce("new", F.lit(0)), "facts": F.coalesce("facts", F.lit(0))})
    ratio = F.when(F.size("tokens") > 0, F.col("new") / F.size("tokens")).otherwise(0.0)
    overlap = F.when(F.greatest(F.size("tokens"), F.size("before")) > 0, F.size(F.array_intersect("tokens", "before")) / F.greatest(F.size("tokens"), F.size("before"))).otherwise(0.0)
    evolves = (
        (F.col("facts") >= 1) & ((ratio >= P.NOVEL_SHARE) | (overlap <= P.NOVEL_OVERLAP))
        | (F.col("facts") >= 2) & (ratio >= P.FEW_NOVEL_SHARE) & (overlap <= P.FEW_NOVEL_OVERLAP)
        | (F.col("facts") == 0) & (ratio >= P.NO_FACT_SHARE) & (overlap <= P.NO_FACT_OVERLAP)
    )
    d = F.when(F.col("before").isNull(), "origin").when(evolves, "evolution").otherwise("repetition")
    return a.select("appearance_id", "item_id", "published_at", F.round(ratio, 3).alias("novelty"), F.round(overlap, 3).alias("overlap"), "facts", d.alias("decision"))


def _step(state: dict, decision: str, at: pd.Timestamp) -> None:
    if decision == "repetition":
        state["repetitions"] += 1
        state["streak"] += 1
        idle = (at - state["last"]).total_seconds() > P.IDLE_DAYS * 86400
        if idle or state["streak"] >= P.REPETITION_STREAK:
            state["status"] = "archived"
        else:
            state["status"] = "stable" if state["evolutions"] >= P.STABLE_EVOLUTIONS else "developing"
    else:
        was = state["status"]
        state["evolutions"] += 1
        state["streak"], state["last"] = 0, at
        state["status"] = "developing" if was == "archived" or state["evolutions"] < P.STABLE_EVOLUTIONS else "stable"


def lifecycles(items: DataFrame) -> DataFrame:
    """State of each storyline after every appearance: an ordered fold per item.

    Rows stream through sorted by item, so a fold holds one state at a time, however long an item's story is.
    """
    d = decisions(items).select("appearance_id", "item_id", "decision", "published_at")
    d = d.repartition("item_id").sortWithinPartitions("item_id", "published_at", "appearance_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for b in batches:
            rows = []
            for a, item, decision, at in zip(b["appearance_id"], b["item_id"], b["decision"], b["published_at"]):
                if item != now:
                    now, state = item, {"evolutions": 0, "repetitions": 0, "streak": 0, "last": at, "status": "developing"}
                _step(state, decision, at)
                rows.append((a, item, decision, state["status"], state["evolutions"], state["repetitions"], state["streak"]))
            yield pd.DataFrame(rows, columns=["appearance_id", "item_id", "decision", "status", "evolutions", "repetitions", "streak"])

    return d.mapInPandas(fold, STATE)


def assigned(items: DataFrame) -> DataFrame:
    """``item_id, storyline, how``: the story each item belongs to, named by the item that began it.

    An item keeps its story. A new one joins the story of the earlier item of its category group whose name is most like its
    own, from a score of 0.82 on; of equals the earliest, then the smallest id. Otherwise it begins a story. Items whose
    names share no token are not compared; of a name only the rarest tokens are looked up, at least one of which two alike
    names share.
    """
    first = items.where("item_id is not null").groupBy("item_id").agg(
        F.min(F.struct("published_at", "appearance_id")).alias("since"), F.min_by("item_name", F.struct("published_at", "appearance_id")).alias("name"), F.min_by("category", F.struct("published_at", "appearance_id")).alias("category")
    )
    first = park(first.select("item_id", "since", "name", T.category_group(F.col("category")).alias("grp"), F.array_distinct(T.storyline_tokens(F.col("name"))).alias("tokens")), "storyline-items")
    token = first.select("item_id", "grp", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = token.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("df"))
    ordered = token.join(df, ["grp", "token"]).groupBy("item_id", "grp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).getField("token").alias("t"))
    rare = ordered.select(F.col("item_id").alias("x"), "grp", F.explode(F.slice("t", 1, F.col("n") - F.ceil(F.col("n") / 2).cast("int") + 1)).alias("token"))
    pairs = rare.join(token.select(F.col("item_id").alias("y"), "grp", "token"), ["grp", "token"]).where("x <> y").select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("p.*").distinct()
    side = lambda k: first.select(F.col("item_id").alias(k), F.col("since").alias(f"{k}_since"), F.col("name").alias(f"{k}_name"))
    p = pairs.join(side("x"), "x").join(side("y"), "y").where("y_since < x_since").withColumn("score", reference_score(F.col("x_name"), F.col("y_name"))).where(F.col("score") >= P.STORYLINE_MATCH)
    best = p.groupBy("x").agg(F.min_by("y", F.struct(-F.col("score"), "y_since", "y")).alias("y"))
    numbered = first.select("item_id", F.xxhash64("item_id").alias("node"))
    chain = best.select(F.xxhash64("x").alias("node"), F.xxhash64("y").alias("next"))
    ends = ends_of_chains(chain).join(numbered.select(F.col("node").alias("end"), F.col("item_id").alias("storyline")), "end").select("node", "storyline")
    got = numbered.join(ends, "node", "left")
    return got.select("item_id", F.coalesce("storyline", "item_id").alias("storyline"), F.when(F.col("storyline").isNull(), "begun").otherwise("joined").alias("how"))


def members(items: DataFrame, stories: DataFrame) -> DataFrame:
    """``storyline, appearance_id, item_id, position``: the appearances of a story in the order of their times."""
    a = appearances(items).select("appearance_id", "item_id", "published_at").join(stories.select("item_id", "storyline"), "item_id")
    w = Window.partitionBy("storyline").orderBy("published_at", "appearance_id")
    return a.select("storyline", "appearance_id", "item_id", F.row_number().over(w).alias("position"))


def links(items: DataFrame, stories: DataFrame) -> DataFrame:
    """``edition_id, target, source, kind``: stories that meet in an edition under one link.

    The story that is older is the target; the others are merged into it. A story that begins where exactly one other
    stands is a fork of that instead.
    """
    a = appearances(items).select("edition_id", "published_at", "item_id", U.dedupe_key(F.col("source_url")).alias("key")).where("key is not null").join(stories.select("item_id", "storyline"), "item_id")
    since = appearances(items).join(stories.select("item_id", "storyline"), "item_id").groupBy("storyline").agg(F.min("published_at").alias("since"))
    a = a.select("edition_id", "published_at", "key", "storyline").distinct().join(since, "storyline")
    oldest = a.groupBy("edition_id", "key").agg(F.min(F.struct("since", "storyline")).alias("t"), F.count(F.lit(1)).alias("n")).where("n > 1")
    m = a.join(oldest, ["edition_id", "key"]).where(F.col("storyline") != F.col("t.storyline"))
    kind = F.when((F.col("n") == 2) & (F.col("since") == F.col("published_at")) & (F.col("t.since") < F.col("published_at")), "fork").otherwise("merge")
    return m.select("edition_id", F.col("t.storyline").alias("target"), F.col("storyline").alias("source"), kind.alias("kind")).distinct()


def merged(items: DataFrame, stories: DataFrame) -> DataFrame:
    """``storyline, into``: where the pointers of merged stories end; of several targets of a story the first in name holds."""
    m = links(items, stories).where("kind = 'merge'").groupBy("source").agg(F.min("target").alias("target"))
    names = m.select(F.col("source").alias("name")).unionByName(m.select(F.col("target").alias("name"))).distinct()
    ends = ends_of_chains(m.select(F.xxhash64("source").alias("node"), F.xxhash64("target").alias("next")))
    by = names.select("name", F.xxhash64("name").alias("h"))
    return ends.join(by, F.col("node") == F.col("h")).select(F.col("name").alias("storyline"), "end").join(by, F.col("end") == F.col("h")).select("storyline", F.col("name").alias("into"))


def active(items: DataFrame, stories: DataFrame, now: str) -> DataFrame:
    """``storyline, items, appearances, first, last, top_score`` of stories that appeared within the idle days before ``now``, with the newest version of their items, newest first."""
    end = F.lit(now).cast("timestamp_ntz")
    a = appearances(items).where(F.col("published_at") <= end).join(stories.select("item_id", "storyline"), "item_id")
    s = a.groupBy("storyline").agg(F.count(F.lit(1)).alias("appearances"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))
    v = latest_versions(items.where(F.col("published_at") <= end)).join(stories.select("item_id", "storyline"), "item_id").groupBy("storyline").agg(F.count(F.lit(1)).alias("items"), F.max("relevance_score").alias("top_score"))
    return s.join(v, "storyline").where(F.col("last") > end - F.expr(f"interval {P.IDLE_DAYS} days")).select("storyline", "items", "appearances", "first", "last", "top_score").orderBy(F.desc("last"), "storyline")
