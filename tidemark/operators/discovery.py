"""Discovery of sources: which links lead to candidates, what speaks for them, and what becomes of them cycle by cycle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators.records import edition_day, scored


def mentions(records: DataFrame) -> DataFrame:
    """``record_id, candidate, url, quality, referrer, cycle, score``: the link by which a record mentions a candidate best.

    Of several links of a record to one candidate the one of the highest path quality and specificity counts, then the longer.
    """
    links = records.select("record_id", F.explode(U.links_of(F.col("outbound_urls"), F.col("summary"))).alias("url"))
    links = links.withColumn("candidate", U.source_candidate(F.col("url"))).where("candidate is not null")
    quality = F.when(F.col("candidate").startswith("web:"), U.path_quality(F.col("url"))).otherwise(0)
    links = links.withColumn("quality", quality).withColumn("order", F.struct((U.specificity(F.col("url")) + quality).alias("s"), F.length("url").alias("n"), F.col("url").alias("u")))
    best = links.groupBy("record_id", "candidate").agg(F.max_by(F.struct("url", "quality"), "order").alias("x")).select("record_id", "candidate", "x.*")
    s = scored(records).select("record_id", F.col("source_id").alias("referrer"), edition_day(F.col("fetched_at")).alias("cycle"), "score")
    return best.join(s, "record_id")


def evidence(m: DataFrame, referrers: int = 50, examples: int = 20) -> DataFrame:
    """Per candidate the counts, the quality of the items that mention it and the page to fetch; of referrers and examples the first in order are kept.

    Lists are bounded while they are made: a candidate that a third of all records mention keeps as little as any other.
    """
    item = T.round_half_up(F.col("score") + F.col("quality") + F.least(U.specificity(F.col("url")), F.lit(30)) / 10)
    m = m.withColumn("item_quality", item)
    counts = m.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("mentions"), F.sum("item_quality").cast("bigint").alias("total_quality"), F.max("item_quality").cast("bigint").alias("best_quality"),
        F.count(F.when(F.col("score") >= P.HIGH_SIGNAL, 1)).alias("high_signal"), F.max_by("url", F.struct("item_quality", U.specificity(F.col("url")), "url")).alias("fetch_url"),
    )

    def first(column: str, most: int) -> DataFrame:
        distinct = m.where(F.col(column).isNotNull()).select("candidate", column).distinct()
        # the place within a part is enough to leave out what cannot be among the first
        part = F.pmod(F.xxhash64(column), F.lit(16))
        near = distinct.withColumn("k", F.row_number().over(Window.partitionBy("candidate", part).orderBy(column))).where(F.col("k") <= most)
        return near.groupBy("candidate").agg(F.slice(F.array_sort(F.collect_list(column)), 1, most).alias(f"{column}s"))

    return counts.join(first("referrer", referrers), "candidate", "left").join(first("url", examples), "candidate", "left").withColumn(
        "mean_quality", T.round_half_up(F.col("total_quality") / F.col("mentions")).cast("bigint")
    )


def authority(m: DataFrame, sources: DataFrame, records: DataFrame, repositories: DataFrame) -> DataFrame:
    """Authority of each source from outside: citations by other sources that were not discovered themselves, stars and activity of the code it links to."""
    web = records.where("source_type <> 'web'").select("record_id")
    cites = m.where("referrer is null or referrer <> candidate").join(web, "record_id", "left_semi").groupBy("candidate").agg(F.count(F.lit(1)).alias("citations"))
    reg = sources.select("source_id", F.col("seed"), F.coalesce("approved_at", "discovered_at").alias("since"), "approved_at")
    hosts = U.source_candidate(F.col("homepage"))
    days = F.floor((F.unix_timestamp("ingested_at") - F.unix_timestamp("pushed_at")) / 86400.0)
    stars = repositories.select(F.coalesce(hosts, U.source_candidate(F.concat(F.lit("https://"), F.col("homepage")))).alias("candidate"), "stars", S.github_activity(F.greatest(days, F.lit(0)), F.col("stars"), F.col("forks")).alias("activity"))
    stars = stars.where("candidate is not null").groupBy("candidate").agg(F.max("stars").alias("stars"), F.max("activity").alias("activity"))
    got = cites.join(stars, "candidate", "full").join(reg, F.col("candidate") == F.col("source_id"), "left")
    score = S.source_authority(F.col("citations"), F.col("stars"), F.col("activity"), F.lit(0))
    new = F.col("approved_at").isNull()
    return got.select("candidate", F.coalesce("citations", F.lit(0)).alias("citations"), "stars", score.alias("authority"), S.authority_suffices(score, new, F.col("seed")).alias("eligible"))


def topic_coverage(records: DataFrame, sources: DataFrame, least: int = P.MIN_ACTIVE_PER_CATEGORY) -> DataFrame:
    """Active sources per topic, with the status of the topic: blind, fragile or covered; topics without a source are there too."""
    active = sources.where("status = 'approved' and not coalesce(seed, false)").select("source_id")
    hits = records.where("source_id is not null").select("source_id", F.explode(T.topic_hits(F.concat_ws(" ", "title", "summary"))).alias("topic")).distinct().join(active, "source_id", "left_semi")
    n = hits.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.createDataFrame([(t,) for t in P.TOPICAL_KEYWORDS], "topic string")
    got = every.join(n, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("active_sources"))
    return got.withColumn("status", F.when(F.col("active_sources") == 0, "blind").when(F.col("active_sources") < least, "fragile").otherwise("covered"))


def category_sets(records: DataFrame) -> DataFrame:
    """The categories that each source covers, in their order."""
    order = F.array(*[F.lit(c) for c in P.CATEGORIES])
    sets = records.where("source_id is not null and category is not null").groupBy("source_id").agg(F.collect_set("category").alias("s"))
    return sets.select("source_id", F.array_join(F.filter(order, lambda c: F.array_contains("s", c)), ",").alias("categories"))


# ---- what becomes of a source


def cycles(records: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id, cycle, best, status``: a row for every registered source and every cycle from its first to the last of all.

    ``best`` is the highest score of the source in the cycle, null where it was not seen. Scores are combined before the
    rows of missing cycles are made, so there is one row a source and day, however many records a source has.
    """
    best = scored(records).where("source_id is not null").groupBy("source_id", edition_day(F.col("fetched_at")).alias("cycle")).agg(F.max("score").alias("best"))
    last = best.agg(F.max("cycle").alias("last"))
    span = best.groupBy("source_id").agg(F.min("cycle").alias("first")).crossJoin(F.broadcast(last))  # one row
    days = span.select("source_id", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("cycle"))
    registered = sources.select("source_id", "status", F.coalesce("seed", F.lit(False)).alias("seed"))
    return days.join(best, ["source_id", "cycle"], "left").join(registered, "source_id")


class Life:
    """State of one source: candidate, probation, active or retired; a step for every cycle."""

    def __init__(self, status: str, seed: bool) -> None:
        self.seed = seed
        self.state = {"approved": "probation", "retired": "retired"}.get(status, "candidate")
        self.qualifying: list = []
        self.low = 0
        self.reason = None

    def step(self, day, best: float | None) -> None:
        """A cycle with the best score of the source in it, or none. Seeds stay as they are."""
        self.reason = None
        if self.seed:
            self.state = "active"
            return
        if best is not None and best >= P.HIGH_SIGNAL:
            self.low = 0
            if self.state == "retired":  # seen again with a high signal: restored on probation
                self._to("probation", "restored")
        elif self.state in ("probation", "active"):
            self.low += 1
        if self.state == "probation" and best is not None:
            if best >= P.PROMOTION_SCORE:
                self.qualifying.append(day)
            elif not self.qualifying or self.qualifying[-1] != day:
                self.qualifying = []
            self.qualifying = [q for q in self.qualifying if (day - q).days < P.PROMOTION_DAYS]
            if len(self.qualifying) >= P.PROMOTION_CYCLES:
                self._to("active", "promoted")
        if self.state in ("probation", "active") and self.low >= P.RETIREMENT_CYCLES:
            self._to("retired", "low_signal")

    def _to(self, state: str, reason: str) -> None:
        self.state, self.reason, self.qualifying, self.low = state, reason, [], 0


def lifecycles(c: DataFrame) -> DataFrame:
    """``source_id, cycle, state, transition`` after every cycle: an ordered fold per source that holds one state at a time.

    Promotion takes three cycles of a high score within three days, and a low one clears them; three cycles in a row
    without a high score retire a source; a high score brings a retired one back on probation.
    """
    ordered = c.repartition("source_id").sortWithinPartitions("source_id", "cycle")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, life = None, None
        for b in batches:
            rows = []
            for source, day, best, status, seed in zip(b["source_id"], b["cycle"], b["best"], b["status"], b["seed"]):
                if source != now:
                    now, life = source, Life(status, bool(seed))
                life.step(day, None if pd.isna(best) else best)
                rows.append((source, day, life.state, life.reason))
            yield pd.DataFrame(rows, columns=["source_id", "cycle", "state", "transition"])

    return ordered.select("source_id", "cycle", "best", "status", "seed").mapInPandas(fold, "source_id string, cycle date, state string, transition string")


def audit(lives: DataFrame) -> DataFrame:
    """Ledger of decisions: every transition with the state before it and the time until the next; an entry is closed by the next one."""
    w = Window.partitionBy("source_id").orderBy("cycle")
    moved = lives.withColumn("was", F.lag("state").over(w)).where("transition is not null")
    return moved.select("source_id", "cycle", "transition", "was", "state", F.lead("cycle").over(w).alias("closed_at"), F.row_number().over(w).alias("entry"))


def guarded_retirements(lives: DataFrame, records: DataFrame) -> DataFrame:
    """Retirements with the categories that would lose their only active source, which blocks them."""
    of = records.where("source_id is not null and category is not null").select("source_id", "category").distinct()
    active = lives.where("state = 'active' or transition = 'low_signal'").select("source_id", "cycle", "transition").join(of, "source_id")
    alone = active.groupBy("cycle", "category").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("transition") == "low_signal", 1)).alias("leaving"), F.min("source_id").alias("source_id"))
    blocked = alone.where("n = 1 and leaving = 1").groupBy("source_id", "cycle").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return lives.where("transition = 'low_signal'").select("source_id", "cycle").join(blocked, ["source_id", "cycle"], "left").withColumn("blocked", F.col("categories").isNotNull())


def expertise(items: DataFrame, most: int = 50) -> DataFrame:
    """``source_id, item_id, first, latest, appearances, outcome`` of the items by which a source shows expertise, the ``most`` last observed of each.

    Tracking begins with a high score; a second edition with one retains the item, otherwise it is short-lived a week later.
    """
    best = items.where("relevance_score is not null and source_id is not null").groupBy("source_id", "item_id", "edition_id").agg(F.max("relevance_score").alias("score"), F.max("published_at").alias("at"))
    begins = best.where(F.col("score") >= P.HIGH_SIGNAL).groupBy("source_id", "item_id").agg(F.min("at").alias("since"))
    kept = best.join(begins, ["source_id", "item_id"]).where("at >= since")
    per = kept.groupBy("source_id", "item_id").agg(
        F.min_by("score", "at").alias("first"), F.max_by("score", "at").alias("latest"), F.count(F.lit(1)).alias("appearances"),
        F.count(F.when(F.col("score") >= P.HIGH_SIGNAL, 1)).alias("high"), F.max("at").alias("last"),
    )
    outcome = F.when(F.col("high") >= 2, "retained").otherwise("short_lived")
    # the newest of parts first, so that no window holds all items of a source
    near = per.withColumn("p", F.row_number().over(Window.partitionBy("source_id", F.pmod(F.xxhash64("item_id"), F.lit(16))).orderBy(F.desc("last"), "item_id"))).where(F.col("p") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("last"), "item_id"))).where(F.col("rank") <= most)
    return ranked.select("source_id", "item_id", "first", "latest", "appearances", outcome.alias("outcome"))
