from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_is_towards_plus_infinity(spark):
    assert one(spark, T.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, T.round_half_up(F.lit(2.5))) == 3


def blend(spark, **signals):
    cols = {k: F.lit(signals.get(k)).cast("double") for k in P.WEIGHTS}
    return one(spark, S.relevance(cols))


def test_relevance_of_known_items(spark):
    sat = lambda v, k: one(spark, S.saturating(F.lit(v), P.SATURATION[k]))
    rec = lambda h: one(spark, S.recency(F.lit(float(h))))
    github = lambda stars, act: float(int(0.6 * sat(stars, "stars") + 0.4 * act + 0.5))
    assert blend(spark, recency=rec(2), authority=94, mentions=sat(5, "mentions"), github=github(6200, 90), social=sat(260, "social")) == 89
    assert blend(spark, recency=rec(12), authority=96, mentions=sat(2, "mentions"), social=sat(35, "social")) == 73
    assert blend(spark, recency=rec(1), authority=25, mentions=sat(1, "mentions"), social=sat(800, "social")) == 57


def test_only_observed_signals_carry_weight(spark):
    assert blend(spark) == 0
    assert blend(spark, authority=70.0) == 70
    assert one(spark, S.saturating(F.lit(None).cast("double"), 8)) is None
    assert one(spark, S.recency(F.lit(200.0))) == 0


def test_urls(spark):
    c = lambda f, u: one(spark, f(F.lit(u)))
    assert c(U.canonical, "https://A.example/x/?b=2&a=1#top") == "https://a.example/x?a=1&b=2"
    assert c(U.dedupe_key, "https://www.GitHub.com/Own/Repo/?utm_source=x&ref=y") == "https://github.com/own/repo"
    assert c(U.dedupe_key, "https://twitter.com/a/1") == "https://x.com/a/1"
    assert c(U.dedupe_key, "https://mobile.twitter.com/a/1") == "https://mobile.twitter.com/a/1"
    assert c(U.discovery, "https://www.site.example/p/?si=1&z=1&a=2#x") == "https://site.example/p/?z=1&a=2"
    assert c(U.discovery, "ftp://site.example/p") is None
    assert c(U.source_cluster, "https://x.com/@Name/status/1") == "x:account:name"
    assert c(U.source_candidate, "https://youtu.be/abc") is None
    assert c(U.repository, "https://github.com/Own/Repo.git") == "https://github.com/own/repo"
    assert c(U.canonical, "no url") is None and c(U.source_cluster, None) is None


def test_texts(spark):
    assert one(spark, T.slug(F.lit("  Héllo, World 2! "))) == "h-llo-world-2"
    assert one(spark, T.comparable(F.lit("!!!"))) is None
    assert one(spark, T.category_of(F.lit("A new HTTP API and SDK"))) == "api"
    assert one(spark, T.dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == 0.5
    assert one(spark, T.fact_clauses(F.lit("The planner sorts queries. New. Fast engine loads"))) == ["the planner sorts queries", "fast engine loads"]


def test_ladders(spark):
    from tidemark.functions import ladders as L

    risks = spark.createDataFrame([("low", "long text", 1), ("high", "a", 2), ("HIGH", "ab", 3), ("high", "xy", 4), (None, "longest of all", 5)], "s string, d string, i int")
    assert tuple(risks.agg(L.worst_risk(F.col("s"), F.col("d"), F.col("i")).alias("r")).first()["r"]) == ("HIGH", "ab")
    assert one(spark, L.version_key(F.lit("v1.10.0")) > L.version_key(F.lit("1.9"))) is True
    ref = lambda a, b: one(spark, L.reference_score(F.lit(a), F.lit(b)))
    assert [ref("Alpha Tool", "alpha-tool"), ref("alpha", "Alpha Tool"), ref("big alpha tool", "alpha tool"), ref("a b c d e", "a b c d f"), ref("x", "y")] == [1.0, 0.96, 0.92, 0.9, 0.0]
    assert [one(spark, L.backoff_hours(F.lit(n))) for n in (0, 1, 3, 9)] == [0.0, 1.0, 4.0, 24.0]
    t = lambda s: F.lit(s).cast("timestamp")
    ok = lambda s, n, at: one(spark, L.fetch_eligible(F.lit(s), F.lit(n), t(at), t("2026-01-01 10:00:00")))
    assert ok("approved", 0, "2026-01-01 09:59:00") and ok("approved", 2, "2026-01-01 08:00:00") and not ok("approved", 3, "2026-01-01 08:00:00") and not ok("retired", 0, "2026-01-01 01:00:00")
