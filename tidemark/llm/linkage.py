"""Match papers and repositories that present the same project, without a common key.

Candidates share an attribute: a name in the title, a link to the repository, a
site, or a link back to the paper; names, links and sites weigh the more the
fewer share them. Candidates that could
not reach a match whatever else they share are pruned (meta-blocking), the rest are scored, and scores are passed
between neighbours - other versions of the paper, other repositories that
compete for it - until they no longer move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.params import CODE_HOSTS
from tidemark.llm.survivorship import host_pattern, repository_key
from tidemark.plans.shared import join_by_value, park

#: Hosts of papers and hosts on which each first part of a path is a site of its own, with the stand-ins of the test data.
PAPER_HOSTS, PAGE_HOSTS = ("arxiv.org", "arxiv.example"), ("github.io", "pages.example")
#: Papers or repositories that are thought to be there besides those of the tables, so that in a small table what two share is no less rare than in a large one.
WORLD = 10_000
#: Weights of the evidence on the log-odds scale.
BIAS, NAME, NAME_NEARLY, SITE, LINK, BACK = -4.0, 5.0, 3.0, 4.0, 2.0, 3.5
ELSEWHERE, ODD_OWNER, VERSIONS, RIVAL = -6.0, -3.0, 5.0, -4.0


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _is_repository(u: Column) -> Column:
    return u.rlike(r"(?i)^\s*(?:git\+)?(?:[a-z+]+://)?(?:[^/@\s]+@)?(?:www\.)?" + host_pattern(CODE_HOSTS) + r"(?::\d+/|[:/])")


def arxiv_id(u: Column) -> Column:
    """Id without version of a link to a paper or of the paper's own id; null if there is none."""
    got = F.regexp_extract(F.lower(u), r"(?:^|" + host_pattern(PAPER_HOSTS) + r"/(?:abs|pdf|html)/)\s*(?:arxiv:)?(\d{4}\.\d{4,})(?:v\d+)?(?:\.pdf)?/?(?:[?#].*)?\s*$", 1)
    return F.when(got != "", got)


def site(u: Column) -> Column:
    """Host without ``www.`` or ``docs.``, with the first part of the path on shared page hosts; null for code and paper hosts and the local machine."""
    rest = F.regexp_replace(F.lower(F.trim(u)), r"^[a-z][a-z+.]*://|[?#].*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/:]+)", 1), r"^(?:www|docs)\.|\.$", "")
    first = F.regexp_extract(rest, r"^[^/]+/+([^/]+)", 1)
    usable = host.rlike(r"^[^\s.]+(?:\.[^\s.]+)*\.\p{L}{2,}$") & ~host.rlike(r"(?:^|\.)" + host_pattern(CODE_HOSTS + PAPER_HOSTS) + "$")
    return F.when(usable, F.when(host.isin(*PAGE_HOSTS) & (first != ""), F.concat(host, F.lit("/"), first)).otherwise(host))


def _label(s: Column) -> Column:
    """The name a site goes by; empty for sub-hosts, which say nothing about a project."""
    return F.when(s.contains("/"), _compact(F.substring_index(s, "/", -1))).when(F.size(F.split(s, r"\.")) == 2, _compact(F.substring_index(s, ".", 1))).otherwise("")


def _variants(names: Column) -> Column:
    """The names and, of those with six letters or more, what is left without one letter: names one edit apart share a variant."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    return F.array_distinct(F.flatten(F.transform(names, lambda x: F.when(F.length(x) >= 6, F.concat(F.array(x), cut(x))).otherwise(F.array(x)))))


def _all(urls: Column, f) -> Column:
    return F.array_compact(F.array_distinct(F.transform(F.coalesce(urls, F.array().cast("array<string>")), f)))


def papers(rows: DataFrame, longest: int) -> DataFrame:
    """One row per paper row; its names are all runs of title words that together are at most ``longest`` letters, the length of the longest name sought."""
    words = F.expr(r"regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+', 0)")
    rows = rows.where("paper_id is not null").select(
        F.col("paper_id").cast("bigint").alias("paper_id"),
        F.coalesce(arxiv_id(F.col("external_id")), arxiv_id(F.col("source_url")), F.concat(F.lit("#"), F.col("paper_id"))).alias("base"),
        words.alias("words"),
        F.concat(F.coalesce("outbound_urls", F.array().cast("array<string>")), F.array()).alias("urls"),
    )
    return rows.select(
        "paper_id", "base",
        F.expr(
            "array_distinct(flatten(transform(sequence(0, greatest(size(words) - 1, 0)), i -> filter(transform(sequence(1, least(%d, greatest(size(words) - i, 1))),"
            " l -> array_join(slice(words, i + 1, l), '')), x -> length(x) between 1 and %d))))" % (longest, longest)
        ).alias("names"),
        _all(F.col("urls"), lambda u: F.when(_is_repository(u), repository_key(u))).alias("links"),
        _all(F.col("urls"), lambda u: F.when(~_is_repository(u), site(u))).alias("sites"),
    )


def repositories(rows: DataFrame) -> DataFrame:
    """One row per repository; the sets of links are combined before the shuffle."""
    rows = rows.select(repository_key(F.col("external_id")).alias("entity_key"), "outbound_urls", "homepage").where("entity_key is not null")
    urls = F.concat(F.coalesce("outbound_urls", F.array().cast("array<string>")), F.array("homepage"))
    each = rows.select("entity_key", F.explode_outer(urls).alias("u")).groupBy("entity_key").agg(
        F.collect_set(F.when(~_is_repository(F.col("u")), site(F.col("u")))).alias("sites"), F.collect_set(arxiv_id(F.col("u"))).alias("back")
    )
    return each.select("entity_key", _compact(F.substring_index("entity_key", "/", -1)).alias("name"), "sites", "back")


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _rarity(n: Column, all_: int) -> Column:
    """1 for what one of ``all_`` has, falling with the logarithm of how many have it."""
    world = float(WORLD + all_)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log(world / (1.0 + n)) / math.log(world / 2)))


def link(arxiv_records: DataFrame, github_records: DataFrame, tolerance: float = 1e-3, rounds: int = 100) -> DataFrame:
    """``paper_id, entity_key, confidence, by_name, by_link, by_site, mutual`` of every candidate pair, matched or not.

    A pair with a confidence above 0.5 is a match. A name alone is enough if nothing speaks against it; a link alone is
    a citation. A repository whose own site is named otherwise than it, or a paper whose own site is another project's,
    speaks against a match by name.

    Null ids give no rows; null or empty links and titles are no evidence; repeated rows count once; an empty table on
    either side gives an empty result; other columns are ignored.
    """
    r = park(repositories(github_records), "linkage-repositories")
    totals = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("name")).alias("longest")).first()
    p = park(papers(arxiv_records, 1 + (totals["longest"] or 0)), "linkage-papers")  # a name may be one letter short
    none = F.array().cast("array<string>")
    base_count = p.select("base").distinct().count()
    # the fewer titles hold a name, the more it says
    held = p.select("base", F.explode("names").alias("name")).join(r.select("name").distinct(), "name", "left_semi").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    r = park(r.join(held, "name", "left").withColumn("name_weight", _rarity(F.coalesce("n", F.lit(0)), base_count)).drop("n"), "linkage-named")
    # a site is its project's own if one repository has it, or only repositories of one name, or mostly such that are named like it
    with_sites = r.select("entity_key", "name", F.explode("sites").alias("s"))
    fit = (F.length(_label(F.col("s"))) >= 3) & F.startswith("name", _label(F.col("s")))
    sites = with_sites.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("one"), F.max("name").alias("other"), F.sum(fit.cast("int")).alias("fit"))
    sites = sites.select("s", _rarity(F.col("n"), totals["n"]).alias("weight"), ((F.col("one") == F.col("other")) | (2 * F.col("fit") >= F.col("n"))).alias("one_project"))
    sites = park(sites, "linkage-sites")
    hubs = park(sites.where("not one_project").select("s", "weight"), "linkage-hubs")
    p_sites = p.select("paper_id", F.explode("sites").alias("s")).join(hubs, "s", "left_anti")
    r_sites = r.select("entity_key", F.explode("sites").alias("s")).join(hubs, "s", "left_anti")
    own = p_sites.groupBy("paper_id").agg(F.collect_set("s").alias("own"))
    told = r_sites.join(sites.select("s", "weight"), "s").groupBy("entity_key").agg(F.collect_set("s").alias("sites"), F.max("weight").alias("own_weight"))
    p_hubs = p.select("paper_id", F.explode("sites").alias("s")).join(hubs, "s")
    links = p.select("paper_id", F.explode("links").alias("entity_key"))
    link_count = links.groupBy("entity_key").agg(F.count(F.lit(1)).alias("cited"))
    labelled = lambda sites: F.filter(F.transform(F.coalesce(sites, none), _label), lambda x: F.length(x) >= 3)
    fits = lambda x: F.startswith(F.col("name"), x)
    # However many bear a name, all are candidates but those that a name alone cannot make a match: repositories whose own
    # site is named otherwise, and papers in a single version whose own sites all are. Tied in another way, they come in by that.
    named = r.where("name <> ''").select("entity_key", "name").join(told, "entity_key", "left")
    named = named.where((F.size(labelled(F.col("sites"))) == 0) | F.exists(labelled(F.col("sites")), fits)).select("entity_key", "name")
    single = p.groupBy("base").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("base", F.lit(True).alias("single"))
    naming = p.select("paper_id", "base", "names").join(single, "base", "left").join(own, "paper_id", "left").withColumn("name", F.explode("names"))
    naming = naming.where(F.col("single").isNull() | (F.size(F.coalesce("own", none)) == 0) | F.exists(labelled(F.col("own")), fits)).select("paper_id", "name")
    # A site of many makes a match only with a name at most one edit apart.
    p_near = p_hubs.select("paper_id", "s").join(p.select("paper_id", "names"), "paper_id").withColumn("variant", F.explode(_variants(F.col("names"))))
    r_near = r.select("entity_key", "name", F.explode("sites").alias("s")).join(hubs.select("s"), "s", "left_semi").withColumn("variant", F.explode(_variants(F.array("name"))))
    near = p_near.join(r_near, ["s", "variant"]).where(F.exists("names", lambda x: F.levenshtein(x, F.col("name"), 1) >= 0)).select("paper_id", "entity_key")
    pairs = (
        naming.join(named, "name").select("paper_id", "entity_key")
        .unionByName(near)
        .unionByName(links)
        .unionByName(p_sites.join(r_sites, "s").select("paper_id", "entity_key"))
        .unionByName(p.select("paper_id", "base").join(r.select("entity_key", F.explode("back").alias("base")), "base").select("paper_id", "entity_key"))
        .distinct()
    )
    # what one version of a paper may match, its other versions may
    bases = p.select("paper_id", "base")
    pairs = park(pairs.join(bases, "paper_id").select("base", "entity_key").distinct().join(bases, "base").select("paper_id", "entity_key"), "linkage-pairs")
    widely = p_hubs.groupBy("paper_id").agg(F.collect_set(F.struct("s", "weight")).alias("hubs"))
    total = p.count() or 1
    # a repository that very many papers cite is spread over tasks
    known = r.withColumnRenamed("sites", "every").join(told, "entity_key", "left").join(link_count, "entity_key", "left")
    cited = pairs.groupBy("entity_key").agg(F.count(F.lit(1)).alias("n"))
    c = join_by_value(pairs, known, ["entity_key"], cited, F.col("paper_id"))
    c = c.join(p.drop("sites").join(own, "paper_id", "left").join(widely, "paper_id", "left"), "paper_id")
    c = c.withColumn("own", F.coalesce("own", none)).withColumn("sites", F.coalesce("sites", none))
    labels = labelled(F.col("sites"))
    shared = F.coalesce(F.array_max(F.transform(F.filter("hubs", lambda h: F.array_contains("every", h.s)), lambda h: h.weight)), F.lit(0.0))
    nearly = F.exists("names", lambda x: (F.length(x) >= 6) & (F.levenshtein(x, F.col("name"), 1) >= 0))
    c = c.select(
        "paper_id", "base", "entity_key", "name", "name_weight",
        F.when(F.array_contains("names", F.col("name")), 1.0).when((F.length("name") >= 6) & nearly, NAME_NEARLY / NAME).otherwise(0.0).alias("by_name"),
        F.array_contains("links", F.col("entity_key")).alias("by_link"),
        (F.arrays_overlap("own", "sites") | (shared > 0)).alias("by_site"),
        F.arrays_overlap("own", "sites").alias("by_own_site"),
        F.when(F.arrays_overlap("own", "sites"), F.col("own_weight")).otherwise(shared).alias("site_weight"),
        F.array_contains("back", F.col("base")).alias("back"),
        ((F.size("own") > 0) & ~F.arrays_overlap("own", "sites") & ~F.exists(F.transform("own", _label), lambda x: (F.length(x) >= 3) & fits(x))).alias("elsewhere"),
        ((F.size(labels) > 0) & ~F.exists(labels, fits)).alias("odd"),
        (F.log(F.lit(1.0 + total) / (1.0 + F.coalesce("cited", F.lit(0)))) / math.log(1.0 + total)).alias("rarity"),
    )
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)
    tied = F.coalesce(F.col("by_link") | F.col("back") | F.col("by_own_site"), F.lit(False))
    score = (
        F.lit(BIAS) + NAME * F.col("by_name") * F.col("name_weight") + SITE * F.col("site_weight") + LINK * F.col("rarity") * yes(F.col("by_link")) + BACK * yes(F.col("back"))
        + ELSEWHERE * yes(F.col("elsewhere") & ~(F.col("by_link") | F.col("back"))) + ODD_OWNER * yes(F.col("odd") & ~tied)
    )
    c = c.withColumn("score", score).withColumn("confidence", _logistic(score))
    # meta-blocking: a pair that even the strongest version of its paper could not lift is dropped
    strongest = c.groupBy("base", "entity_key").agg(F.max("confidence").alias("strongest"))
    c = c.join(strongest, ["base", "entity_key"]).where(F.col("score") + VERSIONS * F.col("strongest") > 0).drop("strongest")
    c = park(c.withColumn("own", F.col("confidence")), "linkage-scored")
    for _ in range(rounds):
        # own evidence against the strongest repository of the paper; only what is stronger speaks against a weaker one
        best = c.groupBy("paper_id").agg(F.max(F.struct("score", "confidence")).alias("top"))
        n = c.join(best, "paper_id").withColumn("rival", F.when(F.col("top.score") > F.col("score"), F.col("top.confidence")).otherwise(0.0))
        n = n.withColumn("alone", _logistic(F.col("score") + RIVAL * F.col("rival"))).drop("top")
        version = n.groupBy("base", "entity_key").agg(F.max("alone").alias("version"))
        n = n.join(version, ["base", "entity_key"])
        helped = F.when(F.col("version") > F.col("alone") + 1e-9, F.col("version")).otherwise(0.0)
        now = _logistic(F.col("score") + RIVAL * F.col("rival") + VERSIONS * helped)
        n = n.withColumn("now", F.round(now, 6))
        n = park(n.select(*[x for x in c.columns if x != "confidence"], F.col("now").alias("confidence"), F.abs(F.col("now") - F.col("confidence")).alias("moved")), "linkage-round")
        moved = n.agg(F.max("moved")).first()[0] or 0.0
        c = n.drop("moved")
        if moved <= tolerance:
            break
    else:
        raise RuntimeError(f"confidences still move after {rounds} rounds")
    return c.select("paper_id", "entity_key", "confidence", "by_name", "by_link", "by_site", F.col("back").alias("mutual"))


def found(arxiv_records: DataFrame, github_records: DataFrame) -> DataFrame:
    """p4_found: pairs of a paper row and a repository of the same project."""
    return link(arxiv_records, github_records).where("confidence > 0.5").select("paper_id", "entity_key")
