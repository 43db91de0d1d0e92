"""Which records name the same thing: exact signals, similarity of names, groups and their consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators.graph import components


def exact_keys(records: DataFrame) -> DataFrame:
    """Every normal form of a URL that each record goes by."""
    urls = F.concat(F.array("source_url"), F.coalesce("source_urls", F.array().cast("array<string>")))
    return records.select("record_id", F.explode(F.array_distinct(F.transform(urls, U.dedupe_key))).alias("key")).where("key is not null").distinct()


def shared_keys(records: DataFrame) -> DataFrame:
    """Keys of several records with their number and smallest record; a star instead of all pairs of a key."""
    k = exact_keys(records).groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.min("record_id").alias("first"))
    return k.where("records > 1")


def duplicate_groups(records: DataFrame) -> DataFrame:
    """Records that share a key directly or over others, with the smallest record of their group."""
    keys = exact_keys(records)
    edges = keys.join(shared_keys(records).select("key", "first"), "key").select(F.col("record_id").alias("a"), F.col("first").alias("b"))
    return components(edges).select(F.col("node").alias("record_id"), F.col("root").alias("group_id"))


def consolidated(records: DataFrame) -> DataFrame:
    """One row per duplicate group: summed mentions, highest authority, longest summary, earliest times, union of kinds."""
    g = records.join(duplicate_groups(records), "record_id")
    return g.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.greatest(F.coalesce(F.col("metrics.mentions"), F.lit(1)), F.lit(1))).alias("mentions"), F.max("source_authority").alias("authority"),
        F.max_by("summary", F.struct(F.length("summary"), -F.col("record_id"))).alias("summary"), F.min("published_at").alias("published_at"), F.min("fetched_at").alias("fetched_at"),
        F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("kinds"), F.max_by("record_id", F.struct("source_authority", F.coalesce(F.col("metrics.mentions"), F.lit(1)), -F.col("record_id"))).alias("primary_id"),
    )


def similar_names(papers: DataFrame, threshold: float = P.DICE) -> DataFrame:
    """Pairs of papers whose titles' material tokens have a Dice coefficient from the threshold on.

    Only the rarest tokens of a title are joined on: a pair that reaches the threshold shares one of the first
    ``n - ceil(t / (2 - t) n) + 1`` of each. Equal titles count as one, through their smallest paper.
    """
    t = papers.select("paper_id", F.array_sort(F.array_distinct(T.material_tokens(F.col("title")))).alias("tokens")).where(F.size("tokens") >= 2)
    t = t.groupBy("tokens").agg(F.min("paper_id").alias("paper_id"))
    e = t.select("paper_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = e.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    e = e.join(df, "token")
    ordered = e.groupBy("paper_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).getField("token").alias("tokens"))
    share = threshold / (2 - threshold)
    prefix = ordered.select("paper_id", "tokens", F.explode(F.slice("tokens", 1, F.greatest(F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1, F.lit(1)))).alias("token"))
    a, b = prefix.alias("a"), prefix.alias("b")
    pairs = a.join(b, F.col("a.token") == F.col("b.token")).where("a.paper_id < b.paper_id").select(F.col("a.paper_id").alias("a"), F.col("b.paper_id").alias("b"), F.col("a.tokens").alias("x"), F.col("b.tokens").alias("y"))
    got = pairs.withColumn("dice", F.round(T.dice(F.col("x"), F.col("y")), 6)).where(F.col("dice") >= threshold)
    return got.select("a", "b", "dice").distinct()


EXACT = ("canonical_url", "repo_root", "canonical_id")
CANONICAL = ("repo_root", "canonical_id")
ALIASES = ("name_alias", "repo_name_alias", "repo_full_name_alias", "host_alias", "slug_alias")


def paper_id(c: Column) -> Column:
    """Number without version of a link to a paper."""
    return F.nullif(F.regexp_extract(F.lower(c), r"arxiv\.(?:org|example)/(?:abs|pdf|html)/(\d{4}\.\d{4,})", 1), F.lit(""))


def signals(rows: DataFrame, key: str, urls: Column, name: str, category: str = "category") -> DataFrame:
    """``key, grp, type, value``, each once: everything that a row may be recognised by.

    Exact ones are the normal forms of its links, the root of a repository and the number of a paper or a DOI; the others
    are aliases: its name, names of repositories with and without owner, the host if it is written in parts, and the
    last two parts of a path.
    """
    grp = T.category_group(F.coalesce(category, F.lit("technique"))).alias("grp")
    base = rows.where(F.col(key).isNotNull()).select(F.col(key), grp, F.explode_outer(F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))).alias("u"), F.col(name).alias("name"))
    u, repo = F.col("u"), U.repository(F.col("u"))
    host = F.regexp_replace(U.host(u), r"^www\.", "")
    owner, repository = F.regexp_extract(repo, r"([^/]+)/[^/]+$", 1), F.substring_index(repo, "/", -1)
    label = F.regexp_extract(host, r"^(?:.*\.)?([^.]+)\.[^.]+$", 1)
    parts = F.filter(F.split(U.path(u), "/"), lambda s: s != "")
    plain = U.is_url(u) & repo.isNull() & ~host.isin(*P.ACCOUNT_HOSTS)
    made = [
        ("canonical_url", U.dedupe_key(u)), ("repo_root", repo), ("canonical_id", F.concat(F.lit("arxiv:"), paper_id(u))),
        ("canonical_id", F.when(U.host(u).isin("doi.org", "dx.doi.org", "www.doi.org"), F.concat(F.lit("doi:"), T.doi(u)))),
        ("repo_name_alias", T.alias(repository)), ("repo_full_name_alias", T.alias(F.concat_ws(" ", F.nullif(owner, F.lit("")), F.nullif(repository, F.lit(""))))),
        ("host_alias", F.when(plain & label.rlike("[-_]"), T.alias(label))),
        ("slug_alias", F.when(plain, T.alias(F.try_element_at(parts, F.lit(-1))))), ("slug_alias", F.when(plain, T.alias(F.try_element_at(parts, F.lit(-2))))),
        ("name_alias", T.alias(F.col("name"))),
    ]
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(t).alias("type"), v.alias("value")) for t, v in made]), lambda x: x.value.isNotNull() & (x.value != "")))
    return base.select(key, "grp", each.alias("x")).select(key, "grp", "x.type", "x.value").distinct()


def record_signals(records: DataFrame, related: bool = False) -> DataFrame:
    """Signals of records by their own links, with ``related`` also by those they lead to."""
    none = F.array().cast("array<string>")
    urls = F.concat(F.array("source_url"), F.coalesce("source_urls", none), F.coalesce("outbound_urls", none) if related else none)
    return signals(records, "record_id", urls, "title")


def shared_aliases(s: DataFrame) -> DataFrame:
    """``grp, value, records, types, entities`` of specific aliases that several records bear, each with one that is no name.

    Two records are one thing by an alias if they have two types of it between them. ``entities`` counts the different
    repositories or papers behind the bearers: records of different ones are kept apart.
    """
    known = s.where(F.col("type").isin(*CANONICAL)).groupBy("record_id").agg(F.min("value").alias("entity"))
    a = s.where(F.col("type").isin(*ALIASES) & T.is_specific(F.col("value"))).groupBy("grp", "value", "record_id").agg(F.collect_set("type").alias("t"))
    a = a.where(F.exists("t", lambda t: t != "name_alias")).join(known, "record_id", "left")
    types = a.select("grp", "value", F.explode("t").alias("t")).distinct().groupBy("grp", "value").agg(F.count(F.lit(1)).alias("types"))
    got = a.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("entity").alias("entities"))
    return got.join(types, ["grp", "value"]).where("records > 1 and types > 1").select("grp", "value", "records", "types", "entities")


def same_things(s: DataFrame) -> DataFrame:
    """Edges ``a, b`` between records that are one thing by an exact signal or by an alias with corroboration.

    A shared signal is a star around its smallest record. An alias is a star around the smallest record without a repository
    or paper of its own for each set of alias types: all others may be joined with that, whereas records of different
    repositories or papers may not be joined with each other.
    """
    exact = s.where(F.col("type").isin(*EXACT))
    first = exact.groupBy("grp", "type", "value").agg(F.min("record_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = exact.join(first, ["grp", "type", "value"]).select(F.col("record_id").alias("a"), "b")
    own = s.where(F.col("type").isin(*CANONICAL)).select("record_id").distinct().withColumn("own", F.lit(True))
    a = s.where(F.col("type").isin(*ALIASES) & T.is_specific(F.col("value"))).groupBy("grp", "value", "record_id").agg(F.array_sort(F.collect_set("type")).alias("t"))
    a = a.where(F.exists("t", lambda t: t != "name_alias")).join(own, "record_id", "left")
    centre = a.where("own is null").groupBy("grp", "value", F.col("t").alias("u")).agg(F.min("record_id").alias("b"))
    joined = a.join(centre, ["grp", "value"]).where(F.size(F.array_union("t", "u")) >= 2).select(F.col("record_id").alias("a"), "b")
    return edges.unionByName(joined).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def identity_groups(records: DataFrame) -> DataFrame:
    """Records of one thing within a category group, directly or over others, with the smallest record of the group."""
    return components(same_things(record_signals(records))).select(F.col("node").alias("record_id"), F.col("root").alias("group_id"))


def resolved(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming_id, item_id, priority, first_seen, edition_count``: the accepted item that each incoming row is, by the best evidence.

    In order: 0 the very id, 1 a repository, 2 a DOI, 3 a page that is no account, 4 the specific name within the category
    group, if not both have a repository or paper of their own, 5 the number of a paper. Among items of one priority the one
    of most editions, then the latest, then the greatest id. The first sight is carried on, the editions are counted on;
    rows without a match begin anew. Each signal is an equi-join; items are combined per signal before it.
    """
    state = items.where("item_id is not null").groupBy("item_id").agg(F.min("first_seen").alias("known_since"), F.countDistinct("edition_id").alias("editions"), F.max("published_at").alias("last"))
    level = F.when(F.col("type") == "repo_root", 1).when(F.startswith("value", F.lit("doi:")), 2).when(F.col("type") == "canonical_url", 3).when(F.col("type") == "name_alias", 4).when(F.col("type") == "canonical_id", 5)
    urls = F.concat(F.array("source_url"), F.coalesce("source_urls", F.array().cast("array<string>")))
    wanted = lambda s: s.withColumn("level", level).where("level is not null").where((F.col("level") != 4) | T.is_specific(F.col("value"))).where(
        (F.col("level") != 3) | ~F.regexp_extract("value", "^[a-z]+://([^/?]+)", 1).isin(*P.ACCOUNT_HOSTS, "doi.org", "dx.doi.org")
    )
    old = wanted(signals(items.where("item_id is not null"), "item_id", urls, "item_name"))
    new = wanted(signals(incoming, "incoming_id", F.array("source_url"), "item_name"))
    own = lambda s, k: s.where("level in (1, 2, 5)").select(k).distinct()
    # of every signal the best item, and for names also the best without a repository or paper of its own
    ranked = old.join(state, "item_id").join(own(old, "item_id").withColumn("own", F.lit(True)), "item_id", "left")
    per = ranked.groupBy("grp", "level", "value").agg(F.max(F.struct("editions", "last", "item_id")).alias("any"), F.max(F.when(F.col("own").isNull(), F.struct("editions", "last", "item_id"))).alias("free"))
    hits = new.join(own(new, "incoming_id").withColumn("own", F.lit(True)), "incoming_id", "left").join(per, ["grp", "level", "value"])
    hits = hits.withColumn("best", F.when((F.col("level") == 4) & F.col("own").isNotNull(), F.col("free")).otherwise(F.col("any"))).where("best is not null")
    direct = incoming.select("incoming_id", "item_id").join(state, "item_id").select("incoming_id", F.lit(0).alias("level"), F.struct("editions", "last", "item_id").alias("best"))
    every = hits.select("incoming_id", "level", "best").unionByName(direct)
    got = every.groupBy("incoming_id").agg(F.max(F.struct((-F.col("level")).alias("p"), "best")).alias("x")).select("incoming_id", (-F.col("x.p")).alias("priority"), F.col("x.best.item_id").alias("known"))
    j = incoming.select("incoming_id", "first_seen").join(got, "incoming_id", "left").join(state.withColumnRenamed("item_id", "known"), "known", "left")
    return j.select("incoming_id", F.col("known").alias("item_id"), "priority", F.coalesce("known_since", "first_seen").alias("first_seen"), (F.coalesce("editions", F.lit(0)) + 1).alias("edition_count"))


def sentiment(records: DataFrame) -> DataFrame:
    """Spread of the sentiments of the posts of one account: agree up to one, disagree if they are opposed, else mixed; posts without any do not count."""
    x = records.where("source_id is not null and source_type = 'x'")
    e = x.groupBy("source_id").agg(F.collect_set(T.sentiment(F.concat_ws(" ", "title", "summary"))).alias("m"))
    spread = F.when(F.size("m") <= 1, "agree").when((F.size("m") == 2) & ~F.array_contains("m", "neutral"), "disagree").otherwise("mixed")
    return e.select("source_id", F.array_join(F.array_sort("m"), ",").alias("sentiments"), spread.alias("spread"))
