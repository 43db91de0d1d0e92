"""URL functions as Column expressions. The normal forms differ in what they drop and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import params as P

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(c), _URL, k)


def is_url(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(_URL) & (_part(c, 2) != ""), F.lit(False))


def host(c: Column) -> Column:
    """Host and port without what stands before ``@``; a port is left out where it is that of the scheme."""
    h = F.regexp_replace(F.lower(_part(c, 2)), r"^.*@|:$", "")
    scheme = F.lower(_part(c, 1))
    return F.when(scheme == "http", F.regexp_replace(h, ":80$", "")).when(scheme == "https", F.regexp_replace(h, ":443$", "")).otherwise(h)


def user(c: Column) -> Column:
    """What stands before the host, with its ``@``."""
    return F.regexp_extract(_part(c, 2), r"^(.*@)", 1)


def path(c: Column) -> Column:
    p = _part(c, 3)
    return F.when(p == "", "/").otherwise(p)


def _query(c: Column, keep) -> Column:
    """Query with its parameters in order of their keys, without those that are not kept."""
    parts = F.filter(F.split(F.regexp_replace(_part(c, 4), r"^\?", ""), "&"), lambda p: (p != "") & keep(F.lower(F.substring_index(p, "=", 1))))
    parts = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))).getField("p")
    joined = F.array_join(parts, "&")
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")


def _trimmed(p: Column) -> Column:
    t = F.regexp_replace(p, "/+$", "")
    return F.when(p == "/", "/").otherwise(t)


def _untracked(k: Column) -> Column:
    return ~F.startswith(k, F.lit("utm_")) & ~k.isin(*P.TRACKING)


def canonical(c: Column) -> Column:
    """Without fragment and trailing slashes, parameters sorted by key; null if it is no URL."""
    return F.when(is_url(c), F.concat(F.lower(_part(c, 1)), F.lit("://"), user(c), host(c), _trimmed(path(c)), _query(c, lambda k: F.lit(True))))


def dedupe_key(c: Column) -> Column:
    """Canonical form without tracking parameters and ``www.``; account hosts are one, code paths in lower case."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    p = F.when(h.isin(*P.CODE_HOSTS), F.lower(path(c))).otherwise(path(c))
    return F.when(is_url(c), F.concat(F.lower(_part(c, 1)), F.lit("://"), F.when(h == "twitter.com", "x.com").otherwise(h), _trimmed(p), _query(c, _untracked)))


def discovery(c: Column) -> Column:
    """Without fragment and tracking parameters; keeps slashes and the order of parameters; web URLs only."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    keep = F.filter(F.split(F.regexp_replace(_part(c, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")) & ~F.substring_index(p, "=", 1).isin(*P.DISCOVERY_TRACKING))
    q = F.array_join(keep, "&")
    return F.when(is_url(c) & F.lower(_part(c, 1)).isin("http", "https"), F.concat(F.lower(_part(c, 1)), F.lit("://"), h, path(c), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def account(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(path(c), "^/+([^/]+)", 1), "^@", "")), F.lit(""))


def source_cluster(c: Column) -> Column:
    """The source that a URL counts for: its host, on account hosts the account; null if it is no URL."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    on_account = h.isin(*P.ACCOUNT_HOSTS)
    named = account(c).isNotNull() & ~account(c).isin(*P.RESERVED_ACCOUNTS)
    return F.when(is_url(c), F.when(on_account & named, F.concat(F.lit("x:account:"), account(c))).when(on_account, "x:domain:x").otherwise(h))


def source_candidate(c: Column) -> Column:
    """Id of the source behind a URL; null for ignored hosts and for account hosts without an account."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    kind = F.when(h.rlike(r"(?:^|\.)github\."), "github").when(h.rlike(r"(?:^|\.)arxiv\."), "arxiv").when(h.rlike(r"(?:^|\.)reddit\."), "reddit").otherwise("web")
    usable = is_url(c) & F.lower(_part(c, 1)).isin("http", "https") & ~h.isin(*P.IGNORED_DOMAINS)
    handle = F.when(account(c).rlike("^[a-z0-9_]{1,15}$") & ~account(c).isin(*P.RESERVED_ACCOUNTS), account(c))
    return F.when(usable, F.when(h.isin(*P.ACCOUNT_HOSTS), F.concat(F.lit("x:account:"), handle)).otherwise(F.concat(kind, F.lit(":domain:"), h)))


def repository(c: Column) -> Column:
    """``https://host/owner/name`` in lower case of a URL on a code host."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    got = F.regexp_extract(F.lower(path(c)), r"^/+([^/]+/[^/]+?)(?:\.git)?(?:/.*)?$", 1)
    return F.when(is_url(c) & h.isin(*P.CODE_HOSTS) & (got != ""), F.concat(F.lit("https://"), h, F.lit("/"), got))


def variant_score(c: Column) -> Column:
    """How good a spelling of a URL is: no tracking 8, account or clean code host 4, no trailing slash 1."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    tracked = F.exists(F.split(F.regexp_replace(_part(c, 4), r"^\?", ""), "&"), lambda p: ~_untracked(F.substring_index(p, "=", 1)) & (p != ""))
    clean = h.isin("x.com", "x.example") | (h.isin(*P.CODE_HOSTS) & (path(c) == F.lower(path(c))))
    return F.when(tracked, 0).otherwise(8) + F.when(clean, 4).otherwise(0) + F.when(path(c).rlike("/$"), 0).otherwise(1)


def specificity(c: Column) -> Column:
    """Ten for each segment of the path and one for each parameter."""
    segments = F.size(F.filter(F.split(path(c), "/"), lambda s: s != ""))
    return 10 * segments + F.size(F.filter(F.split(F.regexp_replace(_part(c, 4), r"^\?", ""), "&"), lambda s: s != ""))


def path_quality(c: Column) -> Column:
    """Six for each part of the path that leads to documentation, up to 18; with a part that leads elsewhere at most minus what is left of 20."""
    parts = F.filter(F.transform(F.split(path(c), "/"), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    among = lambda words: F.size(F.filter(parts, lambda s: s.isin(*words)))
    high, low = among(P.HIGH_VALUE_SEGMENTS), among(P.LOW_VALUE_SEGMENTS)
    return F.when(low > 0, F.greatest(F.lit(-20), 4 * high - 20)).otherwise(F.least(6 * high, F.lit(18)))


def links_of(urls: Column, *texts: Column) -> Column:
    """The links that are listed and those that stand in texts, each once in its form for discovery."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"https?://[^\s<>\"')\]]+"), 0) for t in texts])
    return F.array_compact(F.array_distinct(F.transform(F.concat(F.coalesce(urls, F.array().cast("array<string>")), found), discovery)))
