"""Raw payloads of the source families to one shape of records.

Every reader takes a DataFrame of payloads (a ``payload`` string, one document a row) and gives rows of
``external_id, title, summary, source_url, author, published_at, outbound_urls`` with what the family adds.
A payload that cannot be read gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of the payloads that are read.
REPOSITORIES = (
    "struct<items:array<struct<full_name:string,name:string,owner:struct<login:string>,html_url:string,description:string,language:string,topics:array<string>,"
    "stargazers_count:bigint,forks_count:bigint,archived:boolean,created_at:string,pushed_at:string,homepage:string,license:struct<spdx_id:string>>>>"
)
LISTING = (
    "struct<data:struct<children:array<struct<data:struct<id:string,title:string,selftext:string,permalink:string,url_overridden_by_dest:string,author:string,"
    "created_utc:double,ups:bigint,num_comments:bigint,over_18:boolean>>>>>"
)
POSTS = (
    "struct<data:array<struct<id:string,author_id:string,text:string,created_at:string,lang:string,public_metrics:struct<like_count:bigint,reply_count:bigint,retweet_count:bigint,quote_count:bigint>,"
    "entities:struct<urls:array<struct<expanded_url:string>>>>>,includes:struct<users:array<struct<id:string,username:string,verified:boolean,public_metrics:struct<followers_count:bigint>>>>>"
)


def decoded(c: Column) -> Column:
    """Entities to characters and white space squeezed; the ampersand last, so nothing is decoded twice."""
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def stripped(c: Column) -> Column:
    """Text of a piece of HTML: no scripts, styles and tags."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    return decoded(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def _inside(c: Column, tag: str) -> Column:
    return F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as an absolute URL; null for fragments and other schemes than http."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "")
    return (
        F.when(link.rlike(r"(?i)^https?://"), link).when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^(https?:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link)).when(link.rlike(r"^(?:#|[a-z][a-z0-9+.-]*:)") | (link == ""), F.lit(None))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def counted(c: Column) -> Column:
    """``1,234``, ``1.2k`` and ``3m`` as numbers."""
    number = F.regexp_extract(F.lower(F.replace(c, F.lit(","), F.lit(""))), r"([0-9]+(?:\.[0-9]+)?)\s*([km]?)", 1)
    unit = F.regexp_extract(F.lower(F.replace(c, F.lit(","), F.lit(""))), r"([0-9]+(?:\.[0-9]+)?)\s*([km]?)", 2)
    return F.when(number != "", F.round(number.cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)).cast("bigint"))


def repositories(payloads: DataFrame) -> DataFrame:
    """Search results; ``rank`` is the place in its page from 1."""
    x = payloads.select(F.from_json("payload", REPOSITORIES).alias("p")).select(F.posexplode("p.items").alias("i", "r")).where("r.full_name is not null")
    return x.select(
        F.lower("r.full_name").alias("external_id"), F.col("r.name").alias("title"), F.col("r.description").alias("summary"), F.col("r.html_url").alias("source_url"),
        F.col("r.owner.login").alias("author"), F.try_to_timestamp("r.pushed_at").alias("published_at"), F.array_compact(F.array("r.html_url", F.nullif("r.homepage", F.lit("")))).alias("outbound_urls"),
        F.col("r.stargazers_count").alias("stars"), F.col("r.forks_count").alias("forks"), F.col("r.language").alias("language"), F.col("r.license.spdx_id").alias("license"),
        F.coalesce("r.archived", F.lit(False)).alias("archived"), (F.col("i") + 1).alias("rank"),
    )


def trending(payloads: DataFrame, origin: str = "https://github.example") -> DataFrame:
    """Rows of a trending page: one per article block."""
    a = payloads.select(F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?is)<article\b.*?</article>"), F.lit(0))).alias("i", "a"))
    path = F.regexp_extract("a", r"(?is)<h[1-3]\b.*?href=[\"']/?([^\"'/]+/[^\"'/?#]+)", 1)
    return a.withColumn("path", path).where("path <> ''").select(
        F.lower("path").alias("external_id"), F.substring_index("path", "/", -1).alias("title"), stripped(_inside(F.col("a"), "p")).alias("summary"), F.concat(F.lit(origin + "/"), "path").alias("source_url"),
        F.substring_index("path", "/", 1).alias("author"), F.lit(None).cast("timestamp").alias("published_at"), F.array(F.concat(F.lit(origin + "/"), "path")).alias("outbound_urls"),
        counted(F.regexp_extract("a", r"(?is)/stargazers[^>]*>(.*?)</a>", 1)).alias("stars"), counted(F.regexp_extract("a", r"(?i)([0-9.,]+\s*[km]?)\s+stars\s+today", 1)).alias("stars_today"), (F.col("i") + 1).alias("rank"),
    )


def papers(payloads: DataFrame) -> DataFrame:
    """Entries of Atom feeds; the version is cut from the id."""
    e = payloads.select(F.explode(F.regexp_extract_all("payload", F.lit(r"(?is)<entry\b.*?</entry>"), F.lit(0))).alias("e"))
    url = F.trim(_inside(F.col("e"), "id"))
    found = F.regexp_extract(url, r"/abs/([^?#\s]+?)(v\d+)?$", 1)
    links = F.transform(F.regexp_extract_all("e", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda x: _attribute(x, "href"))
    return e.where(found != "").select(
        found.alias("external_id"), stripped(_inside(F.col("e"), "title")).alias("title"), stripped(_inside(F.col("e"), "summary")).alias("summary"), url.alias("source_url"),
        stripped(_inside(F.regexp_extract("e", r"(?is)<author\b.*?</author>", 0), "name")).alias("author"), F.try_to_timestamp(F.trim(_inside(F.col("e"), "published"))).alias("published_at"),
        F.array_compact(links).alias("outbound_urls"), F.coalesce(F.nullif(F.regexp_extract(url, r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("version"),
        _attribute(F.regexp_extract("e", r"(?is)<[a-z:]*primary_category\b[^>]*>", 0), "term").alias("primary_category"),
    )


def listings(payloads: DataFrame, origin: str = "https://reddit.example") -> DataFrame:
    x = payloads.select(F.from_json("payload", LISTING).alias("p")).select(F.explode("p.data.children").alias("c")).select("c.data.*").where("id is not null and not coalesce(over_18, false)")
    page = F.concat(F.lit(origin), "permalink")
    return x.select(
        F.col("id").alias("external_id"), "title", F.nullif("selftext", F.lit("")).alias("summary"), page.alias("source_url"), "author", F.timestamp_seconds("created_utc").alias("published_at"),
        F.array_compact(F.array("url_overridden_by_dest")).alias("outbound_urls"), (F.coalesce("ups", F.lit(0)) + F.coalesce("num_comments", F.lit(0))).alias("engagement"),
    )


def posts(payloads: DataFrame, origin: str = "https://x.example") -> DataFrame:
    """Posts with their accounts; a post whose account is not in the payload stays without one."""
    x = payloads.select(F.from_json("payload", POSTS).alias("p")).select(F.explode("p.data").alias("t"), F.col("p.includes.users").alias("users"))
    user = F.try_element_at(F.filter("users", lambda u: u["id"] == F.col("t.author_id")), F.lit(1))
    x = x.withColumn("user", user).where("t.id is not null")
    m = F.col("t.public_metrics")
    followers = F.coalesce("user.public_metrics.followers_count", F.lit(0))
    reach = F.when(followers >= 100_000, 8).when(followers >= 10_000, 5).when(followers >= 1_000, 2).otherwise(0)
    return x.select(
        F.col("t.id").alias("external_id"), F.col("t.text").alias("title"), F.col("t.text").alias("summary"), F.concat(F.lit(origin + "/"), F.coalesce("user.username", F.lit("i")), F.lit("/status/"), "t.id").alias("source_url"),
        F.col("user.username").alias("author"), F.try_to_timestamp("t.created_at").alias("published_at"), F.coalesce("t.entities.urls.expanded_url", F.array().cast("array<string>")).alias("outbound_urls"),
        sum(F.coalesce(m[k], F.lit(0)) for k in ("like_count", "reply_count", "retweet_count", "quote_count")).alias("engagement"),
        F.least(F.lit(90), 72 + F.when(F.col("user.verified"), 8).otherwise(0) + reach).alias("authority"),
    )


def pages(rows: DataFrame, most_links: int = 50, most_summary: int = 320) -> DataFrame:
    """Web pages ``url, html``: title, summary, canonical address and links; the caps are part of what a page record is."""
    metas = F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def meta(*names: str) -> Column:
        def named(n: str):
            return lambda t: F.coalesce(_attribute(t, "name"), _attribute(t, "property")) == n

        hits = [F.try_element_at(F.filter(metas, named(n)), F.lit(1)) for n in names]
        return F.coalesce(*[_attribute(h, "content") for h in hits])

    canonical = _attribute(F.regexp_extract("html", r"(?is)<link\b[^>]*rel=[\"']canonical[\"'][^>]*>", 0), "href")
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>"), F.lit(0)), lambda t: absolute(_attribute(t, "href"), F.col("url")))
    text = F.coalesce(meta("description", "og:description"), stripped(_inside(F.col("html"), "p")))
    return rows.where("url is not null and html is not null").select(
        F.col("url").alias("external_id"), F.coalesce(decoded(meta("og:title", "twitter:title")), stripped(_inside(F.col("html"), "title")), stripped(_inside(F.col("html"), "h1"))).alias("title"),
        F.trim(F.substring(decoded(text), 1, most_summary)).alias("summary"), F.coalesce(absolute(canonical, F.col("url")), "url").alias("source_url"), decoded(meta("author", "article:author")).alias("author"),
        F.coalesce(*[F.try_to_timestamp(c) for c in (meta("article:published_time"), meta("date"), _attribute(F.regexp_extract("html", r"(?is)<time\b[^>]*>", 0), "datetime"))]).alias("published_at"),
        F.slice(F.array_distinct(F.array_compact(hrefs)), 1, most_links).alias("outbound_urls"),
    )
