"""Consumers without a declared id: which known consumer a request belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_agent(c: Column) -> Column:
    """Products of a user agent without comments and versions, each once, in lower case."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\([^)]*\)", " ")
    names = F.transform(F.split(F.trim(plain), r"\s+"), lambda p: F.substring_index(p, "/", 1))
    return F.nullif(F.array_join(F.array_distinct(F.filter(names, lambda p: p != "")), " "), F.lit(""))


def client_ip(forwarded_for: Column, forwarded: Column, direct: Column) -> Column:
    """Address of a client: first of the forwarding headers, then the connection; mapped and scoped forms are plain."""
    first = F.trim(F.split(forwarded_for, ",")[0])
    header = F.regexp_extract(F.lower(F.coalesce(forwarded, F.lit(""))), r"for=\"?\[?([^\];,\"]+)", 1)
    ip = F.coalesce(F.nullif(first, F.lit("")), F.nullif(header, F.lit("")), direct)
    return F.regexp_replace(F.regexp_replace(F.lower(ip), r"^::ffff:", ""), r"%.*$", "")


def identity(declared: Column, agent: Column, ip: Column) -> Column:
    """What identifies a consumer - a declared name, else its products, else its address - as the start of a hash."""
    what = F.coalesce(F.concat(F.lit("declared:"), F.nullif(F.trim(declared), F.lit(""))), F.concat(F.lit("agent:"), user_agent(agent)), F.concat(F.lit("ip:"), ip))
    return F.substring(F.sha2(what, 256), 1, 16)


def matched(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``request_id, consumer_id, by`` of requests ``request_id, declared, agent, ip`` against consumers ``consumer_id, declared, agent, ip``.

    In order: the same declared name; the only consumer of this agent on this address; the only one of this agent; the
    only one of this address. A request that none fits has no consumer. Uniqueness is counted once for the registry as
    given, so the result does not depend on the order of requests.
    """
    k = known.select("consumer_id", F.nullif(F.trim("declared"), F.lit("")).alias("declared"), user_agent(F.col("agent")).alias("agent"), "ip")
    r = requests.select("request_id", F.nullif(F.trim("declared"), F.lit("")).alias("declared"), user_agent(F.col("agent")).alias("agent"), "ip")

    def only(*by: str) -> DataFrame:
        return k.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("consumer_id").alias("id_" + "_".join(by))).where("n = 1").drop("n")

    names = k.where("declared is not null").groupBy("declared").agg(F.min("consumer_id").alias("id_declared"))
    r = r.join(names, "declared", "left")
    for by in (("agent", "ip"), ("agent",), ("ip",)):
        r = r.join(only(*by), list(by), "left")
    rules = [("declared", "id_declared"), ("agent and address", "id_agent_ip"), ("agent", "id_agent"), ("address", "id_ip")]
    return r.select(
        "request_id", F.coalesce(*[c for _, c in rules]).alias("consumer_id"), F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in rules]).alias("by")
    )
