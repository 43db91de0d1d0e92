"""Mix sources to target shares of the tokens of a public tokenizer, in a proportionate-fair order.

Each source is a stream of its documents in a fixed pseudo-random order, pass
after pass, cut into blocks of tokens. The schedule is that of a frame in which
every source has a whole number of blocks; frame follows frame. Block ``k`` of a source with weight ``w``
is released at slot ``floor((k-1)/w)`` and due at ``ceil(k/w)``; taking the
released block with the earliest deadline at each slot keeps every source
within less than one block of its share at every point of the mixture.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import park

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts texts before byte-pair merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Slots of a frame. The schedule of a frame is made on the driver; a mixture has as many frames, each like the other, as its size asks for.
SLOTS = 4096
#: Tokens of a block at most, whatever the size of the mixture.
BLOCK_TOKENS = 1 << 16
#: Tokens of a part of a source's order at most, so that running sums need no task that holds a whole source.
PART_TOKENS = 1 << 24


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, tokens``; the vocabulary file is read on the driver and broadcast (its size is fixed)."""
    spark = documents.sparkSession
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    return (
        documents.where("doc_id is not null and text is not null and source is not null")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
        .mapInPandas(count, "doc_id bigint, source string, tokens bigint")
    )


def feasible_quotas(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source contributes.

    Sources with neither tokens nor a positive share drop out and the shares of the rest are scaled to 1. Without
    ``total`` the mixture is the largest in which every share is met exactly; with ``total`` a source that falls short
    even when repeated gives all it may, and the others share the rest by their weights, as far as they reach.
    """
    left = {s: (w, available[s] * r) for s, w, r in targets if w and w > 0 and r and r > 0 and available.get(s, 0) > 0}
    if not left:
        return {}
    weight = sum(w for w, _ in left.values())
    if total is None:
        total = min(cap / (w / weight) for w, cap in left.values())
    got: dict[str, float] = {}
    rest = float(total)
    while left:
        weight = sum(w for w, _ in left.values())
        short = {s: cap for s, (w, cap) in left.items() if cap <= rest * w / weight * (1 - 1e-12)}
        if not short:
            got |= {s: min(float(cap), rest * w / weight) for s, (w, cap) in left.items()}
            break
        for s, cap in short.items():
            got[s] = float(cap)
            rest -= cap
            del left[s]
    return got


def pfair_schedule(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """``(source, block, slot)``: earliest deadline first among released blocks; blocks count from 0."""
    slots = sum(blocks.values())
    weight = {s: Fraction(n, slots) for s, n in blocks.items() if n > 0}
    release = lambda s, k: k * weight[s].denominator // weight[s].numerator
    due = lambda s, k: -(-(k + 1) * weight[s].denominator // weight[s].numerator)
    waiting = [(0, s, 0) for s in sorted(weight)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (max(release(s, k + 1), slot + 1), s, k + 1))
    return out


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER, slots: int = SLOTS, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """The mixture: ``slot, source, block, pass, doc_id, tokens, target_share`` with one row per use of a document.

    Order by ``slot, pass, doc_id`` to read it. A block has at most ``block_tokens`` tokens, or a frame's part of a
    mixture of less than ``slots`` blocks; a source has at least one block in each frame, and blocks of a size of its
    own, so that its share is met whatever the number of slots. ``pass`` counts from 1 and never exceeds ``max_repeats``. The last
    document of a source is used if at least half of it fits, so that a source misses its quota by half a document at
    most. Documents without id, text or source and sources without a target are left out; a repeated ``doc_id`` is one
    document; documents of no tokens are never used; targets that are repeated add up their shares and keep the lowest
    cap; empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r")).collect()
    goals = [(t["source"], float(t["w"] or 0), int(t["r"] or 0)) for t in wanted]
    place = F.xxhash64(F.col("doc_id"), F.lit(17))
    counted = count_tokens(documents.where(F.col("source").isin([g[0] for g in goals] or [""])), tokenizer)
    counted = counted.groupBy("doc_id").agg(F.min_by(F.struct("source", "tokens"), F.struct("source", "tokens")).alias("x")).select("doc_id", "x.*").where("tokens > 0")
    counted = park(counted.withColumn("place", place), "mixing-counts")
    available = {r["source"]: r["tokens"] for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # a row a target
    quotas = feasible_quotas(goals, available, total_tokens)
    whole = sum(quotas.values())
    cap = {s: r for s, _, r in goals}
    share = {s: w for s, w, _ in goals}
    frames = max(1, math.ceil(whole / (slots * block_tokens)))
    blocks = {s: max(1, round(slots * q / whole)) for s, q in quotas.items()}  # of a frame
    plan = [(s, float(q), float(available[s]), blocks[s], frames * blocks[s], q / (frames * blocks[s]), cap[s], share[s]) for s, q in quotas.items()]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, quota double, available double, in_frame bigint, blocks bigint, block_tokens double, cap bigint, target_share double"))
    order_df = F.broadcast(spark.createDataFrame(pfair_schedule(blocks), "source string, in_order bigint, place_in_frame bigint"))
    parts = max(1, math.ceil(max(available.values(), default=0) / part_tokens))
    counted = counted.withColumn("part", F.pmod("place", F.lit(parts)))
    sums = counted.groupBy("source", "part").agg(F.sum("tokens").alias("tokens"))
    sofar = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("source", "part", sofar.alias("sofar"))
    running = Window.partitionBy("source", "part").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = counted.withColumn("within", F.coalesce(F.sum("tokens").over(running), F.lit(0))).join(before, ["source", "part"]).join(plan_df, "source")
    docs = docs.withColumn("passes", F.least("cap", F.ceil(F.col("quota") / F.col("available")) + 1))
    uses = docs.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes").cast("bigint"))))
    uses = uses.withColumn("start", (F.col("pass") - 1) * F.col("available") + F.col("sofar") + F.col("within"))
    uses = uses.where("start + tokens / 2.0 <= quota").withColumn("block", F.least(F.col("blocks") - 1, F.floor(F.col("start") / F.col("block_tokens"))))
    uses = uses.withColumn("in_order", F.col("block") % F.col("in_frame")).join(order_df, ["source", "in_order"])
    slot = F.expr("block div in_frame") * sum(blocks.values()) + F.col("place_in_frame")
    return uses.select(slot.alias("slot"), "source", "block", "pass", "doc_id", "tokens", "target_share")


def shares(documents: DataFrame, targets: DataFrame, **parameters) -> DataFrame:
    """``source, target_share, max_repeats, documents, uses, most_uses, tokens, actual_share`` of every target."""
    used = mixture(documents, targets, **parameters).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    per = used.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("uses"), F.max("n").alias("most_uses"), F.sum("t").alias("tokens"))
    whole = per.agg(F.sum("tokens").alias("whole"))
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = goals.join(per, "source", "left").crossJoin(F.broadcast(whole))  # one row on the right
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return got.select("source", "target_share", "max_repeats", zero("documents"), zero("uses"), zero("most_uses"), zero("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("whole"), 6).alias("actual_share"))
