"""Similarity join of word sets: all pairs whose sets share a given part of their union.

T-occurrence search in the manner of DivideSkip, over a whole collection at
once. The words of a set are ordered from rare to frequent. A pair that reaches
the required overlap T has T words in common, so two of them stand among the
first ``n - T + 2`` of each set: those lists - the short ones - are merged, and
a pair is a candidate when it occurs in two of them. Merging is done word by
word: a list keeps with each set the words that follow, and a list that is not
short enough to be compared as it stands is merged with the lists of those
words, which leaves the sets that occur in both. What occurs often enough is
held against a bit-difference sketch, and the words that were not merged - the
long lists - are probed by binary search until T is reached or out of reach.

Sets that are equal are one class and joined once.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import glyphs
from tidemark.operators.graph import components
from tidemark.plans.shared import park, unpark

_WORD = re.compile(r"[^\W_]+")

#: A word of at least this part of all sets counts as frequent, and of these at most so many; others keep the order of their hashes. The list that is broadcast is bounded by that, and what is frequent changes the cost only.
FREQUENT, RANKED = 1e-4, 1 << 20
#: 64-bit words of a sketch.
SKETCH = 2
#: Sets of one word that are compared in one place; longer lists are cut into blocks and every two blocks meet.
BLOCK = 1 << 19
#: From so many sets on a list is merged with the lists of the words that follow; changes the cost, not the result.
SPLIT = 256
#: Entries of a list that are merged by their second words at once; those of a longer list are taken in slices of these words.
CHUNK = 1 << 20

#: An entry as it is sent, and how it is sent where its numbers are too large for that.
SHORT = np.dtype([("id", "<u4"), ("s", "<u8", (SKETCH,)), ("n", "u1"), ("pos", "u1")])
ENTRY = np.dtype([("id", "<i8"), ("s", "<u8", (SKETCH,)), ("n", "<u4"), ("pos", "<u4")])
NEW = np.uint32(1 << 31)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def text_of(*columns: str) -> Column:
    return F.concat_ws("\n", *[F.col(c).cast("string") for c in columns])


def readable(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """``id, text`` with the columns' texts together in their visually consistent form; rows of a null key are left out."""
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), text_of(*columns).alias("text"))
    need = glyphs.needs_work(F.col("text"))
    hard = park(rows.where(need), name)  # a small part, read twice below
    hard = glyphs.Dictionary(hard).join(hard, F.col("id"), "left").select("id", F.coalesce("unified", "text").alias("text"))
    return rows.where(~need).unionByName(park(hard, name))


#: Plain characters in lower case, those that are no letter or digit as spaces: a faster way to the same words where a text is plain.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def _words(text: str) -> set[bytes]:
    if text.isascii():
        return set(text.encode().translate(_PLAIN).split())
    return {w.encode() for w in _WORD.findall(text.lower())}


def frequent_words(texts: DataFrame, part: float = FREQUENT) -> list[bytes]:
    """The frequent words, rarest first. Counted over all texts; counts are combined before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, n = Counter(), 0
        for b in batches:
            for t in b["text"]:
                c.update(_words(t))
            n += len(b)
            if len(c) > 500_000:
                yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                c.clear()
        c[b""] += n
        yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    counts = park(texts.select("text").mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word-counts")
    n = counts.where("word = X''").agg(F.sum("n")).first()[0] or 0
    # bounded: see FREQUENT
    often = counts.where("word <> X''").where(F.col("n") >= max(2, math.ceil(part * n))).orderBy(F.desc("n"), F.desc("word")).limit(RANKED).orderBy("n", "word").select("word").toPandas()
    return [bytes(w) for w in often["word"]]


class Coder:
    """Words to numbers in the order of the search: rare ones are negative hashes, frequent ones their rank."""

    def __init__(self, frequent: list[bytes]) -> None:
        import xxhash

        class Memo(dict):
            def __missing__(self, w: bytes) -> int:
                if len(self) > 2_000_000:
                    self.clear()
                    self.update(base)
                self[w] = code = -1 - (xxhash.xxh3_64_intdigest(w) >> 2)
                return code

        base = {w: i for i, w in enumerate(frequent)}
        self.memo = Memo(base)
        self.rank = "H" if len(frequent) < 1 << 16 else "I"

    def pack(self, text: str) -> bytes | None:
        """The numbers of a text's words in order: how many are rare, those in 8 bytes each, the ranks of the others; None without words."""
        words = _words(text)
        if not words:
            return None
        codes = sorted(map(self.memo.__getitem__, words))
        k = bisect_left(codes, 0)
        return struct.pack("<I", k) + array("q", codes[:k]).tobytes() + array(self.rank, codes[k:]).tobytes()


def _rank(frequent: list[bytes]) -> np.dtype:
    return np.dtype("<u2") if len(frequent) < 1 << 16 else np.dtype("<u4")


def unpack(packed: list[bytes], rank: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of many packed sets, one set after the other, and the size of each."""
    k = np.array([int.from_bytes(x[:4], "little") for x in packed], np.int64)
    rare = np.frombuffer(b"".join([x[4 : 4 + 8 * m] for x, m in zip(packed, k.tolist())]), "<i8")
    often = np.frombuffer(b"".join([x[4 + 8 * m :] for x, m in zip(packed, k.tolist())]), rank)
    n = k + np.array([(len(x) - 4) // rank.itemsize for x in packed], np.int64) - k * (8 // rank.itemsize)
    flat = np.empty(int(n.sum()), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    first = place < np.repeat(k, n)
    flat[first], flat[~first] = rare, often
    return flat, n


def encode(texts: DataFrame, frequent: list[bytes]) -> DataFrame:
    """``id, h1, h2, codes``: equal sets have equal ``h1, h2``. Texts without words are left out: they share no word."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        coder = Coder(sent.value)
        for b in batches:
            packed = [coder.pack(t) for t in b["text"].tolist()]
            some = np.array([x is not None for x in packed], bool)
            packed = [x for x in packed if x is not None]
            two = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packed)), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"id": b["id"].to_numpy()[some], "h1": two[:, 0], "h2": two[:, 1], "codes": packed})

    return texts.select("id", "text").mapInPandas(run, "id bigint, h1 bigint, h2 bigint, codes binary")


def classes(encoded: DataFrame) -> DataFrame:
    """``rep, h1, h2, codes`` of each class of equal sets; ``rep`` is its smallest id."""
    return encoded.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("codes").alias("codes"))


def merged(n: np.ndarray, threshold: float, k: int) -> np.ndarray:
    """How many first words of sets of ``n`` words hold the ``k``-th word that is shared with any similar set."""
    return np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + k)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length - 1`` of each range, one range after the other."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def _pack(e: np.ndarray, cut: np.ndarray, new: bool) -> tuple[np.ndarray, list[bytes]]:
    """``base`` and the bytes of the entries between every two cuts, which are short where they can be.

    ``base`` is the upper half of their ids; its lowest bits tell whether short entries are new and whether they are short.
    """
    base = e["id"] >> 32
    fits = (e["n"] < 256) & (base == np.repeat(base[cut[:-1]], np.diff(cut)))
    fits = np.logical_and.reduceat(fits, cut[:-1])
    short = np.empty(len(e), SHORT)
    short["id"], short["s"], short["n"], short["pos"] = e["id"] & 0xFFFFFFFF, e["s"], e["n"] & 0xFF, e["pos"] & 0xFF
    if new:
        e["n"] |= NEW
    return np.where(fits, (base[cut[:-1]] << 32) + 2 + new, 0), [(short if ok else e)[i:j].tobytes() for i, j, ok in zip(cut.tolist(), cut[1:].tolist(), fits.tolist())]


def _unpack_entries(pieces: dict[int, tuple[list[bytes], list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """The entries and tails of one word from its pieces by their base."""
    got = []
    for base, (lists, _) in pieces.items():
        if not base & 2:
            got.append(np.frombuffer(b"".join(lists), ENTRY))
            continue
        short = np.frombuffer(b"".join(lists), SHORT)
        e = np.empty(len(short), ENTRY)
        e["id"], e["s"], e["n"], e["pos"] = short["id"].astype(np.int64) | (base >> 32 << 32), short["s"], short["n"] | (NEW if base & 1 else np.uint32(0)), short["pos"]
        got.append(e)
    return got[0] if len(got) == 1 else np.concatenate(got), np.frombuffer(b"".join([t for _, tails in pieces.values() for t in tails]), "<u2")


def entries(reps: DataFrame, frequent: list[bytes], threshold: float, new: bool = False) -> DataFrame:
    """The short lists, in pieces: ``word, m, base, list, tail`` with the entries of the sets that have the word among their first.

    ``tail`` holds for each entry the words after this one that take part in the merge, hashed to 16 bits: words with
    one hash are merged as one, which adds candidates and loses none. ``m`` is the number of entries of a piece.
    """
    rank = _rank(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat, n = unpack(b["codes"].tolist(), rank)
            if not len(n):
                continue
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            mixed = flat.view(np.uint64) * _GOLDEN
            bit, code = (mixed >> np.uint64(40)) % np.uint64(64 * SKETCH), (mixed >> np.uint64(48)).astype("<u2")
            one = np.uint64(1) << (bit & np.uint64(63))
            sketch = np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), start) for w in range(SKETCH)], axis=1)
            first, last = merged(n, threshold, 1), merged(n, threshold, 2)
            row = np.repeat(np.arange(len(n)), first)
            pos = _ranges(np.zeros(len(n), np.int64), first)
            word = flat[start[row] + pos]
            order = np.argsort(word, kind="stable")
            word, row, pos = word[order], row[order], pos[order]
            e = np.empty(len(row), ENTRY)
            e["id"], e["s"], e["n"], e["pos"] = b["rep"].to_numpy()[row], sketch[row], n[row], pos
            length = last[row] - pos - 1
            tail = code[_ranges(start[row] + pos + 1, length)]
            cut = np.concatenate([[0], np.nonzero(word[1:] != word[:-1])[0] + 1, [len(word)]])
            at = np.concatenate([[0], np.cumsum(length)])[cut]
            base, lists = _pack(e, cut, new)
            yield pd.DataFrame({"word": word[cut[:-1]], "m": np.diff(cut), "base": base, "list": lists, "tail": [tail[i:j].tobytes() for i, j in zip(at, at[1:])]})

    return reps.select("rep", "codes").mapInPandas(run, "word bigint, m int, base bigint, list binary, tail binary")


def list_sizes(reps: DataFrame, frequent: list[bytes], threshold: float) -> DataFrame:
    """``word, m``: how many entries the short lists will have."""
    rank = _rank(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat, n = unpack(b["codes"].tolist(), rank)
            if len(n):
                word, m = np.unique(flat[_ranges(np.cumsum(n) - n, merged(n, threshold, 1))], return_counts=True)
                yield pd.DataFrame({"word": word, "m": m})

    return reps.select("codes").mapInPandas(run, "word bigint, m bigint").groupBy("word").agg(F.sum("m").alias("m"))


class Comparer:
    """Merges and compares the lists of one word after another; what is to be compared is gathered and swept through together."""

    #: Entries that are swept through together; a group of more than so many is compared for itself.
    ITEMS, DENSE = 1 << 15, 512

    def __init__(self, threshold: float, only_new: bool, split: int = SPLIT) -> None:
        self.threshold, self.only_new, self.split = threshold, only_new, split
        self.a_sum, self.a_diff = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)
        self.out: list[np.ndarray] = []
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.items = 0

    def add(self, e: np.ndarray, tail: np.ndarray) -> None:
        """The entries of a word with their tails."""
        if len(e) < 2 or self.only_new and not (e["n"] & NEW).any():
            return
        n, pos = (e["n"] & ~NEW).astype(np.int64), e["pos"].astype(np.int64)
        order = np.argsort(n, kind="stable")  # every group is in order of size
        length = merged(n, self.threshold, 2) - pos - 1
        start = (np.cumsum(length) - length)[order]
        n, pos, length = n[order], pos[order], length[order]
        self.now = e["id"][order], e["s"][:, 0][order], e["s"][:, 1][order], e["n"][order], n
        row = np.arange(len(e), dtype=np.int32)
        if len(e) <= self.split:
            self._put(row, pos, np.array([len(e)]), 1)
            return
        # sets so small that one shared word is enough for a pair of them
        tiny = np.flatnonzero(np.ceil(self.threshold * n - 1e-9) < 2)
        self._put(row[tiny], pos[tiny], np.array([len(tiny)]), 1)
        row, place, pos = np.repeat(row, length), _ranges(start, length), _ranges(pos + 1, length).astype(np.uint32)
        code = tail[place]
        del place
        slices = min(1 << max(0, (len(code) - 1) // CHUNK).bit_length(), 1 << 16)
        for s in range(slices):
            at = np.flatnonzero((code & (slices - 1)) == s) if slices > 1 else slice(None)
            order = np.argsort(code[at], kind="stable")
            c, r, p = code[at][order], row[at][order], pos[at][order]
            cut = np.concatenate([[0], np.nonzero(c[1:] != c[:-1])[0] + 1]) if len(c) else np.empty(0, np.int64)
            sizes = np.diff(np.concatenate([cut, [len(c)]]))
            keep = sizes > 1
            if self.only_new and len(cut):
                keep &= np.bitwise_or.reduceat(self.now[3][r] & NEW, cut) > 0
            some = np.repeat(keep, sizes)
            self._put(r[some], p[some].astype(np.int64), sizes[keep], 2)

    def _put(self, row: np.ndarray, pos: np.ndarray, sizes: np.ndarray, k: int) -> None:
        """Groups of entries that share ``k`` words, the last of them at ``pos``: large ones are compared, others wait to be compared together."""
        if not len(row):
            return
        ids, s0, s1, size, n = self.now[:5]
        left = n[row] - pos - 1 + k  # the words that are shared so far and all that come after
        dense = sizes > self.DENSE
        if dense.any():
            end = np.cumsum(sizes)
            for i, j in zip((end - sizes)[dense].tolist(), end[dense].tolist()):
                self._dense(row[i:j], left[i:j])
            some = np.repeat(~dense, sizes)
            row, left, sizes = row[some], left[some], sizes[~dense]
        for i in range(0, len(sizes), self.ITEMS // self.DENSE):
            part = sizes[i : i + self.ITEMS // self.DENSE]
            j = int(part.sum())
            r, row = row[:j], row[j:]
            self.waiting.append((ids[r], s0[r], s1[r], size[r], left[:j], part))
            left = left[j:]
            self.items += j
            if self.items >= self.ITEMS:
                self.flush()

    def _reach(self, n: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half of what a pair may differ in, up to what a sketch can show, and the largest set that so much overlap suffices for."""
        return np.minimum(32 * SKETCH, np.ceil(self.a_diff * n)).astype(np.uint8), np.floor(left / self.a_sum - n + 1e-9).astype(np.int64)

    def _dense(self, row: np.ndarray, left: np.ndarray) -> None:
        """Compare a large group, many with many: those that can be the smaller set of a pair with all that are no smaller and that they may reach."""
        ids, s0, s1, size, n = (x[row] for x in self.now[:5])
        fresh, found, waiting = (size & NEW) > 0, [], 0
        q, most = self._reach(n, left)
        small = np.flatnonzero(most >= n)
        for i in range(0, len(small), 16):
            u = small[i : i + 16]
            # a set that this leaves without a partner of its own size meets smaller ones only, down to the first of these
            v = np.arange(u[0] + 1, np.searchsorted(n, most[u].max(), "right"))
            v = v[most[v] >= n[u[0]]]
            if self.only_new and not fresh[u].all():
                v = v if fresh[u].any() else v[fresh[v]]
            for j in range(0, len(v), 2048):
                w = v[j : j + 2048]
                bits = np.bitwise_count(s0[u][:, None] ^ s0[w])
                bits += np.bitwise_count(s1[u][:, None] ^ s1[w])
                hit = np.flatnonzero((bits <= q[u][:, None] + q[w]).ravel())
                if len(hit):
                    a, b = u[hit // len(w)], w[hit % len(w)]
                    ok = (b > a) & (n[b] <= most[a])
                    found.append(np.stack([a[ok], b[ok]]))
                    waiting += len(a)
                    if waiting > 1 << 16:
                        self._check(np.concatenate(found, axis=1), ids, s0, s1, n, left, fresh)
                        found, waiting = [], 0
        if found:
            self._check(np.concatenate(found, axis=1), ids, s0, s1, n, left, fresh)

    def flush(self) -> None:
        """Compare all that waits: every item with the one ``d`` places further in its group, for every ``d`` that its place allows."""
        if not self.waiting:
            return
        ids, s0, s1, size, left, sizes = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.items = [], 0
        fresh, n = (size & NEW) > 0, (size & ~NEW).astype(np.int64)
        q, most = self._reach(n, left)
        group = np.repeat(np.arange(len(sizes)) << 32, sizes)
        key, limit = np.append(group + n, np.iinfo(np.int64).max), group + most
        at = np.flatnonzero(most >= n)
        x0, x1, xq, end = s0[at], s1[at], q[at], limit[at]
        found, waiting, d = [], 0, 0
        while len(at):
            d += 1
            to = np.minimum(at + d, len(ids))
            ok = key[to] <= end
            if np.count_nonzero(ok) < 0.9 * len(ok):
                at, to, x0, x1, xq, end = at[ok], to[ok], x0[ok], x1[ok], xq[ok], end[ok]
                ok = slice(None)
            to = np.minimum(to, len(ids) - 1)
            bits = np.bitwise_count(x0 ^ s0[to])
            bits += np.bitwise_count(x1 ^ s1[to])
            hit = np.flatnonzero(bits <= xq + q[to])
            if len(hit):
                found.append(np.stack([at[hit], to[hit]]))
                waiting += len(hit)
                if waiting > 1 << 16:
                    self._check(np.concatenate(found, axis=1), ids, s0, s1, n, left, fresh)
                    found, waiting = [], 0
        if found:
            self._check(np.concatenate(found, axis=1), ids, s0, s1, n, left, fresh)

    def _check(self, uv: np.ndarray, ids: np.ndarray, s0: np.ndarray, s1: np.ndarray, n: np.ndarray, left: np.ndarray, fresh: np.ndarray) -> None:
        u, v = uv
        x, y = n[u], n[v]
        ok = np.bitwise_count(s0[u] ^ s0[v]).astype(np.int64) + np.bitwise_count(s1[u] ^ s1[v]) <= self.a_diff * (x + y) + 1e-9
        ok &= (np.minimum(x, y) >= self.threshold * np.maximum(x, y) - 1e-9) & (ids[u] != ids[v])
        ok &= np.minimum(left[u], left[v]) >= np.ceil(self.a_sum * (x + y) - 1e-9)
        if self.only_new:
            ok &= fresh[u] | fresh[v]
        if ok.any():
            a, b = ids[u[ok]], ids[v[ok]]
            self.out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))


def candidates(lists: DataFrame, sizes: DataFrame, threshold: float, only_new: bool = False, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """``a, b`` (ids, a < b) of all pairs that occur in enough short lists and whose sketches allow the threshold.

    ``sizes`` (word, m) are those of the lists. A list of more than ``block`` entries is cut, and every two parts meet in
    a cell of their own; so no task holds more than two blocks.
    """
    # parked, as the size of what is left decides how it is joined; at most all entries / block words
    long = park(sizes.where(F.col("m") > block).select("word", F.ceil(F.col("m") / block).cast("int").alias("k")), "setjoin-long")
    if long.isEmpty():
        cells = lists.select("word", F.lit(0).alias("p"), F.lit(0).alias("q"), "m", "base", "list", "tail")
    else:
        cells = lists.join(long, "word", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        cells = cells.withColumn("part", F.pmod(F.xxhash64("list"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        cells = cells.select("word", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "m", "base", "list", "tail")
    cells = cells.repartition("word", "p", "q").sortWithinPartitions("word", "p", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, m, now, compare = {}, 0, None, Comparer(threshold, only_new, split)

        def flush():
            nonlocal held, m
            if m > 1:
                compare.add(*_unpack_entries(held))
            held, m = {}, 0

        for b in batches:
            for w, p, q, k, base, x, y in zip(b["word"].tolist(), b["p"].tolist(), b["q"].tolist(), b["m"].tolist(), b["base"].tolist(), b["list"], b["tail"]):
                if (w, p, q) != now:
                    flush()
                    now = (w, p, q)
                lists, tails = held.setdefault(base, ([], []))
                lists.append(x)
                tails.append(y)
                m += k
            if sum(x.shape[1] for x in compare.out) > 50_000:
                yield _pairs(compare.out)
                compare.out.clear()
        flush()
        compare.flush()
        yield _pairs(compare.out)

    return cells.mapInPandas(run, "a bigint, b bigint").distinct()


def _pairs(out: list[np.ndarray]) -> pd.DataFrame:
    if not out:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    p = np.unique(np.concatenate(out, axis=1), axis=1)
    return pd.DataFrame({"a": p[0], "b": p[1]})


def verify(pairs: DataFrame, reps: DataFrame, frequent: list[bytes], threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs whose sets share at least ``threshold`` of their union."""
    rank = _rank(frequent)
    sets = reps.select("rep", "codes")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("codes").alias("ca")), "a").join(sets.select(F.col("rep").alias("b"), F.col("codes").alias("cb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            if not len(t):
                continue
            got = np.zeros(len(t))
            (xs, nx), (ys, ny) = unpack(t["ca"].tolist(), rank), unpack(t["cb"].tolist(), rank)
            for i, (x, y) in enumerate(zip(np.split(xs, np.cumsum(nx)[:-1]), np.split(ys, np.cumsum(ny)[:-1]))):
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                o = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                got[i] = o / (len(x) + len(y) - o)
            ok = got >= threshold - 1e-12
            yield pd.DataFrame({"a": t["a"][ok], "b": t["b"][ok], "similarity": got[ok]})

    return both.select("a", "b", "ca", "cb").mapInPandas(run, "a bigint, b bigint, similarity double")


class Join:
    """The parts of a self-join: ``members`` (id, rep) and ``pairs`` (a, b, similarity) between representatives."""

    def __init__(self, rows: DataFrame, key: str, columns: list[str], threshold: float, block: int = BLOCK, split: int = SPLIT) -> None:
        texts = readable(rows, key, columns, "setjoin-texts")
        frequent = frequent_words(texts)
        encoded = park(encode(texts, frequent), "setjoin-codes")
        self.reps = park(classes(encoded), "setjoin-classes")
        self.members = park(encoded.select("id", "h1", "h2").join(self.reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep").distinct(), "setjoin-members")
        unpark(encoded)
        # parked, as the size of what is left decides how it is joined
        sizes = list_sizes(self.reps, frequent, threshold)
        found = park(candidates(entries(self.reps, frequent, threshold), sizes, threshold, block=block, split=split), "setjoin-candidates")
        self.pairs = park(verify(found, self.reps, frequent, threshold), "setjoin-pairs")


def similar_pairs(rows: DataFrame, key: str, columns: list[str], threshold: float = 0.6, part: int = 4096) -> DataFrame:
    """``a, b`` (keys, a < b) of all rows whose word sets share at least ``threshold`` of their union.

    Equal sets count. Null texts are empty; texts without any word are similar to none; rows of a null key are left
    out and a repeated key counts once; an empty table gives no pair; columns but ``key`` and ``columns`` are ignored.

    A class of more than ``part`` rows is cut and its parts meet pairwise, in tasks of their own.
    """
    j = Join(rows, key, columns, threshold)
    members = j.members
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # parked, as the size of what is left decides how it is joined
    parts = park(copies.select("rep", F.ceil(F.col("copies") / part).cast("int").alias("k")), "setjoin-parts")
    several = members.join(parts, "rep").withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    x = several.select("rep", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("k") - 1)).alias("q"), F.col("id").alias("ia"))
    y = several.select("rep", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("p"), F.col("part").alias("q"), F.col("id").alias("ib"))
    within = x.join(y, ["rep", "p", "q"]).where("p < q or ia < ib").select("ia", "ib")
    # a class of one row is its representative; only pairs of a larger one are spread over its parts
    across = j.pairs.select("a", "b")
    for c in ("a", "b"):
        across = across.join(parts.withColumnRenamed("rep", c), c, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
        rows_of = several.select(F.col("rep").alias(c), "part", F.col("id").alias("row"))
        across = across.join(rows_of, [c, "part"], "left").withColumn(f"i{c}", F.coalesce("row", c)).drop("row", "part")
    return within.unionByName(across.select("ia", "ib")).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def groups(rows: DataFrame, key: str, columns: list[str], threshold: float = 0.6) -> DataFrame:
    """One row per row of a group: ``key, class_id, copies, links``.

    ``class_id`` is the smallest key of the group, ``copies`` counts the rows with the same set of words and ``links``
    the rows with another set that is similar. Rows without a copy or link are left out.
    """
    j = Join(rows, key, columns, threshold)
    members = j.members
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    both = j.pairs.select("a", "b").unionByName(j.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("links")).withColumnRenamed("a", "rep")
    roots = components(j.pairs).withColumnRenamed("node", "rep")
    got = members.join(size, "rep").join(links, "rep", "left").join(roots, "rep", "left").where("copies > 1 or links is not null")
    return got.select(F.col("id").alias(key), F.coalesce("root", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def found(records: DataFrame) -> DataFrame:
    """p2_found: pairs of records whose word sets share at least 60% of their union."""
    return similar_pairs(records, "record_id", ["title", "summary"], 0.6).select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))
