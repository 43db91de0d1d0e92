"""Check each new batch for repeats of everything accepted so far, without working through the history again.

The history keeps block tables: per rare word, the bit-difference fingerprints
of the texts that have the word among their first (the block that must agree
exactly). A batch is looked up in the tables of its own words, candidates are
verified by Hamming distance and by text, and its fingerprints are appended.
All tables only grow; a batch reads the folders and shuffles the rows that its
own words, ids and candidates lead to.

Plain 64-bit SimHash in rotated blocks cannot find texts that share 60% of their
words: they differ in up to 18 of 64 bits. Fingerprints of ``setjoin`` bound the
difference of two sets by the difference of their bits, and its blocks lose no pair.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import setjoin
from tidemark.plans.shared import park, shared_dir


def id_key(c: Column) -> Column:
    """Letters and digits of an id in lower case; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", F.lit("")), F.lit(""))


class History:
    """Accepted rows in the shared folder, in tables that are only appended to.

    ``frequent``: words in the order of the search, as it was when the history began. ``lists``: fingerprints by word.
    ``sets``: the words of each distinct text with its item. ``ids``: letters and digits of ids with their item.
    ``items``: id, first sight and number of editions of each item, of which the highest ``version`` holds.
    All but the first are laid out in ``SLOTS`` folders by the key they are looked up by.
    """

    SCHEMAS = {
        "frequent": "rank int, word binary", "lists": "word bigint, m int, base bigint, list binary, tail binary, slot int", "sets": "rep bigint, codes binary, item_key string, slot int",
        "ids": "key string, seq bigint, item_key string, slot int", "items": "item_key string, item_id string, first_seen timestamp_ntz, edition_count bigint, version bigint, slot int",
    }
    #: Folders of a table. A batch whose keys fall into few of them leaves the others unread.
    SLOTS = 32

    def __init__(self, spark: SparkSession, threshold: float = 0.6, path: str | None = None) -> None:
        self.spark, self.threshold = spark, threshold
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        self.frequent: list[bytes] = []
        if path:  # a history that is opened again goes on with the codes of its stored sets
            self.frequent = [bytes(r["word"]) for r in self.table("frequent").orderBy("rank").collect()]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _slot(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.SLOTS)).cast("int")

    def _add(self, name: str, df: DataFrame, key: str) -> None:
        df = df.withColumn("slot", self._slot(key)).repartition("slot")
        df.write.mode("append").option("compression", "zstd").partitionBy("slot").parquet(f"{self.path}/{name}")

    def _of(self, name: str, key: str, keys: DataFrame) -> DataFrame:
        """The rows of a table whose ``key`` is among ``keys``: other folders are not read, other rows not shuffled."""
        slots = [r[0] for r in keys.select(self._slot(key)).distinct().collect()]  # at most SLOTS
        return self.table(name).where(F.col("slot").isin(slots)).drop("slot").join(keys, key, "left_semi")

    @classmethod
    def of(cls, rows: DataFrame, threshold: float = 0.6) -> History:
        """A history of published rows ``seq, item_id, name, summary, seen, published, edition``.

        ``seq`` orders rows by acceptance. Rows whose ``item_id`` has no letter or digit are items of their own.
        """
        h = cls(rows.sparkSession, threshold)
        key = id_key(F.col("item_id"))
        rows = rows.where("seq is not null").withColumn("key", key).withColumn("item_key", F.coalesce(key, F.concat(F.lit("#"), F.col("seq"))))
        texts = setjoin.readable(rows, "seq", ["name", "summary"], "history-texts")
        h.frequent = setjoin.frequent_words(texts)
        h.spark.createDataFrame(list(enumerate(h.frequent)), "rank int, word binary").coalesce(1).write.parquet(f"{h.path}/frequent")
        reps = park(setjoin.classes(setjoin.encode(texts, h.frequent)), "history-classes")
        owner = rows.groupBy("seq").agg(F.min("item_key").alias("item_key")).withColumnRenamed("seq", "rep")
        h._add_sets(reps.join(owner, "rep"))
        h._add("ids", rows.where("key is not null").groupBy("key").agg(F.min("seq").alias("seq"), F.min("item_key").alias("item_key")), "key")
        h._add("items", rows.groupBy("item_key").agg(
            F.min_by("item_id", F.struct("published", "seq")).alias("item_id"),
            F.min(F.least("seen", "published")).alias("first_seen"),
            F.countDistinct("edition").alias("edition_count"),
            F.max("seq").alias("version"),
        ), "item_key")
        return h

    def _add_sets(self, reps: DataFrame) -> None:
        self._add("sets", reps.select("rep", "codes", "item_key"), "rep")
        self._add("lists", setjoin.entries(reps, self.frequent, self.threshold), "word")

    def match(self, batch: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """``id, seq, key, item_key, item_id, is_new, by, similarity, first_seen, edition_count`` of a batch ``id, item_id, name, summary, received, edition``.

        A row repeats the item of an earlier row - of the history, or of the batch with a smaller ``id`` - if their ids
        have the same letters and digits, else if their words share at least ``threshold`` of their union; of several
        the most similar, then the earliest. Repeats of repeats belong to the first item. ``item_id`` is as first
        accepted, ``first_seen`` that of the accepted item and ``edition_count`` its count carried on by the editions
        of the batch so far. New rows start an item of their own.

        ``texts`` (id, text) are the batch's texts in their readable form, if they are known already.

        Null ids are left out; null ``item_id`` or texts match by what is there; an empty batch gives an empty result.
        """
        top = self.table("items").agg(F.max("version")).first()[0]
        low = batch.agg(F.min("id")).first()[0]
        shift = 0 if top is None or low is None else max(0, top - low + 1)
        batch = batch.where("id is not null").dropDuplicates(["id"])
        batch = park(batch.withColumn("seq", F.col("id") + F.lit(shift)).withColumn("key", id_key(F.col("item_id"))), "history-batch")
        if texts is None:
            texts = setjoin.readable(batch, "seq", ["name", "summary"], "history-texts")
        else:
            texts = texts.join(batch.select("id", "seq"), "id").select(F.col("seq").alias("id"), "text")
        encoded = park(setjoin.encode(texts, self.frequent), "history-codes")
        reps = park(setjoin.classes(encoded), "history-classes")
        fresh = park(setjoin.entries(reps, self.frequent, self.threshold, new=True), "history-entries")
        lists = self._of("lists", "word", park(fresh.select("word").distinct(), "history-words")).unionByName(fresh)
        sizes = lists.groupBy("word").agg(F.sum("m").alias("m"))
        pairs = park(setjoin.candidates(lists, sizes, self.threshold, only_new=True), "history-candidates")
        ends = park(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "history-ends")
        sets = park(self._of("sets", "rep", ends).unionByName(reps.select("rep", "codes", F.lit(None).cast("string").alias("item_key"))), "history-sets")
        pairs = setjoin.verify(pairs, sets, self.frequent, self.threshold)
        # of each distinct text of the batch the most similar earlier one, which is the first of its class
        up = pairs.select(F.greatest("a", "b").alias("rep"), F.least("a", "b").alias("up"), "similarity").join(sets.select(F.col("rep").alias("up"), "item_key"), "up")
        closest = up.groupBy("rep").agg(F.max(F.struct("similarity", (-F.col("up")).alias("up"), "item_key")).alias("x"))
        closest = park(closest.select("rep", (-F.col("x.up")).alias("up"), "x.similarity", "x.item_key"), "history-closest")
        own = encoded.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("id").alias("seq"), "rep").join(closest, "rep", "left")
        # a copy repeats the first row of its class, unless that has the very words of an earlier row itself
        copy = (F.col("seq") > F.col("rep")) & (F.coalesce("similarity", F.lit(0.0)) < 1)
        by_text = own.select(
            "seq", F.when(copy, F.col("rep")).otherwise(F.col("up")).alias("by_text"), F.when(copy, 1.0).otherwise(F.col("similarity")).alias("similarity"),
            F.when(~copy, F.col("item_key")).alias("text_item"),
        ).where("by_text is not null")
        known = park(self._of("ids", "key", park(batch.select("key").where("key is not null").distinct(), "history-keys")), "history-ids")
        first = known.unionByName(batch.where("key is not null").select("key", "seq", F.lit(None).cast("string").alias("item_key")))
        first = first.groupBy("key").agg(F.min("seq").alias("by_id"), F.min_by("item_key", "seq").alias("id_item"))
        rows = batch.select("id", "seq", "key").join(first, "key", "left").join(by_text, "seq", "left")
        earlier = F.col("by_id") < F.col("seq")
        own_key = F.coalesce("key", F.concat(F.lit("#"), F.col("seq")))
        rows = rows.withColumn("by", F.when(earlier, "id").when(F.col("by_text").isNotNull(), "text")).select(
            "id", "seq", "key", F.col("by").isNull().alias("is_new"), "by", "similarity",
            F.when(F.col("by") == "id", F.col("id_item")).when(F.col("by") == "text", F.col("text_item")).otherwise(own_key).alias("item_key"),
            F.when(F.col("by") == "id", F.col("by_id")).when(F.col("by") == "text", F.col("by_text")).alias("up"),
        )
        rows = self._follow(park(rows, "history-links"))
        # an item that begins in the batch is as its first row has it
        begun = rows.where("is_new").select("item_key", "seq").join(batch.select("seq", "item_id", "received"), "seq")
        begun = begun.groupBy("item_key").agg(F.min_by("item_id", "seq").alias("item_id"), F.min("received").alias("first_seen"), F.lit(0).cast("bigint").alias("edition_count"))
        touched = park(rows.where("not is_new").select("item_key").distinct(), "history-touched")
        held = self._of("items", "item_key", touched).groupBy("item_key").agg(F.max_by(F.struct("item_id", "first_seen", "edition_count"), "version").alias("x")).select("item_key", "x.*")
        items = held.unionByName(begun)
        seen = rows.join(batch.select("seq", "edition"), "seq")
        so_far = seen.select("item_key", "edition").distinct()
        so_far = so_far.groupBy("item_key").agg(F.array_sort(F.collect_set("edition")).alias("editions"))  # at most one entry an edition of the batch
        out = seen.join(so_far, "item_key").join(items, "item_key")
        count = F.col("edition_count") + F.coalesce(F.array_position("editions", F.col("edition")), F.lit(0))
        out = park(out.select("id", "seq", "key", "item_key", "item_id", "is_new", "by", F.round("similarity", 6).alias("similarity"), "first_seen", count.alias("edition_count")), "history-matched")
        self._pending = reps, closest, known, out
        return out

    def _follow(self, rows: DataFrame) -> DataFrame:
        """Item of every row: pointers to earlier rows of the batch are doubled until all end at a known item."""
        for _ in range(64):  # doubled so often, a pointer passes any number of rows
            if rows.where("item_key is null").isEmpty():
                return rows
            to = rows.select(F.col("seq").alias("at"), F.col("item_key").alias("found"), F.col("up").alias("next"))
            rows = rows.join(to, rows["up"] == to["at"], "left").select(
                "id", "seq", "key", "is_new", "by", "similarity", F.coalesce("item_key", "found").alias("item_key"),
                F.when(F.col("item_key").isNull(), F.col("next")).otherwise(F.col("up")).alias("up"),
            )
            rows = park(rows, "history-links")
        raise RuntimeError("rows point at each other")

    def append(self) -> None:
        """Accept the rows of the last ``match``: texts and ids that are new and the state of the items are added to the tables."""
        reps, closest, known, matched = self._pending
        new = reps.join(closest.where("similarity = 1"), "rep", "left_anti").join(matched.select(F.col("seq").alias("rep"), "item_key"), "rep")
        self._add_sets(park(new, "history-new"))
        ids = matched.where("key is not null").groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("item_key", "seq").alias("item_key"))
        self._add("ids", ids.join(known.select("key"), "key", "left_anti"), "key")
        self._add("items", matched.groupBy("item_key").agg(
            F.min_by("item_id", "seq").alias("item_id"), F.min("first_seen").alias("first_seen"), F.max("edition_count").alias("edition_count"), F.max("seq").alias("version")
        ), "item_key")


def published(edition_items: DataFrame) -> DataFrame:
    return edition_items.select(
        F.col("appearance_id").cast("bigint").alias("seq"), "item_id", F.col("item_name").alias("name"), "summary",
        F.col("first_seen").alias("seen"), F.col("published_at").alias("published"), F.col("edition_id").alias("edition"),
    )


def arriving(incoming_items: DataFrame) -> DataFrame:
    return incoming_items.select(
        F.col("incoming_id").cast("bigint").alias("id"), "item_id", F.col("item_name").alias("name"), "summary",
        F.col("received_at").alias("received"), F.col("batch_no").alias("edition"),
    )


def matches(edition_items: DataFrame, incoming_items: DataFrame, at_once: int = 10) -> DataFrame:
    """Every incoming row: new, or the item it repeats.

    The batches are taken in the order of their smallest id, ``at_once`` of them together; each lot is matched against
    the history and what was appended to it before. Rows of one lot are matched with each other in the order of their
    ids, so that the result does not depend on ``at_once``.
    """
    h = History.of(published(edition_items))
    new = arriving(incoming_items).where("id is not null")
    # how a text reads does not depend on the history, so it is worked out once for all lots
    texts = park(setjoin.readable(new.dropDuplicates(["id"]), "id", ["name", "summary"], "history-texts"), "history-texts")
    starts = sorted(r["low"] for r in new.groupBy("edition").agg(F.min("id").alias("low")).collect())[::at_once]  # one a batch
    got = []
    for low, high in zip(starts, [*starts[1:], None]):
        here = F.col("id") >= low if high is None else (F.col("id") >= low) & (F.col("id") < high)
        got.append(h.match(new.where(here), texts.where(here)))
        if high is not None:
            h.append()
    if not got:
        got.append(h.match(new))
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    return out.select(F.col("id").alias("incoming_id"), "item_id", "is_new", "by", "similarity", "first_seen", "edition_count")


def found(edition_items: DataFrame, incoming_items: DataFrame) -> DataFrame:
    """p5_found: incoming rows that repeat an accepted item, with its id."""
    return matches(edition_items, incoming_items).where("not is_new").select("incoming_id", "item_id")
