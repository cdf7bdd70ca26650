"""Exact dedup with an extendible-hash index on shared files.

Texts are normalised and hashed to 64 bits. Keys are dealt to owners by their first
bits, so that an owner has one range of keys, in order. It starts with one bucket and,
while a bucket has more than ``capacity`` distinct keys, splits it by one more bit and
doubles its directory where the bucket was as deep as that; chains texts with the same
key, and compares bytes. The buckets are written to the shared folder in key order.

A text whose key no other row has equals none, so only texts of repeated keys move, each
once a task (copies within a task are combined first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, discard, materialise, small_batches, table, texts

#: Distinct keys of a bucket at most, whatever the number of keys; bytes of texts that a task combines at a time.
CAPACITY, HELD_BYTES = 256, 24 << 20
#: Bits of an owner's directory at most: 2^DEEPEST entries.
DEEPEST = 20
#: Repeated keys that an owner has on average, at most: owners grow with the input.
OWNED = 1 << 16
#: Bits that tell tasks which keys may be repeated, BITS / 64 rows whatever the input. Beyond some millions of repeated keys more texts move, with the same result.
BITS = 1 << 24


class Directory:
    """Extendible-hash directory of one owner: its entries are the next ``depth`` bits of a key behind the ``skip`` bits that all its keys share.

    ``keys`` are distinct, in unsigned order. No bucket is left with more than ``capacity`` keys but where DEEPEST bits don't tell them apart, which hashes don't
    come to: such a bucket is a longer chain, and as right.
    """

    def __init__(self, keys: np.ndarray, capacity: int, skip: int = 0):
        self.keys, self.skip, self.depth = keys, skip, 0
        #: Of each bucket: local depth, and where its keys begin and end.
        self.buckets = [(0, 0, len(keys))]
        self.entries = [0]
        overfull = [0] if len(keys) > capacity else []
        while overfull:
            b = overfull.pop()
            local, lo, hi = self.buckets[b]
            if local == self.depth:  # double: each entry now stands for two
                self.entries = [e for e in self.entries for _ in range(2)]
                self.depth += 1
            bit = np.uint64(1) << np.uint64(63 - self.skip - local)
            mid = lo + int(np.searchsorted(keys[lo:hi] & bit, bit))  # the bits before this one are equal
            new = len(self.buckets)
            self.buckets[b] = (local + 1, lo, mid)
            self.buckets.append((local + 1, mid, hi))
            first = self.entries.index(b)
            span = 1 << (self.depth - local)
            self.entries[first + span // 2 : first + span] = [new] * (span // 2)
            overfull += [x for x in (b, new) if self.buckets[x][2] - self.buckets[x][1] > capacity and local + 1 < min(DEEPEST, 64 - skip)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The bucket of each key."""
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        at = (keys << np.uint64(self.skip)) >> np.uint64(64 - self.depth)
        return np.array(self.entries, np.int64)[at.astype(np.int64)]


def _combine():
    """Texts of a task, each once: (key, doc_id, n, text) with the smallest doc_id and the number of rows."""

    def run(batches):
        held, size = {}, 0

        def flush():
            keys = np.array([k for k, chain in held.items() for _ in chain], np.int64)
            rows = [x for chain in held.values() for x in chain]
            for i in range(0, len(rows), 1000):
                part = rows[i : i + 1000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i : i + 1000]), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int64()), pa.array([x[0] for x in part], pa.string())],
                    ["key", "doc_id", "n", "text"],
                )

        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                chain = held.setdefault(key, [])
                for entry in chain:
                    if entry[0] == text:
                        entry[1], entry[2] = min(entry[1], doc_id), entry[2] + 1
                        break
                else:
                    chain.append([text, doc_id, 1])
                    size += len(text) + 100
            if size > HELD_BYTES:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


INDEX = "owner int, depth int, bucket long, key long, sha string, keep_id long, group_size long"


def _own(bits: int, capacity: int):
    """Rows (owner, key, doc_id, n, text) in the order of owner and unsigned key: an owner's buckets, in order, with a row for each distinct text.

    Texts of one key are chained and told apart by their bytes; only one key's texts are held, and of a finished key its digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, key, chain, done = None, None, [], []

        def close() -> None:
            done.extend((key, hashlib.sha256(t).hexdigest(), d, n) for t, d, n in chain)
            chain.clear()

        def index() -> Iterator[pa.RecordBatch]:
            keys = np.array([r[0] for r in done], np.int64).view(np.uint64)
            directory = Directory(np.unique(keys), capacity, bits)
            bucket = directory.find(keys)
            depth = np.array([x[0] for x in directory.buckets], np.int64)[bucket] + bits
            prefix = np.where(depth > 0, keys >> ((64 - depth) % 64).astype(np.uint64), np.uint64(0)).view(np.int64)
            columns = [pa.array(np.full(len(done), owner), pa.int32()), pa.array(depth, pa.int32()), pa.array(prefix), pa.array(keys.view(np.int64))]
            columns += [pa.array([r[1] for r in done]), pa.array([r[2] for r in done], pa.int64()), pa.array([r[3] for r in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])
            done.clear()

        for batch in batches:
            for o, k, doc_id, n, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "key", "doc_id", "n", "text"))):
                if k != key or o != owner:
                    close()
                    if o != owner and done:
                        yield from index()
                    owner, key = o, k
                raw = text.encode()
                for entry in chain:
                    if entry[0] == raw:
                        entry[1], entry[2] = min(entry[1], doc_id), entry[2] + n
                        break
                else:
                    chain.append([raw, doc_id, n])
        close()
        if done:
            yield from index()

    return run


def _bit(key: Column) -> tuple[Column, Column]:
    """Word and place of a key's bit."""
    at = F.pmod(key, F.lit(BITS))
    return F.shiftright(at, 6).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")


def build(docs: DataFrame, capacity: int = CAPACITY, owned: int = OWNED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, sha) of each row of ``docs`` with a doc_id, and the index of keys that more than one row has (INDEX), in files of ordered keys."""
    small_batches(docs.sparkSession)
    norm = texts(docs).select("doc_id", F.regexp_replace("text", SPACES, " ").alias("text"))
    keyed = norm.select("doc_id", F.xxhash64("text").alias("key"), "text")
    keys = materialise(keyed.select("doc_id", "key", F.sha2("text", 256).alias("sha")), "keys")
    word, place = _bit(F.col("key"))
    repeated = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit"))
    taken = materialise(repeated.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n")), "taken")
    count = taken.agg(F.sum("n")).first()[0] or 0
    # at least an owner a task; where there are more, neighbours share one
    least = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = max((count // owned).bit_length(), (least - 1).bit_length())
    tasks = max(least, 1 << max(bits - 4, 0))
    sieve = F.broadcast(taken.select("word", "bits"))
    met = keyed.join(sieve, (word == F.col("word")) & (F.getbit("bits", place) == 1), "left_semi")
    sent = met.mapInArrow(_combine(), "key long, doc_id long, n long, text string")
    owner = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    task = F.floor(F.col("owner") * F.lit(tasks) / F.lit(1 << bits)).cast("int")
    dealt = sent.select(owner.alias("owner"), "key", "doc_id", "n", "text").repartitionById(tasks, task)
    in_order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    index = materialise(dealt.withColumn("place", in_order).sortWithinPartitions("owner", "place").drop("place").mapInArrow(_own(bits, capacity), INDEX), "index")
    discard(taken)
    return keys, index


def groups(docs: DataFrame, capacity: int = CAPACITY, owned: int = OWNED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, a row for each row of ``docs`` with a doc_id.

    Null text counts as empty, and all empty texts are one group. Rows that repeat a doc_id and text count in group_size and share a verdict.
    """
    keys, index = build(docs, capacity, owned)
    out = keys.join(index.where("group_size > 1").select("key", "sha", "keep_id", "group_size"), ["key", "sha"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (keep == F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)
"""
