"""Quality classifier on random-indexing word vectors.

Each word has a fixed sparse random index vector, derived from its 64-bit hash;
a word's vector sums the index vectors of its neighbours over all training texts.
A document is the mean and spread of its words' vectors. A two-layer network in
numpy maps that to a probability, with a temperature fitted on training rows that
the network did not see.

The vocabulary is a table keyed by word hash and has no bound. The ``COMMON`` most
frequent words at most go to every task; tokens of all others are joined to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialise, small_batches, table, texts
from .lm_scoring import common_from
from .words import LOWER, buffer_of, mix, run_hashes, signed

DIM, NONZERO, REACH, HIDDEN, TRAIN_ROWS, CHUNK = 32, 4, 2, 32, 16_000, 100_000
COMMON, HELD_WORDS, HELD_TOKENS = 1 << 18, 200_000, 1 << 28
CAPITALS = np.uint64(0x9E3779B97F4A7C15)  # the marker before a word in capitals

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[np.r_[65:91, 97:123, 128:256]] = 1
_CLASS[48:58] = 2
_UPPER, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _SMALL[97:123] = True, True


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of words' index vectors: one dimension in each of ``NONZERO`` equal blocks."""
    bits = mix(h ^ np.uint64(0x2545F4914F6CDD1D))[:, None] >> np.arange(0, 8 * NONZERO, 8, dtype=np.uint64)
    block = DIM // NONZERO
    where = (bits % np.uint64(block)).astype(np.int64) + block * np.arange(NONZERO)
    return where, np.where(bits & np.uint64(128), 1.0, -1.0)


def tokens_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and the row of each: runs of letters, of digits and of other marks, in small letters; a marker word precedes a word in capitals."""
    data, offsets = buffer_of(column)
    kind = _CLASS[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    edge[0] = True
    edge[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    upper, small = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_UPPER, _SMALL))
    shout = (upper[ends] - upper[starts] > 0) & (small[ends] == small[starts]) & (ends - starts > 1) & (kind[starts] == 1)
    at = np.repeat(np.arange(len(starts)), 1 + shout)
    h = mix(run_hashes(data, starts, ends, 3, LOWER))[at]
    h[:-1][at[:-1] == at[1:]] = CAPITALS
    return h, (np.searchsorted(offsets, starts, side="right") - 1)[at]


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums of parts (hashes, counts, sums) by hash."""
    h, n, sums = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h = h[order]
    cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return (h[cut], np.add.reduceat(n[order], cut), np.add.reduceat(sums[order], cut, axis=0, dtype=np.int32)) if len(cut) else (h, n, sums)


CONTEXTS = "h long, n long, sums binary"
KINDS = (np.int8, np.int16, np.int32)


def _packed(h: np.ndarray, n: np.ndarray, sums: np.ndarray):
    """Batches of (h, n, sums), sums as integers of the fewest bytes that hold a word's."""
    most = np.abs(sums).max(axis=1, initial=0)
    size = np.searchsorted([np.iinfo(kind).max for kind in KINDS], most)
    for i, kind in enumerate(KINDS):
        at = np.flatnonzero(size == i)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(n[at]), _fixed(sums[at].astype(kind))], ["h", "n", "sums"])


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of numbers."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _contexts(batches):
    """Words of a task, their counts and the sums of their neighbours' index vectors; a word again where over ``HELD_WORDS`` words or ``HELD_TOKENS`` tokens came before."""
    parts, held, passed = [], 0, 0
    for batch in batches:
        tokens, row = tokens_of(batch.column(0))
        if not len(tokens):
            continue
        h, word = np.unique(tokens, return_inverse=True)
        where, sign = index_vectors(h)
        total = np.zeros(len(h) * DIM)
        for reach in range(1, REACH + 1):
            near = row[:-reach] == row[reach:]
            a, b = word[:-reach][near], word[reach:][near]
            for x, y in ((a, b), (b, a)):
                for j in range(NONZERO):
                    total += np.bincount(x * DIM + where[y, j], sign[y, j], len(total))
        parts.append((h, np.bincount(word, minlength=len(h)), total.reshape(len(h), DIM).astype(np.int32)))
        held, passed = held + len(h), passed + len(tokens)
        if held > 2 * HELD_WORDS or passed > HELD_TOKENS:
            parts = [_merge(parts)]
            held = len(parts[0][0])
            if held > HELD_WORDS or passed > HELD_TOKENS:
                yield from _packed(*parts[0])
                parts, held, passed = [], 0, 0
    if parts:
        yield from _packed(*_merge(parts))


def _combine(batches):
    """(h, n, vec): counts and directions of words, 127 to the unit and a byte a dimension, from rows sorted by word; one word at a time is open."""

    def units(h, n, sums):
        v = np.round(127 * sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), _fixed(v)], ["h", "n", "vec"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, n = (batch.column(i).to_numpy() for i in (0, 1))
        size = pc.binary_length(batch.column(2)).to_numpy()
        sums = np.zeros((len(h), DIM))
        for kind in KINDS:
            at = size == DIM * np.dtype(kind).itemsize
            sums[at] = np.frombuffer(b"".join(batch.column(2).filter(pa.array(at)).to_pylist()), kind).reshape(-1, DIM)
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        words, n, sums = h[cut], np.add.reduceat(n, cut), np.add.reduceat(sums, cut, axis=0)
        if last is not None and last[0] == words[0]:
            n[0], sums[0] = n[0] + last[1], sums[0] + last[2]
        elif last is not None:
            yield units(np.array([last[0]]), np.array([last[1]]), last[2][None])
        last = words[-1], n[-1], sums[-1]
        if len(words) > 1:
            yield units(words[:-1], n[:-1], sums[:-1])
    if last is not None:
        yield units(np.array([last[0]]), np.array([last[1]]), last[2][None])


def word_vectors(train: DataFrame) -> DataFrame:
    """(h, n, vec): every word of every row of ``train``, with its count and direction.

    Repeated rows count as often as they are there; null and empty texts have no words; no rows give no vectors. Sums are of integers, so neither their order nor
    how rows are dealt shows. Other columns are not looked at.
    """
    return materialise(train.select("text").mapInArrow(_contexts, CONTEXTS).repartition("h").sortWithinPartitions("h").mapInArrow(_combine, "h long, n long, vec binary"), "vectors")


def _weight(n, total: int):
    return (1 + np.log1p(total / np.maximum(n, 1))) / 1270


ROWS = "k long, h long, c long, doc_id long, sums binary"


def _split(h: np.ndarray, vec: np.ndarray, weight: np.ndarray):
    """A row per document with its tokens ``c`` and the sums and squares of its common words, and a row per other word of it (``sums`` null)."""

    def run(batches):
        part, row0 = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            tokens, row = tokens_of(batch.column(1))
            rows = batch.num_rows
            k = part + row0 + np.arange(rows)
            row0 += rows
            at = np.minimum(np.searchsorted(h, tokens), max(len(h) - 1, 0))
            hit = h[at] == tokens if len(h) else np.zeros(len(tokens), bool)
            sums = np.zeros((rows, 2 * DIM))
            at, r_hit = at[hit], row[hit]
            for i in range(0, len(at), CHUNK):
                some, r = at[i : i + CHUNK], r_hit[i : i + CHUNK]
                v = vec[some] * weight[some, None]
                cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                sums[r[cut], :DIM] += np.add.reduceat(v, cut, axis=0, dtype=np.float64)
                sums[r[cut], DIM:] += np.add.reduceat(v * v, cut, axis=0, dtype=np.float64)
            rare, r_rare = tokens[~hit], row[~hit]
            order = np.lexsort((rare, r_rare))
            rare, r_rare = rare[order], r_rare[order]
            cut = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (r_rare[1:] != r_rare[:-1]))) if len(rare) else np.zeros(0, np.int64)
            c = np.diff(np.append(cut, len(rare)))
            none = pa.nulls(len(cut))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([k, k[r_rare[cut]]])), pa.array(signed(np.concatenate([mix(k.astype(np.uint64)), rare[cut]]))),  # documents' own rows spread like words
                pa.array(np.concatenate([np.bincount(row, minlength=rows), c])), pa.concat_arrays([batch.column(0), none.cast(pa.int64())]), pa.concat_arrays([_fixed(sums.astype(np.float32)), none.cast(pa.binary())]),
            ], [f.split()[0] for f in ROWS.split(", ")])

    return run


def _pool(total: int):
    """(doc_id, vec): means and deviations of documents' word vectors, from rows sorted by document; one document at a time is open."""

    def features(doc_id, n, sums):
        mean, square = sums[:, :DIM] / np.maximum(n, 1)[:, None], sums[:, DIM:] / np.maximum(n, 1)[:, None]
        pooled = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]).astype(np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, pooled.size + 1, 2 * DIM, dtype=np.int32)), pa.array(pooled.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(doc_id), flat], ["doc_id", "vec"])

    def run(batches):
        last = None  # key, doc_id, tokens and sums of the document that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            k, c, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 5))
            own = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            met = batch.column(4).is_valid().to_numpy(zero_copy_only=False) & ~own
            m = np.zeros((len(k), 2 * DIM))
            m[own] = np.frombuffer(b"".join(batch.column(3).drop_null().to_pylist()), np.float32).reshape(-1, 2 * DIM)
            word = np.frombuffer(b"".join(batch.column(4).filter(pa.array(met)).to_pylist()), np.int8).reshape(-1, DIM)
            v = word * _weight(count[met].astype(float), total)[:, None]
            m[met] = np.hstack([v, v * v]) * c[met, None]
            cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sums, n = np.add.reduceat(m, cut, axis=0), np.add.reduceat(np.where(own, c, 0), cut)
            ids = np.maximum.reduceat(np.where(own, batch.column(2).fill_null(0).to_numpy(), np.iinfo(np.int64).min), cut)
            if last is not None and last[0] == k[0]:
                sums[0], n[0], ids[0] = sums[0] + last[3], n[0] + last[2], max(ids[0], last[1])
            elif last is not None:
                yield features(np.array([last[1]]), np.array([last[2]]), last[3][None])
            last = k[-1], ids[-1], n[-1], sums[-1]
            if len(cut) > 1:
                yield features(ids[:-1], n[:-1], sums[:-1])
        if last is not None:
            yield features(np.array([last[1]]), np.array([last[2]]), last[3][None])

    return run


def pooled_vectors(docs: DataFrame, vectors: DataFrame, most: int = COMMON) -> DataFrame:
    """(doc_id, vec), a row for each row of ``docs`` (doc_id, text); words without a vector count as zero, and so do null and empty texts as a whole.

    Repeated rows each have their own row, alike; an empty table gives none; a text of any length counts whole.
    """
    least = common_from(vectors, most, "n")
    total = vectors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = vectors.where(F.col("n") >= least).toPandas().sort_values("h")  # at most ``most`` rows
    h = common["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    vec = np.frombuffer(b"".join(common["vec"]), np.int8).reshape(-1, DIM)[order]
    weight = _weight(common["n"].to_numpy(float)[order], total).astype(np.float32)
    columns = "k", "c", "doc_id", "sums", "vec", F.coalesce("n", F.lit(0)).alias("n")
    return materialise(
        docs.mapInArrow(_split(h[order], vec, weight), ROWS).join(vectors.where(F.col("n") < least), "h", "left")
        .repartition("k").sortWithinPartitions("k", "h").select(*columns).mapInArrow(_pool(total), "doc_id long, vec array<float>"),
        "pooled",
    )


class Network:
    """Inputs standardised, tanh layer, logistic output, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 80, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.ready = len(y) >= 20 and 0 < y.mean() < 1
        if not self.ready:
            return
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.std
        order = rng.permutation(len(x))
        fit, held = order[len(x) // 5 :], order[: len(x) // 5]
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(max(epochs, 40_000 // max(len(fit), 1))):
            rng.shuffle(fit)
            for i in range(0, len(fit), 128):
                a, t = x[fit[i : i + 128]], y[fit[i : i + 128]]
                hidden = np.tanh(a @ p[0] + p[1])
                err = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - t) / len(t)
                back = np.outer(err, p[2]) * (1 - hidden * hidden)
                step += 1
                for k, g in enumerate((a.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ err + 1e-4 * p[2], err.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z, t = self.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, standard: np.ndarray) -> np.ndarray:
        return np.tanh(standard @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.std) / self.temperature, -30, 30)))


def _apply(network: Network):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 2 * DIM))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network(x))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of ``docs`` with a doc_id.

    Word vectors are summed over all rows outside the held-out fold, for every word there; a word not seen there has the zero vector. The network is fitted on at most about ``train_rows`` of the labelled ones, taken by
    a hash of doc_id. Null labels do not count; with under 20 labels or one class the score is the share of label 1 (0.5 without labels). Null and empty
    texts have the zero vector; repeated rows count, and are scored, as often as they occur; other columns are not read.
    """
    small_batches(docs.sparkSession)
    d = texts(docs)
    vectors = word_vectors(d.where(crc_mod(F.col("doc_id"), folds) != held))
    pooled = pooled_vectors(d, vectors)
    discard(vectors)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id").cast("long"), folds) != held))
    share = min(1.0, train_rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = pooled.join(sample, "doc_id").select("doc_id", "vec", "quality").toPandas().sort_values(["doc_id", "quality"])
    network = Network(np.stack(got["vec"]).astype(float) if len(got) else np.zeros((0, 2 * DIM)), got["quality"].to_numpy(float))
    out = pooled.mapInArrow(_apply(network), "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
