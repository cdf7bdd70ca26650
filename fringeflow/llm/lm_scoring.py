"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary weight all segmentations of a text. Their
log-probabilities come from the training texts: each distinct training word is
cut by the existing tokenizer, and pieces are counted by how often the word
occurs. A word's probability is the sum over all its segmentations, by a
log-space forward recursion; a text's is the product over its words and an end.

Counts and lattice scores are made once per distinct word of the corpus. The
most frequent words, at most ``COMMON`` of them, go to all tasks; tokens of the
other words meet their counts by a join.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialise, small_batches, table, texts
from .words import LOWER, gather, mix, signed, words_of

COMMON, HELD_WORDS, SMOOTH = 1 << 16, 4_000_000, 0.5
SPACE = "▁"


def _count_words(batches):
    """(word, h, n_train, n_all) of a task, repeated only where more than ``HELD_WORDS`` words passed in between."""
    strings, hashes, train, every, held = [], [], [], [], 0

    def flush():
        h = np.concatenate(hashes)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n_train = np.bincount(inverse, np.concatenate(train), len(unique)).astype(np.int64)
        n_all = np.bincount(inverse, np.concatenate(every), len(unique)).astype(np.int64)
        names = pa.concat_arrays(strings).take(pa.array(first))
        out = pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(signed(unique)), pa.array(n_train), pa.array(n_all)], ["word", "h", "n_train", "n_all"])
        for x in (strings, hashes, train, every):
            x.clear()
        return out

    for batch in batches:
        words = words_of(batch.column(1))
        if len(words.starts):
            h, first, inverse, n = np.unique(words.hashes(table=LOWER), return_index=True, return_inverse=True, return_counts=True)
            taught = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), float)[words.row]
            strings.append(gather(words.data, words.starts[first], words.ends[first], LOWER))
            hashes.append(h)
            train.append(np.bincount(inverse, taught, len(h)))
            every.append(n.astype(float))
            held += len(words.starts)
        if held > HELD_WORDS:
            yield flush()
            held = 0
    if hashes:
        yield flush()


def _count_pieces(path: str):
    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(model.get_piece_size())
        for batch in batches:
            ids = model.encode(batch.column(0).to_pylist(), num_threads=1)
            weight = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            total += np.bincount(np.fromiter((i for x in ids for i in x), np.int64, len(weight)), weight, len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen].astype(np.int64))], ["piece", "n"])

    return run


class Lattice:
    """Forward recursion over the pieces of a vocabulary; ``scores`` are natural-log piece probabilities."""

    def __init__(self, path: str, scores: np.ndarray):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = ahocorasick.Automaton()
        self.byte = {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = float(scores[i])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces.add_word(name, (len(name), float(scores[i])))
        self.pieces.make_automaton()

    def word(self, word: str) -> float:
        """ln of the probability that a word is written, over all segmentations; characters outside the vocabulary are written in bytes."""
        text = SPACE + word
        none = -math.inf
        forward = [0.0] + [none] * len(text)
        known = 0  # places up to here can be reached
        for end, (length, score) in self.pieces.iter(text):
            known = self._bytes(text, forward, known, end + 1 - length)
            before = forward[end + 1 - length] + score
            now = forward[end + 1]
            if now == none:
                forward[end + 1] = before
            elif before > now:
                forward[end + 1] = before + math.log1p(math.exp(now - before))
            else:
                forward[end + 1] = now + math.log1p(math.exp(before - now))
            known = max(known, end + 1 if length == 1 else known)
        self._bytes(text, forward, known, len(text))
        return forward[-1]

    def _bytes(self, text: str, forward: list, known: int, upto: int) -> int:
        for i in range(known, upto):  # places that no piece reaches
            if forward[i + 1] == -math.inf:
                forward[i + 1] = forward[i] + sum(self.byte[b] for b in text[i].encode())
        return max(known, upto)


def _score_words(path: str, scores: np.ndarray):
    def run(batches):
        lattice = Lattice(path, scores)
        for batch in batches:
            lp = [lattice.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(lp, pa.float64())], ["h", "c", "n_all", "lp"])

    return run


ROWS = "k long, h long, tokens long, doc_id long, known long, base double, lat double"


def _score_docs(h: np.ndarray, c: np.ndarray, lp: np.ndarray, z: float, end: tuple[int, float, float]):
    """A row per document with what common words and the end give, and a row per other token (``tokens`` 0, sums to be joined)."""
    base = np.log10((c + 0.5) / z)

    def run(batches):
        part, row0 = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            words = words_of(batch.column(1))
            n = batch.num_rows
            key = part + row0 + np.arange(n)
            row0 += n
            x = words.hashes(table=LOWER)
            at = np.searchsorted(h, x)
            hit = at < len(h)
            hit[hit] = h[at[hit]] == x[hit]
            at, row = at[hit], words.row[hit]
            known = np.bincount(row, c[at] > 0, n).astype(np.int64) + end[0]
            sums = np.bincount(row, base[at], n) + end[1], np.bincount(row, lp[at], n) + end[2]
            rare = ~hit
            m = int(rare.sum())
            none = np.zeros(m, np.int64)
            out = [
                np.concatenate([key, key[words.row[rare]]]),
                signed(np.concatenate([mix(key.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)), x[rare]])),  # documents' own rows spread like words
                np.concatenate([words.count + 1, none]),
                np.concatenate([batch.column(0).to_numpy(zero_copy_only=False), none]),
                np.concatenate([known, none]),
                np.concatenate([sums[0], none.astype(float)]),
                np.concatenate([sums[1], none.astype(float)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in out], [f.split()[0] for f in ROWS.split(", ")])

    return run


def score(docs: DataFrame, path: str | None = None, folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row of ``docs`` with a doc_id.

    Rows with crc32(doc_id) mod ``folds`` = ``held`` are held out of all counts. Null and empty texts are one end token. Without training rows all counts
    are 0 and every text still has a score. Repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    d = texts(docs).select("doc_id", "text", (crc_mod(F.col("doc_id"), folds) != held).alias("train"))
    counted = d.mapInArrow(_count_words, "word string, h long, n_train long, n_all long")
    vocabulary = materialise(counted.groupBy("word", "h").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "vocabulary")
    trained = docs.where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id").cast("long"), folds) != held)).count()
    words, distinct = vocabulary.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.count_if(F.col("n_train") > 0), F.lit(0))).first()
    tokens, distinct = words + trained, distinct + (trained > 0)
    z = tokens + 0.5 * (distinct + 1)

    known = vocabulary.where("n_train > 0").select("word", "n_train")
    pieces = known.mapInArrow(_count_pieces(path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row a piece at most
    scores = _piece_scores(path, {r["piece"]: r["n"] for r in pieces}, trained)
    scored = materialise(vocabulary.select("word", "h", "n_train", "n_all").mapInArrow(_score_words(path, scores[0]), "h long, c long, n_all long, lp double"), "scored")

    least = common_from(scored)
    common = scored.where(F.col("n_all") >= least).select("h", "c", "lp").toPandas()  # at most COMMON rows
    h = common["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    c, lp = common["c"].to_numpy(np.int64)[order], common["lp"].to_numpy(float)[order]
    end = (int(trained > 0), math.log10((trained + 0.5) / z), scores[1])
    rows = d.select("doc_id", "text").mapInArrow(_score_docs(h[order], c, lp, z, end), ROWS)
    rest = scored.where(F.col("n_all") < least).select("h", "c", "lp")
    met = rows.join(rest, "h", "left")
    base = F.log10((F.col("c") + 0.5) / F.lit(z))
    out = met.groupBy("k").agg(
        F.max(F.when(F.col("tokens") > 0, F.col("doc_id"))).alias("doc_id"), F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, 1).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(base, F.lit(0.0))).alias("base_score"), F.sum(F.col("lat") + F.coalesce("lp", F.lit(0.0))).alias("lat"),
    )
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", (F.col("lat") / math.log(10)).alias("score")
    )


def _piece_scores(path: str, counts: dict[int, int], ends: int) -> tuple[np.ndarray, float]:
    """Natural-log probabilities of all pieces and of the end, smoothed by ``SMOOTH``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = np.full(model.get_piece_size(), SMOOTH)
    for piece, count in counts.items():
        n[piece] += count
    total = n.sum() + ends + SMOOTH
    return np.log(n / total), math.log((ends + SMOOTH) / total)


def common_from(words: DataFrame, most: int = COMMON, count: str = "n_all") -> int:
    """The least count of words so frequent that no more than ``most`` words are as frequent."""
    steps = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    sizes = sorted(words.groupBy(steps.alias("step")).agg(F.count("*").alias("n"), F.min(count).alias("least")).collect(), reverse=True)  # 16 rows an octave
    total, least = 0, 1 << 62
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return least


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
