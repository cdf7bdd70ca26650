"""Substring dedup with repeated-phrase automata.

A window is 20 consecutive words. Its anchor is the six-word run in it with the
smallest hash, so equal windows have equal anchors, and neighbouring windows
mostly share one. Anchors that occur once hold no repeated window. For the
others, the words around each occurrence (a segment) go to a shard by anchor.
There, passages are confirmed (runs of windows that always recur together), an
Aho-Corasick automaton is compiled from them, and all segments of the shard
stream through it; every occurrence but the first of each passage is covered.

Segments of an anchor that occurs more than ``HOT`` times meet by content: of
equal segments all but the first are covered, and the first ones are cut anew
by a finer anchor, the ``2``, ``4``, ``8`` or all six-word runs of a window with
the smallest hashes, until no anchor is so frequent. A window thus moves once a
step and meets only windows that may equal it.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches, spare, table, texts
from .words import gather, mix, signed, window_hashes, words_of

WINDOW, ANCHOR, HOT, SHARD_ROWS = 20, 6, 3000, 8000
FINER = (2, 4, 8, WINDOW - ANCHOR + 1)
ALL = (1 << 31) - 1


def anchors(words) -> tuple[np.ndarray, ...]:
    """Anchor hash, row, first and last window start (word numbers in the row) of each run of windows with one anchor."""
    grams = window_hashes(words.hashes(), ANCHOR)
    width = WINDOW - ANCHOR + 1
    n = len(words.starts) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return grams[:0], none, none, none
    start = np.flatnonzero(words.row[:n] == words.row[WINDOW - 1 :])
    at = np.empty(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    for i in range(0, n, 1 << 18):
        at[i : i + (1 << 18)] = view[i : min(n, i + (1 << 18))].argmin(axis=1)
    place = start + at[start]
    if not len(start):
        return grams[:0], none, none, none
    row = words.row[start]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    last = np.append(new[1:], len(start)) - 1
    own = words.first[row[new]]
    return grams[place[new]], row[new], start[new] - own, start[last] - own


def _prints(batches):
    for batch in batches:
        words = words_of(batch.column(1))
        h = words.hashes()
        marks = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.first[:-1], words.first[1:])]
        marks = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words.count), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())], ["doc_id", "th", "n_words", "s1", "s2"])


def _anchor_places(batches):
    """(h, v): v tells apart places in texts that differ, or in one text; copies of a text give the same."""
    for batch in batches:
        words = words_of(batch.column(0))
        hashes = words.hashes()
        text = np.array([int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(words.first[:-1], words.first[1:])], np.uint64)
        h, row, lo, _ = anchors(words)
        v = mix(text[row] + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(h) else h
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(v))], ["h", "v"])


def _anchor_rows(batches):
    for batch in batches:
        h, row, lo, hi = anchors(words_of(batch.column(1)))
        ids, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(ids[row]), pa.array(th[row]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["h", "doc_id", "th", "lo", "hi"])


SEGMENT = "h long, hot boolean, doc_id long, th long, lo int, n int, words string"
GONE = "doc_id long, th long, lo int, hi int"


def _spaced(words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space before, between and after them, and the place of the space before each word (and of the last space)."""
    lengths = words.ends - words.starts
    before = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(before[-1]) + 1, 32, np.uint8)
    each = np.arange(int(lengths.sum()), dtype=np.int64)
    each += np.repeat(words.starts - (np.cumsum(lengths) - lengths), lengths)
    out[each + np.repeat(before[:-1] + 1 - words.starts, lengths)] = words.data[each]
    return out, before


def _batch(schema: str, *columns):
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    arrow = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(arrow[k]) for c, k in zip(columns, kinds)], list(names))


def _segments(batches):
    """Words around each repeated anchor, with one space before, between and after them."""
    for batch in batches:
        words = words_of(batch.column("text"))
        spaced, before = _spaced(words)
        runs = batch.column("runs")
        counts, runs = np.diff(runs.offsets.to_numpy()), runs.flatten()
        of = lambda name: runs.field(name).to_numpy(zero_copy_only=False)
        lo, hi, row = of("lo").astype(np.int64), of("hi").astype(np.int64), np.repeat(np.arange(len(counts)), counts)
        for k in range(0, len(lo), 1 << 16):
            c = slice(k, k + (1 << 16))
            base = words.first[row[c]]
            text = gather(spaced, before[base + lo[c]], before[base + hi[c] + WINDOW] + 1)
            own = [batch.column(name).to_numpy()[row[c]] for name in ("doc_id", "th")]
            yield _batch(SEGMENT, of("h")[c], of("hot")[c], *own, lo[c], hi[c] - lo[c] + 1, text)


def _windows(words) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of all windows of segments."""
    n = len(words.starts) - WINDOW + 1
    start = np.flatnonzero(words.row[: max(n, 0)] == words.row[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
    return start, words.row[start]


class Automaton:
    """All occurrences of phrases (with a space at each end) in segments, as word numbers."""

    def __init__(self, phrases):
        self.found = ahocorasick.Automaton()
        for k, phrase in enumerate(phrases):
            self.found.add_word(phrase, (k, len(phrase)))
        self.found.make_automaton()

    def places(self, segment: str):
        for end, (k, length) in self.found.iter(segment):
            yield k, segment.count(" ", 0, end + 1 - length)


def passages(words) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Phrases that recur among segments, how many windows each holds, and the rows where one may occur.

    Windows that occur more than once are confirmed; two neighbours are of one phrase if neither ever occurs without the other beside it.
    """
    start, row = _windows(words)
    if not len(start):
        return [], start, row
    hashes = window_hashes(words.hashes(), WINDOW)[start]
    _, first, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    n = count[which]
    beside = np.flatnonzero((start[1:] == start[:-1] + 1) & (row[1:] == row[:-1]) & (n[1:] == n[:-1]) & (n[1:] > 1))
    _, pair, pairs = np.unique(mix(hashes[beside] * np.uint64(0x9E3779B97F4A7C15) + hashes[beside + 1]), return_inverse=True, return_counts=True)
    joined = np.zeros(len(start) + 1, bool)  # a window that goes on with the one before
    joined[beside[pairs[pair] == n[beside]] + 1] = True
    head = np.zeros(len(start), bool)
    head[first] = True  # the first place of each window
    opens = np.flatnonzero(head & (n > 1) & ~joined[:-1])
    ends = np.flatnonzero(~joined[1:])  # last windows of runs
    length = ends[np.searchsorted(ends, opens)] - opens + 1
    spaced, before = _spaced(words)
    a = start[opens]
    return gather(spaced, before[a], before[a + length - 1 + WINDOW] + 1).to_pylist(), length, np.unique(row[n > 1])


def _shard(batches):
    """Rows in the order of (h, doc_id, lo, th): compile the phrases of some anchors, then stream their segments."""

    def search(rows):
        column = pa.concat_arrays([r.column("words") for r in rows])
        phrases, length, where = passages(words_of(column))
        ids, ths, los = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("doc_id", "th", "lo"))
        if not phrases:
            return _batch(GONE, *[np.zeros(0, np.int64)] * 4)
        automaton, first, length, out = Automaton(phrases), {}, length.tolist(), []
        for doc_id, th, lo, words in zip(ids[where].tolist(), ths[where].tolist(), los[where].tolist(), column.take(pa.array(where)).to_pylist()):
            a, b = -2, -2
            for start, end in sorted((lo + at, lo + at + length[k] - 1) for k, at in automaton.places(words) if first.setdefault(k, (doc_id, lo + at, th)) != (doc_id, lo + at, th)):
                if start <= b + 1:
                    b = max(b, end)
                    continue
                if b >= 0:
                    out.append((doc_id, th, a, b))
                a, b = start, end
            if b >= 0:
                out.append((doc_id, th, a, b))
        return _batch(GONE, *(np.array(out, np.int64).reshape(-1, 4).T))

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < SHARD_ROWS:
            continue
        h = np.concatenate([r.column("h").to_numpy() for r in held])
        cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
        table = pa.Table.from_batches(held).combine_chunks()
        if cut:
            yield search(table.slice(0, cut).to_batches())
            table = table.slice(cut)
        held, count = table.to_batches(), table.num_rows
    if held:
        yield search(held)


def _finer(grams: int):
    """Segments cut at the windows whose ``grams`` smallest six-word runs differ, keyed by these."""

    def run(batches):
        for batch in batches:
            words = words_of(batch.column("words"))
            start, row = _windows(words)
            if not len(start):
                continue
            view = np.lib.stride_tricks.sliding_window_view(window_hashes(words.hashes(), ANCHOR), WINDOW - ANCHOR + 1)
            key = mix(batch.column("h").to_numpy().view(np.uint64)[row])
            for g in np.sort(view[start], axis=1)[:, :grams].T:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + g)
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
            a, length, row = start[new], np.diff(np.append(new, len(start))), row[new]
            spaced, before = _spaced(words)
            text = gather(spaced, before[a], before[a + length - 1 + WINDOW] + 1)
            own = [batch.column(name).to_numpy()[row] for name in ("doc_id", "th", "lo")]
            yield _batch(SEGMENT, signed(key[new]), np.ones(len(a), bool), own[0], own[1], own[2] + a - words.first[row], length, text)

    return run


def _hot(hot: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The segments of very frequent anchors: those left to search, keyed by finer anchors, and the ranges (doc_id, th, lo, hi) that equal segments cover."""
    cold, gone = None, []
    for grams in (*FINER, 0):
        same = hot.withColumn("mark", F.xxhash64("words"))
        first = same.groupBy("h", "mark").agg(F.min(F.struct("doc_id", "lo", "th", "n", "words")).alias("first"))
        first = materialise(first.select("h", "first"), "first")
        # all segments but the first of each kind, by aggregation: a frequent kind has many rows to a key
        each = hot.select("doc_id", "th", "lo", "n", F.lit(False).alias("is_first")).union(first.select("first.doc_id", "first.th", "first.lo", "first.n", F.lit(True)))
        later = each.groupBy("doc_id", "th", "lo", "n").agg(F.max("is_first").alias("is_first")).where("not is_first")
        gone.append(materialise(later.select("doc_id", "th", "lo", (F.col("lo") + F.col("n") - 1).cast("int").alias("hi")), "later"))
        if not grams:
            return cold, gone
        cut = first.select("h", F.lit(True).alias("hot"), "first.doc_id", "first.th", "first.lo", "first.n", "first.words").mapInArrow(_finer(grams), SEGMENT)
        finer = materialise(cut, "finer")
        counts = finer.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
        cut = finer.join(counts, "h").select("h", (F.col("c") > HOT).alias("hot"), "doc_id", "th", "lo", "n", "words")
        cut = materialise(cut, "cut")
        discard(first, finer)
        more = cut.where("not hot")
        cold = more if cold is None else cold.union(more)
        hot = cut.where("hot")
        if not hot.limit(1).count():
            return cold, gone


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): per document with repeated windows, ranges lo..hi of covered window starts; th is xxhash64 of the text."""
    small_batches(docs.sparkSession)
    d = texts(docs).withColumn("th", F.xxhash64("text"))
    prints = materialise(d.mapInArrow(_prints, "doc_id long, th long, n_words long, s1 long, s2 long").where(F.col("n_words") >= WINDOW), "prints")
    # later copies of a whole text are covered from end to end; they need no search
    first = prints.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("s1", "s2", "first")
    copies = materialise(prints.join(first, ["s1", "s2"]).where("doc_id > first").select("doc_id", "th").distinct(), "copies")

    repeated = d.select("text").mapInArrow(_anchor_places, "h long, v long").groupBy("h").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"))
    repeated = materialise(repeated.where("a <> b").select("h", (F.col("n") > HOT).alias("hot")), "repeated")
    rows = d.select("doc_id", "text", "th").mapInArrow(_anchor_rows, "h long, doc_id long, th long, lo int, hi int").join(repeated, "h")
    runs = rows.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "hot", "lo", "hi")).alias("runs"))
    runs = materialise(runs.join(copies, ["doc_id", "th"], "left_anti"), "runs")
    held = d.join(runs, ["doc_id", "th"]).select("doc_id", "th", "text", "runs").mapInArrow(_segments, SEGMENT)
    segments = materialise(held, "segments")

    cold, gone = segments.where("not hot"), [copies.select("doc_id", "th", F.lit(0).alias("lo"), F.lit(ALL).alias("hi"))]
    hot = segments.where("hot")
    if hot.limit(1).count():
        more, ranges = _hot(hot)
        cold, gone = cold.union(more), gone + ranges
    cold = cold.select("h", "doc_id", "th", "lo", "words").repartition("h").sortWithinPartitions("h", "doc_id", "lo", "th")
    found = cold.mapInArrow(_shard, GONE)
    for ranges in gone:
        found = found.union(ranges)
    out = materialise(found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")), "gone")
    discard(prints, copies, repeated, runs, segments)
    return out


RESULT = "n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    column = pa.array(text, pa.string())
    words = words_of(column)
    data = words.data.tobytes()
    rows = []
    for i, (t, ranges) in enumerate(zip(text, gone)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        n = b - a
        hide = np.zeros(n + 1, np.int64)
        for r in ranges if ranges is not None and n >= WINDOW else ():
            hide[min(r["lo"], n)] += 1
            hide[min(r["hi"] + WINDOW, n)] -= 1
        hidden = np.cumsum(hide[:n]) > 0
        starts, ends = words.starts[a:b], words.ends[a:b]
        keep = np.flatnonzero(~hidden)
        joined = b" ".join([data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
        kept = t
        if len(keep) < n:  # each run of kept words keeps its own white space
            cuts = np.flatnonzero(np.append(True, np.diff(keep) > 1)) if len(keep) else []
            spans = [(int(starts[keep[c]]), int(ends[keep[(cuts[k + 1] if k + 1 < len(cuts) else len(keep)) - 1]])) for k, c in enumerate(cuts)]
            kept = "\n".join(data[s:e].decode() for s, e in spans)
        rows.append((n, n - len(keep), hashlib.sha256(joined).hexdigest(), kept))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])


def strip(docs: DataFrame, cut: str = "cut") -> DataFrame:
    """All of docs' columns and a column named ``cut``: n_words, n_removed, kept_sha256 (kept words joined by one space) and kept, the text without repeated windows.

    Words are runs outside white space, unchanged; runs of kept words on both sides of a cut are joined by a line feed, and a text without a cut stays as
    it is (null: as empty). Texts under 20 words have no window. Rows that repeat a doc_id and text are treated alike, as one document; those with another text are ordered by its hash; rows without a doc_id are left out. Other columns pass as they are, whatever their names.
    """
    doc, th, at = spare(docs, "_doc"), spare(docs, "_th"), spare(docs, "_gone")
    gone = covered(docs).select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("gone").alias(at))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.where(F.col("doc_id").isNotNull()).join(gone, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(th)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.pandas_udf(_cut, RESULT)(text, F.col(at)).alias(cut))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "cut").select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that repeat; those of which no word is left go. n_chars follows the text.

    Texts without words stay, null texts stay null; rows without a doc_id go, repeated rows are treated alike, other columns pass unchanged.
    """
    cut = spare(docs, "cut")
    out = strip(docs, cut).where((F.col(f"{cut}.n_removed") == 0) | (F.col(f"{cut}.n_removed") < F.col(f"{cut}.n_words")))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.when(F.col(f"{cut}.n_removed") > 0, F.col(f"{cut}.kept")).otherwise(F.col("text"))}
    out = out.select(*[v.alias(c) for c, v in columns.items()])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
