"""Sum-of-squares online packing of tokenised documents.

Each task streams its documents. Whole windows are cut off the front of a long
document; what is left goes to the fill level that minimises the sum of squared
counts of partially filled windows, kept in an array with one count a level.
Windows still open at the end of a task (or when ``OPEN_TOKENS`` are held) go on
in a second pass of far fewer tasks, where their pieces are placed by the same
rule. Only what is open at the end of that is joined and cut anew: full windows
first, then powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table, texts
from .words import Memo, Words, words_of

WINDOW, END_ID, OPEN_TOKENS, SECOND_TOKENS, MEMO_WORDS = 2048, 1, 4 << 20, 16 << 20, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = f"{SCHEMA}, ids binary"

# words that the tokenizer's normaliser only lower-cases, and how its pre-tokenizer cuts them
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_BYTES = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_BYTES = str.maketrans({chr(b): _BYTES.get(b) or chr(256 + sum(x not in _BYTES for x in range(b))) for b in range(256)})


class WordEncoder:
    """Token ids of white-space words: no pre-token of this tokenizer spans white space, so a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.parts = self.tokenizer.model, {}
        self.memo = Memo(self.word, np.uint32, MEMO_WORDS)

    def word(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        parts, cut = self.parts, _CUT.findall(word.lower())
        if len(cut) == 1:
            return parts.get(cut[0]) or self._part(cut[0])
        out = []
        for part in cut:
            out += parts.get(part) or self._part(part)
        return out

    def _part(self, part: str) -> list[int]:
        if len(self.parts) > MEMO_WORDS:
            self.parts.clear()
        ids = self.parts[part] = [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES))]
        return ids

    def encode(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with ``end_id`` last, and the offset of each row."""
        memo = self.memo
        slot = memo.slots(words.data, words.starts, words.ends)
        lengths = memo.offsets[slot + 1] - memo.offsets[slot]
        total = np.concatenate([[0], np.cumsum(lengths)])
        rows = len(words.first) - 1
        row_start = total[words.first[:-1]] + np.arange(rows)
        offsets = np.append(row_start, total[-1] + rows).astype(np.int64)
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        each = np.arange(int(total[-1]))
        out[each + np.repeat(words.row, lengths)] = memo.flat[np.repeat(memo.offsets[slot] - total[:-1], lengths) + each]
        return out, offsets


class Levels:
    """Open windows by fill level, and the level array of the sum-of-squares rule."""

    def __init__(self, window: int):
        self.window, self.count = window, np.zeros(window + 1, np.int64)
        self.open: dict[int, list] = {}
        self.held = 0

    def choose(self, size: int) -> int:
        """The level (0: a new window) to put ``size`` at; a fuller window wins ties."""
        n, top = self.count, self.window - size
        # raising a window from level h to h + size: N(h) falls by one and N(h + size), if not full, rises by one
        cost = 2 * n[size : self.window + 1] + 1
        cost[top] = 0
        cost[1:] -= 2 * n[1 : top + 1] - 1
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, pieces: list, size: int):
        """Put pieces in a window; a filled window is returned."""
        level = self.choose(size)
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window += pieces
        if level + size == self.window:
            self.held -= level
            return window
        self.count[level + size] += 1
        self.held += size
        self.open.setdefault(level + size, []).append(window)
        return None

    def close(self) -> list:
        """All open windows, fullest first."""
        out = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.held = {}, 0
        self.count[:] = 0
        return out


class Rows:
    """Pieces of windows, gathered to batches; open windows carry their ids on."""

    def __init__(self, base: int):
        self.base, self.sequence, self.rows = base, 0, []

    def emit(self, pieces, still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), tokens, self.base + self.sequence, offset, raw if still_open else None))
            offset += len(ids)
        self.sequence += 1

    def flush(self):
        kinds = [pa.int64()] * 7 + [pa.binary()]
        columns = zip(*self.rows) if self.rows else [[]] * 8
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in OPEN.split(", ")])
        self.rows = []
        return out


def _pack(path: str, window: int, end_id: int):
    def run(batches):
        encoder, levels, rows = WordEncoder(path), Levels(window), Rows(TaskContext.get().partitionId() << 36)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            flat, offsets = encoder.encode(words_of(batch.column(1)), end_id)
            for i, doc_id in enumerate(doc_ids):
                ids = flat[offsets[i] : offsets[i + 1]]
                tokens, whole = len(ids), len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    rows.emit([(doc_id, start, ids[start : start + window], tokens)])
                if tokens > whole and (full := levels.place([(doc_id, whole, ids[whole:].copy(), tokens)], tokens - whole)):
                    rows.emit(full)
            if levels.held > OPEN_TOKENS:
                for pieces in levels.close():
                    rows.emit(pieces, True)
            yield rows.flush()
        for pieces in levels.close():
            rows.emit(pieces, True)
        yield rows.flush()

    return run


def _second(window: int):
    """The pieces of open windows, placed anew among more of them."""

    def run(batches):
        levels, rows = Levels(window), Rows((1 << 61) + (TaskContext.get().partitionId() << 36))
        for batch in batches:
            for doc_id, start, tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                if full := levels.place([(doc_id, start, np.frombuffer(ids, "<u4"), tokens)], len(ids) // 4):
                    rows.emit(full)
            yield rows.flush()
        left = [p for w in levels.close() for p in w]
        total, free, current = sum(len(p[2]) for p in left), 0, []
        for doc_id, start, ids, tokens in left:  # cut anew: full windows, then powers of two
            while len(ids):
                if not free:
                    free = window if total >= window else 1 << (total.bit_length() - 1)
                part = ids[:free]
                current.append((doc_id, start, part, tokens))
                start, ids, free, total = start + len(part), ids[len(part) :], free - len(part), total - len(part)
                if not free:
                    rows.emit(current)
                    current = []
        yield rows.flush()

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end id. Rows that repeat a doc_id are packed each for itself; rows without a doc_id are left out; an empty table gives no
    piece. A document is cut where it is longer than a window, and where the last windows of the second pass are cut anew. A task that holds more than
    ``OPEN_TOKENS`` hands its open windows to the second pass early, whose tasks get about ``SECOND_TOKENS`` each. Sequence ids are unique, not dense.
    """
    small_batches(docs.sparkSession)
    first = materialise(texts(docs).mapInArrow(_pack(path or public_tokenizers.path("word_bpe_49k.json"), window, end_id), OPEN), "packed")
    still = first.where("ids is not null")
    tasks = -(-(still.agg(F.sum("length").alias("n")).first()["n"] or 1) // SECOND_TOKENS)
    second = still.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(_second(window), OPEN)
    return first.where("ids is null").union(second).drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents, as ``pack`` gives them."""
    return pack(docs)
