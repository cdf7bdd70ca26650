"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model.

Encoding is by backtracking: an Aho-Corasick automaton over the vocabulary gives
the pieces that start at each place; the longest one that is compatible with the
piece before it is taken, and a place from which no piece fits is marked in a
bitfield and never tried again. Two pieces are compatible if merging their text
anew gives just these two.

No piece of such a model holds a space mark after another character, or a line
feed, so a text falls into units (a run of spaces with what follows; a line
feed) that encode on their own; each distinct unit of a task is encoded once.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, texts
from .words import Memo, buffer_of

SPACE, MEMO_UNITS = "▁", 1 << 20


class Pieces:
    """Vocabulary, merge order, encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.end = model.eos_id()
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: model.get_score(i) for i in plain}
        if len(self.byte) != 256 or any("\n" in p or " " in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: not a BPE model with byte fallback whose pieces keep within words")
        self.names, self.automaton, self.pairs, self.own = names, ahocorasick.Automaton(), {}, {}
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        raw = [b"" if model.is_control(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.raw, self.raw_length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def merge(self, text: str) -> list[str]:
        """The model's own rule on a short text: join the best-scored adjacent pair, the leftmost on ties, while any joins to a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1 << 19:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def stable(self, piece: str) -> bool:
        """Whether the piece is what its own text merges to."""
        known = self.own.get(piece)
        if known is None:
            known = self.own[piece] = self.merge(piece) == [piece]
        return known

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a unit; ``unit`` has space marks for spaces."""
        n = len(unit)
        if unit in self.ids and self.stable(unit):
            return [self.ids[unit]]
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(unit):
            starts[end + 1 - len(piece)].append(piece)  # shorter ones come first
        for i, c in enumerate(unit):
            if c not in self.ids:
                starts[i].insert(0, c)  # outside the vocabulary: bytes, once placed
        failed = bytearray(n + 1)
        path, choice, place = [], [len(starts[0]) - 1], 0
        while place < n:
            options, k, last = starts[place], choice[-1], path[-1] if path else None
            while k >= 0:
                piece = options[k]
                if not failed[place + len(piece)] and (len(piece) == 1 or self.stable(piece)) and (last is None or self.compatible(last, piece)):
                    break
                k -= 1
            if k < 0:  # nothing fits here: never come back, and shorten the piece before
                failed[place] = 1
                choice.pop()
                place -= len(path.pop())
                choice[-1] -= 1
                continue
            choice[-1] = k
            path.append(piece)
            place += len(piece)
            if place < n:
                choice.append(len(starts[place]) - 1)
        ids, out = self.ids, []
        for piece in path:
            i = ids.get(piece)
            if i is None:
                out += [self.byte[b] for b in piece.encode()]
            else:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, with the end id last."""
        flat, offsets = Encoder(self).encode(pa.array([text]))
        return flat[offsets[0] : offsets[1]].tolist()

    def decode_all(self, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 texts of rows of ids: bytes joined, the leading space mark of a text left out, broken UTF-8 replaced."""
        lengths = self.raw_length[flat]
        total = np.concatenate([[0], np.cumsum(lengths)])
        data = self.raw[np.repeat(self.raw_start[flat] - total[:-1], lengths) + np.arange(int(total[-1]))].tobytes()
        out = []
        for i in range(len(offsets) - 1):
            lo, hi = total[offsets[i]], total[offsets[i + 1]]
            first = offsets[i] < offsets[i + 1] and self.names[flat[offsets[i]]].startswith(SPACE)
            out.append(data[lo + bool(first) : hi].decode("utf-8", "replace").encode())
        return out


class Encoder:
    """Encodes columns of texts; distinct units are remembered up to ``MEMO_UNITS``."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memo = Memo(lambda unit: pieces.encode_unit(unit.replace(" ", SPACE)), np.int32, MEMO_UNITS)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id last, and the offset of each row."""
        data, bounds = buffer_of(column)
        # U+2581 in a text is a space to the model; each text that is not empty gets a space in front
        if SPACE.encode() in data.tobytes():
            return self.encode(pa.array([(x or "").replace(SPACE, " ") for x in column.to_pylist()], pa.large_utf8()))
        rows = len(bounds) - 1
        filled = np.diff(bounds) > 0
        shift = np.cumsum(filled)
        padded = np.full(len(data) + int(filled.sum()), 32, np.uint8)
        padded[np.arange(len(data)) + np.repeat(shift, np.diff(bounds))] = data
        bounds = bounds + np.concatenate([[0], shift])
        n = len(padded)
        opens = np.zeros(n, bool)
        if n:
            space, feed = padded == 32, padded == 10
            opens[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
            opens[bounds[:-1][filled]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], n)[: len(starts)]
        memo = self.memo
        slot = memo.slots(padded, starts, ends)
        lengths = memo.offsets[slot + 1] - memo.offsets[slot]
        total = np.concatenate([[0], np.cumsum(lengths)])
        row = np.searchsorted(bounds, starts, side="right") - 1
        offsets = total[np.searchsorted(starts, bounds)] + np.arange(rows + 1)
        out = np.full(int(offsets[-1]), self.pieces.end, np.int32)
        each = np.arange(int(total[-1]))
        out[each + np.repeat(row, lengths)] = memo.flat[np.repeat(memo.offsets[slot] - total[:-1], lengths) + each]
        return out, offsets


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _digests(path: str):
    def run(batches):
        pieces = load(path)
        encoder = Encoder(pieces)
        decimal = np.array([str(i) for i in range(len(pieces.names))], object)
        for batch in batches:
            flat, offsets = encoder.encode(batch.column(1))
            words, ids_sha = decimal[flat], []
            for i in range(len(offsets) - 1):
                ids_sha.append(hashlib.sha256(" ".join(words[offsets[i] : offsets[i + 1]]).encode()).hexdigest())
            decoded = [hashlib.sha256(x).hexdigest() for x in pieces.decode_all(flat, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(ids_sha), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        pieces = load(path)
        encoder = Encoder(pieces)
        for batch in batches:
            flat, offsets = encoder.encode(batch.column(1))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([x.decode() for x in pieces.decode_all(flat, offsets)])], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> (end id last), decoded string, of every whole text; null counts as empty, which is the end id alone. Rows without a doc_id are left out.

    Repeated rows are each encoded, alike; of merges with the same score the leftmost is taken, as the library does; other columns are not looked at, whatever their
    names; an empty table gives no rows. A text of any length is encoded whole, unit by unit.
    """
    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(_ids(path or public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return texts(table(spark, sf_dir, "documents")).mapInArrow(_digests(public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
