"""Token counts of sections by offset mapping.

A document is encoded once, whole. Byte-level tokens cover the text without gaps,
so running sums of token lengths are the tokens' spans. Tokens are then joined to
section spans by interval search. A token that crosses a section boundary goes,
whole, to the section it overlaps most, the earlier one on ties; under rule
"first" it goes to the section of its first byte, and under "split" each section
gets the share of the token's bytes that it holds.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, texts
from .words import buffer_of

RULES = ("most", "first", "split")
SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>"


def load(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        length[rank] = len(piece)
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def attribute(spans: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and the number of tokens that cross a boundary.

    spans: token boundaries in bytes, 0 first; bounds: section boundaries, 0 first and the text's length last; sections are not empty.
    """
    sections = len(bounds) - 1
    starts, ends = spans[:-1], spans[1:]
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    crossing = np.flatnonzero(last > first)
    out = np.bincount(first, minlength=sections).astype(float)
    if rule != "first":
        for t in crossing:  # few: only tokens that hold a boundary
            cut = np.concatenate([[starts[t]], bounds[first[t] + 1 : last[t] + 1], [ends[t]]])
            share = np.diff(cut)
            out[first[t]] -= 1
            if rule == "most":
                out[first[t] + int(np.argmax(share))] += 1
            else:
                out[first[t] : last[t] + 1] += share / share.sum()
    return out, len(crossing)


def line_bounds(text: np.ndarray) -> np.ndarray:
    """Sections are lines, each with the line feed that ends it."""
    cut = np.flatnonzero(text == 10) + 1
    return np.unique(np.concatenate([[0], cut, [len(text)]]))


def _count(path: str, rule: str, marks: bool):
    def run(batches):
        encoding, length = load(path)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            raw, given = data.tobytes(), batch.column(2).to_pylist() if marks else None
            tokens, sections, crossing, counts = [], [], [], []
            for i in range(len(offsets) - 1):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                text = raw[lo:hi].decode()
                spans = np.concatenate([[0], np.cumsum(length[encoding.encode_to_numpy(text, disallowed_special=())])]) if hi > lo else np.zeros(1, np.int64)
                if marks and given[i] is not None:  # starts in characters
                    size = np.cumsum(np.concatenate([[0], (data[lo:hi] & 0xC0) != 0x80])) if hi > lo else np.zeros(1, np.int64)
                    at = np.searchsorted(size, np.array([x for x in given[i] if x is not None], np.int64), side="right") - 1
                    at = np.where(np.array([x for x in given[i] if x is not None], np.int64) >= size[-1], hi - lo, np.maximum(at, 0))
                    bounds = np.unique(np.concatenate([[0], at, [hi - lo]]))
                else:
                    bounds = line_bounds(data[lo:hi])
                each, across = attribute(spans, bounds, rule) if hi > lo else (np.zeros(0), 0)
                tokens.append(len(spans) - 1)
                sections.append(len(each))
                crossing.append(across)
                counts.append(each)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sections)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *counts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (tokens, sections, crossing)), lists], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return run


def counts(docs: DataFrame, path: str | None = None, rule: str = "most", starts: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens (sums to n_tokens), a row per document.

    Sections are lines, or start at the character offsets in the array column ``starts``; offset 0 is always one, ties and offsets past the end make no
    section. Null and empty texts have no token and no section. Rows without a doc_id are left out.

    Repeated rows are each counted, alike; other columns are not looked at, whatever their names; an empty table gives no rows. A token that overlaps two sections
    by as much goes to the first of them. A text of any length is encoded once, whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    return texts(docs, *([starts] if starts else [])).mapInArrow(_count(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), rule, bool(starts)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
