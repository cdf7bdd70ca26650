"""Fill-in-middle: texts cut at two token starts and put in another order behind markers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import OUT, Scan, compose
from .common import materialise, small_batches, table, texts

#: Bytes of a chunk. A text of one chunk is cut where it is; the chunks of a longer one are dealt to tasks, at most 2^31 / CHUNK a text.
CHUNK = 1 << 16
#: Bytes of texts scanned at once.
_TOGETHER = 1 << 22
_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_HASHES = [f"h{i}" for i in range(1, 5)]


def _hashes() -> list[Column]:
    """The first four 8-digit groups of sha256 of ``1:doc_id``, as numbers."""
    digits = F.sha2(F.concat(F.lit("1:"), F.col("doc_id").cast("string")), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(_HASHES)]


def cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before the middle and before the suffix."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def forms(n: np.ndarray, marks: np.ndarray, h3: np.ndarray, h4: np.ndarray) -> np.ndarray:
    return np.where((n == 0) | (marks > 0) | (h3 % 100 >= 90), "plain", np.where(h4 % 100 < 20, "spm", "psm"))


def arrange(text: bytes, form: str, a: int, b: int) -> tuple[int | None, int | None, str]:
    """Code points of prefix and middle, and the output, of a text cut at bytes a and b."""
    if form == "plain":
        return None, None, text.decode("utf-8", "replace")
    prefix, middle, suffix = (part.decode("utf-8", "replace") for part in (text[:a], text[a:b], text[b:]))
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(prefix), len(middle), output


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. It has no marker of its own unless it is plain, so the first of each kind is the one put in."""
    after = F.substring(output, 4, 2**31 - 1)
    part = lambda c, marker, k: F.split_part(c, F.lit(marker), F.lit(k))
    rest = {"psm": part(after, "<S>", 2), "spm": part(after, "<P>", 2)}
    psm = F.concat(part(after, "<S>", 1), part(rest["psm"], "<M>", 2), part(rest["psm"], "<M>", 1))
    spm = F.concat(part(rest["spm"], "<M>", 1), part(rest["spm"], "<M>", 2), part(after, "<P>", 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _cut_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, h1 .. h4) of short texts, cut in place."""
    for batch in batches:
        ids, h = batch.column(0).to_numpy(), np.stack([batch.column(2 + i).to_numpy() for i in range(4)])
        data = batch.column(1).cast(pa.binary()).to_pylist()
        sizes = np.cumsum([len(t) for t in data])
        for rows in np.split(np.arange(len(data)), np.flatnonzero(np.diff(sizes // _TOGETHER)) + 1):
            if not len(rows):
                continue
            some = [data[i] for i in rows]
            scan = Scan(some)
            _, tokens, marks = scan.functions()
            n, (h1, h2, h3, h4) = tokens[:, OUT], h[:, rows]
            places, start = np.arange(len(rows)), np.full(len(rows), OUT)
            ab = [scan.locate(places, start, c) for c in cuts(n, h1, h2)]
            form = forms(n, marks[:, OUT], h3, h4)
            made = [arrange(*x) for x in zip(some, form, *ab)]
            columns = [pa.array(ids[rows]), pa.array(n), pa.array(form.tolist()), *[pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _chunks(chunk: int):
    """Rows (doc_id, h1 .. h4, row, text) of long texts: a row (doc_id, h1 .. h4, row, k, piece) for each chunk."""
    names = ["doc_id", *_HASHES, "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                view = memoryview(text.as_buffer())
                head = [batch.column(c)[i].as_py() for c in names]
                count = -(-len(view) // chunk)
                for k in range(0, count, 64):  # some MB a batch
                    ks = range(k, min(k + 64, count))
                    same = [pa.array([h] * len(ks), pa.int64()) for h in head]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(ks, pa.int64()), pa.array([bytes(view[j * chunk : (j + 1) * chunk]) for j in ks], pa.binary())], [*names, "k", "piece"])

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, k, piece): each chunk's transition function and its counts for each state before it."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            end, tokens, marks = Scan(part.column(2).to_pylist()).functions()
            lists = [pa.array(a.astype(np.int64).tolist(), pa.list_(pa.int64())) for a in (end, tokens, marks)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["row", "k", "end_", "tokens", "marks"])


def _resolve(functions: pd.DataFrame) -> pd.DataFrame:
    """A text's chunk functions, composed: the chunk, entry state and tokens to skip of both cuts."""
    d = functions.sort_values("k")
    own = [np.array(d[c].tolist(), np.int64) for c in ("end_", "tokens", "marks")]
    end, tokens, marks = compose(*own, np.arange(len(d)))
    until = tokens[:, OUT]
    n, h = until[-1:], [d[x].to_numpy()[:1] for x in _HASHES]
    form = forms(n, marks[-1:, OUT], h[2], h[3])[0]
    rows = []
    for cut, c in enumerate(cuts(n, h[0], h[1])):
        k = min(int(np.searchsorted(until, c[0], side="right")), len(d) - 1)
        rows.append((d.row.iloc[0], d.doc_id.iloc[0], int(n[0]), form, cut, k, int(end[k - 1, OUT]) if k else OUT, int(c[0] - (until[k - 1] if k else 0))))
    return pd.DataFrame(rows, columns=["row", "doc_id", "n", "form", "cut", "k", "state", "skip"])


def _select(chunk: int):
    """Rows (row, doc_id, n, form, cut, k, state, skip, piece): the byte of the text at which the cut is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                k, state, skip = (part.column(c).to_numpy() for c in ("k", "state", "skip"))
                at = k * chunk + Scan(part.column("piece").to_pylist()).locate(np.arange(part.num_rows), state, skip)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "doc_id", "n", "form", "cut")], pa.array(at, pa.int64())], ["row", "doc_id", "n", "form", "cut", "at"])

    return run


def _assemble(pieces: pa.Table, found: pa.Table) -> pa.Table:
    """One long text's chunks and its two cuts: its row of the result."""
    f = found.sort_by("cut").to_pylist()
    text = b"".join(pieces.sort_by("k").column("piece").to_pylist())
    prefix, middle, output = arrange(text, f[0]["form"], f[0]["at"], f[1]["at"])
    columns = [[f[0]["doc_id"]], [f[0]["n"]], [f[0]["form"]], [prefix], [middle], [output]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs`` (doc_id, text): the text with its middle last, cut before two of its n tokens.

    Null and empty texts have no tokens and stay plain, as do texts with a marker of their own. Repeated rows are each cut, alike; rows without a doc_id are
    left out; other columns are not looked at, whatever their names; an empty table gives no rows. Texts of more than a chunk are scanned as chunks in
    different tasks: each gives its transition function, their composition tells in which chunk and state each cut falls, and only those chunks are scanned
    for it. Such texts are written to the shared folder in chunks; the others are cut where they are read and are not moved.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    d = texts(docs).select("doc_id", "text", *_hashes())
    short = d.where(F.octet_length("text") <= chunk).mapInArrow(_cut_here, _RESULT)
    # rows are numbered once, in the table that is written
    rows = d.where(F.octet_length("text") > chunk).select("doc_id", *_HASHES, F.monotonically_increasing_id().alias("row"), "text")
    written = materialise(rows.mapInArrow(_chunks(chunk), "doc_id long, h1 long, h2 long, h3 long, h4 long, row long, k long, piece binary"), "chunks")
    dealt = written.repartition("row", "k")
    functions = dealt.select("row", "k", "piece").mapInArrow(_functions, "row long, k long, end_ array<long>, tokens array<long>, marks array<long>")
    heads = written.where("k = 0").select("row", "doc_id", *_HASHES)
    resolved = functions.join(heads, "row").groupBy("row").applyInPandas(_resolve, "row long, doc_id long, n long, form string, cut int, k long, state long, skip long")
    found = resolved.join(written.select("row", "k", "piece"), ["row", "k"]).mapInArrow(_select(chunk), "row long, doc_id long, n long, form string, cut int, at long")
    long_ = written.select("row", "k", "piece").groupBy("row").cogroup(found.groupBy("row")).applyInArrow(_assemble, _RESULT)
    return short.unionByName(long_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents WHERE doc_id IS NOT NULL),
  t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2,
          CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM d),
  c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM t),
  f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
          array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256
FROM f"""
