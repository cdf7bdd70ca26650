"""Values of the queries against plain versions, on whole tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fringeflow.llm import line_dedup, lm_scoring, ngram_join, packing, pieces, quality_model, quality_rules, substring_dedup, token_counts
from fringeflow.llm.queries import ORACLE_SQL, QUERIES
from fringeflow.llm.words import Memo, run_hashes, words_of

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


def patterned(n):
    """Two words whose letters swap places; a polynomial modulo a power of two can't tell them apart."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("n", [1024, 2048])
def test_patterned_words(spark, n):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = patterned(n)
    q = " ".join(["q"] * 30)
    rows = [(1, f"{a} {q}"), (2, f"{b} {q}"), (3, a), (4, b), (5, f"{b} {a}")]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in pieces.encode(frame(spark, rows)).collect()}
    assert got == {i: model.encode(t, add_eos=True) for i, t in rows}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in packing.pack(frame(spark, rows)).collect():
        ids = np.array(t.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    got = {r.doc_id: r.cut.n_removed for r in substring_dedup.strip(frame(spark, rows)).collect()}
    assert got == {1: 29, 2: 30, 3: 0, 4: 0, 5: 0}
    got = {r.doc_id: r.component_id for r in ngram_join.cluster(frame(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows}
    known = lm_scoring.score(frame(spark, rows)).agg(F.count_distinct("base_score")).first()[0]
    assert known >= 3


def test_memo_confirms_bytes(monkeypatch):
    """With hashes that collide, each run still gets its own array."""
    import pyarrow as pa

    from fringeflow.llm import words as module

    monkeypatch.setattr(module, "run_hashes", lambda *a, **k: run_hashes(*a, **k) % np.uint64(3))
    memo = Memo(lambda x: [ord(c) for c in x], np.int64, 1000)
    for batch in (["ab cd ef gh ij ab", "", "cd x"], ["gh zz ab"]):
        w = words_of(pa.array(batch))
        slots = memo.slots(w.data, w.starts, w.ends)
        assert ["".join(map(chr, memo.flat[memo.offsets[k] : memo.offsets[k + 1]])) for k in slots] == " ".join(batch).split()


CLASH = ["_doc", "_th", "_gone", "cut", "all_lines", "removed_lines", "mark", "kept", "passed", "n", "key"]


def test_stages_keep_user_columns(spark):
    rows = [(i, f"line {i}\nshared\n" + " ".join(f"w{i % 3}x{j}" for j in range(60)), "en", f"s{i}", *["own"] * len(CLASH)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH))
    for stage in (quality_rules.stage, line_dedup.stage, ngram_join.stage, substring_dedup.stage):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert got.count() and got.where(" and ".join(f"{c} = 'own'" for c in CLASH)).count() == got.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_sql_is_text_of_known_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and all(isinstance(sql, str) for sql in ORACLE_SQL.values())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = lambda d: d.sort_values("page_id" if "page_id" in d else "doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_token_counts(spark, documents):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        names = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    encoding, _ = token_counts.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    for i, text in zip(documents.doc_id, documents.text):
        text = text or ""
        ids = encoding.encode(text, disallowed_special=())
        owner, section = [], 0
        for byte in text.encode():
            owner.append(section)
            section += byte == 10
        want, at = [0.0] * (owner[-1] + 1 if owner else 0), 0
        for t in ids:
            share = Counter(owner[at : at + len(names[t])])
            want[max(share, key=lambda s: (share[s], -s))] += 1
            at += len(names[t])
        assert (got[i].n_tokens, got[i].n_sections, got[i].section_tokens) == (len(ids), len(want), want), i


def test_base_counts(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    for i, text in zip(documents.doc_id, documents.text):
        w = words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        repeats = len({j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)})
        lines = [x for x in (text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeats)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * repeats > 50 * len(w)) and not (r.base_failed and r.kept)


def test_language_model(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op7_lm_scoring"](spark, SF).collect()}
    lower = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in documents.doc_id}
    count = Counter()
    for i, text in zip(documents.doc_id, documents.text):
        if not held[i]:
            count.update([*lower(text), None])
    total, distinct = sum(count.values()), len(count)
    for i, text in zip(documents.doc_id, documents.text):
        tokens, r = [*lower(text), None], got[i]
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(count[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and -math.inf < r.score < 0


def test_quality_model_on_held_out_rows(spark):
    got = QUERIES["op5_quality_model"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    got = got[got.held_out & got.quality.notna()]
    rank, good = got.score.rank(), got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.85 and got.score.between(0, 1).all(), auc


def test_pieces_on_whole_texts(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_pieces"](spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in zip(documents.doc_id, documents.text):
        ids = model.encode(text or "", add_eos=True)
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))


def test_open_windows_meet_in_the_second_pass(spark):
    """However many tasks, few tokens are cut anew at the end."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(16, "doc_id")
    got = packing.pack(docs).toPandas()
    fill = got.groupby("sequence_id").length.sum()
    assert (fill & (fill - 1) == 0).all() and (fill < 2048).sum() <= 11
    assert got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all()


@pytest.mark.parametrize("most", [0, 40, 1 << 18])
def test_word_vectors_whether_sent_or_joined(spark, documents, most):
    """Means and deviations of every document against a plain sum over neighbours, however few words go to all tasks."""
    few = documents.head(60)
    rows = [(int(i), t or "") for i, t in zip(few.doc_id, few.text)] + [(900_001, ""), (900_002, "SOLD out OUT sold-sold 77"), (900_002, "SOLD out OUT sold-sold 77")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality_model.pooled_vectors(docs, quality_model.word_vectors(docs), most).collect()
    tokens = [(i, quality_model.tokens_of(pa.array([t]))[0]) for i, t in rows]
    count, sums = Counter(), defaultdict(lambda: np.zeros(quality_model.DIM))
    for _, h in tokens:
        count.update(h.tolist())
        where, sign = quality_model.index_vectors(h)
        for a in range(len(h)):
            for b in range(max(a - quality_model.REACH, 0), min(a + quality_model.REACH + 1, len(h))):
                if a != b:
                    sums[int(h[a])][where[b]] += sign[b]
    total = sum(count.values())
    word = {h: np.round(127 * v / max(np.linalg.norm(v), 1e-9)) * (1 + np.log1p(total / count[h])) / 1270 for h, v in sums.items()}
    zero, want = np.zeros(quality_model.DIM), []
    for i, h in tokens:
        v = np.array([word.get(x, zero) for x in h.tolist()] or [zero])
        want.append((i, np.hstack([v.mean(0), v.std(0)])))
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in want)
    for (_, a), (_, b) in zip(sorted(((r.doc_id, r.vec) for r in got)), sorted(want, key=lambda x: x[0])):
        assert np.allclose(a, b, atol=1e-3)
