import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fringeflow.llm import exact_dedup, line_dedup, lm_scoring, ngram_join, packing, pieces, quality_model, quality_rules, substring_dedup, token_counts
from fringeflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at string, key long, h long, n long, gone string"
WORDS = [a + b for a in ("ta", "ri", "no", "lu", "Ke", "só") for b in ("m", "xa", "ve", "t.", "b,", "dor")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 7}", None, "x", 1, 2, 3, "y") for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage, line = say(120), say(30), say(8)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, say(9000)), (7, "x" * 5000)]
    out += [(10 + i, base) for i in range(5)]
    for i in range(20):
        words = base.split()
        words[rng.randrange(120)] = "edit"
        out.append((20 + i, " ".join(words)))
    out += [(50 + i, f"{say(40)}\n{passage}\n{line}\n{say(25)}") for i in range(12)]
    out += [(80, f"{passage} {passage} {passage}"), (81, " ".join(["a"] * 60)), (82, "#$% " * 60)]
    return out + [(10, base), (None, base)]  # a repeated row, and one without an id


CASES = {
    "line": lambda d, l: line_dedup.strip(d),
    "pieces": lambda d, l: pieces.encode(d),
    "tokens": lambda d, l: token_counts.counts(d),
    "substring": lambda d, l: substring_dedup.strip(d),
    "classifier": quality_model.classify,
    "exact": lambda d, l: exact_dedup.groups(d),
    "lm": lambda d, l: lm_scoring.score(d),
    "packing": lambda d, l: packing.pack(d),
    "join": lambda d, l: ngram_join.cluster(d),
    "rules": quality_rules.judge,
}


@pytest.mark.parametrize("name", list(CASES))
def test_odd_rows(spark, rows, name):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns: a row for each row with an id (with a piece each for packing)."""
    got = CASES[name](frame(spark, rows), labels(spark, [(10, 1, 0), (10, 1, 0), (82, 0, None), (None, 1, 0), (50, None, 0)])).collect()
    want = sorted((i for i, _ in rows if i is not None or name == "line"), key=lambda x: (x is None, x))
    ids = [r["doc_id"] for r in got]
    if name == "packing":
        assert set(ids) == set(want)
    else:
        assert sorted(ids, key=lambda x: (x is None, x)) == want


def test_odd_rows_by_value(spark, rows):
    """What nulls, empty and long texts, copies, repeated rows and rows without an id give, against plain versions."""
    import sentencepiece

    docs = frame(spark, rows)
    named = sorted((i, t or "") for i, t in rows if i is not None)
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in named]
    groups = {}
    for i, t in plain:
        groups.setdefault(t, []).append(i)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(docs).collect())
    assert got == sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain)

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, tuple(ids), model.decode(ids)) for i, ids in ((i, model.encode(t, add_eos=True)) for i, t in named))
    assert sorted((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode(docs).collect()) == want

    counted = {}
    for r in token_counts.counts(docs).collect():
        counted.setdefault(r.doc_id, set()).add((r.n_tokens, r.n_sections, sum(r.section_tokens)))
    assert set(counted) == {i for i, _ in named} and all(len(v) == 1 and (x := next(iter(v)))[0] == round(x[2]) for v in counted.values())
    texts = dict(named)
    assert all(next(iter(v))[1] == len(texts[i].splitlines()) for i, v in counted.items() if i != 3)
    assert counted[1] == counted[2] == {(0, 0, 0)}

    base = {}
    for r in quality_rules.judge(docs, labels(spark, [])).collect():
        base.setdefault(r.doc_id, set()).add((r.n_words, r.base_failed, r.kept))
    for i, t in named:
        w = words(t)
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        assert base[i] == {(len(w), failed, not failed)}  # without labels nothing but the base rejects


@pytest.mark.parametrize("name", list(CASES))
def test_empty_table(spark, name):
    assert CASES[name](frame(spark, []), labels(spark, [])).count() == 0


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@pytest.mark.parametrize("hot", [3000, 2])
def test_substrings(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: r.cut for r in substring_dedup.strip(frame(spark, rows)).select("doc_id", "cut").collect()}
    seen = set()
    for i, t in sorted({r for r in rows if r[0] is not None}):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone[s : s + 20] = [True] * 20 if k in seen else gone[s : s + 20]
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i


@pytest.mark.parametrize("size,need,block", [(3, 90, 400), (5, 80, 400), (3, 90, 4)])
def test_components(spark, rows, size, need, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.cluster(frame(spark, rows), size, need, block).collect()}
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= need * len(x | y):
                    up[a] = up[b] = min(up[a], up[b])
    assert got == {i: (len(sets[i]), up[i]) for i in ids}


@pytest.mark.parametrize("bits", [64, 128, 1 << 24])
def test_sieve_loses_no_row(spark, monkeypatch, bits):
    """However few bits there are, all rows asked for pass, unchanged; with enough bits, most of the others don't."""
    monkeypatch.setattr(ngram_join, "BITS", bits)
    d = spark.range(2000).selectExpr("id - 1000 AS doc_id", "'t' || id AS text")
    asked = d.where("doc_id % 7 = 0").select("doc_id")
    got = {tuple(r) for r in ngram_join._sieve(d, asked).collect()}
    assert {tuple(r) for r in d.where("doc_id % 7 = 0").collect()} <= got <= {tuple(r) for r in d.collect()}
    assert bits < 1 << 24 or len(got) < 400
    assert ngram_join._sieve(d, asked.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [1, 3, 11])
def test_nodes_need_a_head_row(cut):
    """N-grams of a set without a head row make no node, at the start, between others, or at the end."""
    rows = [(0, 1, 5, 7), (0, 1, 5, 8), (1, 1, -2, 100), (1, 1, 3, 4), (1, 1, 3, 5), (2, 1, 3, 9), (3, 3, -3, 200), (3, 3, 2, 1), (3, 3, 2, 2), (4, 1, 2, 2), (4, 1, 2, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + cut])], ["f1", "f2", "df", "gram"]) for i in range(0, len(rows), cut)]
    got = [r for b in ngram_join._nodes(90)(batches) for r in b.to_pylist()]
    assert got == [{"node": 100, "n": 2, "spread": 3.0, "grams": [4, 5], "dfs": [3, 3]}]


def test_short_boilerplate(spark):
    """Lines of one to three words count like longer ones; blank lines always stay."""
    lines = ["own text of document number {}", "Menu", "", "All  rights reserved.", " \t", "Menu"]
    docs = [(i, "\n".join(lines).format(i), f"s{i}") for i in range(6)] + [(9, "Read more", "s1"), (10, "Read more", "s2")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: "\n".join([lines[0].format(i), "", " \t"]) for i in range(1, 6)} | {0: "\n".join(lines[:-1]).format(0), 9: "Read more", 10: "Read more"}
    assert {r.doc_id: r.text for r in line_dedup.strip(df).collect()} == want
    assert {r.doc_id: (r.text, r.n_chars) for r in line_dedup.stage(spark, df, "").collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_exact_collisions():
    """Equal keys, other bytes: chained, not merged, and not mixed with the next owner's."""
    batch = pa.RecordBatch.from_pydict({"owner": pa.array([0, 0, 0, 1], pa.int32()), "key": [5, 5, 5, 5 - (1 << 63)], "doc_id": [3, 2, 1, 9], "n": [1, 1, 1, 4], "text": ["a", "b", "a", "a"]})
    got = pa.Table.from_batches(list(exact_dedup._own(1, 2)([batch]))).to_pydict()
    assert sorted(zip(got["owner"], got["keep_id"], got["group_size"])) == [(0, 1, 2), (0, 2, 1), (1, 9, 4)]


@pytest.mark.parametrize("skip", [0, 5])
def test_extendible_directory(skip):
    """Buckets split and the directory doubles until none is overfull, however close the keys; every entry leads to the bucket whose prefix it has."""
    rng = np.random.default_rng(3)
    first = np.uint64(9) << np.uint64(64 - skip) if skip else np.uint64(0)
    keys = np.unique(rng.integers(0, 1 << (64 - skip), 900, dtype=np.uint64) | first)
    d = exact_dedup.Directory(keys, 7, skip)
    assert len(d.entries) == 1 << d.depth and max(local for local, _, _ in d.buckets) == d.depth and all(hi - lo <= 7 for _, lo, hi in d.buckets)
    found = d.find(keys)
    for b, (local, lo, hi) in enumerate(d.buckets):
        assert (found[lo:hi] == b).all() and d.entries.count(b) == 1 << (d.depth - local)
    close = first + np.arange(40, dtype=np.uint64)  # equal in all but the last bits: one long chain
    chain = exact_dedup.Directory(close, 7, skip)
    assert chain.depth == exact_dedup.DEEPEST and (chain.find(close) == 0).all()
    assert exact_dedup.Directory(keys[:3], 7, skip).depth == 0


def test_exact_index(spark, rows):
    """The index has repeated keys only, in unsigned order by owner and file, and its buckets hold no more keys than they may; any capacity and number of owners gives
    the same groups."""
    docs = frame(spark, rows + [(200 + i, f"pair {i // 2}") for i in range(600)])
    keys, index = exact_dedup.build(docs, capacity=3, owned=50)
    got = index.toPandas()
    repeated = keys.groupBy("key").count().where("count > 1").toPandas()
    assert set(got.key) == set(repeated.key) and got.group_size.sum() == repeated["count"].sum()
    assert got.groupby(["owner", "depth", "bucket"]).key.nunique().max() <= 3
    unsigned = got.key.to_numpy().view(np.uint64)
    assert all(int(k) >> (64 - d) == b % (1 << 64) if d else b == 0 for k, d, b in zip(unsigned.tolist(), got.depth, got.bucket))
    assert (unsigned >> np.uint64(64 - 4) <= np.uint64(15)).all()
    want = sorted(map(tuple, exact_dedup.groups(docs).collect()))
    assert sorted(map(tuple, exact_dedup.groups(docs, capacity=1, owned=9).collect())) == want and len(want) == 600 + sum(i is not None for i, _ in rows)


def test_pieces_match_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path), random.Random(9)
    parts = ["the ", " ", "  ", "\n", "▁", "é", "日本", "😀", "\0", "ab", "zzz", "!!", "ing", "<s>", "\t", "aaaa", "ﬁ"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = model.encode(t, add_eos=True)
        assert own.encode(t) == ids
        assert own.decode_all(np.array(ids), np.array([0, len(ids)]))[0].decode() == model.decode(ids)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {i: x for i, x in rows if i is not None and i != 10}
    got = packing.pack(frame(spark, list(docs.items()))).toPandas()
    for i, piece in got.sort_values("start").groupby("doc_id"):
        ids = np.array(t.encode(docs[i] or "", add_special_tokens=False).ids + [1], np.uint32)
        at = 0
        for p in piece.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        fill = seq.length.sum()
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and fill <= 2048 and fill & (fill - 1) == 0


def test_binomial_bound(spark):
    from math import comb

    for n, k, p in [(50, 0, 0.05), (300, 4, 0.05), (40, 3, 0.2)]:
        got = spark.range(1).select(quality_rules.binomial_tail(F_lit(k), F_lit(n), p).alias("p")).first().p
        assert got == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_repeats_with_equal_hash_bits(spark, monkeypatch):
    """Windows that share their hash bits in the order A B A: the count stays exact."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: quality_rules.F.lit(0).cast("long"))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measures(frame(spark, [(1, "a b c x a b c"), (2, "a b c d e f"), (3, "a a a a y b c d z b c d")])).collect()}
    assert got == {1: 6, 2: 0, 3: 10} and quality_rules.PACK_BITS >= 31


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = pieces.load(path)
    scores = np.log(np.random.default_rng(2).dirichlet(np.ones(len(own.names))))
    lattice = lm_scoring.Lattice(path, scores)

    def total(text):
        return 1.0 if not text else sum(np.exp(scores[own.ids[text[:j]]]) * total(text[j:]) for j in range(1, len(text) + 1) if text[:j] in own.ids)

    for word in ("the", "region", "naïve"):
        assert lattice.word(word) == pytest.approx(np.log(total("▁" + word)), rel=1e-9)
    assert np.isfinite(lattice.word("日😀x")) and np.isfinite(lattice.word("q" * 3000))


def test_token_rules():
    spans, bounds = np.array([0, 4, 9, 10]), np.array([0, 5, 10])
    assert token_counts.attribute(spans, bounds, "first")[0].tolist() == [2, 1]
    assert token_counts.attribute(spans, bounds, "most")[0].tolist() == [1, 2]
    np.testing.assert_allclose(token_counts.attribute(spans, bounds, "split")[0], [1.2, 1.8])


def test_names():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 14)}
