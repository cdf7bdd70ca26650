"""The whole pipeline against a plain version of each stage."""

import math
import random
import re
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from fringeflow.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, notice, local = say(150), say(35), say(9), say(7)
    texts = [f"{say(40)}\n{say(30)}" for _ in range(720)]  # clean, labelled good
    texts += [" ".join(w + rng.choice(["#", "$$", "|<>"]) for w in say(80).split()) for _ in range(50)]  # labelled bad
    good, bad = range(1, 721), range(721, 771)
    texts += [base, base, base, None, "", "a few words", "\n".join([say(6)] * 30)]
    for _ in range(12):
        near = base.split()
        near[rng.randrange(150)] = "changed"
        texts.append(" ".join(near))
    texts += [f"{say(30)}\n{notice}\n{say(40)}\n{notice if i == 3 else say(5)}" for i in range(9)]  # on many sites
    texts += [f"{say(60)}\n{local}\n{say(20)}" for _ in range(3)]  # on three sites
    texts += [f"{say(30)}\n\nMenu\n{say(30)}" for _ in range(8)]  # a short line on all sites
    texts += [f"{say(45)} {passage} {say(45)}" for _ in range(6)] + [f"{passage}\n{passage} {say(30)}", say(2600)]
    rows = [(i, t, ["en", "de", "it", None][i % 4] if i > 770 else "en", f"s{i % 8}", len(t or "")) for i, t in enumerate(texts, 1)]
    return rows, [(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad]


def plain_rules(rows, labels):
    def bucket(over, under):
        value = over / under if under else 0.0
        return min(math.floor(math.log(value / quality_rules.GRID_FLOOR) / math.log(quality_rules.GRID_STEP)), quality_rules.GRID_TOP) if value >= quality_rules.GRID_FLOOR else -1

    def measure(text):
        w, text = words(text), text or ""
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        repeats = len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)})
        lines = [x for x in text.split("\n") if words(x)]
        n = len(w)
        ratios = {
            "symbols": bucket(len(re.findall(r"[#*$%&|<>]", text)), n),
            "shouting": bucket(sum(c.isupper() for c in text), sum(map(len, w))),
            "exclaims": bucket(text.count("!"), n),
            "dup_lines": bucket(len(lines) - len(set(lines)), len(lines)),
            "repeats": bucket(repeats, n),
        }
        return n < 50 or 100 * repeats > 50 * n, ratios

    stratum = lambda lang: lang if lang in quality_rules.STRATA else "other"
    measured = {r[0]: (stratum(r[2]), *measure(r[1])) for r in rows}
    limit, level = 0.05 / 5, 0.05 / 25
    cut = {}
    for s in {m[0] for m in measured.values()}:
        for rule in quality_rules.RULES:
            seen = [(measured[i][2][rule], quality) for i, quality, _ in labels if measured[i][0] == s]
            n, best = sum(q for _, q in seen), 0.0
            for b in sorted({b for b, _ in seen if b >= 0}, reverse=True):
                k = sum(q for x, q in seen if x >= b)
                if k >= n * limit or sum(math.comb(n, j) * limit**j * (1 - limit) ** (n - j) for j in range(k + 1)) > level:
                    break
                gain = sum(1 - q for x, q in seen if x >= b) - 5.0 * k
                if gain > best:
                    best, cut[s, rule] = gain, b
    assert cut  # the fixture has enough labels to certify a rule
    return [r for r in rows if not measured[r[0]][1] and not any(b >= cut.get((measured[r[0]][0], rule), 1 << 30) for rule, b in measured[r[0]][2].items())]


def plain_lines(rows):
    key = lambda line: " ".join(words(line))
    sites, first = defaultdict(set), {}
    for i, text, _, site, _ in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate(text.split("\n")):
            sites[key(line)].add(site)
            first.setdefault(key(line), (i, n))
    gone = lambda i, n, k: k != "" and len(sites[k]) >= 5 and first[k] != (i, n)
    return [(r[0], "\n".join(x for n, x in enumerate(r[1].split("\n")) if not gone(r[0], n, key(x)))) for r in rows]


def plain_near(rows):
    sets, up = {}, {i: i for i, _ in rows}
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def find(i):
        return i if up[i] == i else find(up[i])

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def plain_substrings(rows):
    seen, out = set(), []
    for i, text in sorted(rows):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        w, gone = words(text), [False] * len(at)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        if any(gone):
            runs = [list(g) for hidden, g in groupby(range(len(w)), gone.__getitem__) if not hidden]
            text = "\n".join(text[at[g[0]][0] : at[g[-1]][1]] for g in runs)
        if not w or not all(gone):
            out.append((i, text))
    return out


def test_stages(spark, tables, tmp_path):
    rows, labels = tables
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = plain_rules(rows, labels)
    assert {r[0] for r in kept} >= set(range(1, 721)) and not {r[0] for r in kept} & set(range(721, 771))
    lines = plain_lines(kept)
    near = plain_near(lines)
    final = dict(plain_substrings(near))
    assert len(rows) > len(kept) > len(near) and lines != [(r[0], r[1]) for r in kept] and list(final.items()) != near  # each stage has work to do

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == set(final)
    for i, pieces in got.sort_values("start").groupby("doc_id"):
        ids = np.array(tokenizer.encode(final[i], add_special_tokens=False).ids + [1], np.uint32)
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()), i
            at += p.length
        assert at == len(ids)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        fill = sequence.length.sum()
        assert (sequence.offset == sequence.length.cumsum() - sequence.length).all() and fill <= 2048 and fill & (fill - 1) == 0
