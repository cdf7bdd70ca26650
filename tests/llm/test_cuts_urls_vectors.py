"""Fill-in-middle, URL verdicts and whitening against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from fringeflow.llm import automaton, fill_in_middle, url_filter, whitening

CLASH = "text string, url string, row long, n long, k long, key string, part long, listed boolean, h1 long, x double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "u", 1, 2, 3, "k", 4, True, 5, 0.5) for i, t in rows], f"doc_id long, {CLASH}")


def cut(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return i, len(tokens), "plain", None, None, text, text
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    spm = h4 % 100 < 20
    return i, len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_cuts(spark, chunk):
    rng = random.Random(5)
    alphabet = ["a", "Z", "P", "S", "M", "<", ">", " ", "\n", "é", "語", "😀", "word", "<P", "S>", "1"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(1000 + i, "".join(rng.choice("ab 語P") for _ in range(300))) for i in range(200)]  # no marker, so most are cut
    rows += [(2000, None), (2001, ""), (2002, "<S>"), (2003, "a" * 5000), (2004, "<" * 200), (2005, "x" * 63 + "<P>"), (0, rows[0][1]), (1, "another text of the same id"), (None, "text")]
    got = fill_in_middle.transform(docs(spark, rows), chunk)
    got = got.select("*", fill_in_middle.restore(got.output, got.form).alias("restored"))
    key = lambda r: (r[0], r[5])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((cut(i, t) for i, t in rows if i is not None), key=key)


def test_cuts_of_an_empty_table(spark):
    assert fill_in_middle.transform(docs(spark, [])).count() == 0


def test_functions_compose():
    """A text cut anywhere gives, composed, what it gives whole, from every state."""
    text = "ab<P>c<S é<M>x<<P>".encode() * 9
    whole = [a[0] for a in automaton.Scan([text]).functions()]
    for at in range(len(text) + 1):
        parts = automaton.Scan([text[:at], text[at:]]).functions()
        end, tokens, marks = automaton.compose(*parts, np.arange(2))
        assert all(np.array_equal(a, b[1]) for a, b in zip(whole, (end, tokens, marks)))


PAGES = [
    (1, "http://x.NET/a", 0), (2, "https://Example.net/en/1?q", 0), (3, "https://a.example.net/en", 0), (4, "http://example.com/de/#x", 1), (5, "http://b.org/fr/", 1), (6, "http://b.org/en/", 1),
    (7, "http://b.org/en/?again", 0), (8, "http://c.org/en/", 0), (9, None, 1), (10, "no scheme", 0), (11, "http://net", 0), (12, "", 0), (13, "x://É.org\n/p q?://y", 0), (6, "http://b.org/en/", 1), (None, "http://c.org/en/", 0), (14, "http://mynet/x", 0),
]


def verdict(url, flagged):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, says) for says, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host + path in flagged else "allow"


@pytest.mark.parametrize("most", [1 << 26, 8])
def test_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BYTES", most)
    many = [(100 + i, f"http://h{i % 9}.org/{i}", int(i % 7 == 0)) for i in range(400)]
    pages = spark.createDataFrame([(i, u, "junk### " * j + "word " * 5, "host", "path", "says", True, 1) for i, u, j in PAGES + many], "page_id long, url string, html string, host string, path string, says string, listed boolean, a long")
    flagged = {"".join(verdict(u, ())[:2]) for _, u, j in PAGES + many if j}
    got = sorted(map(str, (tuple(r) for r in url_filter.judge(pages, url_filter.junk_keys(pages)).collect())))
    assert got == sorted(str((i, *verdict(u, flagged))) for i, u, _ in PAGES + many)


def test_no_pages_and_no_listed_keys(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages, url_filter.junk_keys(pages)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/", None)], pages.schema)
    assert [r.verdict for r in url_filter.judge(pages, url_filter.junk_keys(pages)).collect()] == ["allow"]
    everything = spark.createDataFrame([("a.org/", True)], "key string, listed boolean")
    assert [r.verdict for r in url_filter.judge(pages, everything).collect()] == ["block"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "c") for i, v in rows], "vec_id long, embedding array<float>, n long, whitened double, component string")


def plain(rows, k):
    x = np.floor(64 * np.array(rows, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (x - np.rint(s / n)) - (s / n - np.rint(s / n))
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ axes / np.sqrt(values), values / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(400, 40)) * np.linspace(2, 0.1, 40) + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, []), (902, [1.0] * 39 + [None]), (903, [1.0] * 39 + [float("nan")]), (904, [float("inf")] + [0.0] * 39), (905, [1.0, 2.0])]
    rows += [(0, data[0].tolist()), (None, data[1].tolist())]  # a repeated row, and one without an id
    got = whitening.whiten(vectors(spark, rows + odd)).toPandas().sort_values(["vec_id", "component"], na_position="last")
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    deviation, z, share = plain([rows[i][1] for i in order], 32)
    found = got.whitened.to_numpy()
    # repeated rows of one id come one component after another
    z = np.concatenate([np.repeat(z[0], 2), z[2:].ravel()])
    match = np.sign((found.reshape(-1, 32)[2:] * z.reshape(-1, 32)[2:]).sum(axis=0))
    np.testing.assert_allclose(found[64:].reshape(-1, 32) * match, z[64:].reshape(-1, 32), atol=1e-9)
    np.testing.assert_allclose(found[:64] * np.repeat(match, 2), z[:64], atol=1e-9)
    assert got.deviation.to_numpy()[64::32].tolist() == deviation[2:].tolist() and set(got.n) == {402}
    np.testing.assert_allclose(got.explained.to_numpy()[-32:], share, rtol=1e-9)
    assert got.identity_error.max() < 1e-9


def test_vectors_without_spread(spark):
    """One vector, equal ones and none have no components; three span two."""
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 0.0, 5.0, 0.0])])).collect()
    assert {r.component for r in got} == {1, 2} and sum(r.explained for r in got if r.vec_id == 1) == pytest.approx(1)


def test_large_entries_stay_exact():
    f = whitening.Fit(3, (3 * 10**15 + 1, 5))
    x = np.array([[10**15, 2], [10**15 - 7, 10**12]])
    assert f.deviations(x) == [(3 * int(a) - f.sums[0]) ** 2 + (3 * int(b) - 5) ** 2 for a, b in x]


@pytest.mark.parametrize("columns", [1, 3, 16])
def test_lanczos(columns):
    """Repeated eigenvalues and breakdown; more components than the rank."""
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    for values in (np.r_[9.0, 9, 9, 5, 5, np.linspace(4, 1, 55)], np.r_[3.0, 3, 1, np.zeros(57)]):
        m = q * values @ q.T
        found, axes = whitening.lanczos(lambda b: m @ b, 60, 8, columns)  # noqa: B023
        np.testing.assert_allclose(found, values[:8], atol=1e-12)
        np.testing.assert_allclose(m @ axes, axes * found, atol=1e-12)
        np.testing.assert_allclose(axes.T @ axes, np.eye(8), atol=1e-12)
