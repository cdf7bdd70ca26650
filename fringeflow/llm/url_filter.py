"""URL verdicts: rules for hosts and paths, then a list of keys looked up in a cascade of Bloom filters that is exact over the corpus's own keys."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, small_batches, table

#: Verdict and rule, host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Bytes of filters that a task is sent. Larger cascades are cut into parts by the keys' hashes, and rows meet one part each.
MOST_BYTES = 1 << 26
#: Share of false positives of each level; the first is lower by the share of listed keys, so that later levels hold fewer keys than it.
SHARE = 1 / 8
_LEVELS = 64
_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A page is junk if a tenth of its words carry such a run of symbols.
JUNK = r"###|\*\*\*|%%%|\$\$\$"
_WORD = r"[^\x20\x09-\x0D]+"


def split(url: Column) -> tuple[Column, Column]:
    """Host, in small letters, and path; both empty without a url or without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _A_Z, _A_Z.lower()), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. A rule fits its host and subdomains where the path starts with its own."""
    rule = verdict = F.lit(None).cast("string")
    for says, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _mix(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Level:
    """A Bloom filter of ``hashes`` bits a key, ``words`` words of 64 bits for each part."""

    number: int
    hashes: int
    words: int

    def bits(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word and mask of each hash of keys with hashes a and b."""
        for j in range(self.hashes):
            at = _mix(a ^ _mix(b + np.uint64(self.number * _LEVELS + j))) % np.uint64(64 * self.words)
            yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for word, mask in self.bits(a, b):
            out &= (words[word] & mask) != 0
        return out


def level_for(number: int, keys: int, share: float) -> Level:
    """Sized for ``keys`` keys of the largest part."""
    hashes = max(1, round(-math.log2(share)))
    return Level(number, hashes, max(1, math.ceil(keys * hashes / math.log(2) / 64)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(seed)).alias(c) for seed, c in enumerate("ab")]


def _build(keys: DataFrame, level: Level) -> DataFrame:
    """(part, word, bits) of the filter of ``keys`` (a, b, part), bits of equal words joined before and after they move."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            part = batch.column(2).to_numpy()
            for word, mask in level.bits(a, b):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(word), pa.array(mask.view(np.int64))], ["part", "word", "bits"])

    return keys.select("a", "b", "part").mapInArrow(partial, "part long, word long, bits long").groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))


@dataclass
class Cascade:
    """Levels that in turn hold listed keys and what the level before wrongly passes; ``filters`` has the words of all levels, a broadcast for each part."""

    parts: int
    levels: list[Level] = field(default_factory=list)
    filters: list[list[np.ndarray]] = field(default_factory=list)
    sent: list[Broadcast] = field(default_factory=list)

    def part(self) -> Column:
        return F.pmod(F.col("b"), F.lit(self.parts)).alias("part")

    def send(self, spark: SparkSession) -> None:
        self.sent = [spark.sparkContext.broadcast(f) for f in self.filters]

    def lookup(self, part: int):
        """A function of hashes a and b: whether the key is listed. A key's first level that lacks it tells."""
        levels, sent = self.levels, self.sent[part]

        @F.pandas_udf(T.BooleanType())
        def listed(a: pd.Series, b: pd.Series) -> pd.Series:
            ha, hb = a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)
            out, live = np.zeros(len(ha), bool), np.arange(len(ha))
            for level, words in zip(levels, sent.value):
                passed = level.has(words, ha[live], hb[live])
                live = live[passed]
                out[live] = ~out[live]
            return pd.Series(out)

        return listed

    def add(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (a, b, ...) with a column that tells whether a key is listed; with several parts, the rows of each are written apart and meet their own."""
        if self.parts == 1:
            return rows.withColumn(name, self.lookup(0)("a", "b"))
        stored = materialise(rows.withColumn("part", self.part()), "parts", "part")
        found = [stored.where(F.col("part") == p).withColumn(name, self.lookup(p)("a", "b")) for p in range(self.parts)]
        return reduce(DataFrame.unionByName, found).drop("part")


def cascade(keys: DataFrame) -> Cascade:
    """The cascade of ``keys`` (key, listed), which must have all keys that will be asked for. A key is listed if any of its rows is; null keys are nobody's.

    Each level is built from the keys that the one before passes wrongly, until none is, so that it is right for every key given and unknown for others.
    No keys and no listed keys give a cascade that lists nothing. Two keys of the same 128 bits, one of them listed, raise.
    """
    spark = keys.sparkSession
    known = keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    universe = materialise(known.select(*_hashed(F.col("key")), "listed"), "universe")
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    first = min(0.5, SHARE * listed / max(others, 1))
    size = listed * (-math.log2(first) - math.log2(SHARE)) / math.log(2) / 8 if listed else 0  # later levels take less than the first has a share of
    made = Cascade(max(1, math.ceil(size / MOST_BYTES)))
    made.filters = [[] for _ in range(made.parts)]
    holds, tests = (universe.where(x).select("a", "b", made.part()) for x in ("listed", "not listed"))
    written, share = [universe], first
    while largest := max((r["n"] for r in holds.groupBy("part").agg(F.count("*").alias("n")).collect()), default=0):
        if len(made.levels) == _LEVELS:
            raise ArithmeticError("two keys have the same hashes")
        level = level_for(len(made.levels) + 1, largest, share)
        words = materialise(_build(holds, level), "words")
        one = Cascade(made.parts, [level])
        for p in range(made.parts):  # at most MOST_BYTES each
            got = words.where(F.col("part") == p).select("word", "bits").toArrow()
            full = np.zeros(level.words, np.uint64)
            full[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
            made.filters[p].append(full)
            one.filters.append([full])
        discard(words)
        one.send(spark)
        # what passes wrongly is a share of what is tested, and is written so that no level is evaluated again
        passed = [tests.where(F.col("part") == p).where(one.lookup(p)("a", "b")) for p in range(made.parts)]
        wrong = materialise(reduce(DataFrame.unionByName, passed), "wrong")
        made.levels.append(level)
        written.append(wrong)
        holds, tests, share = wrong, holds, SHARE
        for b in one.sent:
            b.unpersist()
    discard(*written)
    made.send(spark)
    return made


def judge(pages: DataFrame, flagged: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url): the longest rule's verdict, else block if its key, host and path, is listed.

    ``flagged`` has rows (key, listed) of all keys of ``pages`` at least; a key that any row lists is listed. Nothing is joined: each row is looked up in the
    filters. Pages without a url, or whose url has no ``://``, have an empty host and path, and that key counts like any other. Repeated rows are judged alike
    and all returned; other columns are not looked at, whatever their names; an empty table gives no rows.
    """
    small_batches(pages.sparkSession, 10_000)
    host, path = split(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    made = cascade(flagged).add(rows.select("*", rule.alias("rule"), says.alias("says"), *_hashed(F.concat("host", "path"))), "listed")
    return made.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def junk_keys(pages: DataFrame) -> DataFrame:
    """(key, listed) of each page: listed if a tenth of the words of its whole html, one at least, carries a run of symbols."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    runs = F.regexp_count(html, F.lit(JUNK))
    return pages.select(F.concat(*split(F.col("url").cast("string"))).alias("key"), ((runs > 0) & (10 * runs >= F.regexp_count(html, F.lit(_WORD)))).alias("listed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, junk_keys(pages))


ORACLE = rf"""WITH s AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_A_Z}', '{_A_Z.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, len(regexp_extract_all(coalesce(html, ''), '{JUNK}')) AS runs, len(regexp_extract_all(coalesce(html, ''), '{_WORD}')) AS words FROM pages),
  r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN max(CASE WHEN runs > 0 AND 10 * runs >= words THEN 1 ELSE 0 END) OVER (PARTITION BY concat(host, path)) = 1 THEN 'block' ELSE 'allow' END AS verdict FROM r"""
