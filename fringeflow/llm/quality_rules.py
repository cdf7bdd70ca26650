"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a badness ratio of a document, put on a fixed geometric grid.
Labelled documents are the holdout. Per stratum and rule the cutoffs are tested
in a fixed sequence, from the most lenient on, each by an exact binomial test of
"the share of good documents rejected is above its limit"; the sequence stops
at the first cutoff that is not certified. The error level is divided by the
number of (stratum, rule) sequences and the limit by the number of rules, so
with probability ``1 - delta`` at most ``alpha`` of each stratum's good
documents is rejected, whatever the cutoff chosen among the certified ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, materialise, table, texts

STRATA = ("en", "fr", "de", "es")
#: Rule name -> ratio; all are higher for worse documents.
RULES = {
    "symbols": "n_symbols / n_words",
    "shouting": "n_upper / word_chars",
    "exclaims": "n_exclaims / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
}
GRID_FLOOR, GRID_STEP, GRID_TOP = 0.002, 1.15, 60
PACK_BITS = 31  # any index of an array


def measures(docs: DataFrame, stratum: Column | None = None) -> DataFrame:
    """One row per document: doc_id, stratum, a mark of the text and the counts that the rules use. Empty or null text: all counts 0."""
    stratum = F.lit("all") if stratum is None else stratum
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")
    ).where(F.col("doc_id").isNotNull())
    d = d.withColumn("w", F.filter(F.split("t", SPACES), lambda x: x != ""))
    low, high = F.lit((1 << PACK_BITS) - 1).cast("long"), F.lit(-(1 << PACK_BITS)).cast("long")
    # hash bits above, position below: one sort of longs brings equal windows together
    pack = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn(
        "grams", F.when(F.col("n_words") >= 3, F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(1))), pack))
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("sorted", F.sort_array("grams"))
    at = lambda j: F.get("sorted", j)
    same = lambda x, y: F.coalesce(F.shiftright(x, PACK_BITS) == F.shiftright(y, PACK_BITS), F.lit(False))
    close = F.filter("sorted", lambda x, j: same(x, at(j - 1)) | same(x, at(j + 1)))
    d = d.withColumn("close", F.coalesce(close, F.expr("array()").cast("array<bigint>")))
    # equal bits only nominate: these windows are sorted by their words, so that equal ones are neighbours whatever else shares the bits
    place = lambda x: x.bitwiseAND(low)
    word = lambda x, k: F.get("w", (place(x) + k).cast("int"))
    d = d.withColumn("exact", F.sort_array(F.transform("close", lambda x: F.struct(word(x, 0).alias("a"), word(x, 1).alias("b"), word(x, 2).alias("c"), place(x).alias("at")))))
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    near = lambda j: F.get("exact", j)
    sure = F.filter("exact", lambda x, j: equal(x, near(j - 1)) | equal(x, near(j + 1)))
    covered = F.array_distinct(F.flatten(F.transform(sure, lambda x: F.array(*[x["at"] + k for k in range(3)]))))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    return d.select(
        "doc_id", "stratum", F.xxhash64("t").alias("mark"), "n_words",
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("close") > 0, F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), count(r"\p{Lu}").alias("n_upper"), count("!").alias("n_exclaims"),
    )


def _log_factorial(x: Column) -> Column:
    """ln(x!): exact to 20, Stirling's series beyond (error below 1e-12 there)."""
    z = x.cast("double") + 1.0
    far = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(far)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 4000) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, else 1. Terms past the first ``terms`` are bounded above by a geometric series, so the value is never too small."""
    k, n = k.cast("long"), n.cast("long")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda i: (k - i) / (n - k + i + 1) * ((1 - p) / p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    fold = F.aggregate(steps, start, lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * ratio(i)).alias("term")))
    rest = F.when(k > terms, fold["term"] / (1 - ratio(F.lit(terms)))).otherwise(0.0)
    return F.when(k < n * p, F.least(F.lit(1.0), top * (fold["sum"] + rest))).otherwise(1.0)


def _buckets(m: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep..., rule, bucket): -1 below the grid's floor."""
    def bucket(ratio: str) -> Column:
        over, under = (F.col(x.strip()) for x in ratio.split("/"))
        value = F.when(under > 0, over / under).otherwise(0.0)
        return F.when(value >= GRID_FLOOR, F.least(F.floor(F.log(value / GRID_FLOOR) / math.log(GRID_STEP)), F.lit(GRID_TOP))).otherwise(-1).cast("int")

    each = F.array(*[F.struct(F.lit(name).alias("rule"), bucket(ratio).alias("bucket")) for name, ratio in RULES.items()])
    return m.select(*keep, F.explode(each).alias("x")).select(*keep, "x.rule", "x.bucket")


def cutoffs(m: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, strata: int = len(STRATA) + 1, price: float = 5.0) -> DataFrame:
    """At most strata x rules rows (stratum, rule, cutoff, good, rejected_good, rejected_bad, bound): reject at buckets >= cutoff.

    Among certified cutoffs the one with most rejected bad less ``price`` times rejected good documents is taken, the most lenient on ties; none is
    taken where no certified cutoff gains. Each distinct text of a stratum counts once, with the label of its smallest doc_id (the smallest label, where
    that has several); null labels do not count.
    """
    limit, level = alpha / len(RULES), delta / (strata * len(RULES))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    counts = [c for c in m.columns if c in _needed()]
    # copies of a text are one trial of the test, not many
    seen = m.join(known, "doc_id").groupBy("stratum", "mark").agg(F.min(F.struct("doc_id", "quality", *counts)).alias("x"))
    seen = seen.select("stratum", "x.*").groupBy("stratum", "quality", *counts).agg(F.count("*").alias("weight"))
    good, bad = F.when(F.col("quality") == 1, F.col("weight")).otherwise(0), F.when(F.col("quality") == 0, F.col("weight")).otherwise(0)
    grid = _buckets(seen, ["stratum", "quality", "weight"]).groupBy("stratum", "rule", "bucket").agg(F.sum(good).alias("g"), F.sum(bad).alias("b"))
    each = W.partitionBy("stratum", "rule")
    down = each.orderBy(F.col("bucket").desc())
    grid = grid.select("stratum", "rule", "bucket", F.sum("g").over(each).alias("good"), F.sum("g").over(down).alias("rejected_good"), F.sum("b").over(down).alias("rejected_bad")).where("bucket >= 0")
    tested = grid.withColumn("bound", binomial_tail(F.col("rejected_good"), F.col("good"), limit))
    tested = tested.withColumn("worst", F.max("bound").over(down)).where(F.col("worst") <= level)
    gain = F.col("rejected_bad") - price * F.col("rejected_good")
    best = tested.withColumn("gain", gain).where("gain > 0").withColumn("rank", F.row_number().over(each.orderBy(F.col("gain").desc(), F.col("bucket").desc())))
    return best.where("rank = 1").select("stratum", "rule", F.col("bucket").alias("cutoff"), "good", "rejected_good", "rejected_bad", "bound")


def _needed() -> set[str]:
    return {x.strip() for ratio in RULES.values() for x in ratio.split("/")}


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts of every document, ``base_failed`` and ``kept``.

    Strata are the four languages and all others together (null too), a fixed number, so the table of cutoffs has a fixed size and is broadcast.
    Without labels nothing is certified and only the base decides. Repeated rows are judged alike; rows without a doc_id are left out.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    m = materialise(measures(docs, F.when(lang.isin(*STRATA), lang).otherwise("other")), "measures")
    cut = cutoffs(m, labels, alpha, delta)
    wide = cut.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    scored = m.join(F.broadcast(wide), "stratum", "left")
    fail = F.lit(False)
    for name, ratio in RULES.items():
        over, under = (F.col(x.strip()) for x in ratio.split("/"))
        value = F.when(under > 0, over / under).otherwise(0.0)
        bucket = F.when(value >= GRID_FLOOR, F.least(F.floor(F.log(value / GRID_FLOOR) / math.log(GRID_STEP)), F.lit(GRID_TOP))).otherwise(-1)
        fail = fail | F.coalesce(bucket >= F.col(f"cut_{name}"), F.lit(False))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~fail).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; columns as they were.

    Null and empty texts have no words and go, as do rows without a doc_id; rows that repeat a doc_id stay if one of them passes. An empty table gives an
    empty one.
    """
    verdict = judge(docs, table(spark, sf_dir, "labels")).where("kept").select(F.col("doc_id").alias("passed")).distinct()
    return docs.join(verdict, docs["doc_id"].cast("long") == verdict["passed"], "left_semi")
