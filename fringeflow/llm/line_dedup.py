"""Line dedup by distinct-site spread.

Each line's sites are held in a HyperLogLog sketch per line hash, merged by
aggregation. Lines whose estimate lies near the threshold get exact distinct
counts. Lines on at least ``sites`` sites are boilerplate and go everywhere but
at their first place (smallest doc_id, then line number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spare, table

SITES, MIN_WORDS, LG_K = 5, 1, 10


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    # one regexp a text, which matches only white space that changes; a filter would otherwise run it again for each use of the line
    even = F.regexp_replace(F.col("text").cast("string"), r"\x20[\x20\x09\x0B-\x0D]+|[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*", " ")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), even.alias("text"))
    d = d.where("doc_id is not null and text is not null").select("doc_id", "th", "site", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    d = d.select("doc_id", "th", "site", "line_no", F.trim("line").alias("k"))
    # replace() searches bytes, where translate() looks up each character
    d = d.where((F.col("k") != "") & (F.octet_length("k") - F.octet_length(F.replace("k", F.lit(" "), F.lit(""))) >= min_words - 1)) if min_words > 1 else d.where(F.col("k") != "")
    return d.select("doc_id", "th", "site", "line_no", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k", F.length("k")).alias("h2"))


def boilerplate(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """Occurrences (doc_id, th, line_no, h1, h2, first_doc) of lines on at least ``sites`` distinct sites; a null site is one site of its own.

    Lines whose estimate clears the threshold by three standard errors are taken as they are; for those within that margin the sites among their
    occurrences are counted.
    """
    margin = 3 * 1.04 / 2 ** (lg_k / 2)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    spread = spread.where(F.col("n") >= sites).select("h1", "h2", "first_doc", F.hll_sketch_estimate("sketch").alias("about"))
    spread = materialise(spread.where(F.col("about") >= sites * (1 - margin)), "spread")
    found = lines.join(spread.withColumn("near", F.col("about") <= sites * (1 + margin)).drop("about"), ["h1", "h2"])
    found = materialise(found, "found")
    exact = found.where("near").groupBy("h1", "h2", "site").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    common = found.where("near").join(exact.where(F.col("exact") >= sites).select("h1", "h2"), ["h1", "h2"], "left_semi")
    return found.where("not near").unionByName(common).select("doc_id", "th", "line_no", "h1", "h2", "first_doc")


def strip(docs: DataFrame, site: str = "source", sites: int = SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K, counts: tuple[str, str] = ("all_lines", "removed_lines")) -> DataFrame:
    """All of docs' columns, ``text`` without boilerplate lines, and two columns (long) named ``counts``: all lines and removed ones.

    Lines are split at \\n and compared with white space runs as one space; lines without a word, or of fewer than ``min_words``, always stay. Null texts stay null,
    empty ones empty. Repeated rows (same doc_id and text) are treated alike. Rows without a doc_id pass unchanged. Other columns pass as they are, whatever
    their names; ``counts`` must be new ones.
    """
    if {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{counts}: columns of the documents already")
    hits = boilerplate(_lines(docs, site, min_words), sites, lg_k)
    # a document's own lines: only the first place in the first document stays
    per_line = hits.groupBy("doc_id", "th", "h1", "h2").agg(F.min("line_no").alias("least"), F.min("first_doc").alias("first_doc"), F.collect_set("line_no").alias("at"))
    gone = F.when(F.col("doc_id") == F.col("first_doc"), F.array_except("at", F.array("least"))).otherwise(F.col("at"))
    doc, th, at = spare(docs, "_doc"), spare(docs, "_th"), spare(docs, "_gone")
    gone = per_line.select(F.col("doc_id").alias(doc), F.col("th").alias(th), gone.alias("at")).groupBy(doc, th).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias(at))
    joined = docs.join(gone, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left")
    kept = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x, i: ~F.array_contains(at, i))
    hit = F.size(F.coalesce(at, F.array().cast("array<int>"))) > 0
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text"))}
    every = F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    return joined.select(*[v.alias(c) for c, v in out.items()], every.cast("long").alias(counts[0]), F.when(hit, F.size(at)).otherwise(0).cast("long").alias(counts[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    out = strip(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("all_lines").alias("n_lines"), F.col("removed_lines").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {docs}
), k AS (
  SELECT *, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS k FROM l
), c AS (
  SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(source, '')) >= 5
), f AS (
  SELECT k.doc_id, k.line_no, k.line, c.k IS NOT NULL AND row_number() OVER (PARTITION BY k.k ORDER BY k.doc_id, k.line_no) > 1 AS gone FROM k LEFT JOIN c ON c.k = k.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
""".format(docs="documents")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; n_chars follows the text.

    Nulls, empty texts, repeated rows and other columns are treated as in ``strip``; an empty table gives an empty one.
    """
    counts = spare(docs, "all_lines"), spare(docs, "removed_lines")
    out = strip(docs, counts=counts).drop(*counts)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
