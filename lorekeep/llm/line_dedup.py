"""Line dedup, in DataFrame operations only.

A line's key is the line without blanks at its ends and with A-Z in lower case; keys of fewer than ten
characters are never duplicates. Key hashes (128 bits) are range-partitioned together with a salt of the
document, sorted by document and position inside, and read in order: whatever follows the first document of
its group is dropped at once. Only the first documents of each group, one row per key and salt, meet again
to settle which of them is the first of all; so one key may hold any share of the lines. Text is not moved
for it. What comes back per document is its keep bitmap, coded as runs.

A null or empty text is one empty line. Rows without an id count as one document after all others. Rows of
the same id are one document: their lines are never dropped for each other, so repeated rows repeat their results.
A tie cannot arise: the smallest id that holds a key keeps all its lines. Very long texts are split whole. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read; other columns may have any name and are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import BLANKS, documents, identity, stored

SHORTEST = 10
SALTS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(BLANKS))
    # lower() also changes letters beyond A-Z; where there are none it is the faster of the two
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _version(text: Column) -> Column:
    """Rows of one id that differ in text have bitmaps of their own."""
    return F.xxhash64(text)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(d, v, pos) of the lines to drop; d is the document, v its text's hash, pos counts from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(identity().alias("d"), _version(text).alias("v"), F.posexplode(F.split(text, "\n")))
    keyed = lines.select("d", "v", "pos", line_key(F.col("col")).alias("key"))
    hashed = keyed.filter(F.char_length("key") >= SHORTEST).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
        F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("smallint").alias("salt"),
        "d",
        "v",
        "pos",
    )
    group = ["h1", "h2", "salt"]
    ranged = stored(hashed, "line-keys").repartitionByRange(*group)
    order = Window.partitionBy(*group).orderBy("d", "v", "pos")
    streamed = ranged.withColumn("first", F.first("d").over(order))
    later = streamed.filter("d > first").select("d", "v", "pos")
    firsts = streamed.filter("d = first").groupBy(*group, "d", "v").agg(F.collect_list("pos").alias("at"))
    settled = firsts.withColumn("keeper", F.min("d").over(Window.partitionBy("h1", "h2")))
    lost = settled.filter("d > keeper").select("d", "v", F.explode("at").alias("pos"))
    return later.unionByName(lost)


def drop_runs(docs: DataFrame) -> DataFrame:
    """(d, v, runs): per document with losses its dropped runs (start, len), in order."""
    order = Window.partitionBy("d", "v").orderBy("pos")
    marked = dropped_lines(docs).withColumn("run", F.col("pos") - F.dense_rank().over(order))
    runs = marked.groupBy("d", "v", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("last"))
    item = F.struct("start", (F.col("last") - F.col("start") + 1).alias("len"))
    return runs.groupBy("d", "v").agg(F.array_sort(F.collect_list(item)).alias("runs"))


def _keep_runs(runs: Column, n: Column) -> Column:
    """The runs between the dropped ones; only those with lines."""
    begin = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["len"]))
    end = F.concat(F.transform(runs, lambda r: r["start"]), F.array(n))
    spans = F.transform(
        F.arrays_zip(begin.alias("start"), end.alias("end")),
        lambda s: F.struct(s["start"].alias("start"), (s["end"] - s["start"]).alias("len")),
    )
    return F.filter(spans, lambda s: s["len"] > 0)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """Every row as (_row, n_lines, n_dropped, keep): keep is the run-coded bitmap of the lines that stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), identity().alias("d"), _version(text).alias("v"))
    joined = rows.join(drop_runs(docs), ["d", "v"], "left")
    n = F.size(F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n"))
    none = F.array().cast("array<struct<start:int,len:int>>")
    return (
        joined.withColumn("n_lines", n)
        .withColumn("runs", F.coalesce("runs", none))
        .select(
            "_row",
            F.col("n_lines").cast("bigint").alias("n_lines"),
            F.aggregate("runs", F.lit(0), lambda total, r: total + r["len"]).cast("bigint").alias("n_dropped"),
            _keep_runs(F.col("runs"), F.col("n_lines")).alias("keep"),
        )
    )


def kept_text(text: Column, keep: Column, n_dropped: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    parts = F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["len"]))
    return F.when(n_dropped == 0, whole).otherwise(F.array_join(F.flatten(parts), "\n"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated lines taken out of the text; a null text stays null."""
    kept = keep_bitmaps(docs).select(
        "_row", kept_text(F.col("_row.text"), F.col("keep"), F.col("n_dropped")).alias("_kept")
    )
    names = {
        "text": F.when(F.col("_row.text").isNotNull(), F.col("_kept")),
        "n_chars": F.when(F.col("_row.text").isNotNull(), F.char_length("_kept")).cast("bigint"),
    }
    return kept.select(*(names.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep_bitmaps(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(kept_text(F.col("_row.text"), F.col("keep"), F.col("n_dropped")), 256).alias("kept_sha256"),
    )


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{UPPER.lower()}') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= {SHORTEST}
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND k.doc_id <> s.keeper AS lost
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
