"""Removal of lines that too many documents share.

Lines are normalised (trimmed, lower-cased, runs of white space made one blank), hashed,
and the distinct documents of each hash are counted; lines of a hash in more than
``max_docs`` documents are dropped everywhere, and what remains of each text is put
together again by position. All of it stays in the JVM. The hashes of each row's lines are
written once; they and their positions are shuffled for the counts, each task's own pairs of
line and document made distinct first, and the texts once for the reassembly.

Defined results for odd input: a null text stays null with no lines; an empty text has
one empty line; lines without any character after trimming are never dropped; rows of
the same doc_id are one document in the counts and each row is cleaned; rows without
doc_id are cleaned but count for no document; texts of any length and number of lines are
cleaned whole, in time linear in their lines; an empty table gives an empty result;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_DOCS = 5


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def remove_common_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, text without the lines that more than ``max_docs`` documents have, n_lines, n_dropped."""
    rows, row = common.with_row_id(common.fixed(docs.select("doc_id", "text")))
    hashes = F.transform(F.transform(_lines(F.col("text")), _normal), lambda x: F.when(x != "", F.xxhash64(x)))
    hashed = common.saved(rows.where("text IS NOT NULL").select(row, "doc_id", hashes.alias("hashes")), "lines")
    parts = hashed.select(row, "doc_id", F.posexplode("hashes").alias("at", "hash")).where("hash IS NOT NULL")
    hot = parts.where("doc_id IS NOT NULL").select("hash", "doc_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("hash")
    drops = parts.select("hash", row, "at").join(hot, "hash", "left_semi").groupBy(row).agg(F.sort_array(F.collect_list("at")).alias("at"))
    # a flag for each line up to the last that is dropped: as many false as lie between two that are
    before = F.concat(F.array(F.lit(-1)), F.slice("at", 1, F.size("at") - 1))
    flags = F.flatten(F.zip_with(before, "at", lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))))
    drops = drops.select(F.col(row), flags.alias("__flags"), F.size("at").cast("long").alias("__n"))
    joined = rows.join(drops.hint("shuffle_hash"), row, "left")
    kept = F.array_join(F.filter(_lines(F.col("text")), lambda _, i: ~F.coalesce(F.get("__flags", i), F.lit(False))), "\n")
    return joined.select(
        "doc_id", F.when(F.col("__n").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_common_lines(common.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM rows
),
normal AS (
  SELECT r, doc_id, pos, line, lower(trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g'))) AS norm FROM lines
),
hot AS (
  SELECT norm FROM normal WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > {MAX_DOCS}
),
marked AS (
  SELECT n.*, n.norm IN (SELECT norm FROM hot) AS dropped FROM normal n
),
again AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) AS text, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
  FROM marked GROUP BY r
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.text, '') END AS text,
  coalesce(a.n_lines, 0)::BIGINT AS n_lines, coalesce(a.n_dropped, 0)::BIGINT AS n_dropped
FROM rows d LEFT JOIN again a USING (r)
"""
