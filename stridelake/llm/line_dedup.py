"""Line dedup in DataFrame operations: lines shared by several documents stay only in the first of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import ASCII_SPACE, is_null, order_id, table, whole_text, written


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    r"""Drops lines whose key of at least ``min_chars`` code points is in ``min_docs`` documents or more, but for the smallest id's.

    All columns of ``df`` are kept, the text holds the remaining lines joined by ``\n``, and ``n_lines`` and ``n_dropped``
    are added (an input column of such a name is replaced). Null and empty texts are one empty line. A null id is one more
    document after all others; rows that repeat an id are one document, in which a line stays wherever it stands. Texts of any length are split whole.

    Lines are exploded once: their keys' 128-bit hashes are a written table. Distinct documents of each hash are counted in two steps, by hash and
    document first, so a line of a third of all documents is counted by many tasks and arrives as one row per task. Shared hashes are written
    too, so that the join of lines with them has an exchange of its own on both sides and adaptive execution
    can split a hot line; the last join brings each document together with the positions it loses.
    """
    rows = df.withColumns({"__ld_id": order_id(id_col), "__ld_none": is_null(id_col), "__ld_text": whole_text(text_col)}).withColumn("__ld_row", F.xxhash64("__ld_text"))
    document = ["__ld_id", "__ld_none"]
    lines = rows.select(*document, "__ld_row", F.posexplode(F.split("__ld_text", "\n")).alias("__ld_pos", "__ld_line"))
    keys = written(
        lines.select(*document, "__ld_row", "__ld_pos", line_key(F.col("__ld_line")).alias("__ld_key"))
        .where(F.char_length("__ld_key") >= min_chars)
        .select(*document, "__ld_row", "__ld_pos", F.xxhash64("__ld_key").alias("__ld_h1"), F.xxhash64(F.lit(1), "__ld_key").alias("__ld_h2"))
    )
    by = ["__ld_h1", "__ld_h2"]
    holders = keys.select(*by, *document).distinct()
    shared = holders.groupBy(*by).agg(F.min("__ld_id").alias("__ld_first"), F.min("__ld_none").alias("__ld_first_none"), F.count("*").alias("__ld_n"))
    shared = shared.where(F.col("__ld_n") >= min_docs).drop("__ld_n")
    first = (F.col("__ld_id") == F.col("__ld_first")) & (F.col("__ld_none") == F.col("__ld_first_none"))
    lost = keys.join(written(shared), by).where(~first).groupBy(*document, "__ld_row").agg(F.collect_set("__ld_pos").alias("__ld_lost"))
    split = F.split("__ld_text", "\n")
    n_lost = F.coalesce(F.size("__ld_lost"), F.lit(0))
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__ld_lost"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("__ld_split"), i)), "\n")
    out = rows.join(lost, [*document, "__ld_row"], "left").withColumn("__ld_split", split)
    out = out.withColumns({
        "n_lines": F.size("__ld_split").cast("long"),
        "n_dropped": F.when(F.col("__ld_lost").isNull(), 0).otherwise(n_lost).cast("long"),
        text_col: F.when(F.col("__ld_lost").isNull(), F.col("__ld_text")).otherwise(kept),
    })
    return out.drop(*[c for c in out.columns if c.startswith("__ld_")])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every document; see :func:`dedup_lines` for nulls, empty texts, ties and repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_KEY = r"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup_ctes(source: str) -> str:
    """Common table expressions of DuckDB that end in ``deduped(doc_id, text, n_lines, n_dropped)``."""
    return f"""
split_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {source}),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM split_lines),
shared AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first_id AS lost FROM keyed k LEFT JOIN shared s ON k.key = s.key),
deduped AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS text,
         count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped
  FROM marked GROUP BY doc_id)"""


OP2_SQL = f"WITH {line_dedup_ctes('documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped"
