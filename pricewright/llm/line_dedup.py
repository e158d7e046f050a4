"""Line deduplication over range-partitioned hashes; whole texts are never moved.

1. Each line long enough becomes two 64-bit hashes of its key, with document
   and position. A sketch of the hashes names the few that more than a
   ``SHARE``-th of all lines may have.
2. The other hashes are range-partitioned with documents and positions sorted
   behind them; a pass over each run sees which document comes first (the
   largest id, or the smallest) and whether enough documents follow.
3. Frequent hashes would make a run of millions of rows. They are decided by
   partial aggregation instead, and the decisions, of bounded number, broadcast.
4. Dropped positions become bitmaps by ``or`` in words of ``WORD`` lines. A
   document's bitmap holds only the words in which a line goes.

All steps are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.common import SHARE, load, row_key
from pricewright.session import materialize

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Lines that one word of a bitmap stands for.
WORD = 64
#: Counters of the sketch; it surely holds what more than a ``SHARE``-th of the lines have.
TRACKED = 1 << 16
#: No hash of fewer lines is treated as frequent.
FEW = 2000


def line_table(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, key, pos, h1, h2) of each line whose key has at least ``least_chars`` code points."""
    text = F.coalesce("text", F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    keyed = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    lines = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.posexplode(F.split(keyed, "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(WHITE))
    rows = lines.select("doc_id", "key", "pos", line.alias("line")).where(F.char_length("line") >= least_chars)
    return rows.select("doc_id", "key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def frequent(lines: DataFrame, total: int) -> DataFrame:
    """(h1) of the hashes that more than a ``SHARE``-th of all lines may have: less than ``2 * SHARE`` rows."""
    top = lines.agg(F.expr(f"approx_top_k(h1, {2 * SHARE}, {TRACKED})").alias("top"))
    held = top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h1"), F.col("t.count").alias("n"))
    return held.where(F.col("n") > max(FEW, total // SHARE)).select("h1")


def _first(newest: bool) -> Column:
    return F.desc_nulls_last("doc_id") if newest else F.asc_nulls_last("doc_id")


def repeated_lines(lines: DataFrame, least_docs: int, newest: bool) -> DataFrame:
    """(doc_id, key, pos) of the lines that go. ``lines`` is read several times, so it should be stored."""
    hot = F.broadcast(materialize(frequent(lines, lines.count()), "frequent-lines"))
    rows = lines.join(hot, "h1", "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", _first(newest), "pos")
    run = Window.partitionBy("h1", "h2")
    ranked = rows.withColumn("rank", F.dense_rank().over(run.orderBy(_first(newest))))
    ranked = ranked.withColumn("n_docs", F.max("rank").over(run))
    gone = ranked.where((F.col("n_docs") >= least_docs) & (F.col("rank") > 1))

    often = lines.join(hot, "h1")
    by_doc = often.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))  # as many rows as documents, in all tasks
    first = F.max("doc_id") if newest else F.min("doc_id")  # null only where no row has an id
    decided = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), first.alias("first")).where(F.col("n_docs") >= least_docs)
    known = F.broadcast(materialize(decided.select("h1", "h2", "first"), "frequent-decisions"))
    gone_often = often.join(known, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.select("doc_id", "key", "pos").unionByName(gone_often.select("doc_id", "key", "pos"))


def line_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, newest: bool = True) -> DataFrame:
    """(doc_id, key, n_dropped, keep) of the documents that lose lines.

    A line's key is the line without ASCII white space at both ends and with A-Z
    in lower case. Keys of at least ``least_chars`` code points in at least
    ``least_docs`` documents stay in one document only, that of the largest
    doc_id (``newest``) or the smallest. ``keep`` is a compressed bitmap: words
    of ``WORD`` lines in order, each with its number and a bit for each line;
    words that keep all their lines are left out.

    Rows that share a doc_id are one document, and so are rows without one,
    which come last. Documents are told apart by doc_id and ``key``, a hash of
    doc_id and text (see ``row_key``). Null and empty texts are one empty line.
    """
    lines = materialize(line_table(docs.select("doc_id", "text"), least_chars), "line-hashes")
    gone = repeated_lines(lines, least_docs, newest)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD).cast("int"))
    words = gone.groupBy("doc_id", "key", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(one).alias("drop"))
    held = words.groupBy("doc_id", "key").agg(
        F.sum(F.bit_count("drop")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits")))).alias("keep"),
    )
    return materialize(held, "keep-bitmaps")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), use)[0]


def _kept_lines(text: Column, keep: Column) -> Column:
    lines = F.split(text, "\n")
    words = F.expr(f"(size(split(coalesce(text, ''), '\n')) - 1) div {WORD}").cast("int")
    held = F.map_from_entries(keep)
    whole = _let(held, lambda m: F.transform(F.sequence(F.lit(0), words), lambda w: F.coalesce(F.element_at(m, w), F.lit(-1).cast("long"))))
    bit = lambda d, i: F.call_function("getbit", F.get(d, F.call_function("div", i, F.lit(WORD)).cast("int")), i % WORD)
    return _let(whole, lambda d: F.array_join(F.filter(lines, lambda line, i: bit(d, i) == 1), "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text; its other columns stay, apart from clashing names."""
    held = bitmaps.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("n_dropped").alias("_n"), "keep")
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text", "keep", "_id", "_key", "_n")]
    rows = docs.select(*rest)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (row_key("doc_id", "text") == F.col("_key"))
    text = F.coalesce("text", F.lit(""))
    return rows.join(held.hint("shuffle_hash"), same, "left").select(
        *rest,
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), text).otherwise(_kept_lines(text, F.col("keep"))).alias("kept_text"),
    )


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, newest: bool = True) -> DataFrame:
    """One row per document with the lines that stay; see ``line_bitmaps``."""
    return apply_bitmaps(docs, line_bitmaps(docs, least_chars, least_docs, newest))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(load(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, trim(translate(ls[i], '{UPPER}', '{LOWER}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), r AS (SELECT key, max(doc_id) AS stays FROM l WHERE length(key) >= {LEAST_CHARS} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {LEAST_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE stays <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays IS NULL OR stays = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN r USING (key) GROUP BY doc_id
"""
