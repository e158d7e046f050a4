"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

1. Tasks count the words of their own texts; the counts are summed by word.
2. A word is cut into two even segments, which depend on its length. One edit
   leaves one of them as it is, at the front, or at the back shifted by what the
   other word is longer. So each word is indexed by both segments, and equally
   long and one letter longer words probe with the substrings at those places.
3. Where many words share a segment, what is left of them is cut in two again,
   and so on: both halves of the remainder again hold the edit or don't. Groups
   of any size come down to words that differ in one place only, so their pairs
   are links. No group is capped.
4. Candidates are verified to be one edit apart, and found twice count once.
5. Every word points to its most frequent neighbour, if that is frequent enough;
   pointers are doubled until all have reached their root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import chunks, load, pieces, raw, values
from pricewright.llm.merkle_manifest import CRC_TABLE, crc_sql
from pricewright.session import materialize

LEAST_CHARS, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word.
RATIO = 2
#: One in so many runs of a document, by checksum, has a code point deleted.
DAMAGE = 97
#: Pairs in a group beyond which its words are cut again.
PAIRS = 1 << 14
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(least: int, damage: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for part in chunks(batch):
                for doc, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), raw(part)):
                    own: Counter = Counter()
                    for piece in pieces(text.translate(LOWER)):
                        own.update(RUN.findall(piece.decode("utf-8", "replace")))
                    start = zlib.crc32(b"%d:" % doc) if damage and doc is not None else None
                    for word, n in own.items():
                        if len(word) < least:
                            continue
                        if start is not None and not (h := zlib.crc32(word.encode(), start)) % damage:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    return run


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` code points and ``least_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower
    case. With ``damage`` some lose a code point first, as a checksum of doc_id
    and run says; rows without a doc_id are left as they are. Null and empty
    texts have no words; rows that share a doc_id are each counted.
    """
    counted = docs.select("doc_id", "text").mapInArrow(_words(least_chars, damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _key(lo: Column, hi: Column, shift: Column | int) -> Column:
    """What stands before and behind the part of a word in which the edit is; ``shift``: letters it is longer than the indexed one."""
    before = F.substring(F.col("word"), F.lit(1), lo)
    behind = F.substring(F.col("word"), hi + shift + 1, F.col("l"))
    return F.xxhash64("l", lo, hi, before, behind)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the edit in the second half of its part, and with the edit in the first."""
    middle = F.col("lo") + F.expr("(hi - lo) div 2")
    ends = F.explode(F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi"))))
    cut = rows.select("word", "n", "shift", "probe", "l", ends.alias("e")).select("word", "n", "shift", "probe", "l", "e.lo", "e.hi")
    return cut.withColumn("key", _key(F.col("lo"), F.col("hi"), F.col("shift")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of ``words`` one edit apart, once, the shorter or smaller one first."""
    size = F.char_length("word")
    index = words.select("word", "n", F.lit(0).alias("shift"), F.lit(False).alias("probe"), size.alias("l"))
    probe = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"), F.lit(True).alias("probe")).withColumn("l", size - F.col("shift"))
    rows = index.unionByName(probe).where("l > 0").withColumn("lo", F.lit(0)).withColumn("hi", F.col("l"))
    found = []
    while True:
        rows = materialize(_halves(rows), "segments")
        count = lambda probe: F.sum((F.col("probe") == F.lit(probe)).cast("long"))
        sizes = rows.groupBy("key").agg(count(False).alias("indexed"), count(True).alias("asked"), F.max(F.col("hi") - F.col("lo")).alias("left"))
        large = materialize(sizes.where((F.col("indexed") * F.col("asked") > PAIRS) & (F.col("left") > 1)).select("key"), "large-groups")
        few = rows.join(large, "key", "left_anti")
        one = few.where("not probe").select("key", "word", "n")
        two = few.where("probe").select("key", "shift", F.col("word").alias("near"), F.col("n").alias("near_n"))
        near = ((F.col("shift") == 1) | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1)
        found.append(materialize(one.join(two, "key").where(near).select("word", "n", "near", "near_n"), "near-words"))
        if large.isEmpty():
            break
        rows = rows.join(large, "key", "left_semi").drop("key")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Pointers double each round, so rounds are few."""
    held = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = materialize(jumped, "roots")
        held = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return held


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row for each of ``words`` (word, n): word, n, n_near, form, form_n, root.

    Words are near if one inserted, deleted or replaced code point makes one of
    the other. ``form`` is the near word of largest n (of equal ones the first in
    code-point order), if it occurs ``ratio`` times as often, ``root`` what one
    comes to by following forms. Without a form, form and form_n are null and
    root is the word.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    linked = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.n") >= F.col("n") * ratio
    linked = linked.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"))
    linked = materialize(linked, "forms")
    known = linked.join(roots(linked.where("form is not null")), "word", "left")
    return words.join(known, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(load(spark, sf_dir, "documents", "doc_id", "text"), damage=DAMAGE))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    data = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
    return rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
c AS (SELECT run, n, {crc_sql(data)} AS h FROM r, crc WHERE length(run) >= {LEAST_CHARS}),
w AS (
  SELECT word, sum(n)::BIGINT AS n, length(word) AS l
  FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM c)
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), x AS (SELECT word, n, l, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, l, unnest(generate_series(1, l)) AS i FROM w)),
one AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM x a JOIN w ON a.less = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM x a JOIN w ON a.less = w.word
), f AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM one GROUP BY word
), g AS (SELECT word, n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM f),
up(word, root, form) AS (
  SELECT word, word, form FROM g WHERE form IS NOT NULL
  UNION ALL SELECT up.word, up.form, g.form FROM up JOIN g ON g.word = up.form WHERE up.form IS NOT NULL
)
SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, g.form, g.form_n, coalesce(up.root, w.word) AS root
FROM w LEFT JOIN g USING (word) LEFT JOIN (SELECT word, root FROM up WHERE form IS NULL) up USING (word)
"""


OP11_SQL = _sql()
