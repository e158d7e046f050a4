"""Merkle manifest of a dataset, with a proof for every row.

Each source is a tree over its rows by doc_id, and the sources are the leaves
of a tree above. Nodes are joined in runs of ``FAN`` until one is left.

1. Rows are hashed where they lie; only digests move on. A distributed sort
   numbers them, so that no source has to fit in a task.
2. Trees grow ``STEP`` levels at a time: a group of ``FAN ** STEP`` neighbours
   makes all its nodes. The nodes are stored in one table, by coordinate (the
   number of the first leaf below, and the level).
3. From its place and the size of its tree, a leaf works out the coordinates of
   the siblings on its way to the root. They are exploded, joined to the table
   of nodes, put in order again, concatenated for the digest of the proof, and
   folded with the leaf for the root.

Nodes near a root are asked for by a large share of all leaves; those are of
bounded number and broadcast. The others are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import left_join_by_size, load
from pricewright.session import materialize

FAN = 3
#: Levels that one group makes: it holds ``FAN ** STEP`` nodes.
STEP = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels of the tree over sources are numbered from here; a long has fewer than 40 powers of three.
TOP = 64
LEVELS = 2 * TOP
#: Tampering with even checksums only deletes line ends.
EVERY = 2

POWERS = [FAN**i for i in range(40)]


def _powers() -> Column:
    return F.array(*(F.lit(p).cast("long") for p in POWERS))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its value; ``-`` for null."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the whole order; a distributed sort, nulls first."""
    local = 33  # bits that number the rows of a partition in monotonically_increasing_id
    held = materialize(rows.sort(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part, inner = F.shiftright("_id", local), F.col("_id") % (1 << local)
    sizes = sorted(tuple(r) for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())  # a row for each partition
    starts, done = [], 0
    for number, n in sizes:
        starts.append((number, done))
        done += n
    table = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return held.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn("at", F.col("_start") + inner).drop("_part", "_start", "_id")


def _up(level: Column) -> Column:
    """The level above: digests of runs, and the leaves below them."""

    def node(j: Column) -> Column:
        run = F.slice(level, j * FAN + 1, FAN)
        text = F.array_join(F.transform(run, lambda x: F.lower(F.hex(x["digest"]))), "")
        return F.struct(F.unhex(F.sha2(text, 256)).alias("digest"), F.aggregate(run, F.lit(0).cast("long"), lambda s, x: s + x["under"]).alias("under"))

    return F.transform(F.sequence(F.lit(0), _div(F.size(level) - 1, FAN).cast("int")), node)


def node_table(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees over ``leaves`` (tree, pos, n, digest, under): tree, level, pos, digest, root, demand.

    ``demand`` is the number of leaves below the node's run, at least as many as ask for it.
    """
    block, stored, base = FAN**STEP, [], 0
    while True:
        grouped = leaves.groupBy("tree", _div(F.col("pos"), block).alias("block")).agg(
            F.max("n").alias("n0"), F.array_sort(F.collect_list(F.struct("pos", "digest", "under"))).alias("held")
        )
        rows = grouped.select("tree", "block", "n0", F.transform("held", lambda x: F.struct(x["digest"].alias("digest"), x["under"].alias("under"))).alias("l0"))
        for k in range(1, STEP + 1):
            n = F.col(f"n{k - 1}")
            rows = rows.withColumn(f"n{k}", _div(n + FAN - 1, FAN)).withColumn(f"l{k}", F.when(n > 1, _up(F.col(f"l{k - 1}"))))
        rows = materialize(rows, "tree-blocks")
        for k in range(STEP):
            each = rows.where(F.col(f"l{k}").isNotNull()).select("tree", "block", F.col(f"n{k}").alias("n"), F.col(f"l{k + 1}").alias("up"), F.posexplode(f"l{k}").alias("i", "node"))
            above = F.get(F.col("up"), _div(F.col("i"), FAN).cast("int"))["under"]
            stored.append(
                each.select(
                    "tree", F.lit(base + k).alias("level"), (F.col("block") * FAN ** (STEP - k) + F.col("i")).alias("pos"), F.col("node.digest").alias("digest"),
                    (F.col("n") == 1).alias("root"), F.coalesce(above, F.col("node.under")).alias("demand"),
                )
            )
        base += STEP
        left = rows.where(F.col(f"l{STEP}").isNotNull()).select("tree", F.col("block").alias("pos"), F.col(f"n{STEP}").alias("n"), F.explode(f"l{STEP}").alias("node"))
        leaves = left.select("tree", "pos", "n", F.col("node.digest").alias("digest"), F.col("node.under").alias("under"))
        if leaves.isEmpty():
            break
    nodes = stored[0]
    for more in stored[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _code(level: Column, first: Column) -> Column:
    """A coordinate as one number: levels below the first leaf."""
    return first * LEVELS + level


def _steps(i: Column, n: Column, start: Column, top: int) -> Column:
    """(level, first leaf) of a leaf's own nodes below the root, from the bottom."""
    return F.transform(F.filter(_powers(), lambda p: p < n), lambda p, k: F.struct((k + top).cast("long").alias("level"), (start + _div(i, p) * p).alias("first")))


def _siblings(i: Column, n: Column, start: Column, top: int) -> Column:
    """Coordinates of the other nodes of each run on the way to the root."""

    def of(p: Column, k: Column) -> Column:
        own = _div(i, p)
        places = F.filter(F.transform(F.array(*map(F.lit, range(FAN))), lambda j: _div(own, FAN) * FAN + j), lambda x: (x != own) & (x * p < n))
        return F.transform(places, lambda x: _code((k + top).cast("long"), start + x * p))

    return F.flatten(F.transform(F.filter(_powers(), lambda p: p < n), of))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: F.lower(F.hex(x["digest"]))), "")


def _folded(digest: Column, steps: Column, siblings: Column) -> Column:
    """The root that ``digest`` leads to."""

    def step(held: Column, own: Column) -> Column:
        run = F.filter(siblings, lambda x: x["level"] == own["level"])
        left, right = (_joined(F.filter(run, test)) for test in (lambda x: x["first"] < own["first"], lambda x: x["first"] > own["first"]))
        return F.sha2(F.concat(left, held, right), 256)

    return F.aggregate(steps, digest, step)


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings.

    A row's leaf is the digest of ``FIELDS``. ``tampered`` is the text that the
    verifier holds instead of ``text`` (by default the same): folded_root is
    what its leaf and the original siblings lead to, verified whether that is
    root. A null source is a source of its own, before all others; null
    doc_ids come first in their source; repeated rows are leaves of their own,
    next to each other; an empty table has no rows and no root. Extra columns
    are ignored.
    """
    text = F.col("text") if tampered is None else tampered
    own = [F.col(c) for c in FIELDS]
    first = leaf(own)
    rows = docs.select("doc_id", "source", F.unhex(first).alias("leaf"), F.when(~text.eqNullSafe(F.col("text")), F.unhex(leaf([*own[:-1], text]))).alias("other"))
    rows = numbered(materialize(rows, "leaves"), "source", "doc_id", "leaf")
    rows = rows.withColumn("named", F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")))
    sources = rows.groupBy("named").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    sources = materialize(numbered(sources, "start").withColumnRenamed("at", "s"), "sources")
    n_rows, n_sources = rows.count(), sources.count()
    placed = materialize(left_join_by_size(rows, sources, "named", "n", n_rows).drop("named", "source"), "placed")

    below = node_table(placed.select(F.col("start").alias("tree"), (F.col("at") - F.col("start")).alias("pos"), "n", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("under")))
    below = materialize(below, "nodes")
    subroots = below.where("root").join(sources, F.col("tree") == F.col("start"))
    above = node_table(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("s").alias("pos"), F.lit(n_sources).cast("long").alias("n"), "digest", F.col("n").alias("under")))
    above = materialize(above, "top-nodes")
    root = above.where("root").select(F.lower(F.hex("digest"))).first()
    root = F.lit(root[0] if root else None).cast("string")

    power = lambda level: F.get(_powers(), level.cast("int"))
    code = lambda df, top: df.select(_code(F.col("level").cast("long") + top, F.col("tree") + F.col("pos") * power(F.col("level"))).alias("code"), "digest", "demand")
    nodes = code(below, 0).unionByName(code(above, TOP))

    i, n, s = F.col("at") - F.col("start"), F.col("n"), F.col("s")
    top = (s, F.lit(n_sources).cast("long"), F.lit(0).cast("long"), TOP)
    wanted = F.concat(_siblings(i, n, F.col("start"), 0), _siblings(*top), F.array(_code(F.lit(TOP).cast("long"), s)))
    asked = placed.select("at", F.explode(wanted).alias("code"))
    got = left_join_by_size(asked, nodes, "code", "demand", n_rows)
    sibling = F.struct((F.col("code") % LEVELS).alias("level"), _div(F.col("code"), LEVELS).alias("first"), "digest")
    own_row = F.struct("doc_id", "leaf", "other", "start", "n", "s")
    both = placed.select("at", own_row.alias("own"), F.lit(None).cast(f"struct<level:bigint,first:bigint,digest:binary>").alias("node"))
    both = both.unionByName(got.select("at", F.lit(None).cast(both.schema["own"].dataType).alias("own"), sibling.alias("node")))
    proofs = both.groupBy("at").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("node")).alias("held"))

    is_own = lambda x: (x["level"] == TOP) & (x["first"] == F.col("own.s"))
    proofs = proofs.select(
        "at", "own.*", F.filter("held", is_own)[0]["digest"].alias("subroot"), F.filter("held", lambda x: ~is_own(x)).alias("siblings")
    )
    hexed = lambda c: F.lower(F.hex(c))
    steps = F.concat(_steps(i, n, F.col("start"), 0), _steps(*top))
    out = proofs.select(
        "doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        root.alias("root"),
        F.sha2(_joined(F.col("siblings")), 256).alias("proof_sha256"),
        _folded(hexed(F.coalesce("other", "leaf")), steps, F.col("siblings")).alias("folded_root"),
        F.size("siblings").alias("n_siblings"),
    )
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "n_siblings")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", *FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string")) % EVERY == 0  # rows without doc_id stay
    tampered = F.when(touched, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(docs, tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: crc32 of a list of bytes, as DuckDB SQL over a row with ``tab``, the 256 remainders.
CRC_TABLE = "SELECT [list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FOR c IN range(256)] AS tab"


def crc_sql(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def _sql() -> str:
    part = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"
    digest = lambda text: f"sha256({' || '.join(map(part, [*FIELDS[:-1], text]))})"
    data = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)"
    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {crc_sql(data)} % {EVERY} = 0 THEN replace(text, chr(10), '') ELSE text END AS held FROM documents, crc),
l AS (
  SELECT doc_id, source, leaf, other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM (SELECT doc_id, source, {digest('text')} AS leaf, {digest('held')} AS other FROM d)
), t(s, lev, pos, n, h) AS (
  SELECT s, 0::BIGINT, pos, n, leaf FROM l
  UNION ALL SELECT s, lev + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY s, lev, pos // {FAN}, n
), top(lev, pos, n, h) AS (
  SELECT {TOP}::BIGINT, s, (SELECT count(DISTINCT s) FROM l), h FROM t WHERE n = 1
  UNION ALL SELECT lev + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lev, pos // {FAN}, n
), nodes AS (SELECT * FROM t UNION ALL SELECT -1, * FROM top),
up(doc_id, s, lev, pos, n, h, proof) AS (
  SELECT doc_id, s, 0::BIGINT, pos, n, other, '' FROM l
  UNION ALL SELECT u.doc_id, u.s, u.lev + 1, u.pos // {FAN}, (u.n + {FAN - 1}) // {FAN}, sha256(string_agg(CASE WHEN x.pos = u.pos THEN u.h ELSE x.h END, '' ORDER BY x.pos)),
         any_value(u.proof) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos <> u.pos), '')
  FROM up u JOIN nodes x ON x.s = u.s AND x.lev = u.lev AND x.pos // {FAN} = u.pos // {FAN} WHERE u.n > 1 GROUP BY u.doc_id, u.s, u.lev, u.pos, u.n
), up2(doc_id, lev, pos, n, h, proof) AS (
  SELECT doc_id, {TOP}::BIGINT, s, (SELECT count(DISTINCT s) FROM l), h, proof FROM up WHERE n = 1
  UNION ALL SELECT u.doc_id, u.lev + 1, u.pos // {FAN}, (u.n + {FAN - 1}) // {FAN}, sha256(string_agg(CASE WHEN x.pos = u.pos THEN u.h ELSE x.h END, '' ORDER BY x.pos)),
         any_value(u.proof) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos <> u.pos), '')
  FROM up2 u JOIN top x ON x.lev = u.lev AND x.pos // {FAN} = u.pos // {FAN} WHERE u.n > 1 GROUP BY u.doc_id, u.lev, u.pos, u.n
)
SELECT l.doc_id, l.leaf, sub.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, up2.h AS folded_root, up2.h = r.h AS verified
FROM l JOIN t sub ON sub.s = l.s AND sub.n = 1 JOIN top r ON r.n = 1 JOIN up2 ON up2.doc_id = l.doc_id AND up2.n = 1
"""


OP12_SQL = _sql()
