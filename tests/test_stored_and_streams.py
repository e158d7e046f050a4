"""Stored relations that follow their inputs, and streams whose results don't depend on how files are split."""

import shutil
from datetime import datetime, timedelta
from random import Random

from pricewright.session import refresh, stored
from pricewright.streaming import jobs


def test_stored_relation_is_read_until_its_inputs_change(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(3).write.parquet(path)
    builds = []

    def read():
        return stored(spark, "test/view", lambda: builds.append(1) or spark.read.parquet(path), [path])

    assert (read().count(), read().count(), len(builds)) == (3, 3, 1)
    held = read()
    spark.range(5).write.mode("append").parquet(path)
    assert (read().count(), read().count(), len(builds)) == (8, 8, 2)
    assert held.count() == 3  # a reader that has begun keeps its rows
    assert refresh("test/view", spark.range(4), [path]).count() == 4 == read().count()


def test_stored_relation_survives_a_cleared_folder_and_drops_old_copies(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(3).write.parquet(path)
    own = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    read = lambda: stored(spark, "test/cleared", lambda: spark.read.parquet(path), [path])
    first = own(read())
    shutil.rmtree(first)
    assert read().count() == 3
    copies = [own(refresh("test/cleared", spark.range(n + 1), [path])) for n in range(3)]
    from pathlib import Path

    assert [Path(c).exists() for c in copies] == [False, True, True]


POINT = "product_id string, store_id string, seq long, at timestamp, cents long, currency string"


def split_stream(spark, folder, rows, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], POINT).coalesce(1).write.parquet(f"file://{folder}/{i:03d}")
    return spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/*")


def brute_changes(rows):
    last, out = {}, set()
    for product, store, seq, _, cents, currency in sorted(set(rows), key=lambda r: r[2]):
        if last.get((product, store)) != (cents, currency):
            out.add((product, store, seq, cents, currency))
        last[product, store] = cents, currency
    return out


def test_changes_dont_depend_on_how_points_are_split(spark, tmp_path):
    """Late points put in their place, repeated points, and corrections that add up to the same."""
    draw = Random(2)
    start = datetime(2024, 1, 1)
    rows = [("p", draw.choice("ab"), i, start + timedelta(hours=i), draw.choice([10, 11]), draw.choice(["USD", "NGN"])) for i in range(40)]
    want = brute_changes(rows)
    order = list(range(40))
    for n, parts in enumerate(([order], [order[30:], order[:15], order[10:31]], [order[::2], order[1::2]])):
        with jobs.state_store(spark, jobs.ROCKS):
            found = jobs.drain(jobs.price_changes(split_stream(spark, tmp_path / str(n), rows, parts)))
        assert {tuple(r) for r in jobs.standing(found).collect()} == want
        assert n == 0 or found.where("sign < 0").count() > 0


class Held:
    """A group's state and timers; counts how often the state is written."""

    def __init__(self):
        self.value, self.timers, self.writes = None, [], 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_offers_of_a_group_are_put_in_place_at_once():
    """500 offers cost a write of state for each batch, not for each offer; what a timer drops is that of each offer."""
    import pandas as pd

    draw, held = Random(4), Held()
    points = [(f"p{i % 100}", f"s{i // 100 % 5}", i, i * 10, draw.choice([10, 11]), draw.choice(["USD", "NGN"])) for i in range(2000)]
    draw.shuffle(points)
    taker = jobs.PriceChanges()
    taker.init(held)
    signs = {}
    for part in (points[:700], points[600:1500], points[1500:]):
        frames = [pd.DataFrame(rows, columns=["product_id", "store_id", "seq", "millis", "cents", "currency"]) for rows in (part[:300], part[300:])]
        for out in taker.handleInputRows((7,), iter(frames), None):
            for *change, sign in out.itertuples(index=False):
                signs[tuple(change)] = signs.get(tuple(change), 0) + sign
    assert {c for c, n in signs.items() if n} == brute_changes(points) and set(signs.values()) <= {0, 1}
    assert held.writes == 3 and len(held.timers) == 1 and len({p[:2] for p in points}) == 500

    class Passed:
        getCurrentWatermarkInMs = staticmethod(lambda: 15_000)

    assert list(taker.handleExpiredTimer((7,), Passed, None)) == []
    left = [tuple(r.values()) for r in taker._held().to_pylist()]
    last = {}
    for p in sorted(points, key=lambda p: p[2]):
        if p[3] < 15_000:
            last[p[:2]] = p
    assert sorted(left) == sorted(set(last.values()) | {p for p in points if p[3] >= 15_000})


def test_a_price_that_is_missing_counts_as_in_sql(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("p", "a", i, at + timedelta(hours=i), cents, currency) for i, (cents, currency) in enumerate([(10, "USD"), (None, "USD"), (10, "USD"), (10, "USD"), (10, None), (11, None), (11, "USD")])]
    with jobs.state_store(spark, jobs.ROCKS):
        found = jobs.drain(jobs.price_changes(split_stream(spark, tmp_path, rows, [[1, 2, 5], [0, 3, 4, 6]])))
    points = spark.createDataFrame(rows, POINT)
    points.createOrReplaceTempView("some_points")
    want = spark.sql("SELECT product_id, store_id, seq, cents, currency FROM (SELECT *, lag(cents) OVER w AS c, lag(currency) OVER w AS k FROM some_points WINDOW w AS (PARTITION BY product_id, store_id ORDER BY seq)) WHERE c IS NULL OR c <> cents OR k <> currency")
    assert {tuple(r) for r in jobs.standing(found).collect()} == {tuple(r) for r in want.collect()}


def test_state_keeps_the_last_point_behind_the_horizon(spark, tmp_path):
    """Batches a year apart with a horizon of a day: the base price stays known, so an equal price is no change."""
    at = lambda days: datetime(2024, 1, 1) + timedelta(days=days)
    rows = [("p", "a", 1, at(0), 10, "USD"), ("p", "a", 2, at(1), 12, "USD"), ("q", "a", 3, at(300), 1, "USD"), ("p", "a", 4, at(365), 12, "USD"), ("p", "a", 5, at(366), 13, "USD"), ("p", "a", 0, at(-1), 99, "USD")]
    with jobs.state_store(spark, jobs.ROCKS):
        found = jobs.drain(jobs.price_changes(split_stream(spark, tmp_path, rows, [[0, 1], [2], [3], [4], [5]]), "1 day"))
    assert {tuple(r)[:4] for r in jobs.standing(found).collect()} == {("p", "a", 1, 10), ("p", "a", 2, 12), ("q", "a", 3, 1), ("p", "a", 5, 13)}


def test_ingest_is_idempotent_and_first_wins(spark, tmp_path):
    schema = "product_key string, store_id string, product_id string, cents long, seq long"
    one = spark.createDataFrame([("k", "s", "p2", 20, 2), ("k", "s", "p1", 10, 1), ("k", "t", "p3", 30, 3), (None, "s", "x", 1, 1), ("m", None, "x", 1, 1)], schema)
    two = spark.createDataFrame([("k", "s", "p9", 90, 9), ("k", "u", "p0", 5, 0), ("n", "s", "p5", 50, 5)], schema)
    table = jobs.IngestTable(spark, f"file://{tmp_path}/table")
    rows = lambda: sorted(tuple(r)[:4] for r in table.read().collect())
    assert rows() == []
    table.merge(one, 0)
    assert rows() == [("k", "s", "p1", 20), ("k", "t", "p1", 30)]
    table.merge(two, 1)
    want = [("k", "s", "p0", 90), ("k", "t", "p0", 30), ("k", "u", "p0", 5), ("n", "s", "p5", 50)]
    assert rows() == want
    before = sorted(p for p in (tmp_path / "table").rglob("*.parquet"))
    table.merge(two, 1)  # a repeated batch
    table.merge(one, 0)
    assert rows() == want and sorted(p for p in (tmp_path / "table").rglob("*.parquet")) == before
    table.merge(two.limit(0), 2)
    assert rows() == want
