"""Structured Streaming forms of the incremental operators.

Each job reads files as they arrive and can be run to the end of what is there
(``availableNow``). State and output go to the shared folder.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pricewright.catalog import Catalog, sql
from pricewright.functions import text as T
from pricewright.session import materialize, scratch_root

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE = "product_id string, store_id string, seq long, cents long, currency string, sign int"
#: Points of a group's offers that are still within the horizon, by offer and in order, and of each offer the last one before it: an Arrow stream.
STATE = "points binary"
#: How long after a later one a point may come and still be put in its place.
HORIZON = "3000 days"
#: Groups that offers are dealt into by a hash; Python takes a group at a time. The number holds for the life of a checkpoint.
GROUPS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

POINTS = pa.schema([("product_id", pa.string()), ("store_id", pa.string()), ("seq", pa.int64()), ("millis", pa.int64()), ("cents", pa.int64()), ("currency", pa.string())])
#: Points of an offer in order, of repeated ones that which is held first.
ORDER = [(name, "ascending") for name in ("product_id", "store_id", "seq", "fresh")]


def _like_last(column: pa.ChunkedArray) -> np.ndarray:
    """Whether a value is that of the row before it; nulls are alike."""
    values = column.combine_chunks()
    now, last = values[1:], values[:-1]
    alike = pc.if_else(pc.or_(pc.is_null(now), pc.is_null(last)), pc.and_(pc.is_null(now), pc.is_null(last)), pc.equal(now, last))
    return np.concatenate([[False], alike.to_numpy(zero_copy_only=False).astype(bool)])[: len(values)]


def _of_last(points: pa.Table) -> np.ndarray:
    """Whether a point is of the same offer as the row before it."""
    return _like_last(points["product_id"]) & _like_last(points["store_id"])


def _changed(points: pa.Table) -> np.ndarray:
    """Whether a point is its offer's first, or its price or currency isn't that of the one before; a null differs from nothing, and the one behind a null price is a change."""
    if not len(points):
        return np.zeros(0, bool)
    cents, currency = points["cents"].combine_chunks(), points["currency"].combine_chunks()
    other = pc.or_kleene(pc.not_equal(cents[1:], cents[:-1]), pc.not_equal(currency[1:], currency[:-1]))
    other = pc.or_(pc.is_null(cents[:-1]), pc.fill_null(other, False))
    return np.concatenate([[True], other.to_numpy(zero_copy_only=False).astype(bool)]) | ~_of_last(points)


class PriceChanges(StatefulProcessor):
    """Changes of the prices of a group's offers, corrected when points come late.

    A point is a change if price or currency isn't that of its offer's point
    before it. One that comes late is put in its place: it may be a change
    itself, and the one behind it may become one (sign 1) or cease to be one
    (sign -1). So what the signs add up to doesn't depend on how points are
    split into batches. When the watermark passes a point, a timer drops all of
    its offer before it, so the state of an offer is its points within the
    horizon and one more. A batch's points of a group are put in place at once,
    as columns.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("points", STATE)

    def _held(self) -> pa.Table:
        return pa.ipc.open_stream(self.state.get()[0]).read_all() if self.state.exists() else POINTS.empty_table()

    def _keep(self, points: pa.Table) -> int | None:
        """Store a group's points; the time after which some can be dropped, if ever."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, POINTS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(points)
        self.state.update((sink.getvalue().to_pybytes(),))
        next_at = pc.min(points["millis"].filter(pa.array(_of_last(points)))).as_py()
        return None if next_at is None else next_at + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        old = held.append_column("fresh", pa.array(np.zeros(len(held), bool))).append_column("before", pa.array(_changed(held)))
        new = pa.concat_tables([pa.Table.from_pandas(batch, POINTS, preserve_index=False) for batch in rows])
        new = new.append_column("fresh", pa.array(np.ones(len(new), bool))).append_column("before", pa.array(np.zeros(len(new), bool)))
        both = pa.concat_tables([old, new])
        both = both.take(pc.sort_indices(both, sort_keys=ORDER))
        repeated = _of_last(both) & _like_last(both["seq"])
        both = both.filter(pa.array(~repeated))
        points = both.select(POINTS.names)
        sign = _changed(points).astype("int32") - both["before"].to_numpy().astype("int32")
        following = self._keep(points)
        timers = list(self.handle.listTimers())
        if following is not None and timers != [following]:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(following)
        out = points.drop_columns("millis").append_column("sign", pa.array(sign)).filter(pa.array(sign != 0))
        if len(out):
            yield out.to_pandas()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        points = self._held()
        offer = np.cumsum(~_of_last(points)) - 1
        passed = pc.fill_null(pc.less(points["millis"], timerValues.getCurrentWatermarkInMs()), False).to_numpy().astype(bool)
        row = np.arange(len(points))
        last = np.zeros(len(points), "int64")
        np.maximum.at(last, offer[passed], row[passed])
        following = self._keep(points.filter(pa.array(row >= last[offer])))
        if following is not None:
            self.handle.registerTimer(following)
        yield from ()

    def close(self) -> None:
        pass


def price_changes(points: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Change capture on a stream of product_id, store_id, seq, at, cents and currency: changes with a sign, see ``PriceChanges``.

    Points later than ``horizon`` are left out.
    """
    group = F.pmod(F.xxhash64("product_id", "store_id"), F.lit(GROUPS)).cast("int")
    dealt = points.withColumns({"offers": group, "millis": F.unix_millis("at")}).withWatermark("at", horizon)
    return dealt.groupBy("offers").transformWithStateInPandas(PriceChanges(), CHANGE, "Append", "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """The changes that stand after all corrections."""
    by = [c for c in changes.columns if c != "sign"]
    return changes.groupBy(*by).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*by)


def drop_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of events of equal id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def window_counts(events: DataFrame, size: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Events and value by tumbling window and kind."""
    by = F.window("ts", size)
    counted = events.withWatermark("ts", delay).groupBy(by.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, with the schema they have now."""
    schema = spark.read.parquet(path).schema
    # a pattern that only this path fits: a stream reads no single file
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[{path[-1]}]")
    # event time has to be an instant
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there; the table it leaves.

    Append mode writes rows as they come. Complete mode replaces the table with
    each batch, under the number of the batch, so a repeated batch does no harm.
    """
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    last: list[int] = []

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out-{number}")
        last.append(number)

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out-{last[-1]}")


class state_store:
    """Within it the session's streams keep state in ``provider``; the setting before is restored."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession, provider: str):
        self.conf, self.provider = spark.conf, provider

    def __enter__(self) -> None:
        self.before = self.conf.get(self.NAME)
        self.conf.set(self.NAME, self.provider)

    def __exit__(self, *_: object) -> None:
        self.conf.set(self.NAME, self.before)


#: Folders of a stored table; a batch rewrites those it has rows for.
BUCKETS = 16


class IngestTable:
    """A stored table of listings, merged from batches: one row for each key and store.

    Rows have product_key, store_id, product_id (of the first listing of the
    key, in any store), cents and seq (of the last), first_seq, and batch. The
    table is dealt into folders by a hash of product_key, so a merge reads and
    rewrites only folders that the batch has rows for. A folder that has seen a
    batch's number is left alone, so a repeated batch changes nothing, also if
    it was cut off half way.
    """

    ROWS = "product_key string, store_id string, product_id string, cents long, seq long, first_seq long, batch long, bucket int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.ROWS).write.mode("append").partitionBy("bucket").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.ROWS).parquet(self.path)

    def merge(self, listings: DataFrame, number: int) -> None:
        """Merge ``listings`` (product_key, store_id, product_id, seq, cents). Rows without a key or store are left out."""
        spark = listings.sparkSession
        rows = listings.where("product_key is not null and store_id is not null").withColumn("bucket", F.pmod(F.xxhash64("product_key"), F.lit(BUCKETS)).cast("int"))
        own = rows.groupBy("bucket", "product_key", "store_id").agg(
            F.min_by("product_id", "seq").alias("product_id"), F.max_by("cents", "seq").alias("cents"), F.max("seq").alias("seq"), F.min("seq").alias("first_seq")
        )
        fresh = materialize(own.withColumn("batch", F.lit(number).cast("long")), "ingest-batch")
        held = spark.read.schema(self.ROWS).parquet(self.path).join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi")
        seen = F.broadcast(held.groupBy("bucket").agg(F.max("batch").alias("last")).where(F.col("last") >= number).select("bucket"))  # a row for each folder at most
        both = held.unionByName(fresh).join(seen, "bucket", "left_anti")
        merged = both.groupBy("bucket", "product_key", "store_id").agg(
            F.min_by("product_id", "first_seq").alias("product_id"), F.max_by("cents", "seq").alias("cents"), F.max("seq").alias("seq"), F.min("first_seq").alias("first_seq")
        )
        first = merged.groupBy("product_key").agg(F.min_by("product_id", "first_seq").alias("product_id"))
        named = merged.drop("product_id").join(first, "product_key").withColumn("batch", F.lit(number).cast("long"))
        ready = materialize(named.select("product_key", "store_id", "product_id", "cents", "seq", "first_seq", "batch", "bucket"), "ingest-merged")
        ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def ingest(listings: DataFrame, table: IngestTable, checkpoint: str) -> None:
    """Merge a stream of listings to its end."""
    listings.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def q_stream_window_counts(spark, sf_dir):
    return drain(window_counts(read_stream(spark, f"{sf_dir}/events.parquet")), "complete")


def q_stream_drop_repeats(spark, sf_dir):
    return drain(drop_repeats(read_stream(spark, f"{sf_dir}/events.parquet"), "40 days")).select("event_id", "user_id")


def _seq() -> Column:
    """Order dates folded into one sequence number."""
    return F.unix_date(F.to_date("recorded_at")).cast("long") * 10**10 + F.col("order_no") * 100 + F.col("line_no")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points as a stream, with their sequence numbers."""
    points = read_stream(spark, f"{sf_dir}/lineitem.parquet")
    c = Catalog(spark, sf_dir)
    c.table = lambda name: points  # the same binding, over the stream
    return c.points.select("product_id", "store_id", _seq().alias("seq"), F.col("recorded_at").cast("timestamp").alias("at"), "cents", "currency")


def q_stream_price_changes(spark, sf_dir):
    """Price changes by offer that stand when all points are in."""
    with state_store(spark, ROCKS):
        return standing(drain(price_changes(_points(spark, sf_dir))))


def q_stream_ingest(spark, sf_dir):
    """Listings merged batch by batch into a stored table: equal titles of a brand are one product, that of the first listing."""
    keys = Catalog(spark, sf_dir).products.select("product_id", F.concat_ws("/", T.title_key(F.col("title")), "brand").alias("product_key"))
    root = f"{scratch_root(spark)}/ingest-{uuid.uuid4().hex}"
    table = IngestTable(spark, f"{root}/table")
    ingest(_points(spark, sf_dir).join(keys, "product_id"), table, f"{root}/state")
    return table.read().select("product_key", "store_id", "product_id", "cents")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "stream_ingest": sql(
        """SELECT product_key, store_id, first(first_id ORDER BY seq) AS product_id, last(cents ORDER BY seq) AS cents FROM (
        SELECT product_key, store_id, cents, seq, first_value(product_id) OVER (PARTITION BY product_key ORDER BY seq) AS first_id FROM (
          SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') || '/' || brand AS product_key, store_id, product_id, cents, datediff('day', DATE '1970-01-01', recorded_at::DATE)::BIGINT * 10000000000 + order_no * 100 + line_no AS seq
          FROM points JOIN products USING (product_id))) GROUP BY 1, 2"""
    ),
    "stream_window_counts": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "stream_price_changes": sql(
        """SELECT product_id, store_id, seq, cents, currency FROM (SELECT *, lag(cents) OVER w AS c, lag(currency) OVER w AS k FROM (
        SELECT *, datediff('day', DATE '1970-01-01', recorded_at::DATE)::BIGINT * 10000000000 + order_no * 100 + line_no AS seq FROM points) WINDOW w AS (PARTITION BY product_id, store_id ORDER BY seq))
        WHERE c IS NULL OR c <> cents OR k <> currency"""
    ),
    "stream_drop_repeats": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM events) WHERE rn = 1",
}
