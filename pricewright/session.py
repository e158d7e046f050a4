"""Session and scratch-folder helpers shared by operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and a cluster
    falls back to its warehouse, which is shared too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix="pricewright-")
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner a real size.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The stored relations of an application: (application, name) to (schema, path, mark of the inputs, path of the copy before).
_stored: dict[tuple[str, str], tuple] = {}


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def input_mark(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files at ``paths``: names, sizes and times of change. Another one means other rows."""
    seen = hashlib.sha256()
    for path in sorted(paths):
        files, place = _file_system(spark, path)
        if not files.exists(place):
            continue
        found = files.listFiles(place, True)
        while found.hasNext():
            one = found.next()
            seen.update(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}\n".encode())
    return seen.hexdigest()


def refresh(name: str, df: DataFrame, inputs: list[str] | None = None) -> DataFrame:
    """Recompute a stored relation.

    It is written beside the one in use and put in its place when complete, so
    readers see the old rows or the new ones, and those that have begun keep
    theirs. The copy before the one replaced is dropped. ``inputs`` are the
    paths that it is made of.
    """
    spark = df.sparkSession
    mark = input_mark(spark, inputs) if inputs else None  # before reading: a file that comes meanwhile is seen next time
    path = f"{scratch_root(spark)}/{name.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    key = spark.sparkContext.applicationId, name
    held = _stored.get(key)
    if held and held[3]:
        files, place = _file_system(spark, held[3])
        files.delete(place, True)
    _stored[key] = df.schema, path, mark, held[1] if held else None
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame], inputs: list[str]) -> DataFrame:
    """The stored relation ``name``, built by its first reader, and again when files at ``inputs`` have changed or its own are gone."""
    held = _stored.get((spark.sparkContext.applicationId, name))
    if held is not None:
        schema, path, mark, _ = held
        files, place = _file_system(spark, f"{path}/_SUCCESS")
        if files.exists(place) and mark == input_mark(spark, inputs):
            return spark.read.schema(schema).parquet(path)
    return refresh(name, build(), inputs)
