"""Helpers that the operators share: the folder all executors see, settled tables and integer naming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but the ASCII space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: With this setting a query's shuffle files go when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: list[str] = []
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one of our own, in a local session only.

    On a cluster each executor would write to a disk of its own, so there the setting is required.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master is {master})")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="marginalia-"))
    return _own_folder[0]


def _filesystem(spark: SparkSession, place: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_place(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses; Hadoop deletes it when the driver's JVM ends."""
    place = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    files, path = _filesystem(spark, place)
    files.deleteOnExit(path)
    return place


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends in files that outlive executors.

    The shuffles of the writing query are removed with it; ``free`` removes the table once its last reader is written.
    """
    spark = df.sparkSession
    place = new_place(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(place)
    _places[out] = place
    return out


def free(*tables: DataFrame | None) -> None:
    """Delete settled tables. Only for tables that nothing will read again; frames that ``settle`` didn't make are left alone."""
    for df in tables:
        place = _places.pop(df, None) if df is not None else None
        if place:
            files, path = _filesystem(df.sparkSession, place)
            files.delete(path, True)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all ``columns`` (in any case)."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def integer_names(distinct: DataFrame, order: list[str], bucket_of: Column, buckets: int, name: str = "name") -> DataFrame:
    """Number the rows of ``distinct``, which must not repeat: sort each bucket and interleave the buckets' numbers.

    Names depend on the rows alone (not on partitions or task order), and no two rows share one.
    """
    w = Window.partitionBy("_bucket").orderBy(*order)
    numbered = distinct.withColumn("_bucket", F.pmod(bucket_of, F.lit(buckets)).cast("long"))
    return numbered.withColumn(name, (F.row_number().over(w) - 1).cast("long") * F.lit(buckets) + F.col("_bucket")).drop("_bucket")


def map_columns(df: DataFrame, start: Callable[[], Callable[..., list[tuple]]], schema: str, columns: list[str]) -> DataFrame:
    """Run a Python function over Arrow batches. ``start()`` makes, once a task, a function from lists of ``columns`` to rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work = start()
        for batch in batches:
            rows = work(*[batch.column(c).to_pylist() for c in columns])
            cells = list(zip(*rows, strict=True)) or [()] * len(want)
            yield pa.RecordBatch.from_arrays([pa.array(cell, want.field(k).type) for k, cell in enumerate(cells)], schema=want)

    return df.select(*columns).mapInArrow(run, schema)
