"""Tables that are made once and read often: sections and terms of a corpus.

A table's place follows from what it is made of: its name and the length and time of every input file. As long as those
stay, the files written first are read again; when one changes, the table is made anew. Tables lie in the folder that
``spark.checkpoint.dir`` names (a temporary one in a local session without it) and are deleted with the driver's JVM.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_known: dict[tuple[str, str], tuple[str, object]] = {}
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master is {master})")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="marginalia-store-"))
    return _own[0]


def _path(spark: SparkSession, place: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def signature(spark: SparkSession, inputs: list[str]) -> str:
    """A digest of the inputs' files: path, length and time of change."""
    seen = hashlib.sha256()
    for place in sorted(inputs):
        files, path = _path(spark, place)
        each = files.listFiles(path, True)
        found = []
        while each.hasNext():
            f = each.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        seen.update("\n".join([place, *sorted(found)]).encode())
    return seen.hexdigest()[:32]


def saved(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of these inputs: read if it was written in this session and the inputs are as they were, else made."""
    key = (spark.sparkContext.applicationId, f"{name}-{signature(spark, inputs)}")
    if key not in _known:
        place = f"{folder(spark)}/{key[0]}-{key[1]}"
        files, path = _path(spark, place)
        files.deleteOnExit(path)
        df = make()
        df.write.mode("overwrite").option("compression", "zstd").parquet(place)
        _known[key] = (place, df.schema)
    place, schema = _known[key]
    return spark.read.schema(schema).parquet(place)
