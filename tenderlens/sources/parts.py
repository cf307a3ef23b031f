"""Tables of parts that are replaced as a whole.

A write goes to a folder of its own, a version of its part, and counts from the moment on that a row naming it is in the
table's registry, a small Parquet table beside the data. Readers take the newest version of each part, so they see a write
wholly or not at all, whatever the new version holds or lacks; a write that fails leaves nothing to be seen. A write of
the whole table ends all parts before it. Superseded versions stay readable until ``drop_superseded`` deletes them.

The registry has one row per write; the driver reads it to name the folders to be listed. Rows are ordered by the time of
their commit, so two writers of one part need clocks that agree.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, types as T

from tenderlens.session import shuffles_dropped

REGISTRY = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("version", T.StringType()), T.StructField("stamp", T.LongType()),
    T.StructField("whole", T.BooleanType()),
])


def registry_path(table: str) -> str:
    return f"{table.rstrip('/')}/_parts"


def version_folder(table: str, part: str, version: str) -> str:
    return f"{table.rstrip('/')}/part={quote(part, safe='')}/version={version}"


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    place, system = _hadoop(spark, path)
    system.delete(place, True)


def delete_folders(spark: SparkSession, pattern: str) -> None:
    """Delete every folder that a pattern of the file system names."""
    place, system = _hadoop(spark, pattern)
    for found in system.globStatus(place) or []:
        system.delete(found.getPath(), True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    place, system = _hadoop(spark, path)
    return system.getContentSummary(place).getLength()


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _hadoop(spark, path)
    return system.exists(place)


def is_committed(spark: SparkSession, table: str) -> bool:
    """Whether any write to the table has come to its end."""
    return exists(spark, registry_path(table)) and not registry(spark, table).isEmpty()


def registry(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(registry_path(table))


def new_version() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_version(rows: DataFrame, table: str, part: str, by: str, whole: bool = False) -> str:
    """rows as the new version of a part, partitioned by a column; with ``whole`` all other parts end."""
    version = new_version()
    with shuffles_dropped(rows.sparkSession):
        rows.write.option("compression", "snappy").partitionBy(by).parquet(version_folder(table, part, version))
    commit(rows.sparkSession, table, [(part, version)], whole)
    return version


def commit(spark: SparkSession, table: str, versions: list[tuple[str, str]], whole: bool = False) -> None:
    """Make written versions count, all at once: one file appears in the registry."""
    stamp = time.time_ns()
    spark.createDataFrame([(p, v, stamp, whole) for p, v in versions], REGISTRY).coalesce(1).write.mode("append").parquet(registry_path(table))


def current(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    """(part, version) of what the table holds now, in the order of their commits."""
    now: dict[str, str] = {}
    for r in sorted(registry(spark, table).collect(), key=lambda r: (r.stamp, r.version)):
        if r.whole:
            now.clear()
        now.pop(r.part, None)
        now[r.part] = r.version
    return list(now.items())


def read_versions(spark: SparkSession, table: str, versions: Iterable[tuple[str, str]], schema: T.StructType) -> DataFrame:
    """The rows of the versions named. A column ``version`` in the schema tells them apart."""
    folders = [version_folder(table, p, v) for p, v in versions]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(*folders).select(*schema.fieldNames())


def read_current(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """What the table holds at this moment; later writes do not change the frame. Folders without a registry, as plain Parquet."""
    if not exists(spark, registry_path(table)):
        return spark.read.schema(schema).parquet(table).select(*schema.fieldNames())
    return read_versions(spark, table, current(spark, table), schema)


def drop_superseded(spark: SparkSession, table: str, older_than_hours: float = 24.0) -> list[str]:
    """Delete the folders of versions that are not current, those of failed writes too; the versions deleted.

    Younger ones stay: readers may still be at them, and a write that is under way has no row yet.
    """
    # The registry is read after the folders, so a write that ends in between is known.
    place, system = _hadoop(spark, f"{table.rstrip('/')}/part=*/version=*")
    found = [str(s.getPath()) for s in (system.globStatus(place) or [])]
    kept = {v for _, v in current(spark, table)}
    ended = {r.version: r.stamp for r in registry(spark, table).collect()}
    before = time.time_ns() - int(older_than_hours * 3600e9)
    # A version is out of use from the next commit on at the latest; its own times are a lower bound for that.
    gone = []
    for folder in found:
        version = folder.rsplit("version=", 1)[1]
        if version not in kept and ended.get(version, int(version.split("-")[0])) < before:
            delete_folder(spark, folder)
            gone.append(version)
    return gone
