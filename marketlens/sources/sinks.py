"""Report sinks and materialisation of shared intermediates.

The original workload stores every report with CREATE TABLE AS (some with
IF NOT EXISTS, which keeps a stale table on rerun) and reads the fact view
30 times. Here a report is written with an explicit save mode, and the fact
can be materialised once into the shared checkpoint folder so that a run of
all reports scans it instead of re-joining the base tables. A written table
survives executor loss, unlike an in-memory cache.

A table is published only when it is whole. It is written to a staging folder
beside its place and moved there afterwards; a table it replaces is moved
aside first and deleted last. A write that fails (or a driver that dies)
leaves the old table as it was, and what it left behind counts as no table:
``stored_table`` takes a folder for a table only if it holds a committed file.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from marketlens.session import scratch_path

SAVE_MODES = ("overwrite", "ignore", "errorifexists", "append")


def _place(spark: SparkSession, path: str):
    """(file system, path) of ``path``, whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def holds_table(spark: SparkSession, path: str) -> bool:
    """A committed table is at ``path``: a success marker or a data file, in
    the folder or in its partitions. What an unfinished write left
    (``_temporary``, an empty folder) is none."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return False
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        return True
    folders = [place]
    while folders:
        for entry in fs.listStatus(folders.pop()):
            if not entry.getPath().getName().startswith(("_", ".")):
                if entry.isFile():
                    return True
                folders.append(entry.getPath())
    return False


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table written at ``path``, or None if no whole one is there."""
    return spark.read.parquet(path) if holds_table(spark, path) else None


def _beside(path: str, what: str) -> str:
    """A new name in the folder of ``path`` that readers of that folder skip."""
    parent, _, name = path.rstrip("/").rpartition("/")
    own = f"_{what}-{name}-{uuid.uuid4().hex}"
    return f"{parent}/{own}" if parent else own


def _publish(spark: SparkSession, staging: str, path: str) -> None:
    """Move the finished ``staging`` folder to ``path``, replacing what is there."""
    fs, target = _place(spark, path)
    _, source = _place(spark, staging)
    old = None
    if fs.exists(target):
        _, old = _place(spark, _beside(path, "replaced"))
        if not fs.rename(target, old):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(source, target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"cannot move the finished table to {path}")
    if old is not None:
        fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def write_report(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    order_by: Sequence[str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Write a finished report; all of it appears at ``path``, or nothing does.

    ``mode='ignore'`` reproduces CREATE TABLE IF NOT EXISTS, and
    ``'errorifexists'`` a plain CREATE TABLE AS. ``order_by`` gives the
    stored file a presentation order (a range-partitioned sort; reports are
    small, this is for readers that scan files in order). ``'append'`` relies
    on Spark's own commit: files of a failed job never become visible.
    """
    if mode not in SAVE_MODES:
        raise ValueError(f"mode must be one of {SAVE_MODES}")
    spark = df.sparkSession
    if order_by:
        df = df.orderBy(*order_by)
    if mode == "append":
        df.write.mode(mode).format(fmt).save(path)
        return
    if mode != "overwrite" and holds_table(spark, path):
        if mode == "errorifexists":
            raise FileExistsError(f"a table is already stored at {path}")
        return
    staging = _beside(path, "staging")
    try:
        df.write.mode("errorifexists").format(fmt).save(staging)
        _publish(spark, staging, path)
    except BaseException:
        remove(spark, staging)
        raise


def save_table(
    df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None
) -> None:
    """CTAS into the session catalog as a Parquet table.

    With ``path`` the table is external (its files live at ``path``, e.g. on
    shared storage); otherwise it is managed in the warehouse folder. Either
    way the catalog shows the new table only when it is whole: files are
    published as by ``write_report``, a managed table is written under another
    name and renamed. ``mode='ignore'`` keeps an existing table (CREATE TABLE IF
    NOT EXISTS).
    """
    if mode not in SAVE_MODES:
        raise ValueError(f"mode must be one of {SAVE_MODES}")
    spark = df.sparkSession
    there = spark.catalog.tableExists(name)
    if mode == "append" and there:
        df.write.mode("append").format("parquet").saveAsTable(name)
        return
    if there and mode == "ignore":
        return
    if there and mode == "errorifexists":
        raise FileExistsError(f"the table {name} already exists")
    if path is not None:
        # A table that only the files know of is kept (or refused) by its files.
        write_report(df, path, mode)
        if there:
            spark.sql(f"DROP TABLE {name}")
        spark.catalog.createTable(name, path=path, source="parquet")
        return
    staging = f"{name}_staging_{uuid.uuid4().hex[:12]}"
    try:
        df.write.format("parquet").saveAsTable(staging)
        if there:
            spark.sql(f"DROP TABLE {name}")
        spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        raise


def materialize(
    spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = ()
) -> tuple[DataFrame, str]:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back; also its path.

    Cuts the lineage (a lost executor re-reads files instead of recomputing
    the joins) and lets many readers share one computation.
    """
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a materialised table, on whatever file system it is."""
    fs, place = _place(spark, path)
    fs.delete(place, True)
