"""Versions of a table behind a pointer: data first, then the pointer, in one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_latest"


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of the folders in ``path`` that begin with ``prefix``."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(prefix))


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it over ``path``: readers see the old text or the new one."""
    jvm, hidden = spark._jvm, path.rpartition("/")[0] + f"/.{uuid.uuid4().hex}"
    where, fs = _path(spark, hidden)
    out = fs.create(where, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(where, jvm.org.apache.hadoop.fs.Path(path), overwrite)


def get_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> int | None:
    """The published version, none before the first."""
    text = get_text(spark, f"{path}/{POINTER}")
    return int(text) if text else None


def publish(df: DataFrame, path: str, keep: int | None = None) -> int:
    """Write ``df`` as the next version and then point to it; the version's number.

    A version's folder has a name of its own, so a writer that dies leaves the
    pointer and what it points to as they were, and a later one takes the next
    number.  With ``keep`` only that many of the latest versions stay; versions after
    the published one (of writers that died or have not published yet) are left alone.  One writer at a
    time: of two that publish at once the later rename counts.
    """
    spark = df.sparkSession
    taken = [int(n.removeprefix("v=")) for n in subfolders(spark, path, "v=")]
    number = max([-1, *taken, -1 if (now := latest(spark, path)) is None else now]) + 1
    df.write.mode("errorifexists").parquet(f"{path}/v={number}")
    put_text(spark, f"{path}/{POINTER}", str(number))
    if keep is not None:
        retain(spark, path, keep)
    return number


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The published version; what was published before stays readable while it is kept."""
    number = latest(spark, path)
    if number is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/v={number}")


def retain(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Delete all but the ``keep`` latest versions up to the published one; the numbers that went."""
    if keep < 1:
        raise ValueError("the published version cannot go: keep 1 at least")
    now = latest(spark, path)
    old = sorted(n for n in (int(x.removeprefix("v=")) for x in subfolders(spark, path, "v=")) if now is not None and n <= now)
    gone = old[:-keep]
    for n in gone:
        delete(spark, f"{path}/v={n}")
    return gone
