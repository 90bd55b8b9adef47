"""Publishing results: whole documents or none, verified snapshots, and a page for readers."""

from __future__ import annotations

import html
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import merge
from lodestrata.session import exists, file_system


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, letters beyond ASCII as they are; nulls are written too."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table as a whole: written beside it, then renamed, so no reader ever sees half of it.

    Between its two renames there is no table for a moment; a run that ends there
    leaves the old one beside it, and ``recover_table`` brings it back. Folders are
    renamed at once on HDFS and disks but not on object stores: there use
    ``publish_version``.
    """
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    recover_table(spark, path)
    system, target = file_system(spark, path)
    source, old = file_system(spark, staged)[1], file_system(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    existed = system.exists(target)
    if existed and not system.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not system.rename(source, target):
        if existed:
            system.rename(old, target)
        raise OSError(f"could not publish {path}")
    if existed:
        system.delete(old, True)


def recover_table(spark: SparkSession, path: str) -> bool:
    """Bring back the table that an interrupted ``replace_table`` left beside its place; whether there was one."""
    system, target = file_system(spark, path)
    if system.exists(target) or not system.exists(target.getParent()):
        return False
    left = [f.getPath() for f in system.listStatus(target.getParent()) if f.getPath().getName().startswith(f"{target.getName()}.old-")]
    return bool(left) and system.rename(left[0], target)


def held_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or none of ``like``'s rows where there is no table. A table that can't be read is an error."""
    recover_table(spark, path)
    return spark.read.parquet(path) if exists(spark, path) else like.limit(0)


def publish_version(df: DataFrame, path: str) -> str:
    """Write ``df`` as a new version of the table in the folder ``path`` and turn its pointer there; returns the version.

    The pointer is one small file, put in place by one rename with overwriting:
    readers have the old version until then and the new one from then on.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm = spark.sparkContext._jvm
    system, staged = file_system(spark, f"{path}/pointer-{version}")
    out = system.create(staged, True)
    out.write(bytearray(version, "ascii"))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(staged, file_system(spark, f"{path}/CURRENT.txt")[1], options)
    return version


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer of ``publish_version`` names."""
    name = spark.read.text(f"{path}/CURRENT.txt").head()[0]
    return spark.read.parquet(f"{path}/{name}")


@contextmanager
def locked(spark: SparkSession, path: str, timeout: float = 30.0, poll: float = 0.1) -> Iterator[None]:
    """Hold the lock of ``path``, a file beside it that only one process can create; TimeoutError where another holds it too long.

    Only the holder's own lock is taken away afterwards.
    """
    system, lock = file_system(spark, f"{path}.lock")
    token, deadline = uuid.uuid4().hex, time.monotonic() + timeout
    while True:
        try:
            out = system.create(lock, False)
            break
        except Py4JJavaError as error:
            if "exist" not in str(error.java_exception).lower():
                raise
            if time.monotonic() >= deadline:
                raise TimeoutError(f"another process holds {path}.lock") from None
            time.sleep(poll)
    out.write(bytearray(token, "ascii"))
    out.close()
    try:
        yield
    finally:
        if system.exists(lock):
            source = system.open(lock)
            own = bytes(source.readAllBytes()).decode() == token
            source.close()
            if own:
                system.delete(lock, False)


def update_table(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], timeout: float = 30.0) -> None:
    """Read, change and replace a table under its lock. ``change`` gets null where there is no table; if it fails, nothing changes."""
    with locked(spark, path, timeout):
        recover_table(spark, path)
        replace_table(change(spark.read.parquet(path) if exists(spark, path) else None), path)


def publish(pages: DataFrame, owner: str, failed: Column, path: str) -> None:
    """Write the documents none of whose pages failed, each into its own partition; the partitions of others stay."""
    whole = merge.publish_complete(pages, owner, failed)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def merge_report(new: DataFrame, path: str, owner: str) -> None:
    """A run's report together with the old entries of documents that are not in this run."""
    old = held_rows(new.sparkSession, path, new)
    replace_table(old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new), path)


def snapshot(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """(path, sha256, length) of every file of a folder; contents go once each into the store, by hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    state = files.select("path", F.sha2("content", 256).alias("sha256"), "length")
    contents = files.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    if exists(spark, store):
        contents = contents.join(spark.read.parquet(store).select("sha256"), "sha256", "left_anti")
    contents.write.mode("append").parquet(store)
    return state


def read_verified(spark: SparkSession, state: DataFrame, store: str) -> DataFrame:
    """Contents of a state from the store; a path that leaves its folder and a hash that does not match fail when they are read."""
    outside = F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)")
    state = state.withColumn("path", F.when(outside, F.raise_error(F.concat(F.lit("invalid path "), F.col("path")))).otherwise(F.col("path")))
    held = state.join(spark.read.parquet(store), "sha256")
    checked = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("changed content of "), F.col("path"))))
    return held.withColumn("content", checked)


def html_report(items: DataFrame, columns: list[str], title: str, most: int = 500) -> str:
    """A page with the first items, every text escaped. ``most`` bounds what a reader gets to see and the driver holds."""
    rows = items.select(*columns).limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def summary_line(df: DataFrame, column: str) -> str:
    """Counts of a status column in one line, for people."""
    return ", ".join(f"{r[0]}: {r[1]}" for r in df.groupBy(column).count().orderBy(F.desc("count"), column).collect())
