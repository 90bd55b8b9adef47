"""Session set-up and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow); ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # small shuffles keep as many partitions as there are cores: text rules cost more than the rows weigh
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local master without the setting gets a temporary folder, which goes when
    Python ends; on a cluster its absence is an error, for a folder of one machine
    would lose rows there.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as one of its own."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path; a file system that can't be asked is an error, not an absence."""
    system, target = file_system(spark, path)
    return system.exists(target)


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a
    recomputation, and the optimizer sees the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._lodestrata_path = path
    return held


def discard(held: DataFrame) -> None:
    """Delete what ``materialize`` wrote for a frame that nothing reads any more (a round of an iteration that the next one replaced)."""
    path = getattr(held, "_lodestrata_path", None)
    if path:
        system, target = file_system(held.sparkSession, path)
        system.delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs far more than moving its rows.

    A scan of few files is shuffled once; one that already has enough partitions
    stays as it is. Only for plans without a shuffle: counting partitions runs the
    stages before the last.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if partitions >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; nothing need be installed on executors."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestrata-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "lodestrata.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._lodestrata_shipped = True
