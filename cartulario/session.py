"""Session helpers: table loading and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(master)
        .appName("cartulario")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables; the scan stays lazy so that pruning and pushdown reach it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder in ``spark.checkpoint.dir``.

    Only where neither the context nor the session names a folder (tests on one
    machine) is a temporary one made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cartulario-checkpoint-")
    context.setCheckpointDir(folder)


#: With this setting Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, and delete the shuffle files that led to it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as the cluster runs at once, before work that is heavy by row.

    Only a table of fewer scan tasks than that is moved; it is small for that reason, as a
    scan task holds a bounded number of bytes. What comes out of a shuffle stays as it is:
    counting its tasks would run it.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("Join", "Aggregate", "Window", "Sort", "Repartition")):
        return df
    wide = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wide) if df.rdd.getNumPartitions() < wide else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="cartulario-package-"))
    with zipfile.ZipFile(folder / "cartulario.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(folder / "cartulario.zip"))
    _SHIPPED.add(context.applicationId)
