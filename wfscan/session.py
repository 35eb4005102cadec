"""Session, table and lineage helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "wfscan.shipped.app"


def session(app: str = "wfscan", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WFSCAN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application, wherever the driver was started."""
    sc = spark.sparkContext
    if spark.conf.get(_SHIPPED, "") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="wfscan-")) / "wfscan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("wfscan") / p.relative_to(root))
    sc.addPyFile(str(target))
    spark.conf.set(_SHIPPED, sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few splits over all cores, before costly work on each row; what already has enough partitions isn't moved.

    A file of one row group is one task however many cores there are. Inputs of that kind are small, so what is moved is small too.
    """
    ship_package(df.sparkSession)
    sc = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString() or "Adaptive" in plan.toString():  # asking for its partitions would run its stages
        return df
    if plan.execute().getNumPartitions() * 2 > sc.defaultParallelism:
        return df
    return df.repartition(sc.defaultParallelism)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. A temporary one serves only where everything runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors on several machines need a folder that they share")
    return (named or tempfile.gettempdir()).rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/wfscan-{name}-{uuid.uuid4()}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may be gone
            pass

    atexit.register(remove)
    return path


def shared_table(df: DataFrame) -> DataFrame:
    """Write the rows once into the shared folder and read them from there."""
    path = shared_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a dimension whose size must stay below `limit` rows; fail loudly instead of growing the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; it must not be collected")
    return rows
