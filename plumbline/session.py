"""Session helper, table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]


def local_session(cores: int | str = 8, app: str = "plumbline") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plumbline-ck-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage with files that survive the loss of any executor, compressed and columnar,
    unlike an RDD checkpoint. What a loop does not drop itself goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/plumbline-{_RUN}/{label}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path).getParent()
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Remove the files behind a frame that ``materialise`` returned."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if "plumbline-" in path.toString():
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def wide_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
