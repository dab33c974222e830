"""Session helpers: building a session for tests/bench and reliable lineage cuts."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "tabforge",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Session for local runs (tests, bench). On a cluster, pass the cluster's session instead."""
    master = master or os.environ.get("TABFORGE_MASTER", "local[8]")
    cores = 8
    if master.startswith("local[") and master[6:-1].isdigit():
        cores = int(master[6:-1])
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.constraintPropagation.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    Uses the cluster's ``spark.checkpoint.dir`` (or a directory already set on the
    context). Only a local-mode session without one gets a private scratch folder,
    as in tests; a cluster session without a shared folder is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabforge-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder and return the re-read plan.

    Used where a plan must be evaluated exactly once (sampled range bounds, iterative
    label propagation) so that recomputation after an executor loss sees the same rows.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A table written once as Parquet in the shared checkpoint folder: cuts lineage, survives lost executors, and adaptive
    execution can split joins with it. The files go with ``drop()``, or else when the application ends."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        place = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
        df.write.parquet(place)
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(place)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.path)
        self.df = spark.read.schema(df.schema).parquet(place)

    def drop(self) -> None:
        self.files.delete(self.path, True)


#: Rows of a partition that a table keeps whole, and rows that no partition of a table dealt out should exceed.
FEW_ROWS, MANY_ROWS = 16384, 500_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, whose rows are read many times, dealt out evenly: iterative training over the one or two partitions of a file with few row
    groups would use as many cores. Three partitions a core, of ``FEW_ROWS`` rows at least, and more where they would exceed ``MANY_ROWS``."""
    n = df.count()
    parts = max(min(math.ceil(n / FEW_ROWS), 3 * df.sparkSession.sparkContext.defaultParallelism), math.ceil(n / MANY_ROWS))
    return df.repartition(parts) if parts > 1 else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabforge`` importable in Python workers (pandas UDFs reference its functions).

    The package source is zipped on the driver and distributed with
    ``SparkContext.addPyFile`` -- Spark's own code-distribution path -- once per application.
    """
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="tabforge-py-")
    zpath = os.path.join(out_dir, "tabforge.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
