"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest group one task may sort, and rows per ordered chunk once a group is larger.
GROUP_ROWS = 2_000_000
CHUNK_ROWS = 1 << 20


def build_session(app: str = "rankspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.rankspark.{name}", str(default)))


def group_rows(spark: SparkSession) -> int:
    return setting(spark, "groupRows", GROUP_ROWS)


def chunk_rows(spark: SparkSession) -> int:
    return setting(spark, "chunkRows", CHUNK_ROWS)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(table: DataFrame) -> DataFrame:
    """Redistribute a file table that comes in fewer splits than there are cores, before heavy expressions.
    Large tables have more splits than cores and stay where they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a scratch folder only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def drop_cuts(spark: SparkSession) -> int:
    """Delete every folder this driver has cut or written to so far, once no result that reads them is needed any more."""
    dropped = 0
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        dropped += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table once into the shared folder and read it back, so that a lost executor neither replays nor
    changes what was already decided. Parquet keeps column pruning and gives the optimizer the real size."""
    spark = df.sparkSession
    folder = new_folder(spark, "cut")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
