"""Session settings and durable staging for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one key may own a third of the rows: let AQE split its shuffle blocks
    # even where that costs one more exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Spark 4.1 lets a union claim its children's hash partitioning; groups
    # above such a union then come out split into several rows
    "spark.sql.unionOutputPartitioning": "false",
    # an explode needs no inferred "array is not empty" filter: pushed down,
    # it evaluates the exploded text expression a second time
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    "spark.sql.session.timeZone": "UTC",
}

# Inputs below this size arrive in fewer splits than cores; spreading them
# costs one tiny shuffle. Larger inputs are never repartitioned here.
SMALL_INPUT_BYTES = 256 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Runtime options the jobs rely on; rules the caller excluded stay excluded."""
    for key, value in RUNTIME_CONF.items():
        if key == "spark.sql.optimizer.excludedRules":
            kept = [r for r in (spark.conf.get(key, "") or "").split(",") if r.strip()]
            value = ",".join(dict.fromkeys([*kept, value]))
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, memory: str = "20g", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("newsloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):  # a core setting: it cannot be added to a running session
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's spark.checkpoint.dir."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share before running these jobs")
    return path.rstrip("/")


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage (survives executor loss, unlike a local checkpoint) and
    gives the optimizer real table sizes for the next round's joins.
    """
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# rows up to which a counted side is sent to every executor
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` rows, else
    as it is. It is counted, so it should be a staged table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def plan_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate of a frame, None when it has none."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small scan as many partitions as there are cores."""
    size = plan_bytes(df)
    if size is None or size > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
