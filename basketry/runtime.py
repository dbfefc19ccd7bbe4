"""Session settings, lineage cuts and small guards shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import basketry

# Functions of this package travel to the Python workers whole, so only the driver needs the package.
cloudpickle.register_pickle_by_value(basketry)

# Settings every job of this library relies on. They are runtime SQL settings, so they can be applied to a session
# that somebody else built. Partition counts are left to the cluster: adaptive execution coalesces them.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when that costs one more shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keep only the first n rows of a key on the map side, whatever n is; the limit counts rows and holds none.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000000",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "basketry", cores: int | str = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.wholeStage", "true")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="basketry-checkpoint-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the shared checkpoint folder and go on from the files.

    Used where a table is read several times and must be the same each time (range-partition numbers), and in
    iterative operators, where lineage would otherwise grow with every round. Files keep statistics, and readers of them
    prune columns and push filters down.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for tables that one job writes and reads back."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Remove a table that ``scratch_path`` named, once nothing reads it any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")


def require_positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive, got {value}")


def scalar(df: DataFrame, expr: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery: stays in the plan and needs no join."""
    return df.agg(expr.alias("_scalar")).scalar()


def days(n: float) -> Column:
    return F.make_dt_interval(F.lit(int(n)))


def count_of(event_type: str, column: str = "event_type") -> Column:
    return F.count_if(F.col(column) == event_type)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to union")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
