"""Session building, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that is ever broadcast on request; larger sides take the shuffle join.
BROADCAST_ROWS = 200_000
# Rows of a table that one task of a join sorts at most, by average.
TASK_ROWS = 1_000_000


def build_session(app: str = "cinderleaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # a join whose side fits per partition skips the sort; larger ones keep the spilling sort-merge
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # recording the Python call site of every column expression doubles the planning time
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="cinderleaf-")
    sc.setCheckpointDir(shared)
    return shared


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table, planned as a local relation rather than as a Python data source."""
    kinds = [column.strip().split(" ", 1) for column in schema.split(",")]
    cells = F.array(*[F.array(*[F.lit(v).cast("string") for v in row]) for row in rows])
    listed = spark.range(0, 1, 1, 1).select(F.explode(cells).alias("v"))
    return listed.selectExpr(*[f"CAST(v[{i}] AS {kind}) AS `{name}`" for i, (name, kind) in enumerate(kinds)])


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and continue from the written files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` written as a table to the shared folder and read back.

    Unlike a checkpoint it has the size of its files: a checkpoint keeps the estimate of its plan, and
    where the result of joins is joined round after round that estimate grows beyond all bounds.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query run herein go when it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` gave; no plan that is still to run may read them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint when its row count is within the bound, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """The tasks that joins of `df` need for at most `rows` rows each; None when the session's number will do."""
    needed = -(-df.count() // rows)
    return needed if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """`df` dealt to that many tasks by the key, so that a join or grouping by it sorts no larger parts."""
    return df if tasks is None else df.repartition(tasks, key)
