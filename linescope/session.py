"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


#: Rows of a table that may be broadcast after they were counted.
SMALL_ROWS = 10_000
INPUT_PARTITIONS = "spark.linescope.inputPartitions"


def local_session(cores: int | str = 8, app: str = "linescope", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # File sizes say nothing about exploded text: broadcast by measured size only.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32m")
        .config("spark.sql.session.timeZone", "UTC")
        .config(INPUT_PARTITIONS, str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A machine-local folder is made only for a local master where neither is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linescope-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """New path below the shared folder."""
    return f"{shared_dir(spark)}/linescope/{name}-{uuid.uuid4().hex}"


_scratch: list[str] = []


def mark() -> int:
    """Place in the list of intermediate tables, for :func:`release`."""
    return len(_scratch)


def release(spark: SparkSession, since: int) -> None:
    """Drop the tables that :func:`materialise` wrote after ``since = mark()``.

    For owners of a job, once its result stands in a table of its own; nothing lazy may still read them.
    """
    while len(_scratch) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage with files that outlive any executor.
    """
    path = fresh_path(df.sparkSession, name)
    _scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and marked for broadcast if it has at most ``SMALL_ROWS`` rows; a join is planned freely beyond.

    For tables with a row per class, group or parameter, against which many rows meet few keys.
    """
    held = materialise(df, name)
    return broadcast(held) if held.count() <= SMALL_ROWS else held


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` as it is scanned, or hash-partitioned where the session asks for it.

    ``spark.linescope.inputPartitions`` is for tables in one unsplittable file, as on a test machine. Unset, as on a
    cluster, no text is shuffled; the size of the table decides nothing.
    """
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted), *cols) if wanted else df
