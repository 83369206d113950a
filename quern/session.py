"""Sessions and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


#: Rows of a task that sorts or groups.
ROWS = 250_000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster use the one given."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("quern")
            .config("spark.driver.memory", memory)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder: the shared one that is configured, or, only if
    none is and the master is local, a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="quern-"))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own for ``name`` in the checkpoint folder."""
    return f"{checkpointed(spark).sparkContext.getCheckpointDir().rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the checkpoint folder and read again, which cuts its lineage in a way that
    survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._kept = path
    return found


def dealt(df: DataFrame, rows: int, *keys: str, least: int = 8) -> DataFrame:
    """df dealt by keys over so many tasks as its ``rows`` need, so that a task's share does not grow with the table."""
    return df.repartition(max(least, -(-rows // ROWS)), *keys)


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a result of ``kept`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_kept"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
