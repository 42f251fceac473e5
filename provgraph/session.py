"""Session helpers: where intermediate tables go, how a plan is cut, and how such tables are removed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Only where that setting is absent and the session runs in one process is a temporary folder taken, once a session; on a
    cluster executors couldn't see each other's files in one, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="provgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage, survives the loss of executors, and gives the planner the true size of the table.
    """
    path = f"{scratch_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator: ``table`` writes one, ``drop`` removes those that nothing reads any more.

    A dropped table must not be read again, so what was made from it has to be written first.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = path, read
        return read

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            held = self.paths.get(id(df))
            if held:
                remove(self.spark, held[0])

    def drop_others(self, *kept: DataFrame) -> None:
        """Remove all tables but ``kept``."""
        stay = {id(df) for df in kept}
        self.drop(*(df for key, (_, df) in list(self.paths.items()) if key not in stay))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
