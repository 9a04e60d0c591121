"""The folder that driver and executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; without one, a session of one process gets a temporary one and a cluster is told."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


class Steps:
    """Tables of one computation under the shared folder: lineage ends there and nothing is computed twice."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place, self.n = spark, f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.place}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Kept tables of one schema as one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._path for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        """Deletes kept tables; nothing that is still to be computed may read them."""
        for t in tables:
            self._delete(t._path)

    def drop_all(self) -> None:
        """Deletes all that this computation kept."""
        self._delete(self.place)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet under the shared folder."""
    return Steps(df.sparkSession).keep(df)
