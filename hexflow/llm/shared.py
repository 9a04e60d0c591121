"""The folder that driver and executors share, tables kept there, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of all rows: there are never more hot keys than that.
HOT = 1024
#: Places that the rows of a hot key are dealt over.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; without one, a session of one process gets a temporary one and a cluster is told."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


#: Spark's setting that drops an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Steps' results as Parquet under the shared folder; they cut lineage and can go once the next step is written.

    A step's own shuffle files go when it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.place, self.n = spark, f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, before = f"{self.place}/{self.n}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes what ``keep`` wrote; nothing that is still to be computed may read it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._path)
            path.getFileSystem(conf).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined on ``key`` with ``small``, which has a row a key and in ``size`` that key's rows in ``big``.

    The rows of a hot key are dealt over SALTS places by a hash of all their columns, and the
    key's row of ``small`` goes to each.  Of ``small``, only the hot keys are broadcast, HOT at most.
    """
    hot = F.col(size) * HOT > max(total, HOT * SALTS)
    keys = small.where(hot).select(key, F.lit(True).alias("_hot"))
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    left = big.join(F.broadcast(keys), key, "left").withColumn("_salt", dealt).drop("_hot")
    places = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.join(small.withColumn("_salt", F.explode(places)), [key, "_salt"], how).drop("_salt")
