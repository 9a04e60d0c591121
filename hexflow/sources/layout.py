"""Features laid out along a space-filling curve, so that a small area touches few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow.functions import geometry
from hexflow.functions.classify import LAYERS

#: Features of a file; bits of the curve for each axis.
PER_FILE, BITS = 200_000, 16
MANIFEST = "_manifest"
BOX = ("x0", "y0", "x1", "y1")


def curve(x: Column, y: Column) -> Column:
    """The place on the Z curve of two whole numbers of BITS bits: their bits in turn."""

    def apart(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return apart(x.cast("long")).bitwiseOR(F.shiftleft(apart(y.cast("long")), 1))


def arrange(features: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Writes the features that have a geometry, with their boxes as plain columns, in ranges of the curve through the boxes' middles.

    Beside them goes a table of the files' boxes, a row a file.  Features at one place are told apart by id and shape, so
    a crowded place is many files too.
    """
    boxed = features.withColumn("_b", geometry.bbox(F.col("rings"))).where("_b.x0 is not null")
    boxed = boxed.select(*[c for c in features.columns if c not in BOX], *[F.col(f"_b.{c}").alias(c) for c in BOX])
    low_x, low_y, high_x, high_y, n = boxed.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.count("*")).first()
    if n:
        unit = lambda a, b, low, high: F.floor(((F.col(a) + F.col(b)) / 2 - low) / ((high - low) or 1.0) * ((1 << BITS) - 1))
        code = curve(unit("x0", "x1", low_x, high_x), unit("y0", "y1", low_y, high_y))
        boxed = boxed.withColumn("_code", code).repartitionByRange(-(-n // per_file), "_code", F.xxhash64("feature_id", "rings")).sortWithinPartitions("_code").drop("_code")
    boxed.write.mode("overwrite").parquet(path)
    stored = features.sparkSession.read.schema(boxed.schema).parquet(path)
    files = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def _meets(box: tuple[float, float, float, float]) -> Column:
    return (F.col("x0") <= box[2]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[1])


def files_for(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> list[str]:
    """The files whose box meets this one; of the table of files, only their names come to the driver."""
    return sorted(r.file for r in spark.read.parquet(f"{path}/{MANIFEST}").where(_meets(box)).select("file").collect())


def scan(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features in the layers that matter whose boxes meet ``box``; other files aren't opened, and within a file its row groups' statistics prune."""
    whole = spark.read.parquet(path)
    if box is None:
        return whole.where(F.col("source_layer").isin(LAYERS))
    names = files_for(spark, path, box)
    found = spark.read.schema(whole.schema).parquet(*[f"{path}/{x}" for x in names]) if names else whole.limit(0)
    return found.where(F.col("source_layer").isin(LAYERS) & _meets(box))
