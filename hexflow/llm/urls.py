"""URL filters: rules by host and path, and a character language-model ratio for the rest.

URLs that a rule accepts or rejects train two variable-order Markov models of bytes: a
context's estimate is smoothed towards its shorter context's by as much as it has different followers
(Witten-Bell), down to an even chance over 256 bytes, so each estimate sums to one.  The order
varies with the text: the longest context that was seen is used.  Every ruled URL of the training folds is counted, repeats too, and every
context is held: counts are a Spark table with a row for each different run of ORDER + 1 bytes, and the shorter contexts' counts
follow from it.  What a byte adds to a URL's difference depends on that run alone, so it is worked out once a run, from the shortest
context up, and joined to the URLs' places.  The difference of the models' log likelihoods, divided by the length, is held against a threshold
that is calibrated on a fold of the ruled URLs that trained neither model.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and is
allowed.  While one class has no training url, everything without a rule is allowed.
Every row gives one result row, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexflow.llm import text as T
from hexflow.llm.shared import Tables, spread_join

ORDER = 4
SCALE = 1 << 40  # sums of whole numbers don't depend on their order
#: Bounds of ``sampled``.
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 20
BINS = 100  # of the difference per character, a unit

# The rules of op5.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: F.Column) -> F.Column:
    """Between the first ``://`` and the next /, ? or #, A-Z lower-cased; else ''."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: F.Column) -> F.Column:
    """After the host, up to ? or #; else ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule (host and path joined) and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def contexts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per order 0..ORDER and byte of the texts: the context's code; the bytes; the texts' offsets.

    A code holds the order and the ORDER bytes before; before a text stand bytes 0.
    """
    offsets, data = T.utf8(column)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    h = np.zeros(len(data), np.uint64)
    found = [h]
    for order in range(1, ORDER + 1):
        before = np.where(place >= order, data[np.maximum(np.arange(len(data)) - order, 0)], 0).astype(np.uint64)
        h = h | before << np.uint64(8 * (order - 1))
        found.append(h | np.uint64(order) << np.uint64(56))
    return np.array(found).reshape(ORDER + 1, -1), data, offsets


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A code for each byte of the texts with the ORDER bytes before it, itself lowest and the nearest next; the texts' offsets."""
    codes, data, offsets = contexts(column)
    return ((codes[ORDER] & np.uint64((1 << 8 * ORDER) - 1)) << np.uint64(8) | data.astype(np.uint64)).view(np.int64), offsets


def _last(n: int) -> F.Column:
    """The run's last n bytes."""
    return F.col("run").bitwiseAND(F.lit((1 << 8 * n) - 1))


@dataclass
class Model:
    """Of all training URLs, the different runs with how often each class (0 allowed, 1 rejected) has them: ``run, n0, n1``."""

    counts: DataFrame
    threshold: float = 0.0

    def values(self, asked: DataFrame, tables: Tables) -> DataFrame:
        """The rows of ``asked`` (a row a run) with ``value``: log likelihood of the run's last byte as rejected less as allowed, in nats / SCALE.

        A run's last bytes are met once, whatever stands before them, so no key of a join has more than 256 rows.
        """
        ends = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), _last(n).alias("end")) for n in range(1, ORDER + 2)])).alias("e")
        held = self.counts.select(ends, "n0", "n1").groupBy("e.size", "e.end").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        context = F.shiftright("end", 8).alias("context")
        after = held.groupBy("size", context).agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1"))
        own = asked.select(ends).select("e.size", "e.end").distinct().join(held, ["size", "end"], "left").select("*", context)
        own = tables.keep(own.join(after, ["size", "context"], "left").drop("context"))
        better = lambda c: F.when(F.col(f"all{c}") > 0, (F.coalesce(f"n{c}", F.lit(0)) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"all{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}")).alias(f"p{c}")
        chance = own.where("size = 1").withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)}).select("end", better(0), better(1))
        for n in range(2, ORDER + 2):
            shorter = F.col("end").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))
            chance = own.where(F.col("size") == n).withColumn("shorter", shorter).join(chance.withColumnRenamed("end", "shorter"), "shorter").select("end", better(0), better(1))
        return chance.select(F.col("end").alias("run"), F.round((F.log("p1") - F.log("p0")) * SCALE).cast("long").alias("value")).join(asked, "run")

    def difference(self, column: pa.Array) -> np.ndarray:
        """``differences`` of a few texts."""
        rows = self.counts.sparkSession.createDataFrame(pa.table({"place": pa.array(range(len(column)), pa.int64()), "text": column}))
        return differences(rows, self, "place").orderBy("place").toArrow().column("difference").to_numpy()


def sampled(ruled: DataFrame, cls: int) -> DataFrame:
    """``rejected, text, n``: some training URLs of one class to look at, each once with its number of rows.  No model, count or threshold comes from them."""
    each = ruled.where((F.col("fold") != 0) & (F.col("rejected") == cls)).groupBy("rejected", "text").agg(F.count("*").alias("n"))
    some = each.orderBy(F.xxhash64("text"), "text").limit(SAMPLE)
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("rejected").orderBy(F.xxhash64("text"), "text"))  # SAMPLE rows
    return some.withColumn("_b", so_far).where(F.col("_b") <= SAMPLE_BYTES).drop("_b")


def learn(ruled: DataFrame) -> Model | None:
    """From all rows of ``text, rejected (0/1), fold``: fold 0 calibrates, the others train."""

    def count(batches):
        for batch in batches:
            run, offsets = runs(batch.column("text"))
            cls = np.repeat(batch.column("rejected").to_numpy(), np.diff(offsets))
            different, at = np.unique(run, return_inverse=True)
            n = [np.bincount(at[cls == c], minlength=len(different)).astype(np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(different), *map(pa.array, n)], names=["run", "n0", "n1"])

    tables = Tables(ruled.sparkSession)
    each = ruled.where("fold <> 0").select("text", F.col("rejected").cast("int").alias("rejected")).mapInArrow(count, "run long, n0 long, n1 long")
    counts = tables.keep(each.groupBy("run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    if not all(counts.agg(F.sum("n0"), F.sum("n1")).first()):
        tables.drop(counts)
        return None
    model = Model(counts)
    told = differences(ruled.where("fold = 0"), model, "rejected")
    bins = told.groupBy(F.round(F.col("difference") * BINS).cast("int").alias("bin"), "rejected").count().toPandas()
    tables.drop(told)
    if bins.rejected.nunique() == 2:
        table = bins.pivot_table(index="bin", columns="rejected", values="count", fill_value=0).sort_index()
        right = table[0].cumsum() / table[0].sum() + 1 - table[1].cumsum() / table[1].sum()
        best = right[right >= right.max() - 1e-12].index
        after = right.index[right.index > best.max()]  # the best cut holds until the next bin that anything fell into
        model.threshold = (best.max() + (after.min() if len(after) else best.max() + 1)) / 2 / BINS
    return model


def differences(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns kept, and ``difference`` of each row's ``text``: log likelihood as rejected less as allowed, per byte, in nats; 0 for empty texts.

    The result is a written table.
    """
    tables = Tables(rows.sparkSession)
    given = tables.keep(rows.select("text", *keep).withColumn("_row", F.monotonically_increasing_id()))

    def met(batches):
        for batch in batches:
            run, n = np.unique(runs(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(n.astype(np.int64))], names=["run", "n"])

    def places(batches):
        for batch in batches:
            run, offsets = runs(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("_row").to_numpy(), np.diff(offsets))), pa.array(run)], names=["_row", "run"])

    asked = tables.keep(given.select("text").mapInArrow(met, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")))
    values = tables.keep(model.values(asked, tables))
    total = values.agg(F.sum("n")).first()[0] or 0
    sums = spread_join(given.select("_row", "text").mapInArrow(places, "_row long, run long"), values, "run", "n", total).groupBy("_row").agg(F.sum("value").alias("_sum"))
    per_byte = F.coalesce(F.col("_sum") / SCALE / F.octet_length("text"), F.lit(0.0))
    out = tables.keep(given.join(sums, "_row", "left").select(*keep, per_byte.alias("difference")))
    tables.drop(given, asked, values)
    return out


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict`` of every row, and the ``difference`` of those without a rule."""
    url = F.col(url_col)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    text = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    given = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), text.alias("text"))
    given = given.withColumns({"rule": rule, "ruled": verdict})
    fold = F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(5)).cast("int")
    model = learn(given.where("ruled is not null").select("text", (F.col("ruled") == "block").cast("int").alias("rejected"), fold.alias("fold")))
    if model is None:
        return given.select("id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("difference"))
    judged = differences(given, model, "id", "host", "path", "rule", "ruled")
    Tables(pages.sparkSession).drop(model.counts)
    said = F.when((F.col("host") != "") & (F.col("difference") > model.threshold), "block").otherwise("allow")
    return judged.select("id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("difference")).alias("difference"))


def op5_markov_ratio(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
