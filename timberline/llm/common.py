"""Helpers of the corpus operators: tables, hold-out rule, bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import configure, scratch_path
from timberline.sources import storage

# Texts per Arrow batch: long texts must not add up to a large batch.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, so that other columns never clash with its own. A null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def remainder(n: int) -> Column:
    """The hold-out rule's remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def lower_ascii(column: str | Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """At most ``per_class`` whole texts of each label value outside the held-out fifth, chosen by a hash of the id.

    The bound is what makes it fit the driver; only ids pass the ordering, texts are fetched for the chosen ones. A
    document chosen for both values counts as 1.
    """
    train = labels.where(F.col(label).isNotNull() & (remainder(5) != 0)).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = None
    for value in (0, 1):
        part = train.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = docs.join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("y").alias("y"))), "doc_id").select("text", "y").where(F.col("text").isNotNull())
    return [(r.text, r.y) for r in found.toLocalIterator()]


def logistic_fit(x, y, rounds: int = 60, ridge: float = 1e-3):
    """Weights (bias last) of a small logistic regression by Newton steps."""
    import numpy as np

    x = np.column_stack([np.asarray(x, float).reshape(len(y), -1), np.ones(len(y))])
    y, w = np.asarray(y, float), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return w


def logistic(x, w):
    import numpy as np

    x = np.asarray(x, float)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def frames(batches: Iterator, make) -> Iterator:
    """``make(ids, texts)`` gives the columns to put beside each batch's ids."""
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_pydict(make(batch.column("doc_id"), batch.column("text").to_pylist()))


def keep_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` whose text is kept; each row is judged by its own text, so ids may be null or repeat.

    ``judge()`` makes, once per task, a function from a text (null: empty) to whether its row stays.
    """
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        keeps = judge()
        for batch in batches:
            yield batch.filter(pa.array([keeps(x or "") for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class Steps:
    """Tables an operator writes to the shared folder between its steps; each is removed once no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            storage.remove(self.spark, self.paths.pop(frame))
