"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch; with texts of up to some 100 KB a batch stays far below a Python worker's memory.
BATCH_ROWS = 512
#: Bytes of an Arrow batch, beyond which only a single text can go.
BATCH_BYTES = 64 << 20
#: A key with more than this fraction of the rows is hot; there can be only so many of them.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A folder of this machine would not do on a cluster: there a session without the setting is
    an error. Only a session that is one machine alone gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="rillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: what follows neither recomputes it nor depends on an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for whole texts, by rows and by bytes; a smaller setting of the session stays.

    Spark reads both settings when it plans a query, not when a frame is made, so they stay set.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, str(2**31 - 2)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def whole_text(name: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def schema_with(df: DataFrame, extra: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *extra])


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right, in which a key occurs once at most, on a key that may hold any share of left's rows.

    The rows of keys with over 1 / HOT_KEYS of all are joined where they lie, with at most
    HOT_KEYS rows of right that are broadcast; only the others are shuffled. how is "inner" or
    "left". hot: those keys, where the caller has them; else left is read once more to count.
    """
    if hot is None:
        n = left.count()
        hot = left.groupBy(key).count().where(F.col("count") * HOT_KEYS > n).select(key)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    # Hot keys that right lacks stay with the others, where a left join keeps their rows.
    known = F.broadcast(few.select(key))
    return left.join(few, key).unionByName(left.join(known, key, "left_anti").join(right, key, how))
