"""What the operators share: intermediate tables, size-checked joins, ids."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Ids whose set may be sent to every executor, in bytes. Beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bytes of input for a bucket that one task holds in memory.
BUCKET_BYTES = 128 << 20
#: Bytes of the rows that a Python worker gets at a time.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below `spark.checkpoint.dir`.

    Where that setting is absent a local session, as in tests, gets a temporary
    folder of this machine; on a cluster that is an error, as no folder of one machine
    is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.folio.local.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.folio.local.dir", root)
    return f"{root.rstrip('/')}/folio-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again.

    This cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # Spark deletes a finished job's shuffle files once its objects are collected
    table = spark.read.schema(df.schema).parquet(path)
    table._folio_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(table: DataFrame) -> None:
    """Delete a table that `stored` wrote, once nothing that is still to run reads it."""
    _delete(table.sparkSession, table._folio_path)


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results not yet written need them."""
    _delete(spark, shared_dir(spark))


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get rows in batches of `BATCH_BYTES`, which end with the row that reaches it.

    Each task holds its batches several times, in the executor's memory outside the heap and in the
    worker's. Spark's own bound, 64 MB, is for executors of more memory. The setting stays in
    the session, as rows are computed after a query has returned; a lower one is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def local(spark: SparkSession, schema: StructType, *columns: Sequence) -> DataFrame:
    """A small table of the driver's values, which takes no Python workers: `createDataFrame` of rows starts a second set of them."""
    fields = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), schema)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of `docs` has one of them (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def buckets_of(docs: DataFrame) -> int:
    """Buckets for a task each: the shuffle's partitions, or more where the input has more than `BUCKET_BYTES` for each."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size > 1 << 56 else max(least, -(-size // BUCKET_BYTES))  # an unknown size is reported as huge


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Semi or anti join with a stored table of ids.

    `ids` has the one column `key` and must be cheap to count (a stored table).
    It is sent to every executor only if 16 bytes an id stay under `limit`;
    beyond that both sides are shuffled.
    """
    if ids.count() * 16 <= limit:
        return df.join(F.broadcast(ids), key, how)
    return df.join(ids.hint("shuffle_merge"), key, how)
