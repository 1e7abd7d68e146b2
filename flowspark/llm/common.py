"""Helpers that the operators share: sessions, durable tables, Arrow mapping."""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: everything between these six white-space characters.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows of a batch that goes to Python; with texts of up to 1 MB a batch stays bounded.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package; bound their batches."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set on a local master (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.conf.set("spark.checkpoint.dir", "file:///tmp/checkpoints")
    return "file:///tmp/checkpoints"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by now; what is left is only disk space
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: no later stage computes the table again, and it
    survives the loss of executors.  The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts and shuffles of plans that are done: its cleaner follows the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()


def shared_file(spark: SparkSession, content: bytes, name: str) -> str:
    """Write bytes to a file of the shared folder and hand it to all executors; its name there, for SparkFiles.get."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    for start in range(0, len(content), 8 << 20):
        out.write(bytearray(content[start : start + (8 << 20)]))
    out.close()
    atexit.register(_remove, spark, path)
    spark.sparkContext.addFile(path)
    return name


def map_batches(df: DataFrame, function, schema: str, start=None) -> DataFrame:
    """mapInArrow with a function from one record batch to columns by name.

    `function(batch)` returns a dict of lists or arrays in the order of `schema`.  With
    `start`, what it makes for each task is the function's second argument, and goes
    when the task ends.
    """
    prepare(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches):
        own = () if start is None else (start(),)
        for batch in batches:
            if batch.num_rows:
                out = function(batch, *own)
                columns = [out[f.name] if isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, parsed)


def let(value: Column, body) -> Column:
    """`body(x)` with x bound to `value` once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The contract's words of a text, as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
