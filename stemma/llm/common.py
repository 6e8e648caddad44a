"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on the text bytes that a Python worker handles at once (one longer text is handled alone).
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch; the default of 10,000 holds tens of megabytes of text on either side.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stemma-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage at a place that survives lost executors, and keeps a
    result that several branches read from being computed several times.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again: what was made of them has been written since."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a written table of a few narrow columns, marked for broadcast if it has at most so many rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession) -> None:
    """Let the JVM pass ``BATCH_ROWS`` rows at a time to Python, where the session has no setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist() if batch.nbytes > most else []
    if not sizes:
        if batch.num_rows:
            yield batch
        return
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_texts(docs: DataFrame, fn: Callable[[list, list], dict], schema: str, id_col: str = "doc_id", text_col: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn(ids, texts) -> {column: values}`` to bounded runs of rows; other columns are not read."""
    arrow_schema = _arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=most):
                out = fn(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)
            del batch
            pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _in_slices(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield fn(part)
            del batch
            pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def filter_texts(docs: DataFrame, keep: Callable[[list], list], text_col: str = "text") -> DataFrame:
    """The rows whose text ``keep`` (a list of texts to a list of booleans) is true of, with all columns."""
    return _in_slices(docs, lambda part: part.filter(pa.array(keep(part.column(text_col).to_pylist()), pa.bool_())), text_col)


def replace_texts(docs: DataFrame, fn: Callable[[list], list], text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows with new texts; where a text changes, its length in ``length_col`` (if there is one) does too."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        old = part.column(text_col).to_pylist()
        new = fn(old)
        names, columns = part.schema.names, list(part.columns)
        columns[names.index(text_col)] = pa.array(new, part.schema.field(text_col).type)
        if length_col in names:
            k = names.index(length_col)
            columns[k] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns[k].to_pylist())], columns[k].type)
        return pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return _in_slices(docs, one, text_col)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def new_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, compared as Spark does, without case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
