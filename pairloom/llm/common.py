"""What the training-data operators share: reading tables, staged tables, batches of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What the words of a text are, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch. Texts can be long, and a batch is held in memory whole.
BATCH_ROWS = 250
BATCH_BYTES = 4 << 20

#: What a task of a shuffle is to read, about.
PARTITION_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: The folder of each local application whose session names none.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local session that names none, as in tests, gets a folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _FOLDERS:
            _FOLDERS[application] = tempfile.mkdtemp(prefix="pairloom-")
        where = _FOLDERS[application]
    return where.rstrip("/")


_PATHS: "weakref.WeakKeyDictionary[DataFrame, object]" = weakref.WeakKeyDictionary()

#: Spark then deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Later stages depend on the files and not on the lineage behind them, so a lost executor
    costs them nothing, and the shuffle files of the write go with its end. The table goes with
    discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom/{uuid.uuid4().hex}/{name}"
    with no_shuffle_files_left(spark):
        df.write.parquet(path, compression=compression)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = jpath
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        path = _PATHS.pop(t)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df is made from, by Spark's statistics.

    Where a table has none (rows of a connector, a view over one, a stream's batch), one aggregate counts the bytes of df's texts;
    half of them stand for the file, as packed texts are about half as long.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    if all(x < 1 << 60 for x in sizes):
        return sum(sizes)
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    each = sum(texts, F.lit(8 * len(df.columns))).cast("long")
    return (df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0] + 1) // 2


def partitions_for(size: int) -> int:
    """How many partitions hold about PARTITION_BYTES each."""
    return max(1, -(-size // PARTITION_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> "F.Column":
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_texts(docs: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Run work(texts) -> columns over every text; the id passes through unchanged.

    schema names the id and then what work returns, a list of columns of the same length. also:
    columns that work gets besides the texts, as lists.
    """
    spark = docs.sparkSession
    small_batches(spark)
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *also)
    out = spark.createDataFrame([], schema).schema
    id_name, arrow = out[0].name, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        nonlocal arrow
        arrow = arrow or to_arrow_schema(out)
        for batch in batches:
            if batch.num_rows:
                columns = work(texts_of(batch), *(batch.column(c).to_pylist() for c in also))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").cast(arrow.field(id_name).type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def append_columns(docs: DataFrame, work, fields: str, text_col: str = "text") -> DataFrame:
    """docs with the columns of `fields` appended, computed by work(texts); all other columns pass through."""
    spark = docs.sparkSession
    small_batches(spark)
    added = spark.createDataFrame([], fields).schema
    clash = set(docs.columns) & set(added.names)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    schema = StructType([*docs.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = list(to_arrow_schema(added))
        for batch in batches:
            if batch.num_rows:
                columns = [pa.array(c, f.type) for c, f in zip(work(texts_of(batch, text_col)), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in arrow)])

    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> "F.Column":
    """Whether labels of this document may not be learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents that are not held out, by least hash of the id.

    The sample is bounded, so its ids are broadcast to the documents; it is kept as a table.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select(F.col(id_col).alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return staged(found.drop("_id"), "training")
