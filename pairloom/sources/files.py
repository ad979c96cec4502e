"""Score matrices, block maps, minutiae, duplicate groups, verdicts and errata, and the sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many bytes of a raw matrix are made or written at once.
RANGE_BYTES = 4 << 20
#: So many of these are one task's, and come to the driver at once.
RANGES_OF_TASK = 8
#: Cells of a matrix that a task gathers before it packs them.
CELLS = 1_000_000
RECORDS = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def read_matrix(spark: SparkSession, path: str, rows: int, columns: int | None = None, kind: str = "<i4", missing: float | None = -1) -> DataFrame:
    """(i, j, score) of a headerless little-endian matrix whose shape an index implies; missing scores are left out.

    The file is split between tasks at row boundaries, so it can be of any size.
    """
    columns = columns or rows
    item = np.dtype(kind)
    length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if length != rows * columns * item.itemsize:
        raise ValueError(f"{length} bytes are no {rows} x {columns} matrix of {item}")
    size = {f"{RECORDS}.recordLength": str(columns * item.itemsize)}
    records = spark.sparkContext.newAPIHadoopFile(path, RECORDS, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=size)
    lines = spark.createDataFrame(records.map(lambda r: (int(r[0]), bytes(r[1]))), "i long, line binary")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, line in zip(batch.column("i").to_pylist(), batch.column("line")):
                values = np.frombuffer(line.as_buffer(), item)
                keep = np.flatnonzero(values != missing) if missing is not None else np.arange(columns)
                score = values[keep].astype(np.int64 if item.kind == "i" else np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), i)), pa.array(keep), pa.array(score)], ["i", "j", "score"])

    return lines.mapInArrow(unpack, f"i long, j long, score {'long' if item.kind == 'i' else 'double'}")


def _pack_cells(i: np.ndarray, j: np.ndarray, values: np.ndarray, each: int) -> Iterator[tuple[int, bytes]]:
    """Range of rows, and its cells: number of runs, row, first column and length of each, and the values end to end."""
    order = np.lexsort((j, i))
    i, j, values = i[order], j[order], values[order]
    start = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1] + 1)))
    length = np.diff(np.append(start, len(i)))
    ranges = i[start] // each
    cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
    for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(start)).tolist()):
        own = values[start[x] : start[y - 1] + length[y - 1]]
        yield int(ranges[x]), b"".join([np.int64(y - x).tobytes(), *(c[x:y].astype("<i8").tobytes() for c in (i[start], j[start], length)), own.tobytes()])


def _put_cells(block: bytes, item: np.dtype, first: int, out: np.ndarray) -> None:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    i, j, length = np.frombuffer(block, "<i8", 3 * n, 8).reshape(3, n)
    values, at = np.frombuffer(block, item, offset=8 + 24 * n), 0
    for row, column, size in zip((i - first).tolist(), j.tolist(), length.tolist()):
        out[row, column : column + size] = values[at : at + size]
        at += size


def write_matrix(edges: DataFrame, path: str, rows: int, columns: int | None = None, kind: str = "<i4", missing: float = -1, symmetric: bool = False) -> None:
    """A raw matrix in one file. Tasks make ranges of rows; the driver puts them end to end and holds a few at a time.

    Cells travel once, as runs of values packed where they are made.
    """
    from pairloom.sources.scratch import _open

    columns = columns or rows
    item, spark = np.dtype(kind), edges.sparkSession
    each = max(1, RANGE_BYTES // (columns * item.itemsize))
    ranges = -(-rows // each)
    tasks = max(1, -(-ranges // RANGES_OF_TASK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            i, j, score = (np.concatenate(c) for c in zip(*held))
            parts = list(_pack_cells(i, j, score.astype(item), each))
            for at in range(0, len(parts), 500):
                r, data = zip(*parts[at : at + 500])
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(data, pa.binary())], ["r", "cells"])

        for batch in batches:
            i, j, score = (batch.column(c).to_numpy() for c in ("i", "j", "score"))
            for a, b in ((i, j), (j, i)) if symmetric else ((i, j),):
                known = (a >= 0) & (a < rows) & ~np.isnan(score)
                held.append((a[known], b[known], score[known]))
                size += int(known.sum())
            if size >= CELLS:
                yield from packed()
                held.clear()
                size = 0
        if size:
            yield from packed()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None
        line = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["r", "data"])
        for batch in batches:
            for r, cells in zip(batch.column("r").to_pylist(), batch.column("cells")):
                if r != now:
                    if now is not None:
                        yield line()
                    now, out = r, np.full((min(each, rows - r * each), columns), missing, item)
                if cells.is_valid:
                    _put_cells(cells.as_py(), item, now * each, out)
        if now is not None:
            yield line()

    cells = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "score").dropna().mapInArrow(pack, "r long, cells binary")
    every = spark.range(ranges).select(F.col("id").alias("r"), F.lit(None).cast("binary").alias("cells"))
    # Ranges in a row are one task's, so that tasks follow one another as the file does.
    dealt = cells.unionByName(every).repartitionById(tasks, F.floor(F.col("r") * tasks / ranges).cast("int")).sortWithinPartitions("r")
    file_system, where = _open(spark, path)
    out = file_system.create(where, True)
    try:
        for row in dealt.mapInArrow(lay, "r long, data binary").toLocalIterator(prefetchPartitions=True):
            out.write(row["data"])
    finally:
        out.close()


def read_grid(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(image, r, c, name) of text files with a grid of whole numbers each; the image is the file's stem."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("image"), "value")
    lines = text.select("image", F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s*\n\s*")).alias("r", "line"))
    return lines.select("image", "r", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", name)).withColumn(name, F.col(name).cast("int"))


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    """image, r, c, dir, quality, curved from the three maps of every image below root."""
    maps = [read_grid(spark, f"{root}/*.{ending}", name) for ending, name in (("dm", "dir"), ("qm", "quality"), ("hcm", "curved"))]
    return maps[0].join(maps[1], ["image", "r", "c"]).join(maps[2], ["image", "r", "c"])


def read_minutiae(spark: SparkSession, path: str) -> DataFrame:
    """image, x, y, theta, quality: lines of four fields or more; a quality that is no whole number is null."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("image"), F.split(F.trim("value"), r"\s+").alias("f"))
    fields = [F.expr(f"try_cast(f[{k}] AS int)").alias(n) for k, n in enumerate(("x", "y", "theta", "quality"))]
    return lines.where(F.size("f") >= 4).select("image", *fields)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group, place, tag) of a JSON list of lists; place 0 is the copy that is kept."""
    groups = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("group", "tags"))
    return groups.select("group", F.posexplode("tags").alias("place", "tag"))


def without_later_copies(df: DataFrame, groups: DataFrame, tags: list[str]) -> DataFrame:
    """df without the rows one of whose tag columns names a later copy of a group."""
    later = groups.where("place > 0").select("tag").distinct()
    for t in tags:
        df = df.join(later.withColumnRenamed("tag", t), t, "left_anti")
    return df


VERDICTS = "na string, nb string, rot string, veredito string, gravado_em string"


def verdicts(log: DataFrame) -> DataFrame:
    """a, b, label, verdict, at: the names in the log's fields, which are fixed values, as columns."""
    return log.select(F.col("na").alias("a"), F.col("nb").alias("b"), F.col("rot").alias("label"), F.col("veredito").alias("verdict"), F.to_timestamp("gravado_em").alias("at"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return verdicts(spark.read.schema(VERDICTS).json(path))


def latest(log: DataFrame, key: tuple[str, ...] = ("a", "b"), order: str = "at") -> DataFrame:
    """The last row of each key; a combinable maximum, so that long histories do not travel."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("x"))
    return last.select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))


def checked(log: DataFrame, pairs: int, verdict: str) -> DataFrame:
    """log, if it has exactly this many different pairs and all verdicts are the same; otherwise an error."""
    n, odd = log.agg(F.countDistinct("a", "b"), F.count_if(~F.col("verdict").eqNullSafe(verdict))).first()
    if n != pairs or odd:
        raise ValueError(f"{n} pairs instead of {pairs}, {odd} other verdicts")
    return log


def append_line(spark: SparkSession, path: str, record: dict) -> None:
    """Add a record to a log, with the time in whole seconds. The log is a folder of JSON lines, one file for each record,
    as shared stores mostly cannot append."""
    from datetime import datetime

    from pairloom.sources.scratch import put

    line = json.dumps(record | {"gravado_em": datetime.now().isoformat(timespec="seconds")}, ensure_ascii=False) + "\n"
    put(spark, f"{path}/{uuid.uuid4().hex}.json", line.encode())


def errata(lines: DataFrame, column: str = "value") -> DataFrame:
    """(person, capture) named in free text. A line names them in words, an eight-digit person somewhere and a device after
    that word, or by files, whose names begin with a person and a capture."""
    words = lines.select(F.split(column, r"\s+").alias("spaced"), F.split(column, r"\W+").alias("words"))
    person = F.try_element_at(F.filter("words", lambda w: w.rlike(r"^\d{8}$")), F.lit(1))
    after = F.transform(F.filter(F.arrays_zip(F.slice("spaced", 1, F.size("spaced") - 1).alias("a"), F.slice("spaced", 2, F.size("spaced")).alias("b")), lambda x: x["a"].rlike(r"(^|\W)[Dd]evice$")), lambda x: F.regexp_extract(x["b"], r"^([A-Za-z0-9]+)(\W|$)", 1))
    device = F.try_element_at(F.filter(after, lambda x: x != ""), F.lit(1))
    spoken = words.select(person.alias("person"), F.upper(device).alias("capture")).dropna()
    names = words.select(F.explode("words").alias("w")).select(F.split("w", "_").alias("part"))
    written = names.where((F.size("part") > 2) & F.col("part")[0].rlike(r"^\d{8}$") & F.col("part")[1].rlike("^[A-Za-z0-9]+$"))
    return spoken.unionByName(written.select(F.col("part")[0].alias("person"), F.upper(F.col("part")[1]).alias("capture"))).distinct()


def read_errata(spark: SparkSession, path: str) -> DataFrame:
    return errata(spark.read.text(path))


def without_errata(df: DataFrame, named: DataFrame, flag: str | None = None) -> DataFrame:
    """df without the rows whose person and capture (any case) are among those named, and without those that flag marks already."""
    df = df.where(F.coalesce(F.expr(f"try_cast(`{flag}` AS int)"), F.lit(0)) == 0) if flag else df
    bad = named.select(F.col("person").alias("_p"), F.upper("capture").alias("_c")).distinct()
    return df.join(bad, (F.col("person") == F.col("_p")) & (F.upper("capture") == F.col("_c")), "left_anti")


def persons_in(log: DataFrame, columns: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The persons, as whole numbers, in whose files' names (such as x/12__M_Left_thumb_finger) the columns' paths end."""
    paths = log.select(F.explode(F.array(*columns)).alias("path"))
    number = F.regexp_extract("path", r"/(\d+)__[^/]*$", 1)
    return paths.select(F.when(number != "", number).cast("long").alias("person")).dropna().distinct()


def without_persons(df: DataFrame, persons: DataFrame, columns: tuple[str, ...] = ("person",)) -> DataFrame:
    """df without rows one of whose person columns is among persons."""
    for c in columns:
        df = df.join(persons.select(F.col("person").alias(c)).distinct(), c, "left_anti")
    return df


def read_excluded(spark: SparkSession, path: str, otherwise: list[int]) -> DataFrame:
    """person, from a JSON list, or from a list in the program where there is no such file."""
    from pairloom.sources.scratch import exists

    if not exists(spark, path):
        return spark.createDataFrame([(p,) for p in otherwise], "person long")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<long>")).alias("person"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, ax, ay, bx, by): marked correspondences of JSON documents {"a": [[x, y], ...], "b": [...]}, numbered from 1; name: the file's stem."""
    point = "array<array<double>>"
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name")
    doc = spark.read.text(path, wholetext=True).select(name, F.from_json("value", f"a {point}, b {point}").alias("d"))
    both = doc.select("name", F.posexplode(F.arrays_zip("d.a", "d.b")).alias("k", "p"))
    return both.select("name", (F.col("k") + 1).alias("n"), *(F.col("p")[side][k].alias(f"{side}{axis}") for side in "ab" for k, axis in enumerate("xy")))


def read_pairs(spark: SparkSession, path: str, label: str = "rotulo") -> DataFrame:
    """a, b, label of a CSV file of pairs of names; a file without the label column, a fixed value, has empty labels."""
    df = spark.read.csv(path, header=True)
    return df.select(F.col("a"), F.col("b"), F.coalesce(F.col(label), F.lit("")).alias("label") if label in df.columns else F.lit("").alias("label"))


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, built and written first if no finished one is there."""
    from pairloom.sources.scratch import exists

    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resumed(spark: SparkSession, tasks: str, out: str, marks: str, run, files_per_batch: int = 1) -> DataFrame:
    """run(rows) of every file of tasks, a few files at a time; what was broken off goes on where it was.

    Which files are done is kept by a stream's checkpoint in marks, and a batch that is done anew replaces its own partition, so
    each row of tasks is in the result once, wherever a run ended. New files of tasks are done by the next run.
    """

    def commit(rows: DataFrame, number: int) -> None:
        run(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = spark.readStream.schema(spark.read.parquet(tasks).schema).option("maxFilesPerTrigger", files_per_batch).parquet(tasks)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def with_metadata(df: DataFrame, people: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with columns of people, empty text where a person is not among them."""
    joined = df.join(people.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def write_histogram(hist: DataFrame, path: str, score: str = "score") -> None:
    """Sorted CSV files: score, count, zeros filled in."""
    from pairloom.operators.tails import zero_filled
    from pairloom.sources.ordered import write_sorted

    write_sorted(zero_filled(hist, score).select(F.col(score).alias("score"), F.col("n").alias("count")), path, ["score"])


def document(**parts: DataFrame) -> DataFrame:
    """One row, `json`: a nested document with a list of rows for each part. Parts are results, a few rows each."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
        out = row if out is None else out.crossJoin(row)
    return out.select(F.to_json(F.struct(*parts)).alias("json"))


def write_document(path: str, **parts: DataFrame) -> None:
    document(**parts).coalesce(1).write.text(path)


def write_features(df: DataFrame, path: str, order: list, columns: list[str] | None = None) -> None:
    """Sorted CSV files; doubles with six places, missing values as empty text."""
    kinds = dict(df.dtypes)
    columns = columns or df.columns
    # Sorted by the values as they are, not as they are shown.
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.6f", c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{k}") for k, c in enumerate(order)]
    rows = df.select(*keys, F.struct(*shown).alias("_row")).orderBy(*(f"_o{k}" for k in range(len(keys))))
    rows.select("_row.*").write.csv(path, header=True, mode="overwrite", nullValue="", emptyValue="")
