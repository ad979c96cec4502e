"""Indexes of impressions, subjects and captures: CSV tables, directory scans and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.sources.ordered import numbered

INDEX = "path string, source string, finger_id string, impression string"
SUBJECTS = "path string, image string, person string, sex string, hand string, finger string, minutiae int"
#: Order of hands and fingers in every wide table.
HANDS = ("Left", "Right")
FINGERS = ("thumb", "index", "middle", "ring", "little")
#: Sources whose scans have another resolution than the usual one, by their whole names.
RESOLUTION = {"FVC2002_DB2_B": 569, "FVC2004_DB3_B": 512}
USUAL_RESOLUTION = 500
#: Where captures of each type lie below the images' root: folder, captures, folders below that.
CAPTURES = (
    ("roll", "baseline", "UV", "500/roll/png"),
    ("slap", "baseline", "RS", "500/slap-segmented/png"),
    ("roll", "challengers", "ABCDEFGH", "roll/png"),
    ("plain", "auxiliary/flat", "KLMP", "500/plain/png"),
)
IMAGE_FILES = "*.{tif,tiff,bmp,png,jpg,jpeg,TIF,TIFF,BMP,PNG,JPG,JPEG}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header. A missing file is an error."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several CSV files that exists, as where a later step adds columns to an earlier step's table."""
    for path in paths[:-1]:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            return read_csv(spark, path, schema)
    return read_csv(spark, paths[-1], schema)


def number_first(column: str) -> list[Column]:
    """Order by the number that a text is, texts that are none last and by their letters."""
    as_number = F.expr(f"try_cast(`{column}` AS bigint)")
    return [as_number.asc_nulls_last(), F.col(column)]


def index_order() -> list[Column]:
    return [F.col("source"), *number_first("finger_id"), *number_first("impression")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return numbered(read_csv(spark, path, INDEX), index_order())


def read_subjects(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The subject index; limit keeps people numbered up to it."""
    df = read_csv(spark, path, SUBJECTS).withColumn("person", F.col("person").cast("int"))
    df = df.where(F.col("person") <= limit) if limit else df
    return numbered(df, [F.col("person"), F.col("path")])


def hand_order(column: str = "hand") -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, HANDS)), F.col(column)) - 1, F.lit(0)).cast("int")


def finger_order(column: str = "finger") -> Column:
    place = F.array_position(F.array(*map(F.lit, FINGERS)), F.col(column))
    return F.when(place > 0, place - 1).otherwise(0).cast("int")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def impression_name(path: Column) -> Column:
    """finger_id and impression of a name like 12_3; any other name is an item of its own, impression 0."""
    name = stem(path)
    fits = name.rlike(r"^\d+_\d+$")
    return F.struct(F.when(fits, F.substring_index(name, "_", 1)).otherwise(name).alias("finger_id"), F.when(fits, F.substring_index(name, "_", -1)).otherwise("0").alias("impression"))


#: Fixed value: what a subject's file is called. CR, Obl and Zcut name kinds of alteration.
SUBJECT_NAME = rf"^(\d+)__([MF])_({'|'.join(HANDS)})_({'|'.join(FINGERS)})_finger(?:_(CR|Obl|Zcut))?$"


def subject_name(path: Column) -> Column:
    """person, sex, hand, finger and alteration of a name like 7__M_Left_ring_finger_CR; null for other names."""
    name = stem(path)
    parts = [F.regexp_extract(name, SUBJECT_NAME, k).alias(n) for k, n in enumerate(("person", "sex", "hand", "finger", "altered"), 1)]
    return F.when(name.rlike(SUBJECT_NAME), F.struct(*parts))


def capture_name(path: Column) -> Column:
    """person, capture and position number (frgp) of a name like 10000005_R_500_slap-segmented_02: an eight-digit person, a
    device, perhaps a resolution, a kind and a number, which is 1 to 10; null for other names and numbers."""
    part = F.split(stem(path), "_")
    at = lambda k: F.try_element_at(part, F.lit(k))
    last = F.when(at(-1).rlike(r"^\d{1,9}$"), at(-1)).cast("int")
    fits = at(1).rlike(r"^\d{8}$") & at(2).rlike("^[A-Za-z0-9]+$") & at(-2).rlike("^[a-z-]+$")
    fits &= (F.size(part) == 4) | ((F.size(part) == 5) & at(3).rlike(r"^\d+$"))
    return F.when(fits & last.between(1, 10), F.struct(at(1).alias("person"), F.upper(at(2)).alias("capture"), last.alias("frgp")))


def frgp_hand(frgp: str = "frgp") -> Column:
    return F.when(F.col(frgp) <= 5, HANDS[1]).otherwise(HANDS[0])


def frgp_finger(frgp: str = "frgp") -> Column:
    return F.element_at(F.array(*map(F.lit, FINGERS)), ((F.col(frgp) - 1) % 5 + 1).cast("int"))


def frgp_position(frgp: str = "frgp") -> Column:
    """Place in wide tables: left thumb to little, then right thumb to little."""
    return F.when(F.col(frgp) > 5, F.col(frgp) - 6).otherwise(F.col(frgp) + 4).cast("int")


def capture_type(capture: str = "capture") -> Column:
    """roll, slap or plain by the capture's letter; null for others."""
    out = F
    for kind, _, letters, _ in CAPTURES:
        out = out.when(F.col(capture).isin(*letters), kind)
    return out.otherwise(None)


def resolution(source: str = "source", known: dict[str, int] = RESOLUTION, usual: int = USUAL_RESOLUTION) -> Column:
    """Pixels an inch of a source, by its whole name."""
    out = F
    for name, dpi in known.items():
        out = out.when(F.col(source) == name, dpi)
    return out.otherwise(usual)


def scan_captures(spark: SparkSession, root: str) -> DataFrame:
    """path, capture and type of every image that lies in one of the capture folders below root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(root).select("path")
    found = [(kind, F.regexp_extract("path", f"/{top}/([{letters}])/{below}/[^/]+$", 1)) for kind, top, letters, below in CAPTURES]
    matches = F.filter(F.array(*(F.struct(c.alias("capture"), F.lit(kind).alias("type")) for kind, c in found)), lambda x: x["capture"] != "")
    return files.select("path", F.try_element_at(matches, F.lit(1)).alias("x")).where("x is not null").select("path", "x.capture", "x.type")


def scan_subjects(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """path, type and the parts of subject_name of the images of several folders, {type: folder}; other names are skipped."""
    out = None
    for kind, folder in folders.items():
        files = scan_images(spark, folder).select("path", F.lit(kind).alias("type"), subject_name(F.col("path")).alias("x"))
        out = files if out is None else out.unionByName(files)
    return out.where("x is not null").select("path", "type", "x.*")


def scan_images(spark: SparkSession, root: str, source_prefix: str = "") -> DataFrame:
    """path, source (the directory), bytes of every image below root; content is read only if it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_FILES).option("recursiveFileLookup", "true").load(root)
    source = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select("path", source.alias("source"), F.col("content").alias("bytes")).where(source.startswith(source_prefix))


def first_per_capture(df: DataFrame, n: int, key: str = "capture", order: list[str] | str = "path") -> DataFrame:
    """The first n rows of each key; Spark limits them per task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)))).where(F.col("_n") <= n).drop("_n")


def not_done(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Tasks whose key has no finished output yet."""
    return tasks.join(done.select(*key).distinct(), key, "left_anti")
