"""Queries of sources and sinks, cleaning and tallies, with their SQL.

Each writes files made from whole tables into a scratch folder, and reads them again with the
library's own readers. Where a format has one file for each item, the items are the rows of `nation`.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.columns import axial_wrap
from pairloom.functions.intervals import clopper_pearson
from pairloom.operators import cleaning, fields, pairs, resample, tails
from pairloom.operators.scorers import closeness, external, one_sided, program, similarity
from pairloom.plans.catalog import query
from pairloom.plans.dependence_queries import ITER, OBS, TWO_VARIABLES, means_sql, null_sql, whole, z_sql
from pairloom.plans.pair_queries import BOTH, CLASSED, IDX, ONE, TWO_WAY, best, counted
from pairloom.sources import files, images, indexes
from pairloom.sources.analogues import impressions, read
from pairloom.sources.ordered import read_lines, write_sorted
from pairloom.sources.scratch import put, scratch
from pairloom.streaming import verdicts as stream

HAND = "CASE WHEN {} % 2 = 0 THEN 'Left' ELSE 'Right' END"
FINGER = "list_extract(['thumb', 'index', 'middle', 'ring', 'little'], CAST({} % 5 AS INTEGER) + 1)"


def nations(spark, sf_dir) -> list[tuple[int, int]]:
    """(n_nationkey, n_regionkey), a table of fixed size."""
    return [(r.n_nationkey, r.n_regionkey) for r in read(spark, sf_dir, "nation").collect()]


def one_csv(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.csv(path, header=True)
    return path


# Indexes

INDEX_SQL = """i AS (SELECT vec_id, 'DB' || vec_id % 4 AS source, CASE WHEN label % 7 = 0 THEN 'x' || label ELSE '' || label END AS finger_id, '' || vec_id AS impression FROM embeddings),
    n AS (SELECT *, row_number() OVER (ORDER BY source, TRY_CAST(finger_id AS BIGINT) NULLS LAST, finger_id, TRY_CAST(impression AS BIGINT) NULLS LAST, impression) - 1 AS idx FROM i)"""


def _index_rows(spark, sf_dir):
    finger = F.when(F.col("label") % 7 == 0, F.concat(F.lit("x"), "label")).otherwise(F.col("label").cast("string"))
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("img/"), "vec_id").alias("path"), F.concat(F.lit("DB"), F.col("vec_id") % 4).alias("source"), finger.alias("finger_id"), F.col("vec_id").cast("string").alias("impression"))
    return rows


@query(f"WITH {INDEX_SQL} SELECT idx, '/root/img/' || vec_id AS path, source || '/' || finger_id AS key FROM n")
def index_scan(spark, sf_dir):
    path = scratch(spark)
    write_sorted(_index_rows(spark, sf_dir), path, indexes.index_order())
    return indexes.read_index(spark, path).select("idx", F.concat(F.lit("/root/"), "path").alias("path"), F.concat_ws("/", "source", "finger_id").alias("key"))


@query(f"WITH {INDEX_SQL} SELECT idx, 'img/' || vec_id AS path FROM n")
def index_sorted(spark, sf_dir):
    """The order of the written file itself."""
    path = scratch(spark)
    write_sorted(_index_rows(spark, sf_dir), path, indexes.index_order())
    lines = read_lines(spark, path, "path,source,finger_id,impression")
    return lines.select(F.col("place").alias("idx"), F.split("line", ",")[0].alias("path"))


SUBJECT_SQL = f"""s AS (SELECT vec_id // 10 AS person, vec_id // 10 || '__' || CASE WHEN vec_id // 10 % 2 = 0 THEN 'M' ELSE 'F' END || '_' || {HAND.format('(vec_id % 10 // 5)')} || '_' || {FINGER.format('vec_id')} || '_finger' AS path FROM embeddings)"""


def _subject_file(spark, sf_dir) -> str:
    names = F.array(*map(F.lit, indexes.FINGERS))
    df = impressions(spark, sf_dir).select("person", "hand", "finger")
    sex, hand, finger = F.when(F.col("person") % 2 == 0, "M").otherwise("F"), F.when(F.col("hand") == 0, "Left").otherwise("Right"), F.element_at(names, F.col("finger").cast("int") + 1)
    stem = F.format_string("%d__%s_%s_%s_finger", F.col("person").cast("long"), sex, hand, finger)
    path = scratch(spark)
    write_sorted(df.select(stem.alias("path"), F.lit("").alias("image"), F.col("person").cast("string"), sex.alias("sex"), hand.alias("hand"), finger.alias("finger"), F.lit(12).alias("minutiae")), path, [F.col("person").cast("int"), F.col("path")])
    return path


@query(f"WITH {SUBJECT_SQL} SELECT row_number() OVER (ORDER BY person, path) - 1 AS idx, CAST(person AS INTEGER) AS person, path FROM s")
def subject_scan(spark, sf_dir):
    return indexes.read_subjects(spark, _subject_file(spark, sf_dir)).select("idx", "person", "path")


@query(f"WITH {SUBJECT_SQL} SELECT row_number() OVER (ORDER BY person, path) - 1 AS idx, CAST(person AS INTEGER) AS person FROM s WHERE person <= 20")
def rect_subject_limit(spark, sf_dir):
    return indexes.read_subjects(spark, _subject_file(spark, sf_dir), limit=20).select("idx", "person")


@query("SELECT count(*) AS n, CAST(sum(area) AS BIGINT) AS total FROM (SELECT l_suppkey, count(*) AS area FROM lineitem GROUP BY 1)")
def fallback_scan(spark, sf_dir):
    """The first file of two is missing, so the second is read."""
    path = one_csv(read(spark, sf_dir, "lineitem").groupBy("l_suppkey").count(), scratch(spark))
    return indexes.read_first(spark, [f"{path}-better", path], "person long, area long").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("total"))


# Folders of files

FVC = ("FVC2002_DB1_B", "FVC2002_DB2_B", "FVC2004_DB3_B", "FVC2004_DB2_B", "others")


@query(f"""SELECT f.source, CASE WHEN k % 5 = 0 THEN 'odd' || k ELSE '' || k END AS finger_id, CASE WHEN k % 5 = 0 THEN '0' ELSE '' || (r + 1) END AS impression,
    CASE WHEN f.source = 'FVC2002_DB2_B' THEN 569 WHEN f.source = 'FVC2004_DB3_B' THEN 512 ELSE 500 END AS dpi
    FROM (SELECT n_nationkey AS k, n_regionkey AS r, list_extract({list(FVC)}, CAST(n_regionkey AS INTEGER) + 1) AS source FROM nation) f WHERE source LIKE 'FVC%' AND k % 6 <> 0""")
def image_scan(spark, sf_dir):
    root = scratch(spark)
    for k, r in nations(spark, sf_dir):
        name = f"odd{k}.png" if k % 5 == 0 else f"{k}_{r + 1}.TIF"
        put(spark, f"{root}/{FVC[r]}/{name if k % 6 else f'{k}_{r}.txt'}", b"x")
    found = indexes.scan_images(spark, root, "FVC").withColumn("x", indexes.impression_name(F.col("path")))
    return found.select("source", "x.finger_id", "x.impression", indexes.resolution().alias("dpi"))


@query(f"""WITH f AS (SELECT n_nationkey AS k, t FROM nation, (SELECT unnest(['real', 'altered']) AS t) WHERE NOT (t = 'altered' AND n_nationkey % 4 = 0))
    SELECT t AS type, '' || k AS person, CASE WHEN k % 3 = 0 THEN 'F' ELSE 'M' END AS sex, {HAND.format('k')} AS hand, {FINGER.format('k')} AS finger, CASE WHEN t = 'altered' THEN 'CR' ELSE '' END AS altered,
    CAST(k % 2 AS INTEGER) AS hand_place, CAST(k % 5 AS INTEGER) AS finger_place FROM f""")
def subject_folders(spark, sf_dir):
    root = scratch(spark)
    for k, _ in nations(spark, sf_dir):
        name = f"{k}__{'M' if k % 3 else 'F'}_{indexes.HANDS[k % 2]}_{indexes.FINGERS[k % 5]}_finger"
        put(spark, f"{root}/real/{name}.BMP", b"x")
        put(spark, f"{root}/altered/{name}{'_CR' if k % 4 else '_other'}.BMP", b"x")
    found = indexes.scan_subjects(spark, {t: f"{root}/{t}" for t in ("real", "altered")})
    return found.select("type", "person", "sex", "hand", "finger", "altered", indexes.hand_order().alias("hand_place"), indexes.finger_order().alias("finger_place"))


#: Places of a nation's file among the capture folders, and two where captures are not looked for.
PLACES = [(letter, f"{top}/{letter}/{below}") for _, top, letters, below in indexes.CAPTURES for letter in letters] + [("N", "auxiliary/flat/N/500/plain/png"), ("U", "baseline/U/1000/roll/png")]
CAPTURE_SQL = f"""f AS (SELECT n_nationkey AS k, list_extract({[p for p, _ in PLACES]}, CAST(n_nationkey % {len(PLACES)} AS INTEGER) + 1) AS capture, n_nationkey % {len(PLACES)} < {len(PLACES) - 2} AS inside, n_nationkey % 12 AS frgp FROM nation),
    c AS (SELECT k, capture, CASE WHEN capture IN ('R', 'S') THEN 'slap' WHEN capture IN ('K', 'L', 'M', 'P') THEN 'plain' ELSE 'roll' END AS type, CAST(frgp AS INTEGER) AS frgp FROM f WHERE inside AND frgp BETWEEN 1 AND 10)"""


def _captures(spark, sf_dir):
    root = scratch(spark)
    for k, _ in nations(spark, sf_dir):
        letter, folder = PLACES[k % len(PLACES)]
        kind = folder.split("/")[-2]
        put(spark, f"{root}/{folder}/{10_000_000 + k}_{letter}_{'' if kind == 'roll' and letter < 'I' else '500_'}{kind}_{k % 12:02d}.png", b"x")
    found = indexes.scan_captures(spark, root).withColumn("x", indexes.capture_name(F.col("path"))).where("x is not null")
    return found.select("path", "capture", "type", indexes.capture_type().alias("known"), F.col("x.person").alias("person"), F.col("x.capture").alias("named"), F.col("x.frgp").alias("frgp"))


@query(f"""WITH {CAPTURE_SQL} SELECT '' || (10000000 + k) AS person, capture, type, frgp, CASE WHEN frgp <= 5 THEN 'Right' ELSE 'Left' END AS hand, {FINGER.format('(frgp - 1)')} AS finger,
    CAST(CASE WHEN frgp > 5 THEN frgp - 6 ELSE frgp + 4 END AS INTEGER) AS position FROM c""")
def capture_scan(spark, sf_dir):
    found = _captures(spark, sf_dir).where("capture = named AND type = known")
    return found.select("person", "capture", "type", "frgp", indexes.frgp_hand().alias("hand"), indexes.frgp_finger().alias("finger"), indexes.frgp_position().alias("position"))


@query(f"WITH {CAPTURE_SQL} SELECT type, capture, '' || (10000000 + k) AS person FROM c QUALIFY row_number() OVER (PARTITION BY type ORDER BY capture, k) <= 3")
def first_n_per_capture(spark, sf_dir):
    return indexes.first_per_capture(_captures(spark, sf_dir), 3, "type", ["capture", "person"]).select("type", "capture", "person")


MINUTIAE_SQL = """m AS (SELECT n_nationkey AS k, i, (k * 31 + i * 17) % 300 AS x, (k * 7 + i * 29) % 300 AS y, (k + i * 13) % 180 AS theta, (k * 5 + i * 11) % 60 AS q FROM nation, (SELECT unnest(range(12)) AS i)
    WHERE (k + i) % 6 <> 0)"""


def _minutiae(spark, sf_dir):
    root = scratch(spark)
    for k, _ in nations(spark, sf_dir):
        lines = [f"{(k * 31 + i * 17) % 300} {(k * 7 + i * 29) % 300} {(k + i * 13) % 180}" + ("" if (k + i) % 6 == 0 else f" {(k * 5 + i * 11) % 60 if (k + i) % 5 else 'x'}") for i in range(12)]
        put(spark, f"{root}/{k}.xyt", ("\n".join(lines) + "\n\n").encode())
    return files.read_minutiae(spark, root)


@query(f"WITH {MINUTIAE_SQL} SELECT '' || k AS image, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(theta AS INTEGER) AS theta, CAST(CASE WHEN (k + i) % 5 = 0 THEN NULL ELSE q END AS INTEGER) AS quality FROM m")
def minutiae_scan(spark, sf_dir):
    return _minutiae(spark, sf_dir)


@query(f"WITH {MINUTIAE_SQL}, c AS (SELECT k % 3 AS g, k, CAST(count_if(q >= 20 AND (k + i) % 5 <> 0) AS BIGINT) AS c FROM m GROUP BY 1, 2) SELECT CAST(g AS INTEGER) AS g, count(*) AS n, round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.95), 6) AS p95, CAST(count_if(c < 5) AS BIGINT) AS n_below_5 FROM c GROUP BY 1")
def minutiae_summary(spark, sf_dir):
    counts = _minutiae(spark, sf_dir).groupBy("image").agg(F.count_if(F.col("quality") >= 20).alias("c")).withColumn("g", (F.col("image").cast("int") % 3).cast("int"))
    return cleaning.few_summary(counts, ["g"], "c", 5).select("g", "n", *(F.round(c, 6).alias(c) for c in ("p5", "median", "p95")), "n_below_5")


MAP_SQL = """cells AS (SELECT n_nationkey AS k, r, c, (k * 7 + r * 3 + c * 5) % 18 - 1 AS dir, (k + r + c) % 5 AS quality, (k * r + c) % 2 AS curved FROM nation, (SELECT unnest(range(6)) AS r), (SELECT unnest(range(4)) AS c))"""


def _maps(spark, sf_dir):
    root = scratch(spark)
    for k, _ in nations(spark, sf_dir):
        grids = {"dm": lambda r, c: (k * 7 + r * 3 + c * 5) % 18 - 1, "qm": lambda r, c: (k + r + c) % 5, "hcm": lambda r, c: (k * r + c) % 2}
        for ending, f in grids.items():
            put(spark, f"{root}/{k}.{ending}", "".join(" ".join(f"{f(r, c):2d}" for c in range(4)) + "\n" for r in range(6)).encode())
    return files.read_blocks(spark, root)


@query(f"WITH {MAP_SQL} SELECT '' || k AS image, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(dir AS INTEGER) AS dir, CAST(quality AS INTEGER) AS quality, CAST(curved AS INTEGER) AS curved FROM cells")
def block_map_scan(spark, sf_dir):
    return _maps(spark, sf_dir)


@query(f"""WITH {MAP_SQL}, g AS (SELECT n_nationkey AS k, y, x, (k * 31 + x * 7 + y * 13) % 256 AS grey FROM nation, (SELECT unnest(range(45)) AS y), (SELECT unnest(range(30)) AS x))
    SELECT '' || g.k AS image, count(*) AS pixels, round(avg(grey), 6) AS mean, round(stddev_pop(grey), 6) AS contrast FROM g JOIN cells ON cells.k = g.k AND r = y // 8 AND c = x // 8 WHERE dir >= 0 AND quality > 0 GROUP BY 1""")
def grey_contrast(spark, sf_dir):
    """Bitmaps of 45 x 30 pixels; their grey levels inside the valid blocks of their maps, blocks cut at the edge."""
    root = scratch(spark)
    for k, _ in nations(spark, sf_dir):
        y, x = np.mgrid[0:45, 0:30]
        put(spark, f"{root}/x/{k}.bmp", images.to_bitmap(((k * 31 + x * 7 + y * 13) % 256).astype(np.uint8)))
    valid = _maps(spark, sf_dir).where(fields.valid()).groupBy("image").agg(F.collect_list(F.struct("r", "c")).alias("cells"))
    found = indexes.scan_images(spark, root).select(indexes.stem(F.col("path")).alias("image"), "bytes").join(valid, "image")

    def measure(batches):
        for pdf in batches:
            rows = []
            for image, content, cells in zip(pdf["image"], pdf["bytes"], pdf["cells"]):
                grey, mask = images.grey_image(content), np.zeros((6, 4), bool)
                for cell in cells:
                    mask[cell["r"], cell["c"]] = True
                inside = grey[images.pixels_of_blocks(mask, grey.shape)].astype(float)
                rows.append((image, len(inside), inside.mean() if len(inside) else 0.0, inside.std() if len(inside) else 0.0))
            yield pd.DataFrame(rows, columns=["image", "pixels", "mean", "contrast"])

    out = found.mapInPandas(measure, "image string, pixels long, mean double, contrast double")
    return out.select("image", "pixels", F.round("mean", 6).alias("mean"), F.round("contrast", 6).alias("contrast"))


def _kernel_sql(name: str, size: int, to: int, reach: int) -> str:
    """A table name (o, p, w): how much old pixel p counts in new pixel o."""
    wide = max(size / to, 1.0)
    d = f"abs((p + 0.5 - (o + 0.5) * {size / to}) / {wide})"
    cubic = f"CASE WHEN {d} < 1 THEN (1.5 * {d} - 2.5) * {d} * {d} + 1 WHEN {d} < 2 THEN ((-0.5 * {d} + 2.5) * {d} - 4) * {d} + 2 ELSE 0 END"
    sinc = lambda x: f"CASE WHEN {x} = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END"
    shape = cubic if reach == 2 else f"CASE WHEN {d} < 3 THEN ({sinc(d)}) * ({sinc(f'({d} / 3)')}) ELSE 0 END"
    return f"{name} AS MATERIALIZED (SELECT o, p, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, p, CAST({shape} AS DOUBLE) AS w FROM (SELECT unnest(range({to})) AS o), (SELECT unnest(range({size})) AS p)))"


def _resized_sql(kernel: str, to: int) -> str:
    return f"""SELECT image, '{kernel}' AS kernel, CAST(sum(grey) AS BIGINT) AS total, md5(string_agg(CAST(grey AS VARCHAR), ',' ORDER BY y, x)) AS digest FROM
        (SELECT image, v.o AS y, h.o AS x, CAST(least(255, greatest(0, floor(round(sum(v.w * h.w * grey), 6) + 0.5))) AS INTEGER) AS grey FROM g JOIN {kernel} v ON v.p = g.at // 8 JOIN {kernel} h ON h.p = g.at % 8 GROUP BY 1, 2, 3) GROUP BY 1"""


#: Kernel, side of the new image, and how far the kernel reaches.
SIZES = {"bicubic": (16, 2), "lanczos": (5, 3)}


@query(f"""WITH g AS MATERIALIZED (SELECT vec_id AS image, unnest(range(64)) AS at, unnest(list_transform(embedding, lambda x: abs(CAST(floor(CAST(x AS DOUBLE) * 1000 + 0.5) AS BIGINT)) % 256)) AS grey FROM embeddings),
    {', '.join(_kernel_sql(k, 8, to, reach) for k, (to, reach) in SIZES.items())} {' UNION ALL '.join(_resized_sql(k, to) for k, (to, _) in SIZES.items())}""")
def resized_images(spark, sf_dir):
    """Bitmaps of 8 x 8 pixels, twice as large by the bicubic kernel and smaller by Lanczos's."""
    grey = F.transform("q", lambda x: F.abs(x) % 256)
    bitmaps, out = images.as_bitmaps(impressions(spark, sf_dir).select(F.col("idx").alias("image"), grey.alias("pixels")), 8), None
    for kernel, (to, _) in SIZES.items():
        rows = images.resized(bitmaps, to, to, kernel).withColumn("kernel", F.lit(kernel))
        out = rows if out is None else out.unionByName(rows)
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("image", "kernel", total.alias("total"), F.md5(F.array_join(F.col("pixels").cast("array<string>"), ",")).alias("digest"))


# Documents, logs and lists

@query("WITH g AS (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation) SELECT '' || n_nationkey AS tag, n_name AS name FROM nation JOIN g USING (n_nationkey) WHERE place = 1")
def group_file(spark, sf_dir):
    path, groups = f"{scratch(spark)}/groups.json", {}
    for k, r in sorted(nations(spark, sf_dir)):
        groups.setdefault(r, []).append(str(k))
    put(spark, path, json.dumps(list(groups.values())).encode())
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("tag"), F.col("n_name").alias("name"))
    return files.without_later_copies(rows, files.read_groups(spark, path), ["tag"])


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep, count(*) OVER (PARTITION BY text) AS n FROM documents QUALIFY n > 1")
def exact_duplicates(spark, sf_dir):
    return cleaning.copies(read(spark, sf_dir, "documents"), "text", "doc_id")


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents)
    SELECT source, count(*) AS n FROM d WHERE place = 1 GROUP BY 1""")
def anti_duplicates(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    later = cleaning.copies(docs, "text", "doc_id").select((F.col("doc_id") != F.col("keep")).cast("int").alias("place"), F.col("doc_id").alias("tag"))
    kept = files.without_later_copies(docs.withColumn("tag", F.col("doc_id")), later, ["tag"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _log(spark, sf_dir, verdict, path: str | None = None, part: str = "true") -> str:
    """A log of the turns of conversations, or more lines of one that is there."""
    turns = read(spark, sf_dir, "conversations").where(part)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    path = path or scratch(spark)
    rows = turns.select(F.concat(F.lit("img/"), "conv_id", F.lit("__M_x")).alias("na"), F.concat(F.lit("img/"), F.col("conv_id") + 1, F.lit("__F_"), "role").alias("nb"), F.lit("").alias("rot"), verdict.alias("veredito"), stamp.alias("gravado_em"))
    rows.write.mode("append").json(path)
    return path


@query("SELECT 'img/' || conv_id || '__M_x' AS a, 'img/' || (conv_id + 1) || '__F_' || role AS b, 'v' || turn % 3 AS verdict FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def streamed_verdicts(spark, sf_dir):
    """The log grows between two runs of the stream; the last verdicts are those of all lines."""
    verdict, out, marks = F.concat(F.lit("v"), F.col("turn") % 3), scratch(spark), scratch(spark)
    log = _log(spark, sf_dir, verdict, part="turn % 2 = 0")
    stream.keep_last(stream.verdict_stream(spark, log), out, marks)
    _log(spark, sf_dir, verdict, log, "turn % 2 = 1")
    return stream.keep_last(stream.verdict_stream(spark, log), out, marks).select("a", "b", "verdict")


@query("SELECT 'img/' || conv_id || '__M_x' AS a, 'img/' || (conv_id + 1) || '__F_' || role AS b, 'v' || turn % 3 AS verdict FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def latest_verdict(spark, sf_dir):
    log = files.read_verdicts(spark, _log(spark, sf_dir, F.concat(F.lit("v"), F.col("turn") % 3)))
    return files.latest(log).select("a", "b", "verdict")


@query("SELECT DISTINCT person FROM (SELECT conv_id AS person FROM conversations UNION ALL SELECT conv_id + 1 FROM conversations)")
def persons_of_verdicts(spark, sf_dir):
    """Every pair has to be there and have the same verdict; then the persons of all pairs."""
    log = files.read_verdicts(spark, _log(spark, sf_dir, F.lit("same")))
    pairs_ = read(spark, sf_dir, "conversations").select("conv_id", "role").distinct().count()
    return files.persons_in(files.checked(log, pairs_, "same"))


@query("SELECT n_nationkey AS k, n_regionkey % 2 = 0 AS same FROM nation")
def appended_verdicts(spark, sf_dir):
    """Verdicts appended line by line, as a review adds them."""
    path = f"{scratch(spark)}/log.jsonl"
    for k, r in nations(spark, sf_dir):
        files.append_line(spark, path, {"na": f"img/{k}__M", "nb": "b", "rot": "", "veredito": "same" if r % 2 == 0 else "other"})
    log = files.read_verdicts(spark, path).where("at is not null")
    return log.select(F.regexp_extract("a", r"/(\d+)__", 1).cast("int").alias("k"), (F.col("verdict") == "same").alias("same"))


@query("SELECT e.user_id AS person, coalesce(s.s_name, '') AS name, count(*) AS n FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id GROUP BY 1, 2")
def left_join_metadata(spark, sf_dir):
    path = one_csv(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name")), scratch(spark))
    seen = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("person")).agg(F.count(F.lit(1)).alias("n"))
    return files.with_metadata(seen, indexes.read_csv(spark, path, "person long, name string"), "person", ["name"]).select("person", "name", "n")


ERRATA_SQL = """e AS (SELECT page_id, lpad('' || page_id, 8, '0') AS person, CASE page_id % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'V' WHEN 2 THEN '6E' ELSE '' END AS capture FROM pages)"""


def _errata(spark, sf_dir):
    person = F.lpad(F.col("page_id").cast("string"), 8, "0")
    k = F.col("page_id") % 4
    line = F.when(k == 0, F.concat(F.lit("thumbs of "), person, F.lit(", device r were swapped"))).when(k == 1, F.concat(person, F.lit(", Device V, see notes")))
    line = line.when(k == 2, F.concat(F.lit("wrong: "), person, F.lit("_6e_500_roll_02.png."))).otherwise(F.concat(person, F.lit(" is named without any device, or devices R")))
    path = scratch(spark)
    read(spark, sf_dir, "pages").select(line.alias("value")).write.text(path)
    return files.read_errata(spark, path)


@query(f"WITH {ERRATA_SQL} SELECT person, capture FROM e WHERE capture <> ''")
def errata_regex(spark, sf_dir):
    return _errata(spark, sf_dir)


@query(f"WITH {ERRATA_SQL}, rows_ AS (SELECT page_id, person, c FROM e, (SELECT unnest(['r', 'V']) AS c)) SELECT page_id, c AS capture FROM rows_ r WHERE page_id % 10 <> 9 AND NOT EXISTS (SELECT 1 FROM e WHERE e.person = r.person AND e.capture = upper(r.c))")
def errata_exclusion(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.lpad(F.col("page_id").cast("string"), 8, "0").alias("person"), F.explode(F.array(F.lit("r"), F.lit("V"))).alias("capture"), F.when(F.col("page_id") % 10 == 9, "1").alias("flag"))
    return files.without_errata(rows, _errata(spark, sf_dir), "flag").select("page_id", "capture")


BODIES_KEPT = f"""WITH {BOTH}, bc AS (SELECT similarity, closeness, person_i = person_j AS same, person_i IN (3, 7) OR person_j IN (3, 7) AS out_ FROM e)"""


@query(f"""{BODIES_KEPT}
    SELECT state, scorer, count(*) AS n, CAST(count_if(same) AS BIGINT) AS same_body, CAST(count_if(score >= 35) AS BIGINT) AS n_ge_35 FROM (
        SELECT s.state, t.scorer, same, CASE WHEN t.scorer = 'similarity' THEN similarity ELSE closeness END AS score FROM bc, (SELECT unnest(['all', 'kept']) AS state) s, (SELECT unnest(['similarity', 'closeness']) AS scorer) t
        WHERE s.state = 'all' OR NOT out_) GROUP BY 1, 2""")
def before_after_exclusion(spark, sf_dir):
    """The excluded persons' list is missing, so the one in the program counts."""
    excluded = files.read_excluded(spark, f"{scratch(spark)}/none.json", [3, 7])
    index = impressions(spark, sf_dir)
    gone = excluded.select(F.col(excluded.columns[0]).cast("long").alias("person")).distinct().withColumn("gone", F.lit(True))
    index = index.join(gone, "person", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    # Pairs of excluded people are a class of the one pass; what is kept is the rest.
    classes = pairs.apart(pairs.SAME_PERSON, "gone")
    hist = pairs.class_histogram(index, [similarity, closeness], classes)
    states = F.when(F.col("pair_class").startswith("excluded"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("kept")))
    long = hist.withColumn("state", F.explode(states)).unpivot(["state", "pair_class", "n"], ["similarity", "closeness"], "scorer", "score")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return long.groupBy("state", "scorer").agg(F.sum("n").alias("n"), some(F.col("pair_class").endswith("same")).alias("same_body"), some(F.col("score") >= 35).alias("n_ge_35"))


@query("SELECT n_nationkey AS k, CAST(i + 1 AS INTEGER) AS n, round(n_nationkey + i / 2.0, 6) AS ax, round(i * 3.5, 6) AS ay, CAST(i AS DOUBLE) AS bx, round(n_nationkey / 4.0, 6) AS b_y FROM nation, (SELECT unnest(range(3)) AS i)")
def marked_points(spark, sf_dir):
    root = scratch(spark)
    for k, _ in nations(spark, sf_dir):
        put(spark, f"{root}/{k}.json", json.dumps({"a": [[k + i / 2, i * 3.5] for i in range(3)], "b": [[i, k / 4] for i in range(3)]}).encode())
    points = files.read_points(spark, root)
    return points.select(F.col("name").cast("int").alias("k"), "n", F.round("ax", 6).alias("ax"), F.round("ay", 6).alias("ay"), "bx", F.round("by", 6).alias("b_y"))


@query("SELECT c_name AS a, 'n' || c_nationkey AS b, CASE WHEN f = 1 AND c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS label, CAST(f AS INTEGER) AS file FROM customer, (SELECT unnest([1, 2]) AS f)")
def pair_lists(spark, sf_dir):
    """Two lists of pairs, with labels and without that column."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_name").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("rotulo"))
    lists = [files.read_pairs(spark, one_csv(df, scratch(spark))) for df in (rows, rows.drop("rotulo"))]
    return lists[0].withColumn("file", F.lit(1)).unionByName(lists[1].withColumn("file", F.lit(2)))


# Matrices

@query(f"WITH {ONE}, s AS (SELECT i, j, similarity FROM e UNION ALL SELECT j, i, similarity FROM e) SELECT i, count(*) AS n, CAST(sum(similarity * (j % 97 + 1)) AS BIGINT) AS total, max(similarity) AS top FROM s GROUP BY 1")
def matrix_file(spark, sf_dir):
    index = impressions(spark, sf_dir)
    path, n = f"{scratch(spark)}/m.i32", index.count()
    files.write_matrix(pairs.all_pairs(index, [similarity]).withColumnRenamed("similarity", "score"), path, n, symmetric=True, missing=-10_000)
    m = files.read_matrix(spark, path, n, missing=-10_000)
    return m.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("score") * (F.col("j") % 97 + 1)).alias("total"), F.max("score").alias("top"))


@query(f"""WITH {IDX}, d AS (SELECT a.idx AS i, b.idx AS j, floor(list_dot_product(a.q[1:32], b.q[33:64]) / 10000.0) / 8 AS score FROM idx a, idx b)
    SELECT i, count(*) AS n, round(sum(score), 6) AS total, round(max(score), 6) AS top FROM d GROUP BY 1""")
def float_matrix_file(spark, sf_dir):
    index = impressions(spark, sf_dir)
    path, n = f"{scratch(spark)}/m.f32", index.count()
    directed = pairs.rectangle(index, index, [one_sided]).select("i", "j", (F.col("one_sided") / 8).alias("score"))
    files.write_matrix(directed, path, n, kind="<f4", missing=float("nan"))
    m = files.read_matrix(spark, path, n, kind="<f4", missing=None)
    return m.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"), F.round(F.max("score"), 6).alias("top"))


# Sinks

@query(f"WITH {CLASSED}, t AS (SELECT i, j, similarity AS score FROM p WHERE pair_class = 'impostor' ORDER BY score DESC, i, j LIMIT 100) SELECT i, j, score, row_number() OVER (ORDER BY score DESC, i, j) AS place FROM t")
def top_impostor_file(spark, sf_dir):
    """The best impostors as a sorted file; place is a row's line in it."""
    path = scratch(spark)
    e = pairs.best_pairs_pruned(impressions(spark, sf_dir), [similarity], 100, pairs.THREE_WAY, "impostor").withColumnRenamed("similarity", "score")
    write_sorted(tails.top(e, 100), path, [F.col("score").desc(), "i", "j"])
    lines = read_lines(spark, path, "i,j,score", first=1)
    part = F.split("line", ",")
    return lines.select(*(part[k].cast("long").alias(c) for k, c in enumerate(("i", "j", "score"))), "place")


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, (SELECT count(*) FROM documents) AS everything FROM documents GROUP BY 1")
def summary_document(spark, sf_dir):
    docs, path = read(spark, sf_dir, "documents"), scratch(spark)
    files.write_document(path, langs=docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")), whole=docs.agg(F.count(F.lit(1)).alias("n")))
    doc = spark.read.text(path).select(F.from_json("value", "langs array<struct<lang:string,n:long,chars:long>>, whole array<struct<n:long>>").alias("d"))
    return doc.select(F.explode("d.langs").alias("x"), F.col("d.whole")[0]["n"].alias("everything")).select("x.*", "everything")


@query("SELECT s_suppkey || ',' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE printf('%.6f', s_acctbal / 7) END || ',' || s_nationkey AS line, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS place FROM supplier")
def feature_file(spark, sf_dir):
    """Sorted features with six places, missing ones empty, a column put in at its place."""
    df = read(spark, sf_dir, "supplier").withColumn("x", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") / 7))
    path = scratch(spark)
    files.write_features(df, path, ["s_nationkey", "s_suppkey"], ["s_suppkey", "x", "s_nationkey"])
    return read_lines(spark, path, "s_suppkey,x,s_nationkey", first=1)


@query(f"WITH {ONE}, b AS (SELECT {TWO_WAY} AS pair_class, similarity FROM e) SELECT pair_class, CAST(least(greatest(floor((similarity - 20) / 10.0), 0), 7) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1, 2")
def binned_scores(spark, sf_dir):
    return tails.binned(counted(spark, sf_dir, classes=pairs.TWO_WAY), ["pair_class"], "similarity", 20, 100, 8)


# Work that is resumed, kept, or done by other programs

@query("SELECT c_custkey, length(c_name) AS size FROM customer")
def resumed_work(spark, sf_dir):
    """Two of four files are done and the third is broken off; going on makes the whole."""
    from pairloom.sources.scratch import remove

    tasks, out, marks = (f"{scratch(spark)}/{name}" for name in ("tasks", "out", "marks"))
    read(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(4).write.parquet(tasks)
    sizes, seen = lambda rows: rows.select("c_custkey", F.length("c_name").alias("size")), []

    def breaks_off(rows):
        seen.append(rows)
        if len(seen) == 3:
            raise RuntimeError("broken off")
        return sizes(rows)

    try:
        files.resumed(spark, tasks, out, marks, breaks_off)
    except StreamingQueryException:
        pass
    return files.resumed(spark, tasks, out, marks, sizes).select("c_custkey", "size")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def tasks_not_done(spark, sf_dir):
    done = one_csv(read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey"), scratch(spark))
    return indexes.not_done(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), indexes.read_csv(spark, done, "n_nationkey int"), ["n_nationkey"])


@query("SELECT vec_id AS idx, CAST(floor(embedding[1] * 1000 + 0.5) AS BIGINT) AS first FROM embeddings")
def template_cache(spark, sf_dir):
    """Templates are made once; the second time nothing is built."""
    path, built = scratch(spark), []

    def build():
        built.append(1)
        return impressions(spark, sf_dir).select("idx", F.col("q")[0].alias("first"))

    files.cached(spark, path, build)
    out = files.cached(spark, path, build)
    if len(built) != 1:
        raise RuntimeError("the cache was not used")
    return out


#: A program that scores pairs of paths by how much their lengths differ.
LENGTHS = "import sys\nfor line in sys.stdin:\n    a, b = line.rstrip('\\n').split('\\t')\n    print(abs(len(a) - len(b)))"


@query("SELECT a.s_name AS path_a, b.p_name AS path_b, CAST(abs(length(a.s_name) - length(b.p_name)) AS BIGINT) AS score FROM supplier a JOIN part b ON b.p_partkey = a.s_suppkey")
def external_scores(spark, sf_dir):
    """Pairs scored by a program of its own that runs where a batch of them is."""
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("path_a"))
    b = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("path_b"))
    return external(a.join(b, "k").select("path_a", "path_b"), program([sys.executable, "-c", LENGTHS]))


# Cleaning, subsets and tallies

@query(f"""WITH {OBS} SELECT person, capture, position, coalesce(CASE WHEN area % 3 <> 0 THEN area * 1.0 END, CASE WHEN area % 2 = 0 THEN quality END, 1.0) AS area, coalesce(CASE WHEN position <> 4 THEN contrast END, 0.0) AS contrast, CASE WHEN person % 2 = 0 THEN 1.0 ELSE 0.0 END AS sex
    FROM whole WHERE position <> 7 AND capture NOT IN ('AF', 'RF')""")
def cleaned_observations(spark, sf_dir):
    df = whole(spark, sf_dir).select("person", "capture", "position", F.when(F.col("area") % 3 != 0, F.col("area").cast("double")).alias("area"), F.when(F.col("area") % 2 == 0, F.col("quality")).alias("usable"), F.when(F.col("position") != 4, F.col("contrast")).alias("contrast"), F.when(F.col("position") != 7, F.col("value")).alias("value"), F.when(F.col("person") % 2 == 0, "M").alias("sex"))
    df = cleaning.without_captures(cleaning.measured(df, "value"), ["AF", "RF"])
    df = cleaning.with_defaults(df, {"area": ("usable", 1.0), "contrast": (0.0,)})
    return df.select("person", "capture", "position", "area", "contrast", cleaning.indicator("sex", "M").alias("sex"))


@query(f"WITH {ONE} SELECT count(*) AS n, CAST(sum(similarity) AS BIGINT) AS total FROM e WHERE source_i <> 3 AND source_j <> 3 AND finger_id_i <> finger_id_j")
def natural_impostors(spark, sf_dir):
    named = impressions(spark, sf_dir).withColumn("source", F.concat(F.lit("FVC_DB"), F.col("source") + 1))
    hist = pairs.class_histogram(cleaning.natural_items(named), [similarity], pairs.THREE_WAY).where("pair_class = 'impostor'")
    return hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("similarity") * F.col("n")).alias("total"))


@query("SELECT event_type AS status, count(*) AS n, CAST(count_if(value < 5) AS BIGINT) AS few, CAST(count_if(user_id % 2 = 0) AS BIGINT) AS even FROM events GROUP BY 1")
def status_tally(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("status"), (F.col("value") < 5).alias("few"), (F.col("user_id") % 2 == 0).alias("even"))
    return cleaning.status_tally(rows, "status", ("few", "even"))


@query("SELECT lang, count(*) AS runs, round(avg(doc_id % 50 + 1.0), 6) AS mean_seconds, round(sum(n_chars) / sum(doc_id % 50 + 1.0), 6) AS per_second FROM documents GROUP BY 1")
def throughput_by_lang(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").withColumn("seconds", F.col("doc_id") % 50 + F.lit(1.0))
    t = cleaning.throughput(rows, ["lang"], "seconds", F.col("n_chars"))
    return t.select("lang", "runs", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("per_second", 6).alias("per_second"))


@query("SELECT doc_id, printf('%dh%02dm%02ds', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS took, round_even(n_chars / 2, 0) AS half, coalesce(TRY_CAST(substring(source, 1, 1) AS INTEGER), 0) AS number FROM documents")
def formats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("first", F.substring("source", 1, 1))
    return docs.select("doc_id", cleaning.clock(F.col("n_chars")).alias("took"), cleaning.half_even(F.col("n_chars") / 2).alias("half"), cleaning.whole_number("first").alias("number"))


@query("""WITH b AS (SELECT s_suppkey AS k, (s_suppkey * 7 % 33 - 16) * pi() / 16 AS d, s_suppkey % 11 * 1.0 AS x, s_nationkey * 1.0 AS y FROM supplier)
    SELECT k, round(d + pi() / 2 - pi() * floor((d + pi() / 2) / pi() + 1e-12) - pi() / 2, 6) AS wrapped, round(sqrt(x * x + y * y), 6) AS far FROM b""")
def axial_differences(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    d = (F.col("s_suppkey") * 7 % 33 - 16) * F.pi() / 16
    return s.select(F.col("s_suppkey").alias("k"), F.round(axial_wrap(d + 1e-12), 6).alias("wrapped"), F.round(F.hypot(F.col("s_suppkey") % 11, "s_nationkey"), 6).alias("far"))


@query("SELECT lang, source, count(DISTINCT n_chars) AS sizes, row_number() OVER (ORDER BY lang, source) AS place FROM documents GROUP BY 1, 2")
def sorted_keys(spark, sf_dir):
    from pyspark.sql import Window

    keys = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.countDistinct("n_chars").alias("sizes"))
    return keys.withColumn("place", F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_last(), F.col("source").asc_nulls_last())).cast("long"))


# Tails and tests

@query(f"""WITH {CLASSED}, r AS (SELECT i, j, row_number() OVER (ORDER BY similarity DESC, i, j) - 1 AS ra, row_number() OVER (ORDER BY closeness DESC, i, j) - 1 AS rb FROM p WHERE pair_class = 'impostor')
    SELECT i, j, CASE WHEN ra < 50 THEN ra END AS ra, CASE WHEN rb < 50 THEN rb END AS rb, least(ra, rb) AS best FROM r WHERE ra < 50 OR rb < 50""")
def either_extreme(spark, sf_dir):
    e = files.cached(spark, scratch(spark), lambda: best(spark, sf_dir, 50))
    return tails.either(tails.ranked(e, "similarity", "ra", 50), tails.ranked(e, "closeness", "rb", 50), "ra", "rb")


@query(f"WITH {ONE} SELECT i, j, similarity AS score, row_number() OVER (ORDER BY similarity DESC, i, j) AS place FROM e WHERE similarity >= 75")
def above_threshold(spark, sf_dir):
    path = scratch(spark)
    found = pairs.all_pairs(impressions(spark, sf_dir), [similarity], least={"similarity": 75})
    write_sorted(found.select("i", "j", F.col("similarity").alias("score")), path, [F.col("score").desc(), "i", "j"], compression="gzip")
    part = F.split("line", ",")
    return read_lines(spark, path, "i,j,score", first=1).select(*(part[k].cast("long").alias(c) for k, c in enumerate(("i", "j", "score"))), "place")


@query(f"WITH {ONE}, h AS (SELECT similarity AS score, count(*) AS n FROM e WHERE {TWO_WAY} = 'impostor' GROUP BY 1) SELECT s.score, coalesce(n, 0) AS count, s.score AS place FROM (SELECT unnest(range(0, (SELECT max(score) + 1 FROM h))) AS score) s LEFT JOIN h ON h.score = s.score")
def histogram_file(spark, sf_dir):
    """The histogram of impostors as files in order, read back with each line's place."""
    path = scratch(spark)
    hist = counted(spark, sf_dir, classes=pairs.TWO_WAY).where("pair_class = 'impostor'")
    files.write_histogram(hist.select(F.col("similarity").alias("score"), "n"), path)
    part = F.split("line", ",")
    return read_lines(spark, path, "score,count").select(part[0].cast("long").alias("score"), part[1].cast("long").alias("count"), "place")


@query(f"""WITH {ONE}, c AS (SELECT DISTINCT person FROM idx WHERE person % 3 <> 0) SELECT count(*) AS n, CAST(sum(similarity) AS BIGINT) AS total FROM e
    WHERE person_i IN (SELECT person FROM c) AND person_j IN (SELECT person FROM c)""")
def pairs_within(spark, sf_dir):
    people = impressions(spark, sf_dir).where("person % 3 <> 0").select("person")
    # Who is not among the people makes no pairs.
    index = impressions(spark, sf_dir).join(people.distinct(), "person", "left_semi")
    return pairs.class_histogram(index, [similarity], pairs.EVERY).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("similarity") * F.col("n")).alias("total"))


RANK_SUM = f"""{ONE}, s AS (SELECT similarity, person_i = person_j AS same FROM e), h AS (SELECT similarity, count(*) AS n, count_if(same) AS n1 FROM s GROUP BY 1),
    r AS (SELECT *, sum(n) OVER (ORDER BY similarity) - (n - 1) / 2 AS r FROM h), t AS (SELECT sum(n1) AS n1, sum(n) - sum(n1) AS n2, sum(n1 * r) AS r1, sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM r),
    u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM t),
    z AS (SELECT u, (u - n1 * n2 / 2 - 0.5) / sd AS z_greater, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z_two FROM u)"""
#: The upper normal tail by Simpson's rule.
TAIL = "(0.5 - list_sum(list_transform(range(2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power({0} * k / 2000, 2) / 2))) * {0} / 6000 / sqrt(2 * pi()))"


@query(f"WITH {RANK_SUM} SELECT round(u, 3) AS u, round(z_greater, 6) AS z_greater, round(z_two, 6) AS z_two FROM z")
def mann_whitney_test(spark, sf_dir):
    hist = counted(spark, sf_dir, classes=pairs.SAME_PERSON).withColumnRenamed("similarity", "score")
    t = tails.mann_whitney_z(hist, F.col("pair_class") == "same")
    return t.select(F.round("u", 3).alias("u"), F.round("z_greater", 6).alias("z_greater"), F.round("z_two", 6).alias("z_two"))


@query(f"WITH {RANK_SUM} SELECT round(u, 3) AS u, round({TAIL.format('z_greater')}, 6) AS p_greater, round(least(1, 2 * {TAIL.format('z_two')}), 6) AS p_two FROM z")
def mann_whitney_p_value(spark, sf_dir):
    hist = counted(spark, sf_dir, classes=pairs.SAME_PERSON).withColumnRenamed("similarity", "score")
    p = tails.mann_whitney_p(hist, F.col("pair_class") == "same")
    return p.select(F.round("u", 3).alias("u"), F.round("p_greater", 6).alias("p_greater"), F.round("p_two", 6).alias("p_two"))


@query(f"""WITH {OBS}, z AS {z_sql('whole', 'capture, position')}, o AS (SELECT capture, homologous - cross_ AS s FROM {means_sql('z', ['capture'])}),
    n AS (SELECT capture, homologous - cross_ AS s FROM {null_sql('z', ['capture'], ITER, 'null')}),
    p AS (SELECT capture, (count_if(n.s >= o.s) + 1) / (count(*) + 1) AS p FROM o JOIN n USING (capture) GROUP BY 1)
    SELECT capture, round(p, 9) AS p, p < 0.01 AS at_one_percent, p < 0.05 / (SELECT count(*) FROM p) AS of_all FROM p""")
def bonferroni_flags(spark, sf_dir):
    from pairloom.operators import dependence

    df = whole(spark, sf_dir)
    p = resample.empirical_p(resample.permutation_null(df, ITER, by=("capture",)), dependence.s_statistic(df, ["capture"]), ["capture"], "s")
    return resample.bonferroni(p).select("capture", F.round("p", 9).alias("p"), "at_one_percent", "of_all")


FIVE = " UNION ALL ".join(
    f"SELECT capture, iter, 'information_{w}' AS test, greatest(0, -0.5 * ld) AS x FROM det_{n} UNION ALL SELECT capture, iter, 'difference_{w}', homologous - others FROM {means_sql(f'both{n}', ['capture', 'iter'])}" for n, w in ((1, "first"), (2, "second"))
)


@query(f"""WITH {TWO_VARIABLES}, t AS MATERIALIZED ({FIVE} UNION ALL SELECT capture, iter, 'agreement', rho FROM agreement), o AS (SELECT * FROM t WHERE iter < 0),
    p AS (SELECT capture, test, o.x AS observed, count(*) AS n, (count_if(t.x >= o.x) + 1) / (count(*) + 1) AS p FROM t JOIN o USING (capture, test) WHERE t.iter >= 0 GROUP BY 1, 2, 3)
    SELECT capture, test, round(observed, 9) AS observed, n, round(p, 9) AS p, p < 0.01 AS at_one_percent, p < 0.05 / 5 AS of_all FROM p""")
def five_tests(spark, sf_dir):
    """p of the information and the class difference of two variables and of their pointwise agreement, by capture, with flags."""
    p = resample.five_tests(whole(spark, sf_dir), "value", "quality", ITER, by=("capture",))
    return resample.bonferroni(p, 5).select("capture", "test", F.round("observed", 9).alias("observed"), "n", F.round("p", 9).alias("p"), "at_one_percent", "of_all")


MASS = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({0}) + (n - i) * ln(1 - {0}))"


def _bisected(name: str, above: str) -> str:
    """A recursive table: the share at which a binomial tail is 0.025; above: whether the middle lies below it."""
    middle = "((low + high) / 2)"
    return f"""{name} AS (SELECT quality, k, n, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0 AS step FROM c
        UNION ALL SELECT quality, k, n, CASE WHEN {above.format(middle)} THEN {middle} ELSE low END, CASE WHEN {above.format(middle)} THEN high ELSE {middle} END, step + 1 FROM {name} WHERE step < 45)"""


def _tail_sum(first: str, last: str) -> str:
    return f"list_sum(list_transform(range({first}, {last}), lambda i: {MASS}))"


@query(f"""WITH RECURSIVE c AS (SELECT quality, CAST(count_if(toxic = 1) AS BIGINT) AS k, count(toxic) AS n FROM labels GROUP BY 1),
    {_bisected('a', f"coalesce({_tail_sum('k', 'n + 1')}, 0) < 0.025")}, {_bisected('b', f"coalesce({_tail_sum('0::BIGINT', 'k + 1')}, 0) > 0.025")}
    SELECT a.quality, a.k, a.n, round(CASE WHEN a.k = 0 THEN 0 ELSE (a.low + a.high) / 2 END, 6) AS low, round(CASE WHEN a.k = a.n THEN 1 ELSE (b.low + b.high) / 2 END, 6) AS high FROM a JOIN b ON a.quality IS NOT DISTINCT FROM b.quality AND a.step = 45 AND b.step = 45""")
def exact_share_interval(spark, sf_dir):
    """The share of toxic labels by quality with its exact interval; the bounds come from the driver, one group at a time."""
    counts = read(spark, sf_dir, "labels").groupBy("quality").agg(F.sum("toxic").alias("k"), F.count("toxic").alias("n"))
    rows = [(r.quality, r.k or 0, r.n, *(round(x, 6) for x in clopper_pearson(r.k or 0, r.n))) for r in counts.collect()]
    return spark.createDataFrame(rows, "quality int, k long, n long, low double, high double")
