"""Files in, files out."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.plans import catalog
from pairloom.sources import files, images, indexes, ordered
from pairloom.streaming import verdicts as stream


def test_index_order_and_names(spark, tmp_path):
    (tmp_path / "i.csv").write_text("path,source,finger_id,impression\nb,DB1,10,1\na,DB1,2,2\nc,DB1,2,1\nd,DB1,x,0\n")
    got = indexes.read_index(spark, str(tmp_path / "i.csv")).orderBy("idx").collect()
    assert [(r.finger_id, r.impression, r.idx) for r in got] == [("2", "1", 0), ("2", "2", 1), ("10", "1", 2), ("x", "0", 3)]
    with pytest.raises(Exception):
        indexes.read_index(spark, str(tmp_path / "none.csv")).collect()
    assert indexes.read_first(spark, [str(tmp_path / "none.csv"), str(tmp_path / "i.csv")], indexes.INDEX).count() == 4


def test_file_names(spark):
    paths = ["/x/DB1/12_3.tif", "/x/odd.png", "/x/7__M_Left_ring_finger_CR.BMP", "/x/10000005_r_500_slap_02.png", "/x/10000005_R_500_slap_13.png"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select(indexes.impression_name(F.col("path")).alias("a"), indexes.subject_name(F.col("path")).alias("b"), indexes.capture_name(F.col("path")).alias("c")).collect()
    assert tuple(got[0].a) == ("12", "3") and tuple(got[1].a) == ("odd", "0")
    assert tuple(got[2].b) == ("7", "M", "Left", "ring", "CR") and got[1].b is None
    assert tuple(got[3].c) == ("10000005", "R", 2) and got[4].c is None
    places = spark.range(1, 11).withColumnRenamed("id", "frgp").select("frgp", indexes.frgp_position().alias("p"), indexes.frgp_hand().alias("h"), indexes.frgp_finger().alias("f")).collect()
    assert [r.p for r in places] == [5, 6, 7, 8, 9, 0, 1, 2, 3, 4]
    assert (places[0].h, places[0].f, places[9].h, places[9].f) == ("Right", "thumb", "Left", "little")


def test_lookups_go_by_whole_names(spark):
    sources = ["FVC2002_DB2_B", "FVC2004_DB3_B", "FVC2000_DB2_B", "FVC2004_DB2_B", "FVC2002_DB3_B", "x"]
    df = spark.createDataFrame([(s,) for s in sources], "source string")
    assert [r.d for r in df.select(indexes.resolution().alias("d")).collect()] == [569, 512, 500, 500, 500, 500]
    assert [r.d for r in df.select(indexes.resolution(known={"x": 7}, usual=1).alias("d")).collect()] == [1, 1, 1, 1, 1, 7]
    captures = spark.createDataFrame([(c,) for c in [*"UVRSABCDEFGHKLMPN", "B2", None]], "capture string")
    got = [r.t for r in captures.select(indexes.capture_type().alias("t")).collect()]
    assert got == ["roll"] * 2 + ["slap"] * 2 + ["roll"] * 8 + ["plain"] * 4 + [None] * 3


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("10000005_R_500_slap-segmented_02.png", ("10000005", "R", 2)),
        ("10000005_6e_roll_10.png", ("10000005", "6E", 10)),
        ("10000005_U_500_roll_00.png", None),
        ("10000005_U_500_roll_11.png", None),
        ("10000005_U_x_roll_01.png", None),
        ("1000005_U_500_roll_01.png", None),
        ("10000005_U_01.png", None),
        ("10000005_U_500_roll_extra_01.png", None),
        ("10000005_U_500_Roll_01.png", None),
        ("10000005_U_500_roll_99999999999999.png", None),
        ("", None),
    ],
)
def test_capture_names(spark, name, want):
    got = spark.createDataFrame([(f"/a/b/{name}",)], "path string").select(indexes.capture_name(F.col("path")).alias("x")).first().x
    assert (tuple(got) if got else None) == want


def test_errata_lines(spark):
    lines = {
        "00002361, Device V, is void": {("00002361", "V")},
        "segmented slap thumbs for 00002420, device r were swapped": {("00002420", "R")},
        "see 00002480_6E_500_x and 00002481_s_1": {("00002480", "6E"), ("00002481", "S")},
        "device R, person 00000001": {("00000001", "R")},
        "00000002 devices R, and device, X": set(),
        "123456789 device R": set(),
        "00000003 Device  7b.": {("00000003", "7B")},
        "x00000004_A_1 00000005_A": set(),
        "": set(),
    }
    for line, want in lines.items():
        got = files.errata(spark.createDataFrame([(line,)], "value string")).collect()
        assert {(r.person, r.capture) for r in got} == want, line


def test_matrix_of_many_rows_is_read_in_parts(spark, tmp_path):
    m = np.arange(300 * 40, dtype="<i4").reshape(300, 40)
    m.tofile(tmp_path / "m.i32")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_matrix(spark, str(tmp_path / "m.i32"), 300, 40).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == m.size and (got.score == m[got.i, got.j]).all()
    before, files.RANGE_BYTES = files.RANGE_BYTES, 1000
    try:
        files.write_matrix(spark.createDataFrame(got.sample(frac=1, random_state=0)), str(tmp_path / "n.i32"), 300, 40)
    finally:
        files.RANGE_BYTES = before
    assert (tmp_path / "n.i32").read_bytes() == m.tobytes()
    files.write_matrix(spark.createDataFrame([(2, 1, 5)], "i long, j long, score long"), str(tmp_path / "e.i32"), 4, 3)
    want = np.full((4, 3), -1, "<i4")
    want[2, 1] = 5
    assert (tmp_path / "e.i32").read_bytes() == want.tobytes()


def test_images():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (8, 8), (1, 3)):
        grey = rng.integers(0, 256, shape).astype(np.uint8)
        assert (images.grey_image(images.to_bitmap(grey)) == grey).all()
    colour = b"BM" + bytes(8) + struct.pack("<I", 54) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([0, 0, 255, 255, 255, 255, 0, 0])
    assert images.bitmap(colour).tolist() == [[76, 255]]  # red, then white; rows from the top
    with pytest.raises(ValueError, match="bitmap"):
        images.bitmap(colour[:28] + b"\x04" + colour[29:])
    flat = np.full((20, 30), 77, np.uint8)
    for kernel in ("bicubic", "lanczos"):
        assert (images.resampled(flat, 13, 50, kernel) == 77).all()
    ramp = np.tile(np.arange(40, 200, 4, dtype=np.uint8), (10, 1))
    wide = images.enlarged(ramp).astype(int)
    assert wide.shape == (30, 120) and np.abs(np.diff(wide[:, 9:-9], axis=1)).max() <= 2 and np.abs(wide[:, 1::3] - ramp.repeat(3, 0)).max() <= 1
    assert images.at_resolution(ramp, 504).shape == ramp.shape and images.at_resolution(ramp, 1000).shape == (5, 20)
    noise = rng.integers(0, 256, (9, 14)).astype(np.uint8)
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)

    def by_hand(row, to):
        """One line of pixels, each new one from its own loop over the old ones."""
        step, out = len(row) / to, []
        for k in range(to):
            x = [(p + 0.5 - (k + 0.5) * step) / max(step, 1) for p in range(len(row))]
            w = [sinc(v) * sinc(v / 3) if abs(v) < 3 else 0 for v in x]
            out.append(sum(a * b for a, b in zip(w, row)) / sum(w))
        return out

    lines = np.array([by_hand(c, 4) for c in np.array([by_hand(r, 20) for r in noise.astype(float)]).T]).T
    assert np.abs(images.resampled(noise, 20, 4) - np.clip(lines, 0, 255)).max() <= 0.5 + 1e-9
    assert images.pixels_of_blocks(np.array([[True, False]]), (5, 10)).sum() == 5 * 8


def test_exclusions(spark, tmp_path):
    log = spark.createDataFrame([("x/12__M_Left_thumb_finger", "y/7__F_a"), ("none", "z/12__M_b")], "a string, b string")
    assert {r.person for r in files.persons_in(log).collect()} == {12, 7}
    pairs_ = spark.createDataFrame([(12, 1), (2, 7), (2, 3)], "person_i long, person_j long")
    assert [tuple(r) for r in files.without_persons(pairs_, files.persons_in(log), ("person_i", "person_j")).select("person_i", "person_j").collect()] == [(2, 3)]
    (tmp_path / "e.json").write_text("[4, 5]")
    assert {r.person for r in files.read_excluded(spark, str(tmp_path / "e.json"), [1]).collect()} == {4, 5}
    assert {r.person for r in files.read_excluded(spark, str(tmp_path / "none.json"), [1]).collect()} == {1}


def test_p_of_mann_whitney(spark, sf_dir):
    """Against the normal tail of the deviates, which are held against SQL."""
    z, p = (catalog.QUERIES[n].build(spark, sf_dir).first() for n in ("mann_whitney_test", "mann_whitney_p_value"))
    tail = lambda x: 0.5 * math.erfc(x / math.sqrt(2))
    assert p.p_greater == pytest.approx(tail(z.z_greater), abs=1e-5) and p.p_two == pytest.approx(min(1, 2 * tail(z.z_two)), abs=1e-5)


def test_exact_interval(spark, sf_dir):
    for r in catalog.QUERIES["exact_share_interval"].build(spark, sf_dir).collect():
        above = lambda share: sum(math.comb(r.n, i) * share**i * (1 - share) ** (r.n - i) for i in range(r.k, r.n + 1))
        assert r.k == 0 or above(r.low) == pytest.approx(0.025, abs=1e-6)
        assert r.k == r.n or 1 - above(r.high) + math.comb(r.n, r.k) * r.high**r.k * (1 - r.high) ** (r.n - r.k) == pytest.approx(0.025, abs=1e-6)


def test_matrix_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    m = rng.integers(0, 99, (7, 7)).astype("<i4")
    m[3, 4] = -1
    m.tofile(tmp_path / "m.i32")
    edges = files.read_matrix(spark, str(tmp_path / "m.i32"), 7)
    assert edges.count() == 48
    files.write_matrix(edges, str(tmp_path / "n.i32"), 7)
    assert (tmp_path / "n.i32").read_bytes() == (tmp_path / "m.i32").read_bytes()
    with pytest.raises(Exception, match="matrix"):
        files.read_matrix(spark, str(tmp_path / "m.i32"), 8).count()
    rng.random((2, 5)).astype("<f4").tofile(tmp_path / "r.f32")
    assert files.read_matrix(spark, str(tmp_path / "r.f32"), 2, 5, "<f4", None).count() == 10


def test_maps_and_minutiae(spark, tmp_path):
    for ending, text in (("dm", "1 -1\n2 3\n"), ("qm", "4 0\n1 1\n"), ("hcm", "0 0\n1 0\n")):
        (tmp_path / f"a.{ending}").write_text(text)
    got = {(r.r, r.c): (r.dir, r.quality, r.curved) for r in files.read_blocks(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (1, 4, 0), (0, 1): (-1, 0, 0), (1, 0): (2, 1, 1), (1, 1): (3, 1, 0)}
    (tmp_path / "a.xyt").write_text("1 2 3 40\n5 6 7\n8 9 10 x 1\n")
    rows = files.read_minutiae(spark, str(tmp_path / "a.xyt")).orderBy("x").collect()
    assert [(r.x, r.quality) for r in rows] == [(1, 40), (8, None)]


def test_groups_verdicts_and_errata(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([["a", "b", "c"], ["d", "e"]]))
    groups = files.read_groups(spark, str(tmp_path / "g.json"))
    tags = spark.createDataFrame([(t,) for t in "abcdefg"], "tag string")
    assert sorted(r.tag for r in files.without_later_copies(tags, groups, ["tag"]).collect()) == ["a", "d", "f", "g"]
    lines = ["both thumbs of 10000001, device R are exchanged", "10000002, Device V", "see 10000003_6E_500.png and 10000004_r_1.png", "nothing 123"]
    got = files.errata(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {(r.person, r.capture) for r in got} == {("10000001", "R"), ("10000002", "V"), ("10000003", "6E"), ("10000004", "R")}
    log = str(tmp_path / "log" / "v.jsonl")
    (tmp_path / "log").mkdir()
    for verdict in ("same", "other"):
        files.append_line(spark, str(tmp_path / "appended"), {"na": "p", "nb": "q", "rot": "", "veredito": verdict})
    written = files.read_verdicts(spark, str(tmp_path / "appended")).collect()
    assert {r.verdict for r in written} == {"same", "other"} and all(r["at"] is not None for r in written)
    rows = "\n".join(json.dumps({"na": "p", "nb": n, "rot": "r", "veredito": v, "gravado_em": t}) for n, v, t in (("q", "x", "2026-01-01T00:00:01"), ("q", "y", "2026-01-01T00:00:03"), ("s", "z", "2026-01-01T00:00:02")))
    (tmp_path / "log" / "v.jsonl").write_text(rows + "\n")
    with pytest.raises(ValueError, match="2 pairs instead of 5, 2 other"):
        files.checked(files.read_verdicts(spark, log), 5, "y")
    assert files.checked(files.read_verdicts(spark, log).where("verdict = 'y'"), 1, "y").count() == 1
    last = {(r.a, r.b): r.verdict for r in files.latest(files.read_verdicts(spark, log)).collect()}
    assert last == {("p", "q"): "y", ("p", "s"): "z"}
    out, marks = str(tmp_path / "last"), str(tmp_path / "cp")
    kept = lambda: {(r.a, r.b): r.verdict for r in stream.keep_last(stream.verdict_stream(spark, str(tmp_path / "log"), 1), out, marks).collect()}
    assert kept() == last == kept()


def test_growing_log_as_a_stream(spark, tmp_path):
    """Two runs over a log that grows, one of whose lines comes late; windows are written when they are over."""
    log = tmp_path / "log"
    log.mkdir()
    line = lambda a, v, minute: json.dumps({"na": a, "nb": "b", "rot": "", "veredito": v, "gravado_em": f"2024-05-01T{minute // 60:02d}:{minute % 60:02d}:00"})
    (log / "1.json").write_text("\n".join([line("p", "x", 0), line("p", "y", 5), line("q", "x", 7)]) + "\n")
    folders = [str(tmp_path / n) for n in ("last", "cp1", "windows", "cp2")]

    def run():
        kept = stream.keep_last(stream.verdict_stream(spark, str(log)), *folders[:2]).collect()
        windows = stream.counts_by_window(stream.verdict_stream(spark, str(log)), *folders[2:]).collect()
        return {r.a: r.verdict for r in kept}, sorted((r.start.minute, r.verdict, r.n) for r in windows)

    assert run() == ({"p": "y", "q": "x"}, [])
    # Earlier than what is known of p, and far later of r.
    (log / "2.json").write_text("\n".join([line("p", "z", 3), line("r", "w", 300)]) + "\n")
    found = run()
    assert found[0] == {"p": "y", "q": "x", "r": "w"}
    (log / "3.json").write_text(line("q", "v", 301) + "\n")
    found = run()
    assert found == ({"p": "y", "q": "v", "r": "w"}, [(0, "x", 2), (0, "y", 1), (0, "z", 1)]) and run() == found


def in_order(folder, header):
    """Lines of sorted files, each of which begins with the header."""
    out = []
    for part in sorted(folder.glob("part-*.csv")):
        head, *lines = part.read_text().splitlines()
        assert head == header
        out += lines
    return out


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_order_without_one_task(spark, tmp_path, ranges):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 300, 500).tolist() + [None] * 3
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, n int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = ordered.numbered(df, [F.col("k").desc_nulls_last(), "n"], first=1).collect()
        want = sorted(((k, n) for n, k in enumerate(keys)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        assert [(r.k, r.n) for r in sorted(got, key=lambda r: r.idx)] == want and sorted(r.idx for r in got) == list(range(1, 504))
        ordered.write_sorted(df.select("n", "k"), str(tmp_path / "s"), ["n"])
        lines = ordered.read_lines(spark, str(tmp_path / "s"), "n,k").collect()
        assert [int(r.line.split(",")[0]) for r in sorted(lines, key=lambda r: r.place)] == list(range(503)) == sorted(r.place for r in lines)
        assert len(in_order(tmp_path / "s", "n,k")) == 503
        assert ordered.numbered(df.limit(0), ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_lines_are_numbered_where_they_are_read(spark, tmp_path, compression):
    """Files cut into many parts, many of them in a task: places are right, and no line is shuffled or written again."""
    where, before = str(tmp_path / "s"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    ordered.write_sorted(spark.range(5000).select("id", F.lit(1).alias("k")).repartition(3), where, ["id"], compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = ordered.read_lines(spark, where, "id,k", first=1)
        assert sorted((r.place, r.line) for r in lines.collect()) == [(k + 1, f"{k},1") for k in range(5000)]
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "rangepartitioning" in x] and "Scan text" in plan and "Scan parquet" not in plan
        assert ordered.read_lines(spark, where, "0,1").count() == 5000 - 1 + len(list((tmp_path / "s").glob("part-*")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("at", [0, 1, 2, 3])
def test_resumed_at_any_file(spark, tmp_path, at, late):
    """Broken off before or after a file's rows are written, a run goes on, and each row is done once."""
    tasks, out, marks = (str(tmp_path / n) for n in ("tasks", "out", "marks"))
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(tasks)
    work, calls = lambda rows: rows.withColumn("x", F.col("id") * 2), []

    def breaks(rows):
        calls.append(1)
        if len(calls) == at + 1:
            if late:
                work(rows).withColumn("batch", F.lit(at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
            raise OSError("gone")
        return work(rows)

    with pytest.raises(Exception, match="gone"):
        files.resumed(spark, tasks, out, marks, breaks)
    done = files.resumed(spark, tasks, out, marks, work)
    assert sorted((r.id, r.x) for r in done.collect()) == [(i, 2 * i) for i in range(40)]
    spark.range(40, 45).coalesce(1).write.mode("append").parquet(tasks)
    seen = []
    more = files.resumed(spark, tasks, out, marks, lambda rows: seen.append(rows.count()) or work(rows))
    assert seen == [5] and more.count() == 45


@pytest.mark.parametrize("kernel", ["bicubic", "lanczos"])
@pytest.mark.parametrize("to", [5, 9, 14])
def test_resized_against_a_loop(spark, kernel, to):
    grey = np.random.default_rng(3).integers(0, 256, (9, 9))
    shape, reach = images.KERNELS[kernel]
    wide = max(9 / to, 1.0)
    want = np.zeros((to, to))
    for y in range(to):
        for x in range(to):
            total = weight = 0.0
            for v in range(9):
                for u in range(9):
                    a, b = ((p + 0.5 - (o + 0.5) * 9 / to) / wide for p, o in ((v, y), (u, x)))
                    if abs(a) < reach and abs(b) < reach:
                        w = float(shape(np.array(a)) * shape(np.array(b)))
                        total, weight = total + w * grey[v, u], weight + w
            want[y, x] = min(255, max(0, total / weight))
    rows = spark.createDataFrame([(1, grey.ravel().tolist())], "image int, pixels array<int>")
    got = images.resized(images.as_bitmaps(rows, 9), to, to, kernel).first()
    assert got.image == 1 and np.abs(np.array(got.pixels).reshape(to, to) - want).max() <= 1


def test_sinks(spark, tmp_path):
    hist = spark.createDataFrame([(0, 2), (3, 1)], "score long, n long")
    files.write_histogram(hist, str(tmp_path / "h"))
    assert in_order(tmp_path / "h", "score,count") == ["0,2", "1,0", "2,0", "3,1"]
    doc = json.loads(files.document(hist=hist, one=hist.limit(1)).first().json)
    assert doc["hist"] == [{"score": 0, "n": 2}, {"score": 3, "n": 1}] and len(doc["one"]) == 1
    df = spark.createDataFrame([(2, 0.5), (1, None)], "k int, x double")
    files.write_features(df, str(tmp_path / "f"), ["k"])
    assert in_order(tmp_path / "f", "k,x") == ["1,", "2,0.500000"]
    people = spark.createDataFrame([(2, "F")], "k int, sex string")
    assert [(r.k, r.sex) for r in files.with_metadata(df, people, "k", ["sex"]).orderBy("k").collect()] == [(1, ""), (2, "F")]


def test_matrix_cells_travel_packed_and_once(spark, tmp_path, monkeypatch):
    """A symmetric matrix in many ranges and tasks, rows without cells, and what its one shuffle moves."""
    monkeypatch.setattr(files, "RANGE_BYTES", 4 * 300 * 7)
    n = 300
    edges = spark.range(n * n).select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j")).where("i < j AND i % 50 <> 3 AND j % 50 <> 3").withColumn("score", F.col("i") * 7 + F.col("j"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = moved()
    files.write_matrix(edges, str(tmp_path / "m.i32"), n, symmetric=True)
    assert 0 < moved() - before < 6 * n * n
    got, want = np.fromfile(tmp_path / "m.i32", "<i4").reshape(n, n), np.full((n, n), -1)
    i, j = np.triu_indices(n, 1)
    known = (i % 50 != 3) & (j % 50 != 3)
    want[i[known], j[known]] = want[j[known], i[known]] = (i * 7 + j)[known]
    assert np.array_equal(got, want)
