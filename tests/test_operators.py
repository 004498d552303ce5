import random
import struct

import pytest
from pyspark.sql import functions as F

from mirrorsift.functions import hashes
from mirrorsift.operators import blocking, exact, leaders, outcome, pairs
from mirrorsift.operators.components import connected_components, union_find
from mirrorsift.params import Params
from mirrorsift.plans import engine
from mirrorsift.sources import scan
from mirrorsift.streaming import incremental


def edges_of(spark, pairs_):
    return spark.createDataFrame(pairs_, "a long, b long")


@pytest.mark.parametrize("small", [0, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_union_find(spark, small, seed):
    r = random.Random(seed)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {x.node: x.component for x in connected_components(edges_of(spark, e), small=small).collect()}
    want = {k: v for k, v in union_find(*zip(*[(a, b) for a, b in e if a != b])).items()}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(edges_of(spark, [])).count() == 0
    assert connected_components(edges_of(spark, [(1, 1), (None, 2)])).count() == 0


@pytest.mark.parametrize("small", [0, 20_000])
def test_leaders_are_greedy(spark, small):
    r = random.Random(5)
    names = [f"f{i:02d}" for i in range(40)]
    e = sorted({tuple(sorted(r.sample(names, 2))) for _ in range(60)})
    near = {(a, b) for a, b in e}
    claimed, want = set(), {}
    for n in names:
        if n in claimed:
            continue
        group = [m for m in names if m > n and m not in claimed and (n, m) in near]
        claimed.update([n, *group])
        if group:
            want[n] = set(group) | {n}
    df = spark.createDataFrame([(a, b, 90.0) for a, b in e], "a string, b string, similarity double")
    got = {}
    for x in leaders.leader_clusters(df, small=small).collect():
        got.setdefault(x.leader, set()).add(x.member)
    assert got == want


def test_near_in_time(spark):
    r = random.Random(3)
    times = [(i, float(r.randrange(40 * 86400))) for i in range(60)]
    df = spark.createDataFrame(times, "k long, mtime double")
    want = {k for k, t in times if any(j != k and abs(t - s) < 86400 for j, s in times)}
    assert {x.k for x in blocking.near_in_time(df).collect()} == want


def test_numbered_is_global(spark):
    df = spark.createDataFrame([(f"{i * 7919 % 1000:04d}",) for i in range(1000)], "path string")
    got = blocking.numbered(df, "path").orderBy("path").collect()
    assert [x.row_number for x in got] == list(range(1, 1001))


@pytest.mark.parametrize("size,bucket", [(10, 6), (47, 14), (60, 15), (80, 16), (114, 17), (180, 18), (380, 19), (10**6, 19)])
def test_size_bucket(spark, size, bucket):
    assert spark.range(1).select(blocking.size_bucket(F.lit(size)).alias("b")).first().b == bucket


def test_keepers_and_plans(spark):
    m = spark.createDataFrame(
        [("g", "x/a.txt", 5, 1.0, 9), ("g", "y/a.txt", 5, 2.0, 9), ("g", "z/a.txt", 3, 3.0, None), ("h", "p/b", 1, 1.0, 1), ("h", "q/b", 1, 1.0, 1)],
        "group_id string, path string, size long, mtime double, char_count long",
    )
    kept = lambda s: {x.path for x in outcome.keepers(m, s).where("keep").collect()}
    assert kept("largest") == {"x/a.txt", "p/b"} and kept("smallest") == {"z/a.txt", "p/b"} and kept("newest") == {"z/a.txt", "p/b"} and kept("oldest") == {"x/a.txt", "p/b"} and kept("other") == {"x/a.txt", "p/b"}
    plan = outcome.action_plan(outcome.keepers(m, "newest"), "backup", "/b/").collect()
    assert {x.path: x.target for x in plan} == {"x/a.txt": "/b/a.txt", "y/a.txt": "/b/a_1.txt", "q/b": "/b/b"}
    manual = outcome.keepers(m, "manual", spark.createDataFrame([("x/a.txt",)], "path string"))
    assert {x.path for x in outcome.action_plan(manual, "trash").collect()} == {"y/a.txt", "z/a.txt"}  # group h has no keeper
    for bad in (("move", "/b"), ("copy", "")):
        with pytest.raises(ValueError):
            outcome.action_plan(manual, *bad)


def write_all(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_directory(spark, tmp_path):
    write_all(tmp_path, {"a.txt": "x" * 10, "small.txt": "x" * 9, "sub/B.MD": "y" * 20, ".hid/c.txt": "z" * 20, "build/d.txt": "z" * 20, "n.bin": "z" * 20, "build2/e.txt": "w" * 11, "_u/__init__.py": "v" * 12})
    got = {x.name: x for x in scan.scan_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "B.MD", "e.txt", "__init__.py"} and got["B.MD"].extension == ".md" and got["a.txt"].size == 10
    assert scan.scan_directories(spark, [str(tmp_path), str(tmp_path / "sub")]).count() == 4
    assert scan.scan_directory(spark, str(tmp_path / "none")).count() == 0
    write_all(tmp_path, {"build/v.mp4": b"", ".h/w.MKV": b"1"})
    assert scan.scan_directory(spark, str(tmp_path), "video").count() == 2


def test_encodings_and_images(spark, tmp_path):
    write_all(tmp_path, {"u.txt": "héllo wörld", "g.txt": "中文文本中文文本".encode("gbk"), "l.txt": b"caf\xe9 \xff\xff caf\xe9 x"})
    got = {x.name: (x.encoding, x.text) for x in scan.with_text(scan.scan_directory(spark, str(tmp_path))).collect()}
    assert got["u.txt"] == ("utf-8", "héllo wörld") and got["g.txt"] == ("gbk", "中文文本中文文本") and got["l.txt"][0] == "latin-1"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x02"
    write_all(tmp_path, {"p.png": png, "bad.jpg": b"no image"})
    got = {x.name: (x.width, x.height, x.format) for x in scan.with_image_info(scan.scan_directory(spark, str(tmp_path), "image")).collect()}
    assert got == {"p.png": (640, 480, "PNG"), "bad.jpg": (None, None, None)}


def test_image_hashes(spark, tmp_path):
    # an uncompressed 24-bit bitmap, once plain and once a little brighter
    def bmp(shift):
        w = h = 32
        rows = b"".join(bytes(min(255, 3 * (x + y) + shift) for x in range(w) for _ in range(3)) for y in range(h))
        return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows

    write_all(tmp_path, {"a.bmp": bmp(0), "b.bmp": bmp(9)})
    got = scan.image_hashes(spark, str(tmp_path)).collect()
    assert len(got) == 2 and got[0].ahash == got[1].ahash


#: Shaped like the reference's small corpora: two equal texts and files that differ in a number.
def test_small_corpora(spark, tmp_path):
    same = "alpha beta gamma\ndelta epsilon\nzeta eta\ntheta iota kappa lambda"
    write_all(tmp_path, {"t/test1.txt": same, "t/test2.txt": same, "t/test3.txt": same.replace("beta", "betas") + " mu", "t/different.txt": "quite another text\nwith other words\nin it, one two\nthree four five\nsix"})
    found = engine.scan(spark, [str(tmp_path / "t")])
    compat = engine.find_duplicates(found, params=Params(compat=True)).collect()
    assert {(x.path.rsplit("/", 1)[1], x.match_type) for x in compat} == {("test1.txt", "exact"), ("test2.txt", "exact")}
    write_all(tmp_path, {**{f"l/file_{i}.txt": f"This is test file {i} with some random content \n" for i in range(1, 21)}, **{f"l/dup{i}.txt": "Duplicate content for testing  \n" for i in (1, 2, 3)}})
    found = engine.scan(spark, [str(tmp_path / "l")])
    got = engine.find_duplicates(found).collect()
    assert sum(x.match_type == "exact" for x in got) == 3
    assert len({x.group_id for x in got if "dup" in x.path}) == 1


def test_quick_pairs_match_nested_loop(spark, sf_dir):
    from mirrorsift.plans.inputs import text_files

    f = pairs.with_features(text_files(spark, sf_dir)).cache()
    a, b = f.alias("a"), f.alias("b")
    head = F.col("a.first_lines_hash") == F.col("b.first_lines_hash")
    tail = F.col("a.last_lines_hash") == F.col("b.last_lines_hash")
    word = F.size(F.array_intersect("a.word_sample", "b.word_sample")) / F.nullif(F.size(F.array_union("a.word_sample", "b.word_sample")), F.lit(0)) > 0.5
    want = a.join(b, (F.col("a.path") < F.col("b.path")) & pairs.sized_gates("a", "b") & (F.coalesce(head, F.lit(False)) | F.coalesce(tail, F.lit(False)) | F.coalesce(word, F.lit(False))))
    want = {(x[0], x[1]) for x in want.select("a.path", "b.path").collect()}
    assert {(x.a, x.b) for x in pairs.quick_pairs(f).collect()} == want


def test_exact_groups_edge_cases(spark):
    df = spark.createDataFrame([("a", "x\r\ny"), ("b", "x\ny"), ("c", None), ("d", None), ("e", ""), ("f", "")], "path string, text string")
    assert {x.path for x in exact.exact_groups(df, prefix_chars=100).collect()} == {"a", "b", "e", "f"}
    assert {x.path for x in exact.exact_groups(df).collect()} == {"e", "f"}
    assert exact.exact_groups(df.limit(0)).count() == 0


def test_streaming_first_seen(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "t1", "2024-01-01 00:00:00"), ("b", "t1", "2024-01-01 01:00:00"), ("c", "t2", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "path string, text string, ts string").select("path", "text", F.to_timestamp("ts").alias("mtime_ts"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = incremental.first_seen(stream).writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {x.text for x in spark.table("seen").collect()} == {"t1", "t2"} and spark.table("seen").count() == 2
    known = spark.createDataFrame([("k", "t1")], "path string, text string").withColumn("content_hash", F.md5("text")).drop("text")
    got = {x.path: x.duplicate_of for x in incremental.against_known(df, known).collect()}
    assert got == {"a": "k", "b": "k", "c": None}


@pytest.mark.parametrize("kind", ["image", "video"])
def test_pairs_of_a_small_hot_block_are_many_tasks(spark, kind):
    """A block of few bytes makes many pairs: AQE must not join its parts by their bytes."""
    rows = [(f"p{i:03d}", 1, [i * 7919 % 1024, i], i * 31 % 256, i % 16, i * 17 % 256, i % 8) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, k int, frames array<long>, a1 long, a2 long, p1 long, p2 long")
    edges = engine.video_edges if kind == "video" else engine.image_edges
    found = edges(df, Params(similarity_threshold=90.0), block="k")
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= 6
    if kind == "video":
        differ = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y))
        want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and (1 - differ(x[2], y[2]) / 72) * 100 >= 90}
        assert {(x.a, x.b) for x in found.collect()} == want and want


def test_written_out_frames_score_alike(spark):
    rows = [([], []), ([1, 2], [1, 2]), ([1, 7, 255], [0, 7, 1 << 35]), ([1], [1, 2]), ([1, None], [1, 5]), (None, [1]), ([3] * 5, [12] * 5)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for denominator in ("bits", "rows"):
        plain, out = (hashes.frame_similarity(F.col("a"), F.col("b"), denominator=denominator, most=n) for n in (None, 5))
        assert df.where(~plain.eqNullSafe(out)).count() == 0


def test_scored_pairs_are_many_tasks(spark):
    """Few bytes of pairs are much work: the matcher has tasks by number, not the partitions that joins leave."""
    texts = spark.createDataFrame([(i, f"p{i:02d}", f"some words {i} " * 20) for i in range(40)], "id long, path string, t string")
    candidates = spark.createDataFrame([(i, j) for i in range(40) for j in range(i)], "a long, b long")
    found = engine.scored_pairs(texts, candidates, 0.0)
    assert len(found.groupBy(F.spark_partition_id().alias("p")).count().collect()) >= 12 and found.count() == 780
