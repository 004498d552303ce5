"""The public calls on generated files, and the plans behind them against brute force."""

import io
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorsift.functions import matchers
from mirrorsift.operators import blocking, links, outcome, pairs
from mirrorsift.operators.components import union_find
from mirrorsift.params import Params
from mirrorsift.plans import engine
from mirrorsift.sources import media, scan


def bmp(pixels):
    h, w = pixels.shape[:2]
    rows = b"".join(bytes(row[:, ::-1].tobytes()) + b"\0" * (-3 * w % 4) for row in pixels[::-1].astype(np.uint8))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def png(pixels, level=9):
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def picture(seed, shift=0, side=80):
    r = np.random.default_rng(seed)
    small = r.integers(20, 220, (5, 5, 3)).astype(float)
    y = np.linspace(0, 3.999, side)
    i, f = y.astype(int), (y % 1)[:, None, None]
    tall = small[i] * (1 - f) + small[i + 1] * f
    g = (y % 1)[None, :, None]
    return np.clip(tall[:, i] * (1 - g) + tall[:, i + 1] * g + shift, 0, 255).astype(np.uint8)


def write_all(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def named(rows):
    return {(x.group_id.rsplit("/", 1)[1], x.path.rsplit("/", 1)[1]) for x in rows}


def test_images_end_to_end(spark, tmp_path):
    write_all(tmp_path, {"a.bmp": bmp(picture(1)), "b.bmp": bmp(picture(1, 3)), "c.bmp": bmp(picture(1)), "d.bmp": bmp(picture(2)), "sub/e.png": png(picture(1)), "broken.png": b"\x89PNG\r\n\x1a\nno image at all", "_x.txt": b"text file, not an image"})
    image = spark._jvm.javax.imageio.ImageIO
    for name, seed in (("f.jpg", 3), ("g.jpg", 3), ("h.jpg", 4)):
        write_all(tmp_path, {"tmp.png": png(picture(seed))})
        image.write(image.read(spark._jvm.java.io.File(str(tmp_path / "tmp.png"))), "jpg", spark._jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "tmp.png").unlink()
    found = engine.scan(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "none")], "image")
    rows = {x.name: x for x in found.collect()}
    assert len(rows) == 9 and (rows["a.bmp"].width, rows["a.bmp"].format, rows["a.bmp"].mode) == (80, "BMP", "RGB")
    assert (rows["f.jpg"].width, rows["f.jpg"].height, rows["f.jpg"].format, rows["f.jpg"].mode) == (80, 80, "JPEG", "RGB")
    assert rows["broken.png"].a1 is None and rows["a.bmp"].a1 is not None and (rows["e.png"].a1, rows["e.png"].p2) == (rows["a.bmp"].a1, rows["a.bmp"].p2)
    got = engine.find_duplicates(found, "image").collect()
    groups = named(got)
    assert {("a.bmp", "a.bmp"), ("a.bmp", "b.bmp"), ("a.bmp", "c.bmp"), ("f.jpg", "f.jpg"), ("f.jpg", "g.jpg")} == groups
    assert {x.similarity for x in got if x.path.endswith(("c.bmp", "g.jpg"))} == {100.0}
    assert engine.find_duplicates(found.limit(0), "image").count() == 0


def test_videos_end_to_end(spark, tmp_path):
    frames = lambda v, seed, shift=0: {f"{v}.frames/{i:04d}.png": png(picture(seed + i, shift)) for i in range(12)}
    write_all(tmp_path, {"a.mp4": b"x" * 500, "b.avi": b"y" * 500, "c.mkv": b"z" * 500, "none.mov": b"w" * 500, ".hid/d.mp4": b"v" * 500} | frames("a.mp4", 10) | frames("b.avi", 10, 2) | frames("c.mkv", 50) | frames(".hid/d.mp4", 50))
    found = engine.scan(spark, [str(tmp_path)], "video")
    rows = {x.name: x for x in found.collect()}
    assert len(rows) == 5 and rows["none.mov"].frames is None and len(rows["a.mp4"].frames) == 5 and rows["a.mp4"].duration == 1.0
    got = engine.find_duplicates(found, "video").collect()
    assert {x.path.rsplit("/", 1)[1] for x in got if x.group_id.endswith("a.mp4")} == {"a.mp4", "b.avi"}
    again_ = engine.find_duplicates(found, "video", Params(compat=True)).collect()
    assert {x.path.rsplit("/", 1)[1] for x in again_} <= {x.path.rsplit("/", 1)[1] for x in got}
    assert scan.frame_hashes(spark, [str(tmp_path)], 4, skip_ends=False, side=8).where(F.size("frames") == 4).count() == 3  # Spark reads no hidden folder
    short = engine.scan(spark, [str(tmp_path)], "video", Params(min_duration=2.0))
    assert short.count() == 0


def test_fingerprints_are_kept(spark, tmp_path):
    store, pics = str(tmp_path / "store"), tmp_path / "pics"
    write_all(pics, {"a.bmp": bmp(picture(1)), "b.bmp": bmp(picture(2))})
    first = engine.scan(spark, [str(pics)], "image", cache=store).select("name", "a1", "p2").collect()
    assert spark.read.parquet(f"{store}/images").count() == 2
    made = []
    keyed = spark.read.parquet(f"{store}/images").select("path", "mtime")
    scan.cached(keyed, lambda some: made.append(some.count()) or some.select("path"), store, "images").count()
    assert not made  # all stored
    write_all(pics, {"c.bmp": bmp(picture(3))})
    rows = engine.scan(spark, [str(pics)], "image", cache=store).select("name", "a1", "p2").collect()
    assert set(first) < set(rows) and len(rows) == 3 and spark.read.parquet(f"{store}/images").count() == 3
    scan.clear_cache(spark, store)
    assert not (tmp_path / "store").exists()


class Opened(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_headers():
    of = lambda data: media.image_header(Opened(data))
    assert of(png(picture(1))) == (80, 80, "PNG", "RGB") and of(bmp(picture(1))) == (80, 80, "BMP", "RGB")
    assert of(b"GIF89a" + struct.pack("<HH", 7, 5) + b"\0" * 30) == (7, 5, "GIF", "P")
    jpeg = b"\xff\xd8" + b"\xff\xe1\xff\xff" + b"e" * 65533 + b"\xff\xe2\xff\xff" + b"f" * 65533 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 33, 44, 3) + b"\0" * 9
    assert of(jpeg) == (44, 33, "JPEG", "RGB")  # the size stands past the first 64 KB
    entry = lambda tag, value: struct.pack("<HHIHH", tag, 3, 1, value, 0)
    tiff = b"II*\0" + struct.pack("<I", 100_000) + b"\0" * 99_992 + struct.pack("<H", 4) + entry(256, 9) + entry(257, 8) + entry(262, 2) + entry(258, 8)
    assert of(tiff) == (9, 8, "TIFF", "RGB")
    assert of(b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50, "WEBP", "RGBA")
    stream = b"\xff\x4f\xff\x51" + struct.pack(">HHIIII", 47, 0, 20, 10, 0, 0) + b"\0" * 16 + struct.pack(">H", 3)
    assert of(stream) == (20, 10, "JPEG2000", "RGB")
    assert of(struct.pack(">I4sI", 12, b"jP  ", 0x0D0A870A) + struct.pack(">I4s", 0, b"jp2c") + stream) == (20, 10, "JPEG2000", "RGB")
    assert of(b"") == of(b"\xff\xd8\xff") == of(b"plain text that is no image") == (None,) * 4
    avih = struct.pack("<10I", 40_000, 0, 0, 0, 250, 0, 1, 0, 640, 360) + b"\0" * 16
    avi = b"RIFF\0\0\0\0AVI " + b"LIST" + struct.pack("<I", 4 + 8 + len(avih)) + b"hdrl" + b"avih" + struct.pack("<I", len(avih)) + avih
    assert media.video_header(Opened(avi)) == (640, 360, 25.0, 250)
    box = lambda kind, data: struct.pack(">I4s", 8 + len(data), kind) + data
    stbl = box(b"stbl", box(b"stsz", struct.pack(">III", 0, 0, 90)))
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 600, 1800)) + box(b"hdlr", struct.pack(">II4s", 0, 0, b"vide")) + box(b"minf", stbl))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", struct.pack(">II4s", 0, 0, b"soun"))))
    moov = box(b"moov", sound + box(b"trak", box(b"tkhd", b"\0" * 76 + struct.pack(">II", 320 << 16, 200 << 16)) + mdia))
    assert media.video_header(Opened(box(b"ftyp", b"isom") + moov)) == (320, 200, 30.0, 90)
    assert media.video_header(Opened(b"nothing here")) == (None,) * 4


def test_contents_in_small_batches(spark, tmp_path, monkeypatch):
    write_all(tmp_path, {f"f{i}.txt": bytes([65 + i]) * 1000 for i in range(9)})
    monkeypatch.setattr(scan, "BATCH_BYTES", 1500)
    found = scan.scan_directory(spark, str(tmp_path))
    (tmp_path / "f3.txt").unlink()
    listed = found.collect()
    got = scan.with_content(found).collect()
    assert len(got) == 8 and all(bytes(x.content) == bytes([65 + int(x.name[1])]) * 1000 for x in got) and len(listed) in (8, 9)


def test_compat_names_and_rates(spark):
    shown = spark.createDataFrame([("g", "a", 1536), ("g", "b", 1530), ("g", "c", 2000)], "group_id string, path string, size long")
    kept = lambda s: {x.path for x in outcome.keepers(shown, s).where("keep").collect()}
    assert kept("smallest") == {"b"} and kept("smallest_displayed") == {"a"}
    assert outcome.summary(shown, shown.union(shown)).first().rate == 50.0
    assert outcome.throughput(outcome.scan_stats(shown), 0).first().files_per_sec == 0.0


def first_free(paths, there=()):
    """Names by a loop: first of each name keeps it, the others take the first free number."""
    names = [p.rsplit("/", 1)[1] for p in sorted(paths)]
    taken, out, seen = set(names) | set(there), {}, set(there)
    for p, n in zip(sorted(paths), names, strict=True):
        if n not in seen:
            out[p] = n
            seen.add(n)
            continue
        dot = n.rfind(".")
        stem, ending = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        k = 1
        while f"{stem}_{k}{ending}" in taken:
            k += 1
        out[p] = f"{stem}_{k}{ending}"
        taken.add(out[p])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_target_names(spark, seed):
    r = random.Random(seed)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_4.txt", "b", "b_1", ".rc", "x.tar.gz", "a."] if seed else ["a.txt", "a.txt", "a_1.txt"]
    paths = [f"d{i:03d}/{r.choice(names) if seed else names[i]}" for i in range(60 if seed else 3)]
    there = ["b_2", "a_3.txt", "b"] if seed == 2 else []
    df = spark.createDataFrame([("g", "0/keep", True)] + [("g", p, False) for p in paths], "group_id string, path string, keep boolean")
    plan = outcome.action_plan(df, "copy", "/b", spark.createDataFrame([(x,) for x in there], "name string")).collect()
    got = {x.path: x.target.removeprefix("/b/") for x in plan}
    assert len(set(got.values())) == len(paths) and got == first_free(paths, there)


def test_running_sums_and_positions(spark):
    r = random.Random(4)
    rows = [(f"g{min(3, r.randrange(9))}", i, r.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, n long")
    total, want = 0, {}
    for _, i, n in sorted(rows, key=lambda x: x[1]):
        want[i] = total
        total += n
    assert {x.i: x.before for x in blocking.running_sum(df, "n", "i").collect()} == want
    by = {}
    for g, i, _ in sorted(rows):
        by[i] = 1 + sum(1 for k in by if any(x[0] == g and x[1] == k for x in rows))
    assert {x.i: x.position for x in blocking.positions(df, "g", "i").collect()} == by


@pytest.mark.parametrize("heads,growth", [(1, 8), (2, 2)])
def test_bucket_links_lose_no_component(spark, heads, growth):
    r = random.Random(8)
    keys = [(r.randrange(12), i) for i in range(80) for _ in range(2)] + [(99, i) for i in range(0, 80, 3)]
    near = {tuple(sorted(r.sample(range(80), 2))) for _ in range(700)}
    truth = spark.createDataFrame([(a, b, 90.0) for a, b in near], "a long, b long, similarity double")
    got = links.bucket_links(spark.createDataFrame(keys, "key long, id long"), lambda p: p.join(truth, ["a", "b"]), heads, growth).collect()
    members = {}
    for k, i in keys:
        members.setdefault(k, set()).add(i)
    there = [(a, b) for a, b in near if any(a in m and b in m for m in members.values())]
    assert {(x.a, x.b) for x in got} <= set(there)
    part = lambda e: union_find(*zip(*e))
    assert part([(x.a, x.b) for x in got]) == part(there)
    assert links.bucket_links(spark.createDataFrame([], "key long, id long"), lambda p: p.join(truth, ["a", "b"])).count() == 0


def corpus(seed, n=70):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "lek", "san", "du") for b in ("n", "pe", "rro", "k", "sti", "la", "vom")]
    base = [" ".join(r.choice(words) for _ in range(r.choice([12, 25, 45, 80, 300]))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, len(w) // 30, len(w) // 12])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((f"p{i:03d}.txt", " ".join(w) + ("\n" if r.random() < 0.2 else "")))
    return out


def files_of(spark, rows):
    return spark.createDataFrame([(p, p, ".txt", len(t.encode()), float(i), t) for i, (p, t) in enumerate(rows)], "path string, name string, extension string, size long, mtime double, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_all_pairs(spark, seed):
    rows = corpus(seed)
    normal = [" ".join(t.lower().split()) for _, t in rows]
    near, all_pairs = [], 0
    for j in range(len(rows)):
        for i in range(j):
            sizes = [len(rows[k][1].encode()) for k in (i, j)]
            same = rows[i][1] == rows[j][1]
            if same or min(sizes) / max(sizes) >= 0.8 and matchers.similarity_text(normal[i], normal[j], 80.0) >= 80:
                near.append((rows[i][0], rows[j][0]))
                all_pairs += not same
    want = union_find(*zip(*near))
    got = engine.find_duplicates(files_of(spark, rows)).collect()
    assert all_pairs > 20 and {x.path: x.group_id for x in got} == want
    copies = {p for p, t in rows if sum(u == t for _, u in rows) > 1}
    assert {x.path for x in got if x.match_type == "exact"} == copies and all(80 <= x.similarity <= 100 for x in got)
    assert all(x.similarity == 100 for x in got if x.path == x.group_id)


def test_recall_of_buckets(spark):
    """Links at every third document of the test tables against all texts of like size, in blocks."""
    import os

    from mirrorsift.plans.inputs import text_files

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    f = text_files(spark, d).select("path", "doc_id", "size", "text").toPandas().drop_duplicates("text")
    f["t"] = [" ".join(t.lower().split()) for t in f["text"]]
    asked = f[(f["doc_id"] % 3 == 0) & (f["t"].str.len().between(10, 6000))]
    want = []
    for q in asked.itertuples():
        like = f[(f["size"] >= 0.8 * q.size) & (f["size"] <= q.size / 0.8) & (f["path"] != q.path)]
        for x in like.itertuples():
            a, b = (q, x) if q.path < x.path else (x, q)
            grams = lambda t: {t[i : i + 6] for i in range(len(t) - 5)}
            ga, gb = grams(a.t), grams(b.t)
            # texts that share few six-letter runs cannot score: the matcher is asked only where they share a fifth
            if len(ga & gb) >= 0.2 * min(len(ga), len(gb)) and matchers.similarity_text(a.t, b.t, 80.0) >= 80:
                want.append((a.path, b.path))
    groups = {x.path: x.group_id for x in engine.find_duplicates(files_of(spark, [(p, t) for p, t in zip(f["path"], f["text"], strict=True)])).collect()}
    found = sum(groups.get(a, a) == groups.get(b, b) for a, b in want)
    assert len(want) >= 5 and found / len(want) >= 0.9


def test_long_texts_are_compared_whole(spark):
    r = random.Random(3)
    head = " ".join(f"w{r.randrange(300)}" for _ in range(12_000))
    rows = [("a", head + " " + " ".join(f"x{r.randrange(300)}" for _ in range(9000))), ("b", head + " " + " ".join(f"y{r.randrange(300)}" for _ in range(9000)))]
    assert len(head) > 50_000 and engine.find_duplicates(files_of(spark, rows)).count() == 0


def test_compat_plan(spark, monkeypatch):
    r = random.Random(5)
    lines = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota kappa"]
    rows = []
    for i in range(130):
        body = "\n".join([r.choice(lines), *(f"line {r.randrange(2)} of text" for _ in range(2)), r.choice(lines)]) + "\n"
        rows.append((f"f{i:03d}.txt", f"f{i:03d}.txt", ".txt" if i % 3 else ".md", len(body), i * 40_000.0 if i < 100 else i * 400_000.0, body))
    df = spark.createDataFrame(rows, "path string, name string, extension string, size long, mtime double, text string")
    got = {(x.a, x.b) for x in engine.compat_candidates(df, most_pairs=30).collect()}
    # the same by loops: blocks, neighbours in time, runs of 50, the quick check, a stop
    bucket = lambda s: int(s / (s * 0.05 + 1))
    keep = [x for x in rows if sum(bucket(y[3]) == bucket(x[3]) and y[2] == x[2] for y in rows) > 1]
    assert len(keep) > 100
    keep = sorted((x for x in keep if any(y is not x and abs(y[4] - x[4]) < 86400 for y in keep)), key=lambda x: (x[4], x[0]))
    features = {x.path: x for x in pairs.with_features(df, empty_head=True).collect()}

    def quick(a, b):
        a, b = features[a], features[b]
        low, high = sorted((a.size, b.size))
        chars = len(set(a.stem_chars) & set(b.stem_chars)) / len(set(a.stem_chars) | set(b.stem_chars))
        if low / high < 0.8 or (chars < 0.3 and low / high < 0.9) or min(a.line_count, b.line_count) / max(a.line_count, b.line_count) < 0.7:
            return False
        return a.first_lines_hash == b.first_lines_hash or a.last_lines_hash == b.last_lines_hash

    want, held = set(), 0
    for at in range(0, len(keep), 50):
        if held > 30:
            break
        run = [x[0] for x in keep[at : at + 50]]
        some = {tuple(sorted((p, q))) for i, p in enumerate(run) for q in run[:i] if quick(p, q)}
        want |= some
        held += len(some)
    assert got == want and len(want) > 30


def test_details_and_export(spark, tmp_path):
    rows = [("one two. three", "one two. four"), ("", ""), (None, "x"), ("same text here", "same text here")]
    got = engine.similarity_details(spark.createDataFrame(rows, "ta string, tb string")).collect()
    by = {x.ta: x for x in got}
    assert by["same text here"].sequence_similarity == by["same text here"].vocabulary_similarity == 100.0 and by["same text here"].structure_similarity == pytest.approx(100)
    assert by["one two. three"].vocabulary_similarity == 50.0 and by[None].sequence_similarity == 0.0 and by[""].vocabulary_similarity == 0.0
    for form in ("parquet", "csv", "json"):
        outcome.export(spark.createDataFrame(rows, "ta string, tb string"), str(tmp_path / form), form)
        assert spark.read.format(form).option("header", True).load(str(tmp_path / form)).count() >= 3
    with pytest.raises(ValueError):
        outcome.export(spark.range(1).toDF("a"), str(tmp_path / "x"), "xml")
