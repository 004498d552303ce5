import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorsift.functions import files, hashes, matchers, text
from mirrorsift.operators import pairs
from mirrorsift.params import Params
from mirrorsift.sources import scan

one = lambda spark, c: spark.range(1).select(c.alias("c")).first()["c"]


@pytest.mark.parametrize("path,expected", [("a/b/X.TXT", ".txt"), ("a/.bashrc", ""), ("noext", ""), ("a.tar.gz", ".gz"), ("", ""), ("a.b/c", "")])
def test_suffix(spark, path, expected):
    assert one(spark, files.suffix(F.lit(path))) == expected


@pytest.mark.parametrize("size,expected", [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1 << 20, "1.0 MB"), (1 << 50, "1.0 PB"), (1 << 61, "2048.0 PB")])
def test_format_size(spark, size, expected):
    assert one(spark, files.format_size(F.lit(size))) == expected


def test_format_size_rounds_as_printf(spark):
    """Ties go to the even digit, and a value that only looks like a tie to its own side."""
    sizes = [1280.0, 3328.0, 3840.0, 1023.95 * 1024, 1.15 * 1024, 8.35 * 1024, 0.25, 0.15, 2.675, 1023.95, 900.05 * 1024**2]
    got = [x.t for x in spark.createDataFrame([(i, v) for i, v in enumerate(sizes)], "i int, v double").select("i", files.format_size(F.col("v")).alias("t")).orderBy("i").collect()]
    powers = [sum(v >= 1024 ** (k + 1) for k in range(5)) for v in sizes]
    assert got == [f"{v / 1024**k:.1f} {files.SIZE_UNITS[k]}" for v, k in zip(sizes, powers)]


@pytest.mark.parametrize("value,expected", [("1.5 KB", 1536.0), ("2 xb", 2.0), ("x KB", 0.0), ("", 0.0), ("3", 0.0), (None, 0.0)])
def test_parse_size(spark, value, expected):
    assert one(spark, files.parse_size(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("seconds,expected", [(0, "N/A"), (-3, "N/A"), (59.9, "00:59"), (60, "01:00"), (3661, "01:01:01"), (None, "N/A")])
def test_format_duration(spark, seconds, expected):
    assert one(spark, files.format_duration(F.lit(seconds).cast("double"))) == expected


@pytest.mark.parametrize("percent,bits", [(50, 32), (60, 25), (70, 19), (80, 12), (85, 9), (90, 6), (95, 3), (99, 0), (100, 0)])
def test_hash_threshold(spark, percent, bits):
    assert one(spark, files.hash_threshold(F.lit(percent))) == bits


@pytest.mark.parametrize("total,n,expected", [(0, 5, None), (3, 5, [0, 1, 2]), (5, 5, [0, 1, 2, 3, 4]), (100, 5, [10, 30, 50, 70, 90]), (100, 1, [10])])
def test_frame_indices(spark, total, n, expected):
    assert one(spark, files.frame_indices(F.lit(total).cast("long"), n)) == expected


def test_video_metadata(spark):
    count, duration = files.video_metadata(F.lit(20 << 20), F.lit(25.0), F.lit(0))
    assert (one(spark, count), one(spark, duration)) == (250, 10.0)
    count, duration = files.video_metadata(F.lit(1 << 20), F.lit(0.0), F.lit(7))
    assert (one(spark, count), one(spark, duration)) == (7, 1.0)


@pytest.mark.parametrize("value,lines", [("", 0), ("a", 1), ("a\n", 2), ("a\nb", 2)])
def test_line_count(spark, value, lines):
    assert one(spark, text.line_count(F.lit(value))) == lines


def test_line_features(spark):
    f = text.line_features(F.lit("a\n b \n  "))
    assert one(spark, f["line_count"]) == 2
    assert one(spark, f["avg_line_length"]) == 2.0
    assert one(spark, f["line_length_variance"]) == 1.0
    assert one(spark, text.line_features(F.lit("single"))["first_lines_hash"]) is None
    assert one(spark, text.line_features(F.lit("single"), empty_head=True)["first_lines_hash"]) == "d41d8cd98f00b204"


def test_word_sample_is_unicode(spark):
    value = "\n".join(["x"] * 9 + ["Über heißt älter und mehr noch"]) + "\n"
    assert sorted(one(spark, text.word_sample(F.lit(value)))) == sorted("über heißt älter und mehr".split())


@pytest.mark.parametrize("value,expected", [("short", None), ("  A \n B  longer ", "a b longer"), ("x" * 9, None)])
def test_normalize(spark, value, expected):
    assert one(spark, text.normalize(F.lit(value))) == expected


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, text.cosine(a, b)) - 0.5**0.5) < 1e-12
    assert one(spark, text.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert one(spark, text.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_name_similarity(spark):
    assert one(spark, pairs.name_similarity(F.lit("test3.txt"), F.lit("different.txt"))) == pytest.approx(0.222, abs=0.001)
    assert one(spark, pairs.name_similarity(F.lit(""), F.lit("a"))) == 0.0


@settings(max_examples=60, deadline=None)
@given(st.text("ab c\n", max_size=80), st.text("ab c\n", max_size=80))
def test_sequence_ratio_is_difflib(a, b):
    assert matchers.seq_ratio_text(a, b) == SequenceMatcher(None, a, b).ratio() * 100


@settings(max_examples=20, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=1500), st.text("abcd ", min_size=1, max_size=1500))
def test_sampled_ratio_skips_change_nothing(a, b):
    size, best = len(a), []
    for at in (0, size // 4, size // 2, 3 * size // 4, max(0, size - 500)):
        if at < size:
            best.append(max(SequenceMatcher(None, a[at : at + 500], b[i : i + 500]).ratio() for i in range(0, len(b), 250)))
    assert matchers.sampled_ratio_text(a, b) == pytest.approx(sum(best) / len(best) * 100)


def test_similarity_gates(spark):
    assert one(spark, matchers.text_similarity(F.lit("same text"), F.lit("same text"))) == 100.0
    assert one(spark, matchers.text_similarity(F.lit("a"), F.lit("abcdefgh"))) == 0.0
    assert one(spark, matchers.text_similarity(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, matchers.text_similarity(F.lit("abcd"), F.lit("abce"))) == 75.0


def test_encodings():
    assert matchers.encoding_of(b"") == "utf-8"
    assert matchers.encoding_of(("中" * 400).encode()[:1024]) == "utf-8"
    assert matchers.encoding_of("中文文本".encode("gbk")) == "gbk"
    assert matchers.encoding_of(b"caf\xe9 \xff\xff") == "latin-1"


def test_frame_similarity(spark):
    a, b = F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), F.array(F.lit(63).cast("long"), F.lit(0).cast("long"))
    assert one(spark, hashes.frame_similarity(a, b)) == pytest.approx((1 - 6 / 72) * 100)
    assert one(spark, hashes.frame_similarity(a, b, denominator="rows")) == 50.0
    assert one(spark, hashes.frame_similarity(a, F.array(F.lit(0).cast("long")))) == 0.0


def test_pixel_hashes():
    import numpy as np

    y, x = np.mgrid[0:64, 0:64]
    grey = np.floor(60 + 50 * np.sin(x / 9.0) + 40 * np.cos(y / 7.0 + x / 31.0)).clip(0, 127)
    large = np.kron(grey, np.ones((2, 2)))
    for bits in (hashes.average_bits, hashes.dct_bits):
        assert 16 <= bits(grey).sum() <= 48 and (bits(grey) != bits(large)).sum() <= 4
    assert (hashes.dct_bits(grey) != hashes.dct_bits(grey * 2)).sum() <= 4
    colour = np.stack([grey, grey, grey], axis=2)
    assert (hashes.grey(colour) == grey).all() and (hashes.average_bits(colour) == hashes.average_bits(grey)).all()


def test_resampling():
    import numpy as np

    flat = np.full((50, 30), 77.0)
    assert (hashes.resized(flat, 8, 8) == 77).all() and hashes.shrunk(np.full((480, 640, 3), 9.0)).shape == (240, 320, 3)
    ramp = np.tile(np.arange(0, 256, 4.0), (64, 1))
    assert np.abs(hashes.resized(ramp, 8, 8)[0] - (np.arange(8) * 32 + 14)).max() <= 3
    assert np.allclose(hashes._weights(100, 7, hashes._lanczos, 3.0).sum(axis=1), 1)


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", max_size=60), st.text("abc ", max_size=60))
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    assert matchers.common_length(matchers.positions(a), len(a), b) == (row[-1] if a else 0)


def plain_sampled(a, b):
    best = []
    for at in (0, len(a) // 4, len(a) // 2, 3 * len(a) // 4, max(0, len(a) - 500)):
        if at < len(a):
            best.append(max((SequenceMatcher(None, a[at : at + 500], b[i : i + 500]).ratio() for i in range(0, len(b), 250)), default=0.0))
    return sum(best) / len(best) * 100 if best else 0.0


def test_bounds_change_no_score():
    import random

    r = random.Random(6)
    words = ["the", "river", "of", "stone", "bright", "walks", "under", "seven", "lamps"]
    for n in range(12):
        a = " ".join(r.choice(words) for _ in range(r.randrange(150, 420)))
        b = "".join(c for c in a if r.random() > 0.02 * n) if n % 3 else " ".join(r.choice(words) for _ in range(300))
        want = plain_sampled(a, b)
        assert matchers.sampled_ratio_text(a, b) == pytest.approx(want)
        assert matchers.sampled_ratio_text(a, b, 80.0) == pytest.approx(want if want >= 80 else 0.0)
        if max(len(a), len(b)) > matchers.LONG:
            assert matchers.similarity_text(a, b, want - 1e-6) == pytest.approx(want)


def test_params(tmp_path):
    p = Params().update(similarity_threshold=90.0, extensions=(".txt",))
    p.save(tmp_path / "a" / "config.json")
    assert Params.load(tmp_path / "a" / "config.json") == p
    assert Params.load(tmp_path / "none.json") == Params()
    with pytest.raises(TypeError):
        p.update(unknown=1)
    q = p.set("keep", "oldest")
    assert q.keep == "oldest" and q.reset("keep") == p and q.reset() == Params()


def test_extension_sets():
    assert ".abc" in scan.with_extension(files.TEXT_EXTENSIONS, ".ABC")
    assert ".txt" not in scan.without_extension(files.TEXT_EXTENSIONS, ".TXT")
    with pytest.raises(ValueError):
        scan.with_extension(files.TEXT_EXTENSIONS, "abc")
    assert len(files.TEXT_EXTENSIONS) == 40 and len(files.IMAGE_EXTENSIONS) == 14 and len(files.VIDEO_EXTENSIONS) == 12


def edited(r, text, edits, alphabet):
    out = list(text)
    for _ in range(edits):
        at = r.randrange(len(out) + 1)
        out[at : at + r.choice([0, 0, 1, 20])] = [r.choice(alphabet) for _ in range(r.choice([0, 1, 3]))]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz.,0123456789" + "e" * 40 + " " * 60, "aé😀x "])
def test_matcher_is_difflib(alphabet):
    r = random.Random(len(alphabet))
    for size in (0, 1, 60, 199, 200, 350, 500, 700):
        for edits in (0, 5, 40):
            a = "".join(r.choice(alphabet) for _ in range(size))
            b = edited(r, a, edits, alphabet)
            for autojunk in (True, False):
                assert matchers.Matcher(b, autojunk).ratio(a) == SequenceMatcher(None, a, b, autojunk).ratio()


def words_of(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzeeeaaattt") for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("least", [0.0, 55.0, 80.0])
def test_sampled_ratio_against_all_windows(least):
    r = random.Random(4)
    for n in (1, 80, 200, 500):
        for edits in (0, 20, 200):
            a = words_of(r, n)
            b = edited(r, a, edits, "abc xyz")
            probes = [a[at : at + 500] for at in (0, len(a) // 4, len(a) // 2, 3 * len(a) // 4, max(0, len(a) - 500)) if at < len(a)]
            tops = [max((SequenceMatcher(None, p, b[i : i + 500]).ratio() for i in range(0, len(b), 250)), default=0.0) for p in probes]
            want = sum(tops) / len(tops) * 100
            assert matchers.sampled_ratio_text(a, b, least) == pytest.approx(want if want >= least else 0.0, abs=1e-9)
    assert matchers.sampled_ratio_text("a" * 30, "") == matchers.sampled_ratio_text("", "a") == 0.0


def test_hopeless_pairs_are_left_early(monkeypatch):
    r = random.Random(8)
    shared = words_of(r, 150)
    met = []
    whole = matchers.Matcher.ratio
    monkeypatch.setattr(matchers.Matcher, "ratio", lambda self, a: met.append(a) or whole(self, a))
    assert matchers.sampled_ratio_text(shared + words_of(r, 600), shared + words_of(r, 600), 80.0) == 0.0
    assert len(met) <= 5
