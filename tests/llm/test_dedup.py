import glob
import hashlib
import os
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorsift.llm import neargraph, passages, simhash
from mirrorsift.llm.words import word_blocks
from mirrorsift.operators.components import union_find

DOCS = "doc_id long, text string, lang string, source string, key string, fp string, grp string, component_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "k", "f", "g", "c") for i, t in rows], DOCS)


# -- words -----------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n\t\x0b\x0c\r\x1c é", max_size=60), st.integers(1, 20))
def test_blocks_cut_no_word(text, block):
    data = text.encode()
    got = [w for b in word_blocks(data, block) for w in b]
    assert got == data.split()


# -- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text("aB c\nÄ", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_long_text_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefg") for _ in range(500))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "word_blocks", lambda data: word_blocks(data, 7))
    assert simhash.fingerprint(text) == want


def test_golay_is_perfect():
    by_byte, nearest, second = simhash.golay()
    assert len(set(nearest.tolist())) == 2048 and max(int(e).bit_count() for e in nearest) == 3
    heavy = np.array([int(e).bit_count() == 3 for e in nearest])
    assert ((second >= 0).sum(axis=1) == np.where(heavy, 5, 0)).all()


def test_keys_find_every_link():
    r = np.random.default_rng(4)
    a = r.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, r.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ra, ka), (rb, kb) = simhash.probe_keys(a, 0), simhash.probe_keys(b, 1)
    left = set(zip(ra.tolist(), ka.tolist(), strict=True))
    assert {i for i, k in zip(rb.tolist(), kb.tolist(), strict=True) if (i, k) in left} == set(range(len(a)))


def brute_components(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    part = union_find(*zip(*links)) if links else {}
    least = {}
    for i, (d, _) in enumerate(rows):
        least[part.get(i, i)] = min(d, least.get(part.get(i, i), d))
    return [(d, f"{fp[i]:016x}", least[part.get(i, i)]) for i, (d, _) in enumerate(rows)]


def test_simhash_components(spark):
    r = random.Random(2)
    base = [" ".join(r.choice(["the", "of", "a", "fox", "dog", "x1", "y2"]) for _ in range(120)) for _ in range(6)]
    rows = [(10, None), (3, ""), (5, " \n"), (7, "one two"), (8, "ONE two")]
    for i in range(60):
        words = r.choice(base).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "new"
        rows.append((100 + i, " ".join(words)))
    got = [tuple(x) for x in simhash.near_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_simhash_edges(spark):
    rows = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x y z w v u t")])
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == 4 and {x.component_id for x in got if x.doc_id == 1} == {1}
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and kept.count() == 4
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_components(spark.createDataFrame([(1,)], "fp long"), 5)


def test_simhash_ids(spark):
    a, b, c = "a b c d e f", "x y z w v u t", "p q r s t u v w"
    rows = [(None, a), (None, b), (5, a), (6, b), (7, a + " one"), (8, None)]
    got = {(x.doc_id, x.fingerprint): x.component_id for x in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    print_ = lambda t: f"{plain_fingerprint(t):016x}"
    assert got[5, print_(a)] == 5 and got[6, print_(b)] == 6 and got[None, print_(a)] == 5 and got[None, print_(b)] == 6
    rows = [(7, a), (7, b), (7, c), (5, c), (6, a)]
    assert {x.component_id for x in simhash.near_duplicates(docs_of(spark, rows)).collect()} == {5}
    lone = simhash.near_duplicates(docs_of(spark, [(None, a), (None, a)])).collect()
    assert len(lone) == 2 and {x.component_id for x in lone} == {None}


def test_simhash_writes_few_files(spark):
    r = random.Random(6)
    base = [[str(r.randrange(10**6)) for _ in range(120)] for _ in range(150)]
    rows = [(i, " ".join(base[i % 150][:119] + [str(i % 300)])) for i in range(450)]
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/mirrorsift/*"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [tuple(x) for x in simhash.near_duplicates(docs_of(spark, rows)).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(brute_components(rows))
    files = {os.path.basename(d): len(glob.glob(f"{d}/*.parquet")) for d in set(glob.glob(f"{shared}/mirrorsift/*")) - before}
    assert len(files) >= 5 and max(files.values()) <= 4, files


# -- passages --------------------------------------------------------------------------------------


def brute_passages(rows, n=13):
    first = {}
    words = [((t or "").encode().split()) for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if d is not None and first[tuple(w[k : k + n])] < d:
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,seed,bucket", [(13, 1, 64), (13, 2, 1 << 20), (30, 3, 256), (4, 4, 256)])
def test_passages(spark, length, seed, bucket):
    r = random.Random(seed)
    shared = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(5, 60))) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "one"), (None, shared[0]), (4, shared[0]), (4, shared[0] + " tail")]
    for i in range(60):
        rows.append((10 + r.randrange(60), " ".join(r.choice([r.choice(shared), " ".join(f"v{r.randrange(400)}" for _ in range(20))]) for _ in range(4))))
    got = passages.remove_repeats(docs_of(spark, rows), length=length, bucket_bytes=bucket).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x)
    assert sorted(map(tuple, got), key=key) == sorted(brute_passages(rows, length), key=key)


def test_passages_in_pieces_and_salts(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_WORDS", 37)
    r = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(40))
    rows = [(i, " ".join([hot, *(f"u{r.randrange(10**6)}" for _ in range(r.randrange(60))), hot])) for i in range(30)]
    monkeypatch.setattr(passages, "SALT_ROWS", 50)
    got = passages.remove_repeats(docs_of(spark, rows), bucket_bytes=512).collect()
    assert sorted(map(tuple, got)) == sorted(brute_passages(rows))


def test_passages_hot_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(passages, "SPLIT", 0.25)
    r = random.Random(3)
    hot = " ".join(f"h{i}" for i in range(30))
    rows = [(7, f"{hot} a{i}") for i in range(40)] + [(None, hot)] * 30 + [(3, hot), (9, hot + " z")] + [(i, " ".join(f"u{r.randrange(99)}" for _ in range(40))) for i in range(20, 40)]
    got = passages.remove_repeats(docs_of(spark, rows), bucket_bytes=256).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x)
    assert sorted(map(tuple, got), key=key) == sorted(brute_passages(rows), key=key)


def test_windows_are_told_apart_by_all_bits():
    keys, more = np.array([3, 5, 5, 9], dtype=np.uint64), np.array([1, 2, 4, 7], dtype=np.uint64)
    have, also = np.array([5, 5, 5, 3, 9, 1, 10], dtype=np.uint64), np.array([4, 2, 3, 1, 8, 1, 1], dtype=np.uint64)
    assert passages.find_pairs(keys, more, have, also).tolist() == [2, 1, -1, 0, -1, -1, -1]
    assert passages.covered(np.array([2, 4], dtype=np.uint32), 3).tolist() == [False, False, True, True, True, True, True]


def test_windows_that_share_their_first_word(spark, monkeypatch):
    """All windows of a document get one key, so only the other bits tell them apart."""
    monkeypatch.setattr(passages, "level_windows", lambda ids, left, lengths, filters: ((at := np.flatnonzero(left >= 13)), np.full(len(at), 77, dtype=np.uint64)))
    r = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(i, " ".join([*(f"u{r.randrange(10**6)}" for _ in range(20)), *([shared] if i % 2 else [])])) for i in range(8)]
    docs = docs_of(spark.newSession(), rows).coalesce(1)
    found, _ = passages.repeats(docs.select("doc_id", "text"))
    got = sorted((d, p) for x in found.collect() for d, p in zip(np.frombuffer(x.docs, dtype=np.int64).tolist(), np.frombuffer(x.places, dtype=np.uint32).tolist(), strict=True))
    assert got == [(i, p) for i in (3, 5, 7) for p in range(20, 28)]


def test_groups_are_those_of_spark(spark):
    ids = [0, 1, -1, 7, 2**62, -(2**63), 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("pmod(xxhash64(i), 1024) as g").collect()
    assert passages.group_of(np.array(ids, dtype=np.int64), 1024).tolist() == [x.g for x in got]


def test_passages_without_repeats(spark):
    rows = [(1, "a b c"), (2, " ".join(f"x{i}" for i in range(50)))]
    assert sorted(map(tuple, passages.remove_repeats(docs_of(spark, rows)).collect())) == sorted(brute_passages(rows))
    assert passages.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("length,lengths", [(13, [7, 13]), (50, [7, 13, 25, 50]), (4, [2, 4]), (1, [1, 1])])
def test_doubling(length, lengths):
    got = passages.doubling(length)
    assert got == lengths and all(b <= 2 * a for a, b in zip(got, got[1:], strict=False))


# -- embeddings ------------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<float>, label int, id string, grp string, vec string, n string, copies string"


def vecs_of(spark, rows):
    return spark.createDataFrame([(i, v, c, "i", "g", "v", "n", "c") for i, v, c in rows], VECS)


def brute_links(rows, cosine=0.98):
    ok = []
    for i, (_, v, c) in enumerate(rows):
        good = c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=np.float32).astype(float) if good else None)
    near = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                near[i].add(j)
                near[j].add(i)
    part = union_find(*zip(*[(i, j) for i in near for j in near[i]])) if any(near.values()) else {}
    least = {}
    for i, (d, _, _) in enumerate(rows):
        k = part.get(i, i)
        least[k] = min(d, least.get(k, d))
    return sorted((d, len(near[i]), least[part.get(i, i)], d == least[part.get(i, i)]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("shard,chunk", [(1000, 2000), (20, 2000), (20, 15)])
def test_graph_finds_all_links(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(neargraph, "SHARD", shard)
    monkeypatch.setattr(neargraph, "CHUNK", chunk)
    r = np.random.default_rng(7)
    centres = r.normal(size=(25, 16))
    rows = []
    for i in range(220):
        v = centres[r.integers(25)] + r.normal(scale=r.choice([0.02, 0.12, 0.5]), size=16)
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(2))))
    rows += [(500, rows[3][1], rows[3][2]), (501, rows[3][1], rows[3][2]), (502, None, 1), (503, [0.0] * 16, 1), (504, [1.0, None] + [0.0] * 14, 1), (505, [float("nan")] * 16, 1), (506, rows[3][1], None), (507, [1.0, 2.0], 1), (508, [], 0), (509, [float("inf")] + [1.0] * 15, 0)]
    df = vecs_of(spark, rows)
    got = neargraph.near_duplicates(df)
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got.collect()) == brute_links(rows)
    found, there = neargraph.audit(df, got)
    assert there == 0 or found / there >= 0.9


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_lose_no_link(spark, monkeypatch, seed):
    """Shards that are dealt again: clusters at three scales, and a ball of near copies that cannot be parted."""
    monkeypatch.setattr(neargraph, "SHARD", 6)
    monkeypatch.setattr(neargraph, "_centroids", lambda nodes, radius: {})  # the first deal leaves one shard
    r = np.random.default_rng(seed)
    broad = r.normal(size=(6, 24))
    rows = []
    for i in range(420):
        v = broad[r.integers(6)] + 0.5 * r.normal(size=24) if i % 3 else broad[0] + r.normal(scale=0.01, size=24)
        if i % 5 == 0 and rows:
            v = np.array(rows[r.integers(len(rows))][1]) + r.normal(scale=0.02, size=24)
        rows.append((i, [float(np.float32(x)) for x in v], 1))
    rows += [(500, [0.0] * 23 + [1.0], 1), (501, [-0.0] * 23 + [1.0], 1)]
    deals = []
    refine = neargraph.refine
    monkeypatch.setattr(neargraph, "refine", lambda d, radius: deals.append(refine(d, radius)) or deals[-1])
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in neargraph.near_duplicates(vecs_of(spark, rows)).collect())
    want = brute_links(rows)
    assert any(more for _, more in deals)
    found, there = sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True)), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found / there >= 0.98
    assert got[-1] == (501, 1, 500, False)


def test_graph_edges(spark):
    one = [1.0] + [0.0] * 3
    got = neargraph.near_duplicates(vecs_of(spark, [(None, one, 1), (1, one, 1), (2, one, 1)])).collect()
    assert {(x.vec_id, x.n_links, x.component_id) for x in got} == {(None, 0, None), (1, 1, 1), (2, 1, 1)}
    assert neargraph.near_duplicates(vecs_of(spark, []).limit(0)).count() == 0


def test_shards_hold_linked_vectors_together():
    r = np.random.default_rng(1)
    x = neargraph.unit(r.normal(size=(400, 8)))
    y = neargraph.unit(x + r.normal(scale=0.04, size=x.shape))
    centres = neargraph.kmeans(x, 12)
    near = (x * y).sum(axis=1) >= 0.98
    half = (2 - 2 * 0.98) ** 0.5 / 2
    sides = []
    for v in (x, y):
        row, shard, home = neargraph.shards_of(v, centres, half)
        sides.append((set(zip(row.tolist(), shard.tolist(), strict=True)), dict(zip(row[home].tolist(), shard[home].tolist(), strict=True))))
    (xin, xhome), (yin, yhome) = sides
    assert near.sum() > 50 and all((i, yhome[i]) in xin or (i, xhome[i]) in yin for i in np.flatnonzero(near).tolist())
