import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mirrorsift.llm import mixing, quality, queries, secrets, simhash, warc
from mirrorsift.llm.decontam import scan as decontam_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- quality ---------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    got = queries.op3_pu_quality(spark, d).toPandas()
    labels = pd.read_parquet(f"{d}/labels.parquet").merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert quality.auc(held.quality, held.score) >= 0.95 and (held.quality == held.predicted).mean() >= 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_prior_and_risk():
    r = np.random.default_rng(0)
    pos, neg = r.normal(2, 1, (4000, 3)), r.normal(-2, 1, (4000, 3))
    unl = np.concatenate([r.normal(2, 1, (3000, 3)), neg[:1000]])
    m = quality.fit(pos, unl)
    assert abs(m.prior - 0.75) < 0.06
    assert (m.score(neg) < 0.5).mean() > 0.95 and (m.score(pos) >= 0.5).mean() > 0.95


def test_risk_is_least(monkeypatch):
    """The fitted risk against a search over a grid of one-dimensional models, and the step where the risk would turn negative."""
    r = np.random.default_rng(2)
    pos, unl = r.normal(1.5, 1, (1500, 1)), np.concatenate([r.normal(1.5, 1, (900, 1)), r.normal(-1.5, 1, (600, 1))])
    m = quality.fit(pos, unl)
    soft = lambda z: np.logaddexp(0, z)

    def risk(gp, gu):
        return m.prior * soft(-gp).mean() + max(0.0, soft(gu).mean() - m.prior * soft(gp).mean())

    z = lambda x: np.clip((x[:, 0] - m.mean[0]) / m.scale[0], -8, 8)
    best = min(risk(w * z(pos) + b, w * z(unl) + b) for w in np.linspace(0, 8, 41) for b in np.linspace(-6, 6, 61))
    assert risk(m.margin(pos), m.margin(unl)) <= best + 0.01
    assert abs(m.prior - 0.6) < 0.06


def test_features_in_blocks(monkeypatch):
    from mirrorsift.llm.words import word_blocks

    text = "a a b. C d! " * 50
    whole = quality.features(text)
    monkeypatch.setattr(quality, "word_blocks", lambda data: word_blocks(data, 16))
    part = quality.features(text)
    assert np.allclose(np.delete(whole, 10), np.delete(part, 10))
    assert not quality.features(None).any() and not quality.features(" \n").any()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3), (1, "a b", None, None, 3)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none) is None
    got = quality.score(docs, None).collect()
    assert len(got) == 4 and {x.score for x in got} == {0.5} and [x.held_out for x in got if x.doc_id is None] == [True]
    assert quality.keep(docs, None).columns == docs.columns and quality.keep(docs, None).count() == 4
    assert quality.score(docs.limit(0), None).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None  # 1 is contradicted, the others have no label


# -- mixing ----------------------------------------------------------------------------------------


def test_mixing_counts(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", ["a", "b", None][i % 3 if i < 600 else 0], i) for i in range(3000)], DOCS)
    got = mixing.poisson_mix(docs, {"a": 1.0, "b": 1.0, None: 2.0})
    n = Counter(x.source for x in got.select("source").collect())
    assert abs(n["a"] - 750) < 120 and abs(n["b"] - 750) < 120 and abs(n[None] - 1500) < 170
    rows = got.where("source = 'b'").collect()
    assert {x.doc_id: x.n_copies for x in rows} == dict(Counter(x.doc_id for x in rows))
    # counts invert the distribution function at the hashed number
    rate = 750 / 200
    for i in list(range(1, 600, 3))[:50]:
        u, k, c = int(hashlib.md5(f"0:1:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        p = c
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert sum(x.doc_id == i for x in rows) == k


def test_mixing_high_rates_and_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "a", None), (1, None, None, "a", None), (None, "x", "en", "b", 1)] + [(i, "t", "en", "c", 1) for i in range(10, 3000)], DOCS)
    got = mixing.poisson_mix(docs, {"a": 1.0})
    n = got.count()
    assert {x.source for x in got.select("source").distinct().collect()} == {"a"} and abs(n - 2993) < 400
    assert mixing.poisson_mix(docs.limit(0)).count() == 0
    clash = docs.withColumn("copy", F.lit(9)).withColumn("cdf", F.lit("x"))
    assert mixing.poisson_mix(clash).columns.count("copy") == 1
    assert mixing.poisson_mix(docs, {}).count() == 0


def test_mixing_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "en", "a", i) for i in range(2000)], DOCS)
    for seed in range(3):
        got = mixing.poisson_mix(docs, {"a": 1.0}, seed=seed).collect()
        n = Counter(x.text for x in got)
        assert 1700 < len(got) < 2300 and 600 < 2000 - len(n) < 870 and len({x.order_key for x in got}) == len(got)


def test_mixing_is_repeatable_and_shuffled(spark):
    docs = spark.createDataFrame([(i, "t", "en", f"s{i % 4}", 1) for i in range(800)], DOCS)
    a, b = mixing.poisson_mix(docs).collect(), mixing.poisson_mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    order = [x.doc_id for x in a]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.2


# -- WARC ------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, first string"
BIG = "<html>" + "é" * 60 + "</html>"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "f") for i, u, h in rows], PAGES)


def test_round_trip(spark):
    rows = [(5, "u5", BIG), (3, "u3", BIG), (9, None, None), (8, "u\r\n8", ""), (7, "u7", "small"), (6, "u6", "small"), (2, "u2", BIG + "x"), (5, "u5", BIG)]
    got = (tuple(x) for x in warc.round_trip(pages_of(spark, rows)).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "").encode() == data)
        revisit = len(data) >= 100 and first < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0
    one = warc.round_trip(pages_of(spark, [(None, "u", BIG), (1, "v", BIG)])).collect()
    assert {(x.page_id, x.record_type, x.refers_to) for x in one} == {(None, "response", None), (1, "response", None)}


def test_selected_records_and_payloads(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i + 1)) for i in range(300)]
    index = warc.write(pages_of(spark, rows), archive_bytes=2000)
    assert index.select("archive").distinct().count() > 4
    some = warc.read(index.where("page_id % 50 = 0"), index._warc_folder).collect()
    assert {x.page_id: bytes(x.payload).decode() for x in some} == {i: h for i, _, h in rows if i % 50 == 0}
    spans = index.orderBy("archive", "offset").collect()
    for a, b in zip(spans, spans[1:], strict=False):
        assert a.archive != b.archive or a.offset + a.length == b.offset


def test_archives_of_lost_tasks_are_cleaned(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages_of(spark, [(1, "u", BIG), (2, "v", "x")]), folder)
    (tmp_path / "warc" / "lost.warc.gz").write_bytes(b"half a record")
    assert warc.clean(index) == 1 and warc.clean(index) == 0 and warc.read(index).count() == 2


def test_payloads_can_stay(spark):
    index = warc.write(pages_of(spark, [(1, "u", BIG), (2, "v", BIG)]))
    assert "payload" not in warc.read(index, payload=False).columns and {x.payload_bytes for x in warc.read(index, payload=False).collect()} == {len(BIG.encode()), None}


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (300, 1)], gap=100, most=1000) == [(0, 105, 0, 2), (300, 301, 3, 3)]
    assert warc.ranges([(0, 10), (10, 10)], gap=0, most=15) == [(0, 10, 0, 0), (10, 20, 1, 1)]
    assert warc.ranges([]) == []


def test_broken_records_are_refused():
    good = warc.record_bytes(1, "u", b"body", "d", None)
    assert warc.parse_record(good)[1] == b"body"
    for bad in (good[:-2], b"HTTP/1.1 200\r\n\r\n", good.replace(b"body", b"bodyy")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# -- oracles and the pipeline ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).fetch_df()
    def rows(df):
        plain = [tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
        return sorted(repr(tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r)) for r in plain)

    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scan", "source mixing"]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf_dir).cache()
        before, after = [{x.doc_id: x.text for x in df.select("doc_id", "text").collect()} for df in (docs, out)]
        if i < 4:
            assert out.columns == columns
        if i == 0:
            scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
            assert set(after) == {x.doc_id for x in scored if x.predicted == 1}
        elif i == 1:
            assert set(after) == {x.doc_id for x in simhash.near_duplicates(docs).collect() if x.doc_id == x.component_id}
        elif i == 2:
            assert set(before) - set(after) == {x.doc_id for x in decontam_scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
        elif i == 3:
            live = {x.doc_id for x in secrets.scan(docs).collect() if x.n_live}
            assert {d for d in after if after[d] != before[d]} == live and all(secrets.MASK in after[d] for d in live)
        else:
            assert set(after) <= set(before) and out.columns == [*columns, "n_copies", "copy", "order_key"]
        docs = out


def plain_redaction(rows):
    """doc_id -> text with live secrets masked, by regular expressions and counts in memory."""
    import re

    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [("assign", assign, 1, 12), ("access", re.compile("AKIA[A-Z0-9]{14,}"), 0, 0), ("hex", re.compile("[0-9a-f]{16,}"), 0, 0), ("token", re.compile("[A-Za-z0-9+/_-]{24,}"), 0, 0)]
    held, seen = {}, {}
    for d, text, source in rows:
        for kind, pattern, group, least in kinds:
            for m in pattern.finditer(text):
                if len(v := m.group(group)) >= least:
                    held.setdefault(v, (set(), set()))[0].add(source)
                    held[v][1].add(d)
                    seen.setdefault(d, set()).add((kind, v))
    random_ = lambda v: len(v) >= 16 and len(set(v)) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)
    out = {}
    for d, text, _ in rows:
        live = {v for k, v in seen.get(d, ()) if len(held[v][0]) < 3 and not (len(held[v][1]) >= 100 and not random_(v)) and (k != "token" or random_(v))}
        for _, pattern, group, _ in kinds:
            text = pattern.sub(lambda m: m.group()[: len(m.group()) - len(m.group(group))] + secrets.MASK if m.group(group) in live else m.group(), text)  # noqa: B023
        out[d] = text
    return out


def test_pipeline_against_loops(spark, sf_dir):
    """All rows of the pipeline from loops over the documents: scores, all pairs, all windows, counts and draws."""
    from test_dedup import brute_components
    from test_scans import brute_contaminated

    from mirrorsift.llm import decontam

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {x.doc_id: x for x in docs.collect() if model.score(quality.features(x.text)[None])[0] >= quality.THRESHOLD}
    rows = {d: rows[d] for d, _, c in brute_components([(d, x.text) for d, x in rows.items()]) if d == c}
    tokens = lambda df, key: {x[0]: x[1].split() for x in df.select(key, decontam.canonical(F.col("text"))).collect()}
    items = tokens(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")
    kept = {d: t for d, t in tokens(docs, "doc_id").items() if d in rows}
    assert min(map(len, items.values())) >= 5
    dirty = {d for d, _ in brute_contaminated(kept, items)}
    rows = {d: x for d, x in rows.items() if d not in dirty}
    texts = plain_redaction([(d, x.text, x.source) for d, x in rows.items()])
    sizes = Counter(x.source for x in rows.values())
    whole = sum(math.sqrt(n) for n in sizes.values())
    want = Counter()
    for d, x in rows.items():
        rate = math.sqrt(sizes[x.source]) * len(rows) / whole / sizes[x.source]
        u, k, p = int(hashlib.md5(f"0:1:{d}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want.update((d, texts[d], x.lang, x.source, k, i) for i in range(1, k + 1))
    got = Counter((x.doc_id, x.text, x.lang, x.source, x.n_copies, x.copy) for x in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and dirty and len(want) > 50
