import hashlib
import unicodedata
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from mirrorsift.operators.components import union_find
from mirrorsift.plans import catalogue
from mirrorsift.plans.inputs import text_files
from mirrorsift.runtime import ARROW_CONF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", ["results_view", "export_results"])
def test_view_of_sizes_between_two_tenths(spark, tmp_path, name):
    rows = [(i, "x" * n, "en", f"s{i % 2}") for i, n in enumerate(n for n in (1280, 3328, 3840, 5427) for _ in range(2))]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).to_parquet(tmp_path / "documents.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetch_df()
    assert len(got) == 8 and canon(got) == canon(want)


def turns(sf_dir):
    c = pd.read_parquet(f"{sf_dir}/conversations.parquet").set_index(["conv_id", "turn"])["text"]
    return {k: (t, c[k[0], k[1] + 1]) for k, t in c.items() if (k[0], k[1] + 1) in c.index}


def plain_sampled(a, b):
    best = []
    for at in (0, len(a) // 4, len(a) // 2, 3 * len(a) // 4, max(0, len(a) - 500)):
        if at < len(a):
            best.append(max((SequenceMatcher(None, a[at : at + 500], b[i : i + 500]).ratio() for i in range(0, len(b), 250)), default=0.0))
    return sum(best) / len(best) * 100 if best else 0.0


def plain_score(a, b):
    a, b = (" ".join(t.lower().split()) if len(t) >= 10 else "" for t in (a, b))
    if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < 0.3:
        return 0.0
    return plain_sampled(a, b) if max(len(a), len(b)) > 1000 else SequenceMatcher(None, a, b).ratio() * 100


PAIR_SCORES = {"seq_ratio_pairs": lambda a, b: SequenceMatcher(None, a, b).ratio() * 100, "sampled_ratio_pairs": plain_sampled, "text_similarity_pairs": plain_score}


@pytest.mark.parametrize("name", sorted(PAIR_SCORES))
def test_pair_scores_against_loops(spark, sf_dir, name):
    got = {(x.conv_id, x.turn): x.similarity for x in catalogue.QUERIES[name](spark, sf_dir).collect()}
    pairs = turns(sf_dir)
    assert set(got) == set(pairs) and len(got) > 20
    for k, (a, b) in pairs.items():
        assert got[k] == pytest.approx(PAIR_SCORES[name](a, b), abs=1e-5), k


def test_details_against_loops(spark, sf_dir):
    got = {(x.conv_id, x.turn): x for x in catalogue.similarity_details(spark, sf_dir).collect()}
    for k, (a, b) in turns(sf_dir).items():
        assert got[k].sequence_similarity == pytest.approx(PAIR_SCORES["seq_ratio_pairs"](a, b), abs=1e-5)
        wa, wb = set(a.split()), set(b.split())
        assert got[k].vocabulary_similarity == pytest.approx(100 * len(wa & wb) / max(1, len(wa | wb)), abs=1e-5)


def test_normal_forms_against_loops(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id")["text"]
    got = {x.doc_id: x.normal_hash for x in catalogue.nfkc_normalize(spark, sf_dir).collect()}
    assert got == {d: hashlib.md5(" ".join(unicodedata.normalize("NFKC", t).split()).lower().encode()).hexdigest() for d, t in docs.items()}


@pytest.mark.parametrize("name", [*PAIR_SCORES, "similarity_details"])
def test_turns_are_matched_in_many_tasks(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["nfkc_normalize", "sampled_ratio_pairs", "detect_encoding"])
def test_batches_of_texts_are_bounded(spark, sf_dir, name):
    for key in ARROW_CONF:
        spark.conf.unset(key)
    catalogue.QUERIES[name](spark, sf_dir)
    assert {k: spark.conf.get(k) for k in ARROW_CONF} == ARROW_CONF


def near_pairs(files):
    """Pairs of different texts of like size whose normal forms score 80, by a loop over all pairs."""
    out = []
    runs = {p: {t[i : i + 6] for i in range(len(t) - 5)} for p, t, _ in files}
    for i, (p, t, n) in enumerate(files):
        for q, u, m in files[:i]:
            a, b = sorted(((p, t), (q, u)))
            if t != u and min(n, m) / max(n, m) >= 0.8 and len(runs[p] & runs[q]) >= 0.2 * min(len(runs[p]), len(runs[q])) and plain_score(a[1], b[1]) >= 80:
                out.append((a[0], b[0]))
    return out


def test_near_groups_against_loops(spark, sf_dir):
    rows = text_files(spark, sf_dir).select("path", "text", "size").collect()
    copies = {}
    for x in rows:
        copies.setdefault(x.text, []).append(x.path)
    # copies are one text, named by its first path
    firsts = [(min(ps), t, len(t.encode())) for t, ps in copies.items()]
    links = near_pairs(firsts) + [(min(ps), p) for ps in copies.values() for p in ps if p != min(ps)]
    got = {x.path: x.group_id for x in catalogue.near_dup_groups_intended(spark, sf_dir).collect()}
    assert got == union_find(*zip(*links))
    # outside the groups of copies
    alone = near_pairs([x for x in firsts if len(copies[x[1]]) == 1])
    merged = catalogue.merged_duplicates(spark, sf_dir).collect()
    assert {x.path: x.group_id for x in merged if x.match_type == "similar"} == (union_find(*zip(*alone)) if alone else {})
    assert {x.path for x in merged if x.match_type == "exact"} == {p for ps in copies.values() if len(ps) > 1 for p in ps}


def test_compat_groups_are_copies_and_pairs(spark, sf_dir):
    got = catalogue.near_dup_groups_compat(spark, sf_dir).collect()
    exact = {x.path: x.group_id for x in catalogue.exact_dup_prefix(spark, sf_dir).collect()}
    assert {x.path: x.group_id for x in got if x.match_type == "exact"} == exact
    assert all(x.similarity >= 80 and x.path not in exact for x in got if x.match_type == "similar")


def test_minhash_candidates_meet_near_pairs(spark, sf_dir):
    rows = [(x.path, x.text, x.size) for x in text_files(spark, sf_dir).select("path", "text", "size").collect()]
    got = catalogue.minhash_candidates(spark, sf_dir).collect()
    assert all(x.a < x.b for x in got)
    part = union_find(*zip(*[(x.a, x.b) for x in got]))
    near = near_pairs(rows)
    assert sum(part.get(a, a) == part.get(b, b) for a, b in near) >= 0.9 * len(near)


def test_no_query_is_unheld():
    """Queries without SQL are held to loops above."""
    above = {*PAIR_SCORES, "similarity_details", "nfkc_normalize", "near_dup_groups_intended", "near_dup_groups_compat", "merged_duplicates", "minhash_candidates"}
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == above


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["group_id", "path"]
