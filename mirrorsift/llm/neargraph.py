"""Embedding near-dedup on a robust-pruned flat graph.

Vectors with one label are dealt to overlapping cluster shards: each goes to its nearest centroid (home)
and, of the OVERLAP nearest, to those whose bisector with the home lies within half the link radius.  Two linked vectors
of different homes lie on either side of the bisector of these, and together no further from it than the
radius, so at least one of them is in the home shard of the other: that one's search finds the pair, and
counts it for both where only one can.  In each shard a flat graph is built: near candidates and a few far ones, robust
pruned (an edge to c is dropped where a kept neighbour p has ALPHA * d(p, c) <= d(x, c)), with reverse edges,
and parts out of the medoid's reach get an edge from their nearest node.  The adjacency lists of a vector
from all its shards are united.  Each vector then searches its home shard: greedy beam search from the
medoids, widened to every node that lies in range, and a self-audit that restarts where the search did not
find the query itself.  What was found is verified in double precision.

Equal vectors are one node with a multiplicity.  Shards larger than CHUNK are cut into chunks by hash and
every chunk of queries searches every chunk of the shard, so a task holds at most two chunks; links are
counted per query and each task returns a spanning forest of its links, never its pairs.

Centroids are fitted on at most SAMPLE vectors; every vector is indexed.  Shards that are still large are dealt
again among centroids of their own, each fitted on at most SAMPLE of the shard's vectors.  Only a pair that lies
past the OVERLAP nearest centroids of both can be missed.  audit() measures recall against
brute force for the vectors whose id is divisible by 100.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a
null label, link with nothing; vectors of different lengths do not link; a null vec_id gives a row with 0
links and a null component; rows with equal vec_id are one node that holds all their links; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.operators.components import connected_components, union_find
from mirrorsift.runtime import again, configure, stage

COSINE = 0.98
SAMPLE = 20_000
SHARD = 1000
CHUNK = 2000
#: Shards that a vector may be in, the nearest first; shards of over SPLIT * SHARD vectors are dealt anew among
#: centroids of their own, LEVELS deals in all, where the parts are smaller on average by a factor of WORTH.
OVERLAP, SPLIT, LEVELS, WORTH = 6, 4, 3, 2
DEGREE = 32
NEAR, FAR = 64, 16
ALPHA = 1.2
BEAM = 24
#: Queries of a task that walk at once, and (query, node) pairs of one expansion: they bound a task's memory.
QUERIES = 200
PAIRS = 100_000
#: In the search, nodes this much below the range are walked through as well.
SLACK = 0.1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# -- shards ----------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from spread-out starts; deterministic for the order of x."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (2 * x @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
        for c in range(k):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return np.unique(centres, axis=0)


def apart(centres: np.ndarray, radius: float) -> np.ndarray:
    """Centroids further than the radius from each other: those inside a ball of near copies become one.

    There every vector links to every other, so to deal them to many shards would only copy or lose links.
    """
    kept: list[int] = []
    for i in range(len(centres)):
        if not kept or np.linalg.norm(centres[kept] - centres[i], axis=1).min() > radius:
            kept.append(i)
    return centres[kept]


def shards_of(x: np.ndarray, centres: np.ndarray, margin: float | np.ndarray, most: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of unit vectors: the nearest centroid, and of the ``most`` nearest those whose bisector with it lies within the margin."""
    dist = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
    few = min(most, len(centres))
    near = np.argpartition(dist, few - 1, axis=1)[:, :few]
    own = np.take_along_axis(dist, near, axis=1)
    order = np.argsort(own, axis=1, kind="stable")
    near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
    apart = np.linalg.norm(centres[near] - centres[near[:, :1]], axis=2)
    inside = (own - own[:, :1]) / (2 * np.maximum(apart, 1e-150)) <= np.broadcast_to(margin, len(x))[:, None] + 1e-9
    inside[:, 0] = True
    row, at = np.nonzero(inside)
    return row, near[row, at], at == 0


# -- the graph of one chunk ------------------------------------------------------------------------


def prune(dist: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of every node's candidates at once; -1 fills short lists.  dist: all distances of the chunk."""
    n, width = candidates.shape
    rows = np.arange(n)[:, None]
    own = np.where(candidates >= 0, dist[rows, candidates], np.inf)
    order = np.argsort(own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(own, order, axis=1)
    alive = np.isfinite(own) & (candidates != rows)
    kept = np.full((n, degree), -1, dtype=np.int64)
    for slot in range(degree):
        first = alive.argmax(axis=1)
        some = alive[np.arange(n), first]
        if not some.any():
            break
        pick = np.where(some, candidates[np.arange(n), first], 0)
        kept[some, slot] = pick[some]
        alive[np.arange(n), first] = False
        alive &= ~((alpha * dist[pick[:, None], candidates] <= own) & some[:, None])
    return kept


def build(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Neighbour lists of unit vectors, -1 filled: pruned lists and their reverse edges."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1, dtype=np.int64)
    dist = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
    near = np.argpartition(dist, min(NEAR, n - 1), axis=1)[:, : NEAR + 1]
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    out = prune(dist, np.hstack([near, far]))
    # edges both ways, so that a node stays in reach of those that it is near to; where many point at one
    # node its list is long, but no longer than the chunk
    a, b = np.nonzero(out >= 0)[0], out[out >= 0]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.unique(src * n + dst)
    src, dst = pair // n, pair % n
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    wide = np.full((n, int(rank.max()) + 1), -1, dtype=np.int64)
    wide[src, rank] = dst
    return connect(wide, dist, medoid(x))


def reached(graph: np.ndarray, seen: np.ndarray, front: np.ndarray) -> None:
    """Mark what can be reached from front."""
    seen[front] = True
    while len(front):
        nodes = np.unique(graph[front])
        front = nodes[(nodes >= 0) & ~seen[nodes]]
        seen[front] = True


def connect(graph: np.ndarray, dist: np.ndarray, start: int) -> np.ndarray:
    """The graph with an edge to each part that pruning left out of reach of start, from the nearest node in reach."""
    seen = np.zeros(len(graph), dtype=bool)
    reached(graph, seen, np.array([start]))
    while not seen.all():
        out, inside = np.flatnonzero(~seen), np.flatnonzero(seen)
        near = dist[np.ix_(out, inside)]
        i, j = np.unravel_index(near.argmin(), near.shape)
        row = graph[inside[j]]
        if (row >= 0).all():
            graph = np.hstack([graph, np.full((len(graph), 1), -1, dtype=graph.dtype)])
            row = graph[inside[j]]
        row[(row < 0).argmax()] = out[i]
        reached(graph, seen, np.array([out[i]]))
    return graph


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, block: int = 20_000) -> np.ndarray:
    """Dot products of a[i] and b[j], a block of rows at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), block):
        s = slice(at, at + block)
        np.einsum("ij,ij->i", a[i[s]], b[j[s]], out=out[s])
    return out


def search(graph: np.ndarray, x: np.ndarray, starts: list[int], queries: np.ndarray, low: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the nodes found with cosine >= low: greedy beams from the starts, widened over the range.

    own: the node that is the query itself, or -1; where the search misses it, it starts there again.
    """
    n, m = len(x), len(queries)
    seen = np.zeros((m, n), dtype=bool)
    beam = np.full((m, BEAM), -1, dtype=np.int64)
    score = np.full((m, BEAM), -np.inf)
    open_ = np.zeros((m, BEAM), dtype=bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    reach = low - SLACK

    def visit(q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen nodes of the (q, list of nodes) pairs, with their cosines."""
        q, node = np.repeat(q, nodes.shape[1]), nodes.ravel()
        ok = node >= 0
        q, node = q[ok], node[ok]
        ok = ~seen[q, node]
        pair = np.unique(q[ok] * n + node[ok])
        q, node = pair // n, pair % n
        seen[q, node] = True
        sim = cosines(queries, q, x, node)
        inside = sim >= reach
        hits.append((q[inside], node[inside]))
        return q, node, sim

    def merge(q: np.ndarray, node: np.ndarray, sim: np.ndarray) -> None:
        """Put new nodes into the beams of their queries."""
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        width = int(rank.max()) + 1 if len(q) else 0
        if not width:
            return
        rows = np.unique(q)
        at = np.searchsorted(rows, q)
        new, val = np.full((len(rows), width), -1, dtype=np.int64), np.full((len(rows), width), -np.inf)
        new[at, rank], val[at, rank] = node, sim
        ids, vals, opens = np.hstack([beam[rows], new]), np.hstack([score[rows], val]), np.hstack([open_[rows], new >= 0])
        top = np.argsort(-vals, axis=1, kind="stable")[:, :BEAM]
        beam[rows], score[rows], open_[rows] = np.take_along_axis(ids, top, 1), np.take_along_axis(vals, top, 1), np.take_along_axis(opens, top, 1)

    merge(*visit(np.arange(m), np.tile(np.array(starts), (m, 1))))
    while True:
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            break
        best = np.where(open_[active], score[active], -np.inf).argmax(axis=1)
        open_[active, best] = False
        merge(*visit(active, graph[beam[active, best]]))
    missed = np.flatnonzero((own >= 0) & ~seen[np.arange(m), np.maximum(own, 0)])
    if len(missed):
        visit(missed, own[missed][:, None])
    # the range: every node found inside it is expanded until nothing new turns up
    done = 0
    while done < len(hits):
        q, node = (np.concatenate([h[i] for h in hits[done:]]) for i in (0, 1))
        done = len(hits)
        step = max(1, PAIRS // graph.shape[1])
        for at in range(0, len(q), step):
            visit(q[at : at + step], graph[node[at : at + step]])
    q, node = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
    exact = cosines(queries, q, x, node) >= low
    return q[exact], node[exact]


# -- the operator ----------------------------------------------------------------------------------


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else column, dtype=np.float64)


def _valid(vec: str, label: str):
    c = F.col(vec)
    finite = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def split_centres(x: np.ndarray, k: int, radius: float) -> np.ndarray | None:
    """About k centroids for a shard from a sample of it; None where they would not part it, as in a ball of near copies."""
    k = min(k, len(x) // 8)
    if k < 2:
        return None
    centres = apart(kmeans(x, k), radius)
    row, _, _ = shards_of(x, centres, radius / 2)
    return centres if len(row) * WORTH <= len(x) * len(centres) else None


def refine(dealt: DataFrame, radius: float) -> tuple[DataFrame, bool]:
    """The deal with each shard of over SPLIT * SHARD vectors dealt anew among centroids of its own, and whether any was.

    A vector that is at home in the shard goes to the parts within half the radius of its own, like in the first
    deal.  A guest goes to those within the whole radius: only the partner at home searches there.
    """
    sizes = stage(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT * SHARD), "large-shards", small=True)
    if sizes.isEmpty():
        return dealt, False
    large = dealt.join(sizes, "shard")
    share = F.least(F.lit(float(SAMPLE)), 8.0 * F.col("n") / SHARD) / F.col("n") * (1 << 30)
    some = large.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < share).select("shard", "n", "id", "vec")

    wanted = SHARD

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        centres = split_centres(unit(_matrix(pdf["vec"])), round(pdf["n"].iloc[0] / wanted), radius)
        rows = [] if centres is None else [(pdf["shard"].iloc[0], int(pdf["n"].iloc[0]), centres.tobytes(), len(centres))]
        return pd.DataFrame(rows, columns=["shard", "n", "centres", "k"])

    # a sample holds SAMPLE vectors of a shard at most, so a group is bounded
    fitted = stage(some.groupBy("shard").applyInPandas(fit, "shard string, n long, centres binary, k long"), "shard-centres")
    if fitted.isEmpty():
        return dealt, False
    salts = F.ceil(F.col("n") / SAMPLE).cast("int")
    rows = dealt.join(fitted.select("shard", salts.alias("salts")), "shard").withColumn("salt", F.pmod(F.xxhash64(F.lit(19), "id"), F.col("salts")).cast("int"))
    held = again(fitted).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def deal(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["grp", "vec", "id", "copies", "shard", "at_home"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        centres = np.frombuffer(right["centres"].iloc[0]).reshape(int(right["k"].iloc[0]), -1)
        home = (left["home"] == left["shard"]).to_numpy()
        row, part, first = shards_of(unit(_matrix(left["vec"])), centres, np.where(home, radius / 2, radius))
        out = left.iloc[row].assign(shard=[f"{key[0]}/{p}" for p in part], at_home=first & home[row])
        return out[names]

    kind = "grp string, vec array<double>, id long, copies long, shard string, at_home boolean"
    parted = rows.select("grp", "vec", "id", "copies", "shard", "home", "salt").groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInPandas(deal, kind)
    whole = dealt.join(again(fitted).select("shard"), "shard", "left_anti").select("grp", "vec", "id", "copies", "shard", (F.col("home") == F.col("shard")).alias("at_home"))
    member = stage(parted.unionByName(whole), "members")
    # a vector is in a bounded number of shards
    named = member.groupBy("id").agg(F.max(F.when(F.col("at_home"), F.col("shard"))).alias("home"), F.collect_set("shard").alias("shards"))
    return stage(member.drop("at_home").join(named, "id").select("grp", "vec", "id", "copies", "shard", "home", "shards"), "shards"), True


def _centroids(nodes: DataFrame, radius: float) -> dict[str, np.ndarray]:
    """Centroids by group (label and length) from a bounded sample taken by hash."""
    n = nodes.count()
    share = int((1 << 30) * min(1.0, SAMPLE / max(1, n)))
    some = nodes.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < share).select("grp", "id", "vec").limit(2 * SAMPLE).toPandas().sort_values("id")
    out = {}
    for grp, part in some.groupby("grp"):
        k = min(round(len(part) * n / max(1, len(some)) / SHARD), len(part) // 8)
        if k > 1:
            out[grp] = apart(kmeans(unit(_matrix(part["vec"])), k), radius)
    return out


def links(embeddings: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(nodes, found): nodes has id, copies, grp, vec; found has id, n (links counted at id) and root (of a spanning forest)."""
    configure(embeddings.sparkSession)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & _valid("vec", "label"))
    group = F.concat_ws(":", F.size("vec").cast("string"), "label")
    nodes = stage(rows.groupBy(group.alias("grp"), "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    centres = nodes.sparkSession.sparkContext.broadcast(_centroids(nodes, radius))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grp, part in pdf.groupby("grp"):
                c = centres.value.get(grp)
                if c is None:
                    row, shard, home = np.arange(len(part)), np.zeros(len(part), dtype=int), np.ones(len(part), dtype=bool)
                else:
                    row, shard, home = shards_of(unit(_matrix(part["vec"])), c, radius / 2)
                names = np.array([f"{grp}/{s}" for s in shard], dtype=object)
                every = np.split(names, np.searchsorted(row, np.arange(1, len(part))))
                yield part.iloc[row].assign(shard=names, home=names[home][row], shards=[every[r] for r in row])

    dealt = stage(nodes.mapInPandas(deal, "grp string, vec array<double>, id long, copies long, shard string, home string, shards array<string>"), "shards")
    for _ in range(LEVELS - 1):
        dealt, more = refine(dealt, radius)
        if not more:
            break
    sizes = stage(dealt.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "shard-sizes")
    member = dealt.join(sizes, "shard").withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("chunks")).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        graph = build(unit(_matrix(pdf["vec"])))
        return pd.DataFrame({"id": ids, "near": [ids[g[g >= 0]] for g in graph]})

    lists = member.select("shard", "chunk", "id", "vec").groupBy("shard", "chunk").applyInPandas(make, "id long, near array<long>")
    united = stage(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")

    def look(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        if not len(held) or not len(asked):
            return none
        held, asked = held.sort_values("id"), asked.sort_values("id")
        ids, copies, homes, x = held["id"].to_numpy(), held["copies"].to_numpy(), held["home"].to_numpy(), unit(_matrix(held["vec"]))
        shard, times, mine = key[0], asked["copies"].to_numpy(), asked["shards"].tolist()
        near = [np.asarray(v, dtype=np.int64) for v in held["near"]]
        flat, row = np.concatenate(near), np.repeat(np.arange(len(ids)), [len(v) for v in near])
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat
        at, row = at[here], row[here]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        graph = np.full((len(ids), int(rank.max()) + 1 if len(rank) else 1), -1, dtype=np.int64)
        graph[row, rank] = at
        qid, queries = asked["id"].to_numpy(), unit(_matrix(asked["vec"]))
        own = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
        own = np.where(ids[own] == qid, own, -1)
        count, a, b = np.zeros(len(qid), dtype=np.int64), [], []
        other_side: dict[int, int] = {}
        for i in range(0, len(qid), QUERIES):
            q, node = search(graph, x, [medoid(x)], queries[i : i + QUERIES], cosine, own[i : i + QUERIES])
            other = ids[node] != qid[i + q]
            q, node = q[other] + i, node[other]
            np.add.at(count, q, copies[node])
            # a partner at home elsewhere finds the query only if the query is in that shard too
            for i_q, i_node in zip(*(v[homes[node] != shard].tolist() for v in (q, node)), strict=True):
                if homes[i_node] not in mine[i_q]:
                    other_side[int(ids[i_node])] = other_side.get(int(ids[i_node]), 0) + int(times[i_q])
            # links to the query's smallest partner span what all of its links join
            a += qid[q].tolist()
            b += ids[node].tolist()
            roots = union_find(a, b)
            a, b = list(roots.keys()), list(roots.values())
        counted = dict(zip(qid.tolist(), count.tolist(), strict=True))
        for i, n in other_side.items():
            counted[i] = counted.get(i, 0) + n
        rooted = dict(zip(a, b, strict=True))
        every = sorted({*(i for i, n in counted.items() if n), *rooted})
        return pd.DataFrame({"id": every, "n": [counted.get(i, 0) for i in every], "root": [rooted.get(i, i) for i in every]}).astype("int64")

    chunks = again(sizes).withColumnRenamed("chunks", "asked_chunks")
    held = member.join(united, "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = again(dealt).where("home = shard").join(chunks, "shard").withColumn("part", F.pmod(F.xxhash64(F.lit(13), "id"), F.col("asked_chunks")).cast("int"))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("asked_chunks") - 1)))
    left = held.select("shard", "chunk", "part", "id", "copies", "home", "vec", "near").groupBy("shard", "chunk", "part")
    right = asked.select("shard", "chunk", "part", "id", "copies", "shards", "vec").groupBy("shard", "chunk", "part")
    return nodes, stage(left.cogroup(right).applyInPandas(look, "id long, n long, root long"), "found")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for every row of embeddings."""
    nodes, found = links(embeddings, cosine, id_col, vec_col, label_col)
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    # rows meet their node by 128 bits of the vector, so vectors do not travel again; zeros have one sign
    plain = lambda c: F.transform(c, lambda x: x.cast("double") + F.lit(0.0))
    bits = lambda c: (F.xxhash64(F.lit(0), plain(c)).alias("h0"), F.xxhash64(F.lit(1), plain(c)).alias("h1"))
    node = nodes.select("grp", *bits("vec"), "id", "copies").join(counts, "id", "left").join(parts.toDF("id", "component"), "id", "left")
    node = node.select("grp", "h0", "h1", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component"))
    group = F.when(_valid(vec_col, label_col), F.concat_ws(":", F.size(vec_col).cast("string"), F.col(label_col).cast("string")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), group.alias("grp"), *bits(vec_col))
    both = rows.join(stage(node, "judged"), ["grp", "h0", "h1"], "left")
    own = F.coalesce("component", "vec_id")
    links_ = F.when(F.col("vec_id").isNull() | F.col("n").isNull(), F.lit(0)).otherwise(F.col("n") + F.col("copies") - 1).cast("long")
    return both.select("vec_id", links_.alias("n_links"), F.when(F.col("vec_id").isNotNull(), own).alias("component_id"), (F.col("vec_id") == own).alias("kept"))


def audit(embeddings: DataFrame, result: DataFrame, cosine: float = COSINE, block: int = 2000) -> tuple[int, int]:
    """(links found, links there are) at the vectors whose id is divisible by 100, against all rows, in blocks."""
    rows = embeddings.where(_valid("embedding", "label")).select("vec_id", F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string")).alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("asked"))
    asked = rows.where("asked").select("label", F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))

    def count(key, held: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(q):
            return pd.DataFrame({"q": [], "n": []}).astype("int64")
        a, b = unit(_matrix(q["qv"])), unit(_matrix(held["embedding"]))
        n = sum(((a @ b[i : i + block].T) >= cosine).sum(axis=1) for i in range(0, len(b), block))
        return pd.DataFrame({"q": q["q"], "n": n}).astype("int64")

    held = rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    spread = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")))
    there = held.groupBy("label", "b").cogroup(spread.groupBy("label", "b")).applyInPandas(count, "q long, n long").groupBy("q").agg((F.sum("n") - 1).alias("n"))
    both = there.join(result.select(F.col("vec_id").alias("q"), "n_links"), "q").agg(F.sum(F.least("n_links", "n")), F.sum("n")).first()
    return int(both[0] or 0), int(both[1] or 0)


#: The result in DuckDB: all pairs within a label, components by a recursive walk.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
walk AS (SELECT a AS node, a AS reached FROM pair UNION SELECT w.node, p.b FROM walk w JOIN pair p ON p.a = w.reached),
part AS (SELECT node, min(reached) AS component FROM walk GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component, e.vec_id) AS component_id, e.vec_id = coalesce(component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN part ON node = vec_id LEFT JOIN deg ON deg.a = vec_id
"""
