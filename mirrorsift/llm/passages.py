"""Exact substring dedup over words by level-wise doubling.

A window repeated at one length is the only candidate for a repeat at up to twice that length.  Lengths
double from a short one to the wanted one (7, 13 for 13 words).  At the first level a window is stood for
by its minimizer, the smallest hash of a run of 7 words in it, so that about a quarter of the positions
take part.  Each level counts its windows' hashes over all documents, pre-aggregated per block of
documents, and leaves a bit map of the hashes that occur in two documents.  Bits shared by chance only
let more windows through to the last level, which is exact on 96 bits of each whole window, from 96 bits of
each word: there each repeated window gets its smallest doc_id, and later documents lose the words that it
covers.  At 10**13 windows two different ones agree by chance with a probability under 0.001.  The doubling
ends early when no candidate survives a level.

What is gathered is bounded: a bucket of hashes is sized by the input (``bucket_bytes``) and every block
sends a hash to it once; occurrences of the last level meet by bucket, and where a bucket is hot by (bucket,
salt), after the first documents of its windows were found with combining; documents meet their windows by
group, and a group that is large by (group, salt); the bit map has at most 2**MAX_FILTER_BITS bits, and a
fuller one prunes less but changes no result.

Defined results: null text has no words; rows without a doc_id neither remove nor lose words; rows with
equal doc_id are one document, judged row by row; extra columns are dropped; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.llm.words import encoded, word_blocks
from mirrorsift.runtime import again, configure, spread, stage, unstage

MAX_FILTER_BITS = 31
#: Words of a block of documents that is hashed and pre-aggregated at once.
BLOCK_WORDS = 1 << 21
#: Text bytes that stand behind one bucket of hashes or one group of documents.
BUCKET_BYTES = 16 << 20
#: Occurrences of repeated windows that one task of the last level may take.
SALT_ROWS = 1 << 21
#: Shares of BUCKET_BYTES that one group of documents may hold before it is split.
SPLIT = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The primes of XXH64.
XXH_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


class Vocabulary(dict):
    """An index for each word, and for each index 64 and 32 bits of a hash of the word; forgotten when there are too many."""

    def __init__(self):
        super().__init__()
        self.first, self.second = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.uint32)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.first):
            self.first, self.second = np.resize(self.first, 2 * at), np.resize(self.second, 2 * at)
        value = xxhash.xxh3_128_intdigest(word)
        self.first[at], self.second[at] = value & 0xFFFFFFFFFFFFFFFF, value >> 96
        self[word] = at
        return at

    def __call__(self, data: bytes) -> np.ndarray:
        """The indices of a text's words; they hold until the next call."""
        if len(self) > 1 << 20:
            self.clear()
        parts = [np.fromiter(map(self.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in word_blocks(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window of ``length`` words from each position; fewer than len(ids) of them."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        h *= _ODD
        h += ids[j : j + n]
    return mix(h)


def checks(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """32 bits more of the window at each of some positions."""
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(length):
        h *= _ODD
        h += ids[at + j]
    return (mix(h) >> np.uint64(32)).astype(np.uint32)


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` consecutive values from each position."""
    n = len(h) - width + 1
    out = h[:n].copy() if n > 0 else np.zeros(0, dtype=np.uint64)
    for j in range(1, width):
        np.minimum(out, h[j : j + n], out=out)
    return out


def doubling(length: int, start: int = 7) -> list[int]:
    """Window lengths from about ``start`` to ``length``, each at most twice the one before."""
    lengths = [length]
    while lengths[0] > 2 * (start - 1):
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths if len(lengths) > 1 else [max(1, (length + 1) // 2), length]


class Filter:
    """A bit per prefix of a hash."""

    def __init__(self, bits: int, data: bytes):
        self.shift, self.data = np.uint64(64 - bits), np.frombuffer(data, dtype=np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def level_windows(ids: np.ndarray, left: np.ndarray, lengths: list[int], filters: list[Filter]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the windows that take part at level len(filters).

    left: the words from each position to the end of its document.  At level 0 a key is that of the
    minimizer of a window of lengths[1] words, later that of the window of lengths[level] itself.
    """
    first, second = lengths[0], lengths[1]
    least = smallest(rolled(ids, first), second - first + 1)
    alive = left[: len(least)] >= second
    keys = mix(least ^ _ODD)
    if not filters:
        at = np.flatnonzero(alive)
        if len(at):
            at = at[np.concatenate([[True], (keys[at[1:]] != keys[at[:-1]]) | (np.diff(at) > 1)])]
        return at, keys[at]
    alive &= filters[0](keys)
    for level, passes in enumerate(filters[1:], 1):
        own = rolled(ids, lengths[level])
        ok = np.zeros(len(ids), dtype=bool)
        ok[: len(own)] = passes(own)
        step = lengths[level + 1] - lengths[level]
        grown = np.zeros(len(ids), dtype=bool)
        grown[: len(alive)] = alive
        grown &= ok & (left >= lengths[level + 1])
        grown[: len(ids) - step] &= ok[step:]
        alive = grown
    at = np.flatnonzero(alive)
    own = rolled(ids, lengths[len(filters)])
    return at, own[at]


class Block(NamedTuple):
    """Words of documents one after the other: ids, more bits of them, words left in the document, its doc_id, its text's hash, place in it."""

    ids: np.ndarray
    more: np.ndarray
    left: np.ndarray
    owner: np.ndarray
    row: np.ndarray
    place: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[Block]:
    """Blocks of documents; longer documents come in pieces that overlap."""
    known, held, n = Vocabulary(), [], 0

    def made() -> Block:
        sizes = [len(x[0]) for x in held]
        each = lambda i, t: np.repeat(np.array([x[i] for x in held], dtype=t), sizes)
        left = np.concatenate([np.arange(k, 0, -1) for k in sizes])
        place = np.concatenate([np.arange(x[4], x[4] + k, dtype=np.uint32) for x, k in zip(held, sizes, strict=True)])
        return Block(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), left, each(2, np.int64), each(3, np.uint64), place)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if doc is None:
                continue
            data = encoded(text.as_py())
            index = known(data)
            row, first, second = xxhash.xxh64_intdigest(data), known.first[index], known.second[index]
            for at in range(0, max(1, len(index) - overlap), BLOCK_WORDS):
                piece = slice(at, at + BLOCK_WORDS + overlap)
                held.append((first[piece], second[piece], doc, row, at))
                n += len(first[piece])
                if n >= BLOCK_WORDS:
                    yield made()
                    held, n = [], 0
    if n:
        yield made()


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of equal leading bits in sorted keys."""
    if len(keys):
        top = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]]).tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield int(top[i]), slice(i, j)


def merged(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the smallest of low and the largest of high."""
    if not len(keys):
        return keys, low, high
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[cuts], np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)


def merged_pairs(keys: np.ndarray, more: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """merged() for keys of two words."""
    if not len(keys):
        return keys, more, low, high
    order = np.lexsort((more, keys))
    keys, more, low, high = keys[order], more[order], low[order], high[order]
    cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (more[1:] != more[:-1])) + 1])
    return keys[cuts], more[cuts], np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)


def find_pairs(keys: np.ndarray, more: np.ndarray, have: np.ndarray, also: np.ndarray) -> np.ndarray:
    """Where each (have, also) stands among the sorted (keys, more), or -1."""
    out = np.full(len(have), -1, dtype=np.int64)
    at = np.searchsorted(keys, have)
    todo = np.arange(len(have))
    while len(todo):  # one turn, and another only where two windows share their first word
        todo = todo[at[todo] < len(keys)]
        todo = todo[keys[at[todo]] == have[todo]]
        hit = more[at[todo]] == also[todo]
        out[todo[hit]] = at[todo[hit]]
        todo = todo[~hit]
        at[todo] += 1
    return out


def _joined(cells, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=dtype)


def flags(pdf: pd.DataFrame) -> np.ndarray:
    """1 for each key that a block saw in two documents: added to the first, that counts as another end."""
    return np.concatenate([np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(k) // 8) for m, k in zip(pdf["many"], pdf["keys"], strict=True)]).astype(np.int64)


class Sizes:
    """Numbers of buckets and filter bits for an input of so many bytes of text."""

    def __init__(self, total: int, bucket_bytes: int = BUCKET_BYTES):
        self.bits = min(22, max(3, math.ceil(math.log2(max(1, total / bucket_bytes)))))
        self.filter_bits = min(MAX_FILTER_BITS, max(self.bits + 3, 16, math.ceil(math.log2(max(1, total / 8)))))
        self.groups = 1 << self.bits


def _level_filter(docs: DataFrame, lengths: list[int], filters, sizes: Sizes) -> tuple[bytes, int]:
    """The bit map of the keys that occur in two documents at level len(filters), and how many they are."""
    bits, filter_bits = sizes.bits, sizes.filter_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [Filter(filter_bits, x.value) for x in filters]
        for b in blocks(batches, max(lengths) - 1):
            at, keys = level_windows(b.ids, b.left, lengths, passes)
            keys, low, high = merged(keys, b.owner[at], b.owner[at])
            for bucket, s in by_bucket(keys, bits):
                many = np.packbits(low[s] != high[s]).tobytes()
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "keys": [keys[s].tobytes()], "low": [low[s].tobytes()], "many": [many]})

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, low = _joined(pdf["keys"], np.uint64), _joined(pdf["low"], np.int64)
        keys, first, last = merged(keys, low, low + flags(pdf))
        keys = keys[first != last]
        own = np.zeros(1 << (filter_bits - bits), dtype=np.uint8)
        own[(keys >> np.uint64(64 - filter_bits)) & np.uint64(len(own) - 1)] = 1
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "part": [np.packbits(own, bitorder="little").tobytes()], "n": [len(keys)]})

    counted = docs.mapInArrow(count, "bucket long, keys binary, low binary, many binary")
    parts = counted.groupBy("bucket").applyInPandas(repeated, "bucket long, part binary, n long")
    wide = 1 << (filter_bits - bits - 3)
    whole, n = bytearray(wide << bits), 0
    for row in parts.toLocalIterator():  # slices of one bit map of bounded size
        whole[row["bucket"] * wide : (row["bucket"] + 1) * wide] = row["part"]
        n += row["n"]
    return bytes(whole), n


def repeats(docs: DataFrame, length: int = 13, start: int = 7, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame | None, Sizes]:
    """(grp, docs, rows, places): blobs of the places of windows that also start in a document with a smaller doc_id.

    docs has doc_id and text.  rows are hashes of texts, which tell rows of one doc_id apart.  None where no
    candidate survives.  grp deals documents over Sizes.groups.
    """
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    sizes, lengths, filters = Sizes(total, bucket_bytes), doubling(length, start), []
    for _ in lengths[:-1]:
        found, n = _level_filter(docs, lengths, filters, sizes)
        if not n:
            return None, sizes
        filters.append(spark.sparkContext.broadcast(found))
    bits, filter_bits, groups = sizes.bits, sizes.filter_bits, sizes.groups

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [Filter(filter_bits, x.value) for x in filters]
        for b in blocks(batches, length - 1):
            at, keys = level_windows(b.ids, b.left, lengths, passes)
            # by bucket, and in it as the words stand, so that documents are runs
            order = np.argsort(keys >> np.uint64(64 - bits), kind="stable")
            at, keys = at[order], keys[order]
            columns = {"keys": keys, "more": checks(b.more, at, length), "docs": b.owner[at], "rows": b.row[at], "places": b.place[at]}
            for bucket, s in by_bucket(keys, bits):
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], **{c: [v[s].tobytes()] for c, v in columns.items()}})

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                owner = np.frombuffer(row["docs"], dtype=np.int64)
                keys, more, low, high = merged_pairs(np.frombuffer(row["keys"], dtype=np.uint64), np.frombuffer(row["more"], dtype=np.uint32), owner, owner)
                yield pa.RecordBatch.from_pydict({"bucket": [row["bucket"]], "keys": [keys.tobytes()], "more": [more.tobytes()], "low": [low.tobytes()], "many": [np.packbits(low != high).tobytes()], "n": [len(owner)]})

    def first_docs(pdf: pd.DataFrame) -> pd.DataFrame:
        first = _joined(pdf["low"], np.int64)
        keys, more, low, high = merged_pairs(_joined(pdf["keys"], np.uint64), _joined(pdf["more"], np.uint32), first, first + flags(pdf))
        two = low != high
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "keys": [keys[two].tobytes()], "more": [more[two].tobytes()], "low": [low[two].tobytes()], "salts": [1 + int(pdf["n"].sum()) // SALT_ROWS]})

    def placed(held: pd.DataFrame, keys: np.ndarray, more: np.ndarray, low: np.ndarray) -> pd.DataFrame:
        """The occurrences of known windows in documents after their first, by group of documents."""
        owner = _joined(held["docs"], np.int64)
        at = find_pairs(keys, more, _joined(held["keys"], np.uint64), _joined(held["more"], np.uint32))
        take = at >= 0
        take[take] = low[at[take]] < owner[take]
        owner, row, place = owner[take], _joined(held["rows"], np.uint64)[take], _joined(held["places"], np.uint32)[take]
        grp = group_of(owner, groups)
        order = np.lexsort((place, row, owner, grp))
        owner, row, place, grp = owner[order], row[order], place[order], grp[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]]).tolist() if len(grp) else []
        out = [(int(grp[i]), owner[i:j].tobytes(), row[i:j].tobytes(), place[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame(out, columns=["grp", "docs", "rows", "places"])

    def whole(held: pd.DataFrame) -> pd.DataFrame:
        owner = _joined(held["docs"], np.int64)
        keys, more, low, high = merged_pairs(_joined(held["keys"], np.uint64), _joined(held["more"], np.uint32), owner, owner)
        two = low != high
        return placed(held, keys[two], more[two], low[two])

    def later(key, held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(held):
            return pd.DataFrame([], columns=["grp", "docs", "rows", "places"])
        return placed(held, *(np.frombuffer(known[c].iloc[0], dtype=t) for c, t in (("keys", np.uint64), ("more", np.uint32), ("low", np.int64))))

    blobs = "keys binary, more binary, docs binary, rows binary, places binary"
    held = stage(docs.mapInArrow(occurrences, f"bucket long, {blobs}"), "occurrences")
    counts = held.groupBy("bucket").agg((F.sum(F.octet_length("keys")) / 8).cast("long").alias("n"))
    hot = stage(counts.where(F.col("n") > SALT_ROWS).select("bucket"), "hot-buckets", small=True)
    result = "grp long, docs binary, rows binary, places binary"
    if hot.isEmpty():
        out = stage(held.groupBy("bucket").applyInPandas(whole, result), "later")
        unstage(held)
        return out, sizes
    # a hot bucket is too much for a task: its windows' first documents are found with combining, and its occurrences
    # meet them in as many parts as it takes
    plain = held.join(hot, "bucket", "left_anti").groupBy("bucket").applyInPandas(whole, result)
    large = held.join(again(hot), "bucket", "left_semi")
    known = large.select("bucket", "keys", "more", "docs").mapInArrow(reduced, "bucket long, keys binary, more binary, low binary, many binary, n long")
    known = stage(known.groupBy("bucket").applyInPandas(first_docs, "bucket long, keys binary, more binary, low binary, salts long"), "first-docs")
    salted = large.join(again(known).select("bucket", "salts"), "bucket").withColumn("salt", F.pmod(F.xxhash64("docs"), "salts"))
    spread_out = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    pairs = salted.groupBy("bucket", "salt").cogroup(spread_out.groupBy("bucket", "salt"))
    out = stage(plain.unionByName(pairs.applyInPandas(later, result)), "later")
    unstage(held)
    unstage(known)
    return out, sizes


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """pmod(xxhash64(doc), groups) of longs, as Spark's function has it."""
    rotated = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in XXH_PRIMES)
    with np.errstate(over="ignore"):
        h = rotated(doc.view(np.uint64) * p2, 31) * p1
        h = rotated((np.uint64(42) + p5 + np.uint64(8)) ^ h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), groups)


def covered(places: np.ndarray, length: int) -> np.ndarray:
    """Which words, up to the last such, lie in a window that starts at one of the places."""
    if not len(places):
        return np.zeros(0, dtype=bool)
    edge = np.zeros(int(places.max()) + length + 1, dtype=np.int32)
    np.add.at(edge, places.astype(np.int64), 1)
    np.subtract.at(edge, places.astype(np.int64) + length, 1)
    return np.cumsum(edge[:-1]) > 0


def kept_words(data: bytes, places: np.ndarray, length: int) -> tuple[int, int, str]:
    """(words, words removed, SHA-256 of the words kept)."""
    digest, at, n_kept = hashlib.sha256(), 0, 0
    gone = covered(places, length)
    for words in word_blocks(data):
        some = gone[at : at + len(words)].tolist()
        kept = [w for w, g in zip(words, some, strict=False) if not g] + words[len(some) :] if some else words
        if kept:
            digest.update((b" " if n_kept else b"") + b" ".join(kept))
        at += len(words)
        n_kept += len(kept)
    return at, at - n_kept, digest.hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, start: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    configure(docs.sparkSession)
    own = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    found, sizes = repeats(own, length, start, bucket_bytes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    none = np.zeros(0, dtype=np.uint32)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def table(rows) -> dict:
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {x: [] for x in names}

    types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *kept_words(encoded(t.as_py()), none, length)) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_pydict(table(rows), schema=types)

    if found is None:
        return own.mapInArrow(plain, schema)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, row, place = (_joined(right.column(c).to_pylist(), t) for c, t in (("docs", np.int64), ("rows", np.uint64), ("places", np.uint32)))
        order = np.argsort(owner, kind="stable")
        owner, row, place = owner[order], row[order], place[order]
        rows = []
        for d, t in zip(left.column("doc_id").to_pylist(), left.column("text"), strict=True):
            data = encoded(t.as_py())
            mine = slice(np.searchsorted(owner, d), np.searchsorted(owner, d, side="right"))
            places = place[mine]
            rows.append((d, *kept_words(data, places[row[mine] == xxhash.xxh64_intdigest(data)] if len(places) else none, length)))
        return pa.Table.from_pydict(table(rows), schema=types)

    # a group that repeated ids make large is split by where its rows were read, and its windows are sent to each part
    dealt = own.where("doc_id is not null").withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(sizes.groups)))
    weights = dealt.groupBy("grp").agg(F.sum(F.octet_length("text")).alias("n")).select("grp", (1 + F.floor(F.coalesce("n", F.lit(0)) / (SPLIT * bucket_bytes))).alias("salts"))
    weights = stage(weights, "group-weights", small=True)
    salted = dealt.join(weights, "grp").withColumn("salt", F.pmod(F.spark_partition_id(), F.col("salts")))
    windows = found.join(again(weights), "grp").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    met = salted.select("grp", "salt", "doc_id", "text").groupBy("grp", "salt").cogroup(windows.select("grp", "salt", "docs", "rows", "places").groupBy("grp", "salt")).applyInArrow(apply, schema)
    # rows without an id lose nothing and meet nothing
    return met.union(own.where("doc_id is null").mapInArrow(plain, schema))


#: The result in DuckDB: windows as text, the smallest doc_id of each, and the words that none of a smaller doc_id covers.
ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM v GROUP BY win),
gone AS (SELECT DISTINCT v.doc_id, unnest(range(i, i + 13)) AS i FROM v JOIN f ON v.win = f.win WHERE first < v.doc_id),
one AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
