"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Each segment is decoded by the perfect
binary Golay code [23, 12, 7]: every word lies within 3 bits of exactly one codeword.  If two segments
differ in at most one bit, the codeword of either lies within 4 bits of the other, so it is among the
other's keys: its own codeword and, where that is 3 bits away, the five codewords at 4 bits.  With at
most 4 errors over three segments, either two segments have at most one error each (a pair of Golay keys,
24 bits, finds them) or one segment has none and the others two each (an exact segment key finds them).
Candidates are joined on these keys and verified on all 64 bits.

Defined results: null and blank texts have fingerprint zero and link like any other; rows with equal
doc_id are one document, so all their fingerprints are linked; rows without a doc_id link by their texts
alone and take the smallest doc_id that these reach, or null; extra columns are dropped; an empty table
gives an empty result.  Texts of any length are read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.llm.words import encoded, word_blocks
from mirrorsift.operators.components import connected_components
from mirrorsift.runtime import configure, fewer, spread, stage

#: The generator polynomial of the Golay code, and the segments as (shift, bits).
GOLAY_POLY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
LEADERS = 4


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of each run of k words joined by one space."""
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], seed) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """A bit is 1 where it is set in over half of the shingles' hashes; 0 for a text without words."""
    counts, n, carry = np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks(encoded(text).lower()):
        words = carry + words
        if len(words) >= k:
            found = shingle_hashes(words, k, seed)
            counts += bit_counts(found)
            n += len(found)
            carry = words[len(words) - k + 1 :]
        else:
            carry = words
    if n == 0:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), seed)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), k, seed) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(source).mapInArrow(run, "doc_id long, fp long")


# -- the code --------------------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY_POLY << (i - 11)
    return word


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by byte of the word; nearest error by syndrome; the five errors of weight 4 by syndrome, or -1."""
    unit = [_remainder(1 << i) for i in range(23)]
    by_byte = np.zeros((3, 256), dtype=np.int32)
    for part in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * part + bit < 23:
                    by_byte[part, value] ^= unit[8 * part + bit]
    nearest = np.zeros(2048, dtype=np.int32)
    second = np.full((2048, 5), -1, dtype=np.int32)
    filled = np.zeros(2048, dtype=np.int32)
    for weight in range(1, 5):
        for bits in combinations(range(23), weight):
            syndrome = error = 0
            for i in bits:
                syndrome ^= unit[i]
                error |= 1 << i
            if weight <= 3:
                nearest[syndrome] = error
            else:
                second[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return by_byte, nearest, second


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codeword index of each segment value, and all its keys as (row, index) arrays."""
    by_byte, nearest, second = golay()
    word = segment.astype(np.int32)
    syndrome = by_byte[0, word & 255] ^ by_byte[1, word >> 8 & 255] ^ by_byte[2, word >> 16]
    own = (word ^ nearest[syndrome]) >> 11
    more = second[syndrome]
    row, col = np.nonzero(more >= 0)
    keys = np.concatenate([own, (word[row] ^ more[row, col]) >> 11])
    return own, np.concatenate([np.arange(len(word)), row]), keys


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in SEGMENTS]


def _key(scheme: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (np.int64(scheme) << 44) | (high.astype(np.int64) << 22) | low.astype(np.int64)


def probe_keys(fp: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): side 0 spreads the first segment of each pair over its keys, side 1 the second."""
    parts = segments(fp)
    coded = [codewords(p) for p in parts]
    rows, keys = [], []
    for scheme, (a, b) in enumerate(PAIRS):
        if side == 0:
            _, row, spread = coded[a]
            keys.append(_key(scheme, spread, coded[b][0][row]))
        else:
            _, row, spread = coded[b]
            keys.append(_key(scheme, coded[a][0][row], spread))
        rows.append(row)
    for scheme, part in enumerate(parts):
        rows.append(np.arange(len(fp)))
        keys.append(_key(3 + scheme, np.zeros(len(fp), dtype=np.int64), part))
    return np.concatenate(rows), np.concatenate(keys)


def leader_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) by the two nearest codewords of each pair of segments: one key a pair."""
    own = [codewords(p)[0] for p in segments(fp)]
    row = np.arange(len(fp))
    return np.tile(row, 3), np.concatenate([_key(s, own[a], own[b]) for s, (a, b) in enumerate(PAIRS)])


def _spread(rows: DataFrame, make, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fp = np.asarray(part.column(0)).view(np.uint64)
                row, key = make(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key)] + [c.take(pa.array(row)) for c in part.columns], names=["key", *columns])

    return rows.select(*columns).mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in columns))


# -- links -----------------------------------------------------------------------------------------


def _near(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def leader_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links of fingerprints to a few leaders of each coarse bucket: at most LEADERS rows a key, however hot it is."""
    keyed = _spread(fps, leader_keys, ["fp"])
    firsts = keyed.groupBy("key").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "fp").alias("o"), F.col("fp").alias("id"))).alias(f"l{i}") for i in range(LEADERS)))
    firsts = firsts.select("key", F.array_distinct(F.array(*(F.col(f"l{i}.id") for i in range(LEADERS)))).alias("leaders"))
    near = F.filter("leaders", lambda x: (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= bits) & (x != F.col("fp")))
    # one link a key and fingerprint is enough: two leaders of one fingerprint are joined through it below
    return keyed.join(firsts, "key").select("fp", near.alias("near")).where(F.size("near") > 0).select(F.col("fp").alias("a"), F.explode("near").alias("b")).distinct()


def fingerprint_components(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(node, component) over distinct fingerprints (column fp) linked at ``bits`` or fewer differing bits, bits <= 4.

    Groups of near copies are first joined to leaders (a row each); the Golay join then returns only links
    between fingerprints that are still apart, so a large group never makes its pairs.
    """
    if bits > 4:
        raise ValueError("the keys guarantee links of at most 4 differing bits")
    lead = stage(fewer(leader_links(fps, bits)), "leaders")
    joined = connected_components(lead)
    known = stage(fps.join(joined.toDF("fp", "comp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp")), "known")
    left = _spread(known, lambda x: probe_keys(x, 0), ["fp", "comp"]).toDF("key", "a", "ca")
    right = _spread(known, lambda x: probe_keys(x, 1), ["fp", "comp"]).toDF("key", "b", "cb")
    links = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near("a", "b", bits))
    return connected_components(links.select("a", "b").union(lead))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stage(fingerprints(docs, id_col, text_col), "prints")
    firsts = stage(fewer(prints.groupBy("fp").agg(F.min("doc_id").alias("first"))), "firsts")
    # rows that share a doc_id are one document: all their fingerprints are linked, whatever their distance
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    same = prints.select("doc_id", F.col("fp").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct()
    parts = fingerprint_components(firsts.select("fp"), bits)
    parts = connected_components_with(parts, same)
    labelled = firsts.join(parts.toDF("fp", "part"), "fp", "left").select("fp", "first", F.coalesce("part", "fp").alias("part"))
    least = labelled.groupBy("part").agg(F.min("first").alias("component_id"))
    # a large group is a hot key of this join, so its pieces are dealt anew, not joined, to write few files
    by_print = stage(labelled.join(least, "part").select("fp", "component_id").repartition(docs.sparkSession.sparkContext.defaultParallelism), "by-print")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def connected_components_with(parts: DataFrame, extra: DataFrame) -> DataFrame:
    """parts refined by the few extra links; parts as it is where there are none."""
    extra = stage(fewer(extra), "same")
    if extra.isEmpty():
        return parts
    return connected_components(parts.toDF("a", "b").union(extra))


def keep_one(docs: DataFrame, bits: int = 4) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; rows without a doc_id stay."""
    later = near_duplicates(docs, bits=bits).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(stage(fewer(later), "later"), "doc_id", "left_anti").select(*docs.columns)
