"""Columns over whole texts: counts, hashes, line features, normal forms and set similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newline_normal(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(text: Column, prefix_chars: int | None = None) -> Column:
    """MD5 of the text, or of its first characters; line ends are made equal for a prefix."""
    return F.md5(text) if prefix_chars is None else F.md5(F.substring(newline_normal(text), 1, prefix_chars))


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def line_count(text: Column) -> Column:
    """Newlines plus one; 0 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column, limit: int | None = None, least: int = 10) -> Column:
    """Lower case, single spaces, no outer space, of the whole text or its first ``limit`` characters; null for texts of under ``least``."""
    some = text if limit is None else F.substring(text, 1, limit)
    return F.when(F.length(text) >= least, F.regexp_replace(strip(F.lower(some)), r"(?U)\s+", " "))


def analysable(text: Column, least: int = 10) -> Column:
    return F.when(F.length(strip(text)) >= least, strip(text))


def line_features(text: Column, empty_head: bool = False) -> dict[str, Column]:
    """Head and tail hashes, counts and moments of lines.

    Lines are the newline-terminated ones; a rest that is not blank counts as one more, and as the last of
    the tail.  A text without terminated lines has no head (null) unless empty_head keeps the hash of ''.
    """
    parts = F.split(text, "\n", -1)
    lines, rest = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    more = F.length(strip(rest)) > 0
    clean = lambda a: F.transform(a, strip)
    tail_of = lambda a, n: F.slice(a, F.greatest(F.lit(1), F.size(a) - (n - 1)), n)
    tail = F.when(more, F.concat(clean(tail_of(lines, 10)), F.array(strip(rest)))).otherwise(clean(tail_of(lines, 10)))
    lengths = F.transform(tail_of(lines, 100), lambda x: F.length(x).cast("double"))
    n = F.size(lengths)
    # one pass over the lengths: their sum and the sum of their squares, both exact in doubles
    sums = F.aggregate(lengths, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    mean = sums["s"] / F.greatest(n, F.lit(1))
    spread = F.when(n == 0, F.lit(0.0)).otherwise(sums["q"] / n - mean * mean)
    short = lambda a: F.substring(F.md5(F.array_join(a, "\n")), 1, 16)
    head = short(clean(F.slice(lines, 1, 10)))
    return {
        "line_count": (F.size(lines) + more.cast("int")).cast("long"), "char_count": char_count(text),
        "first_lines_hash": head if empty_head else F.when(F.size(lines) > 0, head), "last_lines_hash": short(tail),
        "avg_line_length": mean, "line_length_variance": spread,
    }


def tenth_lines(text: Column) -> Column:
    """Lines 10, 20, 30, ... of the newline-terminated ones."""
    parts = F.split(text, "\n", -1)
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: (i + 1) % 10 == 0)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def word_sample(text: Column, per_line: int = 5, stop: int = 100) -> Column:
    """Distinct first words of each tenth line; lines are taken until over ``stop`` words are held."""
    take = lambda acc, line: F.when(F.size(acc) > stop, acc).otherwise(F.array_union(acc, F.slice(words(line), 1, per_line)))
    return F.aggregate(tenth_lines(text), F.expr("array_repeat('', 0)"), take)


def sampled_word_count(text: Column) -> Column:
    return F.aggregate(tenth_lines(text), F.lit(0).cast("long"), lambda s, line: s + F.size(words(line)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def sentence_vector(text: Column) -> Column:
    """Sentences, mean sentence length in words, words per character."""
    sentences = F.size(F.filter(F.split(text, "[.!?。！？]+"), lambda s: F.length(F.trim(s)) > 0)).cast("double")
    count = F.size(F.filter(F.split(text, "[ \n]+"), lambda w: w != "")).cast("double")
    return F.array(sentences, count / F.greatest(sentences, F.lit(1.0)), count / F.greatest(F.length(text).cast("double"), F.lit(1.0)))
