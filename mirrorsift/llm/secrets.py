"""Secret scanning with corpus-wide ownership frequency, in SQL functions only.

Candidates are the base kinds (assign, access, hex) and a broader one: long tokens of mixed letters and
digits.  Each candidate's SHA-256 is counted over the whole corpus by distinct repositories and distinct
owners.  A value that many owners hold is a copied example, and so is one in very many repositories that does
not look random, whoever owns them; any other base value is live, whatever its length or characters, and a
broader token is live if it looks random.  Base spans are always reported; a broader token is added as a span of kind ``token`` only
where its ownership says live and no base span covers it.

Positions come from one linear scan a kind: a lazy gap followed by the pattern or the end of the text, so
that lengths of gaps and matches add up to code point offsets.  Offsets are summed in blocks, so texts with
very many matches stay near linear.  Owners are counted after combining (value, owner, repository) rows map-side.

Defined results: null texts are empty; a null owner counts as one owner, a null repository as one
repository; repeated rows give repeated results and count once; extra columns are ignored by scan() and
kept by redact(); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorsift.runtime import spread, stage, unused

# The patterns of each kind, in the order in which kinds sort.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
#: kind, pattern, a cheaper pattern that every match contains, group of the value, least value length.
KINDS = (
    ("assign", ASSIGN, r"(?i:password|passwd|secret|token|api_?key)", 3, 12),
    ("access", ACCESS, "AKIA", 2, 0),
    ("hex", HEX, HEX, 2, 0),
    ("token", TOKEN, TOKEN, 2, 0),
)
BASE = ("assign", "access", "hex")
#: Values held by so many owners or more are copied examples.
EXAMPLE_OWNERS = 3
#: Values that do not look random are copied examples in so many repositories, too.
EXAMPLE_REPOS = 100
#: A random-looking value has so many characters and distinct characters at least.
LIVE_LENGTH, LIVE_DISTINCT = 16, 8
MASK = "<SECRET>"
#: Examples that redact() sends to every task as a set of hashes.
MAX_EXAMPLES = 20_000
_BLOCK = 256


def _scan_pattern(pattern: str) -> str:
    return rf"(?s)(.*?)(?:({pattern})|\z)"


def _pieces(text: Column, pattern: str, cheap: str, value_group: int) -> Column:
    """array<struct<gap, match, value>> that concatenates to the text; empty where nothing matches."""
    scan = F.lit(_scan_pattern(pattern))
    parts = [F.regexp_extract_all(text, scan, F.lit(i)) for i in (1, 2, value_group)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("gap", "match", "value"), strict=True)))
    return F.when(text.rlike(cheap), zipped)


def _spans(pieces: Column, least: int) -> Column:
    """array<struct<start, end, value>> of the matches, with a running sum in blocks."""
    sized = F.transform(pieces, lambda x: F.struct(F.length(x["gap"]).alias("g"), F.length(x["match"]).alias("m"), x["value"].alias("v")))
    empty = F.expr("array_repeat(struct(0 as start, 0 as end, '' as value), 0)")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sized) - 1) / _BLOCK).cast("int")), lambda i: F.slice(sized, i * _BLOCK + 1, _BLOCK))

    def place(chunk, base):
        step = lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["m"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end"), x["v"].alias("value")))).alias("out"),
        )
        return F.aggregate(chunk, F.struct(base.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["g"] + x["m"])
    bases = F.aggregate(F.transform(chunks, total), F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    placed = F.flatten(F.zip_with(chunks, F.slice(bases, 1, F.size(bases) - 1), place))
    kept = F.filter(placed, lambda x: (x["end"] > x["start"]) & (F.length(x["value"]) >= least))
    return F.when(pieces.isNull() | (F.size(pieces) == 0), empty).otherwise(kept)


def _looks_random(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_LENGTH) & (distinct >= LIVE_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_found(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with an array of the base spans and token candidates of a text (start, ord, kind, end, hash, random)."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    cols = {k: unused(f"found_{k}", [*df.columns, name]) for k, *_ in KINDS}
    pieces = df.select(*kept, *(_pieces(text, p, cheap, g).alias(cols[k]) for k, p, cheap, g, _ in KINDS))
    spans = pieces.select(*kept, *(_spans(F.col(cols[k]), least).alias(cols[k]) for k, _, _, _, least in KINDS))
    tag = lambda i, k: F.transform(cols[k], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("ord"), F.lit(k).alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"), _looks_random(x["value"]).alias("random")))
    return spans.select(*kept, F.concat(*(tag(i, k) for i, (k, *_) in enumerate(KINDS))).alias(name))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """doc_id, owner, repo, found: the base spans and token candidates of each row.

    repo_col names the repository; by default each document is one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo"))
    return with_found(rows, F.col("text"), "found").drop("text")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over the corpus."""
    held = found.where(F.size("found") > 0).select("owner", "repo", F.explode(F.array_distinct(F.transform("found", lambda x: x["hash"]))).alias("hash"))
    none = F.lit("")
    by_owner = held.select("hash", F.coalesce("owner", none).alias("owner"), F.coalesce("repo", none).alias("repo")).distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def _copied(random: Column, example_owners: int) -> Column:
    """Whether a value with n_owners and n_repos is a copied example."""
    return (F.col("n_owners") >= example_owners) | ((F.col("n_repos") >= EXAMPLE_REPOS) & ~random)


def _live(span: Column, copied: Column) -> Column:
    return ~copied & ((span["kind"] != "token") | span["random"])


def _judged(found: DataFrame, example_owners: int) -> DataFrame:
    """doc_id, row_key, judged: the spans of each distinct row with candidates, each with its live and copied flags."""
    held = found.where(F.size("found") > 0).select("doc_id", "row_key", F.explode("found").alias("s"))
    counts = stage(ownership(found), "owners")
    copied = _copied(F.col("s.random"), example_owners)
    live = _live(F.col("s"), copied)
    known = held.select("doc_id", "row_key", "s", F.col("s.hash").alias("hash")).join(counts, "hash")
    span = F.struct(F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("hash"), live.alias("live"), copied.alias("copied"), "n_owners", "n_repos")
    return known.groupBy("doc_id", "row_key").agg(F.collect_set(span).alias("judged"))


def _found(docs: DataFrame, **columns) -> DataFrame:
    found = candidates(spread(docs), **columns)
    return stage(found.withColumn("row_key", F.sha2(F.to_json("found"), 256)), "candidates")


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, **columns) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, ownership.

    ownership has kind:start:end:owners:repositories:verdict of every candidate, the verdict being live, copied
    (a widely held example) or plain (a token that does not look random).
    """
    found = _found(docs, **columns)
    judged = stage(_judged(found, example_owners), "judged")
    base = F.filter("found", lambda x: x["kind"] != "token")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    rows = found.select("doc_id", "row_key", *(count(k).alias(f"n_{k}") for k in BASE), base.alias("base"))
    both = rows.join(judged.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (rows.row_key == judged.row_key), "left")
    slim = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))
    no_more = F.filter(slim("base"), lambda x: F.lit(False))
    inside = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    added = F.coalesce(slim(F.filter("judged", lambda x: (x["kind"] == "token") & x["live"] & ~inside(x))), no_more)
    tally = lambda f: F.coalesce(F.size(F.array_distinct(F.transform(F.filter("judged", lambda x: x[f]), lambda x: x["hash"]))), F.lit(0)).cast("long")
    verdict = lambda x: F.when(x["live"], F.lit("live")).when(x["copied"], F.lit("copied")).otherwise(F.lit("plain"))
    told = lambda x: F.concat_ws(":", x["kind"], *(x[c].cast("string") for c in ("start", "end", "n_owners", "n_repos")), verdict(x))
    ownership_ = F.coalesce(F.array_join(F.transform(F.array_sort("judged"), told), ","), F.lit(""))
    return both.select(
        "doc_id", *(f"n_{k}" for k in BASE), F.sha2(_joined(slim("base")), 256).alias("base_sha256"), _joined(F.concat(slim("base"), added)).alias("spans"),
        F.when(F.col("judged").isNull(), F.lit(0)).otherwise(tally("live")).cast("long").alias("n_live"), F.when(F.col("judged").isNull(), F.lit(0)).otherwise(tally("copied")).cast("long").alias("n_copied"), ownership_.alias("ownership"),
    )


def examples(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """hash: the values that are copied examples."""
    shape = found.where(F.size("found") > 0).select(F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["hash"].alias("hash"), x["random"].alias("random"))))).alias("x")).select("x.hash", "x.random").distinct()
    wide = ownership(found).where((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= EXAMPLE_REPOS))
    return wide.join(shape, "hash").where(_copied(F.col("random"), example_owners)).select("hash").distinct()


def redact(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, mask: str = MASK) -> DataFrame:
    """docs (doc_id, text, source, ...) with the values of live secrets replaced in the text; copied examples stay.

    Live is what is no example, so where the examples are few (MAX_EXAMPLES, counted first) each row is judged
    where it lies against their set, and no text is moved; beyond that the live values of each document are
    joined to it, with the same result.
    """
    found = candidates(spread(docs))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    mine = unused("live", docs.columns)
    few = stage(examples(stage(found, "candidates"), example_owners), "examples", small=True)
    if few.count() <= MAX_EXAMPLES:
        known = [x.hash for x in few.collect()]
        every = unused("found", docs.columns)
        live = F.transform(F.filter(every, lambda x: _live(x, x["hash"].isin(known))), lambda x: x["hash"])
        both = with_found(docs, F.coalesce(F.col("text").cast("string"), F.lit("")), every).select(*kept, live.alias(mine))
    else:
        judged = _judged(_found(docs), example_owners).select("doc_id", F.explode("judged").alias("s")).where("s.live")
        own = unused("own_id", docs.columns)
        held = stage(judged.groupBy("doc_id").agg(F.collect_set("s.hash").alias("live")), "live").toDF(own, mine)
        both = docs.join(held, F.col("doc_id").eqNullSafe(F.col(own)), "left")
    text = F.col("text")
    for _, pattern, cheap, group, _ in KINDS:
        is_live = lambda x: F.array_contains(mine, F.sha2(x["value"], 256))
        prefix = lambda x: x["match"].substr(F.lit(1), F.length(x["match"]) - F.length(x["value"]))
        hidden = lambda x: F.concat(x["gap"], F.when((x["match"] != "") & is_live(x), F.concat(prefix(x), F.lit(mask))).otherwise(x["match"]))  # noqa: E731, B023
        text = F.coalesce(F.array_join(F.transform(_pieces(text, pattern, cheap, group), hidden), ""), text)
    some = F.coalesce(F.size(mine), F.lit(0)) > 0
    return both.select(*(F.when(some, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
