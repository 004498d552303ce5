"""Benchmark decontamination by template canonicalisation, in SQL functions only.

Texts become templates: names (capitalised, not upper-case words; at the start of a sentence unless it is a
common opener), numbers and units turn into typed
placeholders that remember the value they replace, everything else is lower-cased and stripped of
punctuation.  Windows of WINDOW template words of documents are hash-joined with those of the benchmark
items.  Matched windows are grouped by the diagonal (position in the document minus position in the item); diagonals
at most a share DRIFT of the item apart are one place, where words were put in or left out.  A place, or a
diagonal of it alone, counts only if its slots are consistent: equal values of the item must have become equal
values of the document.  An item of which one place covers MIN_SIMILARITY of all windows contaminates the
document, verbatim or re-parameterised.

Windows with fewer than MIN_LITERALS words outside slots would match anything: they are matched with their
names as words or, where those are too few, with all their values.  An item's windows are also known with
their names as words, so that case does not matter in a verbatim copy.  Items shorter than a window are
matched as whole sequences with their values.

Templates are made only of documents that can hold an item: of any set of windows larger than the share that
may be missing, a document that holds the item has one.  So a few pairs of adjacent words an item, chosen to
touch so many windows, are looked for first, in one plain pass; no document that holds an item lacks them all.
Windows and pairs are broadcast only up to MAX_BROADCAST and MAX_ANCHORS of them, counted first; beyond that
joins shuffle.
Long texts are cut into pieces that overlap, so a text never becomes one array of words.

Defined results: null texts match nothing; short texts hold at most short items; rows with equal doc_id are one
document, items with equal item_id but different texts are judged apart and reported under their id with
the highest coverage; repeated rows change nothing; extra columns are ignored by scan() and kept by
remove(); empty tables give no rows and remove nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorsift.runtime import again, spread, stage

WINDOW = 5
MIN_SIMILARITY = 0.8
MIN_LITERALS = 2
MAX_BROADCAST = 100_000
#: Pairs of words that are broadcast at most: some 100 bytes each.
MAX_ANCHORS = 1_000_000
PIECE = 2000
#: Characters of a stretch that is looked through for pairs of words.
STRETCH = 1 << 20
#: How far the diagonals of one place may lie apart, as a share of the item's windows.
DRIFT = 0.25
# Markers of slots (private use), units, and the patterns that find slots; each pattern tests the
# class of a character before it looks around.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = "km|kg|cm|mm|mg|ml|lb|lbs|oz|ft|mi|mph|kmh|hz|khz|mhz|ghz|kb|mb|gb|tb|kw|kwh|metres|meters|miles|kilometres|kilometers|grams|kilograms|litres|liters|seconds|minutes|hours|days|weeks|months|years|percent|dollars|euros|pounds|degrees"
SLOT = f"[{NAME}-{UNIT}]"
# A capitalised word is a name inside a sentence, and at any other place unless it is one of these.
OPENERS = "A|About|After|All|Also|Although|An|And|Any|Are|As|At|Be|Because|Before|Between|But|By|Can|Could|Did|Do|Does|Each|Either|Every|Find|For|From|Given|Had|Has|Have|He|Hence|Her|Here|His|How|However|If|In|Is|It|Its|Let|May|Might|Most|Must|My|No|Not|Now|Of|On|One|Or|Our|Over|She|Should|Since|So|Some|Such|That|The|Their|Then|There|These|They|This|Those|Though|Thus|To|Two|Under|Until|Was|We|Were|What|When|Where|Which|While|Who|Whose|Why|Will|With|Would|You|Your"
NAME_PATTERN = rf"((?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]|[\p{{L}}\p{{N}}]['’-])(?:(?<=[\p{{Ll}}\p{{N}},;:] )|(?!(?:{OPENERS})(?![\p{{L}}'’-])))\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*+)"
JUNK_PATTERN = rf"(?:[^\p{{L}}\p{{N}}{NAME}](?!(?<=\p{{N}}[.,:/-])\p{{N}}))++"
NUMBER_PATTERN = r"(\p{N}(?<![\p{L}\p{N}]\p{N})[\p{N}.,:/-]*+)"
UNIT_PATTERN = rf"({NUMBER}[\p{{N}}.,:/-]++) ?({UNITS})(?!\p{{L}})"


def canonical(text: Column) -> Column:
    """Words separated by single spaces; slots are a marker and the value."""
    c = F.coalesce(text.cast("string"), F.lit(""))
    c = F.when(c.contains(NAME) | c.contains(NUMBER) | c.contains(UNIT), F.regexp_replace(c, SLOT, "")).otherwise(c)
    c = F.regexp_replace(c, NAME_PATTERN, f"{NAME}$1")
    c = F.lower(F.regexp_replace(F.regexp_replace(c, JUNK_PATTERN, " "), NUMBER_PATTERN, f"{NUMBER}$1"))
    return F.when(c.contains(NUMBER), F.regexp_replace(c, UNIT_PATTERN, f"$1 {UNIT}$2")).otherwise(c)


def raw_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, separated by single spaces: what templates are made of, without slots."""
    c = F.coalesce(text.cast("string"), F.lit(""))
    c = F.when(c.contains(NAME) | c.contains(NUMBER) | c.contains(UNIT), F.regexp_replace(c, SLOT, "")).otherwise(c)
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]++", " "))


def windows(rows: DataFrame, keys: list[str], text_col: str, window: int = WINDOW) -> DataFrame:
    """keys, at, t0.. (template tokens), n0.. (names as words), o0.. (tokens with values) and few, few_n of each window.

    few, few_n: whether fewer than MIN_LITERALS words stand outside the slots of t and of n.
    """
    words = r"(?:\S++ ?+){1,%d}+"
    piece = rf"(?=({words % (PIECE + window - 1)})){words % PIECE}"
    pieces = rows.select(*keys, F.posexplode(F.regexp_extract_all(canonical(F.col(text_col)), F.lit(piece), F.lit(1))).alias("piece", "part"))
    # windows are zipped from shifted arrays, so none is built as text and no array is copied per window
    part = F.rtrim("part")
    plain = F.when(part.contains(NAME), F.regexp_replace(part, NAME, "")).otherwise(part)
    slotted = part.contains(NAME) | part.contains(NUMBER)
    numbers = lambda c: F.when(c.contains(NUMBER), F.regexp_replace(c, rf"({SLOT})\S+", "$1")).otherwise(c)
    template = F.when(slotted, F.regexp_replace(part, rf"({SLOT})\S+", "$1")).otherwise(part)
    columns = {"t": template, "n": numbers(plain), "o": plain}
    split = pieces.select(*keys, "piece", *(F.split(c, " ").alias(k) for k, c in columns.items())).where(F.size("t") >= window)
    shifted = [F.slice(c, i + 1, F.size("t") - (window - 1)).alias(f"{c}{i}") for c in columns for i in range(window)]
    placed = split.select(*keys, "piece", F.posexplode(F.arrays_zip(*shifted)).alias("k", "w"))
    fields = [F.col(f"w.{c}{i}").alias(f"{c}{i}") for c in columns for i in range(window)]
    flat = placed.select(*keys, (F.col("piece") * PIECE + F.col("k")).alias("at"), *fields)
    slots = lambda c, *marks: sum((F.col(f"{c}{i}").isin(*marks).cast("int") for i in range(window)), F.lit(0))
    most = window - MIN_LITERALS
    return flat.select("*", (slots("t", NAME, NUMBER, UNIT) > most).alias("few"), (slots("n", NUMBER, UNIT) > most).alias("few_n"))


def _array(letter: str, window: int) -> Column:
    return F.array(*(F.col(f"{letter}{i}") for i in range(window)))


def readings(window: int) -> tuple[Column, Column]:
    """The tokens by which a window of a document is matched, and those by which a window of an item may be: a
    template of too few words says nothing, so it is read with its names, and then with all its values."""
    t, n, o = (_array(c, window) for c in "tno")
    plain = F.when(F.col("few_n"), o).otherwise(n)
    return F.when(F.col("few"), plain).otherwise(t), F.array_distinct(F.when(F.col("few"), F.array(plain)).otherwise(F.array(t, n)))


def _tokens(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with whole: all tokens with their values, and n_tokens."""
    own = F.regexp_replace(F.trim(canonical(F.col(text_col))), NAME, "")
    return rows.withColumn("whole", own).withColumn("n_tokens", F.when(own == "", F.lit(0)).otherwise(F.size(F.split(own, " "))))


def _short(texts: DataFrame, short: DataFrame, window: int) -> DataFrame:
    """doc_id, item_id of items shorter than a window that stand word for word in a document."""
    found = texts.sparkSession.createDataFrame([], f"doc_id {dict(texts.dtypes)['doc_id']}, item_id {dict(short.dtypes)['item_id']}")
    for (n,) in short.select("n_tokens").distinct().collect():  # lengths under a window
        run = F.array_join(_array("o", n), " ")
        held = windows(texts, ["doc_id"], "text", n).select("doc_id", run.alias("whole"))
        found = found.union(held.join(short.where(F.col("n_tokens") == n), "whole").select("doc_id", "item_id"))
    return found.distinct()


def _raw_runs(tokens: Column) -> Column:
    """Arrays of raw words that stand side by side wherever the tokens do: slots without a value, units, and numbers before units break them."""
    text = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    text = F.regexp_replace(text, rf" (?:{NUMBER}\S* )?{UNIT}\S*(?= )| (?:{NAME}|{NUMBER})(?= )", " | ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}|]++", " ")
    return F.transform(F.filter(F.split(text, r"\|"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), " "))


def anchors(known: DataFrame, short: DataFrame, min_similarity: float) -> DataFrame:
    """first, second: pairs of adjacent raw words (second null: one word) of which each document that holds an item has one.

    A document that holds an item lacks at most a share of 1 - min_similarity of its windows, so pairs that touch
    one window more are enough; pairs of long words, which are rare, are taken first.  Items that have too few
    pairs are stood for by single words as well.  Short items need all their words.
    """
    pair = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.element_at(r, i).alias("first"), F.element_at(r, i + 1).alias("second")))
    single = lambda r: F.transform(r, lambda w: F.struct(w.alias("first"), F.lit(None).cast("string").alias("second")))
    both = lambda r: F.concat(F.when(F.size(r) > 1, pair(r)).otherwise(F.filter(single(r), lambda x: F.lit(False))), single(r))
    held = known.select("item_id", "item_key", "item_at", F.explode(F.flatten(F.transform("runs", both))).alias("x"))
    per = held.groupBy("item_id", "item_key", "x").agg(F.collect_set("item_at").alias("ats"))
    # pairs before single words, and among them the longest first
    size = F.length("x.first") + F.coalesce(F.length("x.second"), F.lit(0))
    ranked = per.groupBy("item_id", "item_key").agg(F.array_sort(F.collect_list(F.struct(F.col("x.second").isNull().alias("lone"), (-size).alias("o"), "x", "ats"))).alias("r"))
    sizes = known.groupBy("item_id", "item_key").agg(F.count_distinct("item_at").alias("n"))
    spare = F.col("n") - F.ceil(F.col("n") * min_similarity - 1e-9)
    start = F.struct(F.expr("array_repeat(0, 0)").cast(dict(per.dtypes)["ats"]).alias("ats"), F.expr("array_repeat(named_struct('first', '', 'second', ''), 0)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        more = F.array_union(acc["ats"], r["ats"])
        done = (F.size(acc["ats"]) > F.col("spare")) | (F.size(more) == F.size(acc["ats"]))
        return F.when(done, acc).otherwise(F.struct(more.alias("ats"), F.concat(acc["out"], F.array(r["x"])).alias("out")))

    chosen = ranked.join(sizes.withColumn("spare", spare), ["item_id", "item_key"]).select(F.explode(F.aggregate("r", start, step)["out"]).alias("x"))
    raw = F.get(F.flatten(_raw_runs(F.split("whole", " "))), F.lit(0))
    # a short item of a number with its unit is stood for by the number, and by both written as one word
    words = F.split(F.trim(raw_words(F.col("whole"))), " ")
    glued = F.concat(F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    alone = F.explode(F.when(raw.isNotNull(), F.array(raw)).otherwise(F.array(F.get(words, F.lit(0)), glued)))
    lone = short.select(alone.alias("first")).select(F.struct("first", F.lit(None).cast("string").alias("second")).alias("x"))
    return chosen.union(lone).select("x.first", "x.second").where("first is not null and first <> ''").distinct()


def holders(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id of the documents that hold an anchor: one pass over words and pairs of words, without slots."""
    marks = stage(marks, "anchors", small=True)
    small = marks.count() <= MAX_ANCHORS
    longest = marks.agg(F.max(F.length("first") + F.coalesce(F.length("second"), F.lit(0)))).first()[0] or 0
    raw = F.concat(raw_words(F.col("text")), F.lit(" "))
    # a long text in stretches that overlap by an anchor: a word cut at an end only adds a candidate
    starts = F.sequence(F.lit(0), F.floor(F.length("raw") / STRETCH).cast("int"))
    cut = F.when(F.length("raw") <= STRETCH, F.array("raw")).otherwise(F.transform(starts, lambda i: F.substring("raw", i * STRETCH + 1, F.lit(STRETCH + longest + 2))))
    words = texts.select("doc_id", raw.alias("raw")).select("doc_id", F.explode(cut).alias("raw")).select("doc_id", F.split("raw", " ").alias("w"))
    pairs = words.select("doc_id", F.explode(F.arrays_zip(F.col("w").alias("first"), F.slice("w", F.lit(2), F.size("w")).alias("second"))).alias("x")).select("doc_id", "x.first", "x.second")
    two, one = marks.where("second is not null"), again(marks).where("second is null").select("first")
    hint = F.broadcast if small else lambda x: x
    found = pairs.join(hint(two), ["first", "second"], "left_semi").select("doc_id")
    if not one.isEmpty():
        found = found.union(pairs.join(hint(one), "first", "left_semi").select("doc_id"))
    return found.distinct()


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_similarity: float = MIN_SIMILARITY, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, reparameterised for each item that a document contains."""
    own = items.select(F.col(item_col).alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct().withColumn("item_key", F.sha2("text", 256))
    by_doc, by_item = readings(window)
    known = windows(own, ["item_id", "item_key"], "text", window)
    base = F.when(F.col("few"), by_item[0]).otherwise(_array("t", window))
    known = known.select("item_id", "item_key", F.col("at").alias("item_at"), by_item.alias("readings"), _array("o", window).alias("item_own"), _raw_runs(base).alias("runs"))
    known = stage(known, "item-windows", small=True)
    short = stage(_tokens(own, "text").where((F.col("n_tokens") > 0) & (F.col("n_tokens") < window)).select("item_id", "whole", "n_tokens"), "short-items", small=True)
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).where("doc_id is not null")
    near = stage(holders(texts, anchors(known, short, min_similarity)), "holders", small=True)
    texts = texts.join(near, "doc_id", "left_semi")
    sizes = known.groupBy("item_id", "item_key").agg(F.count_distinct("item_at").alias("n_windows"))
    small = known.count() <= MAX_BROADCAST
    asked = known.select("item_id", "item_key", "item_at", "item_own", F.explode("readings").alias("reading"))
    held = windows(texts, ["doc_id"], "text", window).select("doc_id", "at", by_doc.alias("reading"), _array("o", window).alias("own"))
    hits = held.join(F.broadcast(asked) if small else asked, "reading")
    both = F.arrays_zip(F.col("reading").alias("mark"), F.col("item_own").alias("item"), F.col("own").alias("doc"))
    pair = F.transform(F.filter(both, lambda x: x["mark"].isin(NAME, NUMBER, UNIT)), lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc")))
    item = ["doc_id", "item_id", "item_key"]
    places = hits.groupBy(*item, (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"))
    # diagonals a few words apart are one place, with words put in or left out; places further apart are judged alone
    places = places.join(sizes, ["item_id", "item_key"])
    line = Window.partitionBy(*item).orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(line) > F.floor(F.col("n_windows") * DRIFT)
    placed = places.withColumn("place", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(line))
    parts = placed.groupBy(*item, "n_windows", "place").agg(F.collect_list(F.struct("ats", "pairs")).alias("parts"))
    # a place as a whole, and each of its diagonals alone
    gathered = lambda c: F.array_distinct(F.flatten(F.transform("parts", lambda x: x[c])))
    tried = parts.select(*item, "n_windows", F.explode(F.concat(F.array(F.struct(gathered("ats").alias("ats"), gathered("pairs").alias("pairs"))), F.col("parts"))).alias("x"))
    tried = tried.select(*item, "n_windows", "x.ats", "x.pairs")
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["item"])))
    changed = F.exists("pairs", lambda x: x["item"] != x["doc"])
    judged = tried.where(consistent).select("doc_id", "item_id", "n_windows", F.size("ats").cast("long").alias("n_matched"), changed.alias("reparameterised"))
    judged = judged.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= min_similarity)
    whole = F.lit(1).cast("long")
    few = _short(texts, short, window).select("doc_id", "item_id", whole.alias("n_windows"), whole.alias("n_matched"), F.lit(1.0).alias("coverage"), F.lit(False).alias("reparameterised"))
    judged = judged.select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "reparameterised").union(few)
    best = F.max(F.struct("coverage", "n_windows", "n_matched", "reparameterised")).alias("best")
    return judged.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_windows", "best.n_matched", F.round("best.coverage", 6).alias("coverage"), "best.reparameterised")


def remove(docs: DataFrame, items: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """docs without those that contain a benchmark item; rows without a doc_id cannot be told apart and stay."""
    found = stage(scan(docs, items, min_similarity=min_similarity).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
