"""Every reference operator as a query over the driver's tables, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorsift.functions import files, hashes, matchers, text
from mirrorsift.operators import blocking, exact, outcome, pairs
from mirrorsift.operators.components import connected_components
from mirrorsift.params import Params
from mirrorsift.plans import engine
from mirrorsift.plans.inputs import FILES, IMAGES, VIDEOS, images, table, text_files, videos
from mirrorsift.runtime import again, new_path, spread, stage
from mirrorsift.sources.scan import with_video_info
from mirrorsift.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


# -- scans -----------------------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT path, name, extension, size FROM f WHERE extension IN ({_in(files.TEXT_EXTENSIONS)}) AND size BETWEEN 10 AND 52428800")
def scan_filter_files(spark: SparkSession, d: str) -> DataFrame:
    f = text_files(spark, d).where(files.has_extension(F.col("path"), files.TEXT_EXTENSIONS) & F.col("size").between(10, 50 << 20))
    return f.select("path", "name", files.suffix(F.col("path")).alias("extension"), "size")


_URL = "regexp_extract(lower(url), '^[^?#]*', 0)"


@query(f"""SELECT page_id, regexp_extract(p, '[^/]*$', 0) AS name, regexp_extract(p, '[^/]+?(\\.[^./]+)$', 1) AS extension,
  regexp_extract(p, '[^/]+?(\\.[^./]+)$', 1) IN ({_in(files.TEXT_EXTENSIONS)}) AS is_text, regexp_extract(p, '[^/]+?(\\.[^./]+)$', 1) IN ({_in(files.IMAGE_EXTENSIONS)}) AS is_image,
  regexp_extract(p, '[^/]+?(\\.[^./]+)$', 1) IN ({_in(files.VIDEO_EXTENSIONS)}) AS is_video FROM (SELECT page_id, {_URL} AS p FROM pages)""")
def url_extension_scan(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract(F.lower("url"), "^[^?#]*", 0)
    kind = lambda e: files.has_extension(F.col("p"), e)
    return table(spark, d, "pages").select("page_id", p.alias("p")).select(
        "page_id", files.basename(F.col("p")).alias("name"), files.suffix(F.col("p")).alias("extension"), kind(files.TEXT_EXTENSIONS).alias("is_text"),
        kind(files.IMAGE_EXTENSIONS).alias("is_image"), kind(files.VIDEO_EXTENSIONS).alias("is_video"),
    )


@query(f"WITH {FILES} SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size FROM f")
def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    return outcome.scan_stats(text_files(spark, d))


@query(f"WITH {FILES} SELECT source, count(*) AS n_files, round(avg(size), 6) AS avg_size, max(size) AS max_size FROM f GROUP BY source")
def avg_file_size(spark: SparkSession, d: str) -> DataFrame:
    return text_files(spark, d).groupBy("source").agg(F.count("*").alias("n_files"), F.round(F.avg("size"), 6).alias("avg_size"), F.max("size").alias("max_size"))


@query(f"WITH {FILES} SELECT DISTINCT path, size FROM (SELECT path, size FROM f WHERE lang <> 'es' UNION ALL SELECT path, size FROM f WHERE lang <> 'de')")
def union_roots_dedupe(spark: SparkSession, d: str) -> DataFrame:
    f = text_files(spark, d)
    return f.where("lang <> 'es'").unionByName(f.where("lang <> 'de'")).select("path", "size").dropDuplicates(["path"])


# -- filters and blocks ----------------------------------------------------------------------------

@query(f"WITH {FILES}, b AS (SELECT path, size, CAST(trunc(size / (CAST(size AS DOUBLE) * 0.05 + 1)) AS INTEGER) AS bucket FROM f WHERE size > 0) SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY bucket) > 1")
def text_size_bucket(spark: SparkSession, d: str) -> DataFrame:
    return blocking.text_blocks(text_files(spark, d), by_extension=False).select("path", "size", blocking.size_bucket(F.col("size")).alias("bucket"))


@query(f"""WITH {FILES}, b AS (SELECT path, extension, CAST(trunc(size / (CAST(size AS DOUBLE) * 0.05 + 1)) AS INTEGER) AS bucket FROM f WHERE size > 0)
SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY bucket, extension) > 1""")
def text_size_ext_block(spark: SparkSession, d: str) -> DataFrame:
    return blocking.text_blocks(text_files(spark, d)).select("path", "extension", blocking.size_bucket(F.col("size")).alias("bucket"))


@query("""WITH t AS (SELECT s_suppkey, CAST(floor(s_acctbal * 5000) AS DOUBLE) AS mtime FROM supplier),
n AS (SELECT *, mtime - lag(mtime) OVER (ORDER BY mtime, s_suppkey) AS back, lead(mtime) OVER (ORDER BY mtime, s_suppkey) - mtime AS ahead FROM t)
SELECT s_suppkey, mtime FROM n WHERE back < 86400 OR ahead < 86400""")
def mtime_neighbour_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier").select("s_suppkey", F.floor(F.col("s_acctbal") * 5000).cast("double").alias("mtime"))
    return blocking.near_in_time(t)


@query(f"""WITH {FILES}, g AS (SELECT size, count(*) AS n, min(path) AS first FROM f GROUP BY size),
r AS (SELECT size, sum(n) OVER (ORDER BY n DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM g WHERE n > 1),
p AS (SELECT path, f.size FROM f JOIN r ON f.size = r.size WHERE before < 300),
s AS (SELECT path, f.size FROM f JOIN g ON f.size = g.size WHERE g.n = 1 ORDER BY f.size DESC, path)
SELECT path, size FROM p UNION ALL SELECT path, size FROM (SELECT *, row_number() OVER (ORDER BY size DESC, path) AS k FROM s) WHERE k <= 200 - (SELECT count(*) FROM p)""")
def smart_selection(spark: SparkSession, d: str) -> DataFrame:
    return blocking.smart_selection(text_files(spark, d)).select("path", "size")


@query(f"WITH {FILES} SELECT path, CAST((row_number() OVER (ORDER BY path) - 1) // 50 AS BIGINT) AS batch FROM f")
def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    return blocking.batches(text_files(spark, d).select("path"), "path").select("path", "batch")


@query("""WITH i AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey % 1500 AS width, o_orderkey % 900 AS height FROM orders)
SELECT o_orderkey, size // 1024 AS size_block, width // 100 AS width_block, height // 100 AS height_block FROM i QUALIFY count(*) OVER (PARTITION BY size // 1024, width // 100, height // 100) > 1""")
def image_metadata_block(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("size"), (F.col("o_custkey") % 1500).alias("width"), (F.col("o_orderkey") % 900).alias("height"))
    block = lambda c, n: F.floor(F.col(c) / n).alias(f"{c}_block")
    return blocking.image_blocks(i).select("o_orderkey", block("size", 1024), block("width", 100), block("height", 100))


_VIDEO = "v AS (SELECT p_partkey, CAST(floor(p_retailprice * 1000) AS BIGINT) - 1000000 AS size, CAST(p_size * 13 - 100 AS DOUBLE) AS duration FROM part)"
_VKEYS = "CASE WHEN size <= 0 THEN -1 ELSE CAST(trunc(log10(size + 1) * 10) AS INTEGER) END AS size_key, CASE WHEN duration <= 0 THEN -1 ELSE CAST(trunc(duration / 30) AS INTEGER) END AS duration_key"


def _part_videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.floor(F.col("p_retailprice") * 1000) - 1000000).alias("size"), (F.col("p_size") * 13 - 100).cast("double").alias("duration"))


@query(f"WITH {_VIDEO}, k AS (SELECT p_partkey, {_VKEYS} FROM v), s AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY size_key) > 1) SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY size_key, duration_key) > 1")
def video_metadata_block(spark: SparkSession, d: str) -> DataFrame:
    kept = blocking.video_blocks(_part_videos(spark, d))
    return kept.select("p_partkey", blocking.video_size_key(F.col("size")).alias("size_key"), blocking.video_duration_key(F.col("duration")).alias("duration_key"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE coalesce(o_totalprice, 0) BETWEEN 50000 AND 100000")
def filter_by_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(files.between(F.col("o_totalprice"), 50000, 100000)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part WHERE coalesce(p_size, 0) >= 5 AND coalesce(p_size, 0) <= 20")
def filter_by_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(files.between(F.col("p_size"), 5, 20)).select("p_partkey", "p_size")


_META = "m AS (SELECT p_partkey, CAST(floor(p_retailprice * 100000) AS BIGINT) AS size, CAST(p_partkey % 31 AS DOUBLE) AS fps, (p_partkey % 4) * 100 - 100 AS frames FROM part)"


@query(f"""WITH {_META}, c AS (SELECT *, CASE WHEN frames <= 0 AND fps > 0 THEN CAST(floor(size / 1048576.0::DOUBLE / 2 * fps) AS BIGINT) ELSE frames END AS frame_count FROM m)
SELECT p_partkey, frame_count, round(CASE WHEN fps > 0 THEN frame_count / fps ELSE greatest(1.0, size / 1048576.0::DOUBLE / 2) END, 6) AS duration,
round(CASE WHEN fps > 0 THEN frames / fps ELSE 0 END, 6) AS plain_duration FROM c""")
def video_metadata_estimate(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_retailprice") * 100000).alias("size"), (F.col("p_partkey") % 31).cast("double").alias("fps"), (F.col("p_partkey") % 4 * 100 - 100).alias("frames"))
    count, duration = files.video_metadata(F.col("size"), F.col("fps"), F.col("frames"))
    _, plain = files.video_metadata(F.col("size"), F.col("fps"), F.col("frames"), estimate=False)
    return m.select("p_partkey", count.alias("frame_count"), F.round(duration, 6).alias("duration"), F.round(plain, 6).alias("plain_duration"))


def _frames(spark: SparkSession, d: str, skip_ends: bool) -> DataFrame:
    total = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 200).alias("total"))
    return total.select("p_partkey", F.array_join(files.frame_indices(F.col("total"), 5, skip_ends).cast("array<string>"), ",").alias("frames"))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 200 AS n FROM part)
SELECT p_partkey, CASE WHEN n <= 0 THEN NULL WHEN n <= 5 THEN array_to_string(range(0, n), ',')
ELSE array_to_string(list_transform(range(0, 5), lambda i: CAST(floor(floor(n * 0.1::DOUBLE) + i * ((floor(n * 0.9::DOUBLE) - floor(n * 0.1::DOUBLE)) / 4.0::DOUBLE)) AS BIGINT)), ',') END AS frames FROM t""")
def frame_sampling_fast(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d, True)


@query("""WITH t AS (SELECT p_partkey, p_partkey % 200 AS n FROM part)
SELECT p_partkey, CASE WHEN n > 0 THEN array_to_string(list_transform(range(0, 5), lambda i: CAST(floor(i * ((n - 1)::DOUBLE / 4.0::DOUBLE)) AS BIGINT)), ',') END AS frames FROM t""")
def frame_sampling_full(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d, False)


# -- text projections ------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count, CASE WHEN text = '' THEN 0 ELSE CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) END AS line_count FROM documents""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.char_count(t).alias("char_count"), text.line_count(t).alias("line_count"))


_LINES = """l AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, text, parts[1:len(parts) - 1] AS lines, parts[len(parts)] AS rest FROM l)"""


@query(f"""WITH {_LINES}, t AS (SELECT *, list_transform(lines, lambda x: trim(x, chr(9) || chr(32))) AS clean, trim(rest, chr(9) || chr(32)) AS more,
  list_transform(lines[greatest(1, len(lines) - 99):len(lines)], lambda x: CAST(length(x) AS DOUBLE)) AS sizes FROM s)
SELECT doc_id, CAST(len(lines) + (more <> '')::INTEGER AS BIGINT) AS line_count, CAST(length(text) AS BIGINT) AS char_count,
  CASE WHEN len(lines) > 0 THEN substr(md5(array_to_string(clean[1:10], chr(10))), 1, 16) END AS first_lines_hash,
  substr(md5(array_to_string(CASE WHEN more <> '' THEN list_append(clean[greatest(1, len(clean) - 9):len(clean)], more) ELSE clean[greatest(1, len(clean) - 9):len(clean)] END, chr(10))), 1, 16) AS last_lines_hash,
  round(CASE WHEN len(sizes) = 0 THEN 0 ELSE list_avg(sizes) END, 4) AS avg_line_length, round(CASE WHEN len(sizes) = 0 THEN 0 ELSE list_var_pop(sizes) END, 4) AS line_length_variance FROM t""")
def line_features(spark: SparkSession, d: str) -> DataFrame:
    f = text.line_features(F.col("text"))
    out = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", *(c.alias(n) for n, c in f.items()))
    return out.withColumns({c: F.round(c, 4) for c in ("avg_line_length", "line_length_variance")})


#: Words of every tenth line of a text, the first five of each, until over a hundred are held.
_SAMPLES = """x AS (SELECT *, string_split(text, chr(10)) AS parts FROM f),
y AS (SELECT *, list_transform(list_filter(range(1, len(parts)), lambda i: i % 10 = 0), lambda i: regexp_extract_all(lower(parts[i]), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+')) AS tens FROM x),
smp AS (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), tens), lambda acc, l: CASE WHEN len(acc) > 100 THEN acc ELSE list_distinct(list_concat(acc, l[1:5])) END) AS sample FROM y)"""


@query(f"WITH {FILES}, {_SAMPLES} SELECT doc_id, array_to_string(list_sort(sample), ' ') AS words, CAST(coalesce(list_sum(list_transform(tens, lambda l: len(l))), 0) AS BIGINT) AS word_count FROM smp")
def word_sample(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(F.array_sort(text.word_sample(t)), " ").alias("words"), text.sampled_word_count(t).alias("word_count"))


@query("""SELECT doc_id, CASE WHEN length(text) >= 10 THEN regexp_replace(trim(lower(text), chr(9) || chr(10) || chr(13) || chr(32)), '[ \\t\\n\\r]+', ' ', 'g') END AS normal,
CASE WHEN length(trim(text, chr(9) || chr(10) || chr(13) || chr(32))) >= 10 THEN md5(trim(text, chr(9) || chr(10) || chr(13) || chr(32))) END AS stripped_hash FROM documents""")
def normalize_content(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize(t).alias("normal"), F.md5(text.analysable(t)).alias("stripped_hash"))


@query()
def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(matchers.nfkc("text")).alias("normal_hash"))


@query("SELECT page_id, 'utf-8' AS encoding FROM pages")
def detect_encoding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", matchers.detect_encoding(F.col("html").cast("binary")).alias("encoding"))


# -- exact groups ----------------------------------------------------------------------------------

_EXACT = "e AS (SELECT min(path) OVER (PARTITION BY md5(text)) AS group_id, *, count(*) OVER (PARTITION BY md5(text)) AS n FROM f)"


@query(f"WITH {FILES}, {_EXACT} SELECT group_id, path, CAST(100.0 AS DOUBLE) AS similarity, 'exact' AS match_type, md5(text) AS content_hash FROM e WHERE n > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_groups(text_files(spark, d))


@query(f"""WITH {FILES}, h AS (SELECT path, md5(substr(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 1, 100000)) AS content_hash FROM f)
SELECT min(path) OVER (PARTITION BY content_hash) AS group_id, path, CAST(100.0 AS DOUBLE) AS similarity, 'exact' AS match_type, content_hash FROM h QUALIFY count(*) OVER (PARTITION BY content_hash) > 1""")
def exact_dup_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The shipped digest, which reads 100,000 characters."""
    return exact.exact_groups(spread(text_files(spark, d).select("path", "text")), prefix_chars=100_000)


@query("""SELECT min(doc_id) OVER (PARTITION BY md5(text)) AS group_id, doc_id, CAST(100.0 AS DOUBLE) AS similarity, 'exact' AS match_type, md5(text) AS content_hash
FROM documents WHERE text <> '' QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1""")
def exact_dup_bytes(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_groups(table(spark, d, "documents").where("text <> ''"), F.md5(F.col("text").cast("binary")), id_col="doc_id")


# -- pairs and similarities ------------------------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey AS k, list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '\\.[^.]*$', ''), ''), lambda c: c <> '')) AS c FROM part)
SELECT a.k AS a, b.k AS b, round(CASE WHEN len(a.c) = 0 OR len(b.c) = 0 THEN 0 ELSE len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c)))::DOUBLE END, 9) AS similarity FROM s a JOIN s b ON a.k + 1 = b.k""")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts that follow each other."""
    p = table(spark, d, "part")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("na")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("nb"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(pairs.name_similarity(F.col("na"), F.col("nb")), 9).alias("similarity"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, ta, tb: each turn of a conversation with the next."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb"))
    return c.withColumnRenamed("text", "ta").join(after, ["conv_id", "turn"])


def _dealt_turns(spark: SparkSession, d: str) -> DataFrame:
    """_turns() for the matchers: by number, as the few partitions that AQE leaves by bytes would be all their tasks."""
    return _turns(spark, d).repartition(engine.pieces(spark), F.xxhash64("conv_id", "turn"))  # the keys of the join would be no new dealing


_TURNS = "p AS (SELECT a.conv_id, a.turn, a.text AS ta, b.text AS tb FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"
_LINES_OF = "CASE WHEN {0} = '' THEN 0 ELSE length({0}) - length(replace({0}, chr(10), '')) + 1 END"


@query(f"""WITH {_TURNS}, x AS (SELECT *, strlen(ta) AS sa, strlen(tb) AS sb, {_LINES_OF.format("ta")} AS la, {_LINES_OF.format("tb")} AS lb FROM p)
SELECT conv_id, turn, round(least(sa, sb) / nullif(greatest(sa, sb), 0)::DOUBLE, 9) AS size_ratio, round(least(la, lb) / nullif(greatest(la, lb), 0)::DOUBLE, 9) AS line_ratio FROM x""")
def size_line_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    size, lines = (files.ratio(f(F.col("ta")), f(F.col("tb"))) for f in (F.octet_length, text.line_count))
    return _turns(spark, d).select("conv_id", "turn", F.round(size, 9).alias("size_ratio"), F.round(lines, 9).alias("line_ratio"))


_QUICK = f"""{_SAMPLES}, ft AS (SELECT path, name, size, sample, string_split(text, chr(10))[1:len(parts) - 1] AS lines, trim(parts[len(parts)], chr(9) || chr(32)) AS more,
  list_distinct(list_filter(string_split(regexp_replace(lower(name), '\\.[^.]*$', ''), ''), lambda c: c <> '')) AS chars FROM smp),
g AS (SELECT path, name, size, sample, chars, CAST(len(lines) + (more <> '')::INTEGER AS DOUBLE) AS n_lines, list_transform(lines, lambda x: trim(x, chr(9) || chr(32))) AS clean, more FROM ft),
h AS (SELECT *, CASE WHEN len(clean) > 0 THEN md5(array_to_string(clean[1:10], chr(10))) END AS head,
  md5(array_to_string(CASE WHEN more <> '' THEN list_append(clean[greatest(1, len(clean) - 9):len(clean)], more) ELSE clean[greatest(1, len(clean) - 9):len(clean)] END, chr(10))) AS tail FROM g)"""


@query(f"WITH {FILES}, {_QUICK} SELECT path, size, CAST(n_lines AS BIGINT) AS line_count, substr(head, 1, 16) AS first_lines_hash, substr(tail, 1, 16) AS last_lines_hash, CAST(len(sample) AS BIGINT) AS n_words, CAST(len(chars) AS BIGINT) AS n_stem_chars FROM h")
def feature_records(spark: SparkSession, d: str) -> DataFrame:
    """The features that the quick check reads, of every file."""
    f = pairs.with_features(spread(text_files(spark, d)))
    return f.select("path", "size", "line_count", "first_lines_hash", "last_lines_hash", F.size("word_sample").cast("long").alias("n_words"), F.size("stem_chars").cast("long").alias("n_stem_chars"))


@query(f"""WITH {FILES}, {_QUICK}
SELECT a.path AS a, b.path AS b FROM h a JOIN h b ON a.path < b.path AND least(a.size, b.size) / greatest(a.size, b.size)::DOUBLE >= 0.8
WHERE (a.name = b.name OR least(a.size, b.size) / greatest(a.size, b.size)::DOUBLE >= 0.9 OR coalesce(len(list_intersect(a.chars, b.chars)) / nullif(len(list_distinct(list_concat(a.chars, b.chars))), 0)::DOUBLE, 0) >= 0.3)
  AND (a.n_lines = 0 OR b.n_lines = 0 OR least(a.n_lines, b.n_lines) / greatest(a.n_lines, b.n_lines) >= 0.7)
  AND (coalesce(a.head = b.head, false) OR a.tail = b.tail OR (len(a.sample) > 0 AND len(b.sample) > 0 AND len(list_intersect(a.sample, b.sample)) / len(list_distinct(list_concat(a.sample, b.sample)))::DOUBLE > 0.5))""")
def quick_check_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.quick_pairs(stage(pairs.with_features(spread(text_files(spark, d))), "features"))


@query(f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, CAST(length(ta) AS DOUBLE) AS a, CAST(length(tb) AS DOUBLE) AS b FROM p)
SELECT conv_id, turn, CASE WHEN least(a, b) = 0 OR least(a, b) / greatest(a, b) < 0.3 THEN 'no' WHEN greatest(a, b) > 1000 THEN 'sampled' ELSE 'full' END AS matcher FROM n""")
def length_gate_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.length("ta"), F.length("tb")
    hopeless = F.coalesce(files.ratio(a, b), F.lit(0.0)) < matchers.LEAST_RATIO
    gate = F.when((F.least(a, b) == 0) | hopeless, F.lit("no")).when(F.greatest(a, b) > matchers.LONG, F.lit("sampled")).otherwise(F.lit("full"))
    return _turns(spark, d).select("conv_id", "turn", gate.alias("matcher"))


@query()
def seq_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _dealt_turns(spark, d).select("conv_id", "turn", F.round(matchers.seq_ratio("ta", "tb"), 6).alias("similarity"))


@query()
def sampled_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _dealt_turns(spark, d).select("conv_id", "turn", F.round(matchers.sampled_ratio("ta", "tb"), 6).alias("similarity"))


@query()
def text_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The score of the engine: normalised texts, the matcher that their lengths ask for."""
    a, b = (text.normalize(F.col(c)) for c in ("ta", "tb"))
    return _dealt_turns(spark, d).select("conv_id", "turn", F.round(matchers.text_similarity(a, b), 6).alias("similarity"))


@query()
def similarity_details(spark: SparkSession, d: str) -> DataFrame:
    out = engine.similarity_details(_dealt_turns(spark, d)).drop("ta", "tb")
    return out.withColumns({c: F.round(c, 6) for c in ("sequence_similarity", "vocabulary_similarity", "structure_similarity")})


@query(f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(ta, '[ \\n]+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(regexp_split_to_array(tb, '[ \\n]+'), lambda x: x <> '')) AS wb FROM p)
SELECT conv_id, turn, round(coalesce(100 * len(list_intersect(wa, wb)) / nullif(len(list_distinct(list_concat(wa, wb))), 0)::DOUBLE, 0), 6) AS similarity FROM w""")
def vocabulary_similarity(spark: SparkSession, d: str) -> DataFrame:
    return engine.similarity_details(_turns(spark, d)).select("conv_id", "turn", F.round("vocabulary_similarity", 6).alias("similarity"))


_VECTOR = """[CAST(len(list_filter(regexp_split_to_array({0}, '[.!?。！？]+'), lambda x: length(trim(x)) > 0)) AS DOUBLE), CAST(len(list_filter(regexp_split_to_array({0}, '[ \\n]+'), lambda x: x <> '')) AS DOUBLE), CAST(length({0}) AS DOUBLE)]"""


@query(f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, {_VECTOR.format("ta")} AS a, {_VECTOR.format("tb")} AS b FROM p),
w AS (SELECT conv_id, turn, [a[1], a[2] / greatest(a[1], 1.0), a[2] / greatest(a[3], 1.0)] AS a, [b[1], b[2] / greatest(b[1], 1.0), b[2] / greatest(b[3], 1.0)] AS b FROM s)
SELECT conv_id, turn, round(CASE WHEN list_dot_product(a, a) = 0 OR list_dot_product(b, b) = 0 THEN 0 ELSE 100 * list_cosine_similarity(a, b) END, 6) AS similarity FROM w""")
def structure_similarity(spark: SparkSession, d: str) -> DataFrame:
    return engine.similarity_details(_turns(spark, d)).select("conv_id", "turn", F.round("structure_similarity", 6).alias("similarity"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that follow each other."""
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(text.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


@query(f"WITH {IMAGES} SELECT vec_id, ahash, phash FROM img")
def ahash(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("vec_id", "ahash", "phash")


@query(f"""WITH {IMAGES} SELECT a.vec_id AS a, b.vec_id AS b, CAST(hamming(a.ahash, b.ahash) AS INTEGER) AS ahash_bits, CAST(hamming(a.phash, b.phash) AS INTEGER) AS phash_bits
FROM img a JOIN img b ON a.vec_id + 1 = b.vec_id""")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Images that follow each other."""
    i = stage(images(spark, d).select("vec_id", "a1", "a2", "p1", "p2"), "image-hashes")
    a, b = i.alias("a"), again(i).alias("b")
    h = lambda t, k: (F.col(f"{t}.{k}1"), F.col(f"{t}.{k}2"))
    both = a.join(b, F.col("a.vec_id") + 1 == F.col("b.vec_id"))
    return both.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), hashes.hamming(h("a", "a"), h("b", "a")).alias("ahash_bits"), hashes.hamming(h("a", "p"), h("b", "p")).alias("phash_bits"))


_IEDGES = f"""{IMAGES}, edge AS (SELECT a.path AS a, b.path AS b, (1 - (hamming(a.ahash, b.ahash) + hamming(a.phash, b.phash)) / 2.0::DOUBLE / 64) * 100 AS similarity
FROM img a JOIN img b ON a.label = b.label AND a.path < b.path WHERE (hamming(a.ahash, b.ahash) + hamming(a.phash, b.phash)) / 2.0::DOUBLE <= 19)"""
LOOSE = Params(similarity_threshold=70.0)


@query(f"WITH {_IEDGES} SELECT a, b, round(similarity, 6) AS similarity FROM edge")
def image_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return engine.image_edges(images(spark, d), LOOSE, "label").withColumn("similarity", F.round("similarity", 6))


def _video_pairs(spark: SparkSession, d: str, denominator: str) -> DataFrame:
    """Videos that follow each other."""
    v = stage(videos(spark, d).select("video_id", "frames"), "video-hashes")
    a, b = v.alias("a"), again(v).alias("b")
    both = a.join(b, F.col("a.video_id") + 1 == F.col("b.video_id"))
    return both.select(F.col("a.video_id").alias("a"), F.col("b.video_id").alias("b"), F.round(hashes.frame_similarity(F.col("a.frames"), F.col("b.frames"), denominator=denominator), 6).alias("similarity"))


def _video_sql(cells: int) -> str:
    return f"""WITH {VIDEOS} SELECT a.video_id AS a, b.video_id AS b, round(CASE WHEN a.n <> b.n THEN 0 ELSE greatest(0, (1 - hamming(a.bits, b.bits) / (a.n * {cells})::DOUBLE) * 100) END, 6) AS similarity
FROM vid a JOIN vid b ON a.video_id + 1 = b.video_id"""


@query(_video_sql(36))
def video_similarity_bits(spark: SparkSession, d: str) -> DataFrame:
    return _video_pairs(spark, d, "bits")


@query(_video_sql(6))
def video_similarity_rows(spark: SparkSession, d: str) -> DataFrame:
    return _video_pairs(spark, d, "rows")


@query("SELECT CAST(p AS BIGINT) AS percent, CAST(greatest(0, least(64, trunc(64 * (1 - p / 100.0::DOUBLE)))) AS INTEGER) AS bits FROM range(50, 101) t(p)")
def hash_threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(50, 101).select(F.col("id").alias("percent"), files.hash_threshold(F.col("id")).alias("bits"))


# -- clusters --------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_IEDGES}, m AS (SELECT a AS u, b AS v FROM edge UNION ALL SELECT b, a FROM edge),
walk AS (SELECT u AS node, u AS reached FROM m UNION SELECT w.node, m.v FROM walk w JOIN m ON m.u = w.reached),
best AS (SELECT u, max(similarity) AS s FROM (SELECT a AS u, similarity FROM edge UNION ALL SELECT b, similarity FROM edge) GROUP BY u),
part AS (SELECT node AS path, min(reached) AS group_id FROM walk GROUP BY node)
SELECT group_id, path, round(CASE WHEN path = group_id THEN 100 ELSE s END, 6) AS similarity FROM part JOIN best ON u = path""")
def similarity_components(spark: SparkSession, d: str) -> DataFrame:
    return engine.component_groups(engine.image_edges(images(spark, d), LOOSE, "label")).withColumn("similarity", F.round("similarity", 6))


#: Greedy leaders by path over edges (a, b, similarity).
_LEADERS = """node AS (SELECT DISTINCT unnest([a, b]) AS p FROM edge),
ordered AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM node),
step AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS lead
  UNION ALL SELECT o.k, CASE WHEN EXISTS (SELECT 1 FROM edge e WHERE e.b = o.p AND list_contains(s.lead, e.a)) THEN s.lead ELSE list_append(s.lead, o.p) END FROM step s JOIN ordered o ON o.k = s.k + 1),
led AS (SELECT unnest(lead) AS l FROM (SELECT lead FROM step ORDER BY k DESC LIMIT 1)),
claim AS (SELECT b, min(a) AS a FROM edge WHERE a IN (SELECT l FROM led) AND b NOT IN (SELECT l FROM led) GROUP BY b)
SELECT c.a AS leader, c.b AS member, round(e.similarity, 6) AS similarity FROM claim c JOIN edge e ON e.a = c.a AND e.b = c.b UNION ALL SELECT DISTINCT a, a, 100.0 FROM claim"""


@query(f"WITH RECURSIVE {_IEDGES}, {_LEADERS}")
def image_leader_groups(spark: SparkSession, d: str) -> DataFrame:
    found = engine.fingerprint_groups(images(spark, d), lambda x: engine.image_edges(x, LOOSE, "label"), "label", "a1", "a2", "p1", "p2")
    return found.withColumn("similarity", F.round("similarity", 6))


_VEDGES = f"""{VIDEOS}, edge AS (SELECT a.path AS a, b.path AS b, (1 - hamming(a.bits, b.bits) / (a.n * 36)::DOUBLE) * 100 AS similarity
FROM vid a JOIN vid b ON a.size_key = b.size_key AND a.duration_key = b.duration_key AND a.n = b.n AND a.path < b.path WHERE (1 - hamming(a.bits, b.bits) / (a.n * 36)::DOUBLE) * 100 >= 58)"""


@query(f"WITH RECURSIVE {_VEDGES}, {_LEADERS}")
def video_leader_groups(spark: SparkSession, d: str) -> DataFrame:
    """Videos in blocks of like size and duration."""
    found = engine.find_duplicates(videos(spark, d), "video", Params(similarity_threshold=58.0))
    return found.select(F.col("group_id").alias("leader"), F.col("path").alias("member"), F.round("similarity", 6).alias("similarity"))


def _near(spark: SparkSession, d: str, compat: bool) -> DataFrame:
    return engine.find_text_duplicates(text_files(spark, d), Params(compat=compat)).withColumn("similarity", F.round("similarity", 4))


@query()
def near_dup_groups_intended(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, False)


@query()
def near_dup_groups_compat(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, True)


@query()
def merged_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Exact groups, and the groups of similar files among the files outside them."""
    f = stage(spread(text_files(spark, d).select("path", "size", "text")).withColumn("id", F.monotonically_increasing_id()), "files")
    same = stage(exact.exact_groups(f).drop("content_hash"), "exact")
    links = engine.text_links(exact.without_members(f, same).select("id", "path", "size", "text"), Params().similarity_threshold)
    name = f.select("id", "path")
    named = links.join(name.toDF("a", "pa"), "a").join(name.toDF("b", "pb"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "similarity")
    return same.unionByName(engine.component_groups(named).withColumn("match_type", F.lit("similar"))).withColumn("similarity", F.round("similarity", 4))


@query()
def minhash_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.shingle_candidates(text_files(spark, d))


# -- streams ---------------------------------------------------------------------------------------


@query("SELECT DISTINCT md5(text) AS content_hash FROM documents")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of files, each text let through once; the sink is read back."""
    schema = table(spark, d, "documents").schema
    # a pattern, so that the table may be one file or a folder of files
    source = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")
    timed = source.select("text", F.timestamp_seconds(F.col("doc_id") * 3600 + 10**9).alias("mtime_ts"))
    out, log = new_path(spark, "stream"), new_path(spark, "stream-log")
    sink = incremental.first_seen(timed, delay="1000 weeks").select("content_hash").writeStream.format("parquet").option("checkpointLocation", log)
    sink.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("content_hash string").parquet(out)


@query(f"""WITH {FILES}, known AS (SELECT md5(text) AS content_hash, min(path) AS duplicate_of FROM f WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT path, md5(text) AS content_hash, duplicate_of FROM f LEFT JOIN known ON md5(text) = content_hash""")
def incremental_against_known(spark: SparkSession, d: str) -> DataFrame:
    """All documents against the stored hashes of the labelled ones."""
    f = text_files(spark, d)
    known = f.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("path", F.md5("text").alias("content_hash"))
    return incremental.against_known(f.select("path", "text"), stage(known, "known")).select("path", "content_hash", "duplicate_of")


# -- outcome ---------------------------------------------------------------------------------------


def _members(spark: SparkSession, d: str) -> DataFrame:
    """The files of groups of equal texts, with their facts."""
    f = text_files(spark, d)
    groups = exact.exact_groups(f.select("path", "text")).select("group_id", "path", "similarity", "match_type")
    facts = f.withColumns({"char_count": text.char_count(F.col("text")), "line_count": text.line_count(F.col("text"))}).drop("text")
    # read twice or more below: the members are few, the texts are not
    return stage(facts.join(groups, "path"), "members", small=True)


_MEMBERS = """m AS (SELECT min(path) OVER (PARTITION BY md5(text)) AS group_id, *, length(text) AS char_count,
  CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count, count(*) OVER (PARTITION BY md5(text)) AS n FROM f QUALIFY n > 1)"""


@query(f"WITH {FILES}, {_MEMBERS} SELECT count(DISTINCT group_id) AS n_groups, count(*) AS n_files, round(100 * count(*) / (SELECT count(*) FROM f)::DOUBLE, 6) AS rate FROM m")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return outcome.summary(_members(spark, d), text_files(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {FILES}, t AS (SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS s FROM f) SELECT n AS total_files, s AS total_size, round(s / n::DOUBLE, 6) AS avg_size, round(n / 8.0::DOUBLE, 6) AS files_per_sec, round(s / 8.0::DOUBLE / 1048576, 6) AS mb_per_sec FROM t")
def scan_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a scan that took eight seconds."""
    out = outcome.throughput(outcome.scan_stats(text_files(spark, d)), 8.0)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_size", "files_per_sec", "mb_per_sec")})


@query(f"WITH {FILES}, {_MEMBERS} SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM m WHERE path <> group_id")
def reclaimable_bytes(spark: SparkSession, d: str) -> DataFrame:
    return outcome.reclaimable(_members(spark, d))


def _keep_query(name: str, strategy: str, order: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return outcome.keepers(_members(spark, d), strategy).select("group_id", "path", "keep")

    query(f"WITH {FILES}, {_MEMBERS} SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY {order}) = 1 AS keep FROM m", name)(run)


_keep_query("keep_largest", "largest", "char_count DESC, path")
_keep_query("keep_smallest", "smallest", "size, path")
_SHOWN = "CASE " + " ".join(f"WHEN size < {1024 ** (i + 1)} THEN CAST(printf('%.1f', size / {1024**i}::DOUBLE) AS DOUBLE) * {1024**i}" for i in range(4)) + " ELSE size END"
_keep_query("keep_smallest_displayed", "smallest_displayed", f"{_SHOWN}, path")
_keep_query("keep_newest", "newest", "mtime DESC, path")
_keep_query("keep_oldest", "oldest", "mtime, path")


@query(f"WITH {FILES}, {_MEMBERS} SELECT group_id, path, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS keep FROM m")
def keep_manual(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    chosen = text_files(spark, d).join(good, "doc_id", "left_semi").select("path")
    return outcome.keepers(_members(spark, d), "manual", chosen).select("group_id", "path", "keep")


#: A name that many files share, some of its numbered forms among the originals.
_NAME_SQL = "CASE WHEN line_count % 3 = 0 THEN 'file_' || (line_count % 7 + 1) ELSE 'file' END || extension"
_FREE = """names AS (SELECT DISTINCT name FROM g), most AS (SELECT name, max(c) AS most FROM g GROUP BY name HAVING max(c) > 0),
free AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS c FROM (SELECT name, unnest(range(1, CAST(most + (SELECT count(*) FROM names) + 1 AS BIGINT))) AS k FROM most)
  WHERE regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '(\\.[^.]*)$', 1) NOT IN (SELECT name FROM names))"""


def _action_query(action: str, folder: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = _members(spark, d)
        if folder:
            named = F.when(F.col("line_count") % 3 == 0, F.concat(F.lit("file_"), (F.col("line_count") % 7 + 1).cast("string"))).otherwise(F.lit("file"))
            m = m.withColumn("path", F.concat("path", F.lit("/"), named, F.col("extension")))
        return outcome.action_plan(outcome.keepers(m, "newest"), action, folder)

    path = f"path || '/' || {_NAME_SQL}" if folder else "path"
    ranked = f"""WITH {FILES}, {_MEMBERS}, r AS (SELECT group_id, {_NAME_SQL} AS name, {path} AS path, row_number() OVER (PARTITION BY group_id ORDER BY mtime DESC, {path}) AS rank FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS c FROM r WHERE rank > 1)"""
    target = f"'{folder}/' || CASE WHEN k IS NULL THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '(\\.[^.]*)$', 1) END"
    sql = f"{ranked}, {_FREE} SELECT path, '{action}' AS action, {target} AS target, group_id FROM g LEFT JOIN free USING (name, c)" if folder else f"{ranked} SELECT path, '{action}' AS action, CAST(NULL AS VARCHAR) AS target, group_id FROM g"
    query(sql, f"action_plan_{action}")(run)


_action_query("trash", "")
_action_query("delete", "")
_action_query("backup", "/backup")
_action_query("copy", "/copies")


@query("SELECT l.doc_id, d.doc_id IS NOT NULL AS found FROM (SELECT doc_id + 3 AS doc_id FROM labels) l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id")
def validate_files(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "labels").select((F.col("doc_id") + 3).alias("path"))
    there, missing = outcome.validate(asked, table(spark, d, "documents").select(F.col("doc_id").alias("path")))
    return there.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False))).withColumnRenamed("path", "doc_id")


@query(f"WITH {FILES} SELECT CAST(sum(size) AS BIGINT) AS total_size FROM f WHERE doc_id IN (SELECT doc_id FROM labels)")
def total_size_existing(spark: SparkSession, d: str) -> DataFrame:
    f = text_files(spark, d)
    asked = f.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return outcome.total_size(asked.select("path"), f)


# -- scalars ---------------------------------------------------------------------------------------

_SIZE_SQL = "CASE " + " ".join(f"WHEN v < {1024 ** (i + 1)} THEN printf('%.1f {u}', v / {1024**i}::DOUBLE)" for i, u in enumerate(files.SIZE_UNITS[:-1])) + f" ELSE printf('%.1f PB', v / {1024**5}::DOUBLE) END"


@query(f"SELECT o_orderkey, {_SIZE_SQL} AS size_text FROM (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice) AS DOUBLE) * (1 + o_orderkey % 5000) AS v FROM orders)")
def format_size(spark: SparkSession, d: str) -> DataFrame:
    v = F.floor(F.col("o_totalprice") * F.col("o_totalprice")).cast("double") * (1 + F.col("o_orderkey") % 5000)
    return table(spark, d, "orders").select("o_orderkey", files.format_size(v).alias("size_text"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 9000 - 100 AS s FROM orders)
SELECT o_orderkey, CASE WHEN s <= 0 THEN 'N/A' WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS duration_text FROM t""")
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", files.format_duration((F.col("o_orderkey") % 9000 - 100).cast("double")).alias("duration_text"))


@query(f"""WITH t AS (SELECT o_orderkey, o_orderkey % 9000 AS s, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN s || '{files.SECOND}' WHEN s < 3600 THEN s // 60 || '{files.MINUTE}' || s % 60 || '{files.SECOND}'
ELSE s // 3600 || '{files.HOUR}' || s % 3600 // 60 || '{files.MINUTE}' || s % 60 || '{files.SECOND}' END AS time_text, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started FROM t""")
def format_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", files.format_elapsed(F.col("o_orderkey") % 9000).alias("time_text"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("""WITH t AS (SELECT p_partkey, p_size || '.5 ' || CASE p_partkey % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' WHEN 3 THEN 'GB' WHEN 4 THEN 'XB' ELSE '' END AS s, p_partkey % 6 AS k, p_size + 0.5::DOUBLE AS v FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN v WHEN 1 THEN v * 1024 WHEN 2 THEN v * 1048576 WHEN 3 THEN v * 1073741824 WHEN 4 THEN v ELSE 0 END AS bytes FROM t""")
def parse_size(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "XB", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", files.parse_size(F.concat(F.col("p_size").cast("string"), F.lit(".5 "), unit)).alias("bytes"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * p_partkey END AS pixels, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS number FROM part""")
def parse_resolution(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("p_partkey") % 3 == 0
    size = F.col("p_size").cast("string")
    pixels = files.resolution_score(F.when(odd, F.lit("N/A")).otherwise(F.concat(size, F.lit("x"), F.col("p_partkey").cast("string"))))
    return table(spark, d, "part").select("p_partkey", pixels.alias("pixels"), files.parse_number(F.when(odd, F.lit("None")).otherwise(size)).alias("number"))


_VIEW_SIZE = _SIZE_SQL.split(f" WHEN v < {1024**5}")[0] + f" ELSE printf('%.1f TB', v / {1024**4}::DOUBLE) END"


@query(f"""WITH {FILES}, {_MEMBERS}, x AS (SELECT *, CAST(size AS DOUBLE) AS v FROM m)
SELECT CAST(dense_rank() OVER (ORDER BY group_id) AS BIGINT) AS group_no, path, {_VIEW_SIZE} AS size_text, CAST(line_count AS VARCHAR) AS detail_1, CAST(char_count AS VARCHAR) AS detail_2, '100.0%' AS similarity_text FROM x""")
def results_view(spark: SparkSession, d: str) -> DataFrame:
    return outcome.results_view(_members(spark, d))


ORACLES["export_results"] = ORACLES["results_view"]


@query()
def export_results(spark: SparkSession, d: str) -> DataFrame:
    """The results view written as JSON and read back."""
    shown = outcome.results_view(_members(spark, d))
    path = new_path(spark, "export")
    outcome.export(shown, path, "json")
    return spark.read.schema(shown.schema).json(path)


@query("""SELECT 'v' || p_partkey || '.mp4' AS path, CASE WHEN p_size > 10 THEN p_size * 16 ELSE 0 END AS width, CASE WHEN p_size > 10 THEN p_size * 9 ELSE 0 END AS height,
round(CASE WHEN p_size > 10 THEN 25 ELSE 0 END::DOUBLE, 6) AS fps, CASE WHEN p_size > 10 THEN p_partkey + 1 ELSE 0 END AS frame_count,
round(CASE WHEN p_size > 10 THEN (p_partkey + 1) / 25.0::DOUBLE ELSE greatest(1.0, CAST(floor(p_retailprice * 100000) AS BIGINT) / 1048576.0::DOUBLE / 2) END, 6) AS duration FROM part""")
def video_info_join(spark: SparkSession, d: str) -> DataFrame:
    """Path facts of videos joined with a table of metadata that knows some of them."""
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("v"), F.col("p_partkey").cast("string"), F.lit(".mp4")))
    facts = p.select("path", F.floor(F.col("p_retailprice") * 100000).alias("size"))
    known = p.where("p_size > 10").select("path", (F.col("p_size") * 16).alias("width"), (F.col("p_size") * 9).alias("height"), F.lit(25.0).alias("fps"), (F.col("p_partkey") + 1).alias("frame_count"))
    return with_video_info(facts, known).drop("size").withColumn("duration", F.round("duration", 6))


@query()
def components_by_union(spark: SparkSession, d: str) -> DataFrame:
    """Connected components over plain ids: each customer is linked to one of its ten."""
    key = F.col("c_custkey")
    return connected_components(table(spark, d, "customer").select(key.alias("a"), (key - key % 10 + (key * 7 + 3) % 10).alias("b")))


ORACLES["components_by_union"] = """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - c_custkey % 10 + (c_custkey * 7 + 3) % 10 AS b FROM customer),
m AS (SELECT a AS u, b AS v FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b),
w AS (SELECT u AS node, u AS reached FROM m UNION SELECT w.node, m.v FROM w JOIN m ON m.u = w.reached)
SELECT node, min(reached) AS component FROM w GROUP BY node"""
