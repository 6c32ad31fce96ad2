"""Queries over the driver's tables, one or more for each operator, and their SQL for DuckDB.

can't express; their tests are round trips and properties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codecs, digests, filters, scalars
from .operators import chunking, compare, dedup, heuristics, inventory, ordering, selectors
from .functions import fixed, settings
from .functions.settings import Options
from .plans import archive
from .plans.corpus import CORPUS_SQL, corpus
from .plans.storage import settled, shared_path, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _digest() -> Column:
    """DuckDB has md5, and no crc32; any strong digest tells contents apart."""
    return F.md5(F.col("text").cast("binary"))


def query(sql: str | None = None):
    """Register a function under its name, with its SQL; the corpus is defined in front of it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {CORPUS_SQL} {sql}"
        return f

    return put


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(corpus(spark, sf_dir)).withColumn("body", F.col("text").cast("binary"))


# --- aggregations ---


@query("SELECT ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, sum(size) / sum(sum(size)) OVER () AS share FROM corpus GROUP BY ext")
def a1_scan_by_extension(spark, sf_dir):
    return inventory.by_extension(corpus(spark, sf_dir))


@query("""SELECT content, place, count(size) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, coalesce(sum(size) / sum(sum(size)) OVER (), 0.0) AS share
FROM (VALUES ('Png', 0), ('Jpeg', 1), ('Media', 2), ('Other', 3)) AS every(content, place)
LEFT JOIN (SELECT CASE WHEN ext IN ('jpg', 'jpeg') THEN 'Jpeg' WHEN ext IN ('png', 'apng') THEN 'Png' WHEN ext IN ('mp4', 'pdf', 'zip') THEN 'Media' ELSE 'Other' END AS content, size FROM corpus) USING (content)
GROUP BY content, place""")
def a2_scan_by_category(spark, sf_dir):
    return inventory.by_category(corpus(spark, sf_dir))


@query("SELECT count(*) AS files, CAST(0 AS BIGINT) AS dirs, CAST(0 AS BIGINT) AS symlinks, count(*) - count(size) AS unreadable, CAST(sum(size) AS BIGINT) AS bytes FROM corpus")
def a3_scan_totals(spark, sf_dir):
    return inventory.totals(corpus(spark, sf_dir))


@query("SELECT content, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM corpus GROUP BY ROLLUP (content)")
def a4_plan(spark, sf_dir):
    return inventory.plan(corpus(spark, sf_dir))


@query("SELECT CAST(quantile_disc(size, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(size, 0.95) AS BIGINT) AS p95 FROM corpus")
def a5_percentiles(spark, sf_dir):
    return inventory.percentiles(corpus(spark, sf_dir))


@query("""SELECT string_agg(printf('%s %.0f%%', lower(content), share * 100), ', ' ORDER BY share DESC) AS line
FROM (SELECT content, sum(size) / sum(sum(size)) OVER () AS share FROM corpus GROUP BY content) WHERE share >= 0.05""")
def a6_summary_line(spark, sf_dir):
    return inventory.summary_line(corpus(spark, sf_dir))


@query("""SELECT CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(files) AS BIGINT) AS file_count, string_agg(id || ':' || files || ':' || bytes, ',' ORDER BY id) AS type_dist
FROM (SELECT CASE content WHEN 'Jpeg' THEN 0 WHEN 'Png' THEN 1 WHEN 'Media' THEN 2 ELSE 3 END AS id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM corpus GROUP BY content)""")
def a7_scan_summary(spark, sf_dir):
    found = inventory.scan_summary(corpus(spark, sf_dir))
    return found.withColumn("type_dist", F.array_join(F.transform("type_dist", lambda t: F.concat_ws(":", t["kind"].cast("string"), t["count"].cast("string"), t["bytes"].cast("string"))), ","))


@query("SELECT size, md5(text) AS digest, count(*) AS n, min(rel) AS keep, size * (count(*) - 1) AS wasted FROM corpus WHERE size > 0 GROUP BY size, md5(text) HAVING count(*) >= 2")
def a8_dedupe_groups(spark, sf_dir):
    return dedup.groups(corpus(spark, sf_dir), _digest())


@query("""SELECT size, digest, rel, CASE WHEN rel = min(rel) OVER (PARTITION BY size, digest) THEN 'keep' ELSE 'dupe' END AS role
FROM (SELECT size, md5(text) AS digest, rel, count(*) OVER (PARTITION BY size, md5(text)) AS n FROM corpus WHERE size > 0) WHERE n >= 2""")
def a8_dedupe_members(spark, sf_dir):
    return dedup.members(corpus(spark, sf_dir), _digest())


@query("""SELECT (SELECT count(*) FROM corpus WHERE size > 0) AS scanned, count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(size * (n - 1)), 0) AS BIGINT) AS wasted
FROM (SELECT size, count(*) AS n FROM corpus WHERE size > 0 GROUP BY size, md5(text) HAVING count(*) >= 2)""")
def a8_dedupe_report(spark, sf_dir):
    return dedup.report(corpus(spark, sf_dir), _digest())


@query("""SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS stored, sum(length(text)) / sum(size) AS ratio,
CASE WHEN sum(length(text)) / sum(size) >= 0.95 THEN 'poor' WHEN sum(length(text)) / sum(size) < 0.8 THEN 'good' ELSE 'neutral' END AS grade FROM corpus""")
def a9_archive_totals(spark, sf_dir):
    """Characters stand for stored bytes, so that SQL has the same figures."""
    return inventory.archive_totals(corpus(spark, sf_dir).withColumn("stored_size", F.length("text")))


@query("""SELECT count(*) AS entries, count(*) FILTER (WHERE NOT bad) AS verified, count(*) FILTER (WHERE bad) AS failed, CAST(sum(size) AS BIGINT) AS bytes,
(SELECT string_agg(rel, ',' ORDER BY rel) FROM (SELECT rel FROM corpus WHERE doc_id % 17 = 3 AND size > 0 ORDER BY rel LIMIT 20)) AS failed_paths, count(*) FILTER (WHERE bad) - least(20, count(*) FILTER (WHERE bad)) AS more
FROM (SELECT *, doc_id % 17 = 3 AND size > 0 AS bad FROM corpus)""")
def a10_test_tally(spark, sf_dir):
    """Every seventeenth body loses its first character after its digest is stored."""
    stored = corpus(spark, sf_dir).withColumn("stored", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    read = stored.withColumn("text", F.when(F.pmod("doc_id", F.lit(17)) == 3, F.expr("substring(text, 2)")).otherwise(F.col("text")))
    ok = (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) == F.col("stored")) & (F.coalesce(F.octet_length("text"), F.lit(0)) == F.col("size"))
    tally = inventory.test_tally(read.select("rel", "kind", "size", ok.alias("ok")))
    return tally.withColumn("failed_paths", F.array_join("failed_paths", ",")).withColumn("more", F.col("more").cast("long"))


_DUPS = """dups AS (SELECT *, row_number() OVER (PARTITION BY size, md5(text) ORDER BY ext, lower(regexp_extract(rel, '^(.*)/[^/]*$', 1)), size, lower(rel), rel) AS place,
    first_value(rel) OVER (PARTITION BY size, md5(text) ORDER BY ext, lower(regexp_extract(rel, '^(.*)/[^/]*$', 1)), size, lower(rel), rel) AS canonical_rel FROM corpus WHERE size > 0)"""


@query(f"WITH {CORPUS_SQL}, {_DUPS} SELECT CAST((SELECT sum(size) FROM corpus) - coalesce(sum(size) FILTER (WHERE place > 1), 0) AS BIGINT) AS packable FROM dups")
def a11_packable_bytes(spark, sf_dir):
    every = corpus(spark, sf_dir)
    return inventory.packable(every, dedup.duplicates(every, _digest()))


@query("SELECT CAST(sum(size) FILTER (WHERE media) AS BIGINT) AS media, CAST(sum(size) FILTER (WHERE NOT media) AS BIGINT) AS other, sum(size) FILTER (WHERE media) / sum(size) AS share FROM (SELECT size, ext IN ('jpg', 'png', 'mp4', 'pdf', 'jpeg', 'deb', 'zip') AS media FROM corpus)")
def a12_media_share(spark, sf_dir):
    return inventory.media_share(corpus(spark, sf_dir))


@query("SELECT count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE content = 'Jpeg') AS jpeg, count(*) FILTER (WHERE content = 'Png') AS png FROM corpus")
def a13_pack_counters(spark, sf_dir):
    kind = scalars.content_kind(F.col("ext"))
    return inventory.pack_counters(corpus(spark, sf_dir).withColumn("kind", F.when(kind == "Jpeg", 5).when(kind == "Png", 6).otherwise(0)))


_BUCKET = "CASE WHEN ext IN ('jpg', 'png', 'mp4', 'pdf', 'jpeg', 'deb', 'zip') THEN 'media' ELSE 'default' END"


@query(f"SELECT bucket, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM corpus WHERE size > 0 GROUP BY 1, size, md5(text) HAVING count(*) > 1) GROUP BY bucket")
def a14_duplicates_by_bucket(spark, sf_dir):
    return dedup.counted(dedup.duplicates(ordering.route(corpus(spark, sf_dir)), _digest(), "bucket"), "bucket")


# --- deduplication ---


@query(f"WITH {CORPUS_SQL}, {_DUPS} SELECT full_path AS \"full\", rel, canonical_rel FROM dups WHERE place > 1")
def d1_dedup_map(spark, sf_dir):
    return dedup.duplicates(corpus(spark, sf_dir), _digest())


def _dups_within(expr: str, name: str) -> str:
    key = "ext, lower(regexp_extract(rel, '^(.*)/[^/]*$', 1)), size, lower(rel), rel"
    return f"""SELECT {name}, full_path AS "full", rel, canonical_rel FROM (SELECT *, row_number() OVER (PARTITION BY {name}, size, md5(text) ORDER BY {key}) AS place,
    first_value(rel) OVER (PARTITION BY {name}, size, md5(text) ORDER BY {key}) AS canonical_rel FROM (SELECT *, {expr} AS {name} FROM corpus) WHERE size > 0) WHERE place > 1"""


@query(_dups_within(_BUCKET, "bucket"))
def d2_dedup_by_bucket(spark, sf_dir):
    return dedup.duplicates(ordering.route(corpus(spark, sf_dir)), _digest(), "bucket")


@query(_dups_within("doc_id // 250", "batch"))
def d3_dedup_by_batch(spark, sf_dir):
    return dedup.duplicates(corpus(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 250)), _digest(), "batch")


@query(f"WITH {CORPUS_SQL}, {_DUPS} SELECT rel, CASE WHEN place > 1 THEN 3 ELSE 0 END AS kind, CASE WHEN place > 1 THEN 0 ELSE size END AS size, CASE WHEN place > 1 THEN canonical_rel ELSE '' END AS link_target FROM dups UNION ALL SELECT rel, 0, size, '' FROM corpus WHERE size = 0")
def d4_hardlink_entries(spark, sf_dir):
    every = corpus(spark, sf_dir)
    return dedup.linked(every, dedup.duplicates(every, _digest()))


# --- selectors ---


@query("SELECT rel, size FROM corpus WHERE NOT (contains(rel, '/de/') OR contains(rel, '7.'))")
def f1_exclude(spark, sf_dir):
    return selectors.select(corpus(spark, sf_dir), selectors.Selection(exclude=["/de/", "7."])).select("rel", "size")


@query("SELECT rel, size FROM corpus WHERE size >= 1536 AND size <= 10240")
def f2_f3_size_range(spark, sf_dir):
    chosen = selectors.Selection(min_size=scalars.parse_size("1.5k"), max_size=scalars.parse_size("10KB"))
    return selectors.select(corpus(spark, sf_dir), chosen).select("rel", "size")


@query("SELECT rel, mtime FROM corpus WHERE mtime >= epoch(TIMESTAMP '2020-06-01') AND mtime <= epoch(TIMESTAMP '2021-03-15')")
def f4_f5_date_range(spark, sf_dir):
    chosen = selectors.Selection(date_from=scalars.parse_date("2020-06-01"), date_to=scalars.parse_date("2021-03-15"))
    return selectors.select(corpus(spark, sf_dir), chosen).select("rel", "mtime")


@query("WITH x AS (SELECT 1) SELECT event_id FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-05') AND epoch(ts) <= epoch(TIMESTAMP '2024-01-20')")
def f4_f5_events(spark, sf_dir):
    """The same over event times."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("").alias("rel"), F.lit(True).alias("is_regular"), F.lit(0).alias("size"), F.col("ts").cast("timestamp").cast("double").alias("mtime"))
    return selectors.select(rows, selectors.Selection(date_from=scalars.parse_date("2024-01-05"), date_to=scalars.parse_date("2024-01-20"))).select("event_id")


@query("SELECT rel, size FROM corpus WHERE contains(lower(rel), 'src1') AND contains(lower(rel), '.png') OR contains(lower(rel), 'src7/en')")
def f6_find(spark, sf_dir):
    every = corpus(spark, sf_dir)
    both = selectors.find(selectors.find(every, ["SRC1"]), [".png"])
    return both.unionByName(selectors.find(every, ["Src7/EN"])).select("rel", "size")


@query("SELECT content, count(*) AS n FROM corpus WHERE doc_id % 7 IN (0, 4, 5, 6) GROUP BY content")
def f7_file_like(spark, sf_dir):
    typed = corpus(spark, sf_dir).withColumn("kind", F.pmod("doc_id", F.lit(7)))
    return selectors.file_like(typed).groupBy(scalars.content_kind(F.col("ext")).alias("content")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM corpus WHERE size > 0")
def f8_hashable(spark, sf_dir):
    return selectors.hashable(corpus(spark, sf_dir)).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"SELECT ext, count(*) AS n FROM corpus WHERE {_BUCKET} = 'media' GROUP BY ext")
def f9_media(spark, sf_dir):
    return selectors.media(corpus(spark, sf_dir)).groupBy("ext").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM corpus WHERE size > 0 AND 10 * length(regexp_replace(text, '[^\\t\\n\\r\\x20-\\x7e]', '', 'g')) >= 9 * size")
def f10_looks_like_text(spark, sf_dir):
    return selectors.texts(_bodies(spark, sf_dir)).select("doc_id")


@query("SELECT count(*) AS before, count(*) FILTER (WHERE size < 1024 OR contains(rel, '/fr/')) AS skipped, count(*) FILTER (WHERE NOT (size < 1024 OR contains(rel, '/fr/'))) AS kept FROM corpus")
def f11_skipped(spark, sf_dir):
    return selectors.skipped(corpus(spark, sf_dir), selectors.Selection(exclude=["/fr/"], min_size=1024))


# --- scalar functions ---


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS ext, 'Other' AS content FROM p")
def x1_x2_url_extension(spark, sf_dir):
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    found = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.extension(path).alias("ext"))
    return found.withColumn("content", scalars.content_kind(F.col("ext")))


_BIG = "size * size * (doc_id % 5 + 1)"


@query(f"""SELECT doc_id, CASE WHEN n >= 1099511627776 THEN printf('%.2f TB', n / 1099511627776.0) WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE printf('%.2f B', n * 1.0) END AS human,
CASE WHEN n >= 1099511627776 THEN printf('%7.2f TB', n / 1099511627776.0) WHEN n >= 1073741824 THEN printf('%7.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%7.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%7.2f KB', n / 1024.0) ELSE printf('%7.2f  B', n * 1.0) END AS padded,
replace(format('{{:,}}', n), ',', '.') AS dotted, printf('%02d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) AS clock
FROM (SELECT doc_id, {_BIG} AS n FROM corpus)""")
def x3_x6_numbers(spark, sf_dir):
    n = F.col("size") * F.col("size") * (F.pmod("doc_id", F.lit(5)) + 1)
    rows = corpus(spark, sf_dir).select("doc_id", n.alias("n"))
    return rows.select("doc_id", scalars.human_size(F.col("n")).alias("human"), scalars.human_size_padded(F.col("n")).alias("padded"), scalars.dotted(F.col("n")).alias("dotted"), scalars.clock(F.col("n")).alias("clock"))


@query("WITH t AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + (event_id % 3 - 1) * 864000 AS m FROM events) SELECT event_id, strftime(make_timestamp(greatest(m, 0) * 1000000), '%Y-%m-%d %H:%M:%S') AS shown, CASE WHEN m <= 0 THEN repeat(' ', 19) ELSE strftime(make_timestamp(m * 1000000), '%Y-%m-%d %H:%M:%S') END AS listed FROM t")
def x9_times(spark, sf_dir):
    m = F.floor(F.col("ts").cast("timestamp").cast("double")) - 1704067200 + (F.pmod("event_id", F.lit(3)) - 1) * 864_000
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", m.cast("long").alias("m"))
    return rows.select("event_id", scalars.shown_time(F.col("m")).alias("shown"), scalars.listed_time(F.col("m")).alias("listed"))


@query("SELECT doc_id, ['     ', '<dir>', '<lnk>', '<hln>', '<cdc>', '<pjg>', '<ppg>'][doc_id % 7 + 1] AS tag, replace(replace(rel, '/', '\\'), '\\', '/') AS rel FROM corpus")
def x11_x15_tags_and_slashes(spark, sf_dir):
    back = F.translate("rel", "/", "\\")
    return corpus(spark, sf_dir).select("doc_id", scalars.kind_tag(F.pmod("doc_id", F.lit(7))).alias("tag"), scalars.slashes(back).alias("rel"))


@query("""SELECT doc_id, coalesce(length(text) / nullif(size, 0), 0.0) AS ratio, CASE WHEN coalesce(length(text) / nullif(size, 0), 0.0) >= 0.95 THEN 'poor' WHEN coalesce(length(text) / nullif(size, 0), 0.0) < 0.8 THEN 'good' ELSE 'neutral' END AS grade,
coalesce(size / 1048576.0 / nullif(doc_id % 4, 0), 0.0) AS rate FROM corpus""")
def x12_x14_ratios(spark, sf_dir):
    ratio = scalars.share(F.length("text"), F.col("size"))
    return corpus(spark, sf_dir).select("doc_id", ratio.alias("ratio"), scalars.ratio_class(ratio).alias("grade"), scalars.throughput(F.col("size"), F.pmod("doc_id", F.lit(4))).alias("rate"))


@query()
def x16_x18_digests(spark, sf_dir):
    """crc32, xxh3 and blake3 of each document, and their stored forms."""
    rows = _bodies(spark, sf_dir)
    return rows.select("doc_id", digests.crc32(F.col("body")).alias("crc32"), digests.xxh3(F.col("body")).alias("xxh3"), F.hex(digests.blake3_digest(F.col("body"))).alias("blake3"), F.hex(digests.trailer(F.col("body"), "crc32")).alias("trailer"))


@query(f"SELECT doc_id, CASE WHEN n < 67108864 THEN 65536 WHEN n < 536870912 THEN 112640 WHEN n < 2147483648 THEN 196608 ELSE 262144 END AS dictionary FROM (SELECT doc_id, {_BIG} * 10 AS n FROM corpus)")
def x23_dictionary_size(spark, sf_dir):
    n = F.col("size") * F.col("size") * (F.pmod("doc_id", F.lit(5)) + 1) * 10
    return corpus(spark, sf_dir).select("doc_id", scalars.dictionary_size(n).alias("dictionary"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Jpeg' WHEN 1 THEN 'Png' ELSE 'Other' END AS content FROM corpus")
def s12_sniff(spark, sf_dir):
    """Bodies with the first bytes of an image put in front of some."""
    head = F.element_at(F.array(F.lit(b"\xff\xd8"), F.lit(b"\x89PNG"), F.lit(b"\xff"), F.lit(b"MZ")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return _bodies(spark, sf_dir).select("doc_id", scalars.sniffed(F.concat(head, F.coalesce("body", F.lit(b"")))).alias("content"))


# --- joins and set operations ---

_SIDES = """a AS (SELECT rel, size, md5(text) AS crc32 FROM corpus WHERE doc_id % 10 <> 0),
b AS (SELECT rel, CASE WHEN doc_id % 7 = 2 THEN size + 1 ELSE size END AS size, md5(CASE WHEN doc_id % 7 = 2 THEN text || 'x' ELSE text END) AS crc32 FROM corpus WHERE doc_id % 11 <> 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the corpus: some entries are in one only, some differ. Digests stand under the name crc32."""
    every = corpus(spark, sf_dir)
    edited = F.when(F.pmod("doc_id", F.lit(7)) == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    a = every.where("doc_id % 10 <> 0").select("rel", "size", _digest().alias("crc32"))
    b = every.where("doc_id % 11 <> 0").select("rel", F.when(F.pmod("doc_id", F.lit(7)) == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.md5(edited.cast("binary")).alias("crc32"))
    return a, b


_COMPARED = "SELECT rel, CASE WHEN b.size IS NULL THEN 'only<A' WHEN a.size IS NULL THEN 'only>B' WHEN a.size <> b.size OR a.crc32 <> b.crc32 THEN 'differ' ELSE 'match' END AS status FROM a FULL JOIN b USING (rel)"


@query(f"WITH {CORPUS_SQL}, {_SIDES} {_COMPARED}")
def j1_compare(spark, sf_dir):
    return compare.compare(*_sides(spark, sf_dir))


@query(f"WITH {CORPUS_SQL}, {_SIDES} SELECT status, count(*) AS n FROM ({_COMPARED}) GROUP BY status")
def j1_compare_counts(spark, sf_dir):
    return compare.compared_counts(*_sides(spark, sf_dir))


_VERIFIED = "SELECT rel, CASE WHEN b.size IS NULL THEN 'miss' WHEN a.size <> b.size OR a.crc32 <> b.crc32 OR bad OR unread THEN 'diff' ELSE 'ok' END AS status FROM (SELECT *, size % 13 = 5 AS bad, size % 17 = 3 AS unread FROM a) AS a LEFT JOIN b USING (rel)"


def _archived(a: DataFrame) -> DataFrame:
    """Side A as an archive in which some stored digests are wrong and some bodies, being lost, have none."""
    lost = F.when(F.col("size") % 17 != 3, F.col("crc32"))
    return a.withColumn("kind", F.lit(0)).withColumn("stored_crc32", F.when(F.col("size") % 13 == 5, "wrong").otherwise(F.col("crc32"))).withColumn("crc32", lost)


@query(f"WITH {CORPUS_SQL}, {_SIDES} {_VERIFIED}")
def j2_verify(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return compare.verify(_archived(a), b)


@query(f"WITH {CORPUS_SQL}, {_SIDES} SELECT count(*) AS entries, count(*) FILTER (WHERE status = 'miss') AS miss, count(*) FILTER (WHERE status = 'diff') AS diff, count(*) FILTER (WHERE status = 'ok') AS ok FROM ({_VERIFIED})")
def j2_verify_counts(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return compare.verified_counts(_archived(a), b)


@query("WITH x AS (SELECT 1) SELECT lang, count(*) AS documents, count(doc) AS labelled, count(*) - count(doc) AS missing FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS doc FROM labels) ON doc_id = doc GROUP BY lang")
def j2_label_coverage(spark, sf_dir):
    """Documents against labels: natural misses of a left join."""
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc")).distinct()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return docs.join(known, F.col("doc_id") == F.col("doc"), "left").groupBy("lang").agg(F.count("*").alias("documents"), F.count("doc").alias("labelled"), (F.count("*") - F.count("doc")).alias("missing"))


@query(f"WITH {CORPUS_SQL}, {_DUPS} SELECT rel, size FROM dups WHERE place = 1 UNION ALL SELECT rel, size FROM corpus WHERE size = 0")
def j3_entries_to_compress(spark, sf_dir):
    every = corpus(spark, sf_dir)
    return every.join(dedup.duplicates(every, _digest()).select("full"), "full", "left_anti").select("rel", "size")


@query(f"WITH {CORPUS_SQL}, {_DUPS} SELECT d.canonical_rel AS link_target, d.rel, 0 AS target_kind, d.size AS target_size, true AS found FROM dups d WHERE place > 1")
def j4_resolved_links(spark, sf_dir):
    every = corpus(spark, sf_dir)
    return compare.resolved_links(dedup.linked(every, dedup.duplicates(every, _digest())))


@query("SELECT 'documents' AS source, doc_id AS id FROM corpus UNION ALL SELECT 'pages', page_id FROM pages UNION ALL SELECT 'benchmark', item_id FROM benchmark")
def u1_union_of_sources(spark, sf_dir):
    read = lambda name, key: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.lit(name).alias("source"), F.col(key).alias("id"))
    return read("documents", "doc_id").unionByName(read("pages", "page_id")).unionByName(read("benchmark", "item_id"))


@query(f"WITH {CORPUS_SQL}, {_SIDES} SELECT 'a' AS side, rel FROM a WHERE rel NOT IN (SELECT rel FROM b) UNION ALL SELECT 'b', rel FROM b WHERE rel NOT IN (SELECT rel FROM a)")
def u3_only_on_one_side(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return compare.only(a, b).select(F.lit("a").alias("side"), "rel").unionByName(compare.only(b, a).select(F.lit("b").alias("side"), "rel"))


@query(f"WITH {CORPUS_SQL}, {_SIDES} SELECT * FROM a INTERSECT ALL SELECT * FROM b")
def u4_matching(spark, sf_dir):
    return compare.matching(*_sides(spark, sf_dir)).select("rel", "size", "crc32")


# --- orders, limits, partitions ---

_SOLID = "ext, lower(regexp_extract(rel, '^(.*)/[^/]*$', 1)), size, lower(rel), rel"


@query(f"SELECT rel, row_number() OVER (ORDER BY {_SOLID}) - 1 AS position FROM corpus")
def o1_solid_sort(spark, sf_dir):
    return ordering.solid_position(corpus(spark, sf_dir)).select("rel", "position")


@query("SELECT rel, size FROM corpus WHERE doc_id % 17 = 3 ORDER BY rel LIMIT 20")
def o5_first_failed(spark, sf_dir):
    return ordering.first(corpus(spark, sf_dir).where("doc_id % 17 = 3"), 20).select("rel", "size")


@query(f"""SELECT rel, head, running FROM (SELECT rel, least(size, 4096) AS head, CAST(coalesce(sum(least(size, 4096)) OVER (ORDER BY {_SOLID} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS running FROM corpus WHERE size > 0) WHERE running < 262144""")
def o7_dictionary_sample(spark, sf_dir):
    return ordering.sampled(corpus(spark, sf_dir), 1 << 18, 4096).select("rel", "head", "running")


@query(f"SELECT rel, {_BUCKET} AS bucket FROM corpus")
def o8_o9_route(spark, sf_dir):
    """Media have more than a fifth of the bytes here, so they keep a bucket of their own."""
    return ordering.route(corpus(spark, sf_dir)).select("rel", "bucket")


@query("SELECT rel, 'default' AS bucket FROM corpus")
def o9_route_gate(spark, sf_dir):
    """With a gate above the media's share all entries stay together."""
    return ordering.route(corpus(spark, sf_dir), gate=0.99).select("rel", "bucket")


@query("""WITH RECURSIVE w AS (SELECT row_number() OVER (ORDER BY doc_id) AS position, CAST(strlen(text) AS BIGINT) AS size FROM documents),
f AS (SELECT 1 AS pos, 1 AS part, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS position, CAST(NULL AS BIGINT) AS size, CAST(NULL AS INTEGER) AS own
UNION ALL SELECT pos + 1, CASE WHEN f.n + w.size > 200000 THEN part + 1 ELSE part END, CASE WHEN f.n + w.size > 200000 THEN 0 ELSE f.n + w.size END, w.position, w.size, part FROM f JOIN w ON w.position = pos)
SELECT position, size, own AS part FROM f WHERE position IS NOT NULL""")
def k5_split_parts(spark, sf_dir):
    """Documents by id stand for the buffers of one archive."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    placed = ordering.numbered(docs, [F.col("doc_id")], "position")
    return ordering.split_parts(placed.select((F.col("position") + 1).alias("position"), "size"), 200_000)


# --- heuristics ---


@query(f"""WITH {CORPUS_SQL}, f AS (SELECT doc_id, size FROM corpus ORDER BY {_SOLID} LIMIT 64)
SELECT count(*) AS samples, count(*) FILTER (WHERE doc_id % 3 = 0) AS hits, CASE WHEN count(*) >= 4 AND count(*) FILTER (WHERE doc_id % 3 = 0) * 10 >= count(*) * 3 THEN 'x86' ELSE 'none' END AS branch FROM f WHERE size + 2 >= 20""")
def h1_executables(spark, sf_dir):
    """Every third body begins with MZ."""
    head = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(b"MZ")).otherwise(F.lit(b"--"))
    return heuristics.executable(_bodies(spark, sf_dir).withColumn("body", F.concat(head, F.coalesce("body", F.lit(b"")))))


# --- chunks, filters, codecs ---


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language whose ids share their last digits but two, as one body each: near 100 documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    block = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    grouped = docs.groupBy(block.alias("rel")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    return grouped.select("rel", F.array_join(F.transform("d", lambda x: x["text"]), "\n").cast("binary").alias("body"))


_V = """v AS (SELECT coalesce(lang, '') || '/' || doc_id // 100 AS path, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents WHERE text IS NOT NULL GROUP BY 1)"""


@query()
def t1_chunks(spark, sf_dir):
    return chunking.chunked(_volumes(spark, sf_dir)).drop("payload")


@query(f"WITH {_V} SELECT path, CAST(strlen(body) AS BIGINT) AS bytes, true AS gapless, true AS bounded FROM v WHERE strlen(body) > 0")
def t1_chunk_cover(spark, sf_dir):
    """The chunks of each volume cover it: they follow each other without gaps, and all but the last have lengths in bounds."""
    chunks = chunking.chunked(_volumes(spark, sf_dir)).select("path", "seq", "offset", "len")
    w = Window.partitionBy("path").orderBy("seq")
    told = chunks.withColumn("fits", F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("len")).over(w), F.lit(0))).withColumn("ends", F.lead("seq").over(w).isNull())
    bounded = F.col("ends") | F.col("len").between(fixed.CHUNK_MIN, fixed.CHUNK_MAX)
    return told.groupBy("path").agg(F.sum("len").alias("bytes"), F.every(F.col("fits")).alias("gapless"), F.every(bounded).alias("bounded"))


@query()
def d6_chunk_registry(spark, sf_dir):
    return chunking.registry(settled(chunking.chunked(_volumes(spark, sf_dir)), "chunks")).drop("payload")


@query(f"WITH {_V} SELECT count(*) AS files, CAST(sum(strlen(body)) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS dangling, true AS gapless_ids, true AS first_seen_in_order FROM v WHERE strlen(body) > 0")
def d6_t2_recipe_checks(spark, sf_dir):
    """What recipes and the registry say together: all files and bytes are there, ids have no gaps, and each first sight of
    a chunk, by path and place, has a greater id than the one before."""
    chunks = settled(chunking.chunked(_volumes(spark, sf_dir)), "chunks")
    known = settled(chunking.registry(chunks), "registry")
    recipe = chunking.recipes(chunks, known).join(known.select("chunk_id", "len"), "chunk_id", "left")
    n = known.count()
    firsts = recipe.where("NOT is_ref").select("path", "seq", "chunk_id")
    ordered = firsts.withColumn("grows", F.col("chunk_id") > F.coalesce(F.lag("chunk_id").over(Window.partitionBy("path").orderBy("seq")), F.lit(-1))).agg(F.every(F.col("grows")).alias("first_seen_in_order"), (F.count_distinct("chunk_id") == n).alias("every"), (F.coalesce(F.max("chunk_id"), F.lit(-1)) == n - 1).alias("top"))
    whole = recipe.agg(F.count_distinct("path").alias("files"), F.sum("len").cast("long").alias("bytes"), F.count_if(F.col("chunk_id").isNull()).alias("dangling"))
    return whole.join(F.broadcast(ordered)).select("files", "bytes", "dangling", (F.col("every") & F.col("top")).alias("gapless_ids"), "first_seen_in_order")


@query()
def t2_recipes(spark, sf_dir):
    chunks = settled(chunking.chunked(_volumes(spark, sf_dir)), "chunks")
    return chunking.recipes(chunks, chunking.registry(chunks))


@query("""WITH v AS (SELECT coalesce(lang, '') || '/' || doc_id // 100 AS path, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT path, CAST(0 AS BIGINT) AS dangling, sha256(body) AS digest FROM v WHERE strlen(body) > 0""")
def j5_reassembled(spark, sf_dir):
    """Chunked, deduplicated and put together again."""
    chunks = settled(chunking.chunked(_volumes(spark, sf_dir)), "chunks")
    known = settled(chunking.registry(chunks), "registry")
    return chunking.reassembled(chunking.recipes(chunks, known), known).select("path", "dangling", F.sha2("body", 256).alias("digest"))


@query()
def d6_chunk_savings(spark, sf_dir):
    return chunking.savings(chunking.chunked(_volumes(spark, sf_dir)))


def _filtered(name: str):
    def run(spark, sf_dir):
        rows = _bodies(spark, sf_dir).where("body IS NOT NULL").select("doc_id", F.md5("body").alias("digest"), codecs.filtered(F.col("body"), name).alias("coded"))
        return rows.select("doc_id", (F.md5(codecs.unfiltered(F.col("coded"), name)) == F.col("digest")).alias("same"))

    return run


for _id, _name in (("t3", "rep"), ("t4", "srep"), ("t6", "lzp"), ("t7", "delta1"), ("t7", "delta2"), ("t7", "delta4"), ("t8", "words")):
    QUERIES[f"{_id}_{_name}_round_trip"] = _filtered(_name)
    ORACLES[f"{_id}_{_name}_round_trip"] = "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL"


@query()
def t_filter_ratios(spark, sf_dir):
    """Bytes after each filter, of bodies of near 100 documents."""
    rows = _volumes(spark, sf_dir)
    return rows.select("rel", F.octet_length("body").alias("bytes"), *(F.octet_length(codecs.filtered(F.col("body"), n)).alias(n) for n in filters.FILTERS))


def _coded(codec: str, level: int):
    def run(spark, sf_dir):
        rows = _volumes(spark, sf_dir).select("rel", F.md5("body").alias("digest"), codecs.encoded(F.col("body"), codec, level).alias("coded"))
        return rows.select("rel", (F.md5(codecs.decoded(F.col("coded"), codec)) == F.col("digest")).alias("same"))

    return run


for _codec, _level in (("zstd", 1), ("zstd", 3), ("store", 0), ("lzma", 5)):
    _key = {"zstd": "c1", "lzma": "c2", "store": "c6"}[_codec] + f"_{_codec}_{_level}_round_trip"
    QUERIES[_key] = _coded(_codec, _level)
    ORACLES[_key] = "SELECT DISTINCT coalesce(lang, '') || '/' || doc_id // 100 AS rel, true AS same FROM documents WHERE text IS NOT NULL"


@query()
def c1_codec_ratios(spark, sf_dir):
    """Bytes, stored bytes and ratio by codec and level."""
    rows = _volumes(spark, sf_dir).withColumn("kind", F.lit(0)).withColumn("size", F.octet_length("body"))
    each = [inventory.archive_totals(rows.withColumn("stored_size", F.octet_length(codecs.encoded(F.col("body"), c, n)))).withColumn("codec", F.lit(f"{c}-{n}")) for c, n in (("store", 0), ("zstd", 1), ("zstd", 3))]
    return each[0].unionByName(each[1]).unionByName(each[2])


# --- archives and options ---


def _packable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as entries of an archive; null texts are empty files."""
    rows = spread(corpus(spark, sf_dir)).withColumn("body", F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("full", "rel", "kind", "is_regular", "size", "mtime", F.lit(0o644).alias("mode"), F.lit("").alias("link_target"), "ext", "body", "doc_id")


@query(f"WITH {CORPUS_SQL}, {_DUPS} SELECT rel, CASE WHEN place > 1 THEN 3 ELSE 0 END AS kind, CASE WHEN place > 1 THEN 0 ELSE size END AS size, CASE WHEN place > 1 THEN canonical_rel ELSE '' END AS link_target, mtime FROM dups UNION ALL SELECT rel, 0, size, '', mtime FROM corpus WHERE size = 0")
def k1_pack_and_list(spark, sf_dir):
    """An archive is written and its entries are listed."""
    path = shared_path(spark, "archive")
    archive.pack(_packable(spark, sf_dir), path, Options(level=1))
    return archive.listing(spark, path).select("rel", "kind", "size", "link_target", "mtime")


@query("""SELECT count(*) AS entries, count(*) FILTER (WHERE NOT link) AS verified, CAST(0 AS BIGINT) AS failed, CAST(sum(size) FILTER (WHERE NOT link) AS BIGINT) AS bytes, '' AS failed_paths, CAST(0 AS BIGINT) AS more
FROM (SELECT size, size > 0 AND row_number() OVER (PARTITION BY doc_id % 3 = 0, size, md5(text) ORDER BY rel) > 1 AS link FROM corpus)""")
def k4_append_and_test(spark, sf_dir):
    """A third of the corpus is packed, the rest appended, and all bodies are checked."""
    path, every = shared_path(spark, "archive"), _packable(spark, sf_dir)
    archive.pack(every.where("doc_id % 3 = 0"), path, Options(level=1), "xxh3")
    archive.append(every.where("doc_id % 3 <> 0"), path)
    tally = archive.test(spark, path)
    return tally.withColumn("failed_paths", F.array_join("failed_paths", ",")).withColumn("more", F.col("more").cast("long"))


@query(f"WITH {CORPUS_SQL}, dups AS ({_dups_within(_BUCKET, 'bucket')}) SELECT rel, md5(coalesce(text, '')) AS digest FROM corpus WHERE rel NOT IN (SELECT rel FROM dups)")
def s6_archive_bodies(spark, sf_dir):
    """Bodies read from a routed archive."""
    path = shared_path(spark, "archive")
    archive.pack(_packable(spark, sf_dir), path, Options(level=3, route=True), comment="routed")
    return archive.bodies(spark, path).select("rel", F.md5("body").alias("digest"))


_UNIQUE = f"WITH {CORPUS_SQL}, {_DUPS} SELECT rel, md5(text) AS digest FROM dups WHERE place = 1 UNION ALL SELECT rel, md5('') FROM corpus WHERE size = 0"


@query(_UNIQUE)
def k5_pack_and_read_parts(spark, sf_dir):
    """An archive in parts of 50,000 stored bytes, read back from them."""
    path = shared_path(spark, "archive")
    archive.pack(_packable(spark, sf_dir), path, Options(level=1, split=50_000))
    return archive.bodies(spark, path).select("rel", F.md5("body").alias("digest"))


@query(_UNIQUE)
def t4_pack_srep(spark, sf_dir):
    """Bodies read from an archive whose bodies went through the long-range filter before the strongest codec."""
    path = shared_path(spark, "archive")
    archive.pack(_packable(spark, sf_dir), path, Options(level=5, preproc="srep"))
    return archive.bodies(spark, path).select("rel", F.md5("body").alias("digest"))


@query(f"""WITH {CORPUS_SQL}, f AS (SELECT doc_id, size FROM corpus ORDER BY {_SOLID} LIMIT 64)
SELECT CASE WHEN count(*) >= 4 AND count(*) FILTER (WHERE doc_id % 3 = 0) * 10 >= count(*) * 3 THEN 'x86' ELSE 'none' END AS branch, (SELECT count(*) FROM corpus) AS entries, CAST(0 AS BIGINT) AS failed FROM f WHERE size + 2 >= 20""")
def h1_pack_branch(spark, sf_dir):
    """The branch filter that a pack chooses by the first entries, every third of which begins with MZ; all are checked."""
    path = shared_path(spark, "archive")
    head = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(b"MZ")).otherwise(F.lit(b"--"))
    rows = _packable(spark, sf_dir).withColumn("body", F.concat(head, "body")).withColumn("size", F.col("size") + 2)
    archive.pack(rows, path, Options(level=5))
    return archive.test(spark, path).select(F.lit(archive.meta(spark, path)["branch"] or "none").alias("branch"), "entries", "failed")


@query("WITH x AS (SELECT 1) SELECT * FROM (VALUES ('size', '10', 10), ('size', '1.5k', 1536), ('size', '2KiB', 2048), ('size', '3MB', 3145728), ('size', '1T', 1099511627776), ('date', '1584286200', 1584286200), ('date', '2020-03-15', 1584230400), ('date', '1969-12-31', -86400), ('date', '2021-02-31', 1614729600)) AS v(what, given, value)")
def x7_x8_parsers(spark, sf_dir):
    sizes, dates = ["10", "1.5k", "2KiB", "3MB", "1T"], ["1584286200", "2020-03-15", "1969-12-31", "2021-02-31"]
    return spark.createDataFrame([("size", s, scalars.parse_size(s)) for s in sizes] + [("date", d, scalars.parse_date(d)) for d in dates], "what string, given string, value long")


@query("WITH x AS (SELECT 1) SELECT * FROM (VALUES (0, -5, 'zstd', 16, 256), (1, 1, 'zstd', 16, 256), (2, 9, 'zstd', 16, 256), (3, 15, 'zstd', 16, 256), (4, 19, 'zstd', 16, 256), (5, 9, 'lzma', 16, 256), (6, 9, 'lzma', 16, 256), (7, 9, 'lzma', 8, 128), (8, 9, 'lzma', 10, 192), (9, 9, 'lzma', 12, 192), (10, 9, 'lzma', 16, 256)) AS v(level, zstd, backend, ppmd_order, ppmd_mb)")
def x20_x22_levels(spark, sf_dir):
    return spark.createDataFrame([(n, settings.zstd_level(n), settings.backend(Options(level=n)), *settings.ppmd_settings(n)) for n in range(11)], "level int, zstd int, backend string, ppmd_order int, ppmd_mb int")


@query("WITH x AS (SELECT 1) SELECT * FROM (VALUES ('none', 'crc32'), ('crc', 'crc32'), ('CRC32', 'crc32'), ('xxhash3', 'xxh3'), ('XXH3', 'xxh3'), ('b3', 'blake3'), ('blake3', 'blake3')) AS v(given, hash)")
def x19_hash_names(spark, sf_dir):
    return spark.createDataFrame([(g or "none", scalars.hash_name(g)) for g in (None, "crc", "CRC32", "xxhash3", "XXH3", "b3", "blake3")], "given string, hash string")


@query("SELECT DISTINCT coalesce(lang, '') || '/' || doc_id // 100 AS rel, " + ", ".join(f"true AS {b}" for b in fixed.BRANCH_FILTERS) + " FROM documents WHERE text IS NOT NULL")
def t12_branch_filters(spark, sf_dir):
    """Bytes of bodies under each branch filter of the strongest codec; all read back."""
    rows = _volumes(spark, sf_dir)
    return rows.select("rel", *((F.md5(codecs.decoded(codecs.encoded(F.col("body"), "lzma", 5, b), "lzma")) == F.md5("body")).alias(b) for b in fixed.BRANCH_FILTERS))
