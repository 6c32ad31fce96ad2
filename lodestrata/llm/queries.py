"""One query for each operator: it applies the operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language_id, media, ngram_join, secrets, sentencepieces, sharding, toxicity, url_filter
from .common import table


#: Fixed values of the query: host, path and action of each rule.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, action)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


OP8_SQL = """
WITH parts AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(rule_host, rule_path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hosts AS (SELECT DISTINCT host, path FROM parts),
best AS (
    SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
    FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", costly=True).withColumn("repository", F.concat_ws("/", "source", "lang"))
    found = secrets.scan(docs, repository="repository", owner="source")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spelled("base").cast("binary"), 256).alias("base_sha256"), secrets.spelled("spans").alias("spans"), F.size("live").cast("long").alias("n_live"), "n_examples")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents", costly=True), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents", costly=True))
    return found.select("doc_id", "held_out", "lang_pred", "score", "second", "ambiguous")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.predict(table(spark, sf_dir, "documents", costly=True), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_exact", "n_stem", "n_fuzzy", "n_quoted")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents", costly=True))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "length")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents", costly=True))


#: Fixed values of the query: a conversation that spells control strings of templates.
SPELLED = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPELLED).alias("text"))
    shaped = chat.formatted(rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = chat.read_back(shaped.select("conv_id", "formatted", "mask"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
    SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS body,
        replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(3 + 6 + 7 + 4 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_join(table(spark, sf_dir, "documents", costly=True), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


#: Texts in lower case of A-Z alone, and their words by a class of separators.
_WORDS = "[x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}') IF x <> '']"

OP7_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("[ \\t-\\r]+")} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS n, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM pairs WHERE 100 * shared >= 90 * (n - shared)),
reached(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_reached, doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM sets LEFT JOIN (SELECT u, min(v) AS least_reached FROM reached GROUP BY u) r ON r.u = doc_id LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) l ON l.u = doc_id
"""

OP10_SQL = f"""
WITH words AS (SELECT doc_id, {_WORDS.format("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i : i + 9], ' ') FOR i IN range(1, greatest(len(w) - 8, 2))]) AS t FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS t FROM words, sizes WHERE len(w) >= n),
found AS MATERIALIZED (SELECT doc_id, i, places.n, item_id FROM places JOIN windows ON places.t = windows.t AND places.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


#: The patterns of candidates, names in either case, by the order of kinds at the same start. Runs of hex are taken from 32 on,
#: which are those that count.
_PATTERNS = {
    "assign": "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{32,}",
    "entropy": "[A-Za-z0-9+/_-]{20,}={0,2}",
}
_CUT = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM docs" for rank, (kind, pattern) in enumerate(_PATTERNS.items()))

OP9_SQL = rf"""
WITH docs AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
cut AS ({_CUT}),
placed AS (
    SELECT doc_id, kind, rank, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1),
        lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))) AS s FROM cut),
valued AS (
    SELECT doc_id, kind, rank, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e,
        CASE WHEN kind = 'assign' THEN regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE hit END AS v FROM placed),
sized AS (
    SELECT *, list_sum(list_transform(map_values(list_histogram(string_split(v, ''))), lambda k: -(k / length(v)) * log2(k / length(v)))) AS bits
    FROM valued WHERE length(v) >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 WHEN 'hex' THEN 32 ELSE 20 END),
base AS (SELECT * FROM sized WHERE kind <> 'entropy'),
found AS MATERIALIZED (
    SELECT * FROM base UNION ALL
    SELECT * FROM sized x WHERE kind = 'entropy' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND bits >= 3.0
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
examples AS (
    SELECT v FROM (SELECT v, coalesce(source, '?' || doc_id) AS owner, repository FROM found JOIN docs USING (doc_id))
    GROUP BY v HAVING count(DISTINCT owner) >= 3 OR count(DISTINCT (owner, repository)) >= 6),
judged AS (
    SELECT f.*, x.v IS NOT NULL AS example, x.v IS NULL AND bits >= 3.0 AND regexp_matches(f.v, '[0-9]') AND len(list_distinct(string_split(f.v, ''))) >= 8 AS live
    FROM found f LEFT JOIN examples x ON f.v = x.v),
spelled AS (SELECT *, kind || ':' || s || ':' || e AS span FROM judged)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (kind <> 'entropy'), '')) AS base_sha256,
    coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (kind <> 'entropy' OR live), '') AS spans,
    CAST(count(*) FILTER (live) AS INT) AS n_live, count(*) FILTER (example) AS n_examples
FROM docs LEFT JOIN spelled USING (doc_id) GROUP BY doc_id
"""


QUERIES = {f.__name__: f for f in (op1_language_id, op2_sharding, op3_toxicity, op4_media_columns, op5_sentencepiece, op6_chat_format, op7_ngram_jaccard_join, op8_url_filter, op9_secret_scan, op10_benchmark_decontamination)}
ORACLES: dict[str, str] = {"op6_chat_format": OP6_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_secret_scan": OP9_SQL, "op10_benchmark_decontamination": OP10_SQL}
