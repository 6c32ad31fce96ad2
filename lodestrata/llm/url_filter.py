"""URL filters by hashed expressions, in DataFrame functions only.

A URL is expanded into expressions: each suffix of its host at a dot, with each prefix of its path that has the length
of some rule's path. Expressions meet the rules in an equi-join on the first bytes of their digests; the full digest
then confirms, and of the rules that fit the longest one decides.

URLs are reduced to distinct pairs of host and path before they are expanded, so a common URL is judged once; a pair that
very many pages have is sent to the pages, not these to it. Pages without a host fit no rule and meet none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of the short prefix, and rules up to which they are broadcast.
PREFIX, BROADCAST = 8, 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Without ://, or null, empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end. Without ://, or null, empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule (host and path of the rule that decides, else null),
    verdict (its action, else the default). rules: (host, path, action); a rule fits its host and all subdomains if the
    URL's path starts with its path. The longest host and path wins; of the same one given twice, the lesser action.
    Null URLs have an empty host and path. Rules with a null are left out; null page_ids and repeated rows stay."""
    urls = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").na.drop().groupBy("rule_host", "rule_path").agg(F.min("action").alias("action"))
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    listed = rules.select("rule_host", "rule_path", "action", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("prefix"))
    # bounded by the length of a URL
    lengths = sorted(r[0] for r in rules.select(F.char_length("rule_path")).distinct().collect())
    few = rules.limit(BROADCAST + 1).count() <= BROADCAST
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length("path")), lambda n: F.left("path", n))
    some = urls.where("host <> ''")
    pairs = some.groupBy("host", "path").agg(F.count("*").alias("n"))
    expanded = pairs.select("host", "path", "n", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "n", "suffix", F.explode("prefixes").alias("start"))
    expanded = expanded.withColumn("digest", _digest(F.col("suffix"), F.col("start"))).select("host", "path", "n", "digest", F.substring("digest", 1, PREFIX).alias("prefix"))
    if few:
        fits = expanded.join(F.broadcast(listed), "prefix").where("digest = rule_digest")
    else:
        # expressions that many URLs share, such as a top-level domain, are counted before they meet the rules
        expanded = common.settled(expanded, "expressions")
        known = expanded.groupBy("prefix", "digest").agg(F.count("*").alias("urls")).join(listed, "prefix").where("digest = rule_digest").drop("prefix", "rule_digest")
        fits = common.dealt_join(expanded, common.settled(known, "rules"), ["digest"], "urls", expanded.count())
    spelt = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(spelt.alias("rule"), "action"), F.struct(F.char_length(spelt), spelt)).alias("best"), F.first("n").alias("n"))
    joined = common.dealt_join(some, common.settled(best, "verdicts"), ["host", "path"], "n", pages.count(), "left")
    every = joined.unionByName(urls.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return every.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
