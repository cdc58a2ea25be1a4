"""URL filters: rules on hosts and paths, and a blocked Bloom filter of listed URLs before an exact hash join.

The filter's size is bounded whatever the list's length, so it is broadcast; what passes it goes to a hash join
with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bloom import MAX_FILTER_BYTES, blocked_bloom, with_maybe
from corpusloom.llm.common import ascii_lower, materialize


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: then up to ? or #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., and path without its last slashes."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host/path, verdict) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, below = text.index("/"), text[: text.index("/")]
        fits = ((host == below) | F.endswith(host, F.lit("." + below))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds host, path, rule, verdict to (page_id, url): the longest fitting rule's, else block for listed URLs.

    listed: column url, canonical. Null URLs and URLs without :// have an empty host and path, fit no rule
    and are allowed unless the empty URL is listed. Repeated pages are judged each; repeated or null list rows
    count once or not at all. Other columns of pages are ignored; an empty table or list is allowed.
    """
    listed = materialize(listed.filter(F.col("url").isNotNull()).select("url").distinct(), "listed_urls")
    bloom = blocked_bloom(listed, listed.count(), max_filter_bytes)
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "says": says, "canon": canonical(F.col("host"), F.col("path"))})
    probe = with_maybe(seen, F.col("canon"), bloom).withColumn("maybe", F.col("maybe") & F.col("says").isNull())
    columns = ["page_id", "host", "path", "rule", "says", "canon"]
    passed = probe.filter("maybe").select(*columns).join(listed.hint("shuffle_hash"), F.col("canon") == F.col("url"), "left")
    passed = passed.withColumn("listed", F.col("url").isNotNull()).drop("url")
    rest = probe.filter("not maybe").select(*columns).withColumn("listed", F.lit(False))
    verdict = F.coalesce(F.col("says"), F.when(F.col("listed"), "block").otherwise("allow"))
    return passed.unionByName(rest).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
