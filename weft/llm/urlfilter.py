"""Blocking and allowing URLs by rules of a host and the start of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import written


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first `://` up to `/`, `?`, `#`; path up to `?` or `#`. Both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_w_url, locate('://', _w_url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", digits: int = 8) -> DataFrame:
    """`pages` with host, path, rule and verdict added, one row for each row.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the URL's path starts with the rule's path;
    of those that fit, the longest (host and path together, then host, then smallest text) wins. Each distinct (host, path)
    is expanded into its host suffixes times its path prefixes, of the numbers of labels and the lengths that rules have (these numbers, no more than
    the longest rule has labels and characters, pass through the driver); expressions meet rules in an
    equi-join on the first `digits` hex digits of their SHA-256, and count where the full digests agree. Nothing fits: rule is
    null and the verdict `default`. A null URL, or one without `://`, has an empty host and path, which no rule with a host
    fits. Columns of `pages` named host, path, rule or verdict are replaced.
    """
    rules = rules.filter("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("_w_verdict"))
    rules = rules.select(F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("_w_full"), F.concat("host", "path").alias("_w_rule"), F.length("host").alias("_w_host_length"), "_w_verdict")
    parts = rules.select(F.size(F.split(F.substring(F.col("_w_rule"), F.lit(1), F.col("_w_host_length")), r"\.")).alias("labels"), (F.length("_w_rule") - F.col("_w_host_length")).alias("path"))
    sizes = parts.agg(F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("path")).alias("path")).first()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    given = pages.withColumn("_w_url", F.coalesce(F.col(url).cast("string"), F.lit("")))
    host, path = host_and_path(F.col("_w_url"))
    given = given.select(*kept, host.alias("host"), path.alias("path"))
    distinct = given.select("host", "path").distinct().filter("host <> ''")
    labels = F.split("host", r"\.")
    known = lambda numbers, most: F.filter(F.array(*[F.lit(n) for n in numbers]).cast("array<int>"), lambda n: n <= most)
    suffixes = F.transform(known(sizes["labels"], F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    fitting = known(sizes["path"], F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        distinct.select("host", "path", F.explode(suffixes).alias("_w_suffix"))
        .filter("_w_suffix <> ''")
        .select("host", "path", "_w_suffix", F.explode(prefixes).alias("_w_prefix"))
        .withColumn("_w_digest", F.sha2(F.concat("_w_suffix", F.lit("\n"), "_w_prefix"), 256))
        .withColumn("_w_short", F.substring("_w_digest", 1, digits))
    )
    found = expressions.join(rules.withColumn("_w_short", F.substring("_w_full", 1, digits)), "_w_short").filter("_w_digest = _w_full")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("_w_rule").alias("n"), F.col("_w_host_length").alias("h"), F.col("_w_rule").alias("rule"), F.col("_w_verdict").alias("verdict"))).alias("_w_best"))
    # written, so that Spark may split the pages of one common address in the join
    return given.join(written(best), ["host", "path"], "left").select(*kept, "host", "path", F.col("_w_best.rule").alias("rule"), F.coalesce("_w_best.verdict", F.lit(default)).alias("verdict"))
