"""URL rules by equi-joins on short hash prefixes.

A rule is (host, path, verdict): it fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's path. Rules are stored
under the digest of an expression: host plus the path up to its last slash. A
URL is expanded into the expressions that could be such keys: every suffix of
its host's labels with every prefix of its path that ends in a slash (or is
empty), as far as the rules' deepest ones reach. Expressions and rules meet in
an equi-join on the first 4 bytes of the digest; the full digest, then the
rest of the path, confirm; the longest rule wins (ties: the longer host, then
block over allow).

URLs are judged once per distinct (host, path). Rules are broadcast only if
Spark's size check allows it; beyond it the join shuffles distinct expressions.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased; path is what follows up to ``?``, ``#`` or
the end; without ``://`` or for null both are empty. No rule fits: rule null,
verdict ``default``. A rule with an empty host fits no URL; null rule fields
are read as empty. Repeated rows keep their rows; an empty table gives an
empty result; other columns pass through, those named like the outputs are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .util import renamed, save

PREFIX = 8              # hex digits of the digest that are joined on
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _rules(rules: DataFrame, host: str, path: str, verdict: str) -> DataFrame:
    """(digest, short, rest, rule, ...): a row per distinct rule."""
    return (rules.select(F.translate(F.coalesce(F.col(host), F.lit("")), UPPER, LOWER).alias("r_host"),
                         F.coalesce(F.col(path), F.lit("")).alias("r_path"), F.col(verdict).alias("r_verdict")).distinct()
            .withColumn("r_dir", F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)).filter("r_host <> ''")
            .withColumn("digest", _digest(F.concat_ws("\n", "r_host", "r_dir"))).withColumn("short", F.substring("digest", 1, PREFIX)))


def expressions(urls: DataFrame, labels: int, slashes: int) -> DataFrame:
    """(host, path, suffix, dir, digest, short) of every expression of each URL."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))),
                           lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    steps = F.split("path", "/")
    # the empty prefix, then up to and including each slash
    dirs = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(slashes))),
                       lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), F.greatest(n, F.lit(1))), "/"), F.lit("/"))))
    return (urls.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"), dirs.alias("dirs"))
            .select("host", "path", "suffix", F.explode("dirs").alias("dir"))
            .withColumn("digest", _digest(F.concat_ws("\n", "suffix", "dir"))).withColumn("short", F.substring("digest", 1, PREFIX)))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", host: str = "host", path: str = "path", verdict: str = "verdict") -> DataFrame:
    """Add host, path, rule and verdict to every row. ``rules``: columns host, path, verdict."""
    made = ("host", "path", "rule", "verdict")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c == url or c not in made])
    known = save(_rules(rules, host, path, verdict))
    depth = known.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.size(F.split("r_path", "/")) - 1).alias("slashes")).first()
    labels, slashes = depth["labels"] or 0, depth["slashes"] or 0

    source = F.col(f"`{url}`")
    pages = df.withColumns({"_h": host_of(source), "_p": path_of(source)})
    distinct = pages.select(F.col("_h").alias("host"), F.col("_p").alias("path")).distinct()
    found = (expressions(distinct, labels, slashes).join(known.withColumnRenamed("digest", "r_digest"), "short")
             .filter((F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))))
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
        (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("b"))
    best = save(best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "b.rule", "b.verdict"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return (pages.join(best, ["_h", "_p"], "left")
            .select(*keep, F.col("_h").alias("host"), F.col("_p").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
