"""URL filters: host-suffix and path-prefix rules (operator 8, DataFrame functions only).

Each URL is expanded into the (host suffix, path prefix) expressions that a rule
could have, an equi-join on the first 32 bits of the expressions' SHA-256 finds
the candidates, the full digest confirms them, and the longest rule wins.

Only the shapes that occur among the rules (number of host labels, length of
path) are expanded, so a URL of any length gives at most one row per shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict of a URL that no rule fits.
DEFAULT_VERDICT = "allow"
#: More rule shapes than this are refused (each costs one row per URL).
MAX_SHAPES = 1000


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(host, path) -> F.Column:
    return F.sha2(F.concat(host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict in place of columns
    of these names.

    Null URLs and those without ``://`` have empty host and path and fit no rule.
    Equal URLs are judged once; repeated rows all return.  Of two rules of one
    text the one with the smaller verdict (block after allow) is kept.
    """
    labels = F.size(F.split("host", r"\."))
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("digest", _digest(F.col("host"), F.col("path")))
    )
    shapes = rules.select(labels.alias("n"), F.length("path").alias("k")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} rule shapes")
    host, path = split_url(F.col("_url"))
    urls = pages.select(F.col(url).alias("_url")).where("_url is not null").distinct().select("_url", host.alias("_host"), path.alias("_path"))
    urls = urls.withColumn("_n", F.size(F.split("_host", r"\.")))
    found = None
    if shapes:
        suffix = lambda n: F.substring_index("_host", ".", -n)
        each = [
            F.when((F.col("_n") >= n) & (F.length("_path") >= k), _digest(suffix(n), F.substring("_path", 1, k)))
            for n, k in sorted((r["n"], r["k"]) for r in shapes)
        ]
        expressions = urls.select("_url", F.explode(F.array(*each)).alias("_digest")).where("_digest is not null")
        short = lambda d: F.conv(F.substring(d, 1, 8), 16, 10).cast("long")
        known = rules.select(
            short("digest").alias("_short"), F.col("digest").alias("_full"), F.concat("host", "path").alias("rule"), F.col("verdict")
        )
        hits = expressions.withColumn("_short", short("_digest")).join(known, "_short").where("_digest = _full")
        found = hits.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("_best"))
    base = pages.drop("host", "path", "rule", "verdict").withColumn("_url", F.col(url))
    if found is None:
        best = base.withColumn("_best", F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    else:
        best = base.join(found, "_url", "left")
    host, path = split_url(F.col("_url"))
    return best.select(
        *[F.col(c) for c in base.columns if c != "_url"],
        host.alias("host"),
        path.alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    ).withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
