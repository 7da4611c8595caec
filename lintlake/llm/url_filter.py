"""URL filters by a sort-merge range join.

A rule is a host, with all its subdomains, and a path prefix. With the host's labels reversed,
host and path make one canonical key, and the keys a rule covers below its own host are an
interval of the sorted keys. The distinct keys of URLs, one for each rule host above them, and
rules are sorted together; a sweep carries the last rule that began, with the stack of the rules it is nested
in. The deepest of them that still covers the key is the match; the others have closed. What a
key matches is the same for all hosts below the rule's, so a path that many hosts share, such as
`/`, is swept once and joined back to its URLs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.columns import boxed, text_of
from lintlake.sources.store import keep

DEFAULT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#`; A-Z lower-cased. Without one, or null: empty."""
    found = F.regexp_extract(text_of(url), _PARTS, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`, as it is."""
    return F.regexp_extract(text_of(url), _PARTS, 2)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column) -> Column:
    """Reversed labels, each closed by a dot: keys of subdomains start with their domain's."""
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Every rule's key with the stack of rules, itself included, that its key starts with."""
    keyed = rules.select(
        _key(_labels(F.col("host"))).alias("root"), "host", "path", "verdict"
    ).withColumn("key", F.concat("root", "path"))
    # Two rules of one host and path: block goes before allow.
    keyed = keyed.groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"))
    prefixes = keyed.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    prefixes = prefixes.select("key", F.substring("key", F.lit(1), F.col("n")).alias("prefix"))
    nested = keyed.withColumnRenamed("key", "prefix")
    rule = F.struct(F.length("prefix").alias("depth"), "prefix", "host", "path", "verdict")
    return (
        prefixes.join(nested, "prefix")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(rule), asc=False).alias("stack"))
    )


def _points(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, key): each distinct URL once for every rule host that it lies under."""
    hosts = urls.select("host").distinct()
    above = F.transform(
        F.sequence(F.lit(1), F.size("labels")), lambda n: _key(F.slice("labels", F.lit(1), n))
    )
    above = hosts.withColumn("labels", _labels(F.col("host"))).select(
        "host", F.explode(above).alias("root")
    )
    roots = rules.select(_key(_labels(F.col("host"))).alias("root")).distinct()
    return (
        urls.join(above.join(roots, "root"), "host")
        .select("host", "path", F.concat("root", "path").alias("key"))
    )


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the URLs that a rule fits; `urls` has distinct rows.

    The rule is its host and path written together; the longest wins, among equally long ones
    that with the longer host.
    """
    none = F.lit(None).cast(_stacks(rules).schema["stack"].dataType)
    points = keep(_points(urls, rules))
    keys = points.select("key").distinct().withColumn("stack", none)
    # Stored with the number of its range, so that both uses below see the same ranges.
    swept = keep(
        keys.unionByName(_stacks(rules)).repartitionByRange("key").withColumn("slice", F.spark_partition_id())
    )
    begun = F.col("stack").isNotNull()
    last = swept.where(begun).groupBy("slice").agg(F.max_by("stack", "key").alias("last"))
    slices = swept.select("slice").distinct().join(last, "slice", "left")
    # One row per range; what is open where a range begins.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    upto = (
        Window.partitionBy("slice")
        .orderBy("key", F.col("stack").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    open_ = F.coalesce(F.last("stack", ignorenulls=True).over(upto), F.col("carried"))
    fits = F.filter("open", lambda rule: F.col("key").startswith(rule["prefix"]))
    tops = (
        swept.join(carried, "slice", "left")
        .withColumn("open", open_)
        .where(F.col("stack").isNull())
        .select("key", F.get(fits, F.lit(0)).alias("top"))
        .where("top IS NOT NULL")
    )
    found = (
        points.join(tops, "key")
        .select("host", "path", F.concat("top.host", "top.path").alias("rule"),
                F.col("top.host").alias("rule_host"), F.col("top.verdict").alias("verdict"))
    )
    longest = F.max(F.struct(F.length("rule"), F.length("rule_host"), "rule", "verdict"))
    return found.groupBy("host", "path").agg(longest.alias("best")).select(
        "host", "path", "best.rule", "best.verdict"
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The pages with host, path, rule (null: none fits) and verdict.

    `rules` has host, path and verdict. A null URL, or one without `://`, has an empty host and
    path and gets the default verdict. Columns of those four names in `pages` are replaced;
    equal rows give equal rows.
    """
    rules = rules.select(F.lower("host").alias("host"), "path", "verdict")
    parts = boxed(pages, host=host_of(F.col(url)), path=path_of(F.col(url)))
    urls = parts.select("host", "path").distinct()
    found = match(urls, rules)
    own = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return parts.join(found, ["host", "path"], "left").select(
        *own, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


# The rules of the registered query: fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = rf"""
WITH rules(h, p, v) AS (VALUES {_RULES_SQL}),
cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(coalesce(url, ''), '://')
          THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'),
            '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
         FROM parts JOIN rules ON ('.' || host LIKE '%.' || h) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM parts LEFT JOIN fits USING (r)
"""
