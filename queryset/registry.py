"""Every query: what runs on Spark and the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.functions import matching, paths, severity, text
from lintlake.operators import compare, incremental, manifest, metrics, segmented, surface
from lintlake.operators.scan import (
    count_files,
    describe,
    each_match,
    findings,
    ordered_findings,
    positioned_findings,
    scan,
    scan_files,
)
from lintlake.plans import in_sql, reports
from lintlake.rules import RULES, Rule, RuleSet, builtin_rules
from lintlake.rules.ruleset import categories_in_use, duplicate_ids
from lintlake.sources.bucketed import write_hits
from lintlake.sources.findings import read_findings, write_findings
from lintlake.sources.store import keep, remove_folder, shared_dir
from lintlake.sources.tables import from_table, scannable, skip_reason, spread
from lintlake.sources.tree import list_tree, read_tree
from lintlake.streaming.scan import scan_available
from queryset import corpora
from queryset.corpora import quote
from queryset.oracle import (
    UNIFIED,
    findings_ctes,
    line_count_sql,
    reason_sql,
    scannable_sql,
    skipped_sql,
)


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        assert name not in QUERIES, name
        QUERIES[name] = Query(run, sql)
        return run

    return register


# Corpora in both engines.

RENDERED = corpora.rendered_sql()
TREE = scannable_sql(RENDERED)
DOCUMENTS = corpora.documents_sql()


def tree_files(spark, sf):
    return scannable(corpora.rendered(spark, sf))


def rendered_scan(spark, sf):
    return scan_files(tree_files(spark, sf))


def documents_scan(spark, sf):
    return scan_files(corpora.documents(spark, sf))


def read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def found(files: str, select: str, keep=lambda rule: True, catalog=RULES) -> str:
    return f"WITH {findings_ctes(files, keep, catalog)}\n{select}"


PLACE = ["rule_id", "severity", "file_path", "line_number", "match_ord", "line_content"]
ORDERED = schema.FINDING_COLUMNS + ["severity_rank", "rule_ord", "match_ord"]
SELECT_PLACE = f"SELECT {', '.join(PLACE)} FROM findings"
SELECT_ALL = f"SELECT {', '.join(ORDERED)} FROM findings"

# Scans: files joined with rules, matches, lines, order.


@query("findings_by_rule", found(
    DOCUMENTS,
    "SELECT rule_id, title, severity, category, count(*) AS findings, "
    "count(DISTINCT file_path) AS files FROM findings GROUP BY ALL"))
def findings_by_rule(spark, sf):
    """The flagship: all rules over all documents, counted by rule."""
    return metrics.rule_counts(count_files(corpora.documents(spark, sf)))


@query("rule_counts", found(
    TREE,
    "SELECT rule_id, title, severity, category, count(*) AS findings, "
    "count(DISTINCT file_path) AS files FROM findings GROUP BY ALL"))
def rule_counts(spark, sf):
    return metrics.rule_counts(rendered_scan(spark, sf))


@query("dense_rule_counts", found(
    TREE,
    f"SELECT rule_id, title, severity, category, count(*) * {corpora.COPIES} AS findings, "
    f"count(DISTINCT file_path) * {corpora.COPIES} AS files FROM findings GROUP BY ALL"))
def dense_rule_counts(spark, sf):
    """Counts by rule over short files full of matches."""
    return metrics.rule_counts(count_files(scannable(corpora.dense(spark, sf))))


@query("scan_rendered", found(TREE, SELECT_ALL))
def scan_rendered(spark, sf):
    return scan(tree_files(spark, sf)).select(ORDERED)


@query("scan_documents", found(DOCUMENTS, SELECT_PLACE))
def scan_documents(spark, sf):
    return scan(corpora.documents(spark, sf)).select(PLACE)


@query("scan_pages", found(corpora.pages_sql(), SELECT_PLACE))
def scan_pages(spark, sf):
    return scan(corpora.pages(spark, sf)).select(PLACE)


@query("scan_conversations", found(corpora.conversations_sql(), SELECT_PLACE))
def scan_conversations(spark, sf):
    return scan(corpora.conversations(spark, sf)).select(PLACE)


@query("sql_findings", found(
    DOCUMENTS, f"{SELECT_PLACE} WHERE category <> 'secret'"))
def sql_findings(spark, sf):
    """The scan in SQL text alone: functions of the session and the view of the rules."""
    in_sql.register(spark)
    return spark.sql(f"""
        WITH scanned AS (
          SELECT CAST(doc_id AS STRING) AS file_path, lint_lines('python', text) AS hits
          FROM parquet.`{sf}/documents.parquet`),
        lines AS (SELECT * FROM scanned LATERAL VIEW OUTER inline(hits) hit WHERE rule_ord IS NOT NULL)
        SELECT rule_id, severity, file_path, line_number, match_ord, line_content
        FROM lines JOIN (SELECT rule_ord, category FROM lint_rules) USING (rule_ord)
        LATERAL VIEW explode(sequence(1, matches)) each AS match_ord
        WHERE category <> 'secret'""")


@query("sql_counts", found(
    TREE, "SELECT language, rule_id, count(*) AS findings FROM findings JOIN files ON file_path = path GROUP BY ALL"))
def sql_counts(spark, sf):
    """Counts by language and rule in SQL, over a view of the caller's own."""
    in_sql.register(spark)
    name = f"files_{uuid.uuid4().hex}"
    tree_files(spark, sf).createOrReplaceTempView(name)
    counted = spark.sql(f"""
        SELECT language, rule_id, sum(matches) AS findings
        FROM (SELECT lint_language(path) AS language, lint_counts(lint_language(path), text) AS counts FROM {name})
        LATERAL VIEW OUTER inline(counts) counted WHERE rule_id IS NOT NULL GROUP BY ALL""")
    spark.catalog.dropTempView(name)
    return counted


@query("ordered_findings", found(TREE, SELECT_ALL + f" ORDER BY {', '.join(schema.ORDER_COLUMNS)}"))
def ordered(spark, sf):
    return ordered_findings(rendered_scan(spark, sf)).select(ORDERED)


@query("finding_positions", found(
    TREE, f"SELECT {', '.join(PLACE)}, row_number() OVER (ORDER BY {', '.join(schema.ORDER_COLUMNS)}) AS position "
    "FROM findings"))
def finding_positions(spark, sf):
    """Every finding with its place in the order."""
    return positioned_findings(rendered_scan(spark, sf)).select(*PLACE, "position")


@query("min_severity_high", found(
    RENDERED, SELECT_PLACE, lambda rule: rule.severity in ("critical", "high")))
def min_severity_high(spark, sf):
    return scan(corpora.rendered(spark, sf), min_severity="high").select(PLACE)


@query("findings_of_category", found(
    RENDERED, f"{SELECT_PLACE} WHERE category = 'injection'"))
def findings_of_category(spark, sf):
    return scan(corpora.rendered(spark, sf), builtin_rules().only(categories=["injection"])).select(PLACE)


CUSTOM = [
    Rule("X001", "Article heading", "low", "quality", None, None, "high",
         r"<h(?P<level>[1-6])>\s*\w+", [], "A heading.", ""),
    Rule("X002", "Broken", "high", "security", None, None, "high", r"(unclosed", [], "", ""),
    Rule("X003", "Last cell", "medium", "quality", "CWE-1", ["javascript"], "low",
         r"href=\"[^\"]{,9}\"", ["href"], "A short link.", "Drop it."),
    # Rules without a pattern, severity or category are left out.
    Rule("X005", "No pattern", "high", "quality", None, None, "high", None, [], "", ""),
    Rule("X006", "No severity", None, "quality", None, None, "high", "a", [], "", ""),
    Rule("X007", "No category", "low", None, None, None, "high", "a", [], "", ""),
    # What a caller says of strings a match needs, here wrongly, is not relied on.
    Rule("X004", "Paragraph", " HIGH ", " Quality", None, None, " Low ", r"<p>\s*\w", ["<P>"], "", ""),
]
CUSTOM_SQL = [
    CUSTOM[0]._replace(pattern=r"<h([1-6])>\s*\w+"),
    CUSTOM[1],
    CUSTOM[2]._replace(pattern=r"href=\"[^\"]{0,9}\""),
    CUSTOM[6]._replace(severity="high", category="quality", confidence="low"),
]


@query("scan_custom_rules", found(
    corpora.pages_sql(), SELECT_PLACE, lambda rule: rule.rule_id != "X002", CUSTOM_SQL))
def scan_custom_rules(spark, sf):
    """The caller's own rules from a table without an order; the one that does not compile and
    those that lack what a rule needs are left out."""
    table = spark.createDataFrame(
        CUSTOM[::-1],
        "rule_id string, title string, severity string, category string, cwe_id string, "
        "languages array<string>, confidence string, pattern string, needs array<string>, "
        "description string, suggestion string, ends_with string",
    )
    return scan(corpora.pages(spark, sf), RuleSet.from_table(table)).select(PLACE)


def _rule_query(rule: Rule) -> Query:
    only = builtin_rules().only(rule_ids=[rule.rule_id])

    def run(spark, sf):
        return scan(corpora.rendered(spark, sf), only).select(PLACE)

    return Query(run, found(RENDERED, SELECT_PLACE, lambda r: r.rule_id == rule.rule_id))


for _rule in RULES:
    QUERIES[f"rule_{_rule.rule_id.lower()}"] = _rule_query(_rule)


def _older(files):
    """The documents before a change: some texts were others, some were not there, some have gone."""
    key = F.col("path").cast("bigint")
    before = files.withColumn("text", F.when(key % 7 == 2, F.concat(F.lit("eval(x) "), "text")).otherwise(F.col("text")))
    gone = files.where(key % 13 == 5).withColumn("path", F.concat(F.lit("gone/"), "path"))
    return before.where(key % 11 != 3).unionByName(gone)


@query("stored_findings", found(
    TREE, f"{SELECT_PLACE} WHERE rule_id IN ('SEC001', 'SEC004') OR category = 'performance'"))
def stored_findings(spark, sf):
    """Findings of some rules from a table on file: other severities are not read."""
    place = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}"
    write_findings(findings(rendered_scan(spark, sf)), place)
    found_rows = keep(read_findings(spark, place, ["SEC001", "SEC004"], ["performance"]).select(PLACE))
    remove_folder(spark, place)
    return found_rows


@query("rescan", found(DOCUMENTS, SELECT_PLACE))
def rescan(spark, sf):
    """The documents scanned from the stored scan of an older state."""
    files = corpora.documents(spark, sf)
    stored = keep(incremental.keyed_scan(_older(files)))
    return findings(incremental.rescan(files, stored).scanned).select(PLACE)


@query("rescan_tally", found(DOCUMENTS, """, t AS (
  SELECT NULL AS language, rule_id, severity, category, 0 AS files, 0 AS lines, count(*) AS findings
  FROM findings GROUP BY ALL
  UNION ALL
  SELECT language, NULL, NULL, NULL, count(*), sum(length(text) - length(replace(text, chr(10), '')) + 1), 0
  FROM files GROUP BY language)
SELECT language, rule_id, severity, category, files::BIGINT AS files, lines::BIGINT AS lines, findings::BIGINT AS findings
FROM t"""))
def rescan_tally(spark, sf):
    """The tally after the change from the one before it and what changed."""
    files = corpora.documents(spark, sf)
    stored = keep(incremental.keyed_scan(_older(files)))
    changes = incremental.rescan(files, stored)
    return incremental.adjusted_tally(metrics.tally(stored), changes)


@query("stream_scan", found(
    DOCUMENTS, "SELECT rule_id, count(*) AS findings FROM findings GROUP BY rule_id"))
def stream_scan(spark, sf):
    """The same scan over a stream of files, stored and then counted."""
    source = f"{sf}/documents.parquet"
    # A stream reads folders or patterns; this one names the table alone.
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source[:-1] + "[t]")
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = from_table(stream, "doc_id", "text", "python")
    scan_available(files, f"{place}/scanned", f"{place}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{place}/scanned")
    counts = findings(stored).groupBy("rule_id").agg(F.count("*").alias("findings"))
    made = spark.createDataFrame(counts.toArrow())  # a row per rule
    remove_folder(spark, place)
    return made


# Sources and file selection.


@query("detect_language", f"SELECT path, language FROM {RENDERED}")
def detect_language(spark, sf):
    files = corpora.rendered(spark, sf)
    return files.select("path", paths.detect_language(F.col("path")).alias("language"))


@query("detect_language_urls",
       "SELECT page_id, " + corpora.language_sql("url") + " AS language FROM pages")
def detect_language_urls(spark, sf):
    pages = read(spark, sf, "pages")
    return pages.select("page_id", paths.detect_language(F.col("url")).alias("language"))


@query("scannable_files", f"SELECT path, language, size FROM {TREE}")
def scannable_files(spark, sf):
    return tree_files(spark, sf).select("path", "language", "size")


@query("skipped_directories", f"SELECT path, {skipped_sql('path')} AS skipped FROM {RENDERED}")
def skipped_directories(spark, sf):
    files = corpora.rendered(spark, sf)
    return files.select("path", paths.is_skipped(F.col("path")).alias("skipped"))


@query("skip_counts", f"""
SELECT reason, count(*) AS files FROM (SELECT {reason_sql()} AS reason FROM {RENDERED})
WHERE reason IS NOT NULL GROUP BY reason""")
def skip_counts(spark, sf):
    return metrics.skip_counts(corpora.rendered(spark, sf), skip_reason())


@query("relative_paths", f"""
SELECT path, '/data/in/' || path AS absolute, path AS relative, 'x' || path AS outside FROM {RENDERED}
""")
def relative_paths(spark, sf):
    path = F.col("path")
    absolute = F.concat(F.lit("/data/in/"), path)
    return corpora.rendered(spark, sf).select(
        "path",
        absolute.alias("absolute"),
        paths.rel_path(absolute, "/data/in/").alias("relative"),
        paths.rel_path(F.concat(F.lit("x"), path), "/data/in").alias("outside"),
    )


_BROKEN = "CASE WHEN length(text) % 5 = 1 THEN text || chr(65533) || chr(65533) ELSE text END"


@query("decode_text", f"""
SELECT path, md5({UNIFIED.replace("text", "t")}) AS digest FROM (
  SELECT path, {_BROKEN} AS t FROM {RENDERED}
  UNION ALL SELECT 'doc/' || path, {_BROKEN} FROM {DOCUMENTS})""")
def decode_text(spark, sf):
    """Every newline, and bytes that are no UTF-8 at the end of every fifth text or so."""
    docs = corpora.documents(spark, sf).withColumn("path", F.concat(F.lit("doc/"), "path"))
    files = corpora.rendered(spark, sf).unionByName(docs)
    content = F.col("text").cast("binary")
    broken = F.concat(content, F.lit(bytearray(b"\xff\xc3")))
    content = F.when(F.length("text") % 5 == 1, broken).otherwise(content)
    return files.select("path", F.md5(text.decode_text(content)).alias("digest"))


def _written_tree(spark, sf) -> str:
    """The rendered corpus as files in a folder of their own."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}".removeprefix("file:")
    uri = root if "://" in root else f"file://{root}"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(uri)
        for frame in frames:
            for path, content in zip(frame["path"], frame["text"]):
                place = f"{base}/{path}"
                system.create_dir(place.rpartition("/")[0])
                with system.open_output_stream(place) as file:
                    file.write(content.encode())
            yield frame[["path"]]

    files = corpora.rendered(spark, sf).select("path", "text")
    files.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return root


@query("tree_scan", found(
    scannable_sql(f"(SELECT path, language, strlen(text) AS size, text FROM {RENDERED})"),
    SELECT_PLACE))
def tree_scan(spark, sf):
    """Write the rendered corpus out as files, then list, read and scan the tree."""
    return scan(read_tree(spark, _written_tree(spark, sf))).select(PLACE)


_ONE = f"(SELECT * FROM {RENDERED} WHERE language = 'python' ORDER BY strlen(text) DESC, path LIMIT 1)"


@query("single_file_scan", found(
    f"(SELECT '.' AS path, language, size, text FROM {_ONE})", SELECT_PLACE))
def single_file_scan(spark, sf):
    """One file of the written tree scanned by its own path."""
    files = corpora.rendered(spark, sf).where("language = 'python'")
    largest = files.orderBy(F.desc(F.octet_length("text")), "path").first()["path"]
    return scan(read_tree(spark, f"{_written_tree(spark, sf)}/{largest}")).select(PLACE)


@query("segmented_scan", found(
    scannable_sql(f"(SELECT path, language, strlen(text) AS size, text FROM {RENDERED})"),
    SELECT_PLACE))
def segmented_scan(spark, sf):
    """The written tree with every file read in segments of a few lines, as a huge one would be."""
    root = _written_tree(spark, sf)
    listing = list_tree(spark, root).withColumn("language", paths.detect_language(F.col("path")))
    listing = scannable(listing).select("path", "size")
    hits, _ = segmented.large_hits(listing, root, segment=128, behind=96)
    return describe(each_match(hits), builtin_rules()).select(PLACE)


@query("tree_listing", f"""
SELECT path, strlen(text) AS size FROM {RENDERED} WHERE NOT ({skipped_sql('path')})""")
def tree_listing(spark, sf):
    """Every file of the written tree below no skipped directory, with its size."""
    return list_tree(spark, _written_tree(spark, sf)).where(~paths.is_skipped(F.col("path")))


_MANIFEST = f"""
SELECT path, sha256(text) AS sha256 FROM {RENDERED}
WHERE len(list_filter(string_split(path, '/'), lambda p: list_contains(
  ['.git', '__pycache__', '.pytest_cache', '.mypy_cache', '.ruff_cache'], p))) = 0"""


@query("tree_manifest", _MANIFEST)
def tree_manifest(spark, sf):
    """The hash of every file of the written tree."""
    return manifest.tree_manifest(spark, _written_tree(spark, sf))


@query("manifest", _MANIFEST)
def manifest_rendered(spark, sf):
    files = corpora.rendered(spark, sf)
    return manifest.manifest(files.select("path", F.col("text").alias("content")))


# Text.


@query("line_counts", f"SELECT path, {line_count_sql()} AS lines FROM {DOCUMENTS}")
def line_counts(spark, sf):
    files = corpora.documents(spark, sf)
    return files.select("path", text.line_count(F.col("text")).alias("lines"))


@query("last_lines", f"""
SELECT path, string_split(text, chr(10))[-1] AS line,
       substr(trim(string_split(text, chr(10))[1], ' \t'), 1, 80) AS snippet FROM {DOCUMENTS}""")
def last_lines(spark, sf):
    files = corpora.documents(spark, sf)
    content = F.col("text")
    return files.select(
        "path",
        text.line_at(content, text.line_count(content).cast("int")).alias("line"),
        text.snippet(text.line_at(content, F.lit(1))).alias("snippet"),
    )


@query("matches_per_file", found(
    RENDERED,
    "SELECT file_path, rule_id, line_number, count(*) AS matches FROM findings GROUP BY ALL"))
def matches_per_file(spark, sf):
    rules = builtin_rules()
    hits = scan_files(corpora.rendered(spark, sf)).select("path", F.inline_outer("hits"))
    return hits.join(F.broadcast(rules.table(spark)), "ord").select(
        F.col("path").alias("file_path"), "rule_id", "line_number",
        F.col("matches").cast("bigint").alias("matches"),
    )


# A pattern that spans lines: a word ending one line and the word that starts the next.
_SPAN = r"\w+[.,]?\n\w+ "
_SPAN_RULE = Rule("SPAN", "", "low", "quality", None, None, "high", _SPAN, [], "", "")


@query("match_lines", found(
    DOCUMENTS, "SELECT file_path AS path, line_number, any_value(line_content) AS line_content, "
    "count(*) AS matches FROM findings GROUP BY 1, 2", catalog=[_SPAN_RULE]))
def match_lines(spark, sf):
    lines = matching.match_lines(F.col("text"), _SPAN)
    found_lines = corpora.documents(spark, sf).select("path", F.inline(lines))
    return found_lines.withColumn("matches", F.col("matches").cast("bigint"))


@query("match_count", found(
    DOCUMENTS,
    "SELECT path, count(file_path) AS matches FROM files LEFT JOIN findings ON file_path = path "
    "GROUP BY path", catalog=[_SPAN_RULE]))
def match_count(spark, sf):
    matches = matching.match_count(F.col("text"), _SPAN).cast("bigint")
    return corpora.documents(spark, sf).select("path", matches.alias("matches"))


# Severities as columns.


@query("severity_columns", """
WITH named AS (
  SELECT o_orderkey, [' info', 'LOW', 'Medium ', 'HIGH', 'critical'][o_orderkey % 5 + 1] AS given
  FROM orders),
parsed AS (SELECT *, lower(trim(given)) AS severity FROM named)
SELECT o_orderkey, severity,
       list_position(['critical', 'high', 'medium', 'low', 'info'], severity) - 1 AS severity_rank,
       CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5
                     WHEN 'low' THEN 2 ELSE 0 END AS deduction,
       CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium'
            THEN 'warning' ELSE 'note' END AS level,
       severity IN ('critical', 'high') AS blocking
FROM parsed""")
def severity_columns(spark, sf):
    spelt = F.array(*[F.lit(s) for s in (" info", "LOW", "Medium ", "HIGH", "critical")])
    given = F.element_at(spelt, (F.col("o_orderkey") % 5 + 1).cast("int"))
    parsed = read(spark, sf, "orders").select(
        "o_orderkey", severity.parse_severity(given).alias("severity")
    )
    name = F.col("severity")
    return parsed.select(
        "o_orderkey",
        "severity",
        severity.severity_rank(name).alias("severity_rank"),
        severity.deduction(name).alias("deduction"),
        severity.sarif_level(name).alias("level"),
        severity.is_blocking(name).alias("blocking"),
    )


GRADE = (
    "CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B+' "
    "WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END"
)
COST = "CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END"
SCORE = (
    "CASE WHEN files = 0 THEN 100 ELSE greatest(0, least(100, round_even(100 - deduction / "
    "(1 + greatest(1, lines / 1000.0::DOUBLE) * 0.1::DOUBLE), 0)))::INT END"
)


@query("grades", f"""
SELECT o_orderkey % 101 AS score, count(*) AS orders, any_value({GRADE.replace('score', '(o_orderkey % 101)')}) AS grade
FROM orders GROUP BY 1""")
def grades(spark, sf):
    scores = read(spark, sf, "orders").select((F.col("o_orderkey") % 101).alias("score"))
    counted = scores.groupBy("score").agg(F.count("*").alias("orders"))
    return counted.withColumn("grade", severity.score_to_grade(F.col("score")))


def _deduction():
    """What a file's matches of the built-in rules cost."""
    costs = F.array(*[F.lit(schema.DEDUCTIONS[rule.severity]) for rule in builtin_rules()])
    return F.aggregate(
        "hits",
        F.lit(0).cast("bigint"),
        lambda total, h: total + h["matches"] * F.element_at(costs, h["ord"] + 1),
    )


@query("score_by_source", f"""
WITH {findings_ctes(DOCUMENTS)},
costs AS (SELECT file_path, sum({COST})::BIGINT AS cost FROM findings GROUP BY file_path),
sources AS (
  SELECT source, count(*) AS files, sum({line_count_sql()})::BIGINT AS lines,
         coalesce(sum(cost), 0)::BIGINT AS deduction
  FROM documents LEFT JOIN costs ON file_path = doc_id::VARCHAR GROUP BY source)
SELECT source, files, lines, deduction, score, {GRADE} AS grade
FROM (SELECT *, {SCORE} AS score FROM sources)""")
def score_by_source(spark, sf):
    """Score and grade of each document source, as if each were one scan."""
    docs = spread(read(spark, sf, "documents").select("doc_id", "text", "source"))
    path = F.concat_ws("/", F.col("doc_id").cast("string"), "source")
    scanned = scan_files(from_table(docs, path, "text", "python"))
    cost = _deduction()
    grouped = scanned.groupBy(F.substring_index("path", "/", -1).alias("source")).agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum(cost).alias("deduction")
    )
    points = metrics.score(F.col("files"), F.col("lines"), F.col("deduction"))
    return grouped.withColumn("score", points).withColumn(
        "grade", severity.score_to_grade(F.col("score"))
    )


@query("score_formula", f"""
WITH totals AS (SELECT o_orderkey, (o_orderkey % 5)::BIGINT AS files, (o_orderkey % 7 * 5000)::BIGINT AS lines,
                       (o_custkey % 260)::BIGINT AS deduction FROM orders)
SELECT *, {GRADE} AS grade FROM (SELECT *, {SCORE} AS score FROM totals)""")
def score_formula(spark, sf):
    """The score of made-up totals: sources without files, exact halves, and all of 0 to 100."""
    totals = read(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 5).alias("files"),
        (F.col("o_orderkey") % 7 * 5000).alias("lines"),
        (F.col("o_custkey") % 260).alias("deduction"),
    )
    points = metrics.score(F.col("files"), F.col("lines"), F.col("deduction"))
    return totals.withColumn("score", points).withColumn("grade", severity.score_to_grade(F.col("score")))


@query("score_by_file", f"""
WITH {findings_ctes(TREE)},
costs AS (SELECT file_path, sum({COST})::BIGINT AS cost FROM findings GROUP BY file_path),
each AS (SELECT path, 1 AS files, {line_count_sql()} AS lines, coalesce(cost, 0)::BIGINT AS deduction
         FROM files LEFT JOIN costs ON file_path = path)
SELECT path, deduction, score, {GRADE} AS grade FROM (SELECT *, {SCORE} AS score FROM each)""")
def score_by_file(spark, sf):
    """Score and grade of each file, as if each were one scan."""
    scanned = rendered_scan(spark, sf).withColumn("deduction", _deduction())
    points = metrics.score(F.lit(1), F.col("lines"), F.col("deduction"))
    return scanned.select("path", "deduction", points.alias("score")).withColumn(
        "grade", severity.score_to_grade(F.col("score"))
    )


# Totals of a scan.

TOTALS = f"""
totals AS (
  SELECT (SELECT count(*) FROM files) AS files,
         (SELECT coalesce(sum({line_count_sql()}), 0)::BIGINT FROM files) AS lines,
         (SELECT count(*) FROM findings) AS total,
         (SELECT coalesce(sum({COST}), 0)::BIGINT FROM findings) AS deduction,
         (SELECT count(*) FROM findings WHERE severity = 'critical') AS critical,
         (SELECT count(*) FROM findings WHERE severity = 'high') AS high,
         (SELECT count(*) FROM findings WHERE severity = 'medium') AS medium,
         (SELECT count(*) FROM findings WHERE severity = 'low') AS low,
         (SELECT count(*) FROM findings WHERE severity = 'info') AS info),
scored AS (SELECT *, {GRADE} AS grade FROM (SELECT *, {SCORE} AS score FROM totals))"""


def rendered_summary(spark, sf):
    return metrics.summary(metrics.tally(rendered_scan(spark, sf)))


@query("tally", found(TREE, f"""
SELECT NULL AS language, rule_id, severity, category, 0 AS files, 0 AS lines, count(*) AS findings
FROM findings GROUP BY rule_id, severity, category
UNION ALL
SELECT language, NULL, NULL, NULL, count(*), sum({line_count_sql()})::BIGINT, 0 FROM files GROUP BY language
"""))
def tally(spark, sf):
    return metrics.tally(count_files(tree_files(spark, sf)))


def _summary_sql(files: str) -> str:
    return f"""WITH {findings_ctes(files)}, {TOTALS}
SELECT '.' AS path, files AS files_scanned, 0 AS files_skipped, lines AS lines_scanned,
       0.0::DOUBLE AS scan_duration_ms, total AS total_findings, critical AS critical, high, medium,
       low, info, deduction, critical + high AS blocking, score, grade FROM scored"""


def _summary_columns(row: DataFrame) -> DataFrame:
    return row.select(
        "path", "files_scanned", "files_skipped", "lines_scanned", "scan_duration_ms",
        "total_findings",
        *[metrics.severity_count(s).alias(s) for s in schema.SEVERITIES],
        "deduction", "blocking", "score", "grade",
    )


@query("summary", _summary_sql(TREE))
def summary(spark, sf):
    return _summary_columns(rendered_summary(spark, sf))


@query("summary_documents", _summary_sql(DOCUMENTS))
def summary_documents(spark, sf):
    return _summary_columns(metrics.summary(metrics.tally(count_files(corpora.documents(spark, sf)))))


@query("severity_counts", found(
    TREE, "SELECT severity, count(*) AS findings, min(severity_rank) AS severity_rank "
    "FROM findings GROUP BY severity ORDER BY severity_rank"))
def severity_counts(spark, sf):
    return metrics.severity_table(metrics.tally(count_files(tree_files(spark, sf))))


@query("category_counts", found(
    TREE, "SELECT category, count(*) AS findings FROM findings GROUP BY category"))
def category_counts(spark, sf):
    return metrics.category_counts(metrics.tally(count_files(tree_files(spark, sf))))


@query("categories_in_use", found(DOCUMENTS, "SELECT DISTINCT category FROM findings"))
def categories(spark, sf):
    return categories_in_use(metrics.tally(documents_scan(spark, sf)).where("rule_id IS NOT NULL"))


_LANGUAGES = f"""
SELECT language, count(*) AS files, sum({line_count_sql(UNIFIED)})::BIGINT AS lines
FROM {TREE} GROUP BY language"""


@query("language_stats", f"{_LANGUAGES} ORDER BY language")
def language_stats(spark, sf):
    return metrics.language_stats(rendered_scan(spark, sf))


@query("languages_by_lines", f"{_LANGUAGES} ORDER BY lines DESC, language")
def languages_by_lines(spark, sf):
    return metrics.languages_by_lines(rendered_scan(spark, sf))


@query("file_counts", found(
    DOCUMENTS,
    "SELECT file_path, count(*) AS findings, count(*) FILTER (severity IN ('critical', 'high')) "
    "AS blocking, min(severity_rank) AS worst_rank FROM findings GROUP BY file_path"))
def file_counts(spark, sf):
    return metrics.file_counts(documents_scan(spark, sf))


@query("rules_hit", found(TREE, """
SELECT rule_id, severity_rank, file_path, line_number, rule_ord, match_ord, title, description,
       severity, cwe_id, n AS findings
FROM (SELECT *, count(*) OVER (PARTITION BY rule_id) AS n, row_number() OVER (
        PARTITION BY rule_id ORDER BY severity_rank, file_path, line_number, rule_ord, match_ord
      ) AS place FROM findings) WHERE place = 1"""))
def rules_hit(spark, sf):
    return metrics.rules_hit(rendered_scan(spark, sf))


@query("gate", f"""WITH {findings_ctes(TREE)}, {TOTALS}
SELECT level, CASE level WHEN 'critical' THEN critical > 0 WHEN 'high' THEN critical + high > 0
       WHEN 'medium' THEN critical + high + medium > 0 WHEN 'low' THEN total > 0 ELSE false END AS fails
FROM scored, (VALUES ('critical'), ('high'), ('medium'), ('low'), ('none')) AS t(level)""")
def gate(spark, sf):
    return metrics.gate(rendered_summary(spark, sf))


@query("caller_outputs", f"""WITH {findings_ctes(TREE)}, {TOTALS}
SELECT total, critical, high, medium, low, score, grade FROM scored""")
def caller_outputs(spark, sf):
    return metrics.caller_outputs(rendered_summary(spark, sf))


@query("duplicate_keys", """
SELECT conv_id::VARCHAR AS rule_id, count(*) AS uses FROM conversations
GROUP BY conv_id HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    turns = read(spark, sf, "conversations")
    return duplicate_ids(turns.select(F.col("conv_id").cast("string").alias("rule_id")))


# Comparison. The current scan moves every line down and says "passphrase" where the
# baseline says "password"; the baseline has no "debug" yet.


def _versions(spark, sf):
    files = tree_files(spark, sf)
    old = F.replace(F.replace("text", F.lit("DEBUG"), F.lit("LEVEL")), F.lit("debug"), F.lit("level"))
    new = F.concat(
        F.lit("x = 1\n"), F.replace("text", F.lit("password"), F.lit("passphrase"))
    )
    return scan_files(files.withColumn("text", new)), scan_files(files.withColumn("text", old))


_OLD = f"(SELECT path, language, size, replace(replace(text, 'DEBUG', 'LEVEL'), 'debug', 'level') AS text FROM {TREE})"
_NEW = f"(SELECT path, language, size, 'x = 1' || chr(10) || replace(text, 'password', 'passphrase') AS text FROM {TREE})"
_STRIPPED = "sha256(regexp_replace(line_content, '^\\s+|\\s+$', '', 'g'))"
# For these tables; a hundred terabytes of texts would take some thousands.
_BUCKETS = 16
COMPARED = ["rule_id", "file_path", "line_number", "match_ord", "line_hash"]


def _compare_sql(left: str, right: str, operator: str) -> str:
    columns = f"rule_id, file_path, line_number, match_ord, {_STRIPPED} AS line_hash"
    return f"""
WITH l AS (WITH {findings_ctes(left)} SELECT {columns} FROM findings),
     r AS (WITH {findings_ctes(right)} SELECT {columns} FROM findings)
SELECT * FROM l WHERE {operator} (
  SELECT 1 FROM r WHERE r.rule_id = l.rule_id AND r.file_path = l.file_path AND r.line_hash = l.line_hash)"""


@query("new_findings", _compare_sql(_NEW, _OLD, "NOT EXISTS"))
def new_findings(spark, sf):
    return compare.new_findings(*_versions(spark, sf)).select(COMPARED)


@query("new_since_report", _compare_sql(_NEW, _OLD, "NOT EXISTS"))
def new_since_report(spark, sf):
    """Against the written JSON report of the older scan, as a team has it on file."""
    current, baseline = _versions(spark, sf)
    place = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    reports.write_report(reports.json_report(keep(baseline)), place)
    reported = keep(reports.read_findings(spark.read.text(place)))
    remove_folder(spark, place)
    return compare.new_since_report(current, reported).select(COMPARED)


@query("new_findings_stored", _compare_sql(_NEW, _OLD, "NOT EXISTS"))
def new_findings_stored(spark, sf):
    """Both scans on file in buckets, compared without a shuffle of either."""
    tables = {}
    for name, scanned in zip(("current", "baseline"), _versions(spark, sf)):
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{table}"
        tables[table] = path, write_hits(scanned, table, _BUCKETS, path)
    compared = keep(compare.new_findings(*[hits for _, hits in tables.values()]).select(COMPARED))
    for table, (path, _) in tables.items():
        spark.sql(f"DROP TABLE {table}")
        remove_folder(spark, path)
    return compared


@query("fixed_findings", _compare_sql(_OLD, _NEW, "NOT EXISTS"))
def fixed_findings(spark, sf):
    return compare.fixed_findings(*_versions(spark, sf)).select(COMPARED)


@query("kept_findings", _compare_sql(_NEW, _OLD, "EXISTS"))
def kept_findings(spark, sf):
    return compare.kept_findings(*_versions(spark, sf)).select(COMPARED)


# One suppression per document, for its own file or (NULL) for all; many have expired.
_SUPPRESSIONS = """
SELECT CASE WHEN lang = 'en' THEN 'CRYPTO001' ELSE 'SEC003' END AS rule_id,
       CASE WHEN lang = 'fr' AND n_chars > 1000 THEN NULL ELSE doc_id::VARCHAR END AS file_path,
       CASE WHEN lang = 'de' THEN NULL ELSE '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END
         AS expires,
       source AS reason
FROM documents"""


def _suppressions(spark, sf):
    lang = F.col("lang")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    return read(spark, sf, "documents").select(
        F.when(lang == "en", "CRYPTO001").otherwise("SEC003").alias("rule_id"),
        F.when((lang != "fr") | (F.col("n_chars") <= 1000), F.col("doc_id").cast("string")).alias(
            "file_path"
        ),
        F.when(lang != "de", F.concat(F.lit("2024-01-"), day)).alias("expires"),
        F.col("source").alias("reason"),
    )


_MARKED = f"""WITH {findings_ctes(DOCUMENTS)},
active AS (SELECT * FROM ({_SUPPRESSIONS}) WHERE expires IS NULL OR expires >= '2024-01-10'),
marked AS (
  SELECT f.rule_id, f.file_path, f.line_number, f.match_ord, coalesce(
    (SELECT min(reason) FROM active a WHERE a.rule_id = f.rule_id AND a.file_path = f.file_path),
    (SELECT min(reason) FROM active a WHERE a.rule_id = f.rule_id AND a.file_path IS NULL)
  ) AS suppressed_by FROM findings f)
"""
_MARK = ["rule_id", "file_path", "line_number", "match_ord"]


@query("suppressed_findings", _MARKED + "SELECT * FROM marked WHERE suppressed_by IS NOT NULL")
def suppressed_findings(spark, sf):
    scanned = documents_scan(spark, sf)
    return compare.suppressed_findings(scanned, _suppressions(spark, sf), "2024-01-10").select(
        *_MARK, "suppressed_by"
    )


@query("active_findings", _MARKED + f"SELECT {', '.join(_MARK)} FROM marked WHERE suppressed_by IS NULL")
def active_findings(spark, sf):
    scanned = documents_scan(spark, sf)
    return compare.active_findings(scanned, _suppressions(spark, sf), "2024-01-10").select(_MARK)


# Sets of public names, from the part and customer tables.

_PUBLISHED = """
SELECT 'brand' AS kind, p_brand AS name FROM part UNION SELECT 'type', p_type FROM part
UNION SELECT 'segment', c_mktsegment FROM customer"""
_CANDIDATE = """
SELECT 'brand' AS kind, p_brand AS name FROM part
UNION SELECT 'type', CASE WHEN p_size > 25 THEN p_type ELSE p_name END FROM part
UNION SELECT 'nation', c_nationkey::VARCHAR FROM customer"""


def _names(spark, sf):
    part, customer = read(spark, sf, "part"), read(spark, sf, "customer")
    brand = part.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("name"))
    published = surface.union_names(
        brand,
        part.select(F.lit("type").alias("kind"), F.col("p_type").alias("name")),
        customer.select(F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("name")),
    )
    newer = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name"))
    candidate = surface.union_names(
        brand,
        part.select(F.lit("type").alias("kind"), newer.alias("name")),
        customer.select(
            F.lit("nation").alias("kind"), F.col("c_nationkey").cast("string").alias("name")
        ),
    )
    return published, candidate


@query("union_names", _PUBLISHED)
def union_names(spark, sf):
    return _names(spark, sf)[0]


@query("qualified_names", f"SELECT DISTINCT kind || ':' || name AS qualified FROM ({_PUBLISHED}) ORDER BY 1")
def qualified_names(spark, sf):
    return surface.qualified(_names(spark, sf)[0])


_CHANGES = f"""
SELECT *, 'removed' AS change FROM (({_PUBLISHED}) EXCEPT ({_CANDIDATE}))
UNION ALL SELECT *, 'added' FROM (({_CANDIDATE}) EXCEPT ({_PUBLISHED}))"""


@query("name_changes", _CHANGES)
def name_changes(spark, sf):
    return surface.changes(*_names(spark, sf))


@query("change_class", f"""
SELECT removed, added, CASE WHEN removed > 0 THEN 'breaking' WHEN added > 0 THEN 'additive'
       ELSE 'internal' END AS change_class
FROM (SELECT count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'added') AS added
      FROM ({_CHANGES}))""")
def change_class(spark, sf):
    return surface.change_class(surface.changes(*_names(spark, sf)))


_RELEASES = """
SELECT version, CASE p_partkey % 3 WHEN 0 THEN 'v' || version WHEN 1 THEN 'v' || p_size
       ELSE 'v99.0.' || p_partkey END AS tag
FROM (SELECT *, p_size || '.' || (p_partkey % 13) || '.' || (p_partkey % 7) AS version FROM part)"""


@query("newest_release", f"""
SELECT tag, version FROM ({_RELEASES})
WHERE NOT regexp_matches(tag, '^v\\d+\\.\\d+\\.\\d+$') OR ltrim(tag, 'v') = version
ORDER BY list_transform(string_split(version, '.'), lambda x: x::INT) DESC,
         regexp_matches(tag, '^v\\d+\\.\\d+\\.\\d+$') DESC, tag LIMIT 1""")
def newest_release(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    version = F.concat_ws(".", size, (key % 13).cast("string"), (key % 7).cast("string"))
    releases = read(spark, sf, "part").select("*", version.alias("version")).select(
        F.when(key % 3 == 0, F.concat(F.lit("v"), "version"))
        .when(key % 3 == 1, F.concat(F.lit("v"), size))
        .otherwise(F.concat(F.lit("v99.0."), key.cast("string")))
        .alias("tag"),
        "version",
    )
    return surface.newest_release(releases)


# Reports, as lines with their sort keys.

KEYS = ["section", "file_path", "severity_rank", "line_number", "rule_ord", "match_ord", "line"]
_STRIP = "regexp_replace(line_content, '^\\s+|\\s+$', '', 'g')"
_MD_MARK = "CASE severity " + " ".join(
    f"WHEN '{s}' THEN '{m}'" for s, m in zip(schema.SEVERITIES, "🔴🟠🟡🔵⚪")
) + " END"
_BODY_KEYS = "1 AS section, file_path, severity_rank, line_number, rule_ord, match_ord"
_HEAD_KEYS = "0 AS section, NULL, NULL, NULL, NULL, NULL"
_FOOT_KEYS = "2 AS section, NULL, NULL, NULL, NULL, NULL"
_RANKED = (
    "row_number() OVER (ORDER BY severity_rank, file_path, line_number, rule_ord, match_ord)"
)


def kept_scan(spark, sf):
    return keep(rendered_scan(spark, sf))


def _report_keys(report: DataFrame) -> DataFrame:
    return report.select(KEYS)


def _json(*fields: tuple[str, str]) -> str:
    """A JSON object as SQL text; values are SQL expressions of JSON."""
    pieces = " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in fields)
    return "'{' || " + pieces + " || '}'"


def _text_json(column: str) -> str:
    return f"to_json({column})::VARCHAR"


_FINDING_JSON = (
    _json(
        ("rule_id", _text_json("rule_id")), ("title", _text_json("title")),
        ("description", _text_json("description")), ("severity", _text_json("severity")),
        ("category", _text_json("category")), ("file_path", _text_json("file_path")),
        ("line_number", "line_number"), ("line_content", _text_json(_STRIP)),
        ("suggestion", _text_json("suggestion")), ("confidence", _text_json("confidence")),
    )[: -len(" || '}'")]
    + " || CASE WHEN cwe_id IS NULL THEN '' ELSE ',\"cwe_id\":' || to_json(cwe_id)::VARCHAR END || '}'"
)
_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
_SARIF_JSON = _json(
    ("ruleId", _text_json("rule_id")), ("level", _text_json(_LEVEL)),
    ("message", _json(("text", _text_json("description")))),
    ("locations", "'[' || " + _json(("physicalLocation", _json(
        ("artifactLocation", _json(("uri", _text_json("file_path")))),
        ("region", _json(("startLine", "line_number"))),
    ))) + " || ']'"),
    ("fixes", "'[' || " + _json(("description", _json(("text", _text_json("suggestion"))))) + " || ']'"),
)


def _comma_sql(body: str) -> str:
    return f"SELECT {_BODY_KEYS}, CASE WHEN {_RANKED} = 1 THEN '' ELSE ',' END || {body} AS line FROM findings"


@query("json_report_findings", found(TREE, _comma_sql(_FINDING_JSON)))
def json_report_findings(spark, sf):
    """The finding lines of the JSON report."""
    return _report_keys(reports.json_report(kept_scan(spark, sf)).where("section = 1"))


def _map_sql(key: str, value: str, source: str) -> str:
    """A JSON object's members, in order of their names."""
    return f"""(SELECT string_agg('"' || {key} || '":' || {value}, ',' ORDER BY {key}) FROM {source})"""


_NULL_KEYS = (
    "NULL AS file_path, NULL AS severity_rank, NULL AS line_number, NULL AS rule_ord, "
    "NULL AS match_ord"
)


def _whole_report_sql(head: str, body: str, foot: str) -> str:
    return f"""WITH {findings_ctes(TREE)}, {TOTALS}
SELECT 0 AS section, {_NULL_KEYS}, {head} AS line FROM scored
UNION ALL ({_comma_sql(body)})
UNION ALL SELECT 2, {_NULL_KEYS}, {quote(foot)}"""


_JSON_HEAD = (
    """'{"version":"0.1.0","path":".","files_scanned":' || files || ',"files_skipped":0,"lines_scanned":'
    || lines || ',"scan_duration_ms":0.0,"total_findings":' || total || ',"severity_counts":{' || """
    + _map_sql("severity", "n", "(SELECT severity, count(*) AS n FROM findings GROUP BY 1)")
    + """ || '},"category_counts":{' || """
    + _map_sql("category", "n", "(SELECT category, count(*) AS n FROM findings GROUP BY 1)")
    + """ || '},"language_stats":{' || """
    + _map_sql(
        "language",
        """'{"files":' || n || ',"lines":' || l || '}'""",
        f"(SELECT language, count(*) AS n, sum({line_count_sql()}) AS l FROM files GROUP BY 1)",
    )
    + """ || '},"findings":['"""
)


@query("json_report", _whole_report_sql(_JSON_HEAD, _FINDING_JSON, "]}"))
def json_report(spark, sf):
    return _report_keys(reports.json_report(kept_scan(spark, sf)))


@query("sarif_report_results", found(TREE, _comma_sql(_SARIF_JSON)))
def sarif_report_results(spark, sf):
    return _report_keys(reports.sarif_report(kept_scan(spark, sf)).where("section = 1"))


_SARIF_RULE = _json(
    ("id", _text_json("rule_id")), ("name", _text_json("title")),
    ("shortDescription", _json(("text", _text_json("title")))),
    ("fullDescription", _json(("text", _text_json("description")))),
    ("defaultConfiguration", _json(("level", _text_json(_LEVEL)))),
)[: -len(" || '}'")] + (
    " || CASE WHEN cwe_id IS NULL THEN '' ELSE ',\"properties\":{\"cwe\":' || "
    "to_json(cwe_id)::VARCHAR || '}' END || '}'"
)


_SARIF_HEAD = (
    """'{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"lintlake","version":"0.1.0","rules":['
    || (SELECT string_agg(rule, ',' ORDER BY severity_rank, file_path, line_number, rule_ord) FROM (
      SELECT *, """ + _SARIF_RULE + """ AS rule, row_number() OVER (
        PARTITION BY rule_ord ORDER BY file_path, line_number, match_ord) AS place FROM findings)
      WHERE place = 1) || ']}},"results":['"""
)


@query("sarif_report", _whole_report_sql(_SARIF_HEAD, _SARIF_JSON, "]}]}"))
def sarif_report(spark, sf):
    return _report_keys(reports.sarif_report(kept_scan(spark, sf)))


@query("sarif_rules", found(TREE, f"""
SELECT severity_rank, file_path, line_number, {_SARIF_RULE} AS rule
FROM (SELECT *, row_number() OVER (PARTITION BY rule_ord ORDER BY file_path, line_number, match_ord)
      AS place FROM findings) WHERE place = 1"""))
def sarif_rules(spark, sf):
    return reports.sarif_rules(rendered_scan(spark, sf)).select(
        "first.severity_rank", "first.file_path", "first.line_number", F.to_json("rule").alias("rule")
    )


def _head_sql(lines: list[str]) -> str:
    """Header or footer rows, one per SQL expression; NULL lines are left out."""
    return "SELECT unnest(list_filter([" + ", ".join(lines) + "], lambda l: l IS NOT NULL)) AS line FROM scored"


def _count_line(name: str, line: str) -> str:
    return f"CASE WHEN {name} > 0 THEN {line} END"


_MARKDOWN_HEAD = _head_sql([
    "'# lintlake Security Report'", "''", "'**Path:** `.`  '",
    "'**Files scanned:** ' || files || '  '", "'**Lines scanned:** ' || format('{:,}', lines::BIGINT) || '  '",
    "'**Scan time:** 0ms  '", "''",
    "'## Security Score: ' || score || '/100 (Grade: ' || grade || ')'", "''", "'## Summary'", "''",
    "'| Severity | Count |'", "'|----------|-------|'",
    *[_count_line(s, f"'| {m} {s.upper()} | ' || {s} || ' |'")
      for s, m in zip(schema.SEVERITIES, "🔴🟠🟡🔵⚪")],
    "''", "'## Findings'", "''",
])


@query("markdown_report", f"""WITH {findings_ctes(TREE)}, {TOTALS}
SELECT {_HEAD_KEYS.replace('NULL, ', 'NULL AS file_path, ', 1)}, line FROM ({_MARKDOWN_HEAD})
UNION ALL SELECT DISTINCT 1, file_path, NULL, NULL, NULL, NULL, '### `' || file_path || '`' || chr(10) FROM findings
UNION ALL SELECT DISTINCT 1, file_path, NULL, NULL, NULL, NULL, '' FROM findings
UNION ALL SELECT {_BODY_KEYS}, '- ' || {_MD_MARK} || ' **[' || rule_id || '] ' || title || '** (L' || line_number || ')'
  || chr(10) || '  - ' || description || chr(10) || '  - 💡 **Fix:** ' || suggestion FROM findings
UNION ALL SELECT {_FOOT_KEYS}, unnest(['---', '*Generated by lintlake v0.1.0*'])
""".replace("0 AS section, NULL AS file_path, NULL, NULL, NULL, NULL",
            "0 AS section, NULL AS file_path, NULL AS severity_rank, NULL AS line_number, "
            "NULL AS rule_ord, NULL AS match_ord"))
def markdown_report(spark, sf):
    return _report_keys(reports.markdown_report(kept_scan(spark, sf), show_fix=True))


_RULE_LINE = "─" * 60
_TEXT_HEAD = _head_sql([
    "chr(10) || 'lintlake v0.1.0 — Code Security Scanner'", f"'{_RULE_LINE}'", "'  Path:    .'",
    "'  Files:   ' || files || ' scanned, 0 skipped'", "'  Lines:   ' || format('{:,}', lines::BIGINT)",
    "'  Time:    0ms'", "''", "'Languages:'", "''", "'Findings: ' || total || ' total'",
    *[_count_line(s, f"'  {s.upper():10s} ' || {s}") for s in schema.SEVERITIES],
    "''", f"'{_RULE_LINE}'",
])


def _text_sql(fix: str = "''") -> str:
    return f"""WITH {findings_ctes(TREE)}, {TOTALS}
SELECT 0 AS section, NULL AS file_path, NULL AS severity_rank, NULL AS line_number,
       NULL AS rule_ord, NULL AS match_ord, line FROM ({_TEXT_HEAD})
UNION ALL SELECT {_HEAD_KEYS}, '  ' || rpad(language, 15, ' ') || ' ' || lpad(n::VARCHAR, 4, ' ') || ' files  '
  || lpad(format('{{:,}}', lines::BIGINT), 8, ' ') || ' lines'
  FROM (SELECT language, count(*) AS n, sum({line_count_sql()}) AS lines FROM files GROUP BY language)
UNION ALL SELECT DISTINCT 1, file_path, NULL, NULL, NULL, NULL, chr(10) || file_path FROM findings
UNION ALL SELECT {_BODY_KEYS}, '  ' || rpad(upper(severity), 8, ' ') || '  L' || rpad(line_number::VARCHAR, 5, ' ')
  || ' [' || rule_id || '] ' || title || chr(10) || '           ' || substr({_STRIP}, 1, 80) || {fix} FROM findings
UNION ALL SELECT {_FOOT_KEYS}, unnest([chr(10) || '{_RULE_LINE}',
  chr(10) || 'Security Score: ' || score || '/100 (Grade: ' || grade || ')', '']) FROM scored
"""


@query("text_report", _text_sql())
def text_report(spark, sf):
    return _report_keys(reports.text_report(kept_scan(spark, sf)))


@query("text_report_fixes", _text_sql(
    "CASE WHEN suggestion <> '' THEN chr(10) || '           💡 ' || suggestion ELSE '' END"))
def text_report_fixes(spark, sf):
    return _report_keys(reports.text_report(kept_scan(spark, sf), show_fix=True))


@query("step_summary", f"""WITH {findings_ctes(TREE)}, {TOTALS}
SELECT line FROM ({_head_sql([
    "'## lintlake Security Scan Results'", "''", "'| Metric | Value |'", "'|--------|-------|'",
    "'| Security Score | **' || score || '/100** (Grade: ' || grade || ') |'",
    "'| Total Findings | ' || total || ' |'",
    _count_line("critical", "'| :red_circle: Critical | **' || critical || '** |'"),
    _count_line("high", "'| :orange_circle: High | **' || high || '** |'"),
    _count_line("medium", "'| :yellow_circle: Medium | ' || medium || ' |'"),
    _count_line("low", "'| :large_blue_circle: Low | ' || low || ' |'"),
    "''",
])})""")
def step_summary(spark, sf):
    return reports.step_summary(rendered_summary(spark, sf)).select("line")


@query("written_report", f"SELECT line FROM ({_whole_report_sql(_JSON_HEAD, _FINDING_JSON, ']}')})")
def written_report(spark, sf):
    """The JSON report written as text and read back."""
    place = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    reports.write_report(reports.json_report(kept_scan(spark, sf)), place)
    return spark.read.text(place).select(F.col("value").alias("line"))
