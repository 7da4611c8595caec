"""Quality rules, personal data and URL filters against plain Python."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lintlake.llm import pii, quality_rules, url_filter
from lintlake.sources.store import keep
from tests.llm import cases


def measured(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), hit and len(hit) or 0


def test_measures(docs):
    short = docs.where("length(text) < 5000 OR text IS NULL")
    got = quality_rules.measure(short.drop("n_words")).collect()
    assert len(got) == 20
    for row in got:
        want = measured(row["text"])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_hosts_shrink_towards_all(spark):
    rows = [("big", i, False) for i in range(90)] + [("bad", i, True) for i in range(90)] + [("one", 0, True)]
    table = spark.createDataFrame(rows, "host string, id int, base_failed boolean").withColumns(
        {"n_symbols": F.lit(0), "n_words": F.lit(100), "n_dup_lines": F.lit(0), "n_lines": F.lit(5)}
    )
    rates = {r["host"]: r["host_rate"] for r in quality_rules.host_rates(table).collect()}
    assert rates["big"] < 0.1 and 0.9 < rates["bad"] < 1 and rates["one"] < rates["bad"]


def test_hosts_verdict_counts_where_documents_are_between(spark):
    between = " ".join(f"w{i}" + "#" * (i % 3 == 0) for i in range(99))
    rows = [("good", cases.prose(i, 60)) for i in range(20)] + [("bad", "#### " * 60)] * 20
    rows += [("good", between), ("bad", between), ("bad", cases.prose(99, 60))]
    table = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    kept = {r["key"]: r["kept"] for r in quality_rules.judge(table, key="doc_id").withColumnRenamed("doc_id", "key").collect()}
    assert kept[40] and not kept[41] and kept[42]


def test_kept_documents_keep_their_rows(docs, none):
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    verdicts = {(r["doc_id"], r["n_words"] >= 50 and not r["base_failed"]) for r in quality_rules.judge(docs).collect()}
    assert {r["row"] for r in kept.collect()} <= {r["row"] for r in docs.collect()}
    assert (16, True) not in verdicts and kept.where("doc_id = 2").count() == 2
    assert quality_rules.kept_documents(none).count() == 0 and quality_rules.judge(none).count() == 0


def brute_spans(text):
    found = []
    for kind in pii.KINDS:
        if not kind.base:
            continue
        for m in re.finditer(kind.plain, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind.name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind.name == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind.name == "card":
                total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            found.append((kind.name, m.start(), m.end()))
    return found


def test_pii_against_python(spark):
    rng = random.Random(3)
    pieces = ["a@b.c", "x.y@mail.example.com_z@q.r", "1.2.3.4.5", "999.1.1.1", "0001.02.3.255", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 (", "é", "日", " ", "\n", "..", "@@", "12", "-", "a" * 50]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(200))) for _ in range(60)] + [None, ""]
    # Several hundred matches, so positions go over blocks.
    texts.append("é me@here.org " * 500)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in pii.digest(table).collect():
        spans = brute_spans(texts[row["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), texts[row["doc_id"]]
        assert row["spans"].startswith(written)
        assert row["n_email"] == sum(k == "email" for k, _, _ in spans)


def test_pii_checks_and_context(spark):
    texts = {
        1: "account DE89 3704 0044 0532 0130 00 please", 2: "account DE88 3704 0044 0532 0130 00 please",
        3: "my social security number 123-45-6789", 4: "part 123-45-6789", 5: "card 4111 1111 1111 1111",
    }
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(table).collect()}
    assert spans == {1: "iban:8:35", 2: "", 3: "ssn:26:37", 4: "", 5: "card:5:24"}


def test_pii_long_runs_are_linear(spark):
    text = "a" * 1_000_000 + "1" * 1_000_000 + "." * 1000
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.digest(table).first()["spans"] == ""


def test_pii_cases(docs, none):
    assert pii.digest(docs).count() == docs.count() and pii.digest(none).count() == 0


def test_urls_against_brute_force(spark):
    rng = random.Random(5)
    labels, parts = ["com", "net", "a", "b", "www", "a-b", "é", ""], ["", "/", "/x", "/x/", "/x/y/", "/xy"]
    rules = list({(".".join(rng.choice(labels[:6]) for _ in range(rng.randrange(1, 4))), rng.choice(parts[1:])): None for _ in range(25)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [None, "", "no scheme", "http://", "x://y://z"] + [
        f"http{rng.choice(['', 's'])}://{'.'.join(rng.choice(labels + ['COM', 'A']) for _ in range(rng.randrange(1, 5)))}"
        f"{rng.choice(parts)}{rng.choice(['', 'tail', '?q=/x/', '#/x'])}" for _ in range(400)
    ]
    urls += urls[-20:]
    pages = spark.createDataFrame([(k, u, "own") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for row in url_filter.judge(pages, table).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[row["page_id"]] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        want = max(fits, default=(0, 0, None, "allow"))[2:]
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, *want)
    assert url_filter.judge(pages, table.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    assert url_filter.judge(pages.limit(0), table).count() == 0


@pytest.mark.parametrize("operator", [quality_rules, pii, url_filter])
def test_native(operator):
    source = open(operator.__file__).read()
    assert not re.search(r"pandas|pyarrow|mapIn|applyIn|\.rdd|udf", source)


def test_pii_context_on_both_sides(spark):
    far = " " + "x" * pii.CONTEXT_CHARS + " "
    texts = [
        "SSN 123-45-6789, 987-65-4321", "SSN (2024-01-02): 123-45-6789", "123-45-6789 (SSN)", f"ssn{far}123-45-6789{far}ssn",
        "é日 " * 70 + "SSN 123-45-6789", "é日 " * 70 + "123-45-6789 is my Social security number" + " é" * 70,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(table).collect()}
    assert got == {0: "ssn:4:15,ssn:17:28", 1: "ssn:18:29", 2: "ssn:0:11", 3: "", 4: "ssn:214:225", 5: "ssn:210:221"}


def test_pii_iban_ends_at_its_length(spark):
    at, be, no = "AT611904300234573201", "BE68 5390 0754 7034", "NO93 8601 1117 947"
    texts = [
        f"{at} The", f"{be} Thanks", f"{at} {be} {no} 1 A", f"{at}X and {at}A", f"{at}.", no, f"{be[:-1]}5 Thanks",
        "GB29 NWBK 6016 1331 9268 19 UK", "GB29NWBK60161331926819 AND MORE TEXT", f"é {at} T" * 200, "MA64011519000001205000534921 Ok",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(table).collect()}
    assert got == {
        0: "iban:0:20", 1: "iban:0:19", 2: "iban:0:20,iban:21:40,iban:41:59", 3: "", 4: "iban:0:20", 5: "iban:0:18", 6: "",
        7: "iban:0:27", 8: "iban:0:22", 9: ",".join(f"iban:{24 * k + 2}:{24 * k + 22}" for k in range(200)), 10: "",
    }


HARD = [
    "SSN 5-123-45-6789", "my SSN: 1-123-45-6789-2", "SSN 000-12-3456, 666-12-3456, 123-00-3456, 123-45-0000",
    "ssn 123-45-67890 1123-45-6789 223-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x',
    "password: 'correct horse'; pwd='abcdefgh', pwd='12345678', API_KEY: \"a1b2c3d4\"", "AKIA" + "A1" * 8, "xAKIA" + "A1" * 8,
    "ghp_" + "aB3" * 12 + " key", "é sk_live_" + "0aB" * 8 + ", AIza" + "x" * 35, "AKIA" + "A" * 17, None, "",
    "account AT611904300234573201 The", "bank BE68 5390 0754 7034 Thanks", "XQ12 3456 7890 1234 5678", "(IBAN) NO93 8601 1117 947 1 A",
    "4111 1111 1111 1111 card", "call +1 (555) 123-4567 or a@b.co at 10.0.0.1",
]


def test_pii_secrets_and_numbers(spark):
    table = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["spans"], r["n_secret"], r["n_spans"]) for r in pii.digest(table).collect()}
    assert [got[k] for k in range(5)] == [
        ("ssn:6:17", 0, 1), ("ssn:10:21", 0, 1), ("", 0, 0), ("ssn:30:41", 0, 1), ("secret:0:50", 1, 1)]
    assert got[5] == (f"secret:{HARD[5].index('API')}:{len(HARD[5])}", 1, 1) and got[6] == ("key:0:20", 1, 1) and got[7] == ("", 0, 0)
    assert got[8] == ("key:0:40", 1, 1) and got[9] == ("key:2:34,key:36:75", 2, 2) and got[10] == got[11] == got[12] == ("", 0, 0)


def test_pii_against_sql(spark):
    """Rows that only a method with both contexts, country lengths and longer runs gets right."""
    rows = [(k, text) for k, text in enumerate([*HARD, " ".join(t or "" for t in HARD), "é日 " * 30 + "SSN 123-45-6789"])]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(pii.SQL).df()
    got = pii.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    assert got.sort_values("doc_id").values.tolist() == want[got.columns].sort_values("doc_id").values.tolist()


def test_pii_keeps_columns_of_any_name(spark):
    rows = [(1, "a@b.co", "own", "mine", 5)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, email string, _base string, row int")
    found = pii.find(table)
    assert found.columns == [*table.columns, "spans"]
    assert found.select(table.columns).first() == rows[0] and found.first()["spans"][0]["end"] == 6


def test_a_path_of_many_hosts_is_swept_once(spark, monkeypatch):
    """Forty thousand home pages below one rule are one key, and one row of the sweep."""
    pages = spark.range(40_000).selectExpr("id AS page_id", "concat('http://h', id, '.com/') AS url")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    stored = []
    monkeypatch.setattr(url_filter, "keep", lambda table: stored.append(keep(table)) or stored[-1])
    got = url_filter.judge(pages, rules)
    assert got.where("rule = 'com/' AND verdict = 'allow'").count() == 40_000
    swept = next(table for table in stored if "slice" in table.columns)
    assert swept.count() == 1 + len(url_filter.RULES)
