"""Personal data: regular expressions propose, checksums confirm, context words weigh.

Everything is a column expression on the whole text. A pattern is searched once for its
matches; the text between them gives the positions. The patterns start at the first character
of a run or right behind the last match (`\\G`) and do not go back (`++`), so that a long run
without a match costs no more than its length.

Besides personal data it finds secrets: keys whose prefix and length their issuers publish, and
values with letters and digits that are assigned to a name such as `token`. A null text is as an
empty one and has no spans; equal rows give equal rows; an empty table gives an empty result; a
caller's columns keep their names and values whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.columns import bind, boxed, text_of, total

# How far before and after a match context words count, and the score a proposed span needs.
CONTEXT_CHARS = 40
NEEDED = 0.7
_BLOCK = 64
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


class Kind(NamedTuple):
    name: str
    pattern: str  # Java; of an IBAN its start, with all that may belong to it as group 1
    plain: str  # the same matches, for SQL engines without lookbehind
    hint: str  # what every match holds
    score: float  # of a match that passes its check
    context: str  # words that raise the score
    raised: float
    base: bool  # kept whatever the score


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# A name and the quoted value that it is given.
_NAMED = (
    r"(?i)(?:token|secret|passwd|password|pwd|bearer|api[_-]?key|access[_-]?key)['\x22]? {0,3}[=:] {0,3}"
    r"['\x22][A-Za-z0-9+/_=.~!@#$%^&*-]{8,200}['\x22]"
)
# Prefixes and lengths of issued keys.
_ISSUED = (
    "^(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|AIza[A-Za-z0-9_-]{35}"
    "|[sr]k_live_[A-Za-z0-9]{24,99}|xox[abprs]-[A-Za-z0-9-]{10,200})$"
)
# Area, group and serial numbers that are never given out. Areas from 900 on are
# those of taxpayers' numbers, which have the same form.
_NO_SSN = "^(?:000|666)|-00-|-0000$"
KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "@", 0.9, "mail|contact|write", 0.1, True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "[0-9]", 0.7, "ip|host|server|address", 0.3, True,
    ),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9])+", "[0-9]", 0.9,
         "card|visa|credit|payment", 0.1, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"\+", 0.8,
         "phone|call|tel|fax|mobile", 0.2, True),
    Kind("iban", r"(?=([A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?[A-Z0-9]?))[A-Z][A-Z][0-9][0-9]",
         r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "[0-9]", 0.8,
         "iban|account|bank", 0.2, False),
    Kind("ssn", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", r"[0-9]+(?:-[0-9]+)+", "[0-9]-[0-9]",
         0.4, "ssn|social", 0.5, False),
    Kind("key", r"[A-Za-z0-9_-]{20,}+", r"[A-Za-z0-9_-]{20,}", "A[KS]IA|gh[pousr]_|AIza|_live_|xox[abprs]-", 0.9,
         "key|token", 0.1, False),
    Kind("secret", _NAMED, _NAMED, "[=:] {0,3}['\"]", 0.8, "key|token|secret", 0.2, False),
]
BASE = [kind.name for kind in KINDS if kind.base]
SECRETS = ["key", "secret"]
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Characters of an IBAN by country, as registered.
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
    "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weighed(char: Column, i: Column) -> Column:
        digit = char.cast("int")
        double = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, double).otherwise(digit).cast("bigint")

    return total(F.transform(F.split(F.reverse(digits), ""), weighed)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a code of digits and capitals, moved on by four, leaves 1 modulo 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(left: Column, char: Column) -> Column:
        value = F.position(char, F.lit(_ALPHABET)) - 1
        return (left * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits) < 20, luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return match != ""
    if kind == "ssn":
        return ~match.rlike(_NO_SSN)
    if kind == "key":
        return match.rlike(_ISSUED)
    if kind == "secret":
        return match.rlike(r"['\x22][^'\x22]*[0-9][^'\x22]*['\x22]$") & match.rlike(r"['\x22][^'\x22]*[A-Za-z][^'\x22]*['\x22]$")
    return F.lit(True)


def _iban(run: Column) -> Column:
    """The start of a run that is an IBAN, else an empty string.

    It ends where no digit or capital follows, has its country's registered length and passes
    the check. A code of a country without one is no IBAN.
    """

    def at(n: Column) -> Column:
        return F.substring(F.concat(run, F.lit(" ")), n, F.lit(1))

    def passes(start: Column) -> Column:
        def checked(code: Column) -> Column:
            known = F.position(F.left(code, F.lit(2)), F.lit(_IBAN_LENGTHS))
            length = F.substring(F.lit(_IBAN_LENGTHS), known + 2, F.lit(2))
            right = (known > 0) & (F.length(code).cast("string") == length)
            return F.when(right, mod97(code)).otherwise(False)

        return bind(F.replace(start, F.lit(" "), F.lit("")), checked)

    ends = F.filter(F.sequence(F.length(run), F.lit(12), F.lit(-1)), lambda n: (at(n) != " ") & (at(n + 1) == " "))
    found = F.filter(F.transform(ends, lambda n: F.left(run, n)), passes)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def _apart(spans: Column) -> Column:
    """Spans in order without those that begin within one before them that stays."""

    def joined(kept: Column, span: Column) -> Column:
        inside = F.coalesce(F.get(kept, F.size(kept) - 1)["end"] > span["start"], F.lit(False))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(span)))

    def sorted_out(spans: Column) -> Column:
        begin = F.transform(spans, lambda s, i: F.coalesce(F.get(spans, i - 1)["end"] > s["start"], F.lit(False)))
        clash = F.exists(begin, lambda b: b)
        return F.when(clash, F.aggregate(spans, F.array().cast(_SPAN), joined)).otherwise(spans)

    return bind(spans, sorted_out)


def _before(values: Column) -> Column:
    """For each element the sum of those before it, added up by blocks."""

    def sums(array: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / _BLOCK).cast("int"))

        def spread(block_sums: Column) -> Column:
            def one(block: Column) -> Column:
                offset = total(F.slice(block_sums, F.lit(1), block))
                inner = F.sequence(F.lit(0), F.least(F.lit(_BLOCK), F.size(array) - block * _BLOCK) - 1)
                return bind(
                    offset,
                    lambda base: F.transform(
                        inner, lambda k: base + total(F.slice(array, block * _BLOCK + 1, k))
                    ),
                )

            return F.flatten(F.transform(blocks, one))

        return bind(
            F.transform(blocks, lambda b: total(F.slice(array, b * _BLOCK + 1, F.lit(_BLOCK)))), spread
        )

    return bind(values, sums)


def _nearby(pieces: Column, start: Column, end: Column) -> Column:
    """CONTEXT_CHARS of the text on both sides of a match, a newline in its place.

    `pieces` are the text in runs of _BLOCK, so that a match costs the same wherever it is.
    """

    def cut(low: Column, high: Column) -> Column:
        at = F.floor(low / _BLOCK).cast("int")
        two = F.concat(*[F.coalesce(F.get(pieces, at + k), F.lit("")) for k in range(2)])
        return F.substring(two, (low % _BLOCK + 1).cast("int"), (high - low).cast("int"))

    return F.concat(cut(F.greatest(start - CONTEXT_CHARS, F.lit(0)), start), F.lit("\n"), cut(end, end + CONTEXT_CHARS))


def _spans(text: Column, kind: Kind) -> Column:
    none = F.array().cast(_SPAN)

    def placed(matches: Column) -> Column:
        def among(gaps: Column, pieces: Column) -> Column:
            iban = kind.name == "iban"
            steps = F.transform(
                matches,
                lambda m, i: (F.length(F.get(gaps, i)) + (F.lit(4) if iban else F.length(m))).cast("bigint"),
            )

            def span(match: Column, i: Column, before: Column) -> Column:
                if iban:
                    return bind(_iban(match), lambda found: one(found, i, before))
                return one(match, i, before)

            def one(match: Column, i: Column, before: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                near = F.lower(_nearby(pieces, start, start + F.length(match))).rlike(kind.context)
                score = F.round(F.lit(kind.score) + F.when(near, kind.raised).otherwise(0.0), 2)
                return F.struct(
                    F.lit(kind.name).alias("kind"),
                    start.alias("start"),
                    (start + F.length(match)).alias("end"),
                    score.alias("score"),
                    _valid(kind.name, match).alias("valid"),
                )

            found = bind(_before(steps), lambda before: F.transform(matches, lambda m, i: span(m, i, before)))
            good = F.filter(found, lambda s: s["valid"] & (F.lit(kind.base) | (s["score"] >= NEEDED)))
            good = F.transform(good, lambda s: s.dropFields("valid"))
            return _apart(good) if iban else good

        cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))
        searched = bind(F.split(text, kind.pattern, -1), lambda gaps: bind(cut, lambda pieces: among(gaps, pieces)))
        return F.when(F.size(matches) > 0, searched).otherwise(none)

    all_ = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(int(kind.name == "iban")))
    return F.when(text.rlike(kind.hint), bind(all_, placed)).otherwise(none)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace or add `spans`: kind, start, end (code points, end exclusive) and score.

    Base kinds come first, as `KINDS` lists them, each by start; spans of other kinds that
    touch a base span are left out.
    """
    found = boxed(docs, **{kind.name: _spans(text_of(text), kind) for kind in KINDS})
    base = F.concat(*[F.col(name) for name in BASE])
    more = F.concat(*[F.col(kind.name) for kind in KINDS if not kind.base])

    def apart(span: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    spans = found.select("row", base.alias("base"), more.alias("more")).select(
        "row", F.concat("base", F.filter("more", apart)).alias("spans")
    )
    own = [F.col("row")[c].alias(c) for c in docs.columns if c != "spans"]
    return spans.select(*own, "spans")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by base kind, a hash of the base spans, all spans as a string, and how many of them
    are secrets and how many there are."""
    found = find(docs.select(F.col(key).alias(key), F.col(text).alias("_text")), "_text").drop("_text")

    def count(kinds: list[str]) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"].isin(kinds))).cast("bigint")

    counts = [count([name]).alias(f"n_{name}") for name in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select(
        key,
        *counts,
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count(SECRETS).alias("n_secret"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def _sql() -> str:
    """The same for DuckDB, by positions: every proposal with the text on both sides of it."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    quoted = lambda inner: f"regexp_matches(m, '[''\\x22][^''\\x22]*{inner}[^''\\x22]*[''\\x22]$')"
    valid = {
        "email": "true",
        "ip": rf"regexp_matches(m, '^{_PART}(?:\.{_PART}){{3}}$')",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), "
                "lambda c, i: CASE WHEN i % 2 = 0 THEN 2 * c::INT - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END ELSE c::INT END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": "true",
        "ssn": f"NOT regexp_matches(m, '{_NO_SSN}')",
        "key": f"regexp_matches(m, '{_ISSUED}')",
        "secret": f"{quoted('[0-9]')} AND {quoted('[A-Za-z]')}",
    }
    run = "[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?[A-Z0-9]?"
    code = "replace(left(run, z), ' ', '')"
    moved = f"(substr({code}, 5) || substr({code}, 1, 4))"
    mod97 = (
        f"list_reduce(list_concat([0], list_transform(string_split({moved}, ''), lambda c: strpos('{_ALPHABET}', c)::INT - 1)), "
        "lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    )
    length = f"substr('{_IBAN_LENGTHS}', strpos('{_IBAN_LENGTHS}', left(run, 2)) + 2, 2)"
    ends = (
        f"list_filter(range(length(run), 11, -1), lambda z: substr(run || ' ', z, 1) <> ' ' AND substr(run || ' ', z + 1, 1) = ' ' "
        f"AND strpos('{_IBAN_LENGTHS}', left(run, 2)) > 0 AND length({code})::VARCHAR = {length} AND {mod97})"
    )

    def placed(pattern: str) -> str:
        pattern = pattern.replace("'", "''")
        return f"""
  SELECT r, t, ms[i] AS m, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT r, t, ms, gaps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))"""

    def proposals(kind: Kind) -> str:
        if kind.name == "iban":
            return f"""
  SELECT r, t, left(run, ends[1]) AS m, s FROM (
    SELECT *, {ends} AS ends FROM (
      SELECT r, t, s, regexp_extract(substr(t, s + 1), '^{run}') AS run FROM ({placed('[A-Z][A-Z][0-9][0-9]')}))
  ) WHERE len(ends) > 0"""
        if kind.name == "ssn":
            return f"""
  SELECT r, t, array_to_string(parts[j:j + 2], '-') AS m,
         (s + coalesce(list_sum(list_transform(parts[1:j - 1], lambda x: length(x) + 1)), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(parts) - 1)) AS j FROM (
    SELECT r, t, s, string_split(m, '-') AS parts FROM ({placed(kind.plain)})))
  WHERE length(parts[j]) = 3 AND length(parts[j + 1]) = 2 AND length(parts[j + 2]) = 4"""
        return placed(kind.plain)

    parts = []
    for n, k in enumerate(KINDS):
        near = f"substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS})) || chr(10) || substr(t, s + length(m) + 1, {CONTEXT_CHARS})"
        parts.append(f"""
SELECT r, {n} AS n, '{k.name}' AS kind, s, s + length(m) AS e FROM ({proposals(k)})
WHERE CASE WHEN {valid[k.name]} THEN {str(k.base).lower()} OR round({k.score} + CASE WHEN
  regexp_matches(lower({near}), '{k.context}') THEN {k.raised} ELSE 0 END, 2) >= {NEEDED} ELSE false END""")
    n_base = len(BASE)
    iban = [k.name for k in KINDS].index("iban")
    counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
k AS (SELECT * FROM f WHERE n < {n_base} OR NOT EXISTS (
        SELECT 1 FROM f AS b WHERE b.r = f.r AND (b.n < {n_base} AND b.s < f.e AND f.s < b.e
          OR f.n = {iban} AND b.n = {iban} AND b.s < f.s AND f.s < b.e))),
g AS (SELECT r, {counts}, count(*) FILTER (kind IN ('{"', '".join(SECRETS)}')) AS n_secret, count(*) AS n_spans,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY n, s) FILTER (n < {n_base}) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY n, s) AS spans FROM k GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0)::BIGINT AS n_{name}' for name in [*BASE, 'secret', 'spans'])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
