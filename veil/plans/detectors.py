"""Queries of recognizers over documents and pages, and of validators over identifiers derived from keys."""

from pyspark.sql import functions as F

from veil.functions import checksums
from veil.functions.scan import exploded
from veil.operators.recognizers import GENERAL, IPV6, NATIONAL, recognize
from veil.plans import sql
from veil.sources import read_table

KINDS = {"email": "EMAIL_ADDRESS", "ipv4": "IP_ADDRESS", "credit_card": "CREDIT_CARD", "phone": "PHONE_NUMBER", "secret": "SECRET"}
QUERIES, ORACLE_SQL = {}, {}


def _detector(kind: str, table: str, key: str, text: str):
    r = sql.recognizer(kind)

    def query(spark, sf_dir):
        t = F.col(text)
        rows = exploded(read_table(spark, sf_dir, table).select(key, t), recognize(t, r), "s")
        return rows.select(key, "s.start", "s.end", F.substring(t, F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))

    check = f"WHERE {sql.luhn('v')}" if kind == "CREDIT_CARD" else ""
    found = sql.matches("f", f"SELECT {key}, {text} AS t FROM {table}", r.pattern, key)
    return query, f'WITH {found} SELECT {key}, s AS start, e AS "end", v AS value FROM f {check}'


for _name, _kind in KINDS.items():
    for _table, _key, _text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        _q = f"detect_{_name}" + ("" if _table == "documents" else "_pages")
        QUERIES[_q], ORACLE_SQL[_q] = _detector(_kind, _table, _key, _text)

#: Candidates from a key ``k``, as an expression that both engines read, and their check in SQL over ``v``.
_D = lambda n: f"lpad(CAST(k AS VARCHAR(20)), {n}, '0')"
_TWO = "lpad(CAST(k % 97 AS VARCHAR(20)), 2, '0')"
_digit = lambda i: f"CAST(substr(v, {i}, 1) AS INT)"
_OIB = "list_reduce(list_transform(string_split(substr(v, 1, 10), ''), lambda c: CAST(c AS INT)), lambda a, d: CASE WHEN (a + d) % 10 = 0 THEN 20 ELSE (a + d) % 10 * 2 END % 11, 10)"
_CNP_REST = f"{sql.weighted('v', checksums.CNP_WEIGHTS)} % 11"
_PPSN_REST = f"({sql.weighted('v', checksums.PPSN_WEIGHTS)} + CASE WHEN length(v) = 9 THEN (ascii(substr(v, 9, 1)) - 64) * 9 ELSE 0 END) % 23"
_JMBG = f"(11 - {sql.weighted('v', checksums.JMBG_WEIGHTS)} % 11)"
_NHS = f"(11 - {sql.weighted('v', checksums.NHS_WEIGHTS)} % 11)"
_big = lambda digits: f"CAST({digits} AS HUGEINT) % 97 = 1"
CHECKS = {
    "oib": (checksums.oib, f"concat({_D(10)}, CAST(k % 10 AS VARCHAR(20)))", f"(11 - {_OIB}) % 10 = {_digit(11)}"),
    "jmbg": (checksums.jmbg, f"concat({_D(12)}, CAST(k % 10 AS VARCHAR(20)))", f"CASE WHEN {_JMBG} > 9 THEN 0 ELSE {_JMBG} END = {_digit(13)}"),
    "cnp": (checksums.cnp, f"concat('1', '99', lpad(CAST(k % 14 AS VARCHAR(20)), 2, '0'), lpad(CAST(k % 33 AS VARCHAR(20)), 2, '0'), {_D(5)}, CAST(k % 10 AS VARCHAR(20)))",
            f"CAST(substr(v, 4, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(v, 6, 2) AS INT) BETWEEN 1 AND 31 AND CAST(substr(v, 8, 2) AS INT) BETWEEN 1 AND 52 AND CASE WHEN {_CNP_REST} = 10 THEN 1 ELSE {_CNP_REST} END = {_digit(13)}"),
    "ppsn": (checksums.ppsn, f"concat({_D(7)}, substr('ABCDEFGHIJKLMNOPQRSTUVW', CAST(k % 23 + 1 AS INT), 1), CASE WHEN k % 3 = 0 THEN 'A' ELSE '' END)",
             f"CASE WHEN {_PPSN_REST} = 0 THEN 'W' ELSE chr(CAST({_PPSN_REST} + 64 AS INT)) END = substr(v, 8, 1)"),
    "nino": (checksums.nino, f"concat(substr('ABCDEFGHJKLNOQTZ', CAST(k % 16 + 1 AS INT), 1), substr('BGKNTZADFO', CAST(k % 10 + 1 AS INT), 1), {_D(6)}, substr('ABCDE', CAST(k % 5 + 1 AS INT), 1))",
             "regexp_full_match(v, '[A-Z]{2}[0-9]{6}[A-D]') AND substr(v, 1, 2) NOT IN ('BG','GB','KN','NK','NT','TN','ZZ') AND NOT regexp_matches(v, '^[DFIQUV]') AND NOT regexp_matches(v, '^.[DFIOQUV]')"),
    "utr": (checksums.utr, f"concat({_D(9)}, CASE WHEN k % 2 = 0 THEN '1' WHEN k % 3 = 0 THEN 'x' ELSE '' END)", "regexp_full_match(v, '[0-9]{10}')"),
    "ssn": (checksums.ssn, "concat(lpad(CAST(k % 1000 AS VARCHAR(20)), 3, '0'), '-', lpad(CAST(k % 7 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(k % 11 AS VARCHAR(20)), 4, '0'))",
            "substr(v, 1, 3) NOT IN ('000', '666') AND substr(v, 1, 3) < '900' AND substr(v, 5, 2) <> '00' AND substr(v, 8, 4) <> '0000'"),
    "ein": (checksums.ein, f"concat(lpad(CAST(k % 100 AS VARCHAR(20)), 2, '0'), CASE WHEN k % 2 = 0 THEN '-' ELSE ' ' END, {_D(7)})", "regexp_full_match(v, '[0-9]{2}-[0-9]{7}')"),
    "nhs": (checksums.nhs, f"concat({_D(9)}, CAST(k % 10 AS VARCHAR(20)))", f"CASE WHEN {_NHS} = 11 THEN 0 ELSE {_NHS} END = {_digit(10)}"),
    "card": (checksums.luhn, f"concat('4', {_D(15)})", sql.luhn("v")),
    "iban_hr": (checksums.mod97, f"concat('HR', {_TWO}, {_D(17)})", _big("concat(substr(v, 5), '1727', substr(v, 3, 2))")),
    "iban_ie": (checksums.mod97, f"concat('IE', {_TWO}, 'AAAA', {_D(14)})", _big("concat('10101010', substr(v, 9), '1814', substr(v, 3, 2))")),
    "iban_ro": (checksums.mod97, f"concat('RO', {_TWO}, 'AAAA', {_D(16)})", _big("concat('10101010', substr(v, 9), '2724', substr(v, 3, 2))")),
    "iban_gb": (checksums.mod97, f"concat('GB', {_TWO}, 'AAAA', {_D(14)})", _big("concat('10101010', substr(v, 9), '1611', substr(v, 3, 2))")),
}


def _validator(check, candidate: str, test: str):
    def query(spark, sf_dir):
        rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
        return rows.selectExpr("k", f"{candidate} AS v").select(F.col("k").alias("o_orderkey"), F.col("v").alias("candidate"), check(F.col("v")).alias("valid"))

    return query, f"WITH c AS (SELECT o_orderkey AS k FROM orders), d AS (SELECT k, {candidate} AS v FROM c) SELECT k AS o_orderkey, v AS candidate, {test} AS valid FROM d"


for _name, _check in CHECKS.items():
    QUERIES[f"validate_{_name}"], ORACLE_SQL[f"validate_{_name}"] = _validator(*_check)

#: Types that are detected in texts with their candidates: name, type, name of the check, and what the SQL's pattern has before the value.
NATIONAL_KINDS = (
    ("hr_oib", "HR_OIB", "oib", ""), ("hr_jmbg", "HR_JMBG", "jmbg", ""), ("hr_iban", "HR_IBAN", "iban_hr", ""), ("ie_ppsn", "IE_PPSN", "ppsn", ""),
    ("ro_cnp", "RO_CNP", "cnp", ""), ("uk_nino", "UK_NINO", "nino", ""), ("uk_utr", "UK_UTR", "utr", "UTR "), ("us_ssn", "US_SSN", "ssn", ""),
    ("us_ein", "US_EIN", "ein", ""), ("ie_iban", "IE_IBAN", "iban_ie", ""), ("ro_iban", "RO_IBAN", "iban_ro", ""), ("gb_iban", "GB_IBAN", "iban_gb", ""),
)
#: A candidate after a keyword or another word, and again inside longer words.
_TEXT = "concat(CASE WHEN k % 2 = 0 THEN 'UTR ' ELSE 'no ' END, v, ', x', v, ' ', v, '9.')"


def _national(kind: str, check: str, before: str):
    r = next(r for r in NATIONAL if r.entity_type == kind)
    _, candidate, test = CHECKS[check]

    def query(spark, sf_dir):
        rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).selectExpr("k", f"{candidate} AS v").selectExpr("k AS o_orderkey", f"{_TEXT} AS t")
        found = exploded(rows, recognize(F.col("t"), r), "s")
        return found.select("o_orderkey", "s.start", "s.end", "s.score", F.substring("t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))

    patterns = (r.pattern,) if isinstance(r.pattern, str) else r.pattern
    patterns = (rf"\b{before}\d{{10}}\b",) if before else patterns
    source = f"SELECT o_orderkey, {_TEXT} AS t FROM (SELECT k AS o_orderkey, k, {candidate} AS v FROM (SELECT o_orderkey AS k FROM orders))"
    ctes = ", ".join(sql.matches(f"f{i}", source, p, "o_orderkey") for i, p in enumerate(patterns))
    skip = len(before)
    rows = " UNION ALL ".join(f"SELECT o_orderkey, s + {skip} AS s, e, substr(v, {skip + 1}) AS v FROM f{i}" for i in range(len(patterns)))
    return query, f'WITH {ctes}, a AS ({rows}) SELECT o_orderkey, CAST(s AS INT) AS start, e AS "end", 1.0::DOUBLE AS score, v AS value FROM a WHERE {test}'


for _name, _kind, _check, _before in NATIONAL_KINDS:
    QUERIES[f"detect_{_name}"], ORACLE_SQL[f"detect_{_name}"] = _national(_kind, _check, _before)

_V6 = "concat('to 2001:db8:', CAST(o_orderkey % 9999 AS VARCHAR(20)), '::', CAST(o_orderkey % 10 AS VARCHAR(20)), ', 12:30:45 and fe80:0:0:0:1:2:3:', CAST(o_orderkey % 7777 AS VARCHAR(20)))"


def detect_ipv6(spark, sf_dir):
    """Addresses made of order keys, beside a time of day."""
    rows = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_V6} AS t")
    r = next(r for r in GENERAL if r.pattern == IPV6)
    return exploded(rows, recognize(F.col("t"), r), "s").select("o_orderkey", "s.start", "s.end")


QUERIES["detect_ipv6"] = detect_ipv6
ORACLE_SQL["detect_ipv6"] = f"""WITH {sql.matches("f", f"SELECT o_orderkey, {_V6} AS t FROM orders", IPV6, "o_orderkey")} SELECT o_orderkey, s AS start, e AS "end" FROM f"""
