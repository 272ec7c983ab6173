"""Queries of the span algebra, over words of conversations and over ranges derived from line items."""

from pyspark.sql import functions as F

from veil.functions.language import CROATIAN, ENGLISH, window_language
from veil.functions.scan import exploded, find_all
from veil.operators import spans as algebra
from veil.operators.ner import windows
from veil.operators.spans import SPANS, span
from veil.plans import sql
from veil.sources import read_table

TURNS = "SELECT conv_id, turn, text AS t FROM conversations"
KEYS = "conv_id, turn"
QUERIES, ORACLE_SQL = {}, {}


def register(name: str, text: str | None):
    def keep(query):
        QUERIES[name] = query
        if text:
            ORACLE_SQL[name] = text
        return query

    return keep


def turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("t"))


def words(pattern: str, kind, score=0.5, text=None):
    """Spans of all matches; ``kind`` is a type or a function of a match."""
    made = lambda m: span(kind(m) if callable(kind) else kind, m["start"], m["end"], score(m) if callable(score) else score)
    return F.transform(find_all(F.col("t") if text is None else text, pattern), made)


def spread(rows, *keys):
    return exploded(rows, F.col("x"), "s").select(*keys, "s.entity_type", "s.start", "s.end", "s.score")


def ranges(spark, sf_dir):
    """Overlapping spans of each order, from its line items."""
    made = span(F.col("l_returnflag"), F.col("l_suppkey") % 40, F.col("l_suppkey") % 40 + F.col("l_quantity").cast("int") % 12, F.round(F.col("l_discount"), 2), F.col("l_linenumber"))
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(made)).cast(SPANS).alias("x"))


RANGES = """r AS (SELECT l_orderkey, l_returnflag AS entity_type, CAST(l_suppkey % 40 AS INT) AS s,
  CAST(l_suppkey % 40 + CAST(l_quantity AS INT) % 12 AS INT) AS e, round(l_discount, 2) AS score, l_linenumber AS ord FROM lineitem)"""
OUT = 's AS start, e AS "end"'


@register("collapse_containment", f"""WITH {RANGES}, w AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey, entity_type
  ORDER BY s, e DESC, ord, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT l_orderkey, entity_type, {OUT}, score FROM w WHERE before IS NULL OR e > before""")
def collapse_containment(spark, sf_dir):
    return spread(ranges(spark, sf_dir).withColumn("x", algebra.collapse_contained(F.col("x"))), "l_orderkey")


@register("select_overlap", f"""WITH RECURSIVE {RANGES}, c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, s, ord, entity_type, e) AS n FROM r WHERE s < e),
st AS (
  SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(y VARCHAR, s INT, e INT, score DOUBLE)[]) AS acc FROM c
  UNION ALL
  SELECT st.l_orderkey, c.n, CASE WHEN len(list_filter(st.acc, lambda a: a.s < c.e AND a.e > c.s)) > 0 THEN st.acc
    ELSE list_append(st.acc, {{'y': c.entity_type, 's': c.s, 'e': c.e, 'score': CAST(c.score AS DOUBLE)}}) END
  FROM st JOIN c ON c.l_orderkey = st.l_orderkey AND c.n = st.n + 1),
f AS (SELECT l_orderkey, arg_max(acc, n) AS acc FROM st GROUP BY 1)
SELECT l_orderkey, a.y AS entity_type, a.s AS start, a.e AS "end", a.score AS score FROM (SELECT l_orderkey, unnest(acc) AS a FROM f)""")
def select_overlap(spark, sf_dir):
    return spread(algebra.without_overlaps(ranges(spark, sf_dir), "x"), "l_orderkey")


@register("whitelist_filter", f"""WITH {RANGES} SELECT l_orderkey, entity_type, {OUT}, score FROM r WHERE entity_type IN ('A', 'R')""")
def whitelist_filter(spark, sf_dir):
    return spread(ranges(spark, sf_dir).withColumn("x", algebra.whitelisted(F.col("x"), {"A": "A", "R": "R"})), "l_orderkey")


_ADJ = sql.matches("f", TURNS, "[A-Za-z]{3,}", KEYS)


@register("adjacency_merge", f"""WITH {_ADJ}, k AS (SELECT *, CASE WHEN length(v) % 3 = 0 THEN 'ADDRESS' ELSE 'PERSON' END AS y, length(v) % 7 / 10.0 AS score FROM f),
l AS (SELECT *, lag(e) OVER (PARTITION BY {KEYS}, y ORDER BY s) AS before FROM k),
g AS (SELECT *, sum(CASE WHEN s - before <= 3 AND regexp_full_match(substr(t, before + 1, s - before), '\\s*') THEN 0 ELSE 1 END)
  OVER (PARTITION BY {KEYS}, y ORDER BY s) AS island FROM l)
SELECT {KEYS}, y AS entity_type, min(s) AS start, max(e) AS "end", CAST(max(score) AS DOUBLE) AS score FROM g GROUP BY {KEYS}, y, island""")
def adjacency_merge(spark, sf_dir):
    kind = lambda m: F.when(F.length(m["text"]) % 3 == 0, "ADDRESS").otherwise("PERSON")
    rows = turns(spark, sf_dir).withColumn("x", words("[A-Za-z]{3,}", kind, lambda m: F.length(m["text"]) % 7 / 10.0))
    return spread(rows.withColumn("x", algebra.merge_adjacent(F.col("x"), F.col("t"))), "conv_id", "turn")


@register("address_cities", f"""WITH {sql.matches("f", TURNS, "[A-Za-z]{4,}", KEYS)},
k AS (SELECT *, CASE length(v) % 3 WHEN 0 THEN 'ADDRESS' WHEN 1 THEN 'ADDRESS_CITY' ELSE 'PERSON' END AS y, length(v) % 7 / 10.0 AS score FROM f),
l AS (SELECT *, lag(e) OVER (PARTITION BY {KEYS} ORDER BY s) AS before FROM k WHERE y <> 'PERSON'),
g AS (SELECT *, sum(CASE WHEN s - before <= 12 AND regexp_full_match(substr(t, before + 1, s - before), '[ \\t\\n\\r\\f\\v,.0-9-]*') THEN 0 ELSE 1 END)
  OVER (PARTITION BY {KEYS} ORDER BY s) AS island FROM l)
SELECT {KEYS}, 'ADDRESS' AS entity_type, min(s) AS start, max(e) AS "end", CAST(max(score) AS DOUBLE) AS score FROM g GROUP BY {KEYS}, island HAVING count_if(y = 'ADDRESS') > 0
UNION ALL SELECT {KEYS}, y, s, e, CAST(score AS DOUBLE) FROM k WHERE y = 'PERSON'""")
def address_cities(spark, sf_dir):
    n = lambda m: F.length(m["text"]) % 3
    kind = lambda m: F.when(n(m) == 0, "ADDRESS").when(n(m) == 1, "ADDRESS_CITY").otherwise("PERSON")
    rows = turns(spark, sf_dir).withColumn("x", words("[A-Za-z]{4,}", kind, lambda m: F.length(m["text"]) % 7 / 10.0))
    return spread(rows.withColumn("x", algebra.resolve_cities(F.col("x"), F.col("t"))), "conv_id", "turn")


_HELD = "SELECT conv_id, turn, concat('[PERSON_', CAST(turn AS VARCHAR), '] ', t, ' [EMAIL_1]') AS t FROM (" + TURNS + ")"


@register("placeholder_filter", f"""WITH {sql.matches("f", _HELD, "[A-Z][A-Za-z_]+", KEYS)}, {sql.matches("h", _HELD, r"\[[A-Z_]+_[0-9]+\]", KEYS)}
SELECT {KEYS}, 'PERSON' AS entity_type, {OUT}, 0.5::DOUBLE AS score FROM f
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = f.conv_id AND h.turn = f.turn AND f.s < h.e AND f.e > h.s)""")
def placeholder_filter(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("t", F.concat(F.lit("[PERSON_"), F.col("turn").cast("string"), F.lit("] "), "t", F.lit(" [EMAIL_1]")))
    rows = rows.withColumn("x", words("[A-Z][A-Za-z_]+", "PERSON"))
    return spread(rows.withColumn("x", algebra.outside_placeholders(F.col("x"), F.col("t"))), "conv_id", "turn")


_DENY, _EXACT = ("the", "que la", "and"), ("of", "la", "it is")
_TWO_WORDS = "[A-Z][a-z]+(?: [a-z]+)?"


@register("deny_list", f"""WITH {sql.matches("f", TURNS, _TWO_WORDS, KEYS)}
SELECT {KEYS}, 'PERSON' AS entity_type, {OUT}, 0.5::DOUBLE AS score FROM f WHERE lower(v) NOT IN ('the', 'que la', 'and', 'of', 'la', 'it is')
  AND NOT starts_with(lower(v), 'the ') AND NOT starts_with(lower(v), 'que la ') AND NOT starts_with(lower(v), 'and ')""")
def deny_list(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("x", words(_TWO_WORDS, "PERSON"))
    return spread(rows.withColumn("x", algebra.without_denied(F.col("x"), F.col("t"), _DENY, _EXACT)), "conv_id", "turn")


_TRAIL = r"[A-Z][a-z]+(?: [a-z]+)?[.,]*"


@register("trailing_strip", f"""WITH {sql.matches("f", TURNS, _TRAIL, KEYS)},
c AS (SELECT *, regexp_replace(v, '[.,;!?:()]+$', '') AS c FROM f),
d AS (SELECT *, CASE WHEN lower(regexp_extract(c, '([^ ]+)$', 1)) IN ('the', 'of', 'la', 'de') THEN regexp_replace(c, ' *[^ ]+$', '') ELSE c END AS w FROM c)
SELECT {KEYS}, 'PERSON' AS entity_type, s AS start, CAST(s + length(w) AS INT) AS "end", 0.5::DOUBLE AS score FROM d WHERE w <> ''""")
def trailing_strip(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("x", words(_TRAIL, "PERSON"))
    return spread(rows.withColumn("x", algebra.strip_trailing(F.col("x"), F.col("t"), ("the", "of", "la", "de"))), "conv_id", "turn")


_OIB_TEXT = "concat(CASE o_orderkey % 6 WHEN 0 THEN 'phone: ' WHEN 1 THEN 'OIB mobitel ' WHEN 2 THEN '+385 ' WHEN 3 THEN 'broj ' WHEN 4 THEN '(555) ' ELSE 'osobni broj ' END, lpad(CAST(o_orderkey AS VARCHAR(20)), 11, '1'), ' kraj')"


@register("oib_phone_context", f"""WITH {sql.matches("f", f"SELECT o_orderkey, {_OIB_TEXT} AS t FROM orders", r"[0-9]{11}", "o_orderkey")}, b AS (SELECT *, lower(substr(t, 1, s)) AS before FROM f)
SELECT o_orderkey, 'HR_OIB' AS entity_type, {OUT}, 0.5::DOUBLE AS score FROM b
WHERE regexp_matches(before, '\\boib\\b|osobni broj') OR NOT regexp_matches(before, '(phone|mobitel)\\s*[:=]?\\s*$|\\+385[-.\\s]?$|\\([0-9]{{3}}\\)\\s*$')""")
def oib_phone_context(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_OIB_TEXT} AS t").withColumn("x", words(r"[0-9]{11}", "HR_OIB"))
    return spread(rows.withColumn("x", algebra.without_phones(F.col("x"), F.col("t"), 30)), "o_orderkey")


_LIST = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_AROUND = "substr(t, greatest(0, s - 30) + 1, least(length(t), e + 30) - greatest(0, s - 30))"
_COUNT = lambda ws: f"len(list_filter(string_split_regex(lower({_AROUND}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x IN {_LIST(ws)}))"
_LANG = f"CASE WHEN {_COUNT(ENGLISH)} > {_COUNT(CROATIAN)} + len(regexp_extract_all(lower({_AROUND}), '[čšžđć]')) THEN 'en' ELSE 'hr' END"


@register("window_language", f"WITH {sql.matches('f', TURNS, '[A-Z][a-z]+', KEYS)} SELECT {KEYS}, s AS start, {_LANG} AS lang FROM f")
def window_language_query(spark, sf_dir):
    rows = exploded(turns(spark, sf_dir), words("[A-Z][a-z]+", "PERSON"), "s")
    return rows.select("conv_id", "turn", "s.start", window_language(F.col("t"), F.col("s.start"), F.col("s.end")).alias("lang"))


@register("merge_dedupe", f"""WITH {sql.matches("a", TURNS, "[A-Z][a-z]+", KEYS)}, {sql.matches("b", TURNS, "[A-Z][a-z]{2,}", KEYS)},
u AS (SELECT {KEYS}, t, s, e, 'hr' AS who, 0.6::DOUBLE AS score FROM a UNION ALL SELECT {KEYS}, t, s, e, 'en', length(v) % 10 / 10.0 FROM b),
k AS (SELECT * FROM u WHERE {_LANG} = who)
SELECT {KEYS}, 'PERSON' AS entity_type, s AS start, e AS "end", CAST(max(score) AS DOUBLE) AS score FROM k GROUP BY {KEYS}, s, e""")
def merge_dedupe(spark, sf_dir):
    left, right = words("[A-Z][a-z]+", "PERSON", 0.6), words("[A-Z][a-z]{2,}", "PERSON", lambda m: F.length(m["text"]) % 10 / 10.0)
    rows = turns(spark, sf_dir).withColumn("a", left).withColumn("b", right)
    return spread(rows.withColumn("x", algebra.merge_analyzers(F.col("a"), F.col("b"), F.col("t"))["spans"]), "conv_id", "turn")


@register("coreference", f"""WITH {sql.matches("f", TURNS, _TWO_WORDS, KEYS)},
k AS (SELECT *, string_split(v, ' ') AS w FROM f),
full_names AS (SELECT {KEYS}, lower(w[2]) AS last, min(v) AS name FROM k WHERE len(w) = 2 GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1)
SELECT k.conv_id, k.turn, k.s AS start, name AS full_name FROM k LEFT JOIN full_names ON len(w) = 1 AND k.conv_id = full_names.conv_id AND k.turn = full_names.turn AND lower(k.w[1]) = last""")
def coreference(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("x", words(_TWO_WORDS, "PERSON"))
    both = rows.withColumn("n", algebra.same_persons(F.col("x"), F.col("t")))
    both = exploded(both, F.arrays_zip("x", "n"), "z")
    return both.select("conv_id", "turn", F.col("z.x.start").alias("start"), F.col("z.n").alias("full_name"))


@register("subsumed_values", f"""WITH {sql.matches("f", TURNS, "[A-Z][a-z]+", KEYS)}, k AS (SELECT DISTINCT {KEYS}, lower(v) AS value, concat('[PERSON_', CAST(length(v) % 2 AS VARCHAR), ']') AS placeholder FROM f)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.conv_id = k.conv_id AND o.turn = k.turn AND o.placeholder = k.placeholder AND o.value <> k.value AND contains(o.value, k.value))""")
def subsumed_values(spark, sf_dir):
    entry = lambda m: F.struct(F.lower(m["text"]).alias("value"), F.concat(F.lit("[PERSON_"), (F.length(m["text"]) % 2).cast("string"), F.lit("]")).alias("placeholder"))
    rows = turns(spark, sf_dir).withColumn("x", F.array_distinct(F.transform(find_all(F.col("t"), "[A-Z][a-z]+"), entry)))
    return exploded(rows, algebra.without_subsumed(F.col("x")), "s").select("conv_id", "turn", "s.value", "s.placeholder")


@register("chunk_windows", """SELECT doc_id, CAST(i * 768 AS INT) AS "offset", length(substr(text, i * 768 + 1, 1024)) AS n_chars, md5(substr(text, i * 768 + 1, 1024)) AS digest
FROM documents, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1024) / 768.0)) AS BIGINT) + 1)) AS u(i)""")
def chunk_windows(spark, sf_dir):
    rows = exploded(read_table(spark, sf_dir, "documents").select("doc_id", "text"), windows(F.col("text")), "w")
    return rows.select("doc_id", F.col("w.offset").alias("offset"), F.length("w.text").cast("long").alias("n_chars"), F.md5(F.col("w.text").cast("binary")).alias("digest"))


