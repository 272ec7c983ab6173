"""Queries that mask, restore and report, over documents and conversations, and of encryption."""

from pyspark.sql import functions as F

from veil.functions import crypto
from veil.functions.scan import exploded, find_all
from veil.operators import engine, masking, report
from veil.operators.recognizers import IPV4, REGISTRY, Recognizer
from veil.plans import sql
from veil.plans.detectors import KINDS
from veil.plans.span_algebra import KEYS, TURNS, turns
from veil.sources import read_table

QUERIES, ORACLE_SQL = {}, {}
GENERAL = tuple(sql.recognizer(k) for k in KINDS.values())
EMAIL = (sql.recognizer("EMAIL_ADDRESS"),)
#: The same kinds with addresses of IP version 4; ``sql.recognizer`` takes the first of a type, which finds version 6 only.
ROLLED = tuple(next(x for x in REGISTRY if x.pattern == IPV4) if r.entity_type == "IP_ADDRESS" else r for r in GENERAL)
#: Keys of the queries over made-up secrets: test values, not secrets of anyone.
KEY, SECRET = bytes(range(32)), bytes(range(32, 64))


def register(name, text):
    def keep(query):
        QUERIES[name] = query
        if text:
            ORACLE_SQL[name] = text
        return query

    return keep


def _found(source: str, key: str, recognizers: tuple[Recognizer, ...] = GENERAL) -> str:
    """CTEs ending in ``acc``: the greedy choice among the general recognizers' matches, at most one row a span."""
    parts, union = [], []
    for k, r in enumerate(recognizers):
        parts.append(sql.matches(f"f{k}", source, r.pattern, key))
        check = f" WHERE {sql.luhn('v')}" if r.entity_type == "CREDIT_CARD" else ""
        name = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE"}.get(r.entity_type, r.entity_type)
        union.append(f"SELECT {key}, s, e, v, '{name}' AS y, {1.0 if r.valid else r.score}::DOUBLE AS score, {k} AS ord FROM f{k}{check}")
    return f"""{', '.join(parts)},
c AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, s, ord) AS n FROM ({' UNION ALL '.join(union)})),
st AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(y VARCHAR, s INT, e INT, score DOUBLE, v VARCHAR)[]) AS acc FROM c
  UNION ALL
  SELECT st.{key}, c.n, CASE WHEN len(list_filter(st.acc, lambda a: a.s < c.e AND a.e > c.s)) > 0 THEN st.acc
    ELSE list_append(st.acc, {{'y': c.y, 's': c.s, 'e': c.e, 'score': c.score, 'v': c.v}}) END
  FROM st JOIN c ON c.{key} = st.{key} AND c.n = st.n + 1),
g AS (SELECT {key}, unnest(arg_max(acc, n)) AS a FROM st GROUP BY 1),
acc AS (SELECT {key}, a.y AS y, a.s AS s, a.e AS e, a.score AS score, a.v AS v FROM g)"""


_DOCS = "SELECT doc_id, text AS t FROM documents"
_NUMBERED = """first_at AS (SELECT doc_id, y, v, min(s) AS f FROM acc GROUP BY 1, 2, 3),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, y ORDER BY f) AS k FROM first_at),
z AS (SELECT acc.*, concat('[', acc.y, '_', CAST(k AS VARCHAR), ']') AS ph, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM acc JOIN num USING (doc_id, y, v))"""
MASKED = f"""WITH RECURSIVE {_found(_DOCS, 'doc_id')}, {_NUMBERED},
m AS (SELECT z.doc_id, string_agg(concat(substr(text, CAST(before AS INT) + 1, CAST(s - before AS INT)), ph), '' ORDER BY s) AS head, max(e) AS e, count(*) AS n
  FROM z JOIN documents d ON d.doc_id = z.doc_id GROUP BY 1)
SELECT d.doc_id, CASE WHEN m.n IS NULL THEN text ELSE concat(head, substr(text, m.e + 1)) END AS masked_text, CAST(coalesce(m.n, 0) AS INT) AS n_spans
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id"""


@register("mask_documents", MASKED)
def mask_documents(spark, sf_dir):
    return engine.mask_documents(read_table(spark, sf_dir, "documents"), recognizers=GENERAL).drop("entries")


@register("mask_documents_all", None)
def mask_documents_all(spark, sf_dir):
    """All recognizers and all lists; SQL has no look-behind for one of them, so tests check the parts."""
    from veil.config import EngineConfig

    return engine.mask_documents(read_table(spark, sf_dir, "documents"), config=EngineConfig()).drop("entries")


@register("detect_all", f"""WITH RECURSIVE {_found(_DOCS, 'doc_id')} SELECT doc_id, y AS entity_type, s AS start, e AS "end", score, v AS original FROM acc""")
def detect_all(spark, sf_dir):
    return engine.detections(read_table(spark, sf_dir, "documents"), GENERAL)


@register("mask_roundtrip", "SELECT doc_id, text FROM documents")
def mask_roundtrip(spark, sf_dir):
    return engine.restore_documents(engine.mask_documents(read_table(spark, sf_dir, "documents"), recognizers=GENERAL))


@register("pii_summary", f"""WITH RECURSIVE {_found(_DOCS, 'doc_id')} SELECT y AS entity_type, count(*) AS n_detections, count(DISTINCT doc_id) AS n_texts, count(DISTINCT v) AS n_values FROM acc GROUP BY 1""")
def pii_summary(spark, sf_dir):
    return report.summary(engine.detections(read_table(spark, sf_dir, "documents"), GENERAL))


@register("pii_rollup", f"""WITH RECURSIVE {_found(_DOCS, 'doc_id', ROLLED)} SELECT source, y AS entity_type, count(*) AS n_detections FROM acc JOIN documents USING (doc_id) GROUP BY ROLLUP (source, y)""")
def pii_rollup(spark, sf_dir):
    return report.rollup(engine.detections(read_table(spark, sf_dir, "documents"), ROLLED, keep=("doc_id", "source")))


@register("mask_report", f"""WITH RECURSIVE {_found(_DOCS, 'doc_id')}, {_NUMBERED}, p AS (SELECT DISTINCT doc_id, v, ph FROM z)
SELECT doc_id, v AS value, ph AS placeholder, CAST((length(text) - length(replace(text, v, ''))) / length(v) AS INT) AS n, CAST(instr(text, v) - 1 AS INT) AS first FROM p JOIN documents USING (doc_id)
WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.ph = p.ph AND o.v <> p.v AND contains(o.v, p.v))""")
def mask_report(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = engine.mask_documents(docs, recognizers=GENERAL).where("n_spans > 0").join(docs.select("doc_id", "text"), "doc_id")
    return exploded(rows, report.mask_report(F.col("text"), F.col("entries")), "r").select("doc_id", "r.value", "r.placeholder", "r.n", "r.first")


#: In these queries the values of a turn are its long capitalised words, and each stands for its length.
_VALUE = "[A-Z][a-z]{5,}"
_PH = "concat('[PERSON_', CAST(length(v) AS VARCHAR), ']')"


def _known(rows):
    """Turns with a map from their values to placeholders."""
    pair = lambda m: F.struct(m["text"], F.concat(F.lit("[PERSON_"), F.length(m["text"]).cast("string"), F.lit("]")))
    return rows.withColumn("forward", F.map_from_entries(F.array_distinct(F.transform(find_all(F.col("t"), _VALUE), pair))))


_GUARDED = f"""{sql.matches("w", TURNS, sql.WORD, KEYS)}, {sql.matches("f", TURNS, _VALUE, KEYS)},
d AS (SELECT DISTINCT {KEYS}, v, {_PH} AS ph FROM f),
h AS (SELECT w.*, d.ph FROM w LEFT JOIN d ON d.conv_id = w.conv_id AND d.turn = w.turn AND d.v = w.v)"""


@register("mask_all_occurrences", f"""WITH {_GUARDED}, j AS (SELECT {KEYS}, string_agg(concat(gap, coalesce(ph, v)), '' ORDER BY i) || any_value(rest) AS masked FROM h GROUP BY {KEYS})
SELECT c.conv_id, c.turn, coalesce(masked, text) AS masked FROM conversations c LEFT JOIN j ON j.conv_id = c.conv_id AND j.turn = c.turn""")
def mask_all_occurrences(spark, sf_dir):
    return _known(turns(spark, sf_dir)).select("conv_id", "turn", masking.remask(F.col("t"), F.col("forward")).alias("masked"))


@register("remask_spans", f"""WITH {_GUARDED} SELECT {KEYS}, s AS start, e AS "end", v AS original, ph AS placeholder FROM h WHERE ph IS NOT NULL""")
def remask_spans(spark, sf_dir):
    rows = exploded(_known(turns(spark, sf_dir)), masking.remask_spans(F.col("t"), F.col("forward")), "s")
    return rows.select("conv_id", "turn", "s.start", "s.end", "s.original", "s.placeholder")


@register("offset_translate", f"""WITH {_GUARDED},
q AS (SELECT *, sum(length(gap) + length(coalesce(ph, v))) OVER (PARTITION BY {KEYS} ORDER BY i) - length(coalesce(ph, v)) AS masked_at FROM h)
SELECT {KEYS}, CAST(masked_at AS INT) AS masked_at, s AS original_at FROM q""")
def offset_translate(spark, sf_dir):
    """Where each word of a masked turn was in the original."""
    rows = _known(turns(spark, sf_dir)).withColumn("shifts", masking.remask_spans(F.col("t"), F.col("forward")))
    rows = rows.withColumn("masked", masking.remask(F.col("t"), F.col("forward")))
    rows = exploded(rows, find_all(F.col("masked"), r"\[PERSON_\d+\]|" + sql.WORD), "w")
    return rows.select("conv_id", "turn", F.col("w.start").alias("masked_at"), masking.original_offset(F.col("w.start"), F.col("shifts")).alias("original_at"))


@register("restore_turns", "SELECT conv_id, turn, text AS restored, CAST(0 AS INT) AS n_unknown FROM conversations")
def restore_turns(spark, sf_dir):
    """Numbers by first occurrence make the map reversible, so restoring gives each turn again."""
    made = lambda m, i: F.struct(m["text"], F.concat(F.lit("[PERSON_"), i.cast("string"), F.lit("]")))
    values = F.array_distinct(F.transform(find_all(F.col("t"), _VALUE), lambda m: F.struct(m["text"])))
    rows = turns(spark, sf_dir).withColumn("forward", F.map_from_entries(F.transform(values, made)))
    rows = rows.withColumn("masked", masking.remask(F.col("t"), F.col("forward")))
    reverse = F.map_from_arrays(F.map_values("forward"), F.map_keys("forward"))
    back = masking.restore(F.col("masked"), reverse)
    return rows.select("conv_id", "turn", back["text"].alias("restored"), F.size(back["unknown"]).alias("n_unknown"))


@register("crypto_roundtrip", "SELECT c_custkey, c_name AS opened, true AS sealed, CAST(NULL AS VARCHAR) AS wrong_key FROM customer")
def crypto_roundtrip(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").withColumn("x", crypto.encrypt(F.col("c_name"), SECRET))
    sealed = crypto.is_encrypted(F.col("x")) & (F.col("x") != F.col("c_name"))
    return rows.select("c_custkey", crypto.decrypt(F.col("x"), SECRET).alias("opened"), sealed.alias("sealed"), crypto.decrypt(F.col("x"), KEY).alias("wrong_key"))


def _frame(*fields: str) -> str:
    return " || ".join([f"unhex('{crypto.DOMAIN.hex()}')", *(f"unhex(lpad(to_hex(octet_length(encode({f}))), 8, '0')) || encode({f})" for f in fields)])


_PAD = {x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}


@register("blind_index", f"""SELECT c_custkey, upper(sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || {_frame("c_mktsegment", "'PERSON'", "c_name")})))) AS token FROM customer""")
def blind_index(spark, sf_dir):
    token = crypto.blind_index(KEY, F.col("c_mktsegment"), F.lit("PERSON"), F.col("c_name"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.hex(token).alias("token"))
