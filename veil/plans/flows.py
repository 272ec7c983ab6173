"""Queries of the two flows, masking requests and restoring answers, and of a vault between requests.

The names of these texts are their long capitalised words: secrets where their length is even, else user names.
"""

from pyspark.sql import functions as F

from veil.config import EngineConfig
from veil.functions.scan import find_all
from veil.operators import engine, vault
from veil.operators.spans import span
from veil.plans import sql
from veil.plans.span_algebra import KEYS, TURNS
from veil.plans.threads import _VALUE, KEY, NOW, ORDER, at, mentions
from veil.plans.threads import _F as FOUND
from veil.sources import read_table

QUERIES, ORACLE_SQL = {}, {}
CONFIG = EngineConfig(languages=("hr",), deny=(), exact_deny=(), trailing=(), coreference=False, history_messages=3)
BEFORE = "2024-01-19 23:00:00"


def register(name, text):
    def keep(query):
        QUERIES[name], ORACLE_SQL[name] = query, text
        return query

    return keep


def _names(text):
    kind = lambda m: F.when(F.length(m["text"]) % 2 == 0, "SECRET").otherwise("USERNAME")
    return F.transform(find_all(text, _VALUE), lambda m: span(kind(m), m["start"], m["end"], 0.5))


def _messages(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    return rows.select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").cast("int").alias("msg_idx"), "role", part.alias("parts"))


def _requests(spark, sf_dir):
    """A request with the first message of each chat and, an hour later, one with all."""
    rows = _messages(spark, sf_dir)
    ask = lambda asked, known, now: engine.mask_messages(asked, known, at(now), CONFIG, (), KEY, analyzers={"hr": _names})
    return ask(rows, ask(rows.where("msg_idx = 0"), vault.Vault.empty(spark), BEFORE).vault.materialize(), NOW)


#: What both requests find: n0 has the values of the first, det the messages that the second masks and whether
#: it searches them, n1 its new values, known all of them.
_FLOW = f"""{sql.matches("f", TURNS, _VALUE, KEYS)}, k AS (SELECT *, CASE WHEN length(v) % 2 = 0 THEN 'SECRET' ELSE 'USERNAME' END AS y FROM f),
d0 AS (SELECT k.conv_id, y, v, min(s) AS p FROM k JOIN conversations c ON c.conv_id = k.conv_id AND c.turn = k.turn WHERE k.turn = 0 AND role IN ('user', 'assistant') GROUP BY 1, 2, 3),
n0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, y ORDER BY p) AS c FROM d0),
sc AS (SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 3),
det AS (SELECT conv_id, turn, conv_id NOT IN (SELECT conv_id FROM n0) OR turn = max(turn) OVER (PARTITION BY conv_id, role) AS detect FROM sc),
d1 AS (SELECT k.conv_id, k.y, k.v, min((k.turn, k.s)) AS p FROM k JOIN det ON det.conv_id = k.conv_id AND det.turn = k.turn AND detect
  WHERE NOT EXISTS (SELECT 1 FROM n0 WHERE n0.conv_id = k.conv_id AND n0.v = k.v) GROUP BY 1, 2, 3),
n1 AS (SELECT d1.conv_id, d1.y, v, row_number() OVER (PARTITION BY d1.conv_id, d1.y ORDER BY p) + coalesce(m, 0) AS c
  FROM d1 LEFT JOIN (SELECT conv_id, y, count(*) AS m FROM n0 GROUP BY 1, 2) b ON b.conv_id = d1.conv_id AND b.y = d1.y),
known AS (SELECT conv_id, v, concat('[', y, '_', CAST(c AS VARCHAR), ']') AS ph, true AS old FROM n0 UNION ALL SELECT conv_id, v, concat('[', y, '_', CAST(c AS VARCHAR), ']'), false FROM n1)"""
_MASKED = f"""{sql.matches("w", TURNS, sql.WORD, KEYS)},
own AS (SELECT DISTINCT k.conv_id, k.turn, k.v FROM k JOIN det ON det.conv_id = k.conv_id AND det.turn = k.turn AND detect),
h AS (SELECT w.*, CASE WHEN det.turn IS NOT NULL AND (known.old OR own.v IS NOT NULL) THEN known.ph END AS ph FROM w
  LEFT JOIN det ON det.conv_id = w.conv_id AND det.turn = w.turn LEFT JOIN known ON known.conv_id = w.conv_id AND known.v = w.v
  LEFT JOIN own ON own.conv_id = w.conv_id AND own.turn = w.turn AND own.v = w.v),
j AS (SELECT {KEYS}, string_agg(concat(gap, coalesce(ph, v)), '' ORDER BY i) || any_value(rest) AS masked FROM h GROUP BY {KEYS})"""


@register("mask_messages", f"""WITH {_FLOW}, {_MASKED} SELECT CAST(c.conv_id AS VARCHAR) AS chat_id, CAST(c.turn AS INT) AS msg_idx, coalesce(masked, text) AS masked
FROM conversations c LEFT JOIN j ON j.conv_id = c.conv_id AND j.turn = c.turn""")
def mask_messages(spark, sf_dir):
    return _requests(spark, sf_dir).messages.select("chat_id", "msg_idx", F.col("parts")[0]["text"].alias("masked"))


@register("mask_messages_maps", f"""WITH {_FLOW} SELECT CAST(conv_id AS VARCHAR) AS chat_id, v AS value, ph AS placeholder FROM known""")
def mask_messages_maps(spark, sf_dir):
    """What is published with the second request."""
    maps = _requests(spark, sf_dir).maps.withColumn("e", F.explode_outer(F.map_entries("reverse"))).where("e is not null")
    return maps.select("chat_id", F.col("e.value").alias("value"), F.col("e.key").alias("placeholder"))


_UNKNOWN = "[USERNAME_9999]"


@register("restore_messages", f"""WITH {_FLOW} SELECT CAST(conv_id AS VARCHAR) AS chat_id, CAST(turn AS INT) AS msg_idx, text || ' {_UNKNOWN}' AS restored,
  CASE WHEN conv_id IN (SELECT conv_id FROM known) THEN 1 ELSE 0 END AS n_unknown FROM conversations""")
def restore_messages(spark, sf_dir):
    """All masked messages, each with a placeholder that nobody gave out, back again."""
    made = _requests(spark, sf_dir)
    answers = made.messages.select("chat_id", "msg_idx", F.concat(F.col("parts")[0]["text"], F.lit(f" {_UNKNOWN}")).alias("text"))
    back = engine.restore_messages(answers, made.vault.materialize(), at(NOW), CONFIG).messages
    return back.select("chat_id", "msg_idx", F.col("text").alias("restored"), F.size("unknown").alias("n_unknown"))


_FIRST = """n0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, y ORDER BY p) AS c FROM (SELECT conv_id, y, v, min(s) AS p FROM k WHERE turn = 0 GROUP BY 1, 2, 3))"""


@register("vault_counter_survives", f"""WITH {FOUND}, {_FIRST}, one AS (SELECT conv_id, arg_min(v, p) AS v, arg_min(y, p) AS y FROM n0 GROUP BY 1),
d1 AS (SELECT k.conv_id, k.y, k.v, min((k.turn, k.s)) AS p FROM k LEFT JOIN one ON one.conv_id = k.conv_id WHERE k.turn > 0 AND k.v IS DISTINCT FROM one.v GROUP BY 1, 2, 3),
b AS (SELECT n0.conv_id, n0.y, count(*) AS m FROM n0 JOIN one ON one.conv_id = n0.conv_id AND one.y = n0.y GROUP BY 1, 2)
SELECT CAST(n0.conv_id AS VARCHAR) AS chat_id, n0.v AS original_value, concat('[', n0.y, '_', CAST(c AS VARCHAR), ']') AS placeholder FROM n0 JOIN one ON one.conv_id = n0.conv_id AND one.v = n0.v
UNION ALL SELECT CAST(d1.conv_id AS VARCHAR), v, concat('[', d1.y, '_', CAST(row_number() OVER (PARTITION BY d1.conv_id, d1.y ORDER BY p) + coalesce(m, 0) AS VARCHAR), ']')
FROM d1 LEFT JOIN b ON b.conv_id = d1.conv_id AND b.y = d1.y""")
def vault_counter_survives(spark, sf_dir):
    """One value of each chat is seen again after 20 hours; after 34 the others are gone, and their numbers are not given out again."""
    rows = mentions(spark, sf_dir)
    first = vault.upsert(vault.Vault.empty(spark), rows.where("turn = 0"), ORDER, at("2024-01-01"), KEY).materialize()
    one = rows.where("turn = 0").groupBy("chat_id").agg(F.min(F.struct("turn", "start", "entity_type", "value")).alias("m")).select("chat_id", "m.*")
    second = vault.upsert(first, one, ORDER, at("2024-01-01 20:00:00"), KEY).materialize()
    third = vault.upsert(second, rows.where("turn > 0"), ORDER, at("2024-01-02 10:00:00"), KEY)
    return vault.live(third.mappings, at("2024-01-02 10:00:00")).select("chat_id", "original_value", "placeholder")


@register("vault_active_chat", f"""WITH {FOUND}, {_FIRST} SELECT CAST(conv_id AS VARCHAR) AS chat_id, concat('[', y, '_', CAST(c AS VARCHAR), ']') AS placeholder FROM n0
WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')""")
def vault_active_chat(spark, sf_dir):
    """Values live a day; after 30 hours those of chats are left in which an answer was restored after 20."""
    known = vault.upsert(vault.Vault.empty(spark), mentions(spark, sf_dir).where("turn = 0"), ORDER, at("2024-01-01"), KEY).materialize()
    answers = read_table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("chat_id"), "text")
    after = engine.restore_messages(answers, known, at("2024-01-01 20:00:00")).vault
    return vault.live(after.mappings, at("2024-01-02 06:00:00")).select("chat_id", "placeholder")
