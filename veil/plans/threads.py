"""Queries of the vault and of chat shapes. A conversation is a chat; its values are long capitalised words."""

from pyspark.sql import functions as F

from veil.functions.scan import exploded, find_all, vault_key
from veil.operators import chat, masking, vault
from veil.plans import sql
from veil.plans.span_algebra import KEYS, TURNS, turns
from veil.sources import read_table

QUERIES, ORACLE_SQL = {}, {}
NOW = "2024-01-20 00:00:00"
#: Blind index key of the queries: a test value, not a secret of anyone.
KEY = bytes(range(32))


def at(text):
    return F.lit(text).cast("timestamp")


_VALUE = "[A-Z][a-z]{4,}"
_KIND = "CASE WHEN length(v) % 2 = 0 THEN 'PERSON' ELSE 'USERNAME' END"
_F = f"{sql.matches('f', TURNS, _VALUE, KEYS)}, k AS (SELECT *, {_KIND} AS y FROM f)"


def register(name, text):
    def keep(query):
        QUERIES[name] = query
        if text:
            ORACLE_SQL[name] = text
        return query

    return keep


def mentions(spark, sf_dir):
    kind = F.when(F.length("m.text") % 2 == 0, "PERSON").otherwise("USERNAME")
    rows = exploded(turns(spark, sf_dir), find_all(F.col("t"), _VALUE), "m")
    return rows.select(F.col("conv_id").cast("string").alias("chat_id"), kind.alias("entity_type"), F.col("m.text").alias("value"), "turn", "m.start")


ORDER = ["turn", "start"]
_NUMBER = """d AS (SELECT conv_id, y, v, min((turn, s)) AS f FROM k GROUP BY 1, 2, 3),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, y ORDER BY f) AS INT) AS c FROM d)"""
_ROW = "CAST(conv_id AS VARCHAR) AS chat_id, y AS entity_type, v AS original_value, c AS counter_index, concat('[', y, '_', CAST(c AS VARCHAR), ']') AS placeholder"
MINTED = ("chat_id", "entity_type", "original_value", "counter_index", "placeholder")


@register("vault_dense", f"WITH {_F}, {_NUMBER} SELECT {_ROW} FROM n")
def vault_dense(spark, sf_dir):
    return vault.mint(mentions(spark, sf_dir), ORDER).select(*MINTED)


@register("vault_gap", f"""WITH {_F}, q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, y ORDER BY turn, s) AS call FROM k),
n AS (SELECT conv_id, y, v, CAST(min(call) AS INT) AS c FROM q GROUP BY 1, 2, 3) SELECT {_ROW} FROM n""")
def vault_gap(spark, sf_dir):
    return vault.mint(mentions(spark, sf_dir), ORDER, "gap").select(*MINTED)


_FOLD = "CASE WHEN s % 2 = 0 THEN 'PERSON' ELSE 'USERNAME' END"


@register("vault_untyped", f"""WITH {_F}, d AS (SELECT conv_id, v, min((turn, s)) AS f, arg_min({_FOLD}, (turn, s)) AS y FROM k GROUP BY 1, 2),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, y ORDER BY f) AS INT) AS c FROM d) SELECT {_ROW} FROM n""")
def vault_untyped(spark, sf_dir):
    """A value has here the type of its place, odd or even, so one value comes with two types."""
    rows = mentions(spark, sf_dir).withColumn("entity_type", F.when(F.col("start") % 2 == 0, "PERSON").otherwise("USERNAME"))
    return vault.mint(rows, ORDER, "untyped").select(*MINTED)


def _vault(spark, sf_dir):
    return vault.upsert(vault.Vault.empty(spark), mentions(spark, sf_dir), ORDER, at(NOW), KEY)


@register("vault_snapshot", f"WITH {_F}, {_NUMBER} SELECT CAST(conv_id AS VARCHAR) AS chat_id, v AS value, concat('[', y, '_', CAST(c AS VARCHAR), ']') AS placeholder FROM n")
def vault_snapshot(spark, sf_dir):
    maps = vault.snapshot(_vault(spark, sf_dir), at(NOW))
    return exploded(maps, F.map_entries("forward"), "e").select("chat_id", F.col("e.key").alias("value"), F.col("e.value").alias("placeholder"))


@register("vault_restore", f"""WITH {_F}, {_NUMBER} SELECT CAST(k.conv_id AS VARCHAR) AS chat_id, turn, s AS start, k.v AS original FROM k""")
def vault_restore(spark, sf_dir):
    """Each mention's placeholder, looked up again."""
    kept = _vault(spark, sf_dir).mappings
    asked = mentions(spark, sf_dir).join(kept.select("chat_id", "entity_type", F.col("original_value").alias("value"), "placeholder"), ["chat_id", "entity_type", "value"])
    return vault.look_up(asked.select("chat_id", "placeholder", "turn", "start"), kept, at(NOW)).select("chat_id", "turn", "start", "original")


@register("vault_incremental", f"WITH {_F}, {_NUMBER} SELECT {_ROW} FROM n")
def vault_incremental(spark, sf_dir):
    """First turns first, then all turns: numbers go on and known values keep theirs."""
    rows = mentions(spark, sf_dir)
    first = vault.upsert(vault.Vault.empty(spark), rows.where("turn = 0"), ORDER, at(NOW), KEY).materialize()
    return vault.upsert(first, rows, ORDER, at(NOW), KEY).mappings.select(*MINTED)


@register("vault_counters", f"WITH {_F}, {_NUMBER} SELECT CAST(conv_id AS VARCHAR) AS chat_id, y AS entity_type, max(c) + 1 AS next_value FROM n GROUP BY 1, 2")
def vault_counters(spark, sf_dir):
    return _vault(spark, sf_dir).counters.select("chat_id", "entity_type", "next_value")


def _touched(spark, sf_dir):
    """A vault in which users' event types live a day from their last event."""
    rows = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last"))
    ends = F.col("last") + F.make_dt_interval(secs=F.lit(86400))
    return rows.select(
        F.col("user_id").cast("string").alias("chat_id"), F.upper("event_type").alias("entity_type"), F.col("event_type").alias("original_value"),
        F.lit(None).cast("binary").alias("lookup_hash"), F.concat(F.lit("["), F.upper("event_type"), F.lit("_1]")).alias("placeholder"), F.lit(1).alias("counter_index"), "created_at", ends.alias("expires_at"),
    )


_T = "t AS (SELECT CAST(user_id AS VARCHAR) AS chat_id, upper(event_type) AS entity_type, max(ts) + INTERVAL 86400 SECOND AS ends FROM events GROUP BY 1, 2)"


@register("vault_ttl", f"WITH {_T} SELECT chat_id, entity_type FROM t WHERE ends > TIMESTAMP '{NOW}'")
def vault_ttl(spark, sf_dir):
    return vault.live(_touched(spark, sf_dir), at(NOW)).select("chat_id", "entity_type")


@register("vault_purge", f"WITH {_T} SELECT chat_id, entity_type FROM t WHERE ends > TIMESTAMP '{NOW}' OR chat_id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase')")
def vault_purge(spark, sf_dir):
    chats = read_table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("chat_id"))
    return vault.purge(_touched(spark, sf_dir), at(NOW), chats).select("chat_id", "entity_type")


@register("vault_renew", f"""WITH {_T} SELECT chat_id, entity_type, CASE WHEN ends > TIMESTAMP '{NOW}' AND chat_id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase')
THEN TIMESTAMP '{NOW}' + INTERVAL 86400 SECOND ELSE ends END AS expires_at FROM t""")
def vault_renew(spark, sf_dir):
    chats = read_table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("chat_id"))
    return vault.renew(_touched(spark, sf_dir), chats, at(NOW)).select("chat_id", "entity_type", "expires_at")


@register("vault_normalised_key", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS key FROM documents")
def vault_normalised_key(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", vault_key(F.col("text")).alias("key"))


@register("remask_prior_turns", f"""WITH {sql.matches("w", TURNS, sql.WORD, KEYS)}, {_F}, {_NUMBER},
h AS (SELECT w.*, n.c, n.y, n.f FROM w LEFT JOIN n ON n.conv_id = w.conv_id AND n.v = w.v AND n.f[1] < w.turn),
j AS (SELECT {KEYS}, string_agg(concat(gap, CASE WHEN c IS NULL THEN v ELSE concat('[', y, '_', CAST(c AS VARCHAR), ']') END), '' ORDER BY i) || any_value(rest) AS masked FROM h GROUP BY {KEYS})
SELECT CAST(c.conv_id AS VARCHAR) AS chat_id, c.turn, coalesce(masked, text) AS masked FROM conversations c LEFT JOIN j ON j.conv_id = c.conv_id AND j.turn = c.turn""".replace("n.f[1]", "struct_extract(n.f, 1)"))
def remask_prior_turns(spark, sf_dir):
    """Each turn with the values of the turns before it masked: a vault in which a turn is a second."""
    second = lambda c: F.timestamp_seconds(F.col(c))
    first = mentions(spark, sf_dir)
    made = vault.mint(first, ORDER)
    seen = first.groupBy("chat_id", "entity_type", F.col("value").alias("original_value")).agg(F.min("turn").alias("turn"))
    known = made.join(seen, ["chat_id", "entity_type", "original_value"]).withColumn("created_at", second("turn")).withColumn("expires_at", at("2999-01-01"))
    rows = turns(spark, sf_dir).withColumn("chat_id", F.col("conv_id").cast("string")).withColumn("turn_at", second("turn"))
    rows = vault.known_in(rows, vault.Vault(known, None), at(NOW), ["turn"], "t", "turn_at")
    return rows.select("chat_id", "turn", masking.remask(F.col("t"), F.col("forward")).alias("masked"))


def messages(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("msg_idx"), "role", "text")


_MSG = "SELECT conv_id AS chat_id, turn AS msg_idx, role, text FROM conversations"


@register("role_filter", f"SELECT chat_id, msg_idx FROM ({_MSG}) WHERE role IN ('user', 'assistant')")
def role_filter(spark, sf_dir):
    return messages(spark, sf_dir).where(F.col("role").isin(*chat.SPOKEN)).select("chat_id", "msg_idx")


@register("history_scope", f"""SELECT chat_id, msg_idx, role FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY msg_idx DESC) AS n FROM ({_MSG}) WHERE role IN ('user', 'assistant')) WHERE n <= 3""")
def history_scope(spark, sf_dir):
    return chat.in_scope(messages(spark, sf_dir), 3).select("chat_id", "msg_idx", "role")


@register("last_user_only", f"SELECT chat_id, max(msg_idx) AS msg_idx FROM ({_MSG}) WHERE role = 'user' GROUP BY 1")
def last_user_only(spark, sf_dir):
    return chat.in_scope(messages(spark, sf_dir), scope=False).select("chat_id", "msg_idx")


@register("last_roles", f"""SELECT chat_id, coalesce(max(msg_idx) FILTER (role = 'user'), -1) AS last_user, coalesce(max(msg_idx) FILTER (role = 'assistant'), -1) AS last_assistant FROM ({_MSG}) GROUP BY 1""")
def last_roles(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return chat.last_of(rows, "user").join(chat.last_of(rows, "assistant"), "chat_id")


_KNOWN = "(SELECT chat_id FROM (" + _MSG + ") WHERE role = 'system')"


@register("detection_scope", f"""SELECT chat_id, msg_idx, chat_id NOT IN {_KNOWN} OR (msg_idx % 3 <> 0
  AND (msg_idx = max(CASE WHEN role = 'user' THEN msg_idx END) OVER (PARTITION BY chat_id) IS TRUE OR (msg_idx = max(CASE WHEN role = 'assistant' THEN msg_idx END) OVER (PARTITION BY chat_id)) IS TRUE)) AS detect FROM ({_MSG})""".replace("(msg_idx = max(CASE WHEN role = 'user' THEN msg_idx END) OVER (PARTITION BY chat_id) IS TRUE OR", "((msg_idx = max(CASE WHEN role = 'user' THEN msg_idx END) OVER (PARTITION BY chat_id)) IS TRUE OR"))
def detection_scope(spark, sf_dir):
    """Chats with a system message have known values here, and every third message is a title task."""
    rows = messages(spark, sf_dir)
    known = rows.where("role = 'system'").select("chat_id")
    tasked = rows.withColumn("task", F.when(F.col("msg_idx") % 3 == 0, "title_generation"))
    return chat.detected(tasked, known, ("title_generation",)).select("chat_id", "msg_idx", F.coalesce("detect", F.lit(False)).alias("detect"))


@register("user_toggle", """SELECT event_id, CASE c_mktsegment WHEN 'BUILDING' THEN false ELSE true END AS masking FROM events LEFT JOIN customer ON user_id = c_custkey""")
def user_toggle(spark, sf_dir):
    setting = F.when(F.col("c_mktsegment") == "BUILDING", "false").when(F.col("c_mktsegment") == "MACHINERY", "broken")
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), setting.alias("pii_masking_enabled"))
    return chat.toggled(read_table(spark, sf_dir, "events"), users).select("event_id", "masking")


@register("request_bodies", f"""SELECT CAST(chat_id AS VARCHAR) AS chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY msg_idx) - 1 AS INT) AS msg_idx, role, text,
  CASE WHEN chat_id % 2 = 0 THEN 'tags_generation' END AS task FROM ({_MSG}) WHERE regexp_matches(text, '\\S')""")
def request_bodies(spark, sf_dir):
    """Conversations as JSON bodies, the id at the top or in the metadata, read back to rows of text parts."""
    turn = F.struct("msg_idx", F.struct("role", F.col("text").alias("content")).alias("m"))
    rows = messages(spark, sf_dir).groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["m"]).alias("messages"))
    own, even = F.col("chat_id").cast("string"), F.col("chat_id") % 2 == 0
    meta = F.struct(F.when(even, own).alias("chat_id"), F.when(even, "tags_generation").otherwise("").alias("task"))
    body = F.to_json(F.struct(F.when(even, "").otherwise(own).alias("chat_id"), "messages", meta.alias("metadata")))
    parts = chat.explode_parts(chat.read_bodies(rows.select(body.alias("body"))))
    return parts.select("chat_id", "msg_idx", "role", "text", "task")


@register("card_public", f"""WITH {sql.matches("f", TURNS, _VALUE, KEYS)}, l AS (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1)
SELECT f.conv_id AS chat_id, {_KIND} AS type, s AS start, e AS "end" FROM f JOIN l ON l.conv_id = f.conv_id AND l.turn = f.turn WHERE role = 'user'""")
def card_public(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("parts", chat.parts(F.col("text")))
    found = exploded(rows, find_all(F.col("text"), _VALUE), "m")
    kind = F.when(F.length("m.text") % 2 == 0, "PERSON").otherwise("USERNAME")
    return chat.card_rows(found.select("chat_id", "msg_idx", kind.alias("entity_type"), "m.start", "m.end"), rows)


