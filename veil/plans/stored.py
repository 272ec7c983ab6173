"""Queries of the vault in buckets, requests one after another and writers at once, and of JSON bodies."""

import uuid

from pyspark.sql import functions as F

from veil.operators import chat
from veil.operators.bodies import mask_bodies
from veil.operators.vault import Vault
from veil.operators.vault_store import VaultStore
from veil.plans.flows import _FLOW, _MASKED, BEFORE, CONFIG, _messages, _names
from veil.plans.threads import _F, _NUMBER, _ROW, KEY, MINTED, NOW, ORDER, at, mentions
from veil.sources import read_table, shared_dir

QUERIES, ORACLE_SQL = {}, {}


def register(name, text):
    def keep(query):
        QUERIES[name], ORACLE_SQL[name] = query, text
        return query

    return keep


def store(spark, buckets=16):
    return VaultStore(spark, f"{shared_dir(spark)}/veil-vault-{uuid.uuid4().hex}", buckets)


@register("vault_store", f"WITH {_F}, {_NUMBER} SELECT {_ROW} FROM n")
def vault_store(spark, sf_dir):
    """First turns, then all turns of one chat in three, then all: each change writes the buckets of its chats only."""
    rows, kept = mentions(spark, sf_dir), store(spark)
    for part in (rows.where("turn = 0"), rows.where("cast(chat_id as long) % 3 = 0"), rows):
        kept.upsert(part, ORDER, at(NOW), KEY)
    return kept.read().mappings.select(*MINTED)


@register("vault_store_conflict", f"WITH {_F}, {_NUMBER} SELECT {_ROW} FROM n")
def vault_store_conflict(spark, sf_dir):
    """Two writers that have read the same empty vault: the second finds what the first has numbered."""
    rows, kept = mentions(spark, sf_dir), store(spark)
    before = kept.buckets.read()
    kept.upsert(rows.where("turn = 0"), ORDER, at(NOW), KEY, before=before)
    kept.upsert(rows, ORDER, at(NOW), KEY, before=before)
    return kept.read().mappings.select(*MINTED)


@register("mask_stored", f"""WITH {_FLOW}, {_MASKED} SELECT CAST(c.conv_id AS VARCHAR) AS chat_id, CAST(c.turn AS INT) AS msg_idx, coalesce(masked, text) AS masked
FROM conversations c LEFT JOIN j ON j.conv_id = c.conv_id AND j.turn = c.turn""")
def mask_stored(spark, sf_dir):
    """The two requests of mask_messages upon a vault in buckets."""
    rows, kept = _messages(spark, sf_dir), store(spark)
    ask = lambda asked, now: kept.mask(asked, at(now), config=CONFIG, recognizers=(), key=KEY, analyzers={"hr": _names})
    ask(rows.where("msg_idx = 0"), BEFORE)
    return ask(rows, NOW).messages.select("chat_id", "msg_idx", F.col("parts")[0]["text"].alias("masked"))


def _bodies(spark, sf_dir, turns):
    """A JSON body for each conversation, with keys that masking knows nothing of."""
    rows = read_table(spark, sf_dir, "conversations").where(turns)
    message = F.struct("turn", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("json"))
    rows = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(message)), lambda m: m["json"]), " , ").alias("m"))
    body = F.concat(F.lit('{"stream":true, "top_p":1.50,"chat_id": "'), "conv_id", F.lit('", "messages":['), "m", F.lit('],"seed" :7}'))
    return rows.select(F.col("conv_id").alias("request_id"), body.alias("body"))


@register("mask_bodies", f"""WITH {_FLOW}, {_MASKED} SELECT CAST(c.conv_id AS VARCHAR) AS chat_id, CAST(c.turn AS INT) AS msg_idx, coalesce(masked, text) AS masked, true AS kept
FROM conversations c LEFT JOIN j ON j.conv_id = c.conv_id AND j.turn = c.turn""")
def mask_bodies_(spark, sf_dir):
    """The two requests of mask_messages as JSON bodies; the second one's are read again."""
    ask = lambda turns, known, now: mask_bodies(_bodies(spark, sf_dir, turns), known, at(now), config=CONFIG, recognizers=(), key=KEY, analyzers={"hr": _names})
    made = ask("true", ask("turn = 0", Vault.empty(spark), BEFORE).masked.vault, NOW).bodies
    kept = F.startswith("body", F.lit('{"stream":true, "top_p":1.50,"chat_id": "')) & F.contains("body", F.lit('],"seed" :7, "metadata": {"pii_detections": '))
    return chat.read_bodies(made.withColumn("kept", kept)).select("chat_id", "msg_idx", F.col("parts")[0]["text"].alias("masked"), "kept")
