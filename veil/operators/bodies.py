"""Requests as JSON bodies: masked in place, with what is published in their metadata; all else stays as it came."""

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.json_edit import edited, places
from veil.operators import chat, engine
from veil.operators.engine import Masked
from veil.operators.vault import Vault
from veil.sources import materialize, ship

#: Keys of the metadata of a masked body. Fixed values.
DETECTIONS, FORWARD, REVERSE, PUBLIC = "pii_detections", "pii_placeholder_map", "pii_reverse_map", "pii_detections_public"


class MaskedBodies(NamedTuple):
    """``bodies`` as they came in with ``body`` masked, and what ``mask_messages`` gives."""

    bodies: DataFrame
    masked: Masked


def write_bodies(bodies: DataFrame, edits: DataFrame, id_col: str, body_col: str = "body") -> DataFrame:
    """``bodies`` with changes: ``edits`` has ``id_col``, ``texts`` (structs ``msg_idx, part_idx, text``) and ``metadata``, a map of JSON texts.

    A part is written to where it was read: to ``content`` where that is a string, else to ``text`` of an item of the
    list. Bodies without a row in ``edits`` stay as they are. One body is a row; nothing else is held.
    """
    ship(bodies.sparkSession)
    rows = bodies.join(edits.select(id_col, F.col("texts").alias("__texts"), F.map_entries("metadata").alias("__metadata")), id_col, "left")
    schema = bodies.select(id_col, *(c for c in bodies.columns if c != id_col)).schema
    at = [schema.names.index(body_col), len(schema.names), len(schema.names) + 1]

    def run(batches):
        for batch in batches:
            out = []
            for body, texts, metadata in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                values = {}
                for t in texts or ():
                    values["messages", t["msg_idx"], "content", t["part_idx"], "text"] = t["text"]
                    if t["part_idx"] == 0:
                        values["messages", t["msg_idx"], "content"] = t["text"]
                out.append(_changed(body, values, {e["key"]: e["value"] for e in metadata}) if metadata is not None else body)
            columns = [pa.array(out, pa.string()) if k == at[0] else batch.column(k) for k in range(at[1])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(*schema.names, "__texts", "__metadata").mapInArrow(run, schema).select(*bodies.columns)


def _changed(body: str, values: dict, metadata: dict) -> str:
    found = places(body)
    lists = {p for p in values if len(p) == 3 and p in found and body[found[p][0]] != '"'}
    return edited(body, {p: v for p, v in values.items() if p not in lists and not (len(p) == 5 and p[:3] not in lists)}, metadata, "metadata")


def mask_bodies(bodies: DataFrame, known: Vault, now: Column, id_col: str = "request_id", body_col: str = "body", **options) -> MaskedBodies:
    """One request of each chat, as a JSON body: its texts are masked where they stand, and its metadata gets the detections, the
    maps and the public card of its last message.

    ``id_col`` tells bodies apart. A body without an id of its chat is a short-lived chat of its own. Bodies
    without a list of messages, and null ones, stay byte for byte; so does all of a body but the texts that
    change and the metadata: unknown keys, images, order, spaces and forms of numbers. ``options`` are those of
    ``engine.mask_messages``. An empty table gives an empty one.
    """
    read = chat.read_bodies(bodies.select(id_col, F.col(body_col).alias("body")))
    own = F.coalesce("chat_id", F.concat(F.lit(chat.EPHEMERAL), F.col(id_col).cast("string")))
    rows = materialize(read.withColumn("chat_id", own).drop("body"))
    made = engine.mask_messages(rows, known, now, **options)
    key = ["chat_id", "msg_idx"]
    after = made.messages.select(*key, F.col("parts").alias("after"))
    changed = F.filter(F.transform(F.arrays_zip("parts", "after"), lambda x, i: F.struct(i.alias("part_idx"), F.when(~x["parts"]["text"].eqNullSafe(x["after"]["text"]), x["after"]["text"]).alias("text"))), lambda x: x["text"].isNotNull())
    parts = rows.select(id_col, *key, "parts").join(after, key).select(id_col, "msg_idx", F.explode_outer(changed).alias("x")).where("x is not null")
    texts = parts.groupBy(id_col).agg(F.collect_list(F.struct("msg_idx", F.col("x.part_idx").alias("part_idx"), F.col("x.text").alias("text"))).alias("texts"))
    shown = F.struct("entity_type", "start", "end", "score", "original", "placeholder", F.col("msg_idx").alias("message_index"))
    found = made.detections.groupBy("chat_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("msg_idx", "part_idx", "start", shown.alias("d"))))["d"]).alias("found"))
    public = chat.card_rows(made.detections, rows.select(*key, "role", "parts")).groupBy("chat_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("start", "end", "type")))).alias("public"))
    maps = made.maps.select("chat_id", *(F.to_json(c).alias(c) for c in ("forward", "reverse")))
    whole = rows.select(id_col, "chat_id").distinct()
    for table in (found, public, maps):
        whole = whole.join(table, "chat_id", "left")
    part = lambda name, c, none: (F.lit(name), F.coalesce(c, F.lit(none)))
    pairs = (*part(DETECTIONS, "found", "[]"), *part(FORWARD, "forward", "{}"), *part(REVERSE, "reverse", "{}"), *part(PUBLIC, "public", "[]"))
    edits = whole.join(texts, id_col, "left").select(id_col, "texts", F.create_map(*pairs).alias("metadata"))
    return MaskedBodies(write_bodies(bodies, edits, id_col, body_col), made)
