"""JSON bodies in and out."""

import json
import random

from pyspark.sql import functions as F

from veil.config import EngineConfig
from veil.functions.json_edit import edited, places
from veil.operators.bodies import mask_bodies
from veil.operators.vault import Vault

KEY = bytes(range(32))


def test_places_like_the_parser():
    """Every range that is found is the JSON text of the value at its path."""
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth < 4 else 4)
        if kind < 4:
            return [rng.choice(['a"b', "\\", "é\n😀", "{[,:]}", ""]), rng.choice([1, -2.5e10, True, None]), "x", 0][kind]
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {rng.choice('ab"\\{'): value(depth + 1) for _ in range(3)}

    for _ in range(300):
        whole = {"k": value(0), "m": value(0)}
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        found = places(text)
        for path, (a, b) in found.items():
            at = whole
            for step in path:
                at = at[step]
            assert json.loads(text[a:b]) == at
        assert {p for p in found if len(p) == 1} == {("k",), ("m",)}


def test_edits_leave_the_rest():
    text = '{ "n": 1.50e0,\t"metadata" : null, "messages":[{"content":"a", "x":[ ]}] }'
    assert edited(text, {("messages", 0, "content"): 'b"é'}, {}, "metadata") == text.replace('"a"', '"b\\"é"')
    assert edited(text, {("messages", 7): "no"}, {"k": "[]"}, "metadata") == text.replace("null", '{"k": []}')
    assert json.loads(edited("{}", {}, {"k": "1"}, "metadata")) == {"metadata": {"k": 1}}
    assert edited('{"metadata": {"k": 0, "l": 2}}', {}, {"k": "1", "m": "3"}, "metadata") == '{"metadata": {"k": 1, "l": 2, "m": 3}}'
    assert edited('{"metadata": {}, "metadata": { }}', {}, {"k": "1"}, "metadata") == '{"metadata": {}, "metadata": { "k": 1}}'


def test_bodies_in_and_out(spark):
    image = '{"type":"image_url","image_url":{"url":"data:a@b.com"},"n":1.0}'
    first = '{"model" : "m", "temperature":0.70, "chat_id":"c1","messages":[ {"role":"system","content":"s@x.org"},{"role":"user","name":"n","content":[{"type":"text","text":"mail a@x.org","cache":1}, %s, "odd", {"type":"text","text":" "}]}]}' % image
    second = '{"messages":[{"role":"user","content":"to b@x.org \\u00e9 \\n c@x.org"}],"metadata":{"user":"u","pii_detections":9}}'
    others = ["not json", "{}", '{"messages": []}', '{"messages": 3 }', None]
    plain = '{"chat_id":"c3", "messages":[{"role":"assistant","content":"hello"}]}'
    data = [(k, b, "kept") for k, b in enumerate([first, second, *others, plain])]
    bodies = spark.createDataFrame(data, "request_id int, body string, texts string")
    made = mask_bodies(bodies, Vault.empty(spark), F.lit("2024-01-01").cast("timestamp"), config=EngineConfig(languages=("en",)), key=KEY)
    got = {r.request_id: r for r in made.bodies.collect()}
    assert made.bodies.columns == bodies.columns and {r.texts for r in got.values()} == {"kept"}
    assert [got[2 + k].body for k in range(len(others))] == others
    out = json.loads(got[0].body)
    assert got[0].body.startswith(first.replace("mail a@x.org", "mail [EMAIL_1]")[:-1] + ', "metadata": {')
    assert out["metadata"]["pii_placeholder_map"] == {"a@x.org": "[EMAIL_1]"} and out["metadata"]["pii_reverse_map"] == {"[EMAIL_1]": "a@x.org"}
    assert out["metadata"]["pii_detections"] == [{"entity_type": "EMAIL", "start": 5, "end": 12, "score": 1.0, "original": "a@x.org", "placeholder": "[EMAIL_1]", "message_index": 1}]
    assert out["metadata"]["pii_detections_public"] == []  # two text parts
    out = json.loads(got[1].body)
    assert got[1].body.startswith('{"messages":[{"role":"user","content":"to [EMAIL_1] é \\n [EMAIL_2]"}],"metadata":{"user":"u","pii_detections":[')
    assert out["metadata"]["pii_detections_public"] == [{"start": 3, "end": 10, "type": "EMAIL"}, {"start": 15, "end": 22, "type": "EMAIL"}]
    assert {r.chat_id for r in made.masked.vault.mappings.collect()} == {"c1", "ephemeral:1"}
    out = json.loads(got[len(data) - 1].body)
    assert out.pop("metadata") == {"pii_detections": [], "pii_placeholder_map": {}, "pii_reverse_map": {}, "pii_detections_public": []} and out == json.loads(plain)
    assert mask_bodies(bodies.limit(0), Vault.empty(spark), F.lit("2024-01-01").cast("timestamp"), key=KEY).bodies.collect() == []
