"""The vault as state of a stream against the vault made by batches."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veil.operators import vault
from veil.streaming import vault_stream
from veil.streaming.vault import PAGE, _keeper

KEY, SECRET = bytes(range(32)), bytes(range(32, 64))
SCHEMA = "chat_id string, action string, turn long, start long, entity_type string, value string, placeholder string"


@pytest.fixture
def stream(spark, tmp_path):
    """``feed(rows, **options)`` appends rows to a source, runs what is new to its end and returns all results so far."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def feed(rows, **options):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = vault_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), KEY, **options)
        sink = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        sink.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()

    return feed


def say(chat, turn, start, kind, value):
    return (chat, "mask", turn, start, kind, value, None)


def ask(chat, turn, placeholder):
    return (chat, "restore", turn, 0, None, None, placeholder)


def test_numbers_equal_the_batch_vault_and_go_on_after_a_restart(spark, stream):
    rng = random.Random(3)
    rows = [say(f"c{rng.randrange(4)}", t, s, rng.choice(["PERSON", "EMAIL"]), f"v {rng.randrange(30)}") for t in range(40) for s in range(4)]
    shuffled = rng.sample(rows[:80], 80)
    stream(shuffled)
    got = {(r.chat_id, r.entity_type, r.value, r.placeholder) for r in stream(rng.sample(rows[80:], 80))}
    mentions = spark.createDataFrame(rows, SCHEMA).select("chat_id", "entity_type", "value", "turn", "start")
    want = vault.mint(mentions, ["turn", "start"]).select("chat_id", "entity_type", "original_value", "placeholder")
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100


def test_initial_state_from_a_batch_vault_with_encryption(spark, stream):
    now = F.current_timestamp()
    first = spark.createDataFrame([("a", "PERSON", "Ana", 0, 0), ("a", "PERSON", "Iva", 0, 5), ("z", "EMAIL", "x@y", 0, 0)], "chat_id string, entity_type string, value string, turn long, start long")
    known = vault.upsert(vault.Vault.empty(spark), first, ["turn", "start"], now, KEY, secret=SECRET).materialize()
    counters = known.counters.withColumn("next_value", F.when(F.col("chat_id") == "a", 7).otherwise(F.col("next_value")))
    got = stream([say("a", 1, 0, "PERSON", " Iva "), say("a", 1, 9, "PERSON", "Eva"), ask("a", 2, "[PERSON_1]"), ask("a", 2, "[PERSON_7]"), ask("z", 1, "[EMAIL_1]")], secret=SECRET, initial=vault.Vault(known.mappings, counters))
    assert sorted(tuple(r[4:]) for r in got) == [
        ("EMAIL", "x@y", "[EMAIL_1]"),
        ("PERSON", " Iva ", "[PERSON_2]"),
        ("PERSON", "Ana", "[PERSON_1]"),
        ("PERSON", "Eva", "[PERSON_7]"),
        ("PERSON", "Eva", "[PERSON_7]"),
    ]


def test_look_ups_unknown_values_and_odd_rows(stream):
    rows = [
        say("a", 0, 0, "PERSON", "Ana"),
        say("a", 0, 0, "PERSON", "Ana"),
        say("b", 0, 0, "PERSON", ""),
        say("b", 0, 0, None, "x"),
        say("b", 0, 0, "PERSON", None),
        ask("b", 0, None),
        ask("b", 0, "[PERSON_1]"),
        ask("b", 0, "[PERSON_9]"),
        ask("c", 0, "[PERSON_1]"),
    ]
    got = sorted((r.chat_id, r.action, r.value, r.placeholder) for r in stream(rows) if r.value is not None)
    assert got == [("a", "mask", "Ana", "[PERSON_1]")] * 2 + [("b", "mask", "", "[PERSON_1]"), ("b", "restore", "", "[PERSON_1]")]
    lost = sorted((r.chat_id, r.placeholder) for r in stream([ask("c", 1, "[PERSON_1]")]) if r.value is None)
    assert lost == [("b", "[PERSON_9]"), ("c", "[PERSON_1]"), ("c", "[PERSON_1]")]


def test_what_expires_is_gone_and_its_numbers_too(stream):
    stream([say("a", 0, 0, "PERSON", "Ana"), say("a", 0, 1, "PERSON", "Iva")], ttl_seconds=3)
    time.sleep(4)
    got = stream([ask("a", 1, "[PERSON_2]"), say("b", 1, 0, "PERSON", "Ana")], ttl_seconds=3)
    assert [r.value for r in got if r.action == "restore"] == [None]
    got = stream([say("a", 2, 0, "PERSON", "Eva"), ask("a", 2, "[PERSON_1]"), ask("a", 2, "[PERSON_2]")], ttl_seconds=600)
    assert sorted((r.action, r.placeholder, r.value) for r in got if r.turn == 2 and r.value) == [("mask", "[PERSON_1]", "Eva"), ("restore", "[PERSON_1]", "Eva")]


def test_a_chat_of_many_rows(spark, stream):
    """More rows in one chat than an Arrow batch or an output frame holds."""
    rows = [say("a", i, 0, "PERSON", f"v{i % 12_000}") for i in range(24_000)]
    got = {r.turn: r.placeholder for r in stream(rows)}
    assert len(got) == 24_000 and all(got[i] == f"[PERSON_{i % 12_000 + 1}]" for i in range(24_000))


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        vault_stream(spark.createDataFrame([], SCHEMA), b"short")


class Store:
    """A state store in memory that counts its calls: maps, lists and timers of one key."""

    def __init__(self):
        self.maps, self.timers, self.calls, self.now, self.largest = {}, [], 0, 0, 0

    def getMapState(self, name, *_):  # noqa: N802
        return Held(self, self.maps.setdefault(name, {}))

    getListState = getMapState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


class Held:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def getValue(self, key):  # noqa: N802
        self.store.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.store.calls += 1
        self.store.largest = max(self.store.largest, len(value[0]) if isinstance(value[0], str) else 0)
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.rows.pop(key, None)

    def iterator(self):
        return iter(self.rows.items())

    def exists(self):
        return bool(self.rows)

    def appendList(self, rows):  # noqa: N802
        self.rows.setdefault("", []).extend(rows)

    def get(self):
        return iter(self.rows.get("", []))

    def clear(self):
        self.rows.clear()


def fed(store, rows):
    keeper = _keeper(60)
    keeper.init(store)
    frame = pd.DataFrame(rows, columns=["chat_id", "action", "turn", "start", "entity_type", "sealed", "placeholder"])
    frame["hash"] = frame["sealed"]
    return [tuple(r) for out in keeper.handleInputRows((0,), iter([frame]), store) for r in out.itertuples(index=False)]


def test_few_calls_to_the_state_store():
    """It was two calls and more a row; a chat now takes its head, and pages of values and placeholders, once each way."""
    for chats in (1, 100):
        store = Store()
        rows = [say(f"c{chat}", t, 0, "PERSON", f"v{chat} {t}") for chat in range(chats) for t in range(20)] + [ask(f"c{chat}", 0, "[PERSON_20]") for chat in range(chats)]
        got = fed(store, rows)
        assert len(got) == 21 * chats and store.calls <= 6 * chats
        assert {(r[0], r[5], r[6]) for r in got} == {(f"c{chat}", f"v{chat} {t}", f"[PERSON_{t + 1}]") for chat in range(chats) for t in range(20)}
        assert sorted(fed(store, rows)) == sorted(got)
        assert store.calls <= 12 * chats


def test_pages_stay_small_in_a_large_chat_and_go_when_all_has_expired():
    store, n = Store(), 100 * PAGE
    fed(store, [say("a", t, 0, "PERSON", f"v{t}") for t in range(n)] + [say(None, 0, 0, "EMAIL", "x")])
    assert store.largest < 400 * PAGE
    got = fed(store, [ask("a", 1, f"[PERSON_{t + 1}]") for t in range(n)] + [say("a", 1, 0, "PERSON", f"v{t}") for t in range(n)] + [ask(None, 1, "[EMAIL_1]")])
    assert {(r[0], r[5], r[6]) for r in got} == {("a", f"v{t}", f"[PERSON_{t + 1}]") for t in range(n)} | {(None, "x", "[EMAIL_1]")}
    store.now = 30_000
    fed(store, [ask("a", 2, "[PERSON_7]")])
    for store.now, left in ((60_000, [("PERSON", "v6", "[PERSON_7]")]), (90_000, [])):
        store.timers.clear()
        keeper = _keeper(60)
        keeper.init(store)
        assert [len(out) for out in keeper.handleExpiredTimer((0,), store, None)] == [0]
        asked = store.now, {k: dict(v) for k, v in store.maps.items()}
        assert [r[4:] for r in fed(store, [ask("a", 3, "[PERSON_7]"), ask("a", 3, "[PERSON_8]"), ask(None, 3, "[EMAIL_1]")]) if r[5]] == left
        store.maps["pages"].clear()
        store.maps["pages"].update(asked[1]["pages"])
    assert not store.maps["pages"] and not store.timers
