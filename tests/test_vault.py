import base64
import datetime
import hashlib
import hmac
import struct

import pytest
from pyspark.sql import functions as F

from veil.functions import crypto
from veil.operators import vault

def at(text="2024-01-01 00:00:00"):
    return F.lit(text).cast("timestamp")


LATER = "2024-01-05 00:00:00"
KEY, SECRET = bytes(range(32)), bytes(range(32, 64))


def mentions(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "chat_id string, entity_type string, value string, at int")


def mint(spark, mode, *rows):
    return {(r.chat_id, r.original_value): r.placeholder for r in vault.mint(mentions(spark, *rows), ["at"], mode).collect()}


ROWS = [("a", "PERSON", "Ana"), ("a", "PERSON", "Ana"), ("a", "PERSON", "Iva"), ("a", "EMAIL", "x@y.z"), ("b", "PERSON", "Iva"), ("a", "EMAIL", "Ana")]


def test_dense_numbers_have_no_gaps(spark):
    got = vault.mint(mentions(spark, *ROWS), ["at"]).collect()
    assert {(r.chat_id, r.entity_type, r.original_value, r.placeholder) for r in got} == {
        ("a", "PERSON", "Ana", "[PERSON_1]"), ("a", "PERSON", "Iva", "[PERSON_2]"), ("a", "EMAIL", "x@y.z", "[EMAIL_1]"), ("b", "PERSON", "Iva", "[PERSON_1]"), ("a", "EMAIL", "Ana", "[EMAIL_2]")}


def test_gap_numbers_count_mentions(spark):
    assert mint(spark, "gap", *ROWS[:3])[("a", "Iva")] == "[PERSON_3]"


def test_untyped_values_share_a_placeholder(spark):
    assert mint(spark, "untyped", *ROWS)[("a", "Ana")] == "[PERSON_1]"


def test_first_literal_stays(spark):
    assert mint(spark, "dense", ("a", "ADDRESS", "1 St,\nX"), ("a", "ADDRESS", "1 St, X")) == {("a", "1 St,\nX"): "[ADDRESS_1]"}


def test_a_hot_chat_is_numbered_over_many_ranges(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("g"), F.xxhash64("id").alias("o"))
    got = [r.n for r in vault.numbered(rows, ["g"], ["o"]).orderBy("o").collect()]
    assert got == list(range(1, 3001))


def upsert(known, now, *rows, **more):
    return vault.upsert(known, mentions(known.mappings.sparkSession, *rows), ["at"], now, KEY, **more).materialize()


def held(known):
    return {r.original_value: (r.placeholder, r.expires_at) for r in known.mappings.collect()}


def test_upsert_renews_expires_and_restarts(spark):
    first = upsert(vault.Vault.empty(spark), at(), ("a", "PERSON", "Ana"), ("a", "PERSON", "Iva"))
    soon = at("2024-01-01 20:00:00")
    second = upsert(first, soon, ("a", "PERSON", "Iva"), ("a", "PERSON", "Eva"))
    got = held(second)
    assert got["Eva"][0] == "[PERSON_3]" and got["Iva"][1] == datetime.datetime(2024, 1, 2, 20) and got["Ana"][1] == datetime.datetime(2024, 1, 2)
    third = upsert(second, at(LATER), ("a", "PERSON", "Zoe"))
    assert [(r.original_value, r.placeholder) for r in third.mappings.collect()] == [("Zoe", "[PERSON_1]")]


def test_a_number_given_out_is_not_given_again(spark):
    """Ana keeps the counter alive; Bo and Cy expire, and the next person is the fourth."""
    first = upsert(vault.Vault.empty(spark), at(), *(("a", "PERSON", v) for v in ("Ana", "Bo", "Cy")))
    second = upsert(first, at("2024-01-01 20:00:00"), ("a", "PERSON", "Ana"))
    third = upsert(second, at("2024-01-02 10:00:00"), ("a", "PERSON", "Dan"))
    assert {v: p for v, (p, _) in held(third).items()} == {"Ana": "[PERSON_1]", "Dan": "[PERSON_4]"}
    assert [r.next_value for r in third.counters.collect()] == [5]
    bare = vault.Vault(first.mappings, spark.createDataFrame([], vault.COUNTERS))  # a table without counters goes on too
    assert held(upsert(bare, at(), ("a", "PERSON", "Dan")))["Dan"][0] == "[PERSON_4]"


def test_gap_counters_move_with_each_mention(spark):
    first = upsert(vault.Vault.empty(spark), at(), ("a", "PERSON", "Ana"), ("a", "PERSON", "Ana"), ("a", "PERSON", "Iva"), mode="gap")
    second = upsert(first, at(), ("a", "PERSON", "Ana"), ("a", "PERSON", "Eva"), mode="gap")
    assert {v: p for v, (p, _) in held(second).items()} == {"Ana": "[PERSON_1]", "Iva": "[PERSON_3]", "Eva": "[PERSON_5]"}
    assert second.counters.first().next_value == 6


def test_an_active_chat_lives_on(spark):
    known = upsert(vault.Vault.empty(spark), at(), ("a", "PERSON", "Ana"), ("b", "PERSON", "Bo"))
    chats = spark.createDataFrame([("a",)], "chat_id string")
    later = vault.renew_chats(known, chats, at("2024-01-01 20:00:00")).materialize()
    alive = {r.chat_id for r in vault.live(later.mappings, at("2024-01-02 10:00:00")).collect()}
    assert alive == {"a"} == {r.chat_id for r in vault.live(later.counters, at("2024-01-02 10:00:00")).collect()}
    asked = spark.createDataFrame([("b", "[PERSON_1]")], "chat_id string, placeholder string")
    hit = vault.renew(known.mappings, asked, at("2024-01-01 20:00:00"), on=("chat_id", "placeholder"))
    assert {r.chat_id for r in vault.live(hit, at("2024-01-02 10:00:00")).collect()} == {"b"}
    gone = vault.renew_chats(known, chats, at(LATER))
    assert vault.live(gone.mappings, at(LATER)).count() == 0


def test_no_vault_without_a_key(spark):
    for key in (None, b"short"):
        with pytest.raises(ValueError):
            vault.upsert(vault.Vault.empty(spark), mentions(spark, ("a", "PERSON", "Ana")), ["at"], at(), key)


@pytest.mark.parametrize("most", [1000, 1])
def test_known_values_meet_only_texts_that_hold_them(spark, most):
    """A conversation with few values and one with more than ``most``, joined by words, give the same masked texts."""
    from veil.operators import masking

    values = ["Ana", "Ana Kos", "+385 91", "++", "Iva"]
    known = upsert(vault.Vault.empty(spark), at(), *(("a", "PERSON", v) for v in values))
    rows = [("a", 1, "Ana Kos zove Ana +385 91 ++ Ivana"), ("a", 2, None), ("b", 3, "Ana")]
    texts = spark.createDataFrame(rows, "chat_id string, n int, text string")
    got = vault.known_in(texts, known, at(), ["n"], most=most).select("n", masking.remask(F.col("text"), F.col("forward")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {1: "[PERSON_2] zove [PERSON_1] [PERSON_3] [PERSON_4] Ivana", 2: None, 3: "Ana"}
    before = texts.withColumn("was", at("2023-12-31"))
    assert all(not r.forward for r in vault.known_in(before, known, at(), ["n"], before="was", most=most).collect())


def test_snapshot_and_look_up_see_live_rows_only(spark):
    known = upsert(vault.Vault.empty(spark), at(), ("a", "PERSON", "Ana"), ("a", "EMAIL", "Ana"), secret=SECRET)
    assert all(r.original_value.startswith("ENC1:") for r in known.mappings.collect())
    row = vault.snapshot(known, at(), SECRET).first()
    assert row.forward == {"Ana": "[EMAIL_1]"} and row.reverse == {"[PERSON_1]": "Ana", "[EMAIL_1]": "Ana"}
    assert vault.snapshot(known, at(LATER), SECRET).count() == 0 and vault.snapshot(known, at(), KEY).count() == 0
    asked = spark.createDataFrame([("a", "[PERSON_1]"), ("a", "[PERSON_9]"), ("b", "[PERSON_1]")], "chat_id string, placeholder string")
    found = {(r.chat_id, r.placeholder): r.original for r in vault.look_up(asked, known.mappings, at(), SECRET).collect()}
    assert found == {("a", "[PERSON_1]"): "Ana", ("a", "[PERSON_9]"): None, ("b", "[PERSON_1]"): None}
    assert known.counters.where("entity_type = 'PERSON'").first().next_value == 2


def test_envelope_layout(spark):
    long = "x" * 300
    sealed = spark.createDataFrame([("abc",), (long,)], "v string").select(crypto.encrypt(F.col("v"), SECRET, 7).alias("x")).collect()
    raw = base64.b64decode(sealed[0].x.removeprefix("ENC1:"), validate=True)
    assert struct.unpack(">BI", raw[:5]) == (1, 7) and len(raw) == 5 + 12 + 3 + 16
    base64.b64decode(sealed[1].x.removeprefix("ENC1:"), validate=True)


def test_decrypt_paths(spark):
    df = spark.createDataFrame([("plain",), ("ENC1:AAAA",), ("ENC1:!!",)], "v string")
    assert [r.p for r in df.select(crypto.decrypt(F.col("v"), SECRET).alias("p")).collect()] == ["plain", None, None]
    assert [r.p for r in df.select(crypto.decrypt(F.col("v"), SECRET, strict=True).alias("p")).collect()] == [None] * 3


def test_blind_index_is_hmac(spark):
    fields = ("chat", "PERSON", "Ana č")
    framed = crypto.DOMAIN + b"".join(struct.pack(">I", len(f.encode())) + f.encode() for f in fields)
    got = spark.range(1).select(crypto.blind_index(KEY, *map(F.lit, fields)).alias("h")).first().h
    assert bytes(got) == hmac.new(KEY, framed, hashlib.sha256).digest()


@pytest.mark.parametrize("bad", [None, "", "x", base64.b64encode(b"short").decode()])
def test_keys_fail_closed(bad):
    with pytest.raises(ValueError):
        crypto.load_key(bad)
    assert crypto.load_key(base64.b64encode(KEY).decode()) == KEY


def test_stream_mints_like_a_batch(spark, tmp_path):
    from veil.streaming import mint_stream

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "chat_id string, turn long, entity_type string, value string"
    source = tmp_path / "in"
    frame = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    frame(("a", 0, "PERSON", "Ana"), ("a", 1, "PERSON", "Iva"), ("b", 0, "PERSON", "Iva"))
    out = mint_stream(spark.readStream.schema(schema).parquet(str(source)), KEY)
    run = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    frame(("a", 2, "PERSON", "Ana"), ("a", 3, "PERSON", "Eva"), ("a", 4, "EMAIL", "Eva"))
    run()
    got = {(r.chat_id, r.turn): r.placeholder for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): "[PERSON_1]", ("a", 1): "[PERSON_2]", ("b", 0): "[PERSON_1]", ("a", 2): "[PERSON_1]", ("a", 3): "[PERSON_3]", ("a", 4): "[EMAIL_1]"}
