"""The vault in buckets: what a request reads and writes, writers at once, and masking upon it."""

import pytest
from pyspark.sql import functions as F

from veil.config import EngineConfig
from veil.operators.engine import mask_messages, restore_messages
from veil.operators.vault_store import VaultStore

KEY = bytes(range(32))
NOW, LATER = "2024-01-01", "2024-01-03"
ORDER = ["at"]
MENTION = "chat_id string, entity_type string, value string, at int"


def at(day):
    return F.lit(day).cast("timestamp")


@pytest.fixture
def store(spark, tmp_path):
    return VaultStore(spark, f"file://{tmp_path}/vault", 32)


def rows(spark, *data):
    return spark.createDataFrame(list(data), MENTION)


def placeholders(vault):
    return {(r.chat_id, r.original_value): r.placeholder for r in vault.mappings.collect()}


def test_a_request_touches_the_buckets_of_its_chats_only(spark, store, tmp_path):
    every = rows(spark, *[(f"c{k}", "PERSON", f"Ana {k}", 0) for k in range(400)])
    store.upsert(every, ORDER, at(NOW), KEY)
    log = lambda: {p.parent.name: max(int(q.name) for q in p.parent.iterdir() if q.name.isdigit()) for p in tmp_path.glob("vault/log/0*/*")}
    before, files = log(), set(tmp_path.glob("vault/data/*/*/*/*.parquet"))
    assert len(before) == 32
    chats = rows(spark, *[(f"c{k}", "PERSON", "Ivo", 0) for k in range(10)])
    which = set(store.buckets.touched(chats))
    assert len(which) <= 10
    read = store.read(chats)
    assert {f.rsplit("__bucket=", 1)[1].split("/")[0] for f in read.mappings.inputFiles()} == set(map(str, which))
    after = store.upsert(chats, ORDER, at(NOW), KEY)
    assert {int(b) for b, v in log().items() if v > before[b]} == which
    new = set(tmp_path.glob("vault/data/*/*/*/*.parquet")) - files
    assert {int(p.parent.name.split("=")[1]) for p in new} == which and len(new) <= 2 * len(which)
    found = placeholders(after)
    assert all(found[f"c{k}", f"Ana {k}"] == "[PERSON_1]" and found[f"c{k}", "Ivo"] == "[PERSON_2]" for k in range(10))
    assert len(placeholders(store.read())) == 410
    assert store.buckets.vacuum() == 0  # buckets of both folders are in use
    store.upsert(every, ORDER, at(NOW), KEY)
    assert store.buckets.vacuum() == 2 and len(placeholders(store.read())) == 410


def test_writers_at_once_give_a_value_one_placeholder(spark, store):
    """Both have read the empty vault. The first one's numbers stay, and the other's new values go on from them."""
    chats = [f"c{k}" for k in range(20)]
    before = store.buckets.read()
    one = rows(spark, *[(c, "PERSON", v, k) for c in chats for k, v in enumerate(["Ana", "Ivo"])])
    two = rows(spark, *[(c, "PERSON", v, k) for c in chats + ["other"] for k, v in enumerate(["Maja", "Ivo", "Ana"])])
    store.upsert(one, ORDER, at(NOW), KEY, before=before)
    found = placeholders(store.upsert(two, ORDER, at(NOW), KEY, before=before))
    for c in chats:
        assert [found[c, v] for v in ("Ana", "Ivo", "Maja")] == ["[PERSON_1]", "[PERSON_2]", "[PERSON_3]"]
    assert [found["other", v] for v in ("Maja", "Ivo", "Ana")] == ["[PERSON_1]", "[PERSON_2]", "[PERSON_3]"]
    assert placeholders(store.read()) == found
    counters = {(r.chat_id, r.next_value) for r in store.read().counters.collect()}
    assert counters == {(c, 4) for c in chats + ["other"]}


def test_a_writer_that_fails_leaves_the_vault_as_it_was(spark, store):
    store.upsert(rows(spark, ("c", "PERSON", "Ana", 0)), ORDER, at(NOW), KEY)

    def broken(known, part):
        return known._replace(mappings=known.mappings.withColumn("original_value", F.raise_error(F.lit("lost")).cast("string")))

    with pytest.raises(Exception, match="lost"):
        store.change(rows(spark, ("c", "PERSON", "Ivo", 0)), broken)
    assert placeholders(store.read()) == {("c", "Ana"): "[PERSON_1]"}


def test_purge_and_renew_by_chat(spark, store):
    store.upsert(rows(spark, *[(c, "PERSON", "Ana", 0) for c in ("a", "b", "c")]), ORDER, at(NOW), KEY, ttl=86_400)
    store.renew(rows(spark, ("b", "", "", 0)), at(NOW), ttl=86_400 * 7)
    store.purge(rows(spark, ("a", "", "", 0), ("b", "", "", 0)), at(LATER))
    assert set(placeholders(store.read())) == {("b", "Ana"), ("c", "Ana")}


def test_number_of_buckets_is_the_first_writers(spark, store):
    assert VaultStore(spark, store.buckets.path, 7).buckets.buckets == 32


def test_empty_vault_and_no_chats(spark, store):
    assert store.read().mappings.collect() == [] and store.upsert(rows(spark), ORDER, at(NOW), KEY).mappings.collect() == []


def test_requests_at_once_are_masked_with_what_is_stored(spark, store, monkeypatch):
    """While one request is masked another one commits: chats of its buckets are masked anew, with the other's numbers."""
    config = EngineConfig(languages=("en",))
    schema = "chat_id string, msg_idx int, role string, parts array<struct<type:string,text:string>>"
    ask = lambda *texts: spark.createDataFrame([(c, 0, "user", [("text", t)]) for c, t in texts], schema)
    one = ask(*[(f"c{k}", "mail b@x.org or a@x.org") for k in range(4)])
    commit, once = store.buckets.commit, []

    def late(tables, before):
        if not once:
            once.append(1)
            store.mask(ask(("c1", "mail a@x.org")), at(NOW), config=config, key=KEY)
        return commit(tables, before)

    monkeypatch.setattr(store.buckets, "commit", late)
    made = store.mask(one, at(NOW), config=config, key=KEY)
    texts = {r.chat_id: r.parts[0].text for r in made.messages.collect()}
    first, other = "mail [EMAIL_1] or [EMAIL_2]", "mail [EMAIL_2] or [EMAIL_1]"
    assert texts == {"c0": first, "c1": other, "c2": first, "c3": first}
    assert {r.chat_id: r.n_detections for r in made.summary.collect()} == dict.fromkeys(texts, 2)
    answers = made.messages.select("chat_id", F.col("parts")[0]["text"].alias("text"))
    back = restore_messages(answers, store.read(answers), at(NOW), config).messages.collect()
    assert {r.text for r in back} == {"mail b@x.org or a@x.org"}
    plain = mask_messages(one, store.read(one), at(NOW), config, key=KEY).messages.collect()
    assert {r.chat_id: r.parts[0].text for r in plain} == texts
