import base64
import json

import pytest
from pyspark.sql import functions as F

from veil.config import EngineConfig
from veil.functions.language import window_language
from veil.operators import chat, engine, ner, vault
from veil.operators.spans import span


def at(text="2024-01-01 00:00:00"):
    return F.lit(text).cast("timestamp")


MESSAGES = "chat_id string, msg_idx int, role string, parts array<struct<type:string,text:string>>"


def text(t):
    return [("text", t)]


def run(spark, rows, known=None, now=None, schema=MESSAGES, key=bytes(32), secret=None, analyzers=None, model=None, healthy=True, **config):
    known = known or vault.Vault.empty(spark)
    return engine.mask_messages(spark.createDataFrame(rows, schema), known, at() if now is None else now, EngineConfig(**config), key=key, secret=secret, analyzers=analyzers, model=model, vault_healthy=healthy)


def parts(result):
    return {(r.chat_id, r.msg_idx): [p.text for p in r.parts] for r in result.messages.collect()}


def mask(spark, rows, known=None, **more):
    made = run(spark, rows, known, **more)
    return parts(made), made.detections.collect(), made.vault.materialize()


def test_documents(spark):
    df = spark.createDataFrame([(1, "Moj OIB je 12345678903"), (2, None), (3, ""), (4, "😀 a@b.com a@b.com c@d.org")], "doc_id long, text string")
    got = {r.doc_id: (r.masked_text, r.n_spans) for r in engine.mask_documents(df).collect()}
    assert got == {1: ("Moj OIB je [HR_OIB_1]", 1), 2: (None, 0), 3: ("", 0), 4: ("😀 [EMAIL_1] [EMAIL_1] [EMAIL_2]", 3)}
    again = engine.mask_documents(engine.mask_documents(df).select("doc_id", F.col("masked_text").alias("text")))
    assert {r.doc_id: r.masked_text for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_two_requests(spark):
    first, found, after = mask(spark, [("c", 0, "user", text("Moj OIB je 12345678903, a@b.com")), ("c", 1, "assistant", text("Hi a@b.com, c@d.org")), ("c", 2, "system", text("a@b.com"))])
    assert first == {("c", 0): ["Moj OIB je [HR_OIB_1], [EMAIL_1]"], ("c", 1): ["Hi [EMAIL_1], [EMAIL_2]"], ("c", 2): ["a@b.com"]}
    assert {(d.entity_type, d.start, d.end) for d in found if d.msg_idx == 1} == {("EMAIL", 3, 10), ("EMAIL", 12, 19)}
    second, found, _ = mask(spark, [("c", 0, "user", text("old q@r.st, a@b.com")), ("c", 1, "user", text("c@d.org q@r.st c@d.org"))], after)
    assert second == {("c", 0): ["old q@r.st, [EMAIL_1]"], ("c", 1): ["[EMAIL_2] [EMAIL_3] [EMAIL_2]"]}
    # Known values that stand in a searched message are told too; the first message is not searched.
    assert sorted((d.msg_idx, d.original, d.start, d.end, d.score) for d in found) == [(1, "c@d.org", 0, 7, 1.0), (1, "c@d.org", 15, 22, 1.0), (1, "q@r.st", 8, 14, 1.0)]
    back = engine.restore_messages(spark.createDataFrame([("c", "to [EMAIL_2] [EMAIL_9]"), ("d", "[EMAIL_2]")], "chat_id string, text string"), after, at()).messages
    assert {r.chat_id: (r.text, r.restored, r.unknown) for r in back.collect()} == {"c": ("to c@d.org [EMAIL_9]", ["[EMAIL_2]"], ["[EMAIL_9]"]), "d": ("[EMAIL_2]", [], [])}


def test_switches(spark):
    rows = [("c", 0, "user", text("a@b.com"))]
    assert mask(spark, rows, enabled=False)[0] == {("c", 0): ["a@b.com"]}
    assert mask(spark, rows, history_scope=False)[0] == {("c", 0): ["[EMAIL_1]"]}


def test_maps_and_counts(spark):
    rows = [("c", 0, "user", text("a@b.com, a@b.com")), ("c", 1, "assistant", text("c@d.org")), ("d", 0, "user", text("nothing"))]
    made = run(spark, rows)
    maps = {r.chat_id: (r.forward, r.reverse) for r in made.maps.collect()}
    assert maps == {"c": ({"a@b.com": "[EMAIL_1]", "c@d.org": "[EMAIL_2]"}, {"[EMAIL_1]": "a@b.com", "[EMAIL_2]": "c@d.org"})}
    assert {tuple(r) for r in made.summary.collect()} == {("c", 2, 3, 2, 0), ("d", 1, 0, 0, 0)}


def test_kill_switch_publishes_maps_and_renews(spark):
    rows = [("c", 0, "user", text("a@b.com"))]
    after = run(spark, rows).vault.materialize()
    made = run(spark, [("c", 0, "user", text("a@b.com q@r.st"))], after, at("2024-01-01 20:00:00"), detection_enabled=False)
    assert parts(made) == {("c", 0): ["a@b.com q@r.st"]} and made.maps.first().reverse == {"[EMAIL_1]": "a@b.com"}
    assert vault.live(made.vault.mappings, at("2024-01-02 10:00:00")).count() == 1


def test_active_chat_keeps_its_values(spark):
    """Every request and every restored answer renews the values of its chat, used or not."""
    after = run(spark, [("c", 0, "user", text("a@b.com"))]).vault.materialize()
    after = run(spark, [("c", 0, "user", text("hello"))], after, at("2024-01-01 20:00:00")).vault.materialize()
    answer = spark.createDataFrame([("c", "[EMAIL_1]")], "chat_id string, text string")
    back = engine.restore_messages(answer, after, at("2024-01-02 16:00:00"))
    assert back.messages.first().text == "a@b.com"
    assert [r.text for r in engine.restore_messages(answer, back.vault.materialize(), at("2024-01-03 12:00:00")).messages.collect()] == ["a@b.com"]
    assert engine.restore_messages(answer, after, at("2024-01-03 12:00:00")).messages.first().text == "[EMAIL_1]"


def test_published_map_comes_first(spark):
    after = run(spark, [("c", 0, "user", text("a@b.com"))]).vault.materialize()
    rows = [("c", "[EMAIL_1]", {"[EMAIL_1]": "x@y.z"}), ("c", "[EMAIL_1] [EMAIL_7]", {}), ("c", "[EMAIL_1]", None), ("e", "[EMAIL_1]", None), ("c", None, None)]
    df = spark.createDataFrame(rows, "chat_id string, text string, reverse map<string,string>")
    got = [(r.text, r.unknown) for r in engine.restore_messages(df, after, at()).messages.collect()]
    assert sorted(got, key=repr) == sorted([("x@y.z", []), ("a@b.com [EMAIL_7]", ["[EMAIL_7]"]), ("a@b.com", []), ("[EMAIL_1]", []), (None, [])], key=repr)
    off = engine.restore_messages(df, after, at(), EngineConfig(vault_enabled=False)).messages.collect()
    assert sorted(str(r.text) for r in off) == ["None", "[EMAIL_1]", "[EMAIL_1]", "[EMAIL_1] [EMAIL_7]", "x@y.z"]


def test_ephemeral_chats_expire_soon(spark):
    after = run(spark, [(c, 0, "user", text("a@b.com")) for c in ("ephemeral:1", "c")]).vault
    alive = {r.chat_id for r in vault.live(after.mappings, at("2024-01-01 00:30:00")).collect()}
    assert alive == {"c"}


def test_without_vault_values_are_numbered_in_the_request(spark):
    rows = [("c", 0, "user", text("a@b.com, c@d.org")), ("c", 1, "user", text("a@b.com"))]
    for more in ({"vault_enabled": False}, {"healthy": False, "degradation_mode": "passthrough"}):
        made = run(spark, rows, key=None, **more)
        assert parts(made) == {("c", 0): ["[EMAIL_1], [EMAIL_2]"], ("c", 1): ["[EMAIL_1]"]}
        assert made.maps.first().forward == {"a@b.com": "[EMAIL_1]", "c@d.org": "[EMAIL_2]"} and made.vault.mappings.count() == 0
    with pytest.raises(RuntimeError):
        run(spark, rows, healthy=False)


def test_keys_are_due(spark):
    rows = [("c", 0, "user", text("a@b.com"))]
    for more in ({"key": None}, {"encryption_enabled": True}, {"secret": bytes(32)}, {"encryption_enabled": True, "secret": b"x"}):
        with pytest.raises(ValueError):
            run(spark, rows, **more)
    made = run(spark, rows, encryption_enabled=True, secret=bytes(32), key_id=7)
    stored = made.vault.mappings.first().original_value
    assert base64.b64decode(stored.removeprefix("ENC1:"))[:5] == bytes([1, 0, 0, 0, 7]) and made.maps.first().forward == {"a@b.com": "[EMAIL_1]"}


def test_analyzers_and_model_in_the_flow(spark):
    """Names of two analyzers count in text of their language, model spans everywhere; a person found twice is one."""
    named = lambda t: ner.gazetteer(t, {"Ana Kos": "PERSON", "Ivo": "PERSON"})

    def load():
        return lambda w: [("username", "kx9", w.find("kx9"), w.find("kx9") + 3, None)] if "kx9" in w else []

    rows = [("c", 0, "user", text("this is from Ana Kos and kx9, with thanks to Ivo for the help a@b.com"))]
    made = run(spark, rows, analyzers={"hr": named, "en": named}, model=load)
    assert parts(made) == {("c", 0): ["this is from [PERSON_1] and [USERNAME_1], with thanks to [PERSON_2] for the help [EMAIL_1]"]}
    assert made.summary.first().n_dropped == 2
    only = run(spark, rows, analyzers={"hr": named}, languages=("hr",))
    assert parts(only)[("c", 0)][0].startswith("this is from Ana Kos") and only.summary.first().n_dropped == 2


def test_recognizers_win_ties_with_analyzers_and_these_with_the_model(spark):
    """Of spans with one range and score the first listed stays: recognizers, then analyzers, then the model."""
    same = lambda kind: lambda t: F.array(span(kind, 0, 17, 0.8, 0))
    load = lambda: lambda w: [("address", w[:17], 0, 17, 0.8)]
    rows = [("c", 0, "user", text("password=hunter22"))]
    assert parts(run(spark, rows, analyzers={"en": same("USERNAME")}, model=load)) == {("c", 0): ["[SECRET_1]"]}
    rows = [("c", 0, "user", text("is what the cat s and"))]
    assert parts(run(spark, rows, analyzers={"en": same("USERNAME")}, model=load)) == {("c", 0): ["[USERNAME_1] and"]}


def test_parts_of_names_are_told_by_the_whole(spark):
    named = lambda t: ner.gazetteer(t, {"Ana Kos": "PERSON", "Kos": "PERSON"})
    made = run(spark, [("c", 0, "user", text("this is from Ana Kos. The Kos"))], analyzers={"en": named})
    assert parts(made) == {("c", 0): ["this is from [PERSON_1]. The [PERSON_1]"]}
    assert [(r.original, r.placeholder) for r in made.detections.collect()] == [("Ana Kos", "[PERSON_1]")]


def test_switched_off_users(spark):
    schema = MESSAGES + ", masking boolean"
    made = run(spark, [("c", 0, "user", text("a@b.com"), False), ("d", 0, "user", text("a@b.com"), True)], schema=schema)
    assert parts(made) == {("c", 0): ["a@b.com"], ("d", 0): ["[EMAIL_1]"]}
    users = spark.createDataFrame([(1, "false"), (1, "true"), (2, "false")], "user_id int, pii_masking_enabled string")
    on = chat.toggled(spark.createDataFrame([(1,), (2,), (3,)], "user_id int"), users).collect()
    assert {r.user_id: r.masking for r in on} == {1: True, 2: False, 3: True} and len(on) == 3


def test_steps_are_evaluated_once(spark):
    """Detections have as many scans in their plan as the masked texts have: one a recognizer, and one for placeholders."""
    from veil.plans.masks import GENERAL

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = engine.detections(docs, GENERAL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= len(GENERAL) + 1


@pytest.mark.parametrize(("text_", "want"), [
    ("EIN 12-3456789", [("US_EIN", 4, 14, 1.0)]), ("at 2001:db8::ff00:42:8329.", [("IP_ADDRESS", 3, 25, 0.6)]), ("1:2:3:4:5:6:7:8", [("IP_ADDRESS", 0, 15, 0.6)]),
    ("12:30:45 and a::b::c", [("IP_ADDRESS", 13, 17, 0.6)]), ("AB 12 34 56 C, AB123456C", [("UK_NINO", 0, 13, 1.0), ("UK_NINO", 15, 24, 1.0)]),
    ("UTR 1234567890", [("UK_UTR", 4, 14, 1.0)]), ("ping ::1 or (::ffff:10.0.0.1)", [("IP_ADDRESS", 5, 8, 0.6), ("IP_ADDRESS", 13, 28, 0.6)]), ("64:ff9b::192.0.2.33", [("IP_ADDRESS", 0, 19, 0.6)]),
    ("std::vector y:::1 x::", []), ("٣٤٥ ١٢٣-٤٥-٦٧٨٩ 😀123-45-6789", [("US_SSN", 17, 28, 1.0)]),
])
def test_detectors(spark, text_, want):
    df = spark.createDataFrame([(1, text_)], "doc_id long, text string")
    got = sorted((r.entity_type, r.start, r.end, r.score) for r in engine.detections(df).collect())
    assert got == want


def test_other_parts_stay(spark):
    got, _, _ = mask(spark, [("c", 0, "user", [("image", "a@b.com"), ("text", "a@b.com"), ("text", " ")])])
    assert got == {("c", 0): ["a@b.com", "[EMAIL_1]", " "]}


@pytest.mark.parametrize(("mode", "want"), [("block", ("blocked", None)), ("passthrough", ("passthrough", "x")), ("other", ("blocked", None))])
def test_degradation(spark, mode, want):
    df = spark.createDataFrame([("x", "y", False)], "was string, parts string, ok boolean")
    row = engine.guarded(df, F.col("ok"), EngineConfig(degradation_mode=mode), "was").first()
    assert (row.status, row.parts) == want


def test_bodies(spark):
    good = {"chat_id": "", "metadata": {"chat_id": "m", "task": "x", "more": 1}, "messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}]}, {"role": "user", "content": '[{"type": "text", "text": "b"}]'}]}
    bodies = [json.dumps(b) for b in (good, {}, {"messages": []}, {"messages": 3})] + ["not json"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = chat.read_bodies(df).collect()
    # A text that looks like a list of parts is a text.
    assert [(r.chat_id, r.task, r.msg_idx, [p.text for p in r.parts]) for r in rows] == [("m", "x", 0, ["hi"]), ("m", "x", 1, ["a", None]), ("m", "x", 2, ['[{"type": "text", "text": "b"}]'])]
    assert sorted(r.body for r in chat.passed(df).collect()) == sorted(bodies[1:])


def test_answers(spark):
    bodies = [
        {"choices": [{"message": {"role": "assistant", "content": "a"}}]},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "b"}]},
        {"choices": [{"delta": "x"}]},
        {"choices": [{"message": {"role": "assistant", "content": None}}]},
        {"messages": [{"role": "user", "content": "q"}]},
    ]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "b string").select(chat.answer(F.from_json("b", chat.BODY)).alias("a"))
    assert [r.a for r in df.collect()] == ["a", "b", None, None, None]


def test_language_of_windows(spark):
    rows = [("My friend is Ivan", 13, 17, "en"), ("Moj kolega is named X", 0, 3, "hr"), ("xyz Ivan", 4, 8, "hr"), ("ČČ the", 0, 2, "hr")]
    df = spark.createDataFrame(rows, "t string, s int, e int, want string")
    got = [r.l for r in df.select(window_language(F.col("t"), F.col("s"), F.col("e")).alias("l")).collect()]
    assert got == [r[3] for r in rows]


def test_windows_cover_every_short_stretch(spark):
    for n in (0, 1, 100, 101, 260):
        rows = spark.createDataFrame([("x" * n,)], "t string").select(ner.windows(F.col("t"), 100, 30).alias("w")).first().w
        ends = [(w.offset, w.offset + len(w.text)) for w in rows]
        assert ends[-1][1] == n and all(any(a <= s and s + 30 <= b for a, b in ends) for s in range(max(0, n - 30)))
    with pytest.raises(ValueError):
        ner.windows(F.col("t"), 10, 10)


def test_model_slot(spark):
    def load():
        def model(window):
            if "BAD" in window:
                raise RuntimeError
            at = window.find("Ana Kos")
            found = [("person", "Ana Kos", at, at + 7, None), ("first name", "Ana", at + 2, at + 5, 0.9), ("thing", "Ana", at, at + 3, 1.0)] if at >= 0 else []
            return [*found, ("city", "Split", 0, 3, 0.2)]

        return model

    docs = spark.createDataFrame([(1, "x" * 80 + " Ana Kos " + "y" * 50), (2, "BAD Ana Kos"), (3, None)], "doc_id long, text string")
    got = ner.model_spans(docs, load, size=100, overlap=30).collect()
    assert [(r.doc_id, [(s.entity_type, s.start, s.end, s.score) for s in r.spans]) for r in got] == [(1, [("PERSON", 81, 88, 0.5)])]


def test_gazetteer(spark):
    df = spark.createDataFrame([("Ana Kos u gradu Split, Splita",)], "t string")
    spans = df.select(ner.gazetteer(F.col("t"), {"Ana Kos": "PERSON", "Ana": "PERSON", "Split": "ADDRESS_CITY"}).alias("s")).first().s
    assert {(s.entity_type, s.start, s.end) for s in spans} == {("PERSON", 0, 7), ("ADDRESS_CITY", 16, 21)}


def test_config():
    assert EngineConfig.from_env({"VEIL_ENABLED": "false", "VEIL_DENY": "a, b", "VEIL_OIB_PHONE_WINDOW": "0"}) == EngineConfig(enabled=False, deny=("a", "b"), oib_phone_window=0)
    for bad in ({"languages": ()}, {"languages": ("fr",)}, {"oib_phone_window": 201}, {"history_messages": 101}):
        with pytest.raises(ValueError):
            EngineConfig(**bad).validate()
