"""Span algebra against short Python models, on random spans, and on the golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from veil.config import DENY, EXACT_DENY, TRAILING, EngineConfig
from veil.functions.scan import running, sums
from veil.operators import engine, masking
from veil.operators import spans as a
from veil.operators.spans import SPANS, merge_analyzers

SCHEMA = f"t string, x {SPANS}"


def run(spark, rows, f):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("out", f(F.col("x"), F.col("t")))
    return [[(s.entity_type, s.start, s.end, s.score) for s in r.out] for r in df.collect()]


def one(spark, text, spans, f):
    return run(spark, [(text, [(k, s, e, sc, i) for i, (k, s, e, sc) in enumerate(spans)])], f)[0]


def cases(n, seed, types=("PERSON", "HR_OIB", "EMAIL_ADDRESS"), text=None):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = text or "".join(rng.choice("ab  ,.\n1-č😀") for _ in range(40))
        spans = [(rng.choice(types), s := rng.randrange(38), s + rng.randrange(0, 12), rng.choice([0.1, 0.5, 0.9]), i) for i in range(rng.randrange(7))]
        out.append((t, spans))
    return out


def model_overlaps(spans):
    out = []
    for k, s, e, sc, _ in sorted((x for x in spans if x[1] < x[2]), key=lambda x: (-x[3], x[0] not in a.CUSTOM_TYPES, x[1], x[4])):
        if all(e <= s2 or e2 <= s for _, s2, e2, _ in out):
            out.append((k, s, e, sc))
    return sorted(out, key=lambda x: x[1])


def model_contained(spans):
    keep = {x for x in spans if not any(y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] and (y[1], y[2]) != (x[1], x[2]) for y in spans)}
    return {(x[0], x[1], x[2]) for x in keep}


def model_adjacent(text, spans, gap=3):
    out = []
    for k, s, e, sc, _ in sorted(spans, key=lambda x: (x[0], x[1], x[4])):
        space = text[out[-1][2] : s] if out else ""
        if out and out[-1][0] == k and s >= out[-1][2] and len(space) <= gap and not space.strip():
            out[-1] = (k, out[-1][1], max(e, out[-1][2]), max(sc, out[-1][3]))
        else:
            out.append((k, s, e, sc))
    return out


def model_cities(text, spans):
    out, cluster, end = [x[:4] for x in spans if x[0] == "PERSON"], [], 0

    def flush():
        if any(c[0] == "ADDRESS" for c in cluster):
            out.append(("ADDRESS", min(c[1] for c in cluster), max(c[2] for c in cluster), max(c[3] for c in cluster)))

    for x in sorted((x for x in spans if x[0] != "PERSON"), key=lambda x: (x[1], x[2], x[4])):
        space = text[end : x[1]]
        if cluster and len(space) <= 12 and all(c in " \t\n\r\f\v,.-0123456789" for c in space):
            cluster.append(x)
            end = max(end, x[2])
        else:
            flush()
            cluster, end = [x], x[2]
    flush()
    return sorted(out)


def test_overlaps_like_the_model(spark):
    rows = cases(200, 1)
    out = a.without_overlaps(spark.createDataFrame(rows, SCHEMA), "x").collect()
    assert [[(s.entity_type, s.start, s.end, s.score) for s in r.x] for r in out] == [model_overlaps(s) for _, s in rows]


def test_containment_like_the_model(spark):
    rows = cases(200, 2)
    got = run(spark, rows, lambda x, t: a.collapse_contained(x))
    assert [{s[:3] for s in r} for r in got] == [model_contained(s) for _, s in rows]


def test_adjacency_like_the_model(spark):
    rows = cases(200, 3)
    assert run(spark, rows, lambda x, t: a.merge_adjacent(x, t)) == [model_adjacent(t, s) for t, s in rows]


def test_cities_like_the_model(spark):
    rows = cases(200, 4, ("PERSON", "ADDRESS", "ADDRESS_CITY"))
    got = run(spark, rows, lambda x, t: a.resolve_cities(x, t))
    assert [sorted(r) for r in got] == [model_cities(t, s) for t, s in rows]


@pytest.mark.parametrize(
    ("text", "spans", "want"),
    [
        ("Vukovarska 23, 10000 Zagreb", [("ADDRESS", 0, 13), ("ADDRESS", 15, 20), ("ADDRESS_CITY", 21, 27)], [("ADDRESS", 0, 27)]),
        ("Ilica 5, Zagreb", [("ADDRESS", 0, 7), ("ADDRESS_CITY", 9, 15)], [("ADDRESS", 0, 15)]),
        ("12 Main Street, Thurles, Co. Tipperary", [("ADDRESS", 0, 14), ("ADDRESS_CITY", 16, 23), ("ADDRESS_CITY", 25, 38)], [("ADDRESS", 0, 38)]),
        ("12 Main Street, Thurles, Co. Tipperary", [("ADDRESS", 0, 14), ("ADDRESS_CITY", 16, 23), ("ADDRESS_CITY", 29, 38)], [("ADDRESS", 0, 23)]),
        ("Zagreb, Split", [("ADDRESS_CITY", 0, 6), ("ADDRESS_CITY", 8, 13)], []),
        ("Ivan Horvat, Zagreb", [("PERSON", 0, 11), ("ADDRESS_CITY", 13, 19)], [("PERSON", 0, 11)]),
    ],
)
def test_address_cities(spark, text, spans, want):
    got = one(spark, text, [(*s, 0.8) for s in spans], lambda x, t: a.resolve_cities(x, t))
    assert [g[:3] for g in got] == want


def accepted(spark, text, *spans):
    rows = spark.createDataFrame([(text, [(k, s, e, 0.8, i) for i, (k, s, e) in enumerate(spans)])], SCHEMA)
    out = a.select(rows, "out", F.col("x"), F.col("t"), EngineConfig()).first().out
    return [text[s.start : s.end] for s in out]


def test_deny_lists(spark):
    assert (len(DENY), len(EXACT_DENY), len(TRAILING)) == (73, 15, 37)
    assert accepted(spark, "Task", ("PERSON", 0, 4)) == []
    assert accepted(spark, "Task Manager John", ("PERSON", 0, 17)) == []
    assert accepted(spark, "tasksmith", ("PERSON", 0, 9)) == ["tasksmith"]
    assert accepted(spark, "Claude", ("PERSON", 0, 6)) == []
    assert accepted(spark, "Claude Monet", ("PERSON", 0, 12)) == ["Claude Monet"]


def test_trailing_tokens(spark):
    assert accepted(spark, "Ivan Horvat has doktor", ("PERSON", 0, 15)) == ["Ivan Horvat"]
    assert accepted(spark, "Ivan Horvat.", ("PERSON", 0, 12)) == ["Ivan Horvat"]
    assert accepted(spark, "has", ("PERSON", 0, 3)) == []


@pytest.mark.parametrize("before", ["phone: ", "mob: ", "mobitel: ", "telefon: ", "+1 "])
def test_telephone_is_no_oib(spark, before):
    assert accepted(spark, before + "15551234567", ("HR_OIB", len(before), len(before) + 11)) == []


def test_oib_word_overrides(spark):
    assert accepted(spark, "Moj OIB je 15551234567", ("HR_OIB", 11, 22)) == ["15551234567"]


def test_placeholders_are_left_alone(spark):
    assert accepted(spark, "[PERSON_1] and Jimmy Page", ("PERSON", 1, 7), ("PERSON", 15, 25)) == ["Jimmy Page"]
    assert accepted(spark, "[PERSON_1] and Jimmy Page", ("PERSON", 0, 14)) == []


def names(spark, text, *spans):
    rows = spark.createDataFrame([(text, [("PERSON", s, e, 0.8, i) for i, (s, e) in enumerate(spans)])], SCHEMA)
    return rows.select(a.same_persons(F.col("x"), F.col("t")).alias("n")).first().n


def test_coreference(spark):
    assert names(spark, "recipient Ivana Lukić. LUKIĆ works", (10, 21), (23, 28)) == [None, "Ivana Lukić"]
    assert names(spark, "Ana Kos, Iva Kos, Kos", (0, 7), (9, 16), (18, 21)) == [None, None, None]
    assert names(spark, "Ana Kos, Ana", (0, 7), (9, 12)) == [None, None]


def test_masking_numbers_by_first_occurrence(spark):
    text = "Ana x Iva x Ana x Kos"
    rows = spark.createDataFrame([(text, [("PERSON", 0, 3, 0.8, 0), ("PERSON", 6, 9, 0.8, 1), ("PERSON", 12, 15, 0.8, 2), ("EMAIL_ADDRESS", 18, 21, 0.8, 3)])], SCHEMA)
    entries = F.col("e")
    out = masking.number(rows, "e", "x", F.col("t")).select(masking.splice(F.col("t"), entries).alias("m"), masking.forward_map(entries).alias("f")).first()
    assert out.m == "[PERSON_1] x [PERSON_2] x [PERSON_1] x [EMAIL_1]"
    assert out.f == {"Ana": "[PERSON_1]", "Iva": "[PERSON_2]", "Kos": "[EMAIL_1]"}


def test_texts_with_very_many_spans(spark):
    """Selection, numbering and splicing of 20,000 spans in one text, some of which overlap, against a plain loop."""
    words = [f"u{k % 700}@x.org" if k % 3 else f"{k % 256}.1.2.3" for k in range(20_000)]
    text, want, numbers, at = " ".join(words), [], {}, 0
    for w in words:
        kind = "EMAIL" if "@" in w else "IP_ADDRESS"
        names = numbers.setdefault(kind, {})
        want.append((kind, at, at + len(w), f"[{kind}_{names.setdefault(w, len(names) + 1)}]"))
        at += len(w) + 1
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in engine.mask_documents(docs).collect()}
    assert [(e.entity_type, e.start, e.end, e.placeholder) for e in got[1].entries] == want
    assert got[1].masked_text == " ".join(w[3] for w in want) and got[2].masked_text is None and got[3].masked_text == ""


def test_running_is_a_prefix_scan(spark):
    df = spark.createDataFrame([([5, 1, 2] * n,) for n in range(6)] + [(None,)], "v array<int>")
    got = df.select("v", running(F.col("v"), lambda a, b: a + b, "array<int>").alias("s"), sums(F.col("v")).alias("b")).collect()
    for r in got[:-1]:
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))] and r.b == [sum(r.v[:i]) for i in range(len(r.v))]
    assert got[-1].s is None


def test_union_of_analyzers_keeps_places_and_best_scores(spark):
    """Like a loop that swaps a span for an equal one of a better score, where it stands."""
    rng = random.Random(8)
    for _ in range(5):
        make = lambda: [(rng.choice(["EMAIL", "SECRET"]), a := rng.randint(0, 6), a + rng.randint(1, 2), rng.choice([0.5, 0.7, 0.9]), 0) for _ in range(rng.randint(0, 9))]
        one, two = make(), make()
        want = []
        for s in one + two:
            k = next((i for i, w in enumerate(want) if w[:3] == s[:3]), None)
            if k is None:
                want.append(s)
            elif want[k][3] < s[3]:
                want[k] = s
        df = spark.createDataFrame([(one, two)], f"a {SPANS}, b {SPANS}")
        got = df.select(merge_analyzers(F.col("a"), F.col("b"), F.lit("x" * 20), 100).alias("m")).first().m
        assert [tuple(s) for s in got.spans] == [(*w[:4], 100 + i) for i, w in enumerate(want)] and got.dropped == 0
