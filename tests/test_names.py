"""Listed names against a scan of every text from the left."""

import random
import re

from veil.operators.names import listed_spans


def by_hand(text, names):
    words, out, i = list(re.finditer(r"\w+", text)), [], 0
    space = lambda t: re.sub(r"\s+", " ", t)
    while i < len(words):
        fits = [(j, names[space(text[words[i].start() : words[j].end()])]) for j in range(i, min(i + 6, len(words))) if space(text[words[i].start() : words[j].end()]) in names]
        if fits:
            j, kind = fits[-1]
            out.append((kind, words[i].start(), words[j].end()))
            i = j
        i += 1
    return out


def spans(rows):
    return {r.doc_id: [(s.entity_type, s.start, s.end) for s in r.spans] for r in rows.collect()}


def table(spark, names):
    return spark.createDataFrame(list(names.items()), "name string, entity_type string")


def test_equal_to_a_scan_by_hand(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ana", "kos", "ivo", "šime", "x", "de", "É1"])
    names = {" ".join(word() for _ in range(rng.randint(1, 4))): rng.choice(["PERSON", "USERNAME"]) for _ in range(60)} | {"de-ana": "ADDRESS", "x, x": "ADDRESS"}
    texts = ["".join(word() + rng.choice([" ", " ", "  ", "\n", "-", ", ", ". "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    got = spans(listed_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table(spark, names)))
    want = {i: by_hand(t, names) for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w} and sum(map(len, got.values())) > 500


def test_odd_rows(spark):
    names = spark.createDataFrame([("  Ana  Kos! ", "PERSON"), ("Ana Kos", "ADDRESS"), (None, "PERSON"), ("--", "PERSON"), ("Eva", None), ("", "PERSON")], "name string, entity_type string")
    rows = [(1, "Ana\tKos", "n"), (1, "Ana\tKos", "n"), (2, None, "n"), (3, "", "n"), (4, "Anas Kos Eva", "n"), (5, "x Ana Kos", "n"), (5, "Ana Kos", "n"), (None, "😀 Ana Kos.", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    assert spans(listed_spans(docs, names)) == {1: [("ADDRESS", 0, 7)], 5: [("ADDRESS", 0, 7), ("ADDRESS", 2, 9)], None: [("ADDRESS", 2, 9)]}
    assert listed_spans(docs, names.limit(0)).columns == ["doc_id", "spans"] and listed_spans(docs, names.limit(0)).count() == 0
    assert listed_spans(docs.limit(0), names).count() == 0


def test_long_texts_and_many_names(spark):
    text = " ".join(f"w{i % 997}" for i in range(20_000))
    names = {f"w{i} w{i + 1}": "PERSON" for i in range(0, 900, 3)} | {f"made {i}": "PERSON" for i in range(20_000)}
    got = spans(listed_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), table(spark, names)))
    assert got[1] == by_hand(text, names)


def test_no_shuffle_of_texts_and_no_python(spark):
    docs = spark.createDataFrame([(1, "Ana Kos")], "doc_id long, text string")
    plan = listed_spans(docs, table(spark, {"Ana": "PERSON"}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_names_beyond_what_is_broadcast(spark, monkeypatch):
    """The same spans whether hashes of names are sent or shuffled; letters beyond 16 bits, a name of very many words, gaps at both ends."""
    long = " ".join(f"w{i % 7}" for i in range(300))
    names = {"𝒜na Kos": "PERSON", "Kos": "USERNAME", long: "ADDRESS"}
    texts = ["?! 𝒜na \n Kos, Kos 𝒜na😀", f"  x {long} w6 w0", "𝒜𝒜na Kos-", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {0: [("PERSON", 3, 12), ("USERNAME", 14, 17)], 1: [("ADDRESS", 4, 4 + len(long))], 2: [("USERNAME", 5, 8)]}
    assert spans(listed_spans(docs, table(spark, names))) == want
    plan = listed_spans(docs, table(spark, names))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "LeftSemi" in plan
    monkeypatch.setattr("veil.operators.names.HASHES", 2)
    assert spans(listed_spans(docs, table(spark, names))) == want
