"""Alignment, phrases and packing against brute force, with odd rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.test_queries import rows
from veil.llm import bytebpe, op11_alignment, op12_phrases, op13_packing
from veil.llm.op6_tokens import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  two  spaces \n\n", "▁ mark", "<|endoftext|> in <s> text", "naïve — 😀 \x00 中文", "it's we'll 'tis", "x" * 5000, "la la " * 4000, "la la " * 4000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, null ids and columns whose names clash with the operators' own."""
    data = [(k, t, "en" if k % 2 else None, k, "x") for k, t in enumerate(ODD)] + [(None, "null id", "en", 0, "x"), (3, "a", "en", 3, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n long, pair string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def texts_of(spark, sf="sf0.001"):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()]


# Pre-tokens and ids


def test_pieces_like_the_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choice(" '\n\tabstrevmlld12!?.,éñ²½ 　中😀ʼ\r") for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    points, ends = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([len(t) for t in texts])
    want = [int(end) - len(t) + m.start() for t, end in zip(texts, ends, strict=True) for m in regex.finditer(bytebpe.PATTERN, t)]
    assert bytebpe.pieces(points, ends).tolist() == want


@pytest.mark.parametrize("special", [True, False])
def test_ids_like_the_library(spark, special):
    texts = [t for t in ODD if t is not None] + [t for _, t in texts_of(spark) if t]
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = not special
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, counts = bytebpe.Encoder(A, special).encode(texts)
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert bytebpe.Encoder(A).encode([])[0].tolist() == []


# 11


def test_diagonals_cut_a_merge_into_equal_pieces():
    rng = np.random.default_rng(3)
    for work in (1, 2, 7, 64):
        a, b = (np.unique(rng.integers(0, 500, rng.integers(0, 300))) for _ in range(2))
        i, j = op11_alignment.diagonals(a, b, work)
        assert set(np.diff(i + j)[:-1].tolist()) <= {work} and i[-1] == len(a) and j[-1] == len(b)
        at_a, at_b = op11_alignment.common_ends(a, b, work)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def brute_alignment(docs):
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    token = {i: bytes(byte[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items() if all(c in byte for c in t)}

    def ends(pieces):
        out, at = [], 0
        for p in pieces:
            at += len(p)
            out.append(at)
        return out

    found = []
    for _, text in docs:
        groups = []
        if text:
            a, b = one.encode(f" {text}", add_special_tokens=False).ids, two.encode(text)
            pa_ = [token[i] for i in a]
            pb = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(pa_) == b"".join(pb) == f" {text}".encode():
                ea, eb = ends(pa_), ends(pb)
                i = j = 0
                for end in sorted(set(ea) & set(eb)):
                    k, m = ea.index(end, i) + 1, eb.index(end, j) + 1
                    groups.append((a[i:k], b[j:m]))
                    i, j = k, m
        found.append(groups)
    holds = Counter(pair for groups in found for pair in {(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    for (doc_id, _), groups in zip(docs, found, strict=True):
        links = [holds[x, y] == best[x] for a, b in groups for x in a for y in b]
        total = sum(holds[x, y] for a, b in groups for x in a for y in b)
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        yield doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(links), total, digest


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [op11_alignment.MOST_PAIRS, 300])
def test_alignment_like_brute_force(spark, odd, most):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = op11_alignment.alignment(odd, most_pairs=most)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(brute_alignment(docs))


def test_alignment_query_like_brute_force(spark, monkeypatch):
    """The registered query on whole tables, with large groups counted by their distinct ids."""
    monkeypatch.setattr(op11_alignment, "LINKS", 50)
    got = op11_alignment.op11_alignment(spark, f"{DATA}/sf0.001").select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == Counter(brute_alignment(texts_of(spark)))


def test_links_of_large_groups(monkeypatch):
    x = op11_alignment.Aligned(["abc " * 50, "x" * 3000, None], A, B)
    whole = [c.tolist() for c in x.distinct(32000)]
    monkeypatch.setattr(op11_alignment, "LINKS", 3)
    assert [c.tolist() for c in x.distinct(32000)] == whole


def test_alignment_of_nothing(none):
    assert op11_alignment.alignment(none).collect() == []


# 12


def brute_phrases(docs, least=10, most=3, inside=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    frequent = {k: v for k, v in f.items() if v >= least and len(k) > 2}
    around = defaultdict(int)
    for (lang, *w), a in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, *w[i : i + k]] = max(around[lang, *w[i : i + k]], a)
    for (lang, *w), a in frequent.items():
        score, _, left, right = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        if 100 * around[lang, *w] < inside * a:
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


@pytest.mark.parametrize(("least", "most", "capacity"), [(10, 3, op12_phrases.CAPACITY), (2, 4, 64)])
def test_phrases_like_brute_force(spark, odd, least, most, capacity):
    rng = random.Random(2)
    words = ["the", "The", "of", "naïve", "中", "a'b", "-", "x\x00y"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(40)), rng.choice(["en", "de", None, "und"])) for _ in range(80)]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(docs)], "doc_id long, text string, lang string")
    df = df.unionByName(odd.select("doc_id", "text", "lang")).withColumn("phrase", F.lit(1)).withColumn("size", F.lit(1))
    docs += [(r.text, r.lang) for r in odd.collect()]
    got = op12_phrases.collocations(df, least=least, most_words=most, capacity=capacity, top=30)
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(docs, least, most, top=30))


def test_phrases_equal_their_sql(spark):
    import duckdb

    df = op12_phrases.op12_phrases(spark, f"{DATA}/sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.01/documents.parquet'")
    result = con.execute(op12_phrases.SQL)
    columns = [c[0] for c in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_phrases_of_nothing(none):
    assert op12_phrases.collocations(none).collect() == []


def test_summaries_lose_nothing_frequent_in_any_order():
    """Mergeable: whatever the parts and their order, an item over mass / (capacity + 1) survives and no count is off by more than ``lost``."""
    rng = np.random.default_rng(7)
    for trial in range(30):
        items = np.concatenate([rng.integers(0, 5000, 3000), np.repeat(rng.integers(0, 50, 12), rng.integers(1, 90, 12))]).astype(np.uint32)
        rng.shuffle(items)
        least = 10
        s = op12_phrases.Summary(len(items) // least)
        for part in np.array_split(items, 1 + trial):
            s.add(*np.unique(part, return_counts=True))
            s.settle()
        true = Counter(items.tolist())
        kept = set(s.survivors(least).tolist())
        assert {k for k, n in true.items() if n >= least} <= kept and s.lost < least
        assert all(true[k] - s.lost <= n <= true[k] for k, n in zip(s.keys.tolist(), s.counts.tolist(), strict=True))


# 13


def check_packing(got, docs, size):
    """Pieces have the library's ids, sequences have no gaps and no more than ``size`` ids; returns how many, and their bound."""
    library = Tokenizer.from_file(A)
    want, total = Counter(), 0
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        head = len(ids) if len(ids) <= size else (len(ids) - 1) % size + 1
        cuts = [0, *range(head, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
    return len(places), -(-total // size)


def test_packing_of_odd_rows(odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = op13_packing.pack(odd, size=64).collect()
    n, bound = check_packing(got, docs, 64)
    assert n <= bound + 1
    parts = op13_packing.sequences(odd, size=64).collect()
    assert all(len(r.ids) == sum(p.length for p in r.parts) <= 64 for r in parts)
    ids = {(p.doc_id, p.piece, p.start, zlib.crc32(np.array(r.ids[p.offset : p.offset + p.length], "<u4").tobytes())) for r in parts for p in r.parts}
    assert ids == {(r.doc_id, r.piece, r.start, r.ids_crc32) for r in got}


def test_packing_query_meets_its_bound(spark):
    """All documents: as few sequences as the ids fill, or one more; a twentieth more on islands of 16 pieces."""
    got = op13_packing.op13_packing(spark, f"{DATA}/sf0.001").collect()
    n, bound = check_packing(got, texts_of(spark), op13_packing.SIZE)
    assert n <= bound + 1
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    n, bound = check_packing(op13_packing.pack(docs, island=16).collect(), texts_of(spark), op13_packing.SIZE)
    assert n <= 1.06 * bound


def test_islands_are_better_than_best_fit():
    """No child loses a piece, and rounds never get worse than best fit of descending lengths."""
    rng = random.Random(4)
    for low, high in ((1, 100), (20, 60), (34, 50)):
        lengths = [rng.randint(low, high) for _ in range(300)]
        packings = op13_packing.founded(lengths, 100, rng)
        first, migrants = len(op13_packing.best_fit([], sorted(lengths, reverse=True), 100)), [[50, 50], [7, 93], [100]]
        for _ in range(3):
            packings = op13_packing.evolved(packings, migrants, 100, rng)
            for p in packings:
                assert sorted(n for b in p for n in b) == sorted(lengths) and max(map(sum, p)) <= 100
        assert len(packings[0]) <= first


def test_packing_of_nothing(none):
    assert op13_packing.pack(none).collect() == [] and op13_packing.sequences(none).collect() == []
