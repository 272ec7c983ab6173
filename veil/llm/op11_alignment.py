"""Alignment of two tokenizers: token ends merged along merge-path diagonals, groups between common ends, linked id pairs counted."""

import functools
import hashlib
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.arrow import blocks
from veil.llm.bytebpe import encoder
from veil.llm.op6_tokens import byte_alphabet
from veil.sources import materialize, read_table, ship

FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")
#: Ends that one piece of a merge takes.
WORK = 1 << 15
#: Links that are written out at once; a group with more is counted by its distinct ids.
LINKS = 1 << 20
#: Id pairs whose counts each worker has in a table; all others are joined.
MOST_PAIRS = 1 << 20
#: Bytes of text in one piece of work of a task, and distinct pairs that a task holds before it sends their counts.
STEP, HOLD = 1 << 21, 2_000_000


@functools.cache
def first_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    spec = json.load(open(path, encoding="utf-8"))
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = spec["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


@functools.cache
def second(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The processor, and the bytes of each of its ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = ((model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size()))
    return model, [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted arrays crosses every ``work``-th diagonal: how many of ``a`` and of ``b`` come before.

    Of equal values that of ``a`` comes first. All diagonals are searched at once, by halving.
    """
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = np.zeros(len(d), bool)
        before[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low, d - low


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values that both have; both are sorted and without repeats.

    The merge is divided into pieces of ``work`` values, each of which needs no other. A value whose two
    places fall to two pieces is the last of ``a`` in one and the first of ``b`` in the next: these are put in where pieces meet.
    """
    i, j = diagonals(a, b, work)
    found = []
    for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:], strict=False):
        own, other = a[i0:i1], b[j0:j1]
        if len(own) and len(other):
            at = np.minimum(np.searchsorted(other, own), len(other) - 1)
            same = np.flatnonzero(other[at] == own)
            found.append((i0 + same, j0 + at[same]))
        if i1 and j1 < len(b) and a[i1 - 1] == b[j1]:
            found.append((np.array([i1 - 1]), np.array([j1])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


class Aligned:
    """Tokens of some texts by both tokenizers: ids, the number of each text's tokens, and the groups' last tokens."""

    def __init__(self, texts: list[str | None], one: str, two: str):
        model, b_bytes = second(two)
        a_bytes = first_bytes(one)
        texts = [t or "" for t in texts]
        spaced = [f" {t}" if t else "" for t in texts]
        a, self.n_a = encoder(one, False).encode(spaced)
        lists = model.encode(texts, num_threads=1)
        self.n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter((i for x in lists for i in x), np.int64, int(self.n_b.sum()))
        a = a.astype(np.int64)
        odd = set()
        for ids, n, table in ((a, self.n_a, a_bytes), (b, self.n_b, b_bytes)):
            upto = np.r_[0, np.cumsum(n)]
            for k, text in enumerate(spaced):
                if b"".join(map(table.__getitem__, ids[upto[k] : upto[k + 1]].tolist())) != text.encode():
                    odd.add(k)
        if odd:
            keep = np.ones(len(texts), bool)
            keep[list(odd)] = False
            a, b = a[np.repeat(keep, self.n_a)], b[np.repeat(keep, self.n_b)]
            self.n_a, self.n_b = self.n_a * keep, self.n_b * keep
        self.a, self.b = a, b
        ends = (np.cumsum(np.array(list(map(len, table)), np.int64)[ids]) for ids, table in ((a, a_bytes), (b, b_bytes)))
        self.a_last, self.b_last = common_ends(*ends)
        self.upto_a, self.upto_b = np.r_[0, np.cumsum(self.n_a)], np.r_[0, np.cumsum(self.n_b)]
        self.in_a, self.in_b = np.diff(np.r_[-1, self.a_last]), np.diff(np.r_[-1, self.b_last])  # tokens of each group
        self.text = np.searchsorted(self.upto_a, self.a_last, "right") - 1  # of each group

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text, empty for a text without tokens."""
        n = len(self.a) + len(self.b)
        ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        group_a, group_b = np.repeat(np.arange(len(self.in_a)), self.in_a), np.repeat(np.arange(len(self.in_b)), self.in_b)
        before_b, upto_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        ids[np.arange(len(self.a)) + before_b[group_a]] = self.a
        ids[np.arange(len(self.b)) + upto_a[group_b]] = self.b
        mark[self.a_last + before_b] = ord("|")
        mark[self.b_last + upto_a] = ord(";")
        digits = decimals(max(1, len(str(int(ids.max(initial=0))))))
        shown = digits[ids]
        shown[:, -1] = mark
        written = shown != 0
        raw = shown[written].tobytes()
        upto = np.r_[0, np.cumsum(written.sum(axis=1))][self.upto_a + self.upto_b].tolist()
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(upto, upto[1:], strict=False)]

    def links(self, width: int):
        """Yield (text, id pair as a * width + b, times) of all links, in bounded pieces; a pair may come again."""
        first_a, first_b = self.a_last - self.in_a + 1, self.b_last - self.in_b + 1
        size = self.in_a * self.in_b
        large = size > LINKS
        small = np.flatnonzero(~large)
        cuts = np.searchsorted(np.cumsum(size[small]), np.arange(LINKS, int(size[small].sum()) + LINKS, LINKS))
        for g in np.split(small, np.unique(cuts)):
            n = size[g]
            own = np.repeat(g, n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pair = self.a[first_a[own] + k // self.in_b[own]] * width + self.b[first_b[own] + k % self.in_b[own]]
            yield self.text[own], pair, np.ones(len(pair), np.int64)
        for g in np.flatnonzero(large).tolist():
            a, times_a = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            step = max(1, LINKS // len(b))
            for k in range(0, len(a), step):
                pair = (a[k : k + step, None] * width + b).ravel()
                yield np.full(len(pair), self.text[g]), pair, (times_a[k : k + step, None] * times_b).ravel()

    def distinct(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair and number of links of each pair of each text, in order."""
        parts = [(t * (1 << 40) + p, n) for t, p, n in self.links(width)]
        key, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, inverse = np.unique(key, return_inverse=True)
        return key >> 40, key & ((1 << 40) - 1), np.bincount(inverse, times, len(key)).astype(np.int64)


@functools.cache
def decimals(width: int) -> np.ndarray:
    """The digits of all numbers of up to ``width`` digits as bytes, zeros before them, and a zero for a mark after them."""
    n = np.arange(10**width)
    out = np.zeros((len(n), width + 1), np.uint8)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        out[:, k] = np.where((n >= power) | (power == 1), n // power % 10 + 48, 0)
    return out


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one: str = FIRST, two: str = SECOND) -> DataFrame:
    """A row for each document: ``uid`` (its own number), ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and its
    id pairs: ``pairs`` and ``times`` are arrays of unsigned 32-bit numbers as bytes, a pair being a * (ids of B) + b.
    """
    width = len(second(two)[1])
    if len(first_bytes(one)) * width >= 1 << 32:
        raise ValueError("the product of the vocabularies' sizes must be under 2**32")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    whole = F.lit(0).cast("long")
    empty = F.lit(None).cast("binary")
    schema = source.select(whole.alias("uid"), "doc_id", *(whole.alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.lit("").alias("groups_sha256"), empty.alias("pairs"), empty.alias("times")).schema

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, STEP):
            n = batch.num_rows
            x = Aligned(batch.column(1).to_pylist(), one, two)
            groups = np.bincount(x.text, minlength=n)
            links = np.bincount(x.text, x.in_a * x.in_b, n).astype(np.int64)
            text, pair, times = x.distinct(width)
            bounds = np.searchsorted(text, np.arange(n + 1)).tolist()
            slices = list(zip(bounds, bounds[1:], strict=False))
            raw = [[v[a:b].astype("<u4").tobytes() for a, b in slices] for v in (pair, times)]
            numbers = [pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, groups, links)]
            yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(n)), batch.column(0), *numbers, pa.array(x.digests()), *(pa.array(r, pa.binary()) for r in raw)], names=schema.names)
            uid += n

    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: in how many documents of ``aligned`` a pair is linked, and whether no pair of its A id is in more."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def emit():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(pair), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + (1 << 17)].astype(np.int64)), pa.array(n[at : at + (1 << 17)])], names=["pair", "n"])

        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"))
            size += len(held[-1])
            if size > HOLD:
                yield from emit()
                size = 0
        if held:
            yield from emit()

    counts = materialize(rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    one = F.expr(f"pair div {width}").alias("a")
    most = counts.groupBy(one).agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.withColumn("a", one).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _at_least(counts: DataFrame, most: int) -> int:
    """The least power of two such that ``most`` pairs at most are in as many documents."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # 63 rows at most
    total = 0
    for k, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        total += n
        if total > most:
            return 1 << (k + 1)
    return 1


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one: str = FIRST, two: str = SECOND, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Tokens of both tokenizers are grouped between the byte offsets where tokens of both end; links join all
    tokens of a group. ``count_sum`` adds up, over a document's links, the number of documents with the
    link's id pair; ``n_best`` counts links whose pair is in as many documents as any pair of its A id. Counts of the
    most frequent pairs (``most_pairs`` at most) are a table in each worker, all others are joined, so the bound changes no
    result. A text that is null or empty, or that either tokenizer does not give back byte for byte, has zeros and an
    empty digest. Repeated rows are documents of their own; other columns are not looked at; an empty table gives an
    empty result.
    """
    spark = ship(docs.sparkSession)
    rows = materialize(aligned(docs, id_col, text_col, one, two))
    counts = materialize(pair_counts(rows, len(second(two)[1])))
    top = counts.where(F.col("n") >= _at_least(counts, most_pairs)).sort("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(top.column(k).to_numpy() for k in range(3)))

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            uids = batch.column(0).to_numpy()
            own, times = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").astype(np.int64) for k in (1, 2))
            row = np.repeat(np.arange(len(uids)), [len(x) // 4 for x in batch.column(1).to_pylist()])
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            add = lambda v: np.bincount(row[hit], v, len(uids)).astype(np.int64)  # noqa: E731, B023
            sums = add(times[hit] * n[at[hit]]), add(times[hit] * best[at[hit]])
            yield pa.RecordBatch.from_arrays([pa.array(uids), pa.nulls(len(uids), pa.int64()), pa.nulls(len(uids), pa.int64()), *map(pa.array, sums)], names=["uid", "pair", "times", "s", "b"])
            far = ~hit
            none = pa.nulls(int(far.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(uids[row[far]]), pa.array(own[far]), pa.array(times[far]), none, none], names=["uid", "pair", "times", "s", "b"])

    summed = materialize(rows.select("uid", "pairs", "times").mapInArrow(run, "uid long, pair long, times long, s long, b long"))
    rare = summed.where("pair is not null").select("uid", "pair", "times").join(counts, "pair")
    rare = rare.select("uid", (F.col("times") * F.col("n")).alias("s"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("b"))
    total = summed.where("pair is null").select("uid", "s", "b").unionByName(rare).groupBy("uid").agg(F.sum("s").alias("count_sum"), F.sum("b").alias("n_best"))
    return rows.drop("pairs", "times").join(total, "uid").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_alignment": op11_alignment}
#: Tokenizers are not in SQL; tests hold the result against brute force over the libraries' own tokens.
ORACLE_SQL: dict[str, str] = {}
