"""Language-model scores by prediction by partial matching: a byte-context trie with escapes and exclusion."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.arrow import blocks
from veil.sources import drop_table, materialize, read_table, ship

#: Longest context in bytes.
ORDER = 5
#: Codes (context and symbol) whose log probabilities every worker holds; all others are joined.
MOST_CODES = 1 << 20
#: Nodes of the lowest levels of the trie that every part of it has too. Two levels have 2**16 + 2**8 at most.
MOST_SHARED = 1 << 17
#: Words whose counts every worker holds; all others are joined.
MOST_WORDS = 1 << 18
#: The end of a text as a token and as a byte: no word can hold a line feed.
END = b"\n"
#: Additive smoothing of the base score.
ALPHA = 0.1
#: Distinct words that a task holds before it passes on their counts.
HOLD = 400_000
#: Distinct codes that a task holds before it passes on their counts.
HOLD_CODES = 2_000_000
#: Codes of which a task makes one part of the trie at least, if it has so many.
PART = 1 << 20
#: Bytes of text that a task works on at once; longer texts are worked on in pieces.
STEP = 1 << 21
NOTHING = np.zeros(0, np.int64)
LOW = (1 << 56) - 1
#: Marks a code of a text outside the training texts.
OUTSIDE = 1 << 48


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, and the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def grams(docs: list[list[bytes]], order: int = ORDER):
    """Yield packed context and symbol, and document number, of all symbols, a bounded piece at a time.

    The bytes of a document are its words with a space between and the end after the last. Line feeds
    stand before the first byte, so that every symbol has a context of ``order`` bytes.
    """
    pad = END * order
    stream = np.frombuffer(b"".join(pad + b" ".join(d[:-1]) + END for d in docs), np.uint8)
    sizes = np.array([sum(map(len, d[:-1])) + max(0, len(d) - 2) + 1 + order for d in docs], np.int64)
    ends = np.cumsum(sizes)
    for at in range(0, len(stream), STEP):
        low = max(0, at - order)
        piece = stream[low : at + STEP].astype(np.int64)
        code = piece.copy()
        for back in range(1, order + 1):
            code[back:] |= piece[:-back] << (8 * back)
        place = np.arange(at, at + len(piece) - (at - low))
        owner = np.searchsorted(ends, place, "right")
        symbol = place - (ends - sizes)[owner] >= order
        yield code[at - low :][symbol], owner[symbol]


def cut(code: np.ndarray, order: int) -> np.ndarray:
    """Node keys: the last ``order`` bytes of context and the symbol, with the order on top."""
    return (code & ((1 << (8 * order + 8)) - 1)) | (order << 56)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return NOTHING, NOTHING
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Trie:
    """Counts of (context, symbol) nodes and what follows from them: totals, distinct symbols, exclusions."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        at = np.argsort(keys)
        self.keys, self.counts = keys[at].astype(np.int64), counts[at].astype(float)
        levels = self.keys >> 56
        parents = (levels << 56) | ((self.keys & LOW) >> 8)
        self.contexts, first = np.unique(parents, return_index=True)
        number = np.searchsorted(self.contexts, parents)
        n = len(self.contexts)
        self.total, self.kinds = np.bincount(number, self.counts, n), np.bincount(number, minlength=n).astype(float)
        # What a context leaves of the next shorter one, once the symbols it has seen itself are excluded.
        self.rest_total, self.rest_kinds = np.zeros(n), np.zeros(n)
        up = levels > 0
        lower = cut(self.keys[up] & LOW, 0)
        for o in range(1, order + 1):
            here = levels[up] == o
            lower[here] = cut(self.keys[up][here] & LOW, o - 1)
        place = np.minimum(np.searchsorted(self.keys, lower), max(0, len(self.keys) - 1))
        seen = np.where(self.keys[place] == lower, self.counts[place], 0) if len(lower) else np.zeros(0)
        taken = np.bincount(number[up], seen, n)
        level = self.contexts >> 56
        suffix = np.zeros(n, np.int64)
        for o in range(1, order + 1):
            here = level == o
            suffix[here] = (self.contexts[here] & ((1 << (8 * (o - 1))) - 1)) | ((o - 1) << 56)
        deep = level > 0
        below = np.searchsorted(self.contexts, suffix[deep])
        self.rest_total[deep] = self.total[below] - taken[deep]
        self.rest_kinds[deep] = self.kinds[below] - self.kinds[deep]
        flat = level == 0
        self.rest_kinds[flat] = 256 - self.kinds[flat]

    def symbols(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context, by escape method D with exclusion."""
        out = np.zeros(len(code))
        total, kinds = np.zeros(len(code)), np.zeros(len(code))
        entered, live = np.zeros(len(code), bool), np.arange(len(code))
        for o in range(self.order, -1, -1):
            node = cut(code[live], o)
            c, known = find(self.contexts, (o << 56) | ((node & LOW) >> 8))
            skipped, live, node, c = live[~known], live[known], node[known], c[known]
            # The first context found has all its symbols; a later one lacks those excluded above it.
            fresh = ~entered[live]
            total[live[fresh]], kinds[live[fresh]] = self.total[c[fresh]], self.kinds[c[fresh]]
            entered[live] = True
            k, hit = find(self.keys, node)
            miss, mass = ~hit, 2 * total[live]
            out[live[hit]] += np.log10((2 * self.counts[k[hit]] - 1) / mass[hit])
            escapes = miss & (kinds[live] > 0)
            out[live[escapes]] += np.log10(kinds[live[escapes]] / mass[escapes])
            total[live[miss]], kinds[live[miss]] = self.rest_total[c[miss]], self.rest_kinds[c[miss]]
            live = np.concatenate([skipped, live[miss]])
        out[live] -= np.log10(np.where(entered[live], np.maximum(kinds[live], 1), 256))
        return out


def _held(id_col: str, folds: int):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(folds)) == 0


def vocabulary(texts: DataFrame) -> DataFrame:
    """Every token of column ``text`` with its count ``c``; tasks count before anything is shuffled."""

    def run(batches):
        count: Counter = Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])
            count.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(tokens(text))
            if len(count) > HOLD:
                yield emit()
        yield emit()

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _at_least(counts: DataFrame, column: str, most: int) -> int:
    """Smallest power of two that at most ``most`` rows reach."""
    sizes = counts.where(F.col(column) > 0).groupBy(F.floor(F.log2(column)).alias("k")).count().collect()
    left, least = 0, 62
    for k, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        left += n
        if left > most:
            break
        least = k
    return 1 << max(0, least)


def code_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Every code of column ``text`` with its count ``n`` in rows that are not ``held`` and ``m`` in all rows."""

    def run(batches):
        held: list[tuple] = []

        def emit():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "c"])

        for batch in blocks(batches, STEP):
            split = {False: [], True: []}
            for outside, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split[outside].append(tokens(text))
            for outside, docs in split.items():
                for code, _ in grams(docs, order):
                    keys, counts = np.unique(code, return_counts=True)
                    held.append((keys | OUTSIDE if outside else keys, counts))
            if sum(len(k) for k, _ in held) > HOLD_CODES:
                held[:] = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > HOLD_CODES // 2:
                    yield emit()
        if held:
            yield emit()

    inside = F.when(F.col("key") < OUTSIDE, F.col("c")).otherwise(0)
    return (
        texts.select("held", F.col("text").cast("binary"))
        .mapInArrow(run, "key long, c long")
        .groupBy(F.col("key").bitwiseAND(F.lit(OUTSIDE - 1)).alias("code"))
        .agg(F.sum(inside).alias("n"), F.sum("c").alias("m"))
    )


def lowest_levels(counts: DataFrame, order: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of the lowest levels with ``most`` nodes at most in the last, and the nodes of that last one.

    Three levels where they are few enough; two are 2**16 nodes by construction.
    """
    for depth in range(min(3, order), 0, -1):
        node = F.col("code").bitwiseAND(F.lit((1 << (8 * depth)) - 1)).alias("node")
        nodes = materialize(counts.where("n > 0").groupBy(node).agg(F.sum("n").alias("n")))
        if depth < 3 or nodes.count() <= most:
            got = nodes.toArrow()
            return depth, got.column(0).to_numpy(), got.column(1).to_numpy()
    return 0, NOTHING, NOTHING


def code_scores(counts: DataFrame, order: int = ORDER, most_shared: int = MOST_SHARED) -> DataFrame:
    """The log10 probability ``p`` of every code of ``code_counts`` by the whole trie of the training texts.

    The trie is cut by the last bytes of the contexts. A part has all longer contexts that end alike, and
    each has the lowest levels, so all that an escape may reach is in the same part: nothing is pruned.
    """
    depth, low, low_n = lowest_levels(counts, order, most_shared)
    shared = counts.sparkSession.sparkContext.broadcast((low, low_n))

    def run(batches):
        low, low_n = shared.value
        base = [summed(cut(low, o), low_n) for o in range(depth)]

        def part(rows: pa.Table):
            code, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
            seen = n > 0
            levels = base + [summed(cut(code[seen], o), n[seen]) for o in range(depth, order + 1)]
            trie = Trie(*(np.concatenate(x) for x in zip(*levels, strict=True)), order)
            return pa.Table.from_arrays([rows.column("code"), rows.column("m"), pa.array(trie.symbols(code))], names=["code", "m", "p"]).to_batches()

        held: list[pa.RecordBatch] = []
        count, first = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            ending = batch.column("ending")
            first, last = ending[0].as_py() if first is None else first, ending[-1].as_py()
            if count >= PART and first != last:  # whole endings wait here: none is put together twice
                rows = pa.Table.from_batches(held)
                whole = int(np.searchsorted(rows.column("ending").to_numpy(), last))
                yield from part(rows.slice(0, whole).combine_chunks())
                held = rows.slice(whole).combine_chunks().to_batches()
                count, first = rows.num_rows - whole, last
        if held:
            yield from part(pa.Table.from_batches(held).combine_chunks())

    ending = F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * depth)) - 1)).alias("ending")
    return counts.select("code", "n", "m", ending).repartition("ending").sortWithinPartitions("ending").mapInArrow(run, "code long, m long, p double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = ORDER, most_codes: int = MOST_CODES, most_words: int = MOST_WORDS, most_shared: int = MOST_SHARED) -> DataFrame:
    """One row per row of ``docs`` with its unigram base score and its PPM code length as log10 probability.

    Both are of the same tokens: words with A-Z in lower case, and an end. For the trie they are bytes,
    with a space between words. Counts of frequent words (at most ``most_words``) and probabilities of
    frequent codes (at most ``most_codes``) are tables in each worker; all other words and codes of the
    texts are joined with theirs, so the bounds change no result. A null text counts as empty and has
    the end alone; a null id counts as an empty string for the fold. Repeated rows give repeated rows,
    other columns are not looked at. Without training texts all counts are zero and every byte is as
    likely as any other.
    """
    spark = ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    train = source.where(~_held("doc_id", folds))
    vocab = materialize(vocabulary(train))
    row = vocab.agg(F.sum("c"), F.count("*")).first()
    n, v = row[0] or 0, row[1]
    floor = n + ALPHA * (v + 1)
    counts = materialize(code_counts(source.withColumn("held", _held("doc_id", folds)), order))
    probabilities = materialize(code_scores(counts, order, most_shared))
    drop_table(counts)
    top = probabilities.where(F.col("m") >= _at_least(probabilities, "m", most_codes)).select("code", "p").sort("code").toArrow()
    table = spark.sparkContext.broadcast((top.column(0).to_numpy(), top.column(1).to_numpy()))
    common = vocab.where(F.col("c") >= _at_least(vocab, "c", most_words)).toArrow()
    frequent = spark.sparkContext.broadcast((common.column(0).to_pylist(), np.log10((common.column(1).to_numpy() + ALPHA) / floor)))
    whole, real = F.lit(0).cast("long"), F.lit(0.0)
    schema = source.select(whole.alias("uid"), "doc_id", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("code"), whole.alias("n"), whole.alias("known"), real.alias("base"), real.alias("ppm")).schema

    def run(batches):
        words, base = frequent.value
        codes, log_p = table.value
        index = {w: i for i, w in enumerate(words)}
        uid = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, STEP):
            split = [tokens(t) for t in batch.column(1).to_pylist()]
            known, sums, rare = [], [], []
            for doc in split:
                at = np.array([index.get(w, -1) for w in doc], np.int64)
                some = at[at >= 0]
                known.append(len(some))
                sums.append(base[some].sum())
                rare.append(Counter(w for w, i in zip(doc, at.tolist(), strict=True) if i < 0) if len(some) < len(doc) else {})
            who = uid + np.arange(len(split))
            uid += len(split)
            ppm = np.zeros(len(split))
            for code, owner in grams(split, order):
                distinct, inverse = np.unique(code, return_inverse=True)
                at, hit = find(codes, distinct)
                ppm += np.bincount(owner, np.where(hit, log_p[at] if len(log_p) else 0, 0)[inverse], len(split))
                other = np.flatnonzero(~hit[inverse])
                if len(other):
                    pairs, n = np.unique(np.stack([owner[other], code[other]], 1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who[pairs[:, 0]]), pa.nulls(len(n), batch.column(0).type), pa.nulls(len(n), pa.binary()), pa.array(pairs[:, 1].copy()), pa.array(n), pa.array(np.zeros(len(n), np.int64)), pa.array(np.zeros(len(n))), pa.array(np.zeros(len(n)))],
                        names=schema.names,
                    )
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), batch.column(0), pa.nulls(len(who), pa.binary()), pa.nulls(len(who), pa.int64()), pa.array(list(map(len, split)), pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(ppm)],
                names=schema.names,
            )
            who = np.repeat(who, list(map(len, rare)))
            zero = pa.array(np.zeros(len(who)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), pa.nulls(len(who), batch.column(0).type), pa.array([w for r in rare for w in r], pa.binary()), pa.nulls(len(who), pa.int64()), pa.array([k for r in rare for k in r.values()], pa.int64()), pa.array(np.zeros(len(who), np.int64)), zero, zero],
                names=schema.names,
            )

    rows = materialize(source.mapInArrow(run, schema))
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(ALPHA)) / F.lit(float(floor)))
    words = rows.where("word is not null").select("uid", "word", "n").join(vocab, "word", "left").select("uid", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("k"), (F.col("n") * log).alias("b"), real.alias("p"))
    codes = rows.where("code is not null").select("uid", "code", "n").join(probabilities, "code").select("uid", whole.alias("k"), real.alias("b"), (F.col("n") * F.col("p")).alias("p"))
    rare = words.union(codes).groupBy("uid").agg(F.sum("k").alias("rare_known"), F.sum("b").alias("rare_base"), F.sum("p").alias("rare_ppm"))
    return (
        rows.where("word is null and code is null")
        .join(rare, "uid", "left")
        .select(
            "doc_id",
            _held("doc_id", folds).alias("held_out"),
            F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
            (F.col("ppm") + F.coalesce("rare_ppm", F.lit(0.0))).alias("score"),
        )
    )


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_ppm": op10_ppm}
ORACLE_SQL: dict[str, str] = {}
