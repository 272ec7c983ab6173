"""Best-fit packing of token sequences: a grouping genetic algorithm on islands of documents that exchange well-filled bins."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.arrow import blocks
from veil.llm.bytebpe import encoder
from veil.sources import drop_table, materialize, read_table, ship

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens of a sequence, and the id that ends each document.
SIZE, END = 2048, 0
#: Pieces of an island on average: a task holds one at a time.
ISLAND = 4096
#: Packings that an island keeps, children in a round, and rounds, after each of which well-filled bins migrate.
POPULATION, CHILDREN, ROUNDS = 4, 8, 3
#: Bins that an island sends to the next one.
ELITE = 128
#: A bin is well filled if it lacks this share of its size at most.
LACKS = 1 / 256
#: Share of an island's pieces that may be packed anew with those of other islands, from its worst filled bins.
CARRIED = 1 / 8
#: Bytes of text in one piece of work of a task.
STEP = 1 << 22

Bins = list[list[int]]


def best_fit(bins: Bins, lengths: list[int], size: int) -> Bins:
    """``bins`` with pieces of ``lengths`` put one after another into the fullest bin that has room, or a new one."""
    by_room: list[Bins] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: there is a bin with room for r
    for b in bins:
        room = size - sum(b)
        by_room[room].append(b)
        rooms |= 1 << room
    out = list(bins)
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            b.append(n)
        else:
            room, b = size, [n]
            out.append(b)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return out


def fitness(bins: Bins, size: int) -> tuple[int, int]:
    """Fewer bins are better; of as many, those with fuller ones, so that what is left lies together."""
    return -len(bins), sum(sum(b) ** 2 for b in bins)


def crossover(one: Bins, other: Bins, lengths: list[int], size: int, rng: random.Random) -> Bins:
    """A child of two packings of ``lengths``: whole well-filled bins of ``other``, then what fits of ``one``.

    Pieces of equal length are alike. Bins of ``one`` with a piece that an injected bin has taken are emptied,
    and their other pieces go where they fit best. ``other`` may hold bins of other pieces, which count where all
    their lengths are left.
    """
    left = [0] * (size + 1)
    for n in lengths:
        left[n] += 1

    def take(b: list[int]) -> bool:
        for i, n in enumerate(b):
            if not left[n]:
                for m in b[:i]:
                    left[m] += 1
                return False
            left[n] -= 1
        return True

    full = [b for b in other if sum(b) >= size * (1 - LACKS)]
    injected = rng.sample(full, (len(full) + 1) // 2) if full else []
    child = [list(b) for b in injected if take(b)]
    child += [list(b) for b in sorted(one, key=sum, reverse=True) if take(b)]
    return best_fit(child, [n for n in range(size, 0, -1) for _ in range(left[n])], size)


def mutated(bins: Bins, size: int, rng: random.Random) -> Bins:
    """Some bins emptied, of those that are not full the worst ones first, and their pieces put back in another order."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]) + rng.random() * size / 4)
    gone = set(order[: max(2, len(bins) // 16)])
    pieces = [n for i in gone for n in bins[i]]
    pieces.sort(key=lambda n: -n * (1 + rng.random() / 8))
    return best_fit([list(b) for i, b in enumerate(bins) if i not in gone], pieces, size)


def founded(lengths: list[int], size: int, rng: random.Random) -> list[Bins]:
    """The first packings: best fit of pieces from long to short, and of such orders with some noise."""
    orders = [sorted(lengths, reverse=True)] + [sorted(lengths, key=lambda n: -n * (1 + rng.random() * k / 4)) for k in range(1, POPULATION)]
    return [best_fit([], order, size) for order in orders]


def evolved(packings: list[Bins], migrants: Bins, size: int, rng: random.Random) -> list[Bins]:
    """The packings after a round: children of random parents, and of the best one with the bins that came from elsewhere."""
    lengths = [n for b in packings[0] for n in b]
    rank = lambda p: fitness(p, size)
    bound = -(-sum(lengths) // size)
    now = sorted(packings, key=rank, reverse=True)
    if migrants:
        now = sorted([*now, crossover(now[0], migrants, lengths, size, rng)], key=rank, reverse=True)[:POPULATION]
    for _ in range(CHILDREN):
        if len(now[0]) == bound and all(sum(b) == size for b in sorted(now[0], key=sum)[1:]):
            break  # no packing is better
        one, other = rng.sample(now, 2)
        child = mutated(crossover(one, other, lengths, size, rng), size, rng)
        now = sorted([*now, child], key=rank, reverse=True)[:POPULATION]
    return now


def _packed(bins: Bins) -> bytes:
    """Lengths of a packing, a 0 after each bin."""
    return np.array([x for b in bins for x in (*b, 0)], np.int32).tobytes()


def _unpacked(data: bytes) -> Bins:
    x = np.frombuffer(data, np.int32)
    return [p[:-1].tolist() for p in np.split(x, np.flatnonzero(x == 0) + 1) if len(p)]


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: ``n`` (a number of its own), ``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids``.

    A document is its token ids and ``end``. Only one of more than ``size`` ids is cut, into pieces of ``size`` of
    which the first may be shorter.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    whole = F.lit(0).cast("long")
    columns = [whole.alias("n"), "doc_id", F.lit(0).cast("int").alias("piece"), *(whole.alias(c) for c in ("start", "length", "ids_crc32"))]
    schema = source.select(*columns, *([F.lit(None).cast("array<int>").alias("ids")] if with_ids else [])).schema

    def run(batches):
        tokenizer = encoder(vocabulary)
        n = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, STEP):
            ids, counts = tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])
            ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
            totals = counts + 1
            pieces = -(-totals // size)
            row = np.repeat(np.arange(len(totals)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = totals - size * (pieces - 1)
            start = np.where(piece > 0, head[row] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, head[row])
            at = (np.cumsum(totals) - totals)[row] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            arrays = [pa.array(n + np.arange(len(row))), batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[at, len(ids)].astype(np.int32)), pa.array(ids.astype(np.int32))))
            n += len(row)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def _islands(pieces: DataFrame, size: int) -> DataFrame:
    """``island, packings, elite``: the first packings of each island."""

    def found(table: pa.Table) -> pa.Table:
        island = table.column("island")[0].as_py()
        packings = founded(table.column("length").to_pylist(), size, random.Random(island))
        return _state(island, packings, size)

    return pieces.select("island", "length").groupBy("island").applyInArrow(found, STATE)


STATE = "island long, packings array<binary>, elite binary"


def _state(island: int, packings: list[Bins], size: int) -> pa.Table:
    elite = {tuple(sorted(b)) for b in packings[0] if sum(b) >= size * (1 - LACKS)}
    best = sorted(elite, key=lambda b: (-sum(b), b))[:ELITE]
    kinds = pa.schema([("island", pa.int64()), ("packings", pa.list_(pa.binary())), ("elite", pa.binary())])
    return pa.table([[island], [[_packed(p) for p in packings]], [_packed([list(b) for b in best])]], schema=kinds)


def _round(state: DataFrame, number: int, islands: int, size: int) -> DataFrame:
    """The islands after a round. The bins of each go to another one, farther away each time."""

    def run(batches):
        for batch in batches:
            for island, packings, elite in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = random.Random((island << 8) + number)
                now = evolved([_unpacked(p) for p in packings], _unpacked(elite or b""), size, rng)
                yield from _state(island, now, size).to_batches()

    came = state.select(F.pmod(F.col("island") + number, F.lit(islands)).alias("island"), F.col("elite").alias("came"))
    return state.join(came, "island", "left").select("island", "packings", "came").mapInArrow(run, STATE)


def _placed(pieces: DataFrame, state: DataFrame, level: int, size: int, last: bool) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; both null for those that are packed anew with other islands'."""
    schema = pieces.drop("island").select("*", *(F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset"))).schema

    def place(table: pa.Table, states: pa.Table) -> pa.Table:
        island = states.column("island")[0].as_py()
        bins = sorted(_unpacked(states.column("packings")[0][0].as_py()), key=sum)
        room, anew = (0 if last else int(CARRIED * len(table))), 0
        while anew < len(bins) and len(bins[anew]) <= room and sum(bins[anew]) < size * (1 - LACKS):
            room -= len(bins[anew])
            anew += 1
        places: dict[int, list] = {}
        for k, b in enumerate(bins):
            at = 0
            for n in b:
                places.setdefault(n, []).append((None, None) if k < anew else (-1 - ((level << 56) + (island << 20) + k), at))
                at += n
        found = [places[n].pop() for n in table.column("length").to_pylist()]
        out = table.drop_columns(["island"])
        return out.append_column("sequence_id", pa.array([f[0] for f in found], pa.int64())).append_column("offset", pa.array([f[1] for f in found], pa.int64()))

    return pieces.groupBy("island").cogroup(state.groupBy("island")).applyInArrow(place, schema)


def place(pieces: DataFrame, size: int = SIZE, island: int = ISLAND) -> DataFrame:
    """``pieces`` (``n``, unique, and ``length`` from 1 to ``size``) with ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own. All others are dealt to islands of about ``island`` pieces by the
    hash of ``n``; each evolves packings of its own. What its worst filled bins hold, an eighth of its pieces at most, is
    dealt to fewer islands and packed anew, until there is one. ``pieces`` should be a table, as it is read twice.
    """
    whole = pieces.where(F.col("length") == size)
    out = whole.select("*", F.col("n").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, before = pieces.where(F.col("length") < size), 0, None
    while n := rest.count():
        islands = -(-n // island)
        dealt = rest.withColumn("island", F.pmod(F.xxhash64("n", F.lit(level)), F.lit(islands)))
        state = materialize(_islands(dealt, size))
        for k in range(1, ROUNDS + 1):
            then = materialize(_round(state, k, islands, size))
            drop_table(state)
            state = then
        placed = materialize(_placed(dealt, state, level, size, islands == 1))
        drop_table(state)
        out = out.unionByName(placed.where("sequence_id is not null"))
        rest, level = placed.where("sequence_id is null").drop("sequence_id", "offset"), level + 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END, island: int = ISLAND) -> DataFrame:
    """A row for each piece of each document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    The pieces of a sequence fill it from 0 without gaps, ``size`` ids at most. A null text counts as empty: its
    document is the end alone. Repeated rows are documents of their own, a document of any length is
    packed whole, equal lengths change places freely, other columns are not looked at, and an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    return place(materialize(cut(docs, id_col, text_col, vocabulary, size, end)), size, island).drop("n")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END, island: int = ISLAND) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` and ``parts``, an array of ``offset, length, doc_id, piece, start``.

    A sequence has ``size`` ids at most, so its group is bounded. Odd input is treated as by ``pack``.
    """
    ship(docs.sparkSession)
    pieces = materialize(cut(docs, id_col, text_col, vocabulary, size, end, True))
    placed = place(pieces.drop("ids"), size, island).select("n", "sequence_id", "offset")
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start", "ids")))
    grouped = placed.join(pieces, "n").groupBy("sequence_id").agg(parts.alias("p"))
    shown = F.transform("p", lambda x: F.struct(*(x[c].alias(c) for c in ("offset", "length", "doc_id", "piece", "start"))))
    return grouped.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), shown.alias("parts"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {"op13_packing": op13_packing}
#: The tokenizer library is not in SQL; tests hold the ids against the library and the packing against its bound.
ORACLE_SQL: dict[str, str] = {}
