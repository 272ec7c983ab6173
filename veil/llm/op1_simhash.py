"""SimHash near-duplicates: 64-bit fingerprints joined with themselves by a binary trie."""

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.llm.graph import components
from veil.llm.names import spare
from veil.sources import materialize, read_table, ship

SEED = 42
WORDS = 3
BUDGET = 2
#: A trie root with more fingerprints than this is split again by further blocks of bits.
ROOT_LIMIT = 1 << 20
#: Fingerprints, and node pairs, that a task holds at once.
CHUNK = 1 << 19
#: A fingerprint that more than one row in this many has is hot.
HOT = 1000
#: Two of the four 16-bit blocks of two fingerprints with at most two differing bits are equal.
BLOCK_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
_digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, n: int = WORDS) -> int:
    """SimHash of a UTF-8 text: bit set where over half of the shingle hashes have it; 0 if there is no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= n:
        return _digest(b" ".join(words))
    counts, total, step = np.zeros(64, np.int64), len(words) - n + 1, 1 << 18
    for at in range(0, total, step):
        part = words[at : at + step + n - 1]
        h = np.fromiter(map(_digest, map(b" ".join, zip(*(part[i:] for i in range(n)), strict=False))), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """Columns ``doc_id`` and ``fp`` (the fingerprint as a signed long), one row per row of ``docs``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = source.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return source.mapInArrow(run, schema)


def trie_pairs(group: np.ndarray, rest: np.ndarray, budget: int = BUDGET):
    """Yield (i, j) index arrays of all pairs within a group whose 32-bit ``rest`` differ in at most ``budget`` bits.

    ``group`` and ``rest`` are sorted together, so a trie node is a range of rows. Pairs of nodes go down
    together, one bit a level, with the differing bits so far; a pair over budget is pruned. The frontier
    is a stack of bounded slices, so memory does not follow the number of pairs.
    """
    key = (group.astype(np.uint64) << np.uint64(32)) | rest.astype(np.uint64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    stack = [(0, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while stack:
        depth, f = stack.pop()
        if f.shape[1] > CHUNK:
            for part in np.array_split(f, f.shape[1] // CHUNK + 1, axis=1):
                stack.append((depth, part))
            continue
        al, ah, bl, bh, diff = f
        single = (ah - al == 1) & (bh - bl == 1) & (al != bl)
        if single.any():
            i, j = al[single], bl[single]
            near = np.bitwise_count(key[i] ^ key[j]) <= budget
            yield i[near], j[near]
            al, ah, bl, bh, diff = f[:, ~single]
        if not len(al) or depth == 32:
            continue
        bit = np.uint64(31 - depth)
        keep = np.uint64(32 - depth)

        def middle(lo, hi, bit=bit, keep=keep):
            turn = ((key[lo] >> keep) << keep) | (np.uint64(1) << bit)
            return np.clip(np.searchsorted(key, turn), lo, hi)

        am, bm = middle(al, ah), middle(bl, bh)
        own = al == bl
        other = ~own
        children = np.concatenate(
            [
                np.stack([al, am, bl, bm, diff]),
                np.stack([am, ah, bm, bh, diff]),
                np.stack([al, am, bm, bh, diff + 1]),
                np.stack([am, ah, bl, bm, diff + 1])[:, other],
            ],
            axis=1,
        )
        cl, ch, dl, dh, diff = children
        alive = (ch > cl) & (dh > dl) & (diff <= budget) & ~((cl == dl) & (ch - cl == 1))
        if alive.any():
            stack.append((depth + 1, children[:, alive]))


def _join(batches):
    """Trie self-join of rows sorted by root; a root that is cut by a batch waits for the next one."""
    held: list[np.ndarray] = []

    def flush(rows):
        root, rest, fp = rows
        change = np.r_[False, (root[:, 1:] != root[:, :-1]).any(axis=0)] if rows[0].shape[1] else np.zeros(0, bool)
        group = np.cumsum(change)
        order = np.lexsort((rest, group))
        for i, j in trie_pairs(group[order], rest[order]):
            i, j = fp[order][i], fp[order][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(i, j)), pa.array(np.minimum(i, j))], names=["a", "b"])

    def merged():
        return tuple(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))

    count = 0
    for batch in batches:
        get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        root = np.stack([get("combo").astype(np.int64), get("root"), get("sub")])
        held.append((root, get("rest"), get("fp")))
        count += batch.num_rows
        if count >= CHUNK:
            root, rest, fp = merged()
            last = int(np.flatnonzero((root != root[:, -1:]).any(axis=0))[-1]) + 1 if (root != root[:, -1:]).any() else 0
            if last:
                yield from flush((root[:, :last], rest[:last], fp[:last]))
            held = [(root[:, last:], rest[last:], fp[last:])]
            count = len(fp) - last
    if held:
        yield from flush(merged())


def near_pairs(fps: DataFrame, root_limit: int = ROOT_LIMIT) -> DataFrame:
    """Links ``a`` > ``b`` between the distinct fingerprints of column ``fp`` with at most two differing bits.

    Every fingerprint goes to six trie roots, one for each pair of 16-bit blocks, as any link leaves two
    blocks equal. A root above ``root_limit`` is split into three by blocks of the other 32 bits (again one
    is equal in any link), after which no root can hold more than 2**21 or 2**22 fingerprints.
    """
    spark = fps.sparkSession
    block = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    both = lambda i, j: F.shiftleft(block[i], 16).bitwiseOR(block[j])
    parts = []
    for k, (i, j) in enumerate(BLOCK_PAIRS):
        p, q = (x for x in range(4) if x not in (i, j))
        parts.append(F.struct(F.lit(k).alias("combo"), both(i, j).alias("root"), both(p, q).alias("rest")))
    roots = fps.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.*")
    heavy = materialize(roots.groupBy("combo", "root").count().where(F.col("count") > root_limit).select("combo", "root"))
    plain = roots.withColumn("sub", F.lit(-1).cast("long"))
    if not heavy.isEmpty():
        cut = [F.struct(F.lit(n).alias("n"), F.shiftright("rest", s).bitwiseAND(F.lit(m)).alias("bits")) for n, s, m in ((0, 21, 2047), (1, 10, 2047), (2, 0, 1023))]
        split = (
            roots.join(heavy, ["combo", "root"])
            .withColumn("c", F.explode(F.array(*cut)))
            .withColumn("sub", F.col("c.n").cast("long") * 4096 + F.col("c.bits"))
            .drop("c")
        )
        plain = plain.join(heavy, ["combo", "root"], "left_anti").unionByName(split)
    dealt = plain.repartition("combo", "root", "sub").sortWithinPartitions("combo", "root", "sub")
    return dealt.mapInArrow(_join, "a long, b long").distinct()


def _labels(nodes: DataFrame) -> DataFrame:
    """``fp`` and ``component_id`` for the distinct fingerprints ``fp`` with their smallest value ``rep``."""
    linked = components(near_pairs(nodes.select("fp")))
    named = linked.join(nodes, linked["node"] == nodes["fp"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    member = linked.join(named, "root").select(F.col("node").alias("fp"), F.col("component_id"))
    return nodes.join(member, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (long), ``component_id`` (smallest id reachable).

    A null or wordless text has fingerprint zero and links like any other. Rows with equal fingerprints
    are one node of the graph, however many they are. A null id takes part but never names a component
    unless all ids in it are null. Other columns of ``docs`` are not looked at. Empty in, empty out.
    """
    ship(docs.sparkSession)
    fps = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    label = materialize(_labels(nodes.select("fp", "rep")))
    # Under HOT fingerprints have more than that share of all rows, so their labels may be sent to the rows.
    share = (nodes.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = nodes.where(F.col("n") > share).select("fp")
    named = F.broadcast(label.join(F.broadcast(hot), "fp", "left_semi").withColumnRenamed("component_id", "hot_id"))
    rows = fps.join(named, "fp", "left")
    often = rows.where("hot_id is not null").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
    return often.unionByName(rows.where("hot_id is null").select("doc_id", "fp").join(label, "fp").select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id.

    Ties between rows of one id go to the smaller MD5 of id and text, then to the smaller hash of the
    whole row. A row without an id stays only if its group has no row with one.
    """
    ship(docs.sparkSession)
    key, n = spare(docs, "key", "n")
    marks = (F.coalesce(F.col(c).cast("string"), F.lit(f"null {c}")) for c in (id_col, text_col))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws(":", *marks).cast("binary"))))
    who = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("key"))
    fps = materialize(fingerprints(keyed.select(who.alias("who"), F.col(text_col).alias("text")), "who", "text"))
    label = _labels(materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))))
    keys = label.select(F.col("component_id.key").alias(key)).distinct()
    first = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    kept = keyed.join(keys, key, "left_semi").withColumn(n, F.row_number().over(first))
    return kept.where(F.col(n) == 1).select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
