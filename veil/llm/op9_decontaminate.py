"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items."""

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.arrow import blocks
from veil.sources import read_table, ship

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
#: Characters of benchmark text in one automaton. A larger benchmark is scanned for in several, one after another.
SHARD_CHARS = 4_000_000
#: Bytes of document text that are read before the next automaton takes over, where there are several.
BLOCK_BYTES = 64_000_000
#: Lower-cases A-Z and turns every other ASCII byte but 0-9 and a-z into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """All windows of some items. Symbols are word numbers; words that no item has are number 0."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        holders: dict[tuple, set[str]] = {}
        for item, text in items:
            w = [numbers.setdefault(x, len(numbers) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                holders.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.numbers, self.any = numbers, bool(holders)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in holders.items():
            self.machine.add_word(key, (len(key), tuple(who)))
        if self.any:
            self.machine.make_automaton()

    def scan(self, doc: list[bytes], hit: bytearray, found: set[str]) -> None:
        """Mark the words of ``doc`` inside an occurrence and gather the items that occur."""
        if not self.any or not doc:
            return
        get = self.numbers.get
        for end, (n, who) in self.machine.iter(tuple([get(w, 0) for w in doc])):
            hit[end + 1 - n : end + 1] = b"\1" * n
            found.update(who)


def spans(text: bytes, hit: bytearray) -> list[dict]:
    """Maximal runs of hit words as half-open code-point ranges of the original text."""
    out: list[dict] = []
    last = False
    for mark, m in zip(hit, WORD.finditer(text.decode("utf-8", "replace")), strict=False):
        if mark and last:
            out[-1]["end"] = m.end()
        elif mark:
            out.append({"start": m.start(), "end": m.end()})
        last = bool(mark)
    return out


def _shards(bench: DataFrame, chars: int) -> list:
    """Broadcasts of the items, each of a checked size: the driver holds one shard at a time."""
    context = bench.sparkSession.sparkContext
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // chars + 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    out = []
    for k in range(n):
        rows = bench.where(part == k).select("item", F.col("text").cast("binary")).collect()
        out.append(context.broadcast([(str(r[0]), bytes(r[1])) for r in rows]))
    return out


def _scanner(shards: list, window: int):
    """Function from a list of texts to one (n_words, hit, items) each."""
    built: dict[int, Automaton] = {}

    def scan(texts: list) -> list[tuple]:
        docs = [words(t) for t in texts]
        hits, found = [bytearray(len(d)) for d in docs], [set() for _ in docs]
        for k, shard in enumerate(shards):
            if k not in built:
                built.clear()
                built[k] = Automaton(shard.value, window)
            for d, h, f in zip(docs, hits, found, strict=True):
                built[k].scan(d, h, f)
        return list(zip(docs, hits, found, strict=True))

    return scan


def contaminated(n_hit: int, n_words: int, one_in: int = ONE_IN) -> bool:
    return n_hit > 0 and one_in * n_hit >= n_words


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    one_in: int = ONE_IN,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: counts, the items that occur, and the hit ranges of the original text.

    Null and empty texts have no words and no hits. Null items have no window; a null item id counts as
    the string ``None``. Repeated rows give repeated rows; an empty benchmark hits nothing. Other columns
    of either table are not looked at. Documents are never shuffled.
    """
    ship(docs.sparkSession)
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    shards = _shards(items, shard_chars)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = source.select(
        "doc_id",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.lit(0).cast("long").alias("n_items"),
        F.lit("").alias("items_sha256"),
        F.lit(True).alias("contaminated"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
    ).schema
    least = BLOCK_BYTES if len(shards) > 1 else 0
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        scan = _scanner(shards, window)
        for batch in blocks(batches, least):
            texts = batch.column(1).to_pylist()
            rows = []
            for text, (d, hit, found) in zip(texts, scan(texts), strict=True):
                n, names = sum(hit), sorted(found)
                digest = hashlib.sha256(",".join(names).encode()).hexdigest()
                rows.append((len(d), n, len(names), digest, contaminated(n, len(d), one_in), names, spans(text, hit) if n else []))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), span_type]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated.

    Null and empty texts have no words and stay; items without words have no window; an empty benchmark
    drops nothing. Repeated rows stay or go together, and an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    items = bench.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    shards = _shards(items, shard_chars)
    least = BLOCK_BYTES if len(shards) > 1 else 0
    at = docs.columns.index(text_col)

    def run(batches):
        scan = _scanner(shards, window)
        for batch in blocks(batches, least):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not contaminated(sum(h), len(d), one_in) for d, h, _ in scan(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.drop("items", "spans")


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
  FROM iw, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
occ AS (SELECT r, i, dwin.n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.k = win.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
who AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN who USING (r)
"""
QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE_SQL = {"op9_decontaminate": SQL}
