"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, exact counts of what survives, scores in SQL."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.llm.arrow import blocks
from veil.sources import materialize, read_table, ship

#: Least number of occurrences of a phrase in its language, and the most words it has.
LEAST, MOST_WORDS = 10, 3
#: A phrase goes if a longer candidate around it has at least this share, in percent, of its occurrences.
INSIDE = 50
#: Phrases returned of each language, and the factor of a score.
TOP, SCALE = 2000, 1_000_000
#: Counters of one hash partition's summary at most, as far as PARTITIONS allows.
CAPACITY, PARTITIONS = 1 << 21, 1 << 20
#: Bits of the table that tells which hashes survived. Hashes that share a bit only cost a count in vain.
BITS = 28
#: Bytes of text in one piece of work of a task, and distinct n-grams that a task holds before it sends them.
STEP, HOLD = 1 << 22, 2_000_000
#: Keys in one row of a summary.
ROW = 1 << 14
#: Parts in which the best phrases of a language are chosen before all of them are ranked.
SALTS = 64
#: Class of each byte: 0 of a word, 1 between words, 2 between pieces.
CLASS = np.array([1 if c in b" \t" else 2 if c in b".,;:!?\n\x0b\x0c\r" else 0 for c in range(256)], np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts: ``ids`` into ``distinct``, ``piece`` and ``lang`` of each in order."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        raw = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        kind = CLASS[raw]
        inside = np.r_[False, kind == 0]
        turns = np.flatnonzero(inside[1:] != inside[:-1])  # texts end with a separator, so turns come in pairs
        starts, ends = turns[::2], turns[1::2]
        offsets = np.r_[0, np.cumsum(ends - starts)]
        data = LOWER[raw[inside[1:]]]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.ids, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.langs, of_text = np.unique(np.array(langs, dtype=object), return_inverse=True)
        sizes = np.array([len(t) + 1 if t else 1 for t in texts])
        self.lang = of_text[np.searchsorted(np.cumsum(sizes), starts, "right")]

    def hashes(self, most: int):
        """Yield the places at which n-grams of 1, 2 and so on words start, and their hashes."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.to_pylist()), np.uint64, len(self.distinct))[self.ids]
        x = np.fromiter((xxhash.xxh3_64_intdigest(s.encode()) for s in self.langs), np.uint64, len(self.langs))[self.lang]
        at = np.arange(len(own))
        for n in range(most):
            if n:
                whole = at + n < len(own)
                at, x = at[whole], x[whole]
                whole = self.piece[at] == self.piece[at + n]
                at, x = at[whole], x[whole]
            x = (x ^ (x >> np.uint64(29))) * _A + own[at + n]
            x = (x ^ (x >> np.uint64(32))) * _B
            yield at, x ^ (x >> np.uint64(31))

    def grams(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams at some places a place of each different one (of its language), and how often it is there."""
        key, wide = self.lang[at], max(1, len(self.distinct))
        for k in range(n):
            if len(key) and int(key.max()) > (1 << 62) // wide:
                key = np.unique(key, return_inverse=True)[1]
            key = key * wide + self.ids[at + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return at[first], count

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        parts = [self.distinct.take(pa.array(self.ids[at + k])) for k in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))


class Summary:
    """A Misra-Gries summary: an item that is counted over mass / (capacity + 1) times is never lost.

    Counters are added as they come, from texts or from other summaries. Where there are more than
    ``capacity``, all lose what the first one beyond has, and ``lost`` is the sum of these losses: a
    counter is at most that much too small.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = max(1, capacity), 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 18):
            self.settle()

    def settle(self) -> None:
        keys, counts = (np.concatenate([own, *x]) for own, x in zip((self.keys, self.counts), zip(*self.held, strict=True) if self.held else ((), ()), strict=True))
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(inverse, counts, len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            beyond = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.lost += beyond
            self.counts = self.counts - beyond
            left = self.counts > 0
            self.keys, self.counts = self.keys[left], self.counts[left]
        self.held, self.size = [], 0

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may have been counted ``least`` times."""
        self.settle()
        return self.keys[self.counts + self.lost >= least]


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.col(text_col).cast("binary").alias("text"))


def summaries(source: DataFrame, log_parts: int, most_words: int = MOST_WORDS) -> DataFrame:
    """``part, mass, ones, many, counts``: the n-grams of pieces of work, by hash partition.

    A row without keys says how many n-grams a task has counted in a partition. The others have the
    keys that were counted once, and those counted more often with their counts. A task sends all that it holds.
    """
    shift = np.uint64(32 - log_parts)
    schema = "part int, mass long, ones binary, many binary, counts binary"

    def rows(held):
        key, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n for _, n in held]), len(key)).astype(np.uint32)
        part = key >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange((1 << log_parts) + 1, dtype=np.uint64))
        low = key.astype(np.uint32)
        for p in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            a, b = int(bounds[p]), int(bounds[p + 1])
            yield p, int(n[a:b].sum(dtype=np.int64)), None, None, None
            for i in range(a, b, ROW):
                k, c = low[i : min(b, i + ROW)], n[i : min(b, i + ROW)]
                once = c == 1
                yield p, None, k[once].tobytes(), k[~once].tobytes(), c[~once].tobytes()

    def packed(made):
        out: list[tuple] = []
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        names = ["part", "mass", "ones", "many", "counts"]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for row in made:
            out.append(row)
            if len(out) == 256:
                yield batch()
                out.clear()
        if out:
            yield batch()

    def run(batches):
        held, size = [], 0
        for batch in blocks(batches, STEP):
            words = Words(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            key = np.concatenate([x for _, x in words.hashes(most_words)]) >> shift
            held.append(np.unique(key, return_counts=True))
            size += len(held[-1][0])
            if size > HOLD:
                yield from packed(rows(held))
                held, size = [], 0
        if held:
            yield from packed(rows(held))

    return source.mapInArrow(run, schema)


def survivors(source: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, capacity: int = CAPACITY, bits: int = BITS) -> np.ndarray:
    """A table of 2**bits bits by the first bits of a hash; those of all n-grams counted ``least`` times or more are set.

    Each hash partition has a summary of its own. Its capacity is its mass, which the tasks send before their
    keys, divided by ``least``, so no frequent n-gram is lost. Partitions are as many as it takes for
    ``capacity`` to be enough. The driver gets the table, whose size is fixed, piece by piece.
    """
    size = source.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    mass = most_words * (size / 2 + 1)
    log_parts = min(bits - 3, int(math.log2(PARTITIONS)), max(6, math.ceil(math.log2(mass / least / capacity + 1))))

    def merge(batches):
        part, mass, summary = None, 0, None

        def table():
            bit = np.unique(summary.survivors(least) >> np.uint32(32 - (bits - log_parts)))
            out = np.zeros(1 << (bits - log_parts - 3), np.uint8)
            np.bitwise_or.at(out, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for p, m, ones, many, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if summary:
                        yield table()
                    part, mass, summary = p, 0, None
                if ones is None:
                    mass += m
                    continue
                summary = summary or Summary(mass // least)
                once, often = np.frombuffer(ones, np.uint32), np.frombuffer(many, np.uint32)
                summary.add(np.concatenate([once, often]), np.concatenate([np.ones(len(once), np.int64), np.frombuffer(counts, np.uint32)]))
        if summary:
            yield table()

    sent = summaries(source, log_parts, most_words).repartition(1 << log_parts, "part")
    merged = sent.sortWithinPartitions("part", F.col("ones").isNotNull()).mapInArrow(merge, "part int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    wide = 1 << (bits - log_parts - 3)
    for row in merged.toLocalIterator():
        out[row.part * wide : (row.part + 1) * wide] = np.frombuffer(row.bits, np.uint8)
    return out


def frequent(source: DataFrame, table: np.ndarray, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """``lang, size, phrase, f``: exact counts of the n-grams with ``least`` occurrences or more; size 0 has those of all words."""
    shared = source.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(64 - int(math.log2(len(table) * 8)))

    def run(batches):
        bits = shared.value
        for batch in blocks(batches, STEP):
            words = Words(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            n = np.bincount(words.lang, minlength=len(words.langs))
            out = [(words.langs, np.zeros(len(n), np.int32), pa.array([b""] * len(n), pa.large_binary()), n)]
            for k, (at, x) in enumerate(words.hashes(most_words), 1):
                bit = x >> shift
                at = at[(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                first, n = words.grams(at, k)
                out.append((words.langs[words.lang[first]], np.full(len(n), k, np.int32), words.phrases(first, k), n))
            for lang, size, phrase, n in out:
                yield pa.RecordBatch.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(size), phrase.cast(pa.binary()), pa.array(n.astype(np.int64))], names=["lang", "size", "phrase", "f"])

    counts = source.mapInArrow(run, "lang string, size int, phrase binary, f long")
    return counts.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f")).where(f"size = 0 or f >= {least}")


def _words(phrase: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, inside: int = INSIDE, top: int = TOP,
    capacity: int = CAPACITY, bits: int = BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of two to ``most_words`` words of each language.

    A phrase with ``a`` occurrences is cut where its parts, with ``l`` and ``r`` occurrences, score least;
    the first cut counts where two score alike. All numbers are exact: products are decimals of 38 digits,
    enough for a corpus of 10**15 words. Ties go to the larger ``a``, then to the phrase that is first
    in byte order. A null language counts as ``und``, a null or empty text has no words, a text of any
    length is read whole. Repeated rows count again, other columns are not looked at, and an empty table
    gives an empty result.
    """
    source = _source(docs, text_col, lang_col)
    ship(docs.sparkSession)
    counts = materialize(frequent(source, survivors(source, least, most_words, capacity, bits), least, most_words))
    phrases = counts.where("size >= 2")
    # Each cut, as two rows that ask for the counts of its parts. All parts are frequent, as the phrase is.
    size = F.col("size")
    cuts = phrases.select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), p.alias("part")) for s, p in (("l", _words(F.col("phrase"), F.lit(1), F.col("k"))), ("r", _words(F.col("phrase"), F.col("k") + 1, size - F.col("k")))))))
    asked = cuts.select("*", sides.alias("s")).select("lang", "phrase", "size", "a", "k", "s.side", "s.part")
    parts = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"))
    met = asked.join(parts, ["lang", "part"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("n_part"))).alias(s)
    scored = met.groupBy("lang", "phrase", "size", "a", "k").agg(side("l"), side("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("score", F.expr(f"cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast({SCALE} as decimal(7,0))")).withColumn("__lr", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("score div __lr")).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What a longer phrase around a phrase has.
    spots = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda i: _words(F.col("phrase"), i, w)))))
    around = phrases.where("size >= 3").select("lang", spots.alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(f"longer is null or 100 * cast(longer as decimal(20,0)) < {inside} * cast(a as decimal(20,0))")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("__salt"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM lists),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, w AS w1, lead(w) OVER own AS w2, lead(w, 2) OVER own AS w3 FROM words WINDOW own AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, w1 AS p, w1, NULL AS w2, NULL AS w3, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2, w1, w2, NULL, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
asked AS (
  SELECT lang, p, f AS a, 1 AS k, w1 AS lp, concat_ws(' ', w2, w3) AS rp FROM f WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, p, f, 2, w1 || ' ' || w2, w3 FROM f WHERE w3 IS NOT NULL),
cuts AS (
  SELECT asked.lang, asked.p, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM asked JOIN f l ON l.lang = asked.lang AND l.p = lp JOIN f r ON r.lang = asked.lang AND r.p = rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(f) AS f
  FROM (SELECT lang, w1 || ' ' || w2 AS p, f FROM f WHERE w3 IS NOT NULL UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f WHERE w3 IS NOT NULL) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer o ON o.lang = best.lang AND o.p = best.p WHERE o.f IS NULL OR 100 * o.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
QUERIES = {"op12_phrases": op12_phrases}
ORACLE_SQL = {"op12_phrases": SQL}
