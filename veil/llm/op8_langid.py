"""Language identification: script ranges, per-word trigram scores and a Viterbi path over languages."""

import functools
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.counts import HOLD, POOLS, bounded, rows_of, summed, table
from veil.sources import drop_table, materialize, read_table, ship

#: Runs of word characters less digits and the underscore; they may hold number signs, which are no letters.
WORD = re.compile(r"[^\W\d_]+")
#: Trigram counts of all languages that are sent to the workers one by one; beyond, rare trigrams are pooled.
CELLS = 1 << 24
ALPHA = 0.05
#: Cost, in nats, of a change of language between two words.
SWITCH = 8.0
#: A language is a candidate for a script if at least this share of its words is in it.
SCRIPT_SHARE = 0.001
NOT_CANDIDATE = -50.0
#: First code points of script ranges and the script's number.
SCRIPTS = (
    (0x0041, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0780, 6), (0x0900, 7),
    (0x0980, 8), (0x0E00, 9), (0x0F00, 10), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x1E00, 0), (0x1F00, 1),
    (0x2C00, 14), (0x3040, 15), (0x3100, 16), (0xAC00, 12), (0xD7B0, 14), (0xF900, 16), (0xFB50, 5), (0x10000, 14), (0x20000, 16),
)
_BOUNDS = np.array([b for b, _ in SCRIPTS])
_SCRIPT = np.array([s for _, s in SCRIPTS])
N_SCRIPTS = int(_SCRIPT.max()) + 1
#: Distinct words in a worker's memory before it passes on counts or starts again.
REMEMBER = 300_000
#: Characters that are looked up at once.
STEP_CHARS = 1 << 20
#: Words whose values are held as numbers at once, on a path over languages.
STEP_WORDS = 1 << 14


def letters(text: str) -> list[tuple[int, str]]:
    """Runs of letters and where they start."""
    out = []
    for m in WORD.finditer(text):
        at, word = m.start(), m.group()
        if not word.isalpha():
            for alpha, run in itertools.groupby(enumerate(word), lambda x: x[1].isalpha()):
                part = list(run)
                if alpha:
                    out.append((at + part[0][0], "".join(c for _, c in part)))
        else:
            out.append((at, word))
    return out


@functools.cache
def _blanks() -> np.ndarray:
    """Each code point if it is a letter, else a blank; the planes beyond have no letters, and the last entry stands for them."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x40000)), np.uint32, 0x40000)


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    text = text.lower()
    parts = (np.frombuffer(text[i : i + STEP_CHARS].encode("utf-32-le", "surrogatepass"), "<u4") for i in range(0, len(text), STEP_CHARS))
    return "".join(_blanks().take(part, mode="clip").tobytes().decode("utf-32-le") for part in parts).split()


def scripts_of(words: list[str]) -> np.ndarray:
    """Script of the first letter of each word."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT[np.maximum(0, np.searchsorted(_BOUNDS, first, "right") - 1)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of all words, which start with ``<`` and end with ``>``, and the number of each word's."""
    chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes + 2) - sizes - 2, sizes + 2)
    inside = place < np.repeat(sizes, sizes + 2)
    return ((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[inside[:-2]], sizes


def features(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes with their counts: of trigrams, which are large numbers, and of scripts, which are small ones."""
    words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    codes, sizes = grams(words)
    return summed(np.r_[codes, scripts_of(words)], np.r_[np.repeat(n, sizes), n])


def _remainder(column, base: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(base))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> "Model":
    """Count trigrams and scripts of all given texts with a non-null language; counts are combined before the shuffle.

    All trigrams are counted. Where they are more than CELLS over the number of languages, the rarest share
    pools. The values of the language column, its different ones, are held on the driver.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches):
        held: defaultdict = defaultdict(Counter)
        total: dict[str, tuple] = {}

        def fold():
            for lang, words in held.items():
                more = features(words)
                total[lang] = summed(*(np.concatenate(x) for x in zip(total[lang], more, strict=True))) if lang in total else more
            held.clear()

        def emit():
            for lang, (key, n) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "key", "n"])
            total.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    held[lang].update(words)
            if sum(map(len, held.values())) > REMEMBER:
                fold()
                if sum(len(k) for k, _ in total.values()) > HOLD:
                    yield from emit()
        fold()
        yield from emit()

    counts = materialize(source.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    found = bounded(counts.where(F.col("key") >= N_SCRIPTS), CELLS // max(1, len(langs)))
    trigrams = counts.where(F.col("key") >= N_SCRIPTS).select("key").distinct().count()
    model = Model(langs, found.select("lang", "key", "n").toArrow(), counts.where(F.col("key") < N_SCRIPTS).select("lang", "key", "n").toArrow(), trigrams)
    drop_table(counts)
    return model


class Model:
    """Log probabilities: ``table[row, language]`` for trigrams (see ``counts.rows_of``), ``scripts[script, language]`` for candidates."""

    def __init__(self, langs: list[str], counted: pa.Table, scripts: pa.Table, trigrams: int):
        self.langs = langs
        column = lambda t: pc.index_in(t.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int64)
        width = max(1, len(langs))
        self.keys, n = table(counted.column("key").to_numpy(), column(counted), counted.column("n").to_numpy(), width)
        # A pool's count is shared by the trigrams that may be in it; a trigram never seen is in one too.
        total = n.sum(axis=0)
        n[len(self.keys) :] /= max(1.0, (trigrams - len(self.keys)) / POOLS)
        self.table = np.log((n + ALPHA) / (total + ALPHA * (trigrams + 1))).astype(np.float32)
        share = np.zeros((N_SCRIPTS, width))
        np.add.at(share, (scripts.column("key").to_numpy(), column(scripts)), scripts.column("n").to_numpy())
        share = share / np.maximum(share.sum(axis=0), 1)
        fits = share >= SCRIPT_SHARE
        fits |= ~fits.any(axis=1, keepdims=True)  # a script that no language has narrows nothing
        self.scripts = np.where(fits, 0, NOT_CANDIDATE).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Score of each word in each language."""
        codes, sizes = grams(words)
        distinct, inverse = np.unique(codes, return_inverse=True)
        scores = self.table[rows_of(self.keys, distinct)][inverse]
        return np.add.reduceat(scores, np.r_[0, np.cumsum(sizes)[:-1]], axis=0) + self.scripts[scripts_of(words)]


def _full_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on the best path, found word by word; plain numbers, since calls on arrays of a few languages cost more."""
    steps, langs = scores.shape
    before = np.empty((steps, langs))  # value of the best path to each language, with its word
    value = [0.0] * langs
    for at in range(0, steps, STEP_WORDS):
        held = []
        for row in scores[at : at + STEP_WORDS].tolist():
            turn = max(value) - switch
            value = [(v if v >= turn else turn) + s for v, s in zip(value, row, strict=True)]
            held.append(value)
        before[at : at + len(held)] = held
    top = before.argmax(axis=1)
    came = before < before.max(axis=1, keepdims=True) - switch  # to stay in the language is worth less than to come from the top one
    turns = [np.flatnonzero(came[:-1, k]) for k in range(langs)]
    path = np.empty(steps, np.int64)
    end, k = steps, int(top[-1])
    while end:
        n = int(np.searchsorted(turns[k], end - 1))
        start = int(turns[k][n - 1]) + 1 if n else 0
        path[start:end] = k
        end, k = start, int(top[start - 1])
    return path


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the best path; ties go to the earlier language."""
    steps, langs = scores.shape
    best = int(scores.sum(axis=0, dtype=float).argmax())
    path = np.full(steps, best)
    if langs == 1:
        return path
    # A detour from the best single language has to gain more than one switch, and so has any stretch that it is part of.
    level = np.zeros(steps + 1)
    others = scores.copy()
    others[:, best] = -np.inf
    np.cumsum(others.max(axis=1) - scores[:, best], dtype=float, out=level[1:])
    low = np.minimum.accumulate(level[:-1])
    if (level[1:] - low).max() <= switch:
        return path
    away = np.maximum.accumulate(level[:0:-1])[::-1] - low > switch  # words of stretches that gain so much; all others are in the best language
    edges = np.flatnonzero(np.diff(away, prepend=False, append=False))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        part = scores[start:end].astype(float)
        cost = np.where(np.arange(langs) == best, 0, switch)
        if start:
            part[0] -= cost
        if end < steps:
            part[-1] -= cost
        path[start:end] = _full_path(part, switch)
    return path


class Labeller:
    """Scores words once, remembers them, and labels texts."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self._forget()

    def _forget(self):
        self.index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.rows = np.zeros((1 << 16, len(self.model.langs)), np.float32)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.known = 0

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word; a word not met before gets the next one, which ``_learn`` fills."""
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _learn(self) -> None:
        """Score the words that were numbered since the last call."""
        known, now = self.known, len(self.index)
        if known == now:
            return
        if now > len(self.rows):
            more = max(now, 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.float32)])
            self.sizes = np.concatenate([self.sizes, np.zeros(more, np.int64)])
        fresh = list(itertools.islice(reversed(self.index), now - known))[::-1]
        self.rows[known:now] = self.model.words(fresh)
        self.sizes[known:now] = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.known = now

    def paths(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Letters of each word of each text, and the language number of each."""
        if len(self.index) > REMEMBER:
            self._forget()
        numbers = [self._numbers(words_of(t) if t else []) for t in texts]
        self._learn()
        for number in numbers:
            yield self.sizes[number], viterbi(self.rows[number], self.switch) if len(number) else number

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language with most letters, and its share of the letters; ``und`` and 0 without letters or model."""
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        out = []
        for sizes, path in self.paths(texts):
            if not len(sizes):
                out.append(("und", 0.0))
                continue
            letters = np.bincount(path, sizes, len(self.model.langs))
            best = int(letters.argmax())
            out.append((self.model.langs[best], float(letters[best] / letters.sum())))
        return out

    def spans(self, text: str | None) -> list[dict]:
        """Maximal runs of words of one language as code-point ranges of the original text."""
        out: list[dict] = []
        if not text or not self.model.langs:
            return out
        places = letters(text)
        words = [w.lower() for _, w in places]
        if not words:
            return out
        number = self._numbers(words)
        self._learn()
        path = viterbi(self.rows[number], self.switch)
        for (at, word), k in zip(places, path, strict=True):
            lang = self.model.langs[k]
            if out and out[-1]["lang"] == lang:
                out[-1]["end"] = at + len(word)
            else:
                out.append({"lang": lang, "start": at, "end": at + len(word)})
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score`` and, if asked for, ``lang_spans``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
    learned. Very long texts are labelled whole. Rows are independent: nothing is shuffled, repeated rows
    give repeated rows, and other columns are not looked at.
    """
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")]
    if with_spans:
        columns.append(F.lit(None).cast("array<struct<lang:string,start:int,end:int>>").alias("lang_spans"))
    schema = source.select("doc_id", *columns).schema
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        labeller = Labeller(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = labeller.label(texts)
            arrays = [batch.column(0), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())]
            if with_spans:
                arrays.append(pa.array([labeller.spans(t) for t in texts], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has letters and one language for ``least`` of them.

    Null and empty texts, and those of numbers and signs alone, go; where nothing was learned, all rows go.
    Repeated rows stay or go together, and an empty table gives an empty one.
    """
    spark = ship(docs.sparkSession)
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        labeller = Labeller(sent.value)
        for batch in batches:
            made = labeller.label(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in made], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """The documents outside the held-out fold."""
    return docs.where(_remainder(id_col, folds) != 0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, train(learned(docs)))
    return out.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_langid": op8_langid}
ORACLE_SQL: dict[str, str] = {}
