"""Token counts by byte-pair merges over ragged arrays, one rank at a time in every sequence at once."""

import json
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.sources import read_table, ship

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
#: Distinct pre-tokens whose counts a worker remembers before it starts again.
REMEMBER = 400_000
#: Symbols that are merged at once.
SYMBOLS = 1 << 21
NO_RANK = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or one counted up from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Merges:
    """The merge table of a vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.first = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_alphabet()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = len(vocab) + 1
        code = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int64), made[order]
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        out = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + SYMBOLS, SYMBOLS), "right")
        cuts = [0, *sorted({int(c) for c in cuts[1:]} - {0, len(words)}), len(words)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                out[a:b] = self._merge(words[a:b], sizes[a:b])
        return out

    def _merge(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.first[raw]
        filled = sizes > 0
        ends = np.cumsum(sizes) - 1
        symbol[ends[filled]] = self.last[raw[ends[filled]]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done = np.zeros(len(words), np.int64)
        while len(symbol):
            # Rank of the pair that begins at each symbol.
            rank, made = np.full(len(symbol), NO_RANK), np.zeros(len(symbol), np.int64)
            code = symbol[:-1] * self.base + symbol[1:]
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            ok = (self.code[at] == code) & (owner[:-1] == owner[1:])
            rank[:-1][ok], made[:-1][ok] = self.rank[at[ok]], self.made[at[ok]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbol)])
            lowest = np.minimum.reduceat(rank, starts)
            # Sequences without a pair are finished and leave the arrays.
            over = lowest == NO_RANK
            done[owner[starts[over]]] = lengths[over]
            low = np.repeat(lowest, lengths)
            chosen = (rank == low) & (low != NO_RANK)
            # In a run such as aaaa the pair begins at every symbol; every second one of a run is merged.
            index = np.arange(len(symbol))
            begins = chosen & ~np.r_[False, chosen[:-1]]
            run = np.maximum.accumulate(np.where(begins, index, 0))
            chosen &= (index - run) % 2 == 0
            symbol = np.where(chosen, made, symbol)
            keep = ~np.r_[False, chosen[:-1]] & (low != NO_RANK)
            symbol, owner = symbol[keep], owner[keep]
        return done


class Counter:
    """Counts tokens of whole texts as the tokenizer library does, without added special tokens."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.find = regex.compile(self.merges.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)))
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings it holds (each is one token)."""
        if not any(s in text for s in self.merges.special):
            return self.find(self.fold(text)), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.find(self.fold(p))], len(parts) - 1

    @staticmethod
    def fold(text: str) -> str:
        """NFC, then lower case letter by letter, so that no sigma becomes a final one."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pieces(t) if t else ([], 0) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        fresh = list({w for words, _ in split for w in words} - self.known.keys())
        self.known.update(zip(fresh, self.merges.counts([w.encode("utf-8", "surrogatepass") for w in fresh]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) + special for words, special in split]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text counts as empty: no bytes, no tokens. Texts are counted whole; repeated rows give repeated
    rows. Other columns of ``docs`` are not looked at. Nothing is shuffled. The vocabulary file must be at
    the same path on every executor, where the package that holds it is installed.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = source.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_tokens")), F.lit(True).alias("over_limit")).schema

    def run(batches):
        counter = Counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = counter.count(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_tokens": op6_tokens}
ORACLE_SQL: dict[str, str] = {}
