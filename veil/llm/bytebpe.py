"""Token ids of whole texts by a byte-level BPE vocabulary: pre-tokens are cut by arrays, each different one is encoded once."""

import functools
import json
import os

import numpy as np
import pyarrow as pa
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
from tokenizers import Tokenizer  # noqa: E402

#: Distinct pre-tokens whose ids a worker remembers before it starts again.
REMEMBER = 1_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The split pattern of the vocabulary's pre-tokenizer, which ``pieces`` follows. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters after an apostrophe that are a pre-token with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def kinds() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pieces(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts start: the texts' code points one after another, and where each text ends."""
    n = len(points)
    kind = kinds()[points]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True  # texts start where others end
    turn = first.copy()
    turn[1:n] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(turn[:n])
    stops = np.r_[begins[1:], n]
    own = kind[begins]
    joined = np.zeros(len(begins), bool)  # a space belongs to what follows
    joined[1:] = (own[1:] != SPACE) & (points[begins[1:] - 1] == 32) & ~first[begins[1:]]
    start = np.zeros(n + 1, bool)
    start[begins[~joined]] = True
    # The last of some white space stands alone or with what follows, but for white space that ends a text.
    inner = (own == SPACE) & ~first[stops]
    start[stops[inner] - 1] = True
    # An apostrophe that starts a pre-token has certain letters with it.
    marks = np.flatnonzero((stops - begins == 1) & (points[begins] == 39) & ~joined)
    marks = marks[~first[stops[marks]]]
    marks = marks[own[marks + 1] == LETTER] if len(marks) else marks
    for ending in ENDINGS:
        at = marks[stops[marks + 1] - begins[marks + 1] >= len(ending)] if len(marks) else marks
        for k, c in enumerate(ending):
            at = at[points[begins[at] + 1 + k] == ord(c)]
        start[begins[at] + 1] = False
        left = stops[at + 1] > begins[at] + 1 + len(ending)
        start[begins[at][left] + 1 + len(ending)] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts as the tokenizer library gives them, without added special tokens.

    A special string inside a text is one token where ``special``, as is the library's default, and plain text otherwise.
    """

    def __init__(self, path: str, special: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.marks = [t["content"] for t in spec["added_tokens"]] if special else []
        self.tokenizer.encode_special_tokens = not special
        self.index: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, fresh: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.index.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh)), strict=True))
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(size) - size]
        self.ids = np.r_[self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))]
        self.size = np.r_[self.size, size]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and the number of each text's ids."""
        if len(self.size) > REMEMBER:
            self.index.clear()
            self.ids, self.begin, self.size = self.ids[:0], self.begin[:0], self.size[:0]
        odd = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(m in t for m in self.marks)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)] if odd else texts
        points = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in plain])
        at = pieces(points, ends) if len(points) else np.zeros(0, np.int64)
        # Code points before each pre-token as bytes.
        raw = "".join(plain).encode()
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.r_[0, np.cumsum(width)]
        offsets = np.r_[place[at], len(raw)].astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.index]
        if fresh:
            self._learn(fresh)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        size = self.size[which]
        upto = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.begin[which] - upto[:-1], size)] if len(which) else np.zeros(0, np.uint32)
        counts = np.diff(np.r_[0, upto[np.searchsorted(at, ends)]]) if len(ends) else np.zeros(0, np.int64)
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in odd.items():
                parts[i], counts[i] = np.array(x, np.uint32), len(x)
            ids = np.concatenate(parts)
        return ids, counts


@functools.cache
def encoder(path: str, special: bool = True) -> Encoder:
    """One for each worker process, so that tasks that follow each other know what was encoded before."""
    return Encoder(path, special)
