"""Repeated passages: content-defined paragraphs, MinHash bands, exact Jaccard, removals by components."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.llm.arrow import blocks
from veil.llm.graph import components
from veil.llm.op9_decontaminate import FOLD
from veil.sources import materialize, read_table, ship

#: Words of a shingle, and least Jaccard similarity of a near copy.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and the minima in each: a pair at the least similarity shares a band with 1 - (1 - 0.8**2)**5 = 0.994.
BANDS, MINIMA = 5, 2
#: Words of a repeated passage.
LEAST_RUN = 51
#: A paragraph starts at a pair of words whose hash is the least among those of this many words on either side.
RADIUS = 6
#: Where no such pair is within APART words on either side, one that is the least of INNER words on either side does.
APART, INNER = 7, 3
#: Words on either side that say whether a paragraph starts at a word.
AROUND = APART + RADIUS + 2
#: Words after which a paragraph ends where none of these comes; RADIUS words or fewer that are left over stay with it.
MOST_WORDS = 24
#: Members of a bucket that one task compares; larger buckets are cut into blocks and all pairs of blocks compared.
BLOCK = 4096
#: Members with which all others of a bucket are compared first, as most buckets are one group of near copies.
HUBS = 8
#: A bucket with more paragraphs than this in one task's memory is dealt to as many as SALTS tasks.
HOT, SALTS = 64, 64
#: Bytes of text in one piece of work of a task, and about as many whose words are in memory at once (one text at least).
STEP, PART = 1 << 22, 1 << 20
#: Paragraphs that a task remembers to have signed.
HOLD = 300_000
#: Flags of a paragraph that may be repeated: it has an equal one; it shares a band with a different one.
EQUAL, SHARED = 1, 2
_A, _B, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Odd factors of the words of a paragraph, or next to it, by their place.
_PLACE = np.array([pow(int(_A), i, 1 << 64) for i in range(1, 4 * (MOST_WORDS + RADIUS + AROUND))], np.uint64)


def _minima(x: np.ndarray, r: int) -> np.ndarray:
    """Places whose value is less than the ``r`` before and no more than the ``r`` after."""
    inner = max(0, len(x) - 2 * r)
    own, least = x[r : r + inner], np.ones(inner, bool)
    for k in range(1, r + 1):
        least &= (own < x[r - k : r - k + inner]) & (own <= x[r + k : r + k + inner])
    return np.flatnonzero(least) + r


def _starts(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which the paragraphs of texts of ``sizes`` words start, and how many each text has."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    x = (hashes[:-1] * _A + hashes[1:]) * _B
    x = (x ^ (x >> np.uint64(32))) * _MIX
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)

    def within(r):
        """Those of which the pairs on either side are in the same text."""
        at = _minima(x, r)
        place = at - begin[text[at]]
        return at[(place >= r) & (place + r + 1 < sizes[text[at]])]

    chief, more = within(RADIUS), within(INNER)
    # Texts are put so far apart that those of one are never near those of another.
    apart = lambda at: at + (text[at] << 32)
    far, spot = np.r_[-(1 << 32), apart(chief), (len(sizes) + 1) << 32], apart(more)
    after = np.searchsorted(far, spot)
    more = more[(spot - far[after - 1] > APART) & (far[after] - spot > APART)]
    marks = np.union1d(begin[sizes > 0], np.union1d(chief, more))
    pieces = 1 + np.maximum(0, -((MOST_WORDS + RADIUS - np.diff(np.r_[marks, n])) // MOST_WORDS))
    starts = np.repeat(marks, pieces) + MOST_WORDS * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return starts, np.bincount(text[starts], minlength=len(sizes))


class _Cut:
    """Texts cut into paragraphs, all at once, as a step of arrays costs a short text more than its words do.

    ``words`` of all texts and their ``hashes``, ``sizes`` how many each text has; ``starts`` the numbers of
    the words at which paragraphs start, ``counts`` how many each text has, and ``lengths`` their words.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
        self._raw = b" ".join(raw)
        folded = self._raw.translate(FOLD)
        self.words = folded.split()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        inside = np.frombuffer(b" " + folded + b" ", np.uint8) != 32
        self._edges = np.flatnonzero(inside[1:] != inside[:-1])
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        self._before, self._texts = stops - np.fromiter(map(len, raw), np.int64, len(raw)) - 1, texts
        self.sizes = np.diff(np.r_[0, np.searchsorted(self._edges[::2], stops)])
        self.starts, self.counts = _starts(self.hashes, self.sizes)
        self.lengths = np.diff(np.r_[self.starts, len(self.words)])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends in its text, in code points."""
        points = np.cumsum((np.frombuffer(self._raw + b" ", np.uint8) & 0xC0) != 0x80) - 1
        own = np.repeat(points[self._before], self.sizes)
        return points[self._edges[::2]] - own, points[self._edges[1::2]] - own

    def numbers(self) -> np.ndarray:
        return _numbers(self.hashes, self.lengths)


def _split(text: str):
    """Yield (start, end, words, starts of the words) of the paragraphs of a text."""
    cut = _Cut([text])
    first, starts = cut.places()[0], cut.starts
    at = [*first[starts].tolist(), len(text)]
    for k, (i, n) in enumerate(zip(starts.tolist(), cut.lengths.tolist(), strict=True)):
        yield at[k], at[k] + len(text[at[k] : at[k + 1]].rstrip()), cut.words[i : i + n], first[i : i + n]


def _parts(batches, column: int):
    """Batches in slices of about PART bytes of text, or one text."""
    for batch in blocks(batches, STEP):
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // PART)) + 1
        for i, j in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            yield batch.slice(i, j - i)


def _numbers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each paragraph of ``sizes`` words, by the hashes of its words: equal ones have equal numbers."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    x = (hashes ^ (hashes >> np.uint64(31))) * _PLACE[np.arange(len(hashes)) - np.repeat(begin, sizes)]
    x = (np.add.reduceat(x, begin) + sizes.astype(np.uint64)) * _B
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def paragraphs(text: str):
    """Yield (start, end, words) of the paragraphs of a text in code points; they hold all its words.

    Words are runs of letters and digits, A-Z lowered. Where a paragraph starts depends on the few words
    around it only, so equal runs of words are cut alike, whatever sentences, lines and marks they stand
    in. Only where no pair of words is a strict minimum for over MOST_WORDS words is the cut counted from
    the paragraph's start; that is in text of a short period, the pieces of which are alike by shingles.
    """
    for start, end, words, *_ in _split(text):
        yield start, end, words


def shingles(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))) or [b" ".join(words)]


def signatures(hashes: np.ndarray, sizes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The BANDS keys of each paragraph of ``sizes`` words, given by the hashes of its words, as a row of longs.

    A key hashes MINIMA least values of the paragraph's shingles, and its last three bits are the band's number. It
    has 48 bits, as keys are most of what is shuffled; two that are equal by chance cost a comparison only.
    """
    if not len(sizes):
        return np.zeros((0, BANDS), np.int64)
    # A paragraph of fewer than n words is one shingle: it is filled up with zeros.
    padded = np.maximum(sizes, n)
    ends = np.cumsum(padded)
    x = np.zeros(int(ends[-1]), np.uint64)
    x[np.arange(len(hashes)) + np.repeat(ends - padded - np.cumsum(sizes) + sizes, sizes)] = hashes
    grams = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX + x[k : len(x) - n + 1 + k] * _A
    whole = np.arange(len(grams)) + n <= np.repeat(ends, padded)[: len(grams)]
    grams = grams[whole]
    first = np.r_[0, np.cumsum(padded - n + 1)[:-1]]
    out = np.zeros((len(sizes), BANDS), np.uint64)
    for p in range(BANDS * MINIMA):
        turned = (grams ^ np.uint64((p + 1) * int(_B) % (1 << 64))) * _A
        turned = (turned ^ (turned >> np.uint64(31))) * _MIX
        least = np.minimum.reduceat(turned ^ (turned >> np.uint64(29)), first)
        b = p // MINIMA
        out[:, b] = (out[:, b] ^ (out[:, b] >> np.uint64(27))) * _B + least
    return (((out >> np.uint64(16)) & ~np.uint64(7)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similar_links(members: list[tuple[bytes, frozenset]], similar: float = SIMILAR):
    """Links that join the members as all pairs with a Jaccard similarity of ``similar`` or more would: one a member at most.

    Most groups are near copies of one text, so all members are compared with a few of them first. The
    rest is exact by prefix filtering: with shingles ordered from rare to frequent, two similar sets share
    one of their first few. Pairs that are joined already are not compared.
    """
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def near(i: int, j: int) -> bool:
        a, b = members[i][1], members[j][1]
        if min(len(a), len(b)) < similar * max(len(a), len(b)) - 1e-9:
            return False
        both = len(a & b)
        return both >= similar * (len(a) + len(b) - both) - 1e-9

    def join(i: int, j: int):
        a, b = find(i), find(j)
        if a != b and near(i, j):
            root[max(a, b)] = min(a, b)

    hubs: list[int] = []
    for i in range(len(members)):
        if len(hubs) == HUBS:
            break
        if find(i) not in map(find, hubs):
            hubs.append(i)
            for j in range(len(members)):
                join(i, j)
    apart = len(set(map(find, range(len(members))))) > 1
    if apart and len(hubs) < len(members):
        frequency = Counter(s for _, group in members for s in group)
        index: defaultdict = defaultdict(list)
        for i, (_, group) in enumerate(members):
            order = sorted(group, key=lambda s: (frequency[s], s))
            for s in order[: len(order) - int(np.ceil(similar * len(order) - 1e-9)) + 1]:
                index[s].append(i)
        for group in index.values():
            by_root: defaultdict = defaultdict(list)
            for i in group:
                by_root[find(i)].append(i)
            parts = sorted(by_root.values(), key=len)
            for k, part in enumerate(parts):
                for i in part:
                    for other in parts[k + 1 :]:
                        for j in other:
                            join(i, j)
    for i, (name, _) in enumerate(members):
        if find(i) != i:
            yield name, members[find(i)][0]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, doc_id, text``: rows of equal id and text have one key, all others different ones."""
    marks = (F.coalesce(F.col(c).cast("string"), F.lit(f"null {c}")) for c in (id_col, text_col))
    key = F.unhex(F.md5(F.concat_ws(":", *marks).cast("binary")))
    return docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _banded(source: DataFrame) -> DataFrame:
    """``k, band, n``: the bands of each paragraph ``k`` and how often it is in what a task holds at once.

    Where over HOT different paragraphs of a task are in one band, ``n`` is negative, the number of the
    task that gets it, and the smallest and the largest of them stand for them with ``n`` 0.
    """

    def run(batches):
        held: list[tuple] = []

        def emit():
            k, n, bands = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            k, first, inverse = np.unique(k, return_index=True, return_inverse=True)
            n, bands = np.bincount(inverse, n).astype(np.int64), bands[first]
            band, owner = bands.T.ravel(), np.tile(np.arange(len(k)), BANDS)
            distinct, inverse, size = np.unique(band, return_inverse=True, return_counts=True)
            hot = size[inverse] > HOT
            times = np.where(hot, -1 - (k[owner] % SALTS), n[owner])
            parts = [(k[owner], band, times)]
            if hot.any():
                at = np.lexsort((k[owner[hot]], band[hot]))
                name, key = band[hot][at], k[owner[hot]][at]
                edge = np.r_[True, name[1:] != name[:-1]]
                for end in (edge, np.r_[edge[1:], True]):
                    parts.append((key[end], name[end], np.zeros(int(end.sum()), np.int64)))
            for part in parts:
                for at in range(0, len(part[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in part[:2]] + [pa.array(part[2][at : at + (1 << 17)].astype(np.int32))], names=["k", "band", "n"])

        for batch in _parts(batches, 0):
            cut = _Cut(batch.column(0).to_pylist())
            if cut.words:
                k, at, n = np.unique(cut.numbers(), return_index=True, return_counts=True)
                held.append((k, n, signatures(cut.hashes, cut.lengths)[at]))
            if sum(len(k) for k, _, _ in held) > HOLD:
                yield from emit()
        if held:
            yield from emit()

    return source.select("text").mapInArrow(run, "k long, band long, n int")


def _placed(source: DataFrame) -> DataFrame:
    """``key, pos, k`` of every paragraph."""

    def run(batches):
        for batch in _parts(batches, 1):
            cut = _Cut(batch.column(1).to_pylist())
            row = np.repeat(np.arange(len(cut.counts)), cut.counts)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(cut.counts) - cut.counts, cut.counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(pos.astype(np.int32)), pa.array(cut.numbers())], names=["key", "pos", "k"])

    return source.select("key", "text").mapInArrow(run, "key binary, pos int, k long")


def _edges(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, side: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """For each range of words the hashes of its first 1, 2 and so on, from its end backwards where ``side`` is 0, and the words' numbers."""
    size = high - low
    upto = np.r_[0, np.cumsum(size)]
    place = np.arange(int(upto[-1])) - np.repeat(upto[:-1], size)
    at = np.where(np.repeat(side, size) == 1, np.repeat(low, size) + place, np.repeat(high, size) - 1 - place)
    x = hashes[at]
    total = np.r_[np.uint64(0), np.cumsum((x ^ (x >> np.uint64(31))) * _PLACE[place])]
    x = (total[1:] - np.repeat(total[upto[:-1]], size)) * _B
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return tuple(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values)) for values in ((x >> np.uint64(32)).astype(np.uint32).view(np.int32), at))


def _reach(bounds: list[int], first: int, last: int, right: bool) -> int:
    """How many words next to equal paragraphs ``first`` to ``last`` may belong to a passage that has them.

    Farther out the next start of a paragraph, and all that it depends on, would be in the passage too. The
    paragraph before that start would then have an equal one.
    """
    if right:
        stop = last + 2
        while stop < len(bounds) - 1 and bounds[stop] - bounds[first] < AROUND:
            stop += 1
        return bounds[min(stop, len(bounds) - 1)] - bounds[last + 1] + AROUND
    stop = first - 1
    while stop > 0 and bounds[last + 1] - bounds[stop] < AROUND:
        stop -= 1
    return bounds[first] - bounds[max(0, stop)] + AROUND


def _candidates(chosen: DataFrame, least_run: float) -> DataFrame:
    """Rows for the chosen paragraphs of texts, and rows for the words next to those after which a passage may end.

    ``chosen`` has ``doc_id``, ``text`` and ``at``, an array of place * 4 + flags. A paragraph has ``h``, and the
    first of its kind in a task its ``words``; its flags are in ``side``. A row without ``h`` says what
    follows (``side`` 1) or precedes (0) the paragraph at ``pos``, which has an equal, where its neighbour
    has none: ``edge`` has the hashes of the next 1, 2 and so on of the neighbour's words and a
    few more, and ``places`` their outer ends.
    """
    whole, none = F.lit(0).cast("int"), F.lit(None)
    schema = chosen.select(
        F.lit(0).cast("long").alias("uid"), "doc_id", whole.alias("pos"), whole.alias("start"), whole.alias("end"), whole.alias("word"), whole.alias("n_words"), none.cast("long").alias("k"),
        none.cast("binary").alias("h"), none.cast("binary").alias("words"), none.cast("int").alias("side"), none.cast("array<int>").alias("edge"), none.cast("array<int>").alias("places"),
    ).schema
    kinds = {"uid": pa.int64(), "k": pa.int64(), "h": pa.binary(), "words": pa.binary(), "edge": pa.list_(pa.int32()), "places": pa.list_(pa.int32())}

    def table(batch, row, values):
        """A batch with the rows' document ids and the given columns; others are 0, or null where they may be."""
        out = []
        for name in schema.names:
            kind = kinds.get(name, pa.int32())
            value = values.get(name, 0 if name in ("pos", "start", "end", "word", "n_words") else None)
            if name == "doc_id":
                out.append(batch.column(0).take(pa.array(row, pa.int64())))
            elif value is None or isinstance(value, int):
                out.append(pa.nulls(len(row), kind) if value is None else pa.array(np.full(len(row), value), kind))
            else:
                out.append(value if isinstance(value, pa.ListArray) else pa.array(value, kind))
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    def run(batches):
        seen = set()
        uid = TaskContext.get().partitionId() << 40
        for batch in _parts(batches, 1):
            texts, at = batch.column(1).to_pylist(), batch.column(2)
            cut = _Cut(texts)
            words, (first, last), numbers = cut.words, cut.places(), cut.numbers()
            word, paragraph = np.cumsum(cut.sizes) - cut.sizes, np.cumsum(cut.counts) - cut.counts
            row = np.repeat(np.arange(len(texts)), at.value_lengths().to_numpy(zero_copy_only=False))
            flags = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((flags, row))
            row, pos, flags = row[order], flags[order] >> 2, flags[order] & 3
            number = paragraph[row] + pos
            low, size = cut.starts[number], cut.lengths[number]
            # A paragraph ends before the space in front of the next one, or of the text's end.
            begin, following = first[low], np.r_[first[cut.starts], 0][number + 1]
            following = np.where(pos + 1 == cut.counts[row], np.fromiter((len(x or "") for x in texts), np.int64, len(texts))[row], following)
            end, h, lines = [], [], []
            for i, a, b, w, n in zip(row.tolist(), begin.tolist(), following.tolist(), low.tolist(), size.tolist(), strict=True):
                line = b" ".join(words[w : w + n])
                name = xxhash.xxh3_128_digest(line)
                end.append(a + len(texts[i][a:b].rstrip()))
                h.append(name)
                lines.append(None if name in seen else line)
                seen.add(name)
            if len(seen) > HOLD:
                seen.clear()
            yield table(batch, row, {"uid": uid + row, "pos": pos, "start": begin, "end": end, "word": low - word[row], "n_words": size, "k": numbers[number], "h": h, "words": lines, "side": flags})
            # What is next to runs of equal paragraphs, in texts that are long enough for a passage.
            alike = np.flatnonzero((flags & EQUAL > 0) & (cut.sizes[row] >= least_run))
            joined = (row[alike][1:] == row[alike][:-1]) & (pos[alike][1:] == pos[alike][:-1] + 1)
            heads, tails = alike[np.r_[True, ~joined][: len(alike)]], alike[np.r_[~joined, True][: len(alike)]]
            beside, bounds, of = [], [], None
            for i, head, tail in zip(row[heads].tolist(), pos[heads].tolist(), pos[tails].tolist(), strict=True):
                if i != of:
                    p = int(paragraph[i])
                    of, bounds = i, [*(cut.starts[p : p + int(cut.counts[i])] - word[i]).tolist(), int(cut.sizes[i])]
                if head:
                    beside.append((i, head, 0, max(0, bounds[head] - _reach(bounds, head, tail, False)), bounds[head]))
                if tail + 2 < len(bounds):
                    beside.append((i, tail, 1, bounds[tail + 1], min(bounds[-1], bounds[tail + 1] + _reach(bounds, head, tail, True))))
            if beside:
                row, pos, side, low, high = np.array(beside).T
                edge, at = _edges(cut.hashes, low + word[row], high + word[row], side)
                outer = np.where(np.repeat(side, high - low) == 1, last[at.values], first[at.values])
                places = pa.ListArray.from_arrays(edge.offsets, pa.array(outer, pa.int32()))
                yield table(batch, row, {"uid": uid + row, "pos": pos, "k": numbers[paragraph[row] + pos], "side": side, "edge": edge, "places": places})
            uid += batch.num_rows

    return chosen.select("doc_id", "text", "at").mapInArrow(run, schema)


def _beside(batches):
    """The edges of paragraphs at neighbours that have an equal one too: ``k``, ``side`` and the ``words`` of the neighbour."""
    for batch in batches:
        split = [line.split(b" ") for line in batch.column(2).to_pylist()]
        sizes = np.array(list(map(len, split)), np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in split for w in words), np.uint64, int(sizes.sum()))
        high = np.cumsum(sizes)
        edges = _edges(hashes, high - sizes, high, batch.column(1).to_numpy())[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), edges], names=["k", "side", "edge"])


def _compare(batches):
    """Links within runs of rows of one bucket and pair of blocks, sorted by them; a run that is cut waits."""

    def links(run):
        members = dict(run)
        return similar_links([(h, frozenset(shingles(w.split(b" ")))) for h, w in members.items()]) if len(members) > 1 else ()

    key, run, found = None, [], []

    def emit():
        out = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
        found.clear()
        return out

    for batch in batches:
        for band, pair, h, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (band, pair) != key:
                found += links(run)
                key, run = (band, pair), []
            run.append((h, words))
        if len(found) > HOLD:
            yield emit()
    found += links(run)
    yield emit()


def near_links(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between hashes ``h`` of different paragraphs that share a band and are similar.

    ``members`` has ``band, k`` and ``texts`` has ``k, h, words``. A bucket of more than ``block`` paragraphs is cut
    into blocks by number, and every pair of blocks is a piece of work of its own, so no task holds more
    than two blocks and no similar pair is missed. A piece gives one link a member at most.
    """
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).where("n > 1")
    n = F.coalesce("n", F.lit(1))
    own = F.pmod(F.xxhash64("k", F.lit(3)), n).cast("int")
    # The pairs of blocks that a member is in: its own with each, as first or second. Words come last, so they are shuffled once a band.
    dealt = members.join(sizes, "band", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    pair = F.least("own", "other").cast("long") * F.lit(1 << 31) + F.greatest("own", "other")
    dealt = dealt.select("k", "band", pair.alias("pair")).join(texts, "k").select("band", "pair", "h", "words")
    return dealt.repartition("band", "pair").sortWithinPartitions("band", "pair").mapInArrow(_compare, "a binary, b binary").distinct()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN, block: int = BLOCK, extend: bool = True) -> DataFrame:
    """A row for each paragraph of each repeated passage: ``doc_id, start, end, n_words, cluster, keeper_id, removed``.

    Paragraphs that are equal, or similar by five-word shingles, are linked, and links make clusters; a
    cluster within one row of ``docs`` does not count. The first of a cluster (by document id, row and place) stays and all others are ``removed``; ``keeper_id``
    is the document that keeps it. A run of adjoining repeated paragraphs, with the words next to it that
    stand next to a copy of its first or last paragraph too, counts from ``least_run`` words.
    Documents without a repeated passage have no row. Null and empty texts have no paragraph; a null id
    sorts before any other. The first and the last row of a run take in those words. Without ``extend`` only whole paragraphs count. Repeated rows repeat each other. Other columns of ``docs`` are not looked at.
    """
    ship(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    spot = F.when(F.col("n") < 0, F.col("n")).otherwise(0)
    bucket = Window.partitionBy("band", "spot")
    banded = _banded(source).withColumn("spot", spot)
    banded = banded.withColumn("low", F.min("k").over(bucket)).withColumn("high", F.max("k").over(bucket)).withColumn("all", F.sum("n").over(bucket))
    mixed = F.expr("n < 0 or low <> high")
    lone = F.col("band").bitwiseAND(F.lit(7)) == 0  # an equal paragraph is alone in all its bands
    members = banded.where(mixed | (lone & (F.col("all") > 1))).select("k", F.when(mixed, F.col("band")).alias("band"), F.greatest("n", F.lit(0)).alias("n"))
    members = materialize(members.groupBy("k", "band").agg(F.sum("n").alias("n")))
    flags = F.when(F.max("n") > 1, EQUAL).otherwise(0) + F.when(F.count("band") > 0, SHARED).otherwise(0)
    wanted = members.groupBy("k").agg(flags.alias("flags"))
    at = F.collect_set(F.col("pos") * 4 + F.col("flags")).alias("at")
    chosen = source.join(_placed(source).join(wanted, "k").groupBy("key").agg(at), "key")
    rows = materialize(_candidates(chosen, least_run if extend else float("inf")), "zstd")
    units = rows.where("h is not null")
    texts = units.where("words is not null").select("k", "h", "words").dropDuplicates(["h"])
    linked = components(near_links(members.where("band is not null").select("band", "k"), texts, block))
    place = F.struct("doc_id", "uid", "pos")
    kinds = units.groupBy("h").agg(F.min("uid").alias("least"), F.max("uid").alias("last"), F.min(place).alias("first"))
    kinds = kinds.join(linked, kinds["h"] == linked["node"], "left").where("least <> last or node is not null")
    kinds = materialize(kinds.select("h", "least", "last", "first", F.coalesce("root", "h").alias("cluster")))
    keepers = kinds.groupBy("cluster").agg(F.min("first").alias("keeper"), F.min("least").alias("least"), F.max("last").alias("last")).where("least <> last")
    known = kinds.select("h", "cluster").join(keepers.select("cluster", "keeper"), "cluster")
    found = units.select("uid", "doc_id", "pos", "start", "end", "word", "n_words", "h").join(known, "h")
    order = Window.partitionBy("uid").orderBy("pos")
    run = Window.partitionBy("uid", "run")
    found = found.withColumn("run", F.col("pos") - F.row_number().over(order))
    # What stands next to two copies of a paragraph, or more, is part of their passage too. With the edges of
    # a paragraph in order, the longest one that an edge shares with any other it shares with the one before or after.
    beside = rows.where("h is null").select("uid", "pos", "k", "side", "edge", "places")
    same = F.when(F.col("side").bitwiseAND(F.lit(EQUAL)) > 0, F.col("k"))
    near_by = lambda step: F.when(F.lead("pos", step).over(order) == F.col("pos") + step, F.lead(same, step).over(order))
    pairs = units.select("k", *(near_by(step).alias(name) for name, step in (("left", -1), ("right", 1))))
    pairs = pairs.select("k", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(name).alias("other")) for s, name in ((0, "left"), (1, "right"))))).alias("p"))
    pairs = pairs.select("k", "p.*").join(beside.select("k", "side").distinct(), ["k", "side"], "left_semi").where("other is not null").distinct()
    inner = pairs.join(texts.select(F.col("k").alias("other"), "words"), "other").select("k", "side", "words").mapInArrow(_beside, "k long, side int, edge array<int>")
    edges = beside.unionByName(inner, allowMissingColumns=True).where(F.size("edge") > 0).withColumn("next", F.element_at("edge", 1))
    sorted_edges = Window.partitionBy("k", "side", "next").orderBy("edge")
    shared = lambda other: F.aggregate(F.zip_with("edge", other, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    edges = edges.withColumn("n", F.greatest(*(F.coalesce(shared(f("edge").over(sorted_edges)), F.lit(0)) for f in (F.lag, F.lead)))).where("uid is not null and n > 0")
    reach = F.struct(F.col("n").alias("n_words"), F.element_at("places", F.col("n")).alias("start"))
    furthest = [F.max(F.when(F.col("side") == k, reach)).alias(name) for k, name in ((0, "left"), (1, "right"))]
    more = materialize(edges.groupBy("uid", "pos").agg(*furthest))
    found = found.join(more, ["uid", "pos"], "left")
    low, high = F.col("word") - F.coalesce("left.n_words", F.lit(0)), F.col("word") + F.col("n_words") + F.coalesce("right.n_words", F.lit(0))
    ends = {"low": F.min(low), "high": F.max(high), "from": F.min(F.coalesce("left.start", "start")), "to": F.max(F.coalesce("right.start", "end")), "head": F.min("pos"), "tail": F.max("pos")}
    found = found.withColumns({name: end.over(run) for name, end in ends.items()})
    first, last = F.col("pos") == F.col("head"), F.col("pos") == F.col("tail")
    begin, stop = F.when(first, F.col("low")).otherwise(F.col("word")), F.when(last, F.col("high")).otherwise(F.col("word") + F.col("n_words"))
    return found.where(F.col("high") - F.col("low") >= least_run).select(
        "doc_id",
        F.when(first, F.col("from")).otherwise(F.col("start")).alias("start"),
        F.when(last, F.col("to")).otherwise(F.col("end")).alias("end"),
        (stop - begin).cast("int").alias("n_words"),
        F.lower(F.hex("cluster")).alias("cluster"),
        F.col("keeper.doc_id").alias("keeper_id"),
        ((F.col("keeper.uid") != F.col("uid")) | (F.col("keeper.pos") != F.col("pos"))).alias("removed"),
    )


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_paragraphs": op2_paragraphs}
ORACLE_SQL: dict[str, str] = {}
