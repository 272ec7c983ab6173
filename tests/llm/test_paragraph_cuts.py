"""Texts cut into paragraphs many at once, against each text cut alone."""

import random

import numpy as np

from veil.llm import op2_paragraphs as op2


def test_texts_cut_together_are_cut_as_alone():
    rng = random.Random(5)
    marks = ["a ", "b ", "éx ", "Zq. ", "中文 ", "\n\n", "w1, ", "　"]
    texts = [None, "", " ", "é", "x " * 500, "ab cd " * 300] + ["".join(rng.choices(marks, k=rng.randrange(300))) for _ in range(300)] + [None, ""]
    cut = op2._Cut(texts)
    first, last = cut.places()
    word = paragraph = 0
    for text, size, count in zip(texts, cut.sizes.tolist(), cut.counts.tolist(), strict=True):
        alone = op2._Cut([text])
        assert cut.words[word : word + size] == alone.words
        assert (cut.starts[paragraph : paragraph + count] - word).tolist() == alone.starts.tolist()
        for w, a, b in zip(alone.words, first[word:].tolist(), last[word:].tolist(), strict=False):
            assert text[a:b].lower().encode() == w
        word, paragraph = word + size, paragraph + count
    assert word == len(cut.words) and paragraph == len(cut.starts) and cut.lengths.max() <= op2.MOST_WORDS + op2.RADIUS


def test_band_keys_have_48_bits():
    keys = op2.signatures(np.arange(1, 2001, dtype=np.uint64) * op2._A, np.full(100, 20))
    assert keys.min() >= 0 and keys.max() < 1 << 48 and (keys & 7 == np.arange(op2.BANDS)).all()
