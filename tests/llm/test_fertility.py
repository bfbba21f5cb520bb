"""Tokens of very long runs, and the measures against plain counting."""

import math
from collections import Counter
from pathlib import Path

import pytest

from tapewright.llm import fertility


@pytest.fixture(scope="module")
def vocab():
    return fertility.vocabulary(Path(fertility.VOCABULARY).read_bytes())


def test_runs_of_white_space_give_the_same_tokens(vocab):
    """Runs that the pattern can still take give the same tokens cut and uncut."""
    for run in (" " * 70_000, "\n" * 70_000, " \n\t" * 30_000, "\u3000" * 66_000):
        for text in (run, run + "x", "a b" + run + "c d", "x" + run + "!" + run + "1", run + "\x1c"):
            assert vocab.tokens(text).tolist() == vocab.encoding.encode_ordinary(text)


def test_runs_of_two_million_characters(vocab):
    for c in (" ", "\n", "a", "!", "\u3000"):
        assert vocab.measures("word " + c * 2_000_000 + " word")[0] > 0
        assert fertility.score_text(vocab, "en", "word " + c * 2_000_000 + " word")[0] >= 2


def test_measures_by_plain_counting(vocab):
    for text in ("The cat sat on the mat, the cat sat.", "naïve façade – Größe", "жук жук", "a", "   ", "\x00\x01"):
        ids = vocab.encoding.encode_ordinary(text)
        counts = Counter(ids)
        n, per_token, fallback, entropy = vocab.measures(text)
        fragments = 0
        for i in ids:
            try:
                vocab.encoding.decode_single_token_bytes(i).decode()
            except UnicodeDecodeError:
                fragments += 1
        assert n == len(ids) and per_token == len(text) / n and math.isclose(fallback, fragments / n)
        assert math.isclose(entropy, -sum(c / n * math.log2(c / n) for c in counts.values()), abs_tol=1e-12)


def test_verdict_follows_the_bands(vocab):
    assert vocab.measures("") is None and not fertility.in_band("en", None)
    low, high, most, slope, cap = fertility.BANDS["en"]
    for per_token, fallback, entropy, kept in ((low, most, cap, True), (low - 0.01, 0.0, cap, False), (high + 0.01, 0.0, cap, False), (4.0, most + 0.01, cap, False), (4.0, 0.0, cap - 0.1, False)):
        assert fertility.in_band("en", (1 << 20, per_token, fallback, entropy)) is kept
    assert fertility.in_band("en", (4, 4.0, 0.0, slope * 2))
