"""Quality rules on tokeniser fertility.

A public vocabulary (byte-level BPE, never trained here) cuts every whole text into tokens.
Three measures follow: characters per token, the share of tokens that are mere byte
fragments of a character (byte fallback), and the entropy of the token counts in bits.
Text far outside the bands of its language, or of its script where the language is
unknown, is rejected: junk symbols and shouting cut words into many tokens, other encodings
fall back to bytes, and repetition has low entropy.

Base figures beside them (words are runs of other than ASCII white space): see
``base_figures``.

The vocabulary file is sent to the tasks; it is under 2 MB whatever the corpus.  Its path is a parameter:
a plain path is one of the driver's machine, one with a scheme is read through Spark.  Rows are scored where they lie, without a shuffle.

Defined results: null texts have no words, so they fail the base rules; a text without
tokens has null measures; an unknown language falls to its script's band; repeated rows are
scored each; other columns are ignored by ``measure_fertility`` and kept by ``keep_fluent``.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import column_or_null

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space (Unicode's property, as in PATTERN) that are cut out before the pattern meets them: its look-ahead
#: steps back over a run one by one and gives up on very long ones.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = " \t\n\r\x0b\x0c"
SCORES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, chars_per_token double, fallback_share double, token_entropy double, band string"
)
#: (least, most) characters per token, most byte-fallback share, and (slope, cap) of the least
#: entropy, min(slope * log2(tokens), cap).  Languages first, then scripts.
BANDS = {
    "en": (2.15, 9.0, 0.05, 0.5, 5.2),
    "de": (2.15, 9.0, 0.08, 0.5, 5.2),
    "fr": (1.95, 9.0, 0.10, 0.5, 5.2),
    "es": (2.05, 9.0, 0.10, 0.5, 5.2),
    "script:latin": (1.8, 10.0, 0.15, 0.45, 5.0),
    "script:cyrillic": (0.9, 8.0, 0.40, 0.45, 5.0),
    "script:cjk": (0.3, 4.0, 0.90, 0.40, 5.0),
    "script:other": (0.2, 10.0, 0.95, 0.40, 5.0),
}


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = len(_SYMBOLS.findall(text))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            dup += line in seen
            seen.add(line)
    if n < 4:  # fewer than two windows
        return n, chars, symbols, dup, 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return n, chars, symbols, dup, int(covered.sum())


def script_of(text: str) -> str:
    """The commonest script of the letters, by code point range."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    latin = int(((codes >= 65) & (codes <= 90) | (codes >= 97) & (codes <= 122) | (codes >= 0xC0) & (codes < 0x250)).sum())
    cyrillic = int(((codes >= 0x400) & (codes < 0x530)).sum())
    cjk = int(((codes >= 0x3040) & (codes < 0xA000) | (codes >= 0xAC00) & (codes < 0xD7B0)).sum())
    other = int((codes >= 0x250).sum()) - cyrillic - cjk
    best = max(latin, cyrillic, cjk, other)
    return ("latin", "cyrillic", "cjk", "other")[(latin, cyrillic, cjk, other).index(best)]


class Vocabulary:
    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fragment = np.zeros(max(ranks.values()) + 1, bool)
        for token, k in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.fragment[k] = True

    def tokens(self, text: str) -> np.ndarray:
        """The pattern makes one piece of a run of white space but for its last character where more text follows;
        before and behind that piece it matches as if these were texts of their own."""
        parts, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()), self.encoding._encode_single_piece(text[run.start() : end])]
            at = end
        rest = self.encoding.encode_to_numpy(text[at:], disallowed_special=())
        return np.concatenate([*parts, rest]).astype(np.int64) if parts else rest

    def measures(self, text: str) -> tuple[int, float, float, float] | None:
        """Tokens, characters per token, byte-fallback share, entropy in bits."""
        ids = self.tokens(text)
        n = len(ids)
        if not n:
            return None
        counts = np.unique(ids, return_counts=True)[1]
        p = counts / n
        return n, len(text) / n, float(self.fragment[ids].mean()), float(-(p * np.log2(p)).sum())


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """One instance for each worker process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(data)
    return _LOADED[key]


def band_of(lang: str | None, text: str) -> str:
    return lang if lang in BANDS and not lang.startswith("script:") else f"script:{script_of(text)}"


def in_band(band: str, measured: tuple[int, float, float, float] | None) -> bool:
    if measured is None:
        return False
    n, per_token, fallback, entropy = measured
    low, high, most, slope, cap = BANDS[band]
    return low <= per_token <= high and fallback <= most and entropy >= min(slope * math.log2(n), cap)


def score_text(vocab: Vocabulary, lang: str | None, text: str | None) -> tuple:
    text = text or ""
    base = base_figures(text)
    n_words, repeat = base[0], base[4]
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    measured = vocab.measures(text)
    band = band_of(lang, text)
    kept = not failed and in_band(band, measured)
    return (*base, failed, kept, *(measured[1:] if measured else (None, None, None)), band)


def _pass(docs: DataFrame, columns: list[str], schema, path: str, whole: bool) -> DataFrame:
    if "://" in path:
        data = b"\n".join(bytes(r[0]) for r in docs.sparkSession.read.format("binaryFile").load(path).select("content").collect())
    else:
        data = Path(path).read_bytes()
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent.value)
        lang_at = "lang" if whole else "__lang"
        names = [x.split()[0] for x in SCORES.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
        for batch in batches:
            langs = batch.column(lang_at).to_pylist() if lang_at in batch.schema.names else [None] * len(batch)
            scored = [score_text(vocab, lang, t) for lang, t in zip(langs, batch.column("text").to_pylist())]
            if whole:
                yield batch.filter(pa.array([s[6] for s in scored], pa.bool_()))
            elif scored:
                cols = [pa.array(list(c), k) for c, k in zip(zip(*scored), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)

    return docs.select(*columns).mapInArrow(run, schema)


def measure_fertility(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Base figures, measures and verdict of every row."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        column_or_null(docs, "lang", "string").alias("__lang"),
    )
    return _pass(docs, ["doc_id", "text", "__lang"], SCORES, path, whole=False)


def keep_fluent(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return _pass(docs, [f"`{c}`" for c in docs.columns], docs.schema, path, whole=True)
