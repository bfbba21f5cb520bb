"""64-bit hashes of the words of whole texts, without a Python object for each word.

The whole text is hashed at once: prefix sums of code points times powers of a base give the polynomial hash
of any word by one difference, shifted back to the word's start by the inverse power."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Code points that are hashed at once.
CHUNK = 1 << 20
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * B
        x = (x ^ (x >> np.uint64(27))) * C
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(2 * len(cls.up), n, 1 << 14)
            back = pow(int(A), -1, 1 << 64)
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (A, np.uint64(back)))
        return cls.up, cls.down


@cache
def word_characters() -> np.ndarray:
    """By code point: letters, digits, underscores."""
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    out[ord("_")] = True
    return out


@cache
def letters() -> np.ndarray:
    """By code point: word characters but for decimal digits and underscores."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


def word_hashes(text: str | None, inside: np.ndarray | None = None, stem: int = 0) -> np.ndarray:
    """A hash of each run of ``inside`` characters (default: :func:`word_characters`), lower-cased, in order;
    with ``stem``, of the first so many letters of each longer word after them."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return hashed_runs(codes, (word_characters() if inside is None else inside)[codes], stem)


def hashed_runs(codes: np.ndarray, inside: np.ndarray, stem: int = 0) -> np.ndarray:
    """:func:`word_hashes` of code points, as they are, and whether each is inside a word."""
    if len(codes) <= CHUNK:
        return _hash_words(codes, inside, stem)
    parts, at = [], 0
    while at < len(codes):  # long texts are cut between words; a word's hash does not depend on its place
        end = at + CHUNK
        if end < len(codes):
            gaps = np.flatnonzero(~inside[at:end])
            later = np.flatnonzero(~inside[end:]) if not len(gaps) else gaps
            end = (at + gaps[-1] if len(gaps) else end + later[0] if len(later) else len(codes)) + 1
        parts.append(_hash_words(codes[at:end], inside[at:end], stem))
        at = end
    return np.concatenate(parts)


def _hash_words(codes: np.ndarray, inside: np.ndarray, stem: int) -> np.ndarray:
    padded = np.zeros(len(codes) + 2, np.int8)
    padded[1:-1] = inside
    edges = np.flatnonzero(np.diff(padded))
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.of(len(codes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        if stem:
            starts = starts[ends - starts > stem]
            found = np.concatenate([found, ((sums[starts + stem] - sums[starts]) * down[starts]) ^ C])
        return mix(found)
