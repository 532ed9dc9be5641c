"""Hashes of word shingles, computed for many texts at once on their bytes.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. A
word's hash is a polynomial over its bytes, read off running sums; a shingle's hash
mixes its words' hashes. 64 bits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text that are hashed together, unless one text is longer.
CHUNK_BYTES = 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * _BASE)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * CHUNK_BYTES), base, dtype=U)
        known[0] = U(1)
        known = np.multiply.accumulate(known)
        _powers[name] = known
    return known[:n]


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    contents = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    content = np.frombuffer(b"\n".join(contents) + b"\n", np.uint8)
    if len(content) > 4 * CHUNK_BYTES:
        _powers.clear()  # one very long text: don't keep its tables
    inside = _WORD_BYTES[content]
    change = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = change[::2], change[1::2]
    terms = _BYTE_VALUES[content] * _power("up", _BASE, len(content))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(terms, dtype=U)])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(content))[starts])
    borders = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in contents]))
    return np.split(hashes, borders[:-1])


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash per run of WORDS words; a shorter text has one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        total = np.array([n], dtype=U)
        for k in range(n):
            total = total * _BASE + words[k : k + 1]
        return mix(total)
    total = words[: n - WORDS + 1].copy()
    for k in range(1, WORDS):
        total = total * _BASE + words[k : n - WORDS + 1 + k]
    return mix(total)


def sequence_key(words: np.ndarray) -> bytes:
    """128 bits that stand for the sequence of words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in pieces of about CHUNK_BYTES; null counts as empty."""
    begin, size, held = 0, 0, []
    for i, text in enumerate(texts):
        if held and size + len(text or "") > CHUNK_BYTES:
            yield begin, held
            begin, size, held = i, 0, []
        held.append(text or "")
        size += len(text or "")
    if held:
        yield begin, held
