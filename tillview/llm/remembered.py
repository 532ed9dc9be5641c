"""Ids of whole texts from a tokenizer library, remembered by chunk.

A text is cut where no token can cross: the ids of the text are then the ids of its chunks,
one after the other. The library sees each chunk of a slice of rows once, and frequent ones
stay in a memory of bounded bytes; memory changes time, never ids.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from tillview.llm.tokens import byte_symbols

REMEMBERED_BYTES = 64 << 20
#: Longer chunks are encoded with each slice of rows.
REMEMBERED_LENGTH = 64
#: What an entry takes beside its text and ids.
ENTRY_BYTES = 180

_BLANK = re.compile(r"[\t\n\r]")


# fixed values: letters, numbers and white space up to U+00FF, and contractions of the word splitter
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
_SMALL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}\u0100-\U0010ffff]+")
_SPECIAL = "<|"
_BEYOND = re.compile(r"[^\x00-\xff]")


def words(text: str) -> list[str]:
    """Chunks of a text for the lower-case vocabulary of words, whose tokens hold no white space.

    Up to U+00FF a text is cut as its splitter does, after small letters were put; other texts,
    and those that may name a special token, at ASCII white space only.
    """
    if _SPECIAL not in text and not _BEYOND.search(text):
        return _PIECE.findall(text.lower())
    return [c for c in _BLANK.sub(" ", text).split(" ") if c]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered:
    """Packed ids of texts given as chunks, through a function that encodes many chunks."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = REMEMBERED_BYTES):
        self.encode, self.most = encode, most
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        known = self.memory
        new = list(set().union(*texts) - known.keys())
        known.update(zip(new, map(packed, self.encode(new))))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in texts]
        for chunk in new:
            if len(chunk) > REMEMBERED_LENGTH:
                del known[chunk]
            else:
                self.held += 2 * len(chunk) + len(known[chunk]) + ENTRY_BYTES
        if self.held > self.most:
            known.clear()
            self.held = 0
        return out


def library(content: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of a tokenizer file's content for the chunks of :func:`words`.

    A single piece meets the merges at once, other chunks take all the library's steps.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, shown = tokenizer.model, dict(enumerate(byte_symbols()))

    def encode(chunks: list[str]) -> list[list[int]]:
        ids: list[list[int]] = [[]] * len(chunks)
        for i, c in enumerate(chunks):
            if _SMALL.fullmatch(c):  # no special token: those mix letters and signs
                ids[i] = [t.id for t in model.tokenize(c.encode().decode("latin-1").translate(shown))]
            else:
                ids[i] = tokenizer.encode(c, add_special_tokens=False).ids
        return ids

    return encode
