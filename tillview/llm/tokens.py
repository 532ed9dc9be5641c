"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A vocabulary of merges gives every prefix of a word exactly one last token. An
automaton over the vocabulary lists the tokens that end at a position; the last
token is the one that is compatible with the last token of the prefix before it.
Back-pointers from the end of the word give the ids. Two neighbours are compatible
if merging their concatenation from scratch never joins symbols across the border.

Letters and numbers follow the Unicode tables of the installed regex module: ids equal
the tokenizers library's for all characters that both tables know (up to Unicode 15).

Null texts count as empty and give no ids. Texts are encoded whole, word by word.
Equal rows give equal results; input columns are kept, those named like a result are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.llm.common import append_columns

#: Bytes of words and ids that a worker remembers, and pairs of tokens; they bound memory, not results.
REMEMBERED_BYTES = 64 << 20
REMEMBERED_PAIRS = 100_000
#: Longer words are encoded each time.
REMEMBERED_LENGTH = 64
#: What an entry of the memory takes beside its text and ids.
ENTRY_BYTES = 160
FIELDS = [
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
]
# fixed values: white space and contractions of the word splitter, by code point
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
FINAL = 0x10000  # added to the code point of a word's last symbol


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Exact ids for the words of one vocabulary file; remembers words up to a number of bytes."""

    def __init__(self, content: str, remembered: int = REMEMBERED_BYTES):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in added.items()}
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split_ascii = re.compile(rf"{CONTRACTIONS}|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+")
        self.split_any = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            joined = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = order
            self.parts.setdefault(joined, (vocab[left], vocab[right], order))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            symbols = self.marked(token)
            # a symbol or the result of a merge; no other entry can be reached
            if len(symbols) == 1 or i in self.parts:
                self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.remembered = remembered
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def marked(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + FINAL)
        return token

    def edge(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """The symbols that stand at one edge of ``token`` while it is merged: (symbol, born, gone)."""
        found, gone = [], float("inf")
        while True:
            parts = self.parts.get(token)
            found.append((token, parts[2] if parts else -1, gone))
            if not parts:
                return found
            token, gone = parts[side], parts[2]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging left + right from scratch leaves the border between them alone.

        A merge of rank r joins the border if both edge symbols exist when it is due.
        At equal rank the leftmost place is merged first: the left token's own merge
        comes before the border, the right token's after it.
        """
        known = self.fits.get((left, right))
        if known is None:
            known = True
            for a, born_a, gone_a in self.edge(left, 1):
                for b, born_b, gone_b in self.edge(right, 0):
                    r = self.rank.get((a, b))
                    if r is not None and r > born_a and r > born_b and r < gone_a and r <= gone_b:
                        known = False
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def word(self, piece: str) -> list[int]:
        """The ids of one word."""
        text = "".join([self.symbols[b] for b in piece.encode("utf-8")])
        if self.suffix:
            text = text[:-1] + chr(ord(text[-1]) + FINAL)
        n = len(text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(text):
            at = end + 1
            if last[at] < 0:
                before = at - length
                if before == 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                    last[at], back[at] = token, before
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]

    def packed(self, piece: str) -> bytes:
        ids = self.memory.get(piece)
        if ids is None:
            ids = np.array(self.word(piece), dtype="<u4").tobytes()
            if len(piece) <= REMEMBERED_LENGTH:
                self.held += 4 * len(piece) + len(ids) + ENTRY_BYTES
                if self.held > self.remembered:
                    self.memory.clear()
                    self.held = 4 * len(piece) + len(ids) + ENTRY_BYTES
                self.memory[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        # each character is lowered by itself, so sigma has one small form
        return self.split_any.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks = self.added_pattern.split(text) if self.added_pattern else [text]
        known, packed, out = self.memory, self.packed, []
        for chunk in chunks:
            if chunk in self.added:
                out.append(np.array([self.added[chunk]], dtype="<u4").tobytes())
            elif chunk:
                out += [known.get(p) or packed(p) for p in self.pieces(chunk)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary entries joined by spaces, as for a vocabulary without a decoder."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encode_and_decode(spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed unsigned 32-bit), ``decoded`` and ``n_tokens``.

    ``vocabulary`` is the path of a tokenizer file on the driver. Its content, bounded
    by the file, is broadcast; a worker builds the encoder once and keeps its memory
    of words from task to task.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast({"content": file.read()})

    def make(texts: pa.Array) -> list[pa.Array]:
        state = shared.value
        if "encoder" not in state:
            state["encoder"] = Encoder(state["content"])
        encoder = state["encoder"]
        ids = [encoder.encode(t or "") for t in texts.to_pylist()]
        return [
            pa.array(ids, pa.binary()),
            pa.array([encoder.decode(i) for i in ids], pa.string()),
            pa.array([len(i) // 4 for i in ids], pa.int64()),
        ]

    return append_columns(docs, [text], FIELDS, make)


def with_digests(
    spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The key with ``n_tokens`` and the SHA-256 of ids and of decoded text, hashed where they are made."""
    whole = encode_and_decode(spark, docs.select(key, text), vocabulary, text)
    return whole.select(
        key,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
