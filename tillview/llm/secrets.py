"""Secrets in text: fixed patterns, and tokens that pass a battery of randomness tests.

The patterns give the base spans. Further tokens of 20 and more characters get an
encoding (the smallest alphabet that holds them) and three tests: chi-squared against
a uniform alphabet, runs above and below the middle of the alphabet, and serial
correlation of neighbours. A token that any test finds non-random at TEST_LEVEL is
dropped. For the others the chi-squared statistic is held against what words of the
same length give: word-like text has a known unevenness, so its statistic follows a
noncentral chi-squared law whose centre grows with the length. The left tail is the
token's p-value. In the small alphabets (upper-case hex, base32, letters of one case with
digits) that statistic can't tell short random tokens from words; there the likelihood
ratio of the uniform alphabet against letters as frequent as in words, with a share of digits,
gives the p-value. Either way short tokens, for which the tests have no power, cannot pass. The
Benjamini-Hochberg rule over the document's tokens outside base spans holds the share of false
discoveries at FALSE_DISCOVERIES.

Defined cases: a null text counts as empty and gives zero counts, the digest of an
empty string and empty spans. Texts are scanned whole. Repeated rows give equal
results. An added span that overlaps a base span is left out. Columns named like a
result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillview.llm.common import append_columns

# fixed values: the base patterns, in the order that breaks ties
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, so shorter runs can be passed over
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
# fixed values: alphabets by size, and the chance that two letters of a word agree
HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LOWER36 = "0123456789abcdefghijklmnopqrstuvwxyz"
UPPER36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE64_URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
SLUG_LOWER = LOWER36 + "-_"
SLUG_UPPER = UPPER36 + "-_"
ENCODINGS = [HEX_LOWER, HEX_UPPER, BASE32, LOWER36, UPPER36, SLUG_LOWER, SLUG_UPPER, BASE62, BASE64, BASE64_URL]
WORD_AGREEMENT = 0.065
# fixed values: letters A to Z in words, per 1,000; the digits of word-like tokens
LETTERS = dict(
    zip(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7),
    )
)
WORD_DIGITS = 0.25
# how the likelihood varies in joined words with numbers, against independent letters; set so that
# one in a hundred of them, and two of joined hexadecimal words, reach 0.01
WORD_SPREAD, HEX_SPREAD = 0.6, 2.3
#: No single letter weighs more than if words had it this often.
RAREST = 0.01
TEST_LEVEL = 0.001
FALSE_DISCOVERIES = 0.01
FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("n_random", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def normal_tail(z: float) -> float:
    """Both tails of a standard normal value."""
    return math.erfc(abs(z) / math.sqrt(2))


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_squared_below(x: float, freedom: float, centre: float) -> float:
    """Left tail of a noncentral chi-squared law, by Sankaran's normal approximation."""
    mean, twice = freedom + centre, freedom + 2 * centre
    h = 1 - 2 * mean * (freedom + 3 * centre) / (3 * twice**2)
    p = twice / mean**2
    m = (h - 1) * (1 - 3 * h)
    z = ((max(x, 1e-9) / mean) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (
        h * math.sqrt(2 * p) * (1 + 0.5 * m * p)
    )
    return normal_below(z)


def word_ratios(alphabet: str) -> tuple[dict[str, float], float, float]:
    """Log likelihood ratio of each character, uniform against word-like; its mean and variance in words."""
    letters = [c for c in alphabet if c.isalpha()]
    weights = {c: max(LETTERS[c.upper()] / 1000, RAREST) for c in letters}
    whole, digits = sum(weights.values()), len(alphabet) - len(letters)
    share = {c: (1 - WORD_DIGITS) * weights[c] / whole if c in weights else WORD_DIGITS / digits for c in alphabet}
    ratios = {c: -math.log(len(alphabet) * f) for c, f in share.items()}
    mean = sum(share[c] * x for c, x in ratios.items())
    spread = HEX_SPREAD if alphabet == HEX_UPPER else WORD_SPREAD
    return ratios, mean, spread * sum(share[c] * (x - mean) ** 2 for c, x in ratios.items())


WORD_RATIOS = {a: word_ratios(a) for a in (HEX_UPPER, BASE32, LOWER36, UPPER36)}


def battery(token: str) -> float | None:
    """The p-value against word-like text, or None if the token isn't random in its own alphabet."""
    body = token.rstrip("=")
    used = set(body)
    alphabet = next((a for a in ENCODINGS if used <= set(a)), None)
    if alphabet is None or not (used & set("0123456789")) or len(used) < 8:
        return None
    n, k = len(body), len(alphabet)
    counts = Counter(body)
    chi = sum(c * c for c in counts.values()) * k / n - n
    if 1 - chi_squared_below(chi, k - 1, 0.0) < TEST_LEVEL:
        return None
    place = {c: i for i, c in enumerate(alphabet)}
    values = [place[c] for c in body]
    high = [v >= k / 2 for v in values]
    ups = sum(high)
    if ups in (0, n):
        return None
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    expected = 2 * ups * (n - ups) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    if spread > 0 and normal_tail((runs - expected) / math.sqrt(spread)) < TEST_LEVEL:
        return None
    mean = sum(values) / n
    around = sum((v - mean) ** 2 for v in values)
    serial = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / around if around else 1.0
    if normal_tail((serial + 1 / n) * math.sqrt(n)) < TEST_LEVEL:
        return None
    if alphabet in WORD_RATIOS:
        ratios, mean, variance = WORD_RATIOS[alphabet]
        return normal_below((n * mean - sum(ratios[c] for c in body)) / math.sqrt(n * variance))
    uneven = n * max(0.0, WORD_AGREEMENT * k - 1) if k > 16 else n * 0.5
    return chi_squared_below(chi, k - 1, uneven)


def discoveries(p_values: list[float]) -> list[bool]:
    """Benjamini-Hochberg over one family."""
    order = sorted(range(len(p_values)), key=p_values.__getitem__)
    last = max((r for r, i in enumerate(order, 1) if p_values[i] <= FALSE_DISCOVERIES * r / len(p_values)), default=0)
    found = [False] * len(p_values)
    for i in order[:last]:
        found[i] = True
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]]))


def random_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that the battery finds, outside the spans already taken."""
    tested = []
    for m in TOKEN.finditer(text):
        if any(m.start() < e and s < m.end() for s, e, _ in taken):
            continue
        p = battery(m[0])
        if p is not None:
            tested.append((*m.span(), p))
    found = discoveries([p for _, _, p in tested])
    return [
        (start, end, "random")
        for (start, end, _), kept in zip(tested, found)
        if kept
    ]


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of one text, each sorted by start and kind."""
    base = base_spans(text)
    added = random_spans(text, base)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS[s[2]])) if added else base


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts by kind, the digest of the base spans and all spans; offsets in code points."""

    def make(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for value in texts.to_pylist():
            base, spans = scan_text(value or "")
            kinds = Counter(kind for _, _, kind in spans)
            digest = hashlib.sha256(shown(base).encode()).hexdigest()
            rows.append((kinds["assign"], kinds["access"], kinds["hex"], kinds["random"], digest, shown(spans)))
        columns = list(zip(*rows)) or [()] * len(FIELDS)
        return [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.string(), pa.string()])]

    return append_columns(docs, [text], FIELDS, make)
