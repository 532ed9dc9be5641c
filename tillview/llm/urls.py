"""Url filter: rules first, then naive Bayes over the words of host and path.

Host names glue words together. A unigram model splits every label into words along
the most probable path (Viterbi); a multinomial naive Bayes model scores the words of
host and path. Words, words per class and class priors are counted over all urls; the
driver and the broadcast hold the MODEL_WORDS most frequent words, rarer ones count as
unknown. The rows carry no labels: a url is a positive example if one of its plain tokens
is a seed word.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed with score 0. The longest rule wins, equal lengths by name. Repeated
rows get equal results; null ids are judged like others. An empty table gives an empty
result. Columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.llm.common import append_columns, named
from tillview.sources.scratch import materialize

#: Distinct words of a model, at most; the most frequent ones.
MODEL_WORDS = 200_000
#: Labels whose words a worker remembers; bounds memory, not results.
REMEMBERED_LABELS = 200_000
LONGEST_WORD = 24
# fixed values: words that mark a positive example, and common words of host names
SEED_WORDS = (
    "adult ads advert bet bets betting bitcoin bonus casino cheap clickbait crack dating escort farm forex free gamble "
    "gambling hack jackpot keygen lottery loan loans malware nude payday phish phishing pill pills poker porn replica sex "
    "slot slots spam track tracker tracking viagra virus warez win winner xxx"
).split()
COMMON_WORDS = (
    "about academy all and api app apps art auto bank best blog book books box business buy care center city cloud club "
    "code com company daily data design digital direct docs education en example express family finance food for forum "
    "games global go green group guide health help home host house info is it job jobs lab law life live local mail map "
    "market media mobile money music my net network new news now of office online open org our page park people phone "
    "photo pro school science service shop site social solutions sport store studio support tech the time to top trade "
    "travel tv video web wiki work world www your"
).split()
SPLIT = re.compile(r"[^a-z0-9\x80-\U0010ffff]+")
DIGITS = re.compile(r"[0-9]+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_choice(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def plain_tokens(value: str) -> list[str]:
    return [DIGITS.sub("0", t) for t in SPLIT.split(value.lower()) if t]


@dataclass
class UrlModel:
    """Word costs for the segmentation, and log odds of each word."""

    words: dict[str, float]
    unknown: float
    odds: dict[str, float]
    unseen: float
    prior: float
    memory: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def cost(self, word: str) -> float:
        """Bits of a word; an unknown one pays for each character."""
        known = self.words.get(word)
        return known if known is not None else self.unknown + 3.4 * len(word)

    def split(self, label: str) -> list[str]:
        """The cheapest division of a label into words; the longer last word wins a tie."""
        found = self.memory.get(label)
        if found is None:
            best, back = [0.0], [0]
            for end in range(1, len(label) + 1):
                # an unknown stretch of any length is one word, known words are short
                options = [(best[start] + self.cost(label[start:end]), start) for start in range(max(0, end - LONGEST_WORD), end)]
                value, start = min(options)
                best.append(value)
                back.append(start)
            found, end = [], len(label)
            while end:
                found.append(label[back[end] : end])
                end = back[end]
            found.reverse()
            if len(self.memory) >= REMEMBERED_LABELS:
                self.memory.clear()
            self.memory[label] = found
        return found

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for label in plain_tokens(host) for w in self.split(label)] + plain_tokens(path)

    def score(self, host: str, path: str) -> float:
        """Probability of the positive class."""
        if not host:
            return 0.0
        total = self.prior + sum(self.odds.get(t, self.unseen) for t in self.tokens(host, path))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def _segmenter(counts: Counter, total: int, urls: int, prior: float) -> UrlModel:
    """The word costs from counts of plain tokens; ``total`` is their sum, those of words beyond ``counts`` included."""
    vocabulary = Counter(counts)
    for word in COMMON_WORDS + SEED_WORDS:
        vocabulary[word] += max(1, urls // 50)
        total += max(1, urls // 50)
    words = {w: -math.log2(c / total) for w, c in vocabulary.items()}
    return UrlModel(words, math.log2(total + 1), {}, 0.0, prior)


def _with_odds(model: UrlModel, by_class: dict[bool, Counter], sums: dict[bool, int], distinct: int, seeds: int) -> UrlModel:
    """``model`` with the log odds of the words of ``by_class``; sums and distinct cover all words.

    A seed counts as if ``seeds`` more positive urls had it.
    """
    held = {c: Counter(by_class[c]) for c in by_class}
    distinct += len(set(SEED_WORDS) - set(held[True]) - set(held[False]))
    for word in SEED_WORDS:
        held[True][word] += seeds
    sizes = {c: sums[c] + seeds * len(SEED_WORDS) * c + distinct + 1 for c in held}
    every = set(held[True]) | set(held[False])
    model.odds = {w: math.log((held[True][w] + 1) / sizes[True]) - math.log((held[False][w] + 1) / sizes[False]) for w in every}
    model.memory.clear()
    return model


def _prior(positives: int, negatives: int) -> float:
    return math.log((positives + 1) / (negatives + 1))


def is_word(token: str, count: int) -> bool:
    """A glued name is no word of its own: rare unknown names shouldn't outweigh their parts."""
    return count > 1 and len(token) > 1


def fit(examples: list[tuple[str, str, bool]], positives: int, negatives: int) -> UrlModel:
    """Both models from labelled (host, path) pairs; the counts of all rows give the prior."""
    counts = Counter(t for host, path, _ in examples for t in plain_tokens(host) + plain_tokens(path))
    counts = Counter({w: c for w, c in counts.items() if is_word(w, c)})
    model = _segmenter(counts, sum(counts.values()), len(examples), _prior(positives, negatives))
    by_class: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for host, path, positive in examples:
        by_class[positive].update(model.tokens(host, path))
    sums = {c: sum(by_class[c].values()) for c in by_class}
    return _with_odds(model, by_class, sums, len(set(by_class[True]) | set(by_class[False])), 1 + len(examples) // 50)


def _tally(marked: DataFrame, splitter: Callable[[], Callable[[str, str], list[str]]], name: str) -> DataFrame:
    """(token, yes, no): how often the tokens of all urls stand in either class; batches are summed up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = splitter()
        for batch in batches:
            met: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for host, path, positive in zip(*(c.to_pylist() for c in batch.columns)):
                met[positive].update(tokens(host, path))
            every = list(met[True] | met[False])
            counts = [pa.array([met[c][t] for t in every], pa.int64()) for c in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *counts], names=["token", "yes", "no"])

    met = marked.select("host", "path", "positive").mapInArrow(run, "token string, yes bigint, no bigint")
    return materialize(met.groupBy("token").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), name)


def _most_frequent(words: DataFrame) -> list:
    """The MODEL_WORDS most frequent words; seeds and common words come first."""
    fixed = F.col("token").isin(*COMMON_WORDS, *SEED_WORDS)
    return words.orderBy(fixed.desc(), (F.col("yes") + F.col("no")).desc(), "token").limit(MODEL_WORDS).collect()


def learn(pages: DataFrame, url: str = "url") -> UrlModel:
    """The models of a table of urls, counted over all rows."""
    host, path = url_parts(named(url))
    seeds = "|".join(SEED_WORDS)
    parts = pages.select(host.alias("host"), path.alias("path")).where(F.col("host") != "")
    marked = parts.withColumn(
        "positive", F.concat_ws("/", "host", F.lower("path")).rlike(rf"(^|[^a-z0-9])({seeds})([^a-z0-9]|$)")
    )
    sizes = {r["positive"]: r["count"] for r in marked.groupBy("positive").count().collect()}
    positives, negatives = sizes.get(True, 0), sizes.get(False, 0)

    plain = _tally(marked, lambda: lambda host, path: plain_tokens(host) + plain_tokens(path), "url-tokens")
    words = plain.where((F.col("yes") + F.col("no") > 1) & (F.length("token") > 1))
    total = words.agg(F.sum(F.col("yes") + F.col("no"))).first()[0] or 0
    counts = Counter({r["token"]: r["yes"] + r["no"] for r in _most_frequent(words)})
    model = _segmenter(counts, total, positives + negatives, _prior(positives, negatives))

    shared = pages.sparkSession.sparkContext.broadcast(vars(model))
    split = _tally(marked, lambda: UrlModel(**shared.value).tokens, "url-words")
    sums = split.agg(F.sum("yes"), F.sum("no"), F.count("*")).first()
    rows = _most_frequent(split)
    by_class = {True: Counter({r["token"]: r["yes"] for r in rows}), False: Counter({r["token"]: r["no"] for r in rows})}
    # the classes are seldom of one size: seeds are measured by the positive one
    return _with_odds(model, by_class, {True: sums[0] or 0, False: sums[1] or 0}, sums[2], 1 + positives // 25)


def judge(pages: DataFrame, model: UrlModel, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``.

    The model, bounded by MODEL_WORDS, is broadcast.
    """
    shared = pages.sparkSession.sparkContext.broadcast({"model": vars(model)})
    host, path = url_parts(named(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    parts = pages.select(*map(named, kept), host.alias("host"), path.alias("path"))

    def make(hosts: pa.Array, paths: pa.Array) -> list[pa.Array]:
        state = shared.value
        if "built" not in state:
            state["built"] = UrlModel(**state["model"])
        score = state["built"].score
        return [pa.array([score(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())], pa.float64())]

    scored = append_columns(parts, ["host", "path"], [T.StructField("block_score", T.DoubleType())], make)
    rule, verdict = rule_choice(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_method)})
