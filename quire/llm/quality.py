"""Quality classifier without hand labels: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the
counts of vote patterns estimates how accurate each labeller is, and with that a posterior for every
pattern. The posteriors of a bounded sample train a logistic scorer on hashed features, which then
scores all documents, also those on which every labeller abstains.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import MEMORIES, map_rows, prepare
from quire.llm.rules import COMMON

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Documents, drawn by a hash of id and text, that the scorer is trained on (on average no more); all
#: others are only scored.
TRAIN_ROWS = 8_000
BUCKETS = 1 << 14
ROUNDS, STEPS = 100, 200
#: Score from which a document is kept.
KEEP = 0.5

_COMMON = frozenset(w for words in COMMON.values() for w in words)
_SHAPE = str.maketrans(
    {**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{str(d): "0" for d in range(10)}}
)
_RUNS = re.compile(r"(.)\1+", re.S)
_LETTERS = re.compile(r"[^\W\d_]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")
#: Words a Python worker remembers the properties of; they hold no more than speed.
REMEMBERED = 300_000


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


_ENDS = ".,;:?"
#: Shapes of lower-case and capitalised words with one such end or none.
_SHAPES = {(t, e): _bucket(f"s {'Aa' if t else 'a'}{e}") for t in (False, True) for e in ("", *_ENDS)}


class Lexicon:
    """Numbers words as they are met, and keeps what labellers and features ask of each."""

    COLUMNS = ("word", "shape", "letters", "capitals", "symbol", "common", "digit", "length")

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.COLUMNS)), np.int64)

    def _properties(self, word: str) -> tuple[int, ...]:
        end = "" if word[-1] not in _ENDS else word[-1]
        core = word[:-1] if end else word
        if core.isalpha() and (core.islower() or core[1:].islower()):  # most words, of any script
            title = not core.islower()
            lower = core.lower() if title else core
            return (
                _bucket(f"w {lower}{end}"),
                _SHAPES[title, end],
                len(core),
                int(title),
                False,
                lower in _COMMON,
                False,
                len(word),
            )
        return (
            _bucket(f"w {word.lower()}"),
            _bucket("s " + _RUNS.sub(r"\1", word.translate(_SHAPE))),
            len(_LETTERS.findall(word)),
            len(_CAPITALS.findall(word)),
            word[-1] in "#*$%&|<>!~^=@",
            word.strip(".,;:!?\"'()").lower() in _COMMON,
            _DIGIT.search(word) is not None,
            len(word),
        )

    def number(self, words: list[str]) -> np.ndarray:
        if len(self.numbers) > REMEMBERED:
            self.__init__()
        found = list(map(self.numbers.get, words))
        if None in found:
            new = list({w for w, n in zip(words, found) if n is None})
            first = len(self.numbers)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = [self._properties(w) for w in new]
            self.numbers.update(zip(new, range(first, first + len(new))))
            found = list(map(self.numbers.__getitem__, words))
        return np.array(found, np.int64)


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


MEMORIES[__name__] = lexicon.cache_clear


def _votes_below(value: float, good: float, bad: float) -> int:
    """Good up to one bound, bad from another on."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


@dataclass
class Measures:
    """What the labellers look at, from one pass over a text's words, and the words' properties."""

    n: int
    upper: float = 0.0  # capitals among letters
    symbols: float = 0.0  # words that end in or are a symbol
    common: float = 0.0  # very common words among words
    beside: float = 0.0  # words equal to the word before
    distinct: float = 0.0  # distinct words among the words
    length: float = 0.0  # mean characters of a word
    lines: float = 0.0  # non-blank lines equal to an earlier one
    digits: float = 0.0  # words that hold a digit
    words: np.ndarray | None = None  # properties of each distinct word
    counts: np.ndarray | None = None  # its number of places

    @classmethod
    def of(cls, text: str) -> Measures:
        split = text.split()
        n = len(split)
        if not n:
            return cls(0)
        known = lexicon()
        numbers = known.number(split)
        distinct, counts = np.unique(numbers, return_counts=True)
        words = known.table[distinct]
        total = dict(zip(Lexicon.COLUMNS, (counts @ words).tolist()))
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        return cls(
            n,
            total["capitals"] / (total["letters"] or 1),
            total["symbol"] / n,
            total["common"] / n,
            float((numbers[1:] == numbers[:-1]).sum()) / n,
            len(distinct) / n,
            total["length"] / n,
            1 - len(set(lines)) / len(lines),
            total["digit"] / n,
            words,
            counts,
        )

    def votes(self) -> tuple[int, ...]:
        if self.n < 3:
            return (ABSTAIN,) * N_LABELLERS
        long = self.n >= 20
        return (
            _votes_below(self.upper, 0.15, 0.5),
            _votes_below(self.symbols, 0.05, 0.2),
            _votes_below(-self.common, -0.1, -0.04) if long else ABSTAIN,
            _votes_below(self.beside, 0.05, 0.25),
            _votes_below(-self.distinct, -0.3, -0.15) if long else ABSTAIN,
            _votes_below(abs(self.length - 6), 2.5, 6),
            _votes_below(self.lines, 0.2, 0.5) if long else ABSTAIN,
            _votes_below(self.digits, 0.1, 0.4) if long else ABSTAIN,
        )

    def bins(self) -> list[str]:
        return [f"{name}:{min(int(getattr(self, name) * 10), 10)}" for name in _BINNED] + [
            f"length:{min(int(self.length), 20)}"
        ]


N_LABELLERS = 8


def pattern_of(votes: tuple[int, ...]) -> int:
    """Votes as one number, three values a labeller."""
    return sum(v * 3**i for i, v in enumerate(votes))


def fit_labellers(counts: dict[int, int]) -> dict[int, float]:
    """Posterior of "good" for each vote pattern, by expectation-maximisation from a majority vote.

    Labellers are taken as independent given the class; abstaining says nothing. Both classes and both
    votes are smoothed. No documents give no posteriors.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns], float)
    votes = np.stack([patterns // 3**i % 3 for i in range(N_LABELLERS)], axis=1)
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    # One objection outweighs the labellers that merely see nothing wrong.
    posterior = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    for _ in range(ROUNDS):
        share = np.clip((posterior @ weight + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6)
        log = np.log([share, 1 - share])[:, None] + np.zeros((2, len(patterns)))
        for i in range(N_LABELLERS):
            for k, p in enumerate((posterior, 1 - posterior)):
                outcome = np.bincount(votes[:, i], weights=weight * p, minlength=3)[:ABSTAIN] + 1
                log[k] += np.append(np.log(outcome / outcome.sum()), 0.0)[votes[:, i]]
        after = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        done = np.abs(after - posterior).max() < 1e-6
        posterior = after
        if done:
            break
    return dict(zip(patterns.tolist(), posterior.tolist()))


_BINNED = ("upper", "symbols", "common", "beside", "distinct", "lines", "digits")
_BINS = {f"{name}:{i}": _bucket(f"{name}:{i}") for name in _BINNED for i in range(11)} | {
    f"length:{i}": _bucket(f"length:{i}") for i in range(21)
}


def features(measures: Measures) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of words, word shapes and binned measures; values have unit length."""
    shapes, which = np.unique(measures.words[:, 1], return_inverse=True)
    often = np.bincount(which, weights=measures.counts)
    bins = [_BINS[b] for b in measures.bins()]
    buckets = np.concatenate([measures.words[:, 0], shapes, bins]).astype(np.int64)
    values = np.sqrt(np.concatenate([measures.counts, often]) / measures.n)
    values = np.concatenate([values, np.ones(len(bins))])
    return buckets, values / np.sqrt(values @ values)


def train(sizes: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic model.

    ``sizes`` tells how many of ``bucket`` and ``value`` belong to each row, ``target`` its posterior.
    """
    weights = np.zeros(BUCKETS + 1)
    n = len(target)
    if not n:
        return weights
    which = np.repeat(np.arange(n, dtype=np.int32), sizes)
    speed = np.full(BUCKETS + 1, 1e-8)
    for _ in range(STEPS):
        margin = np.bincount(which, weights=value * weights[bucket], minlength=n) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        slope = np.append(np.bincount(bucket, weights=value * error[which], minlength=BUCKETS), error.sum()) / n
        slope[:-1] += 1e-5 * weights[:-1]
        speed += slope * slope
        weights -= 0.5 * slope / np.sqrt(speed)
    return weights


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern`` of every row."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {
                "doc_id": batch["doc_id"],
                "pattern": [pattern_of(Measures.of(t or "").votes()) for t in batch["text"]],
            }

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, pattern int")


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the scorer. Pattern counts cover all documents; about ``train_rows`` train it."""
    prepare(docs.sparkSession)
    counted = vote_patterns(docs).groupBy("pattern").count().collect()  # at most 3 ** N_LABELLERS rows
    posterior = fit_labellers({r["pattern"]: r["count"] for r in counted})
    n = sum(r["count"] for r in counted)
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, train_rows / max(n, 1)))
    # Repeated rows are drawn together and train once.
    sample = docs.select("doc_id", "text").where("text is not null").where(drawn).distinct()

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            measured = [m for m in map(Measures.of, batch["text"]) if m.n]
            found = [features(m) for m in measured]
            yield {
                "pattern": [pattern_of(m.votes()) for m in measured],
                "bucket": [f[0] for f in found],
                "value": [f[1] for f in found],
            }

    # Columns of numbers, not rows of objects: a few dozen bytes for each word of the sample.
    seen = map_rows(sample.select("text"), rows, "pattern int, bucket array<int>, value array<float>").toArrow()
    buckets, values = (seen.column(c).combine_chunks() for c in ("bucket", "value"))
    return train(
        np.diff(buckets.offsets.to_numpy()),
        buckets.flatten().to_numpy(),
        values.flatten().to_numpy(),
        np.array([posterior[p] for p in seen.column("pattern").to_pylist()]),
    )


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``kept`` added, in place; nothing is shuffled.

    A text without a word (null, empty, blank) scores 0 and is rejected. Repeated rows are scored
    alike; columns of ``docs`` with these names give way, all others pass through.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    import pandas as pd

    dense = weights.astype("float64")

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                measures = Measures.of(text or "")
                if not measures.n:
                    out.append(0.0)
                    continue
                bucket, value = features(measures)
                margin = float(dense[bucket] @ value) + dense[-1]
                out.append(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))
            yield pd.Series(out, dtype="float64")

    prepare(docs.sparkSession)
    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scorer = pandas_udf(score, "double")
    kept = docs.select(*(c for c in docs.columns if c not in ("quality_score", "kept")))
    return kept.withColumn("quality_score", scorer(F.coalesce(F.col("text"), F.lit("")))).withColumn(
        "kept", F.col("quality_score") >= KEEP
    )
