"""License scans by a positional index of rare words.

Templates (licence notices) are indexed by position of their words of highest inverse document frequency.
A document looks up all its indexed words; template postings vote for (template, relative position), and
a vote of enough words in line, with the template's mandatory phrases at their places there, is a finding.
Of templates that are found in one place the one that fits best counts. Everything happens within the
document's row; only document frequencies are gathered.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, totals_before, whole_text
from quire.llm.license_texts import TEMPLATES

#: What stands between words (ASCII other than letters and digits).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases and the labels they always give. Fixed values.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Words of highest IDF that a template is indexed by.
INDEXED = 12
#: Share of a template's rare words that must stand in line.
LEAST_VOTES = 0.6
#: Words by which a mandatory phrase may have moved from its place, as where others were put in.
MOVED = 4


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]


VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in _words(notice)})


def phrase_places(notice: str, phrases: list[str]) -> list[tuple[int, list[str]]]:
    """Word position of each mandatory phrase in its notice, and its words."""
    words, out = _words(notice), []
    for phrase in phrases:
        own = phrase.split()
        out.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
    return out


PLACES = [phrase_places(notice, phrases) for _, notice, phrases in TEMPLATES]


def normalized(text: Column) -> Column:
    """Words joined by single spaces; case is left as it is."""
    return F.btrim(F.regexp_replace(text, SEPARATORS, " "))


def phrase_pattern(phrase: str) -> str:
    """Places of a phrase in normalised text, ASCII letters in either case."""
    return f"(?i)(?<![^ ]){phrase}(?![^ ])"


def _n_words(norm: Column) -> Column:
    spaces = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(norm == "", 0).otherwise(spaces + 1).cast("bigint")


def phrase_starts(norm: Column, phrase: str) -> Column:
    """Word positions (from 0) at which the phrase's words stand one after another."""
    n = len(phrase.split())

    def starts(parts: Column) -> Column:
        # Words before a place: those of the parts before it and of the phrases between them.
        words = F.transform(parts, lambda p: F.when(F.btrim(p) == "", 0).otherwise(F.size(F.split(F.btrim(p), " "))))
        before = totals_before(F.transform(words, lambda k: k + n))
        return F.transform(F.slice(before, F.lit(2), F.size(before) - 1), lambda at: (at - n).cast("int"))

    found = F.split(norm, phrase_pattern(phrase), -1)
    return F.when(norm.rlike(phrase_pattern(phrase)), let(found, starts)).otherwise(F.array().cast("array<int>"))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each licence word: at most one count a word is gathered."""
    hits = F.array_intersect(F.split(F.lower(normalized(whole_text())), " "), F.array(*map(F.lit, VOCABULARY)))
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), hits)).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}
    return counts.pop("", 0), counts


class Index:
    """Postings of the templates' rare words, given the corpus's document frequencies."""

    def __init__(self, n: int, frequencies: dict[str, int]) -> None:
        # However common a notice is, its rarest words stay indexed.
        self.idf = {w: math.log((n + 1) / (frequencies.get(w, 0) + 1)) for w in VOCABULARY}
        self.postings: dict[str, list[int]] = {w: [] for w in self.idf}
        self.needed: list[int] = []
        self.rare: list[int] = []
        for t, (_, notice, _) in enumerate(TEMPLATES):
            words = _words(notice)
            best = sorted(set(words), key=lambda w: (-self.idf[w], w))[:INDEXED]
            for at, w in enumerate(words):
                if w in best:
                    # template and place in one number; a document's place is subtracted from it
                    self.postings[w].append((t << 40) + (1 << 39) + at)
            lined = sum(w in best for w in words)
            self.rare.append(lined)
            self.needed.append(max(1, math.ceil(LEAST_VOTES * lined)))


def _votes(norm: Column, index: Index) -> Column:
    """Sorted array of template-and-offset votes of all indexed words of the document."""
    ranked = [w for w in VOCABULARY if index.postings.get(w)]
    postings = F.create_map(*(x for w in ranked for x in (F.lit(w), F.array(*map(F.lit, index.postings[w])).cast("array<bigint>"))))

    def votes(words: Column) -> Column:
        looked_up = F.array_intersect(F.array(*map(F.lit, ranked)), words)

        def of(best: Column) -> Column:
            placed = F.transform(words, lambda w, i: F.when(F.array_contains(best, w), F.struct(w.alias("w"), i.alias("i"))))
            return F.flatten(
                F.transform(
                    F.filter(placed, lambda p: p.isNotNull()),
                    lambda p: F.transform(postings[p["w"]], lambda key: key - p["i"]),
                )
            )

        return F.when(F.size(looked_up) > 0, F.sort_array(let(looked_up, of)))

    return F.coalesce(let(F.split(F.lower(norm), " "), votes), F.array().cast("array<bigint>"))


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, findings.

    findings lists (label, share of the template's rare words in line, word offset). Of findings that
    overlap by more than half of the shorter template only the best counts: by share, then by how little
    its phrases have moved, then by length. score is the best share of a finding, 0 without one. A null or empty text has no words and no findings;
    repeated rows give equal rows; columns other than doc_id and text play no part.
    """
    if not VOCABULARY:
        raise ValueError("no templates")
    index = Index(*document_frequencies(docs))
    rows = docs.select("doc_id", normalized(whole_text()).alias("norm"))
    for i, phrase in enumerate(PHRASES):
        rows = rows.withColumn(f"_p{i}", phrase_starts(F.col("norm"), phrase))
    rows = rows.withColumn("_votes", _votes(F.col("norm"), index))

    def lined(votes: Column) -> Column:
        """(template, votes, offset) of every run of equal votes that is long enough."""
        ends = F.filter(
            F.transform(votes, lambda v, k: F.struct(v.alias("v"), k.alias("k"))),
            lambda x: ~x["v"].eqNullSafe(F.get(votes, x["k"] + 1)),
        )
        return let(
            ends,
            lambda e: F.transform(
                e,
                lambda x, j: F.struct(
                    F.shiftright(x["v"], 40).cast("int").alias("t"),
                    (x["k"] - F.coalesce(F.get(e, j - 1)["k"], F.lit(-1))).alias("n"),
                    (F.lit((1 << 39)) - x["v"].bitwiseAND(F.lit((1 << 40) - 1))).alias("offset"),
                ),
            ),
        )

    names = [label for label, _, _ in TEMPLATES]
    needed, rare = (F.array(*map(F.lit, x)) for x in (index.needed, index.rare))
    none = F.array().cast("array<struct<t:int,n:int,offset:bigint>>")
    enough = F.filter(let(F.col("_votes"), lined), lambda x: x["n"] >= F.get(needed, x["t"]))
    rows = rows.withColumn("_enough", F.when(F.size("_votes") > 0, enough).otherwise(none))
    checked = let(F.split(F.lower("norm"), " "), lambda words: _placed(F.col("_enough"), words, rare))
    rows = rows.withColumn("_placed", F.when(F.size("_enough") > 0, checked).otherwise(F.array().cast(_PLACED)))
    best = let(F.col("_placed"), lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: _beats(y, x))))
    rows = rows.withColumn("_best", F.when(F.size("_placed") > 0, best).otherwise(F.array().cast(_PLACED)))
    findings = F.transform(
        "_best",
        lambda x: F.struct(
            F.get(F.array(*map(F.lit, names)), x["t"]).alias("label"), x["fit"]["share"].alias("share"), x["offset"].alias("offset")
        ),
    )
    places = [F.col(f"_p{i}") for i in range(len(PHRASES))]
    base = F.array_sort(
        F.array_distinct(
            F.flatten(F.array(*(
                F.when(F.size(p) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
                for p, label in zip(places, PHRASES.values())
            )))
        )
    )
    rows = rows.withColumn("findings", findings).withColumn("_base", base).withColumn("_all", F.flatten(F.array(*places)))
    return rows.select(
        "doc_id",
        _n_words(F.col("norm")).alias("n_words"),
        F.size("_all").cast("bigint").alias("n_base"),
        F.array_min("_all").cast("bigint").alias("first_word"),
        F.array_max("_all").cast("bigint").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("_base"), F.transform("findings", lambda f: f["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["share"])), F.lit(0.0)).alias("score"),
        "findings",
    )


_PLACED = "array<struct<t:int,offset:bigint,length:int,fit:struct<share:double,moved:int,words:int,t:int>>>"


def _placed(enough: Column, words: Column, rare: Column) -> Column:
    """Findings whose mandatory phrases stand at their places, or have moved by up to ``MOVED`` words."""
    phrase = "array<array<struct<at:int,words:array<string>>>>"
    listed = F.array(
        *(F.array(*(F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, own)).alias("words")) for at, own in places)) for places in PLACES)
    ).cast(phrase)
    lengths = F.array(*(F.lit(len(_words(notice))) for _, notice, _ in TEMPLATES))

    def stands(x: Column, p: Column, away: Column) -> Column:
        start = x["offset"] + p["at"] + away
        there = F.slice(words, F.greatest(start + 1, F.lit(1)).cast("int"), F.size(p["words"]))
        return (start >= 0) & (there == p["words"])

    def moved(x: Column) -> Column:
        """Words by which the phrase farthest from its place has moved; null where one is missing."""
        ways = F.array(*(F.lit(d) for d in sorted(range(-MOVED, MOVED + 1), key=abs)))
        each = F.transform(
            F.get(listed, x["t"]), lambda p: F.abs(F.get(F.filter(ways, lambda d: stands(x, p, d)), F.lit(0)))
        )
        return F.when(F.forall(each, lambda d: d.isNotNull()), F.coalesce(F.array_max(each), F.lit(0)))

    measured = F.transform(enough, lambda x: F.struct(x.alias("x"), moved(x).alias("moved")))
    return F.transform(
        F.filter(measured, lambda m: m["moved"].isNotNull()),
        lambda m: F.struct(
            m["x"]["t"].alias("t"),
            m["x"]["offset"].alias("offset"),
            F.get(lengths, m["x"]["t"]).alias("length"),
            F.struct(
                F.least(m["x"]["n"] / F.get(rare, m["x"]["t"]), F.lit(1.0)).alias("share"),
                (-m["moved"]).alias("moved"),
                F.get(lengths, m["x"]["t"]).alias("words"),
                (-m["x"]["t"]).alias("t"),
            ).alias("fit"),
        ),
    ).cast(_PLACED)


def _beats(y: Column, x: Column) -> Column:
    """Whether finding ``y`` fits better than ``x`` and the shorter of the two lies within the other or begins with it."""
    overlap = F.least(x["offset"] + x["length"], y["offset"] + y["length"]) - F.greatest(x["offset"], y["offset"])
    return (y["fit"] > x["fit"]) & (2 * overlap > F.least(x["length"], y["length"]))
