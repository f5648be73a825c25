"""Quality rules: counts of words, symbols and repeats, and divergence from language references.

All of it is built-in expressions on one row at a time; only histograms by language are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, lookup_join, whole_text
from quire.session import materialize

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"

#: Very common words of the languages that have a reference. Fixed values.
COMMON = {
    "en": "the of and to in a is that for it with as on are be at this by an not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
}
#: Character classes; what is in none of them is other punctuation.
CLASSES = {
    "upper": "A-Z",
    "lower": "a-z",
    "digit": "0-9",
    "space": SPACE,
    "symbol": SYMBOLS,
    "wide": "\\x80-\\x{10FFFF}",
}

#: A text needs so many words, and so many characters, before its histograms are compared.
LEAST_WORDS, LEAST_CHARS = 80, 400
#: Jensen-Shannon distances (0 to 1) of character classes and of common words beyond which a text is
#: rejected, and those within which it counts for the next references.
MOST_DISTANCE = (0.2, 0.4)
TRIMS = ((0.25, 0.45), (0.16, 0.4))


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; linear but for two sorts.

    Windows are sorted by half of a hash with their place; only those with an equal neighbour, few in
    ordinary text, are then sorted by their words, which settles what the hash may have confused.
    """

    def beside(sorted_: Column, part) -> Column:
        equal = lambda x, y: part(x) == part(y)
        return F.filter(
            sorted_, lambda x, k: equal(x, F.get(sorted_, k + 1)) | equal(x, F.get(sorted_, k - 1))
        )

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def hashed(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 32).bitwiseOR(
                    i.cast("bigint")
                ),
            )
        )

    def exact(w: Column, near: Column) -> Column:
        return F.sort_array(
            F.transform(
                near,
                lambda key: F.struct(
                    F.concat_ws(" ", F.get(w, place(key)), F.get(w, place(key) + 1), F.get(w, place(key) + 2)).alias("g"),
                    place(key).alias("i"),
                ),
            )
        )

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    def counted(w: Column) -> Column:
        near = let(hashed(w), lambda keys: beside(keys, lambda key: F.shiftright(key, 32)))
        twice = let(near, lambda n: let(exact(w, n), lambda e: beside(e, lambda x: x["g"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(starts, covered))

    return let(words, counted)


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, the counts, character-class counts and common-word counts (arrays).

    A null text counts as empty. The language decides which common words are counted; a null or
    unknown language has none. Columns other than doc_id, text and lang play no part.
    """
    known = F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    text = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), whole_text().alias("text")
    ).withColumn("words", words_of(F.col("text")))

    def histogram(hits: Column, common: Column) -> Column:
        return F.transform(common, lambda v: F.size(F.filter(hits, lambda x: x == v)))

    def found(common: Column) -> Column:
        lowered = F.transform(F.col("words"), lambda w: F.lower(w))
        return let(F.filter(lowered, lambda w: F.array_contains(common, w)), lambda h: histogram(h, common))

    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    counts = text.select(
        "doc_id",
        "lang",
        F.length("text").alias("n_chars"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.array(*(_count(F.col("text"), c).cast("bigint") for c in CLASSES.values())).alias("classes"),
        F.coalesce(let(known[F.col("lang")], found), F.array().cast("array<int>")).cast("array<bigint>").alias("common"),
    )
    rest = lambda part, of: F.concat(part, F.array(F.col(of) - F.aggregate(part, F.lit(0).cast("bigint"), lambda a, b: a + b)))
    return counts.withColumn("classes", rest(F.col("classes"), "n_chars")).withColumn(
        "common", rest(F.col("common"), "n_words")
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(rows: DataFrame) -> DataFrame:
    """``lang, class_ref, common_ref``: summed histograms of all documents that pass the base rules."""
    sound = rows.where(~F.col("base_failed"))
    widths = {"classes": len(CLASSES) + 1, "common": max(map(len, COMMON.values())) + 1}
    sums = sound.groupBy("lang").agg(
        *(
            F.sum(F.get(name, F.lit(i)).cast("double")).alias(f"{name}_{i}")
            for name, width in widths.items()
            for i in range(width)
        )
    )
    return sums.select(
        F.col("lang"),
        *(
            F.array(*(F.coalesce(f"{name}_{i}", F.lit(0.0)) for i in range(width))).alias(f"{name}_ref")
            for name, width in widths.items()
        ),
    )


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two count arrays; null if either is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def divergence(x: Column, y: Column) -> Column:
        parts = F.zip_with(x, y, lambda p, q: term(p, q) + term(q, p))
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2

    def shares(x: Column, n: Column) -> Column:
        return F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)) / n)

    na, nb = total(a), total(b)
    return F.when(
        (na > 0) & (nb > 0), F.sqrt(F.greatest(divergence(shares(a, na), shares(b, nb)), F.lit(0.0)))
    )


def compared(rows: DataFrame, sound: DataFrame) -> DataFrame:
    """``rows`` with class_distance and common_distance to the references of ``sound``."""
    joined = lookup_join(rows, materialize(references(sound)), ["lang"])
    enough = (F.col("n_words") >= LEAST_WORDS) & (F.col("n_chars") >= LEAST_CHARS)
    width = F.size("common")
    common_ref = F.slice(F.col("common_ref"), F.lit(1), width)
    return joined.select(
        *rows.columns,
        F.when(enough, js_distance(F.col("classes"), F.col("classes_ref"))).alias("class_distance"),
        F.when(enough & (width > 1), js_distance(F.col("common"), common_ref)).alias("common_distance"),
    )


def _far(limits: tuple[float, float]) -> Column:
    return (F.coalesce("class_distance", F.lit(0.0)) > limits[0]) | (
        F.coalesce("common_distance", F.lit(0.0)) > limits[1]
    )


def judged(docs: DataFrame) -> DataFrame:
    """Counts of ``measured`` with base_failed, class_distance, common_distance and kept.

    References are taken from all documents that pass the base rules, then again from those near the
    first references, so that junk does not colour what it is held against. Texts shorter than the
    guards are not compared, nor are texts of a language without any sound document; their distances
    are null and only the base rules judge them. Repeated rows are judged alike, each giving a row. No
    rows give no rows.
    """
    rows = materialize(measured(docs))
    sound = rows
    for limits in TRIMS:
        sound = compared(rows, sound).where(~_far(limits)).select(*rows.columns)
    last = compared(rows, sound)
    return last.withColumn("kept", ~F.col("base_failed") & ~_far(MOST_DISTANCE))
