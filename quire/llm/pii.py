"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

Base spans come from four patterns. They are the seeds of a graph between *contexts* (the word before
an identifier-like token) and *instances* (the token): Spark scores contexts by the share of their
instances that are known identifiers, instances by the contexts they stand in, and again, so that what one
context discovers lets others be discovered. Contexts of high confidence then mark the unseen instances that
follow them. Secrets (keys, tokens, passwords) have no base pattern: long tokens of mixed letters and digits
are their seeds. Nothing but expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, lookup_join, totals_before, whole_text
from quire.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: With the kind that only the method finds.
ALL_KINDS = (*KINDS, "secret")

#: The kinds' patterns. Possessive quantifiers and the look-behinds change no match; they keep the
#: search linear and without recursion in texts of any length.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Identifier-like tokens: digit groups, or words with a digit or an at sign.
CANDIDATE = (
    r"(?<![A-Za-z0-9@._%+-])(?:[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)*+(?![A-Za-z@_%+])"
    r"|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{3,}+)"
)
#: What a discovered instance of a kind must look like, loosely.
SHAPES = {
    "email": r"^[^@\x20]+@[^@\x20]+[A-Za-z0-9]$",
    "ip": r"^[0-9]{1,3}([.-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[\x20.-]?[0-9]){12,18}$",
    "phone": r"^[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}$",
    "secret": r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9._+-]{8,}$",
}
#: Keys that their issuers' format gives away wherever they stand. Public key formats.
KEY_FORMAT = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24,})$"
#: Tokens that look random enough to be seeds of secrets, if they hold this many different characters.
RANDOM = (
    r"^(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,128}"
    r"|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9_-]{20,})$"
)
DIFFERENT = 8
#: Words whose tokens are as random and no secret.
PUBLIC = r"(?<![a-z])(?:commit|revision|rev|sha[0-9]*|md5|hash|checksum|digest|crc|uuid|guid|etag|isbn|doi|id)(?![a-z])"
#: Scoring rounds; confidence and distinct known instances a context needs to discover others.
ROUNDS = 3
CONFIDENT = 0.8
LEAST_KNOWN = 5
#: Confidence a context needs to pass score on to its instances while rounds go on, and the score from
#: which an instance counts as known in the rounds after the first.
WORKING = 0.3
KNOWN = 0.8

#: Types of span arrays.
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_NO_SPANS = "array<struct<start:bigint,end:bigint,value:string,left:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""

    def part(i: Column) -> Column:
        # cast before doubling; every second digit from the right, the last one not doubled
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + part(i)
    )
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)


def found_spans(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches: start, end (code points), value, and the text just before."""

    def spans(values: Column, gaps: Column) -> Column:
        lengths = F.transform(gaps, lambda g, i: F.length(g) + F.coalesce(F.length(F.get(values, i)), F.lit(0)))
        return let(
            totals_before(lengths),
            lambda at: F.transform(
                values,
                lambda v, i: F.struct(
                    (F.get(at, i) + F.length(F.get(gaps, i))).cast("bigint").alias("start"),
                    (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(v)).cast("bigint").alias("end"),
                    v.alias("value"),
                    F.substring_index(F.get(gaps, i), "\n", -1).alias("left"),
                ),
            ),
        )

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    some = text.contains(hint) if hint else text.rlike("[0-9]")
    found = let(matches, lambda v: F.when(F.size(v) > 0, let(F.split(text, pattern, -1), lambda g: spans(v, g))))
    return F.coalesce(F.when(some, found), F.array().cast(_NO_SPANS))


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of a kind; a match that fails its test is dropped without another try."""
    return F.filter(found_spans(text, PATTERNS[kind], HINTS[kind]), lambda s: valid(kind, s["value"]))


def _context(left: Column) -> Column:
    """The word before a token, with punctuation that stands between, lower case, digits and spaces alike; empty
    at a line's start."""
    word = F.regexp_extract(left, r"([^\s\"'(<]{1,64}(?:\s{1,4}[=:>-]{1,2})?)[\s\"'(<]*$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[0-9]", "0"), r"\s+", " ")


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"[().\x20,%+_-]+$", "")


def candidates(rows: DataFrame) -> DataFrame:
    """``doc_id, _row, context, value, start`` of every identifier-like token that follows a word, and of keys."""
    found = F.transform(
        found_spans(F.col("text"), CANDIDATE, None),
        lambda s: F.struct(
            _context(s["left"]).alias("context"), _trimmed(s["value"]).alias("value"), s["start"].alias("start")
        ),
    )
    kept = F.filter(
        found, lambda s: (F.length(s["value"]) >= 5) & ((s["context"] != "") | s["value"].rlike(KEY_FORMAT))
    )
    return rows.select("doc_id", "_row", F.inline(kept))


def _known_kind(value: Column) -> Column:
    """The kind whose pattern is the whole value, or null."""
    kind = F.lit(None).cast("string")
    for k in reversed(KINDS):
        kind = F.when(value.rlike(f"^(?:{PATTERNS[k]})$") & valid(k, value), k).otherwise(kind)
    return kind


def _seed_kind(value: Column) -> Column:
    """The known kind of a value, or secret where it looks random."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT
    secret = value.rlike(KEY_FORMAT) | (value.rlike(RANDOM) & varied)
    return F.coalesce(_known_kind(value), F.when(secret, "secret"))


def _shaped(kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for k, shape in SHAPES.items():
        out = out | ((kind == k) & value.rlike(shape))
    return out


def confident_contexts(found: DataFrame) -> DataFrame:
    """``context, kind``: contexts of enough confidence after ROUNDS rounds over the graph.

    A context's confidence in a kind is the mean score of its distinct instances, an instance's score
    one minus the product of its contexts' doubts; seeds keep score 1. A context needs ``LEAST_KNOWN``
    instances of score ``KNOWN``: seeds in the first round, then also what was discovered. Words that name
    public numbers are no contexts of secrets. Counts cover all documents; a context or instance of
    very many edges is joined in splittable parts.
    """
    edges = materialize(found.where("context <> ''").select("context", "value").distinct())
    seeds = materialize(
        edges.select("value").distinct().withColumn("kind", _seed_kind(F.col("value"))).where("kind is not null")
        .select("value", "kind", F.lit(1.0).alias("score"))
    )
    degree = edges.groupBy("context").agg(F.count("*").alias("degree"))
    scores, contexts = seeds, None
    for turn in range(ROUNDS):
        sums = (
            edges.join(scores, "value")
            .groupBy("context", "kind")
            .agg(F.sum("score").alias("sum"), F.count(F.when(F.col("score") >= KNOWN, 1)).alias("known"))
            .where((F.col("sum") > 1) & (F.col("known") >= LEAST_KNOWN))
            .where((F.col("kind") != "secret") | ~F.col("context").rlike(PUBLIC))
        )
        contexts = materialize(
            sums.join(degree, "context")
            .withColumn("confidence", F.col("sum") / F.col("degree"))
            .where(F.col("confidence") >= WORKING)
            .select("context", "kind", "confidence")
        )
        if turn + 1 < ROUNDS:
            doubt = F.log(F.lit(1.0) - F.least("confidence", F.lit(0.99)))
            unseen = edges.join(contexts, "context").where(_shaped(F.col("kind"), F.col("value")))
            raised = unseen.groupBy("value", "kind").agg((1 - F.exp(F.sum(doubt))).alias("score"))
            scores = materialize(seeds.union(raised.join(seeds, "value", "left_anti").select("value", "kind", "score")))
    return contexts.where(F.col("confidence") >= CONFIDENT).select("context", "kind")


def found_personal_data(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text (null: empty), base (spans by kind) and spans (all, by kind, then start).

    Spans are ``kind, start, end`` in code points, end exclusive. A discovered span never overlaps a
    base span, or an earlier discovered one of its own kind; base spans stay as they are. Repeated rows
    give equal rows; of other columns, those of ``keep`` are passed on. No rows give no rows.
    """
    rows = docs.select("doc_id", *keep, whole_text().alias("text")).withColumn("_row", F.xxhash64("text"))
    found = materialize(candidates(rows))
    chosen = confident_contexts(found)
    keys = found.where(F.col("value").rlike(KEY_FORMAT)).withColumn("kind", F.lit("secret"))
    marked = (
        found.join(chosen, "context")
        .where(_shaped(F.col("kind"), F.col("value")) & _known_kind(F.col("value")).isNull())
        .unionByName(keys)
        .select("doc_id", "_row", "kind", "start", (F.col("start") + F.length("value")).cast("bigint").alias("end"))
    )
    # Spans of one document at most; equal rows have equal spans, gathered once.
    key = [F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("_id"), "_row"]
    span = F.struct("kind", "start", "end")
    more = materialize(marked.select(*key, span.alias("span")).distinct().groupBy("_id", "_row").agg(F.collect_list("span").alias("_more")))
    based = rows.select(*key, "doc_id", *keep, "text", F.flatten(F.array(*map(_base_of, KINDS))).alias("base"))
    joined = lookup_join(based, more, ["_id", "_row"])
    free = F.filter(
        F.coalesce("_more", F.array().cast(_SPANS)),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    both = F.concat("base", free)
    ordered = let(both, lambda all_: F.flatten(F.array(*(_of_kind(all_, k) for k in ALL_KINDS))))
    return joined.select("doc_id", *keep, "text", "base", ordered.alias("spans"))


def _base_of(kind: str) -> Column:
    spans = base_spans(F.col("text"), kind)
    return F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def _of_kind(spans: Column, kind: str) -> Column:
    """Spans of a kind by start; the struct's first field, the kind, is then the same for all."""
    return F.sort_array(F.filter(spans, lambda s: s["kind"] == kind))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are merged
    and take the name of the first."""

    def pieces(ordered: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            inside = x["start"] < s["at"]
            return F.struct(
                F.greatest(s["at"], x["end"]).alias("at"),
                F.concat(
                    s["out"],
                    F.when(inside, F.lit("")).otherwise(
                        F.concat(
                            F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")),
                            F.lit("<"), F.upper(x["kind"]), F.lit(">"),
                        )
                    ),
                ).alias("out"),
            )

        empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
        rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
        return F.aggregate(ordered, empty, step, rest)

    by_start = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(by_start, pieces))
