"""Chat formatting with a grammar round trip.

A conversation is a sequence of turns. The template marks each turn with control strings; a
deterministic parser reads them back. Every rendered turn is parsed again and compared with its
source, and while they differ the content is escaped once more. Escaping puts one more backslash into
every control string of a text, parsing takes one out, so any text survives.

Grammar (``text`` holds no control string once escaped):

    conversation = turn*
    turn = "[INST] " text " [/INST]"                       user
         | "[SYS] " text " [/SYS]"                         system
         | "[ROLE " text "] " text " [/ROLE]"              any other role
         | text "</s>"                                     assistant
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_rows, prepare

#: Control strings after their first character; the first one is "[" or "<".
_AFTER = r"(?:/?INST\]|/?SYS\]|/?ROLE|/?s>)"
_PLAIN = re.compile(rf"([\[<])(\\*)(?={_AFTER})")
_ESCAPED = re.compile(rf"([\[<])\\(\\*)(?={_AFTER})")
_MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", "</s>")}
_OTHER = ("[ROLE ", "] ", " [/ROLE]")

#: Turn rows: the rendered turn, and the span of its text in it that carries loss (equal ends: none).
TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start bigint, loss_end bigint"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _marks(role: str) -> tuple[str, str]:
    if role in _MARKS:
        return _MARKS[role]
    # A bracket or backslash would end the role's name early, so it is written in another way.
    name = role.replace("\\", "\\\\").replace("]", "\\)")
    return f"{_OTHER[0]}{escape(name)}{_OTHER[1]}", _OTHER[2]


def parse_turn(formatted: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role, unescaped text, span of the escaped text, and the place after the turn that begins at ``at``."""
    for role in ("user", "system"):
        first, last = _MARKS[role]
        if formatted.startswith(first, at):
            start = at + len(first)
            break
    else:
        if formatted.startswith(_OTHER[0], at):
            named = at + len(_OTHER[0])
            end = formatted.index(_OTHER[1], named)
            name = unescape(formatted[named:end])
            role = re.sub(r"\\(.)", lambda m: "]" if m.group(1) == ")" else m.group(1), name, flags=re.S)
            start, last = end + len(_OTHER[1]), _OTHER[2]
        else:
            role, start, last = "assistant", at, _MARKS["assistant"][1]
    end = formatted.index(last, start)
    return role, unescape(formatted[start:end]), start, end, end + len(last)


def _reads_back(formatted: str, role: str, text: str) -> bool:
    try:
        got = parse_turn(formatted)
    except ValueError:
        return False
    return got[:2] == (role, text) and got[4] == len(formatted)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and the span of its text; escaped until it reads back as its source."""
    first, last = _marks(role)
    content = text
    while not _reads_back(first + content + last, role, text):
        escaped = escape(content)
        if escaped == content:
            raise ValueError(f"no reversible form of a {role} turn")
        content = escaped
    return first + content + last, len(first), len(first) + len(content)


def formatted_turns(rows: DataFrame) -> DataFrame:
    """TURNS of every row of ``conv_id, turn, role, text``, each on its own; nothing is shuffled.

    A null text or role counts as empty; only the role ``assistant`` carries loss. Columns other than
    these four play no part. A conversation's training text is its turns' ``formatted`` in order.
    """

    def render(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            roles = [r or "" for r in batch["role"]]
            texts = [t or "" for t in batch["text"]]
            written = [render_turn(r, t) for r, t in zip(roles, texts)]
            yield {
                **batch,
                "role": roles,
                "text": texts,
                "formatted": [w[0] for w in written],
                "loss_start": [w[1] for w in written],
                "loss_end": [w[2] if r == "assistant" else w[1] for r, w in zip(roles, written)],
            }

    prepare(rows.sparkSession)
    used = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return map_rows(used, render, TURNS)


def read_back(turns: DataFrame) -> DataFrame:
    """One row a conversation, from its formatted text alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Turns follow ``turn``, nulls first; equal turn numbers follow role, then text. The text is parsed
    turn by turn as it streams by and hashed on the way, so a conversation of any length takes the
    memory of one batch. Null conversation ids form one conversation. No rows give no rows.
    """
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartition("conv_id").sortWithinPartitions(*order)

    def parse(batches: Iterator[dict]) -> Iterator[dict]:
        state = None
        for batch in batches:
            done = []
            for conv, formatted, start, end in zip(
                batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"]
            ):
                if state is None or state.conv_id != conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Read(conv)
                state.add(formatted, start, end)
            if done:
                yield dict(zip(_READ, zip(*done)))
        if state is not None:
            yield dict(zip(_READ, zip(*[state.row()])))

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_rows(dealt.select("conv_id", "formatted", "loss_start", "loss_end"), parse, schema)


_READ = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


class _Read:
    """A conversation's running hashes."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int, end: int) -> None:
        at = 0
        while at < len(formatted):
            role, text, _, _, at = parse_turn(formatted, at)
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        masked = unescape(formatted[start:end])
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(masked)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_CONTROL = r"(?:/?INST\]|/?SYS\]|/?ROLE|/?s>)"
#: For the roles of the table: a turn is escaped when it would not read back as it stands.
SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'system' THEN ' [/SYS]' ELSE '</s>' END AS last,
        CASE role WHEN 'user' THEN 7 WHEN 'system' THEN 6 ELSE 0 END AS first_chars
    FROM turns
), written AS (
    SELECT *, CASE WHEN strpos(text || last, last) <> length(text) + 1
            OR regexp_matches(text, '[\[<]\\+{_CONTROL}')
            OR (role = 'assistant' AND regexp_matches(text || last, '^(\[INST\] |\[SYS\] |\[ROLE )'))
        THEN regexp_replace(text, '([\[<])(\\*{_CONTROL})', '\1\\\2', 'g') ELSE text END AS content
    FROM marked
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(first_chars + length(content) + length(last))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
