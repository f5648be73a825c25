"""Plain versions of the contracts, one row at a time, to hold the operators against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SPACE = "\x20\x09-\x0d"


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# op2
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {}
    for kind, pattern in KINDS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def op2(text: str | None) -> tuple:
    spans = base_spans(text or "")
    joined = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
    return (*(len(v) for v in spans.values()), hashlib.sha256(joined.encode()).hexdigest(), joined)


# op3
def pieces(ids: list[int], limit: int) -> list[tuple[int, int, int, int]]:
    out = []
    for piece, at in enumerate(range(0, len(ids), limit)):
        part = ids[at : at + limit]
        out.append((piece, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return out


# op5
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def op5(text: str | None) -> tuple:
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
    )


def op5_findings(texts: list[str | None], templates: list[tuple], indexed: int, least: float, moved: int) -> list[list]:
    """(label, share) of each text's findings: every template at every place, word by word."""

    def plain(text: str | None) -> list[str]:
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))

    def english(text: str) -> list[str]:
        return re.findall("[0-9a-z]+", text.lower())

    documents = [plain(t) for t in texts]
    held = Counter(w for d in documents for w in set(d))
    out = []
    for words in documents:
        found = []
        for t, (label, notice, phrases) in enumerate(templates):
            own = english(notice)
            rare = set(sorted(set(own), key=lambda w: (held[w], w))[:indexed])
            lined = [i for i, w in enumerate(own) if w in rare]
            needed = max(1, -int(-least * len(lined) // 1))
            for at in range(-len(own), len(words)) if rare & set(words) else ():
                n = sum(0 <= at + i < len(words) and words[at + i] == own[i] for i in lined)
                if n < needed:
                    continue
                away = []
                for phrase in phrases:
                    p = phrase.split()
                    q = next(i for i in range(len(own)) if own[i : i + len(p)] == p)
                    ways = [abs(d) for d in range(-moved, moved + 1) if at + q + d >= 0 and words[at + q + d : at + q + d + len(p)] == p]
                    away.append(min(ways, default=None))
                if None not in away:
                    found.append((min(1.0, n / len(lined)), -max(away), len(own), -t, at, label))
        best = []
        for x in found:
            beaten = False
            for y in found:
                overlap = min(x[4] + x[2], y[4] + y[2]) - max(x[4], y[4])
                beaten |= y[:4] > x[:4] and 2 * overlap > min(x[2], y[2])
            if not beaten:
                best.append((x[5], x[0]))
        out.append(best)
    return out


# op9
def op9(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{SPACE}]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


# op10
def fingerprint(text: str | None, size: int = 3) -> int:
    words = re.findall(f"[^{SPACE}]+", ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict[int, int], tau: int = 3) -> dict[int, int]:
    root = {d: d for d in fps}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= tau:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


# op8
def op8(turns: list[tuple[str, str]]) -> tuple:
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def op9_distances(rows: list[tuple], common: dict, classes: dict, guards: tuple, most: tuple, trims: tuple) -> list[tuple]:
    """(class distance, common-word distance, kept) of (lang, text) rows, all documents held in memory."""
    from math import log2, sqrt

    def measure(lang: str | None, text: str | None) -> tuple:
        text = text or ""
        words = re.findall(f"[^{SPACE}]+", text)
        kinds = [len(re.findall(f"[{c}]".replace("\\x{10FFFF}", "\U0010ffff"), text)) for c in classes.values()]
        seen = [sum(w.lower() == v for w in words) for v in common.get(lang or "", [])]
        return len(text), len(words), [*kinds, len(text) - sum(kinds)], [*seen, len(words) - sum(seen)]

    def distance(a: list[int], b: list[int]) -> float | None:
        if not sum(a) or not sum(b):
            return None
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        parts = [(x * log2(2 * x / (x + y)) if x else 0) + (y * log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)]
        return sqrt(max(sum(parts) / 2, 0))

    measured = [measure(lang, text) for lang, text in rows]
    failed = [op9(text)[-1] for _, text in rows]

    def compared(sound: list[int]) -> list[tuple]:
        held: dict[str, list] = {}
        for i in sound:
            if not failed[i]:
                _, _, kinds, seen = measured[i]
                old = held.setdefault(rows[i][0] or "", [[0] * len(kinds), [0] * len(seen)])
                held[rows[i][0] or ""] = [[x + y for x, y in zip(a, b)] for a, b in zip(old, (kinds, seen))]
        out = []
        for (lang, _), (chars, words, kinds, seen) in zip(rows, measured):
            if words < guards[0] or chars < guards[1] or (lang or "") not in held:
                out.append((None, None))
                continue
            ref = held[lang or ""]
            out.append((distance(kinds, ref[0]), distance(seen, ref[1]) if len(seen) > 1 else None))
        return out

    def far(found: tuple, limits: tuple) -> bool:
        return (found[0] or 0) > limits[0] or (found[1] or 0) > limits[1]

    sound = list(range(len(rows)))
    for limits in trims:
        found = compared(sound)
        sound = [i for i in range(len(rows)) if not far(found[i], limits)]
    return [(*f, not bad and not far(f, most)) for f, bad in zip(compared(sound), failed)]
