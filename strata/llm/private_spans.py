"""Personal data by patterns and a semi-Markov conditional random field (operator 3)."""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LONGEST = 24  # tokens of an entity
WINDOW = 4096  # tokens whose segments are held at a time in longer stretches
AROUND = LONGEST + 4  # tokens on either side of a figure or an at-sign: any entity that holds it, and a word before
SURE = 0.9  # posterior probability from which a span is added
TABLE = 1 << 13  # hashed features of a label
# fixed values: the patterns of the base spans
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind's number, end: sorts by start, then kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _figures(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card_ok(text: str) -> bool:
    digits = _figures(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _address_ok(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail their test are dropped.

    Each pattern is tried only where it can begin, so long runs of one sign take
    linear time: an address is read outwards from its at-sign.
    """
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    found += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if _address_ok(m.group())]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _card_ok(m.group())]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_figures(m.group())) <= 15]
    return sorted(found)


# ---- zones and features ---------------------------------------------------

# letters and marks of scripts without spaces between words: no part of an address, a border like a space
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_UNSPACED}]+|(?:(?![{_UNSPACED}])[^\W\d_])+|[0-9]+|\s+|.", re.S)
_FOREIGN = re.compile(f"[{_UNSPACED}]")
_BORDER = re.compile(f"[\"'<>|;{_UNSPACED}]")  # beside an entity as good as a space
_TRIGGER = re.compile(r"[0-9]+|@|[\[({][ ]?at[ ]?[\])}]", re.I)
_HIDDEN = re.compile(r"[\w.%+-]+ ?[\[({] ?at ?[\])}] ?[\w-]+( ?([\[({] ?dot ?[\])}]|\.) ?[\w-]+)+", re.I)


def _back(text: str, floor: int, at: int, n: int) -> int:
    """Where the last ``n`` tokens before ``at`` begin; ``floor`` if there are fewer behind it."""
    width = 8 * n
    while True:
        low = max(floor, at - width)
        starts = [m.start() for m in _TOKEN.finditer(text, low, at)]
        if len(starts) > n:  # the first may be the rest of a token
            return starts[-n]
        if low == floor:
            return floor
        width *= 4


def _on(text: str, at: int, n: int) -> int:
    """Where the next ``n`` tokens from ``at`` end."""
    for _ in range(n):
        m = _TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
    return at


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of AROUND whole tokens on either side of figures and at-signs.

    An entity has at most LONGEST tokens, so each lies in a stretch as a whole, with
    or without spaces in the text; tokens in no stretch can be in no entity.
    """
    out: list[tuple[int, int]] = []
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if end < 0:
            start = _back(text, 0, m.start(), AROUND)
        elif _back(text, end, m.start(), 2 * AROUND) > end:
            out.append((start, _on(text, end, AROUND)))
            start = _back(text, end, m.start(), AROUND)
        end = m.end()
    if end >= 0:
        out.append((start, _on(text, end, AROUND)))
    return out


@lru_cache(1 << 16)
def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % TABLE


def _shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        return "9"
    if c.isalpha():
        return "w" if _FOREIGN.match(c) else token.lower() if token.lower() in ("at", "dot") else "a"
    return "_" if c.isspace() else c


def _side(token: str) -> str:
    if not token:
        return "end"
    if _BORDER.match(token):
        return "blank"
    return "word" if token[0].isalnum() else "blank" if token[0].isspace() else token[0]


@dataclass
class Lattice:
    """All candidate segments of a zone: (start, stop) in tokens and their features."""

    tokens: list[str]
    starts: list[int]
    segments: list[tuple[int, int]]
    slots: np.ndarray  # segments x features
    entity: np.ndarray  # whether a segment may be more than a plain token
    ending: list[np.ndarray]  # numbers of the segments that stop at each token


def lattice(
    text: str, word: str = "", begins: tuple[int, int] | None = None, stops: tuple[int, int] | None = None
) -> Lattice:
    """All candidates of a stretch, or those that begin and stop at tokens of these ranges (ends included).

    ``word`` is the last word before the text.
    """
    tokens, starts = [], []
    for m in _TOKEN.finditer(text):
        tokens.append(m.group())
        starts.append(m.start())
    starts.append(len(text))
    shapes = [_shape(t) for t in tokens]
    n = len(tokens)
    word_before = []
    for t in tokens:
        word_before.append(word)
        word = t[:LONGEST].lower() if t[0].isalpha() else word
    segments, slots, entity = [], [], []
    first, last_begin = begins or (0, n - 1)
    soonest, latest = stops or (1, n)
    for i in range(first, last_begin + 1):
        if soonest <= i + 1 <= latest:
            segments.append((i, i + 1))
            slots.append(_features(text, tokens, starts, shapes, word_before, i, i + 1))
            entity.append(False)
        if shapes[i] == "_" or not (shapes[i] in ("9", "a", "+", "(")):
            continue
        useful = False
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            last = shapes[j - 1]
            if "\n" in tokens[j - 1]:
                break
            useful = useful or last in ("9", "@", "at")
            if useful and last in ("9", "a") and soonest <= j <= latest:
                if j == i + 1:
                    entity[-1] = True
                else:
                    segments.append((i, j))
                    slots.append(_features(text, tokens, starts, shapes, word_before, i, j))
                    entity.append(True)
    stops = np.array([j for _, j in segments], np.int64)
    order = np.argsort(stops, kind="stable")
    cuts = np.searchsorted(stops[order], np.arange(n + 2))
    ending = [order[cuts[j] : cuts[j + 1]] for j in range(n + 1)]
    return Lattice(tokens, starts, segments, np.array(slots, np.int64), np.array(entity), ending)


def _features(text, tokens, starts, shapes, word_before, i, j) -> list[int]:
    span = text[starts[i] : starts[j]]
    shape = "".join(shapes[i:j])
    digits = sum(len(tokens[k]) for k in range(i, j) if shapes[k] == "9")
    left, right = _side(tokens[i - 1] if i else ""), _side(tokens[j] if j < len(tokens) else "")
    flags = (
        "@" in span and bool(DOMAIN.fullmatch(span.partition("@")[2])) and set(span.partition("@")[0]) <= LOCAL,
        shape == "9.9.9.9" and _address_ok(span),
        digits == len(span) - shape.count(" ") - shape.count("_") - shape.count("-") and _card_ok(span),
        bool(PHONE.fullmatch(span)) and 10 <= digits <= 15,
        shape.count("at") == 1 and bool(_HIDDEN.fullmatch(span)),
    )
    kind = "".join("01"[f] for f in flags)
    groups = "-".join(str(len(tokens[k])) for k in range(i, j) if shapes[k] == "9")
    return [
        _slot("bias"),
        _slot("shape:" + shape),
        _slot(f"groups:{groups}:{shapes[i] == '+'}"),
        _slot(f"digits:{digits}"),
        _slot("rule:" + kind),
        _slot(f"rule-sides:{kind}:{left}:{right}"),
        _slot(f"left:{left}:{shapes[i]}"),
        _slot(f"right:{right}:{shapes[j - 1]}"),
        _slot(f"sides-shape:{left}:{shape[:12]}:{right}"),
        _slot("word:" + word_before[i]),
        _slot(f"length:{j - i}"),
    ]


# ---- the field ------------------------------------------------------------


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Field:
    """Weights of hashed whole-segment features for each label, and of label after label."""

    weights: np.ndarray
    after: np.ndarray

    def scores(self, grid: Lattice) -> np.ndarray:
        out = self.weights[:, grid.slots].sum(2).T
        single = np.array([j - i == 1 for i, j in grid.segments])
        out[~grid.entity, 1:] = -np.inf
        out[~single, 0] = -np.inf
        return out

    def forward(self, grid: Lattice, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-sums up to each token and label, and before each segment."""
        n = len(grid.tokens)
        upto = np.full((n + 1, len(LABELS)), -np.inf)
        upto[0, 0] = 0.0
        before = np.full(scores.shape, -np.inf)
        reach = np.full((n + 1, len(LABELS)), -np.inf)
        reach[0] = _sum(upto[0][:, None] + self.after, 0)
        for j in range(1, n + 1):
            own = grid.ending[j]
            before[own] = reach[[grid.segments[s][0] for s in own]]
            upto[j] = _sum(before[own] + scores[own], 0)
            reach[j] = _sum(upto[j][:, None] + self.after, 0)
        return upto, before

    def posterior(self, grid: Lattice, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each segment with each label, and expected counts of label after label."""
        n = len(grid.tokens)
        upto, before = self.forward(grid, scores)
        total = _sum(upto[n], 0)
        behind = np.full((n + 1, len(LABELS)), -np.inf)
        behind[n] = 0.0
        gather = np.full((n + 1, len(LABELS)), -np.inf)
        opening: list[list[int]] = [[] for _ in range(n)]
        for s, (i, _) in enumerate(grid.segments):
            opening[i].append(s)
        for i in range(n - 1, -1, -1):
            own = opening[i]
            gather[i] = _sum(scores[own] + behind[[grid.segments[s][1] for s in own]], 0)
            behind[i] = _sum(self.after + gather[i][None, :], 1)
        stop = np.array([j for _, j in grid.segments])
        pairs = np.exp(upto[:n, :, None] + self.after[None] + gather[:n, None, :] - total).sum(0)
        return np.exp(before + scores + behind[stop] - total), pairs

    def best(self, grid: Lattice, scores: np.ndarray) -> list[tuple[int, int]]:
        """(segment, label) of the most probable segmentation, in order."""
        n = len(grid.tokens)
        top = np.full((n + 1, len(LABELS)), -np.inf)
        top[0, 0] = 0.0
        back: list[list[tuple[int, int]]] = [[(-1, -1)] * len(LABELS) for _ in range(n + 1)]
        for j in range(1, n + 1):
            own = grid.ending[j]
            come = top[[grid.segments[s][0] for s in own]][:, :, None] + self.after[None]
            label = come.argmax(1)
            value = come.max(1) + scores[own]
            pick = value.argmax(0)
            for y in range(len(LABELS)):
                top[j, y] = value[pick[y], y]
                back[j][y] = (int(own[pick[y]]), int(label[pick[y], y]))
        out, j, y = [], n, int(top[n].argmax())
        while j > 0:
            s, previous = back[j][y]
            out.append((s, y))
            j, y = grid.segments[s][0], previous
        return out[::-1]


def _invented(rng: random.Random) -> str:
    parts = ("an", "er", "th", "on", "ment", "ción", "keit", "ou", "ß", "é", "re", "ti", "la", "ung", "los", "st")
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented lines with marked entities in many forms, and figures that are none."""
    rng, out = random.Random(seed), []

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        while True:
            body = digits(rng.choice((14, 15, 16, 16, 16, 19)))
            if luhn(body) == valid:
                return body if rng.random() < 0.6 else rng.choice(" -").join(body[k : k + 4] for k in range(0, len(body), 4))

    def email(hidden: bool) -> str:
        name = _invented(rng).encode("ascii", "ignore").decode() or "ab"
        name += rng.choice(("", "." + digits(2), "_x", "-" + digits(1)))
        host = [rng.choice(("mail", "post", "web")) + rng.choice(("", digits(1))), *rng.sample(("example", "site", "corp"), 1), rng.choice(("com", "org", "net", "de"))]
        if not hidden:
            return name + "@" + ".".join(host)
        a, b = rng.choice((("(", ")"), ("[", "]"), ("{", "}")))
        s = rng.choice(("", " "))
        return f"{name}{s}{a}at{b}{s}" + rng.choice((f"{s}{a}dot{b}{s}", ".")).join(host)

    def phone(plain: bool) -> str:
        if plain:
            return rng.choice(("+1 ({}) {}-{}", "+49 {} {}{}", "+33.{}.{}.{}", "+{}{}{}0")).format(digits(3), digits(3), digits(4))
        return rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}")).format(digits(3), digits(3), digits(4))

    def address() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def nothing() -> str:
        return rng.choice(
            (
                lambda: f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}",
                lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}",
                lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
                lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1950, 2030)}",
                lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}",
                lambda: "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)),
                lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
                lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
                lambda: card(False),
                lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
                lambda: digits(rng.randint(1, 12)),
                lambda: f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}",
                lambda: f"§ {rng.randint(1, 99)} ({rng.randint(1, 9)})",
                lambda: f"{digits(3)}-{digits(4)}",
                lambda: f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
                lambda: f"{digits(5)}-{digits(5)}-{digits(5)}",
                lambda: f"{rng.randint(1, 99)}%",
                lambda: "@" + _invented(rng),
                lambda: f"{_invented(rng)} @ {_invented(rng)}",
                lambda: f"{_invented(rng)} (at) {_invented(rng)}",
                lambda: " ".join(digits(rng.randint(1, 5)) for _ in range(rng.randint(2, 8))),
                lambda: "/".join(digits(rng.randint(1, 4)) for _ in range(3)),
                lambda: f"http://{_invented(rng)}.com/{digits(4)}?page={digits(1)}",
            )
        )()

    makers = (
        lambda: (email(rng.random() < 0.4), 1), lambda: (address(), 2), lambda: (card(True), 3),
        lambda: (phone(rng.random() < 0.6), 4),
    )
    for _ in range(n):
        line, marks = "", []
        for _ in range(rng.randint(1, 2)):
            line += " ".join(_invented(rng) for _ in range(rng.randint(1, 3))) + rng.choice((" ", " ", " ", ": ", "\n"))
            if rng.random() < 0.5:
                body, kind = rng.choice(makers)()
                marks.append((len(line), len(line) + len(body), kind))
            else:
                body = nothing()
            line += body + rng.choice((" ", " ", ". ", ", ", "\n"))
        line += " ".join(_invented(rng) for _ in range(rng.randint(1, 3)))
        out.append((line, marks))
    return out


@lru_cache(2)
def trained(n: int = 700, rounds: int = 4, seed: int = 5) -> Field:
    """Fit the field by its conditional likelihood on invented lines.

    No table has labels for hidden forms, so the examples are generated: the same
    every time, whatever the data. Adaptive steps, one line after another.
    """
    field = Field(np.zeros((len(LABELS), TABLE)), np.zeros((len(LABELS), len(LABELS))))
    power, power_after = np.full_like(field.weights, 0.05), np.full_like(field.after, 0.05)
    ready = []
    for line, marks in _examples(n, seed):
        grid = lattice(line)
        place = {(grid.starts[i], grid.starts[j]): s for s, (i, j) in enumerate(grid.segments)}
        gold, at = [], 0
        by_start = {a: (b, y) for a, b, y in marks}
        while at < len(line):
            stop, label = by_start.get(at, (next(x for x in grid.starts if x > at), 0))
            gold.append((place.get((at, stop)), label))
            at = stop
        if all(s is not None for s, _ in gold):
            ready.append((grid, gold))
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(ready)
        for grid, gold in ready:
            scores = field.scores(grid)
            expected, pairs = field.posterior(grid, scores)
            change, after, previous = -expected, -pairs, 0
            for s, y in gold:
                change[s, y] += 1
                after[previous, y] += 1
                previous = y
            strong = np.abs(change).max(1) > 1e-4
            slots = grid.slots[strong]
            for y in range(len(LABELS)):
                step = np.bincount(slots.ravel(), weights=np.repeat(change[strong, y], slots.shape[1]), minlength=TABLE)
                power[y] += step * step
                field.weights[y] += 0.3 * step / np.sqrt(power[y]) - 1e-5 * field.weights[y]
            power_after += after * after
            field.after += 0.3 * after / np.sqrt(power_after)
    return field


class Swept:
    """The field over a long stretch, WINDOW tokens at a time.

    Any segment is at most LONGEST tokens long, so a window needs no more than so many
    tokens beyond itself. Sums and the best path before and behind each token are kept in
    arrays, about 200 bytes a token; segments and their features are made for one window at
    a time, once forwards and, where the path holds entities, once backwards.
    """

    def __init__(self, text: str, field: Field):
        self.text, self.field = text, field
        self.starts, self.word = array("q"), array("q", [-1])  # the last word before each token
        for k, m in enumerate(_TOKEN.finditer(text)):
            self.starts.append(m.start())
            self.word.append(k if text[m.start()].isalpha() else self.word[-1])
        self.n = len(self.starts)
        self.starts.append(len(text))

    def _grid(self, low: int, high: int, begins: tuple[int, int], stops: tuple[int, int]) -> tuple[int, Lattice]:
        """The number of the grid's first token, and a grid over the tokens low to high and one on either side."""
        base = max(0, low - 1)
        w = self.word[base]
        word = self.text[self.starts[w] : self.starts[w + 1]][:LONGEST].lower() if w >= 0 else ""
        part = self.text[self.starts[base] : self.starts[min(self.n, high + 1)]]
        return base, lattice(part, word, (begins[0] - base, begins[1] - base), (stops[0] - base, stops[1] - base))

    def path(self) -> list[tuple[int, int, int, float]]:
        """(first token, end, label, score) of the best segmentation's entities; keeps the sums of the way there."""
        n, labels = self.n, len(LABELS)
        self.reach = np.full((n + 1, labels), -np.inf)
        top = np.full((n + 1, labels), -np.inf)
        came = np.zeros((n + 1, labels), np.int64)
        kind = np.zeros((n + 1, labels), np.int8)
        worth = np.zeros((n + 1, labels))
        upto = np.full(labels, -np.inf)
        upto[0] = top[0, 0] = 0.0
        self.reach[0] = _sum(upto[:, None] + self.field.after, 0)
        for low in range(0, n, WINDOW):
            high, back = min(n, low + WINDOW), max(0, low + 1 - LONGEST)
            base, grid = self._grid(back, high, (back, high - 1), (low + 1, high))
            scores = self.field.scores(grid)
            begin = np.array([i for i, _ in grid.segments], np.int64) + base
            for j in range(low + 1, high + 1):
                own = grid.ending[j - base]
                at = begin[own]
                upto = _sum(self.reach[at] + scores[own], 0)
                self.reach[j] = _sum(upto[:, None] + self.field.after, 0)
                come = top[at][:, :, None] + self.field.after[None]
                label = come.argmax(1)
                value = come.max(1) + scores[own]
                pick = value.argmax(0)
                each = np.arange(labels)
                top[j], came[j], kind[j], worth[j] = value[pick, each], at[pick], label[pick, each], scores[own[pick], each]
        self.total = _sum(upto, 0)
        out, j, y = [], n, int(top[n].argmax())
        while j > 0:
            if y:
                out.append((int(came[j, y]), j, y, float(worth[j, y])))
            j, y = int(came[j, y]), int(kind[j, y])
        return out[::-1]

    def behind(self) -> np.ndarray:
        """Log-sums from each token on to the end."""
        n = self.n
        out = np.full((n + 1, len(LABELS)), -np.inf)
        out[n] = 0.0
        for low in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
            high = min(n, low + WINDOW)
            far = min(n, high - 1 + LONGEST)
            base, grid = self._grid(low, far, (low, high - 1), (low + 1, far))
            scores = self.field.scores(grid)
            stop = np.array([j for _, j in grid.segments], np.int64) + base
            begin = np.array([i for i, _ in grid.segments], np.int64) + base
            cuts = np.searchsorted(begin, np.arange(low, high + 1))
            for i in range(high - 1, low - 1, -1):
                own = slice(cuts[i - low], cuts[i - low + 1])
                out[i] = _sum(self.field.after + _sum(scores[own] + out[stop[own]], 0)[None, :], 1)
        return out


def _swept_spans(text: str, left: int, right: int, field: Field) -> list[Span]:
    swept = Swept(text[left:right], field)
    path = swept.path()
    if not path:
        return []
    behind = swept.behind()
    return [
        (left + swept.starts[i], y - 1, left + swept.starts[j])
        for i, j, y, score in path
        if np.exp(swept.reach[i, y] + score + behind[j, y] - swept.total) >= SURE
    ]


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans of the field that are sure enough and touch no base span."""
    out: list[Span] = []
    held = sorted((a, z) for a, _, z in base)
    opens, ends = [a for a, _ in held], np.maximum.accumulate(np.array([z for _, z in held] or [0], np.int64))
    for left, right in zones(text):
        if right - left > WINDOW:
            for a, k, b in _swept_spans(text, left, right, field):
                before = bisect_left(opens, b)
                if not before or ends[before - 1] <= a:
                    out.append((a, k, b))
            continue
        grid = lattice(text[left:right])
        scores = field.scores(grid)
        path = [(s, y) for s, y in field.best(grid, scores) if y]
        if not path:
            continue
        sure, _ = field.posterior(grid, scores)
        for s, y in path:
            i, j = grid.segments[s]
            a, b = left + grid.starts[i], left + grid.starts[j]
            if sure[s, y] >= SURE and not any(x < b and a < z for x, _, z in base):
                out.append((a, y - 1, b))
    return out


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the added ones, in order."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, field))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch of spans replaced by the kind of its first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, hashes, lists = [], [], []
        for text in batch.column("text").to_pylist():
            base, spans = spans_of(text or "", field)
            counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
            hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
            lists.append(written(spans))
        counts = np.array(counts, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                *[pa.array(counts[:, i]) for i in range(4)],
                pa.array(hashes, pa.string()),
                pa.array(lists, pa.string()),
            ],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
        )


def private_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data in every whole text: doc_id, counts, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind in
    the order email, ip, card, phone. Base spans follow fixed patterns and always stay.
    The field scores whole candidate segments of up to 24 tokens around figures and
    at-signs and decides on boundaries and kinds together; it adds what it is sure of
    and no base span touches, such as hidden addresses and national phone numbers. Long
    stretches of figures are swept in windows (``Swept``), with the same result.
    ``n_*`` count the base spans and ``base_sha256`` is over them; ``spans`` lists all.

    Null and empty texts have no spans. Repeated rows are kept; null doc_ids too;
    other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field or trained())  # of fixed size
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _found(it, sent.value),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def _cleaned(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else redacted(t, spans_of(t, field)[1]) for t in batch.column("text").to_pylist()]
        names = batch.schema.names
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        if "n_chars" in names:
            kind = batch.schema.field("n_chars").type
            columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], kind)
        yield pa.RecordBatch.from_arrays(columns, names)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced by its kind; n_chars follows."""
    sent = docs.sparkSession.sparkContext.broadcast(field or trained())
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(lambda it: _cleaned(it, sent.value), schema)
