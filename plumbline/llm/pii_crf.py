"""Personal data in texts: patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers; what they
find stays. They take the longest run and do not try again, so two card numbers
that stand side by side, or a phone number before an IP address, are lost to them,
and they know one way of writing each kind.

The field reads islands of a text: runs with seven digits or more, and the
surroundings of an at sign or of a word that stands for one. An island is cut into
tokens (digits, letters, single other characters). A segment is one token of no
kind, or a candidate span of at most ``MOST_TOKENS`` tokens with a kind; features
look at a whole span (lengths and separators of its groups, check digits, ranges,
brackets, its neighbours, the word before it). Dynamic programming over the
candidates chooses boundaries and kinds together. Tokens outside islands can only be
of no kind, so islands may be decoded one by one. Spans that touch one of the
patterns are dropped, the others are added.

Weights are fitted with numpy by the gradient of the log-likelihood, on islands of at
most ``LEARNED_ISLANDS`` out of about ``LEARNED_TEXTS`` texts, labelled by the
patterns, and on ``MADE`` made lines that put the kinds into other forms, side by
side and next to look-alikes. Everything else reads every text from end to end.

Defined results: null and empty texts have no spans; the counts n_* and base_sha256
are those of the patterns; offsets are code points; every row is returned, repeated
or without id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
# Bound of an entity, in tokens and in digits.
MOST_TOKENS, MOST_DIGITS = 40, 19
# What the weights are fitted on: about so many texts, at most so many of their islands, and made lines.
LEARNED_TEXTS, LEARNED_ISLANDS, MADE = 8000, 600, 1200
EPOCHS = 5

# ---- patterns ---------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would have started with the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; every match has one at sign, so the search goes from sign to sign."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        after = at + 1
        domain = _DOMAIN.match(text, after)
        local = text[free:at]
        size = len(local) - len(local.rstrip(LOCAL))
        if domain and size:
            out.append((at - size, domain.end()))
            after = domain.end()
        free, at = after, text.find("@", after)
    return out


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, kinds as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Without leading zeros, so that a long part is never made a number.
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            found = digits_of(m.group()) if m.end() - m.start() >= 16 else ""
            if 16 <= len(found) <= 19 and luhn(found):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- islands, tokens and candidate spans ------------------------------------------------------

_NUMBER = re.compile(r"[0-9](?:[ \t().\-/]{0,3}[0-9]){6,}")
_AT = r"(?:@|[\[({] ?[aA][tT] ?[\])}]| [aA][tT] )"
_DOT = r"(?:\.| ?[\[({] ?[dD][oO][tT] ?[\])}] ?| [dD][oO][tT] )"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_SIGN = re.compile(rf"@|[\[({{] ?[aA][tT] ?[\])}}]| [aA][tT] (?={_LABEL}{_DOT})")
_HOST = re.compile(rf" ?{_LABEL}(?:{_DOT}{_LABEL})+")
_ADDRESS = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])? ?({_AT}) ?{_LABEL}((?:{_DOT}{_LABEL})+)")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_RUN, _GAP = re.compile(r"[0-9]+"), re.compile(r"[^0-9]+")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W_]*\Z")
# How far an address may reach from its sign, to either side; words to look at before a span lie as far off.
_LEFT, _RIGHT, _NEAR = 64, 128, 24


def islands(text: str) -> list[tuple[int, int]]:
    """Where spans may lie, in order and apart from each other."""
    found = [(max(0, m.start() - 2), min(len(text), m.end() + 1)) for m in _NUMBER.finditer(text)] if _DIGIT.search(text) else []
    if "@" in text or _SIGN.search(text):
        found += [(max(0, m.start() - _LEFT), min(len(text), m.end() + _RIGHT)) for m in _SIGN.finditer(text)]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _beside(text: str, at: int, step: int) -> str:
    """What stands next to a span: its character's class, and whether a digit or letter follows a mark."""
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    if c.isalnum():
        return "digit" if c.isdigit() else "letter"
    if c.isspace():
        return "space"
    further = text[at + step] if 0 <= at + step < len(text) else " "
    return c + ("x" if further.isalnum() else "") if c in "._-/+@%#=:,\"'()[]" else "mark"


def _word_before(text: str, at: int) -> str:
    m = _WORD_BEFORE.search(text[max(0, at - _NEAR) : at])
    return m.group(1).lower() if m else ""


def _length(n: int) -> str:
    return str(n) if n in (10, 16) else "7-9" if n < 10 else "11-12" if n < 13 else "13-15" if n < 16 else "17-19"


def number_features(text: str, start: int, end: int) -> list[str]:
    """Features of the candidate span [start, end) of digits and separators."""
    span = text[start:end]
    groups, marks = _RUN.findall(span), _GAP.findall(span)
    lead = marks.pop(0) if not "0" <= span[0] <= "9" else ""
    digits, kinds = "".join(groups), set(marks)
    shape = "-".join(str(len(g)) for g in groups) if len(groups) < 7 else "many"
    mark = "none" if not kinds else min(kinds) if len(kinds) == 1 and len(min(kinds)) == 1 else "wide" if "  " in "".join(marks) else "mixed"
    length, even = _length(len(digits)), span.count("(") == span.count(")")
    dotted = len(groups) == 4 and kinds == {"."} and not lead
    small = dotted and all(int(g[-4:]) <= 255 and len(g) <= 3 for g in groups)
    checked = len(digits) >= 16 and luhn(digits)
    steady = mark in ("none", " ", "-") and not lead
    out = [
        "n", f"n:length {length}", f"n:shape {shape}", f"n:lead {lead}", f"n:mark {mark}", f"n:lead {lead} length {length}",
        f"n:mark {mark} length {length}", f"n:brackets {even} {'(' in span}", f"n:dotted {dotted} {small}",
        f"n:checked {checked}", f"n:checked {checked} steady {steady} length {length}",
        f"n:left {_beside(text, start - 1, -1)}", f"n:right {_beside(text, end, 1)}",
    ]
    if lead in ("+", "+(", "("):
        out.append(f"n:led {even} {len(groups)} {length}")
    word = _word_before(text, start)
    return [*out, f"n:word {word}"] if word else out


def address_features(text: str, start: int, end: int, m: re.Match) -> list[str]:
    sign, dots = m.group(1).strip(), m.group(2)
    last = re.split(r"[^A-Za-z0-9-]+", dots)[-1]
    kind = "sign" if sign == "@" else "word" if sign.isalpha() else "bracket"
    dot = "dot" if re.fullmatch(r"(?:\.[A-Za-z0-9-]+)+", dots) else "spaced" if "." in dots else "word"
    apart = " " in m.group().replace(m.group(1), "", 1)
    out = [
        "a", f"a:sign {kind}", f"a:dot {dot}", f"a:sign {kind} dot {dot}", f"a:apart {apart} {kind} {dot}",
        f"a:last {last.isalpha() and 2 <= len(last) <= 12}", f"a:left {_beside(text, start - 1, -1)}", f"a:right {_beside(text, end, 1)}",
        f"a:labels {min(4, len(re.findall(r'[A-Za-z0-9-]+', dots)))}",
    ]
    word = _word_before(text, start)
    return [*out, f"a:word {word}"] if word else out


class Lattice:
    """Tokens of an island and its candidate segments: (first token, token after, kinds, features)."""

    def __init__(self, text: str, lo: int, hi: int):
        # A number or word that reaches over the edge of the island is taken whole where a bound of its length allows it.
        while hi < len(text) and text[hi - 1].isdigit() and text[hi].isdigit():
            hi += 1
        spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.plain = [self._token(text[a:b]) for a, b in spans]
        self.segments = [*self._numbers(text), *self._addresses(text, lo, hi)]
        self.segments.sort(key=lambda s: (s[1], s[0]))

    @staticmethod
    def _token(token: str) -> list[str]:
        if token[0].isdigit():
            return [f"o:digits {min(9, len(token))}"]
        return ["o:letters" if token[0].isalpha() else f"o:{token}" if token in "@+(" else "o:mark"]

    def _numbers(self, text):
        starts, ends = self.starts, self.ends
        for s, a in enumerate(starts):
            c = text[a]
            if not ("0" <= c <= "9" or c in "+("):
                continue
            digits, e = 0, s
            while e < len(starts) and e - s < MOST_TOKENS and digits <= MOST_DIGITS:
                first = text[starts[e]]
                if "0" <= first <= "9":
                    digits += ends[e] - starts[e]
                    if 7 <= digits <= MOST_DIGITS:
                        yield s, e + 1, (1, 2, 3), number_features(text, a, ends[e])
                elif first not in " \t().-/" and not (e == s and first == "+"):
                    break
                e += 1

    def _addresses(self, text, lo, hi):
        starts, ends = self.starts, self.ends
        for sign in _SIGN.finditer(text, lo, hi):
            host = _HOST.match(text, sign.end(), min(hi, sign.end() + _RIGHT))
            before = text[max(lo, sign.start() - _LEFT) : sign.start()]
            before = before if sign.group()[0] == " " else before.removesuffix(" ")
            local = len(before) - len(before.rstrip(LOCAL))
            if not host or not local:
                continue
            first = bisect_left(starts, sign.start() - local - 1)
            for s in range(first, bisect_left(starts, sign.start())):
                for e in range(bisect_left(ends, sign.end() + 1), min(bisect_right(ends, host.end()), s + MOST_TOKENS)):
                    m = _ADDRESS.fullmatch(text, starts[s], ends[e])
                    if m:
                        yield s, e + 1, (0,), address_features(text, starts[s], ends[e], m)


# ---- the field --------------------------------------------------------------------------------


def _add(values: list[float]) -> float:
    most = max(values)
    return most if most == -math.inf else most + math.log(sum(math.exp(v - most) for v in values))


class SemiCrf:
    """Weights per (feature, kind) and per pair of kinds that follow each other."""

    def __init__(self, names: list[str]):
        self.place = {name: k for k, name in enumerate(names)}
        self.weight = np.zeros((len(names), NONE + 1))
        self.step = np.zeros((NONE + 1, NONE + 1))

    def _rows(self, features: list[str]) -> list[int]:
        place = self.place
        return [place[f] for f in features if f in place]

    def graph(self, lattice: Lattice) -> list[list[tuple[int, int, list[int]]]]:
        """Segments that end at each token: (start, kind, feature rows)."""
        out = [[(k, NONE, self._rows(f))] for k, f in enumerate(lattice.plain)]
        for s, e, kinds, features in lattice.segments:
            rows = self._rows(features)
            out[e - 1] += [(s, y, rows) for y in kinds]
        return out

    def scores(self, graph) -> list[list[float]]:
        weight = self.weight
        return [[float(weight[rows, y].sum()) for _, y, rows in segments] for segments in graph]

    def forward(self, graph, scores, join) -> list[list[float]]:
        """alpha[t][y]: ``join`` (sum or maximum of logarithms) over all ways to cut the first t tokens, the last segment of kind y."""
        step = self.step.tolist()
        alpha = [[-math.inf] * NONE + [0.0]]  # before the first token: as after one of no kind
        for segments, values in zip(graph, scores):
            into: list[list[float]] = [[] for _ in range(NONE + 1)]
            for (s, y, _), value in zip(segments, values):
                into[y].append(value + join([a + step[k][y] for k, a in enumerate(alpha[s])]))
            alpha.append([join(v) if v else -math.inf for v in into])
        return alpha

    def decode(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the segments of the best cut, as places in the text."""
        graph = self.graph(lattice)
        scores, step = self.scores(graph), self.step.tolist()
        alpha = self.forward(graph, scores, max)
        out, t = [], len(graph)
        y = max(range(NONE + 1), key=lambda k: (alpha[t][k], k)) if t else NONE
        while t:
            ways = [
                (value + alpha[s][k] + step[k][y], -s, k)
                for (s, kind, _), value in zip(graph[t - 1], scores[t - 1]) if kind == y for k in range(NONE + 1)
            ]
            _, s, before = max(ways)
            if y != NONE:
                out.append((y, lattice.starts[-s], lattice.ends[t - 1]))
            t, y = -s, before
        return out[::-1]

    def gradient(self, graph, gold: list[tuple[int, int, int]], weight: np.ndarray, step: np.ndarray) -> float:
        """Add the gradient of a lattice's log-likelihood to ``weight`` and ``step``; ``gold`` holds (start, end, kind) in tokens."""
        scores, table = self.scores(graph), self.step.tolist()
        alpha = self.forward(graph, scores, _add)
        total = _add(alpha[-1])
        beta = [[-math.inf] * (NONE + 1) for _ in range(len(graph))] + [[0.0] * (NONE + 1)]
        for t in range(len(graph), 0, -1):
            for (s, y, rows), value in zip(graph[t - 1], scores[t - 1]):
                after = value + beta[t][y]
                if after == -math.inf:
                    continue
                share = 0.0
                for k in range(NONE + 1):
                    beta[s][k] = _add([beta[s][k], table[k][y] + after])
                    p = math.exp(min(0.0, alpha[s][k] + table[k][y] + after - total))
                    step[k, y] -= p
                    share += p
                weight[rows, y] -= share
        t, before, score = 0, NONE, 0.0
        stops = {s: (e, y) for s, e, y in gold}
        while t < len(graph):
            e, y = stops.get(t, (t + 1, NONE))
            at = next(k for k, (s, kind, _) in enumerate(graph[e - 1]) if (s, kind) == (t, y))
            weight[graph[e - 1][at][2], y] += 1
            step[before, y] += 1
            score += scores[e - 1][at] + table[before][y]
            t, before = e, y
        return score - total

    def fit(self, examples: list[tuple[Lattice, list[tuple[int, int, int]]]], epochs: int = EPOCHS, batch: int = 16, seed: int = 3) -> None:
        """Adam with weight decay on the log-likelihood."""
        graphs = [(self.graph(x), gold) for x, gold in examples]
        draw, size, t = np.random.default_rng(seed), self.weight.size, 0
        mean, square = np.zeros(size + self.step.size), np.zeros(size + self.step.size)
        for _ in range(epochs):
            order = draw.permutation(len(graphs))
            for lo in range(0, len(order), batch):
                weight, step = np.zeros_like(self.weight), np.zeros_like(self.step)
                for k in order[lo : lo + batch]:
                    self.gradient(*graphs[k], weight, step)
                slope = np.concatenate([weight.ravel(), step.ravel()]) / batch
                slope -= 0.001 * np.concatenate([self.weight.ravel(), self.step.ravel()])
                t += 1
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope * slope - square)
                move = 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
                self.weight += move[:size].reshape(self.weight.shape)
                self.step += move[size:].reshape(self.step.shape)


# ---- what is learned from ---------------------------------------------------------------------


def gold_of(lattice: Lattice, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]] | None:
    """Spans as (start, end, kind) in tokens; None if the lattice has no such segment or spans overlap."""
    begin = {a: k for k, a in enumerate(lattice.starts)}
    end = {b: k + 1 for k, b in enumerate(lattice.ends)}
    there = {(s, e, y) for s, e, kinds, _ in lattice.segments for y in kinds}
    out = []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        found = (begin.get(a), end.get(b), KINDS.index(kind))
        if found not in there or (out and found[0] < out[-1][1]):
            return None
        out.append(found)
    return out


def _digits(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def card_number(draw: random.Random, n: int, valid: bool) -> str:
    body = _digits(draw, n - 1)
    good = next(c for c in "0123456789" if luhn(body + c))
    return body + (good if valid else draw.choice([c for c in "0123456789" if c != good]))


def _made_item(draw: random.Random, words: list[str]) -> tuple[str, str | None]:
    """Something written in one of many ways, and its kind (None: only looks like personal data)."""
    def name():
        return re.sub(r"[^A-Za-z0-9]", "", draw.choice(words)) or "name"

    def ip(top):
        return ".".join(str(draw.randint(0, top)) for _ in range(4))

    def card(valid):
        number = card_number(draw, draw.choice([16] * 8 + [17, 18, 19]), valid)
        mark = draw.choice(["", "", " ", "-"])
        return mark.join(number[k : k + 4] for k in range(0, len(number), 4))

    kind = draw.random()
    if kind < 0.2:
        local = name() + draw.choice(["", "." + name(), "_" + name(), ".%d" % draw.randint(0, 99), "+" + name()])
        host = draw.choice([name(), "mail%d.example" % draw.randint(1, 9), name() + "-" + name()])
        top = draw.choice(["com", "org", "net", "de", "fr", "es", "co.uk"])
        at, dot = draw.choice([("@", ".")] * 3 + [(" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", ".")])
        return local + at + (host + "." + top).replace(".", dot), "email"
    if kind < 0.35:
        return ip(255), "ip"
    if kind < 0.5:
        return card(True), "card"
    if kind < 0.7:
        a, b, c = _digits(draw, 3), _digits(draw, 3), _digits(draw, 4)
        country = str(draw.choice([1, 1, 1, 33, 34, 44, 49, 351]))
        forms = [f"+{country} ({a}) {b}-{c}"] * 4 + [
            f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country} {a}{b}{c}", f"+{country}.{a}.{b}.{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}"
        ]
        return draw.choice(forms), "phone"
    year, month, day = draw.randint(1900, 2030), draw.randint(1, 12), draw.randint(1, 28)
    return draw.choice([
        card(False), card(False), card(False), _digits(draw, draw.randint(7, 15)), _digits(draw, draw.randint(20, 40)),
        f"{year}-{month:02d}-{day:02d} {draw.randint(0, 23):02d}:00", f"{year}{month:02d}{day:02d}", f"{day:02d}.{month:02d}.{year}",
        f"{day:02d}/{month:02d}/{year} - {day:02d}/{month:02d}/{year + 1}", f"{year}-{year + 9}", f"{_digits(draw, 2)}.{_digits(draw, 8)}",
        ".".join(str(draw.randint(256, 999)) for _ in range(4)), f"{draw.randint(0, 9)}.{draw.randint(0, 99)}.{_digits(draw, 5)}",
        "978-3-%s-%s-%s" % (_digits(draw, 2), _digits(draw, 6), _digits(draw, 1)), "%d,%s,%s" % (draw.randint(1, 99), _digits(draw, 3), _digits(draw, 3)),
        " ".join(_digits(draw, 3) for _ in range(draw.randint(3, 9))), hashlib.sha1(_digits(draw, 9).encode()).hexdigest(),
        "@" + name(), f"{name()} @ {draw.randint(1, 9)}", f"{name()} at {name()}", f"{name()} at {name()}. {name().title()}", f"{name()}@{name()}",
        " ".join(str(draw.randint(0, 9)) for _ in range(draw.randint(8, 12))),
    ]), None


_LEADS = ("call", "tel", "phone", "mail", "contact", "card", "from", "host", "ip", "to", "no", "number", "order", "id", "version", "token")


def made_lines(words: list[str], count: int = MADE, seed: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with what they hold, in the words of the corpus."""
    draw, out = random.Random(seed), []
    words = words or ["word"]
    for _ in range(count):
        text, spans = " ".join(draw.choice(words) for _ in range(draw.randint(0, 4))), []
        for _ in range(draw.choice([1, 1, 1, 2, 2, 3])):
            item, kind = _made_item(draw, words)
            lead = draw.choice(_LEADS) + draw.choice([" ", ": ", " = "]) if draw.random() < 0.2 else draw.choice(["", "", "", "", "\"", "(", "#"])
            text += (" " if text else "") + lead
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + draw.choice(["", "", "", "", ".", ",", ")", "\"", "!!", "%%%", "###", ";"])
        text += draw.choice([" ", "\n", ". "]) + " ".join(draw.choice(words) for _ in range(draw.randint(0, 4)))
        out.append((text, spans))
    return out


def _examples(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """Each island with some text around it and the spans in it, by places in that piece."""
    out = []
    for lo, hi in islands(text):
        a, b = max(0, lo - 2 * _NEAR), min(len(text), hi + 2)
        out.append((text[a:b], lo - a, hi - a, [(k, s - a, e - a) for k, s, e in spans if s >= lo and e <= hi]))
    return out


def _unclear(text: str) -> bool:
    """A pattern took a run that is too long for it: what stands there is not known."""
    return any(len(digits_of(m.group())) > 19 for m in _CARD.finditer(text)) or any(len(digits_of(m.group())) > 15 for m in _PHONE.finditer(text))


def learned_islands(docs: DataFrame, texts: int = LEARNED_TEXTS, most: int = LEARNED_ISLANDS) -> tuple[list[tuple], list[str]]:
    """Islands of a sample with what the patterns find there, and words of the sample; bounded by ``most`` rows."""
    bounded_batches(docs.sparkSession)
    count = docs.count()
    place = F.pmod(F.xxhash64(F.col("text"), F.lit("personal data")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & (place < texts / max(1, count)))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = re.findall(r"[^\W\d_]+", text[:400])[:5]
                rows.append((" ".join(words), None, None, None))
                for piece, lo, hi, spans in _examples(text, base_spans(text)):
                    if not _unclear(piece):
                        rows.append((piece, lo, hi, ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["piece", "lo", "hi", "spans"])

    found = sample.mapInArrow(run, "piece string, lo int, hi int, spans string").distinct()
    ordered = found.orderBy(F.xxhash64("piece"), "piece", "lo", "hi", "spans")
    pieces = ordered.filter("lo IS NOT NULL").limit(most).collect()
    words = ordered.filter("lo IS NULL").limit(most).collect()
    examples = [
        (r.piece, r.lo, r.hi, [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]) for r in pieces
    ]
    return examples, sorted({w for r in words for w in r.piece.split()})


def train(docs: DataFrame | None = None, epochs: int = EPOCHS) -> SemiCrf:
    """A field fitted on a sample of ``docs`` (None: on made lines alone)."""
    found, words = learned_islands(docs) if docs is not None else ([], [])
    pieces = [*found, *(e for text, spans in made_lines(words) for e in _examples(text, spans))]
    examples = []
    for piece, lo, hi, spans in pieces:
        lattice = Lattice(piece, lo, hi)
        gold = gold_of(lattice, spans)
        if gold is not None:
            examples.append((lattice, gold))
    seen = Counter(f for lattice, _ in examples for s in lattice.segments for f in s[3])
    plain = {f for lattice, _ in examples for features in lattice.plain for f in features}
    field = SemiCrf(sorted(plain | {f for f, n in seen.items() if n > 2 or ":word" not in f}))
    field.fit(examples, epochs)
    return field


# ---- texts ------------------------------------------------------------------------------------


def all_spans(text: str, field: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the patterns, all spans) of a text, kinds as listed, then by start."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added, k, reach = [], 0, 0
    for lo, hi in islands(text):
        for y, s, e in field.decode(Lattice(text, lo, hi)):
            while k < len(taken) and taken[k][0] < e:  # ends of all that begin before e
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= s:
                added.append((KINDS[y], s, e))
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, field: SemiCrf | None = None) -> DataFrame:
    """op12: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = field or train(docs)
    bounded_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "", field)
                found = Counter(k for k, _, _ in base)
                counts.append([found[k] for k in KINDS])
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(every))
            columns = zip(*counts) if counts else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, field: SemiCrf | None = None) -> DataFrame:
    """doc_id and its text with every span replaced by its kind in brackets; overlapping spans become one."""
    field = field or train(docs)
    bounded_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, s, e in sorted(all_spans(text, field)[1], key=lambda s: (s[1], -s[2])):
            if s >= at:
                out += [text[at:s], f"[{kind}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            texts = pa.array(list(map(clean, batch.column("text").to_pylist())), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")
