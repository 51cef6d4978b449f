"""Secrets: fixed patterns, and probabilistic automata learnt from labelled credentials for other formats.

For every format a prefix tree of its labelled credentials is built over classes of
characters, and states whose outgoing frequencies are compatible (a Hoeffding bound, on
the states and on their successors) are merged until none are left.  The result is a
probabilistic automaton.  Every candidate string of every text is scored by the best
automaton's likelihood, its end included, per character, against that of ordinary strings:
words, names of files, classes and hosts, dates, numbers, identifiers of records.  Of a long one
that does not count as a whole, every window as long as a labelled credential of a
format is scored by that format, and the windows that count are reported, joined where
they overlap.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spans import Span, apart, columns, scan
from ._store import ship

KINDS = ["assign", "access", "hex", "format"]  # the last for what the automata add

# --- fixed patterns -----------------------------------------------------------

_either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
ASSIGN = re.compile(f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_HINT = re.compile("(?i)pass|secret|token|key", re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")


def base_spans(text: str) -> list[Span]:
    out = []
    if ("=" in text or ":" in text) and _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


# --- automata -----------------------------------------------------------------

#: Candidates: strings this long of these characters, with a digit and a letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
#: Candidates over this length that do not count as a whole are also scored window by window.
LONG = 512
#: Log-likelihood per character over that of ordinary strings from which a candidate counts.
THRESHOLD = 0.35
ALPHA = 0.05
_PREFIX = 4  # the first characters keep their identity: formats are told by how they begin


def symbols(text: str) -> list[str]:
    """The first characters as they are, then classes: digit, hexadecimal letter, other letter (by case), or the sign itself."""
    out = list(text[:_PREFIX])
    for c in text[_PREFIX:]:
        out.append("d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "a" <= c <= "z" else "H" if "A" <= c <= "F" else "U" if "A" <= c <= "Z" else c)
    return out


#: How many characters a class stands for, to turn class probabilities into those of characters.
_WIDTH = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}


#: Symbols and the end; what each adds to every count.
SIGNS, SMOOTH = 71, 0.01
_END = "$$"


@dataclass
class Automaton:
    """States with counts; ``moves[s][symbol]`` is the next state and ``counts[s][symbol]`` how often it was taken."""

    moves: list[dict[str, int]] = field(default_factory=lambda: [{}])
    counts: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])

    def add(self, word: list[str]) -> None:
        state = 0
        for s in word:
            then = self.moves[state].get(s)
            if then is None:
                then = len(self.moves)
                self.moves[state][s] = then
                self.moves.append({})
                self.counts.append({})
                self.ends.append(0)
            self.counts[state][s] = self.counts[state].get(s, 0) + 1
            state = then
        self.ends[state] += 1

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.counts[s].values())

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the shares of ends and moves agree in both states and in all pairs of states that the same symbols lead to."""
        work, seen = [(a, b)], {(a, b)}
        while work:
            x, y = work.pop()
            nx, ny = self.total(x), self.total(y)
            if self._differ(nx, self.ends[x], ny, self.ends[y]):
                return False
            if any(self._differ(nx, self.counts[x].get(s, 0), ny, self.counts[y].get(s, 0)) for s in {*self.counts[x], *self.counts[y]}):
                return False
            for s in self.moves[x].keys() & self.moves[y].keys():
                pair = self.moves[x][s], self.moves[y][s]
                if pair[0] != pair[1] and pair not in seen:
                    seen.add(pair)
                    work.append(pair)
        return True

    def merge(self, a: int, b: int) -> None:
        """Folds the tree below ``b`` into ``a``."""
        for state in self.moves:
            for s, then in state.items():
                if then == b:
                    state[s] = a
        work = [(a, b)]
        while work:
            x, y = work.pop()
            if x == y:
                continue
            self.ends[x] += self.ends[y]
            self.ends[y] = 0
            for s, then in list(self.moves[y].items()):
                self.counts[x][s] = self.counts[x].get(s, 0) + self.counts[y].pop(s, 0)
                if s in self.moves[x]:
                    work.append((self.moves[x][s], then))
                else:
                    self.moves[x][s] = then
            self.moves[y] = {}

    def log_likelihood(self, word: list[str]) -> float:
        """The end included; an unseen move gets the smoothed share and stays in its state."""
        state, out = 0, 0.0
        for s in word:
            out += math.log((self.counts[state].get(s, 0) + SMOOTH) / (self.total(state) + SMOOTH * SIGNS)) - math.log(_WIDTH.get(s, 1))
            state = self.moves[state].get(s, state)
        return out + math.log((self.ends[state] + SMOOTH) / (self.total(state) + SMOOTH * SIGNS))


def learn(words: list[str]) -> Automaton:
    """Red-blue merging: the frontier's states are merged into the first compatible settled state, or settled themselves."""
    one = Automaton()
    for w in sorted(words):
        one.add(symbols(w))
    red = [0]
    while True:
        blue = sorted({then for s in red for then in one.moves[s].values()} - set(red))
        if not blue:
            return one
        b = max(blue, key=lambda s: (one.total(s), -s))
        for a in red:
            if one.compatible(a, b):
                one.merge(a, b)
                break
        else:
            red.append(b)


def labelled_table(rows: int = 60, seed: int = 5) -> tuple[dict[str, list[str]], list[str]]:
    """The small labelled table: credentials by format, and ordinary long strings, made by rule."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, n: "".join(chars[k] for k in rng.integers(0, len(chars), n))
    every = upper + lower + digits
    formats = {
        "personal": [some(["ghp_", "gho_", "ghs_"], 1) + some(every, 36) for _ in range(rows)],
        "bot": [f"xoxb-{some(digits, 12)}-{some(digits, 12)}-{some(every, 24)}" for _ in range(rows)],
        "live": [some(["sk_live_", "pk_live_", "sk_test_"], 1) + some(every, int(rng.integers(24, 33))) for _ in range(rows)],
        "cloud": ["AIza" + some(every + "-_", 35) for _ in range(rows)],
        "web": [f"eyJ{some(every + '-_', int(rng.integers(30, 50)))}.eyJ{some(every + '-_', int(rng.integers(40, 80)))}.{some(every + '-_', 43)}" for _ in range(rows)],
        "upper_hex": [some("0123456789ABCDEF", int(n)) for n in rng.choice([32, 40, 64], rows)],
        "base64": [some(every + "+/", 40) for _ in range(rows)],
    }
    stems = "the tion re ment an er qu eau ing ver ein sch ado cion des para with heit lich que".split()
    low_hex = lambda n: some("0123456789abcdef", n)
    parts = lambda n: [stems[j] for j in rng.integers(0, len(stems), n)]
    camel = lambda n: "".join(p.capitalize() for p in parts(n))
    ordinary = []
    for k in range(24 * rows):
        word = "".join(parts(int(rng.integers(5, 12))))
        ordinary.append([
            word, word.capitalize(), word + "-" + word[:6], f"{word}.{some(digits, 2)}", f"www.{word}.com", word[:9].upper() + "_" + word[:9].upper(), f"20{some(digits, 2)}-{some(digits, 2)}-{some(digits, 2)}-{word[:8]}", some(digits, int(rng.integers(16, 21))),
            f"/{word[:6]}/{word[3:9]}/{word[:5]}{some(digits, 1)}", "=" * 20 + word[:3], f"{word[:7]}_v{some(digits, 1)}.{some(digits, 2)}.tar.gz", f"{some(digits, 3)}.{some(digits, 3)}.{some(digits, 3)}.{some(digits, 4)}",
            "-".join(low_hex(n) for n in (8, 4, 4, 4, 12)), camel(int(rng.integers(4, 9))), f"{camel(4)}{some(digits, 1)}{camel(2)}", parts(1)[0] + camel(5) + some(digits, 1), "_".join(parts(5)) + f"_{some(digits, 2)}", f"com.{word[:5]}.{word[2:9]}.{camel(3)}{some(digits, 1)}",
            f"IMG_20{some(digits, 6)}_{some(digits, 6)}.jpg", f"{word[:8]}-20{some(digits, 2)}-{some(digits, 2)}-{some(digits, 2)}.csv.gz", low_hex(int(rng.integers(16, 41))), f"{word[:8]}.{low_hex(8)}.min.js", "_".join(p.upper() for p in parts(4)) + f"_{some(digits, 1)}", f"{parts(1)[0]}-{parts(1)[0]}-{some(digits, 4)}-{some(digits, 6)}",
        ][k % 24][:64])
    return formats, [w for w in ordinary if len(w) >= 16]


@dataclass
class Scanner:
    formats: dict[str, Automaton]
    ordinary: dict[tuple[str, str], float]
    lengths: dict[str, list[int]] = field(default_factory=dict)
    known: dict[str, bool] = field(default_factory=dict)
    _tables: dict | None = field(default=None, repr=False)

    def _usual(self, last: str, s: str) -> float:
        return self.ordinary.get((last, s), self.ordinary.get((last, ""), -6.0))

    def background(self, word: list[str]) -> float:
        """Log-likelihood of an ordinary string, by pairs of neighbouring symbols, the end included."""
        out, last = 0.0, "^"
        for s in word:
            out += self._usual(last, s) - math.log(_WIDTH.get(s, 1))
            last = s
        return out + self._usual(last, _END)

    def score(self, text: str) -> tuple[float, str]:
        """Log-likelihood per character of the best format over ordinary strings, and its name."""
        word = symbols(text)
        usual = self.background(symbols("    " + text)[4:])
        best = max((a.log_likelihood(word), name) for name, a in self.formats.items())
        return (best[0] - usual) / max(1, len(word)), best[1]

    def _as_arrays(self) -> dict:
        """The automata (moves, log-likelihoods by state and sign, and of the end by state) and the background, by code of the sign."""
        if self._tables is None:
            width = np.zeros(128)
            for s, n in _WIDTH.items():
                width[ord(s)] = math.log(n)
            found = {}
            for name, a in self.formats.items():
                n = len(a.moves)
                moves, cost, ends = np.tile(np.arange(n, dtype=np.int32)[:, None], 128), np.zeros((n, 128)), np.zeros(n)
                for s in range(n):
                    taken = np.zeros(128)
                    for c, times in a.counts[s].items():
                        taken[ord(c)] = times
                    every = a.total(s) + SMOOTH * SIGNS
                    cost[s], ends[s] = np.log((taken + SMOOTH) / every) - width, math.log((a.ends[s] + SMOOTH) / every)
                    for c, then in a.moves[s].items():
                        moves[s, ord(c)] = then
                found[name] = moves, cost, ends
            signs = [chr(c) for c in range(128)]
            usual = np.array([[self._usual(a, b) for b in signs] for a in signs]) - width
            last = np.array([self._usual(a, _END) for a in signs])
            classes = np.array([ord(symbols("    " + c)[4]) for c in signs], np.uint8)
            self._tables = {"formats": found, "usual": usual, "last": last, "classes": classes}
        return self._tables

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Where windows as long as a labelled credential count by that format, joined where they overlap.  For ASCII."""
        tables = self._as_arrays()
        raw = np.frombuffer(text.encode("ascii"), np.uint8)
        kinds = tables["classes"][raw]
        usual = np.concatenate([[0.0, 0.0], np.cumsum(tables["usual"][kinds[:-1], kinds[1:]])])  # up to each place, without the first sign
        first = tables["usual"][ord("^"), kinds]
        letter = np.isin(kinds, np.frombuffer(b"hlHU", np.uint8))
        letters, digits = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, kinds == ord("d")))
        change = np.zeros(len(raw) + 1, np.int64)
        for name, (moves, cost, ends) in tables["formats"].items():
            for low in range(0, len(raw), 1 << 16):
                at = np.arange(low, min(low + (1 << 16), len(raw)))
                state, total = np.zeros(len(at), np.int32), np.zeros(len(at))
                for k in range(max(self.lengths[name])):
                    at = at[: max(0, len(raw) - k - low)]
                    state, total = state[: len(at)], total[: len(at)]
                    signs = (raw if k < _PREFIX else kinds)[at + k]
                    total = total + cost[state, signs]
                    state = moves[state, signs]
                    if k + 1 in self.lengths[name]:
                        end = at + k + 1
                        good = (total + ends[state] - first[at] - (usual[end] - usual[at + 1]) - tables["last"][kinds[end - 1]]) / (k + 1) >= THRESHOLD
                        good &= (letters[end] > letters[at]) & (digits[end] > digits[at])
                        np.add.at(change, at[good], 1)
                        np.add.at(change, end[good], -1)
        inside = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]

    def secret(self, text: str) -> bool:
        """Whether a candidate counts; the string needs a digit and a letter."""
        found = self.known.get(text)
        if found is None:
            has = any("0" <= c <= "9" for c in text) and any(c.isalpha() for c in text)
            found = has and self.score(text)[0] >= THRESHOLD
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[text] = found
        return found


def train(formats: dict[str, list[str]], ordinary: list[str]) -> Scanner:
    pairs: dict[tuple[str, str], int] = {}
    totals: dict[str, int] = {}
    for w in ordinary:
        last = "^"
        for s in symbols("    " + w)[4:]:
            pairs[last, s] = pairs.get((last, s), 0) + 1
            totals[last] = totals.get(last, 0) + 1
            last = s
        pairs[last, _END] = pairs.get((last, _END), 0) + 1
        totals[last] = totals.get(last, 0) + 1
    chances = {(a, b): math.log((n + 0.1) / (totals[a] + 7)) for (a, b), n in pairs.items()}
    chances |= {(a, ""): math.log(0.1 / (n + 7)) for a, n in totals.items()}
    return Scanner({name: learn(words) for name, words in formats.items()}, chances, {name: sorted({len(w) for w in words}) for name, words in formats.items()})


@cache
def default_scanner() -> Scanner:
    return train(*labelled_table())


def format_spans(scanner: Scanner, text: str) -> list[Span]:
    out = []
    for m in CANDIDATE.finditer(text):
        word = m.group().rstrip(".=-/")
        lead = len(word) - len(word.lstrip(".=-/+"))
        if len(word) - lead < 16:
            continue
        if scanner.secret(word[lead:]):
            out.append((m.start() + lead, 3, m.start() + len(word)))
        elif len(word) - lead > LONG:
            out += [(m.start() + lead + a, 3, m.start() + lead + b) for a, b in scanner.windows(word[lead:])]
    return out


def find(spark: SparkSession, documents: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``documents``.

    The counts and the digest are those of the fixed patterns; ``spans`` has theirs and,
    as kind ``format``, those that the automata add beside them.  Null texts count as
    empty.  Rows are neither dropped nor merged, whatever their doc_id; other columns are
    ignored.
    """
    ship(spark)
    scanner = scanner or default_scanner()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan(base_spans, lambda texts, base: [apart(format_spans(scanner, t), b) for t, b in zip(texts, base, strict=True)], KINDS, 3), columns(KINDS[:3]))
