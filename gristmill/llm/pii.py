"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field labels tokens (letter runs, digit runs, single other characters) as the
beginning or inside of an e-mail address, an IP address, a card or a phone number.
Features are word shapes of a token and its neighbours.  It is trained from a small
labelled table by gradient steps on the likelihood, and decoded by Viterbi for many
sequences at once in numpy.

No span can do without a digit, an @ or a spelled-out "at" or "dot", so sequences are the
surroundings of those, out to white space, so that none begins or ends inside an unbroken
run; the rest of a text is outside by rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spans import Span, columns, scan
from ._store import ship

KINDS = ["email", "ip", "card", "phone"]

# --- fixed patterns -----------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long runs without one cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            out.append((start, floor))
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _short(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(map(_short, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


# --- the field ----------------------------------------------------------------

TRIGGER = re.compile(r"[0-9@]|[\[({]\s?[Aa][Tt]\s?[\])}]|(?<![A-Za-z])[Aa][Tt](?=\s+[A-Za-z0-9-]+\.[A-Za-z])|(?<![A-Za-z])[Dd][Oo][Tt](?![A-Za-z])")
AROUND = 80
_WHITE = re.compile(r"\s")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_LEXICON = {w: k for k, w in enumerate("at dot com org net edu tel phone call fax mobile cell card visa credit ip host mail email".split())}
_PUNCT = {c: k for k, c in enumerate("@.-()+:[]{}/_,;=#'\"<>%*&!?|")}
SHAPES = 96
LABELS = 1 + 2 * len(KINDS)
_TRIGRAMS = 1 << 14
FEATURES = 5 * 2 * SHAPES + 2 * (2 * SHAPES) ** 2 + _TRIGRAMS


def shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        if n <= 3:
            return 1 + (n - 1) * 2 + (n == 3 and int(token) > 255)
        return 8 + min(n, 20) - 4
    if c.isascii() and c.isalpha():
        word = _LEXICON.get(token.lower())
        if word is not None:
            return 60 + word
        return 26 + 3 * min(len(token) // 3, 3) + (0 if token.islower() else 1 if token[1:].islower() else 2)
    return 40 + (_PUNCT[c] if c in _PUNCT and _PUNCT[c] < 19 else 19)


def tokens(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of the tokens, and their shapes (odd ones follow white space)."""
    spans, codes, last = [], [], -1
    for m in _TOKEN.finditer(text):
        spans.append(m.span())
        codes.append(2 * shape(m.group()) + (m.start() != last))
        last = m.end()
    return spans, np.array(codes, np.int64)


def features(codes: np.ndarray) -> np.ndarray:
    """Feature numbers of each token, tokens x 8; code 0 stands for what lies beyond the ends."""
    n, wide = len(codes), 2 * SHAPES
    padded = np.concatenate([[0, 0], codes, [0, 0]])
    near = [padded[k:k + n] for k in range(5)]
    out = [near[k] + k * wide for k in range(5)]
    start = 5 * wide
    out += [start + near[1] * wide + near[2], start + wide**2 + near[2] * wide + near[3]]
    out.append(start + 2 * wide**2 + (near[1] * 40503 + near[2] * 10007 + near[3] * 2971) % _TRIGRAMS)
    return np.stack(out, axis=1)


#: Inside labels follow only their own kind.
_ALLOWED = np.ones((LABELS, LABELS), bool)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = False
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True


@dataclass
class Field:
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of every sequence of shapes; sequences of like length advance together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            longest, end = len(sequences[order[at]]) * 5 // 4 + 4, at
            while end < len(order) and len(sequences[order[end]]) <= longest and (end - at + 1) * longest <= 1 << 16:
                end += 1
            end = max(end, at + 1)
            self._group(sequences, order[at:end], out)
            at = end
        return out

    def _group(self, sequences, group, out) -> None:
        steps = max(len(sequences[k]) for k in group)
        if not steps:
            return
        score = np.zeros((len(group), steps, LABELS), np.float32)
        for r, k in enumerate(group):
            if len(sequences[k]):
                score[r, :len(sequences[k])] = self.emit[features(sequences[k])].sum(axis=1)
        move = np.where(_ALLOWED, self.move, -1e9).astype(np.float32)
        back = np.zeros((len(group), steps, LABELS), np.int8)
        best = score[:, 0] + np.where(_ALLOWED[0], 0, -1e9).astype(np.float32)
        sizes = np.array([len(sequences[k]) for k in group])
        final = best.copy()
        for t in range(1, steps):
            ways = best[:, :, None] + move
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + score[:, t]
            final = np.where((sizes > t)[:, None], best, final)
        label = final.argmax(axis=1)
        for r, k in enumerate(group):
            n, path, now = len(sequences[k]), [], int(label[r])
            for t in range(n - 1, -1, -1):
                path.append(now)
                now = int(back[r, t, now])
            out[k] = np.array(path[::-1], np.int64)


def labelled_table(rows: int = 900, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences with and without personal data in many spellings, made by rule."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    words = "the of to and report order please see our new house were in on for a an or this that again from ask team green water".split()
    foreign = "der und die las que été naïve über señor être für más".split()
    names = "anna lee.chan bob_s m.kowalski jo info sales kim2 office.help r-smith was.91 thing.55".split()
    dotted = [n for n in names if not n.isalpha()]
    hosts = "example shop mail4 my-site intra corp".split()
    tops = "com org net edu de io".split()

    def word() -> str:
        w = pick(words) if rng.random() < 0.8 else pick(foreign)
        return w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.05 else w

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+49 {digits(3)} {digits(7)}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"00{digits(2)} {digits(3)} {digits(7)}"])

    def card() -> str:
        d = [digits(4) for _ in range(4)]
        return pick([" ".join(d), "-".join(d), "".join(d), "".join(d), ".".join(d)])

    def ip() -> str:
        p = [str(int(x)) for x in rng.integers(0, 256, 4)]
        return pick([".".join(p), ".".join(p), "[.]".join(p), f"{p[0]}.{p[1]}.{p[2]}[.]{p[3]}"])

    def email() -> str:
        n, h, t = pick(names), pick(hosts), pick(tops)
        return pick([f"{n}@{h}.{t}", f"{n}@{h}.example.{t}", f"{n} [at] {h}.{t}", f"{n}(at){h}.{t}", f"{n} (at) {h} dot {t}", f"{n} at {h} dot {t}", f"{n} [at] {h} [dot] {t}", f"{pick(dotted)} at {h}.{t}"])

    def nothing() -> str:
        return pick([
            digits(1), digits(2), digits(3), digits(4), digits(5), digits(6), f"{digits(2)},{digits(3)}", f"{digits(1)}.{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}",
            f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"#{digits(6)}", f"{digits(3)}%", f"v{digits(1)}.{digits(2)}", digits(8), digits(9), digits(11), digits(13),
            f"{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)}", f"{digits(2)}-{digits(2)}", f"${digits(3)}.{digits(2)}", f"({digits(4)})", f"[{digits(2)}]", f"@{pick(hosts)}", "dot", f"{pick(words)} dot {pick(words)}", digits(20), f"{digits(4)} {digits(4)}",
            f"{word()} at {pick(hosts)}.{pick(tops)}", f"meet at {digits(1)} pm", f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(3)}9{digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(4)}", f"{pick(words)}{digits(2)}", f'"{digits(3)}a{digits(4)}b{digits(2)}f"',
        ])

    out = []
    for _ in range(rows):
        text, spans = " ".join(word() for _ in range(int(rng.integers(0, 5)))), []
        for _ in range(int(rng.integers(1, 4))):
            kind = int(rng.integers(-4, 4))
            piece = nothing() if kind < 0 else (email, ip, card, phone)[kind]()
            text += pick([" ", " ", " ", ", ", ": ", " (", "\n"]) if text else ""
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + pick(["", "", "", ".", ",", "!!", ")"]) + " " + " ".join(word() for _ in range(int(rng.integers(1, 4))))
        out.append((text, spans))
    return out


def _gold(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    where, codes = tokens(text)
    gold = np.zeros(len(codes), np.int64)
    for start, kind, end in spans:
        inside = [k for k, (a, b) in enumerate(where) if a >= start and b <= end]
        gold[inside] = 2 + 2 * kind
        gold[inside[0]] = 1 + 2 * kind
    return codes, gold


def train(table: list[tuple[str, list[Span]]], epochs: int = 45) -> Field:
    """Maximum likelihood with a little shrinkage; forward and backward sums run over all sequences at once."""
    rows = [_gold(*r) for r in table]
    steps, n = max(len(c) for c, _ in rows), len(rows)
    feats, gold, mask = np.zeros((n, steps, 8), np.int64), np.zeros((n, steps), np.int64), np.zeros((n, steps), bool)
    for r, (codes, labels) in enumerate(rows):
        feats[r, :len(codes)], gold[r, :len(codes)], mask[r, :len(codes)] = features(codes), labels, True
    used, flat = np.unique(feats[mask], return_inverse=True)
    flat = flat.reshape(-1, 8)
    emit, move = np.zeros((len(used), LABELS)), np.zeros((LABELS, LABELS))
    block = np.where(_ALLOWED, 0, -1e9)
    params, first, second = [emit, move], [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    pairs = mask[:, 1:]
    seen_moves = np.bincount((gold[:, :-1] * LABELS + gold[:, 1:])[pairs], minlength=LABELS**2).reshape(LABELS, LABELS)
    target = np.eye(LABELS)[gold[mask]]
    for step in range(1, epochs + 1):
        score = np.zeros((n, steps, LABELS))
        score[mask] = emit[flat].sum(axis=1)
        a, b = np.zeros((n, steps, LABELS)), np.zeros((n, steps, LABELS))
        a[:, 0] = score[:, 0] + block[0]
        m = move + block
        for t in range(1, steps):
            ways = a[:, t - 1, :, None] + m
            top = ways.max(axis=1)
            a[:, t] = np.where(mask[:, t, None], top + np.log(np.exp(ways - top[:, None]).sum(axis=1)) + score[:, t], a[:, t - 1])
        for t in range(steps - 2, -1, -1):
            ways = (score[:, t + 1] + b[:, t + 1])[:, None, :] + m
            top = ways.max(axis=2)
            b[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(ways - top[..., None]).sum(axis=2)), 0)
        last = a[:, -1]
        total = last.max(axis=1) + np.log(np.exp(last - last.max(axis=1, keepdims=True)).sum(axis=1))
        single = np.exp(a + b - total[:, None, None])[mask]
        joint = np.zeros((LABELS, LABELS))
        for t in range(1, steps):
            here = mask[:, t]
            if here.any():
                joint += np.exp(np.minimum(a[here, t - 1, :, None] + m + (score[here, t] + b[here, t])[:, None, :] - total[here, None, None], 0)).sum(axis=0)
        error = single - target
        g = np.stack([np.bincount(flat.reshape(-1), np.repeat(error[:, c], 8), len(used)) for c in range(LABELS)], axis=1)
        for k, (p, gradient) in enumerate(zip(params, (g + 0.05 * emit, joint - seen_moves + 0.05 * move), strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.99 * second[k] + 0.01 * gradient**2
            p -= 0.1 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((FEATURES, LABELS), np.float32)
    full[used] = emit
    return Field(full, move.astype(np.float32))


@cache
def default_field() -> Field:
    return train(labelled_table())


def _surroundings(text: str) -> list[tuple[int, int]]:
    """Windows of AROUND characters about every trigger, widened to the next white space and joined where they touch; linear in the text."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        floor = out[-1][1] if out else 0
        if out and m.end() + AROUND <= floor:
            continue
        start = max(floor, m.start() - AROUND)
        while start > floor and not text[start - 1].isspace():
            start -= 1
        white = _WHITE.search(text, m.end() + AROUND)
        end = white.start() if white else len(text)
        if out and start <= floor:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def field_spans(field: Field, texts: list[str], base: list[list[Span]] | None = None) -> list[list[Span]]:
    out: list[list[Span]] = [[] for _ in texts]
    sequences, origin = [], []
    for k, text in enumerate(texts):
        for a, b in _surroundings(text):
            where, codes = tokens(text[a:b])
            if len(codes):
                sequences.append(codes)
                origin.append((k, a, where))
    for (k, a, where), labels in zip(origin, field.decode(sequences), strict=True):
        t = 0
        while t < len(labels):
            if labels[t] % 2 == 1:
                end = t + 1
                while end < len(labels) and labels[end] == labels[t] + 1:
                    end += 1
                out[k].append((a + where[t][0], int(labels[t]) // 2, a + where[end - 1][1]))
                t = end
            else:
                t += 1
    return out


def find(spark: SparkSession, documents: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``documents``.

    The counts and the digest are those of the fixed patterns; ``spans`` has theirs and
    those that the field adds beside them.  Null texts count as empty.  Rows are neither
    dropped nor merged, whatever their doc_id; other columns are ignored.
    """
    ship(spark)
    field = field or default_field()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan(base_spans, lambda texts, base: field_spans(field, texts, base), KINDS, len(KINDS)), columns(KINDS))
