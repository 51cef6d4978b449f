import math
import random

from gristmill.llm import secret_scan

ORDINARY = "/the_tion/with_heit/lich_que/cion_des/para_ment"


def window_scores(scanner, text):
    """By plain scoring of each window."""
    inside = set()
    for name, a in scanner.formats.items():
        for n in scanner.lengths[name]:
            for k in range(len(text) - n + 1):
                w = text[k:k + n]
                has = any(c.isdigit() for c in w) and any(c.isalpha() for c in w)
                score = (a.log_likelihood(secret_scan.symbols(w)) - scanner.background(secret_scan.symbols("    " + w)[4:])) / n
                assert not math.isnan(score)
                if has and score >= secret_scan.THRESHOLD:
                    inside |= set(range(k, k + n))
    return inside


def test_secret_behind_long_ordinary_run():
    scanner = secret_scan.default_scanner()
    key = "ghp_" + "aB3" * 12
    ahead = (ORDINARY * 20)[:700] + "/"
    spans = secret_scan.format_spans(scanner, "see " + ahead + key + "/" + ORDINARY * 9)
    start = 4 + len(ahead)
    assert any(a <= start and start + len(key) <= b for a, _, b in spans)
    widest = max(map(max, scanner.lengths.values()))
    assert all(start - widest < a and b < start + len(key) + widest for a, _, b in spans)  # only windows that touch the key
    assert secret_scan.format_spans(scanner, "see " + ahead + ORDINARY * 9) == []


def test_windows_equal_plain_scores():
    scanner = secret_scan.default_scanner()
    rng = random.Random(3)
    text = ORDINARY * 2 + "".join(rng.choice("abcXYZ0189+/_-=.") for _ in range(60)) + "AIza" + "a7-Q_" * 7 + ORDINARY
    found = {k for a, b in scanner.windows(text) for k in range(a, b)}
    assert found == window_scores(scanner, text)
