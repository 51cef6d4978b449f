"""Base queries that SQL cannot say, against plain Python over their whole tables."""

import html as entities
import re
import string

import pytest

from gristmill import catalog
from gristmill.operators import chunker, findings, web

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet").collect()


def tags(text, name):
    return [(m.start(), m.end(), bool(m[1]), m.group().endswith("/>")) for m in re.finditer(rf"(?i)<(/?){name}\b[^>]*>", text)]


def closing(text, name, k):
    """The tag that closes the k-th tag of a name."""
    every, depth = tags(text, name), 0
    for tag in every[k:]:
        depth += -1 if tag[2] else 0 if tag[3] and tag != every[k] else 1
        if not depth:
            return tag
    return None


def without(text, names, accept):
    """All elements of some names at once: intervals first, then the outermost of them become a space."""
    gone = []
    for name in names:
        for k, (a, b, closes, alone) in enumerate(tags(text, name)):
            if not closes and accept(text[a:b]):
                end = None if alone else closing(text, name, k)
                gone.append((a, end[1] if end else b, bool(end) or alone))
    outer, at, n = [], 0, 0
    for a, b, whole in sorted(gone):
        if a >= at:
            outer.append((a, b))
            at, n = b, n + whole
    out, at = "", 0
    for a, b in outer:
        out, at = out + text[at:a] + " ", b
    return out + text[at:], n


def bad_tag(tag):
    found = re.search(r"""(?:^|[\s"'/])(?:id|class)\s*=\s*("[^"]{0,240}"|'[^']{0,240}'|[^\s>]{0,240})""", tag, re.I)
    return bool(found) and any(w in web.BOILERPLATE_WORDS.split("|") for w in parts(found[1].lower().replace('"', " ").replace("'", " ")))


def parts(value):
    """Every run of neighbouring pieces between separators, as a keyword may hold one."""
    pieces = re.split("([-_. ])", value)
    return {"".join(pieces[i:j]) for i in range(0, len(pieces), 2) for j in range(i + 1, min(i + 6, len(pieces) + 1), 2)}


def content(page):
    text = re.sub(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", " ", page)
    for name in web.NON_CONTENT:
        text = re.sub(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ", text)
        text = re.sub(rf"(?i)</?{name}\b[^>]*>", " ", text)
    total = 0
    for names, accept in [*(([n], lambda t: True) for n in web.SKELETON), (web.CONTAINERS, bad_tag)]:
        text, n = without(text, names, accept)
        total += n
    found = []
    for names, test in (
        (["article"], ""), (["main"], ""), (["div", "section"], r'\brole\s*=\s*"?main"?'), (["div", "section"], r'\b(?:id|class)\s*=\s*"[^"]*(?:article|post|content|entry|main)[^"]*"'),
    ):
        regions = []
        for name in names:
            for k, (a, b, closes, _) in enumerate(tags(text, name)):
                end = None if closes or not re.search("(?i)" + test, text[a:b]) else closing(text, name, k)
                if end:
                    regions.append((a, b, end[0], end[1]))
        at = 0
        for a, b, inner, end in sorted(regions):
            if a >= at:  # one within another of its kind is no candidate
                found.append(text[b:inner])
                at = end
    visible = [len(" ".join(re.sub("<[^>]*>", " ", x).split())) for x in found]
    return (found[visible.index(max(visible))], total, True) if found else (text, total, False)


def plain(text):
    for pattern, put in (
        (r"(?is)<a\b[^>]*>(.{0,2000}?)</a\s*>", r" \1 "), (r"(?i)<h1\b[^>]*>", "\n\n# "), (r"(?i)<h2\b[^>]*>", "\n\n## "), (r"(?i)<h[3-6]\b[^>]*>", "\n\n### "),
        (r"(?i)</(h[1-6]|p|div|section|article|main|blockquote|table|tr|ul|ol|dl|pre|figure)\s*>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<t[dh]\b[^>]*>", " | "), ("<[^>]*>", " "),
    ):
        text = re.sub(pattern, put, text)
    return entities.unescape(text.replace("&nbsp;", " "))


def clean(text):
    out, seen, dropped, deduped = [], set(), 0, 0
    for raw in re.sub("\r\n?", "\n", text).split("\n"):
        line = re.sub("[ \t ]+", " ", raw).strip()
        short = len(line) < 12 and not re.search(web.SENTENCE_END, line) and not re.match(r"[#\-|]", line)
        key = re.sub(r"^#+\s*", "", line).lower()
        if line and (re.match(web.BOILERPLATE_LINE, line) or short):
            dropped += 1
        elif len(key) >= 6 and key in seen:
            deduped += 1
        else:
            seen.add(key)
            out.append(line)
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip(), dropped, deduped, sum(map(bool, out))


def test_page_content(spark, pages):
    rows = {r["page_id"]: (r["content"], r["regions"], r["main_region"]) for r in catalog.QUERIES["page_content"](spark, FOLDER).collect()}
    assert rows == {p["page_id"]: content(p["html"]) for p in pages}


def test_page_pipeline(spark, pages):
    rows = {r["page_id"]: r for r in catalog.QUERIES["page_pipeline"](spark, FOLDER).collect()}
    assert len(rows) == len(pages)
    for p in pages:
        r, (inner, regions, main) = rows[p["page_id"]], content(p["html"])
        text, dropped, deduped, paragraphs = clean(plain(inner))
        assert (r["text"], r["dropped"], r["deduped"], r["paragraphs"], r["regions"], r["main_region"]) == (text, dropped, deduped, paragraphs, regions, main)
        assert r["removed_ratio"] == pytest.approx(max(0, 1 - len(text) / len(p["html"])), abs=6e-5) and (r["input_chars"], r["output_chars"]) == (len(p["html"]), len(text))


def test_page_modes(spark, pages):
    df = spark.createDataFrame([(1, "<p>One line that is long enough</p><p>One line that is long enough</p>x", None), (2, "", "given text that is long enough\nx\ngiven text that is long enough"), (3, None, None)], "id int, html string, body string")
    run = lambda **raw: {r["id"]: r for r in web.page_pipeline(df, "id", "html", web.clean_options(raw), "body").collect()}
    article, plain_, off, loose = run(), run(mode="plain"), run(mode="off"), run(mode="plain", dropBoilerplate=False, dedupeLines=False, keepTitle=False)
    assert [article[k]["text"] for k in (1, 2, 3)] == ["One line that is long enough", "given text that is long enough", ""] == [plain_[k]["text"] for k in (1, 2, 3)]
    assert (plain_[1]["dropped"], plain_[1]["deduped"], plain_[1]["removed_ratio"] > 0.5) == (1, 1, True)
    assert off[2]["text"].count("given") == 2 and off[2]["removed_ratio"] == 0 and loose[2]["text"] == off[2]["text"]
    assert web.clean_options({"minLineChars": 1e9, "mode": "odd"}) == web.CleanOptions(min_chars=80) and web.clean_options(None) == web.CleanOptions()


def test_search_chunks(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = catalog.QUERIES["search_chunks"](spark, FOLDER).collect()
    by_doc = {d: sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["n"]) for d in texts}
    for d, text in texts.items():
        found, at = by_doc[d], 0
        assert [r["n"] for r in found] == list(range(1, len(found) + 1))
        for r in found:
            assert text[r["start"]:r["end"]] == r["text"] == r["text"].strip() and len(r["text"]) <= 2 * chunker.TARGET and r["outline"] == ""
            assert not text[at:r["start"]].strip()  # nothing but white space between chunks
            at = r["end"]
        assert not text[at:].strip()
        paragraphs = [len(p) for p in re.split(r"\n[^\S\n]*\n", text) if p.strip()]
        if all(n <= chunker.TARGET for n in paragraphs):
            packs, held = 0, chunker.TARGET + 1  # paragraphs go into the open chunk while they fit
            for n in paragraphs:
                if held and held + n > chunker.TARGET:
                    packs, held = packs + 1, 0
                held += n
            assert abs(len(found) - packs) <= max(1, packs // 8), d


def test_findings_parse(spark, pages):
    def cleaned(x):
        for pattern in (r"\[[^\]]*\]\(https?://[^)\s]+\)", r"\(\s*https?://[^)\s]+\s*\)", r"(?<![(\w])https?://[^\s)>\]]+"):
            x = re.sub(pattern, " ", x)
        return " ".join(re.sub(r"[\s,，;；:：、-]+$", "", re.sub(r"\s*[（(]\s*[)）]\s*$", "", x)).split())

    expected = {}
    for p in pages:
        said = " ".join(entities.unescape(re.sub("<[^>]*>", " ", p["html"])).split())
        for more in (f"{said} {p['url']}", f"{said} (https://www.other.org/x)"):
            claim = cleaned(more)
            if claim:
                found = {re.sub("[.,;:!?、，。；：！？]+$", "", u) for u in re.findall(r"""https?://[^\s)\]}>，。；、"'）】]+""", more)}
                at = expected.setdefault((p["page_id"], claim[:160]), (claim, set()))
                at[1].update(found)
    rows = catalog.QUERIES["findings_parse"](spark, FOLDER).collect()
    assert {(r["page_id"], r["claim"][:160]): (r["claim"], set(r["urls"].split())) for r in rows} == expected
    assert {r["channel"] for r in rows} == {findings.CHANNELS[-1][1]}


def test_every_operator_name_is_plain():
    """Names of queries are what SQL and file names can hold."""
    assert all(set(n) <= set(string.ascii_lowercase + string.digits + "_") for n in catalog.QUERIES)
