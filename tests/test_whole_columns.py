"""Base queries without SQL work on whole columns."""

import re

from gristmill import catalog

SPACE = "[\t\n\x0b\f\r  ]"
TEXTS = ["  " + "- " * 90 + "the title/of: it\n" + "word " * 30 + "end", "\n" * 150 + "a&b_c 100% {x} ~ ^ \\ " * 9 + "end", "short", "", None]


def folder(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    html = "<p>" + "some claim of a page </p><p>" * 20 + "see https://late.example.org/y at the end</p>"
    spark.createDataFrame([(1, "https://www.first.org/a", html), (2, "https://www.first.org/b", "<p>brief</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def slug(text):
    out = re.sub(f"{SPACE}+", "-", re.sub(r'[\\/:*?"<>|\x00-\x1f]', "-", re.sub(f"^{SPACE}+|{SPACE}+$", "", text)))
    return out.strip("-")[:80]


def latex(text):
    out = re.sub(r"([&%$#_{}])", r"\\\1", text.replace("\\", "\\textbackslash{}"))
    return out.replace("~", "\\textasciitilde{}").replace("^", "\\textasciicircum{}")


def test_slug_of_whole_texts(spark, tmp_path):
    rows = catalog.QUERIES["fn_slug_excerpt"](spark, folder(spark, tmp_path)).collect()
    assert {r["doc_id"]: r["slug"] for r in rows} == {k: None if t is None else slug(t) for k, t in enumerate(TEXTS)}


def test_latex_of_whole_texts(spark, tmp_path):
    rows = catalog.QUERIES["layout_text"](spark, folder(spark, tmp_path)).collect()
    assert {r["doc_id"]: r["latex"] for r in rows} == {k: None if t is None else latex(t) for k, t in enumerate(TEXTS)}


def test_whole_pages_are_parsed(spark, tmp_path):
    rows = {r["page_id"]: r for r in catalog.QUERIES["findings_parse"](spark, folder(spark, tmp_path)).collect()}
    assert rows[1]["claim"] == "some claim of a page " * 20 + "see at the end"
    assert set(rows[1]["urls"].split()) == {"https://late.example.org/y", "https://www.first.org/a", "https://www.other.org/x"}
    assert rows[2]["claim"] == "brief" and len(rows) == 2
