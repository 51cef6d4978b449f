"""Operators on literal rows, where the driver's tables have no such case."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import values as v
from gristmill.operators import chunker, findings, graph, media, recall, search, store, tabular, web
from gristmill.sources import packages, stores

NOW = dt.datetime(2024, 1, 20, 12)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tokens_in_mixed_script(spark):
    assert one(spark, tx.search_tokens(F.lit("Hello, 数据库 the. x|中 a中文b"))) == (["hello", "数据", "据库", "the.", "x", "中", "a", "中文", "b"],)
    assert one(spark, tx.search_tokens(F.lit("")), tx.search_tokens(F.lit(None).cast("string"))) == ([], [])


def test_similarity(spark):
    tokens = tx.claim_tokens
    assert one(spark, tokens(F.lit("The AI is été 数据库"))) == (["the", "ét", "té", "数据", "据库"],)
    assert one(spark, tx.jaccard(tokens(F.lit("alpha beta")), tokens(F.lit("beta gamma"))))[0] == pytest.approx(1 / 3)
    assert one(spark, tx.jaccard(tokens(F.lit("")), tokens(F.lit("beta")))) == (0.0,)


def test_text_functions(spark):
    assert one(spark, tx.squeeze(F.lit("\u3000a \u00a0b\n")), tx.slug(F.lit(" a/b  c? ")), tx.host(F.lit("HTTPS://WWW.Ex.com:81/x"))) == ("a b", "a-b-c", "ex.com:81")
    assert one(spark, tx.decode_entities(F.lit("&lt;b&gt; &#233;&#x41; &amp;lt;"))) == ("<b> éA &lt;",)
    assert one(spark, tx.urls(F.lit("see https://a.b/c, (http://x.y) https://a.b/c。")))[0] == ["https://a.b/c", "http://x.y"]
    assert one(spark, tx.parse_list(F.lit('["a","b"]')), tx.parse_list(F.lit("a, b,"))) == (["a", "b"], ["a", "b"])
    assert one(spark, tx.string_list(F.array(F.lit(" a"), F.lit("a"), F.lit(""), F.lit("b"))))[0] == ["a", "b"]
    assert one(spark, tx.excerpt(F.lit("# title that is quite long\nA first line of prose here.\nmenu\nAnother line of prose."))) == ("A first line of prose here. Another line of prose.",)


def test_values(spark):
    kinds = [one(spark, v.classify(F.lit(x)))[0] for x in ("1,234.5%", "-1,234.5", "¥ 12", "2024年1月2日", "x", "")]
    assert kinds == ["percent", "number", "currency", "date", "text", "text"]
    assert one(spark, v.to_number(F.lit("12.5%")), v.to_number(F.lit("$1,200")), v.to_number(F.lit("12abc")), v.to_number(F.lit("x"))) == (0.125, 1200.0, 12.0, None)
    assert one(spark, v.parse_date(F.lit("2024-13-32 1:2:3")))[0] == dt.datetime(2025, 2, 1, 1, 2, 3)
    assert one(spark, v.date_serial(F.lit("2024-01-01 12:00:00").cast("timestamp")))[0] == 45292.5
    assert one(spark, v.reference(F.lit("$AB$12")))[0].asDict() == {"col": 28, "row": 12}
    assert one(spark, v.is_date_format(F.lit("yyyy-mm-dd")), v.is_date_format(F.lit('0.00"dm"'))) == (True, False)


def test_stats_blank_without_numbers(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "k string, x double")
    assert tuple(tabular.column_stats(df, "x", ["count", "counta", "sum"], shown="k").first()) == (None, None, None)
    with pytest.warns(UserWarning):
        assert tabular.stat_names(["mean", "nonsense", "平均值"]) == ["average"]


def test_summary_total_has_blank_keys(spark):
    df = spark.createDataFrame([(" a ", 1.0, 1), ("", 5.0, 2), ("a", 2.0, 3), (None, 7.0, 4)], "k string, x double, r int")
    rows = {r["key"]: (r["n_rows"], r["sum"]) for r in tabular.group_summary(df, "k", "x", order="r").collect()}
    assert rows == {"a": (2, 3.0), "Total": (4, 15.0)}


def test_search_ranks_and_abstains(spark):
    docs = spark.createDataFrame([(1, "数据库 索引 设计", "a"), (2, "green tea water", "b"), (3, "tea house", "c")], "id long, body string, head string")
    terms = search.query_terms(spark, "数据库 tea")
    assert [r["id"] for r in search.top_k(search.two_routes(docs, "id", "body", "head", terms), "id").collect()][0] == 1
    assert search.two_routes(docs, "id", "body", "head", ["absent"]).count() == 0
    with pytest.raises(ValueError):
        search.check_tier("verifed")


def test_time_words():
    assert recall.resolve_window("last week", "last week", NOW) == (dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 14, 23, 59, 59, 999000))
    assert recall.resolve_time("last 1 days", NOW) == dt.datetime(2024, 1, 20)
    assert recall.resolve_time("2024-02-01", NOW, end=True) == dt.datetime(2024, 2, 1, 23, 59, 59, 999000)
    for bad in (("someday", None), ("today", "yesterday")):
        with pytest.raises(ValueError):
            recall.resolve_window(*bad, NOW)


def test_quality_tiers_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.randrange(0, 5)) for g in range(20) for k in range(rng.randrange(0, 60))]
    out = recall.quality_tiers(spark.createDataFrame(rows, "g int, k int, s int"), ["g"], [F.col("k")], "s", 4, 8)
    found = sorted((r["g"], r["k"]) for r in out.collect())
    wanted = []
    for g in range(20):
        kept, quota = [], {"m": 6, "u": 4}
        for _, k, s in [r for r in rows if r[0] == g][:40]:
            if len(kept) == 8:
                break
            tier = "h" if s / 4 >= 0.6 else "m" if s / 4 >= 0.25 else "u"
            if tier == "h" or quota[tier]:
                kept.append((g, k))
                if tier != "h":
                    quota[tier] -= 1
        wanted += kept
    assert found == sorted(wanted)


def test_store(spark):
    blocks = spark.createDataFrame([("m", 1, 150), ("m", 2, 60), ("m", 3, 500), ("m", 4, 10), ("n", 1, 5)], "month string, at int, items int")
    assert sorted((r["month"], r["at"], r["volume"]) for r in store.pack_volumes(blocks, "month", "at", "items").collect()) == [("m", 1, 1), ("m", 2, 2), ("m", 3, 3), ("m", 4, 4), ("n", 1, 1)]
    lines = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([5, 8, 3, 2])], "g int, k int, t string")
    assert [r["shown"] for r in store.greedy_fill(lines, ["g"], "k", "t", 10).orderBy("k").collect()] == [True, False, True, True]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    assert store.fingerprint(a, ["id", "t"]).first() == store.fingerprint(a.orderBy(F.desc("id")), ["id", "t"]).first()


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 4, "b"), (4, 5, "a"), (2, 9, "a"), (9, 10, "a"), (7, 7, "a")], "src long, dst long, kind string")
    live = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 7, 10)], "node long")
    start = spark.createDataFrame([(1,)], "node long")
    rows = {r["node"]: (r["hop"], r["dangling"]) for r in graph.related(edges, start, live).collect()}
    assert rows == {1: (0, False), 2: (1, False), 3: (2, False), 9: (2, True), 4: (3, False)}
    assert {r["node"]: r["total"] for r in graph.neighbour_counts(edges, ["a"]).collect()}[7] == 1


PAGE = """<html lang="en"><head><title>T &amp; x</title><script>var a;</script></head><body><nav><ul><li>Home</li></ul></nav><div class="cookie"><div>inner</div> accept</div>
<article><h1>Head line</h1><p>The first paragraph is a sentence.</p><p>The first paragraph is a sentence.</p><p>We use cookies here</p><section>More prose that is long enough</section></article><footer>f</footer></body></html>"""


def test_page_pipeline(spark):
    row = web.page_pipeline(spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<div class='nav'>never closed and long enough")], "id int, html string"), "id", "html").orderBy("id").collect()
    assert row[0]["text"] == "# Head line\nThe first paragraph is a sentence.\nMore prose that is long enough"
    assert (row[0]["title"], row[0]["lang"], row[0]["deduped"], row[0]["main_region"]) == ("T & x", "en", 1, True)
    assert row[0]["removed_ratio"] > 0.5 and row[3]["text"] == "never closed and long enough"


def test_boilerplate_tag(spark):
    for tag, expected in (('<div class="side-bar x">', True), ("<p id=promo>", True), ('<div class="navigator">', False), ("<div>", False)):
        assert web.boilerplate_tag(tag) is expected
        assert one(spark, web.boilerplate_words(F.lit(tag))) == (expected,)


def test_sentinel(spark):
    check = lambda s, u, t: one(spark, web.sentinel(F.lit(s), F.lit(u), F.lit(t)))[0]
    assert [check(503, "", "x"), check(404, "", ""), check(429, "", ""), check(0, "https://x/unavailable-in-region", "x" * 300), check(200, "", "Verify you are human"), check(200, "", "x"), check(200, "", "x" * 100), check(200, "", "hcaptcha " + "x" * 4000)] == [
        "server_error", "missing", "refused", "region", "challenge", "empty", "short", "ok"
    ]


def test_findings(spark):
    md = "# 百科\n- Water boils at 100 degrees https://a.com/x\n- Water boils at 100 degrees (https://www.b.org/y)\n## other\n- 未经 a claim without source.\ntext\n"
    rows = findings.parse(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md").orderBy("line").collect()
    assert [(r["channel"], r["claim"], r["hosts"]) for r in rows] == [("百科", "Water boils at 100 degrees", ["a.com", "b.org"]), ("other", "未经 a claim without source.", [])]


def test_chunks_are_spans():
    text = "# A\n\npara one\nline two\n\n### C\n" + "\n\n".join("x" * 300 + "." for _ in range(3)) + "\n\n## B\r\n" + "long sentence, " * 60 + "\n"
    out = chunker.chunk(text, 200)
    assert all(text[c["start"]:c["end"]] == c["text"] for c in out) and [c["n"] for c in out] == list(range(1, len(out) + 1))
    assert out[0]["outline"] == "A" and out[1]["outline"] == "A / C" and out[-1]["outline"] == "A / B"
    assert max(len(c["text"]) for c in out) <= 200 and chunker.chunk("") == [] and chunker.chunk(None) == []


def test_media(spark):
    words = one(spark, media.word_times(F.array(*map(F.lit, ["hello", ",", "world"])), F.array(*map(F.lit, [0.5, 0.9, 1.0])), F.lit(2.0), F.lit(10.0)))[0]
    assert [tuple(w) for w in words] == [("hello,", 10.5, 11.0), ("world", 11.0, 12.0)]
    assert one(spark, media.frame_times(F.lit(10.0), count=2), media.frame_times(F.lit(10.0), at=[3, 1, 3])) == ([2.5, 7.5], [1.0, 3.0])
    assert one(spark, media.join_transcript(F.array(*map(F.lit, ["a", "b", "数", "据"])))) == ("a b数据",)


def _xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="AA2" t="b"><v>1</v></c><c r="C2" t="e"><v>#REF!</v></c><c r="D2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_packages(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_xlsx())
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04 not a package")
    cells = packages.read(spark, str(tmp_path), "xlsx")
    assert [r["path"].rpartition("/")[2] for r in cells.filter("error IS NOT NULL").collect()] == ["bad.xlsx"]
    cells = cells.filter("error IS NULL")
    assert sorted((r["row"], r["col"], r["kind"], r["text"], r["num"], r["bool"], r["formula"]) for r in cells.collect()) == [
        (1, 1, "text", "name", None, None, None), (1, 2, "number", None, 2.0, None, "1+1"), (2, 3, "error", "#REF!", None, None, None), (2, 4, "text", "in", None, None, None), (2, 27, "bool", None, None, True, None)
    ]
    info = packages.archive_info(packages.zip_entries(packages.files(spark, str(tmp_path)))).collect()
    assert sorted((r["n_entries"], r["text_entries"]) for r in info) == [(0, 0), (4, 3)]
    assert {(r["path"].rpartition("/")[2], r["error"]) for r in packages.zip_entries(packages.files(spark, str(tmp_path), "a.xlsx", 10)).collect()} == {("a.xlsx", "over 10 bytes")}
    table = packages.sheet_table(cells, 2).orderBy("row").collect()
    assert [(r["row"], r["c1"], r["c2"]) for r in table] == [(1, "name", "2"), (2, None, None)]
    data = {r["entry"]: r["error"] for r in packages.zip_contents(packages.files(spark, str(tmp_path), "a.xlsx"), 60).collect()}
    assert data["xl/sharedStrings.xml"] is None and data["xl/worksheets/sheet1.xml"] == "over 60 bytes"
    assert {r[0] for r in packages.files(spark, str(tmp_path)).select(packages.sniff(F.col("content"))).collect()} == {"zip"}
    with pytest.raises(ValueError):
        packages.read(spark, str(tmp_path), "exe")


def _package(entries) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def test_documents_and_decks(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>said </w:t></w:r><w:r><w:t>so</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    (tmp_path / "d.docx").write_bytes(_package({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'}))
    rows = packages.read(spark, str(tmp_path), "docx")
    assert [(r["n"], r["kind"], r["level"], r["text"]) for r in rows.orderBy("n").collect()] == [(0, "heading", 1, "Top"), (1, "paragraph", None, "said so"), (2, "table", None, "a | b")]
    assert tuple(packages.document_stats(rows).select("headings", "paragraphs", "tables", "chars").first()) == (1, 1, 1, 15)
    shape = lambda t: f'<s xmlns:a="a"><a:sp><a:t>{t}</a:t></a:sp></s>'
    rels = '<Relationships><Relationship Target="../notesSlides/notesSlide1.xml"/><Relationship Target="../media/image1.png"/></Relationships>'
    (tmp_path / "s.pptx").write_bytes(_package({"ppt/slides/slide2.xml": shape("two"), "ppt/slides/slide1.xml": shape("one"), "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/notesSlide1.xml": shape("note")}))
    assert [tuple(r)[1:6] for r in packages.read(spark, str(tmp_path), "pptx").orderBy("slide").collect()] == [(1, 1, "one", "note", ["ppt/media/image1.png"]), (2, 1, "two", "", [])]


def test_tex_projects(spark, tmp_path):
    (tmp_path / "ch").mkdir()
    (tmp_path / "main.tex").write_text("\\documentclass{book}\n\\chapter{One} % \\chapter{no}\n\\input{ch/two}\n\\include{none}\n\\input{main}")
    (tmp_path / "ch" / "two.tex").write_text("\\section{S}\n\\cite{a, b}\\citep[p.~3]{a}\n\\begin{align}x\\end{align}\n\\input{three.tex}")
    (tmp_path / "ch" / "three.tex").write_text("\\section*{T}\\begin{figure}\\end{figure}")
    row = packages.tex_texts(packages.files(spark, f"{tmp_path}/*.tex").unionByName(packages.files(spark, f"{tmp_path}/ch/*.tex"))).collect()
    assert [(r["n_files"], r["missing"], r["chapters"], r["sections"], r["figures"], r["equations"], r["citations"], r["citation_keys"]) for r in row] == [(3, ["none.tex"], 1, 2, 1, 1, 3, 2)]


def test_windows_images_and_pdf(spark, tmp_path):
    import gzip
    import struct

    import zstandard

    (tmp_path / "a.gz").write_bytes(gzip.compress("数据 text".encode()))
    (tmp_path / "b.zst").write_bytes(zstandard.ZstdCompressor().compress(b"0123456789"))
    (tmp_path / "c.gz").write_bytes(b"\x1f\x8bbroken")
    rows = {r["path"].rpartition("/")[2]: (r["text"], r["next_offset"], r["error"] is None) for r in packages.text_windows(packages.files(spark, str(tmp_path)), 1, 4).collect()}
    assert rows == {"a.gz": ("据 te", 5, True), "b.zst": ("1234", 5, True), "c.gz": (None, None, False)}
    images = tmp_path / "images"
    images.mkdir()
    (images / "p").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20))
    (images / "j").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, 7, 9))
    (images / "w").write_bytes(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (4).to_bytes(3, "little") + (5).to_bytes(3, "little"))
    (images / "n").write_bytes(b"none")
    facts = {r["path"].rpartition("/")[2]: (r["mime"], r["width"], r["height"]) for r in packages.image_facts(packages.files(spark, str(images))).collect()}
    assert facts == {"p": ("image/png", 30, 20), "j": ("image/jpeg", 9, 7), "w": ("image/webp", 5, 6), "n": (None, None, None)}
    (tmp_path / "x.pdf").write_bytes(b"%PDF /Type /Page /Type /Pages /Type /Font /Subtype /Image")
    assert tuple(packages.read(spark, str(tmp_path), "pdf").select("pages", "fonts", "images", "encrypted").first()) == (1, 1, 1, False)


def test_archive_items(spark):
    digests = spark.createDataFrame([("2024-01", 1, [("b1", "t", "full", ["i1", "i2"]), ("b2", "t", "old", [])])], "month string, volume int, blocks array<struct<id:string,at:string,reason:string,items:array<string>>>")
    assert sorted((r["block_id"], r["item"] or "") for r in stores.archive_items(digests).collect()) == [("b1", "i1"), ("b1", "i2"), ("b2", "")]


def test_stores(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"1","purpose":"x"}\nnot json\n{"id":"2"}\n')
    assert stores.json_lines(spark, str(tmp_path / "l.jsonl"), stores.LEDGER).count() == 2
    assert stores.json_lines(spark, str(tmp_path / "none.jsonl"), stores.LEDGER).count() == 0
    (tmp_path / "s.json").write_text('{"version":1,"entries":[{"id":"1","content":"c","importance":"odd"},{"id":"2","content":" "}]}')
    assert [(r["id"], r["importance"]) for r in stores.hot_entries(spark, str(tmp_path / "s.json")).collect()] == [("1", "normal")]
    df = spark.createDataFrame([(1, '{"organic":[{"link":"u","title":"t"},{"link":"u","title":"later"},{"title":"none"}]}')], "k int, p string")
    assert [(r["url"], r["title"]) for r in stores.provider_sources(df, "k", "p", "serper").collect()] == [("u", "t")]


def test_ledger_stream(spark, tmp_path):
    from gristmill.streaming import ledger

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(f'{{"id":"{k}","at":"2024-01-0{k + 1}T00:00:00Z"}}\n' for k in range(5)))
    stream = spark.readStream.schema("id string, at timestamp").json(str(tmp_path / "in"))
    for _ in range(2):
        ledger.append_ledger(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert {r["id"] for r in ledger.retained(spark, str(tmp_path / "out"), [], "at", 2).collect()} == {"3", "4"}


def test_entries(spark):
    entries = spark.createDataFrame([("a", "first words", "low"), ("b", "other words", "low")], "id string, content string, importance string")
    assert {r["id"]: r["content"] for r in store.replace_entry(entries, {"content": "new"}, old="first").collect()} == {"a": "new", "b": "other words"}
    for wanted, old in (("", "words"), ("", "absent"), ("c", ""), ("", "")):
        with pytest.raises(ValueError):
            store.the_one(entries, wanted, old)
    with pytest.raises(ValueError):
        store.add_entry(entries, {"id": "c", "content": "x" * 11}, 10)


def test_long_chain_of_claims(spark):
    pairs = spark.createDataFrame([(k, k + 1, 1.0) for k in range(200)], "a long, b long, similarity double")
    rows = findings.clusters(spark.range(202), "id", pairs).collect()
    assert {r["id"]: r["cluster"] for r in rows} == {k: 0 if k < 201 else 201 for k in range(202)}


def test_knowledge_base_folder(spark, tmp_path):
    import hashlib
    import json

    from gristmill.operators import kb

    digest = lambda t: hashlib.sha1(f"\0{t}".encode()).hexdigest()[:12]
    (tmp_path / "chunks" / "h1").mkdir(parents=True)
    (tmp_path / "manifest.jsonl").write_text(json.dumps({"id": "kb:1", "path": "a.md", "hash": "h1", "chunks": 3, "tier": "VERIFIED", "at": "2024-01-02T03"}) + "\nnot json\n" + json.dumps({"id": "", "hash": "x"}) + "\n")
    for n, text, mark in ((1, "tea and water", None), (2, "changed", "bad")):
        (tmp_path / "chunks" / "h1" / f"{n}.json").write_text(json.dumps({"id": f"kb:h1:{n}", "n": n, "text": text, "outline": "top", "hash": mark or digest(text)}))
    manifest, chunks = kb.load(spark, str(tmp_path))
    assert [(r["chunks"], r["found"], r["missing"]) for r in kb.missing(manifest, chunks).collect()] == [(3, 1, 2)]
    hits, summary = kb.find(manifest, chunks, "water", tier="verified")
    assert [(r["chunk_id"], r["header"], r["preview"]) for r in hits.collect()] == [("kb:h1:1", "top · 来源 a.md · 2024-01-02", "tea and water")]
    assert summary.first()["reason"] == "hits" and kb.find(manifest, chunks, "water", tier="user")[1].first()["reason"] == "filter-empty"
    with pytest.raises(ValueError):
        kb.find(manifest, chunks, "water", tier="verifed")


def test_sqlite_rows_and_actions(spark, tmp_path):
    import json
    import sqlite3

    from gristmill import actions

    con = sqlite3.connect(tmp_path / "m.db")
    con.executescript("CREATE TABLE insights(id TEXT, content TEXT); INSERT INTO insights VALUES ('1', 'tea'), ('2', NULL);")
    con.commit()
    con.close()
    rows = actions.act("migrate", packages.files(spark, str(tmp_path)), ["insights", "edges"]).collect()
    assert sorted((r["table"], json.loads(r["row"])["id"] if r["row"] else "", r["error"] is None) for r in rows) == [("edges", "", False), ("insights", "1", True), ("insights", "2", True)]
    with pytest.raises(ValueError):
        actions.act("none")


def test_wrapping_against_a_loop(spark):
    import re

    from gristmill.functions import layout

    def em(text):
        wide, narrow = set("mwMW@%"), set("iljI.,;:!'|`[](){} ")
        return sum(1.0 if re.match(layout.FULL, c) else 1.1 if c == "\t" else 0.28 if c in narrow else 0.9 if c in wide else 0.66 if c.isascii() and c.isupper() else 0.56 if c.isascii() and c.isdigit() else 0 if c == "\n" else 0.54 for c in text)

    def wrap(text, limit):
        out = []
        for raw in text.split("\n"):
            line, width = "", 0.0
            for token in re.findall(r"[A-Za-z0-9@%._#+\-/]+|\s+|[^\s]", raw):
                if width + em(token) * 11 > limit and line.strip():
                    out.append(line.rstrip())
                    line = token.lstrip()
                    width = em(line) * 11
                else:
                    line, width = line + token, width + em(token) * 11
            out.append(line.rstrip())
        return out

    rng = random.Random(2)
    texts = ["", "a", "  lead", "one\n\ntwo "] + ["".join(rng.choice(["word", " ", "  ", "数", "mw@", "\n", ",", "I.", "\t", "x9"]) for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", layout.wrapped(F.col("t"), 60.0).alias("lines"))
    assert {r["k"]: r["lines"] for r in df.collect()} == {k: wrap(t, 60.0) for k, t in enumerate(texts)}
