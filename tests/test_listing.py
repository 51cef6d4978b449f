import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import layout
from gristmill.operators import listing, packs


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_layout(spark):
    assert [round(x, 2) for x in one(spark, layout.estimate_em(F.lit("数 iM A1a\n")), layout.estimate_em(F.lit("")))] == [1 + 0.28 * 3 + 0.9 + 0.66 + 0.56 + 0.54, 0]
    assert one(spark, layout.visual_width(F.lit("a数\t")), layout.escape_latex(F.lit("5% a_b~")))[1] == "5\\% a\\_b\\textasciitilde{}"
    show = lambda x, f: one(spark, layout.display_number(F.lit(x), F.lit(f)))[0]
    assert [show(1234.5, "#,##0.00"), show(1234.5, "0.00"), show(0.125, "0%"), show(1234.0, "#,##0"), show(12.0, ""), show(1.234, ""), show(45000.0, "yyyy-mm-dd")] == ["1,234.50", "1234.50", "12.5%", "1,234", "12", "1.23", "2000-00-00"]
    schema = layout.schema_of(["a", {"key": "p", "type": "percent"}, {"title": "t", "type": "odd"}])
    assert [(f.name, f.dataType, f.metadata["title"], f.metadata["type"]) for f in schema] == [("c0", T.StringType(), "a", "auto"), ("p", T.DoubleType(), "p", "percent"), ("c2", T.StringType(), "t", "auto")]


def test_sites(spark):
    sites = spark.createDataFrame([("a.org", 1, "x", True), ("b.org", 2, "y", False), ("c.org", 3, "x", True)], "domain string, ordinal int, type string, enabled boolean")
    names = lambda *a: [r["domain"] for r in listing.select_sites(sites, *a).collect()]
    assert (names(False), names(), names("x", 1), names(["https://www.b.org/x", "a.org", "none.org"])) == ([], ["a.org", "c.org"], ["a.org"], ["b.org", "a.org"])
    assert listing.missing_sites(sites, ["a.org", "none.org"]) == ["none.org"]


def test_signals_and_roots(spark):
    terms = {"ppt": ["slide", "deck"], "pdf": ["pdf", "deck"]}
    row = one(spark, listing.signal_terms(F.lit("ppt"), F.lit("office.pdf.text()"), terms), listing.signal_terms(F.lit("run"), F.lit(None).cast("string"), terms))
    assert (row[0]["key"], row[0]["terms"], row[1]) == ("pdf+ppt", ["pdf", "deck", "slide"], None)
    df = spark.createDataFrame([("a", 1, None, True, 5, 1), ("b", 2, None, True, 9, 0), ("c", 3, None, False, 99, 9)], "root string, ord int, recent boolean, has_memory boolean, at int, mtime int")
    assert listing.best_root(df).first()["root"] == "b"


def test_documents_share_chunks(spark):
    manifest = spark.createDataFrame([("d1", "h1", 2, "user"), ("d2", "h1", 2, "user"), ("d3", "h3", 1, "user")], "id string, hash string, chunks int, tier string")
    edges = spark.createDataFrame([("kb:h3:1", "d1", "k"), ("d1", "kb:h1:1", "k")], "src string, dst string, kind string")
    out = packs.drop_documents(manifest, spark.createDataFrame([("d1",), ("d3",)], "id string"), edges)
    assert {r["id"] for r in out["dead"].collect()} == {"d1", "d3", "kb:h3:1"} and out["edges"].count() == 0


def test_links_and_tiers(spark):
    edges = spark.createDataFrame([("a", "b", "k", "c1", "open")], "src string, dst string, kind string, conflict_class string, conflict_state string")
    more = spark.createDataFrame([("a", "b", "k", "c2", "closed"), ("a", "a", "k", "c", "s"), ("b", "c", "k", "c", "s")], edges.schema)
    assert sorted(tuple(r) for r in packs.upsert_links(edges, more).collect()) == [("a", "b", "k", "c2", "closed"), ("b", "c", "k", "c", "s")]
    t = lambda rows: spark.createDataFrame(rows, "id string, tier string")
    assert {r["id"]: r["tier"] for r in packs.import_tiers(t([("1", "verified"), ("2", "user")]), t([("1", "user"), ("2", "unverified")])).collect()} == {"1": "user", "2": "unverified"}
    assert listing.status({"x": edges}, "src").first()["bytes"] == 1 and dt
