"""Queries agree with their SQL where white space, entities and lengths are unusual."""

import duckdb
import oracle

from gristmill import catalog


def differences(spark, tmp_path, query, table, columns, rows):
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path / table}.parquet/*.parquet')")
    return oracle.differences(catalog.QUERIES[query](spark, str(tmp_path)), con, catalog.ORACLE[query])


def test_page_meta(spark, tmp_path):
    heads = [
        "<title>token = &quot;5aa25d&quot; &lt;b&gt; &#39;c&#39; &AMP; d&nbsp;</title>", "<title>\x0b a \x0b\t b c  </title>", f"<title>{'long ' * 100}</title>", "<title>a</title\x0b>", "<title> </title>", "<title>\u3000 a\u3000b \u00a0</title>", "<title>a \x85</title>",
        f'<meta property="og:title" content="{"t " * 300}"><meta property="og:site_name" content="{"s" * 300}">', f'<meta\x0bname="author" content="{"b" * 250}"><html lang="{"x" * 30}">', '<meta name\x0b="author" content="c">',
        f'<meta property="article:published_time" content=""><time datetime="{"9" * 90}">', "<title>&amp;amp; &amp;lt;</title><html lang = \"de\n \">", "", None,
    ]
    assert differences(spark, tmp_path, "page_meta", "pages", "page_id long, html string", list(enumerate(heads))) == ""


def test_document_lines_clean(spark, tmp_path):
    texts = [
        None, "", "   ", "Cookie policy\nSubscribe now", "Cookie policy\n", "abc", "\n\n\n", "First line is here.\r\nsecond line is here.\rthird line is here.\n", "\tA line with tabs\t\there\t", "\x0cA line that begins so.\nA line that ends so.\x0c",
        "\x0bA line of its own.\x0b", "　A line that ends so.　", "A line that ends so. ", "A line.\x85", "short. \nabc", "﻿A line that begins so.", "#　A heading line\nA heading line", "#\x0bA heading line\n#\tA heading line\nA heading line",
        "ΟΔΟΣ ΟΔΟΣ\nοδοσ οδοσ\nοδος οδος", "İstanbul is a city\ni̇stanbul is a city\nistanbul is a city", "COOKIE is here long enough to stay.", "ſubscribe to this letter today.", "sıgn in to this letter today.", "ab.\nab.\nabcdef.\nABCDEF.\n\n\n\n\nabcdef.",
    ]
    assert differences(spark, tmp_path, "document_lines_clean", "documents", "doc_id long, text string", list(enumerate(texts))) == ""
