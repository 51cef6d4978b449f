"""Files as tables: packages, workbooks, documents, decks, TeX projects, PDF facts, archives, images.

Every reader takes rows (path, content, error) of ``files`` and parses one file at a time
on the executors.  A file that is too large or can't be parsed gives one row with its path
and the error, so nothing vanishes unseen; ``error`` is null everywhere else.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import json
import posixpath
import re
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 256 << 20


def files(spark: SparkSession, path: str, pattern: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """(path, length, content, error) of files; those beyond a size come without content, which is not read."""
    every = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    small = every.filter(F.col("length") <= most).select("path", "length", "content", F.lit(None).cast("string").alias("error"))
    large = every.filter(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(f"over {most} bytes").alias("error"))
    return small.unionByName(large)


def _each(df: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, columns of ``schema``, error) of every file; ``parse`` may give its rows an error as one more value."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, error in zip(batch["path"], batch["content"], batch["error"], strict=True):
                rows = []
                if error is None:
                    try:
                        rows = [(path, *r, *[None] * (len(names) + 1 - len(r))) for r in parse(bytes(content))]
                    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError, zlib.error, OSError, EOFError, struct.error, StopIteration) as found:
                        error = f"{type(found).__name__}: {found}"
                if error is not None:
                    rows = [(path, *[None] * len(names), error)]
                yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    return df.select("path", "content", "error").mapInPandas(run, f"path string, {schema}, error string")


def _zip(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def zip_entries(df: DataFrame) -> DataFrame:
    """(path, entry, bytes, packed, method, crc, error): the central directory of each package."""
    return _each(df, lambda c: ((i.filename, i.file_size, i.compress_size, i.compress_type, i.CRC) for i in _zip(c).infolist()), "entry string, bytes long, packed long, method int, crc long")


def zip_contents(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, entry, data, error) of each entry; those beyond a size come without data."""

    def parse(content: bytes) -> Iterator[tuple]:
        with _zip(content) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield (i.filename, z.read(i)) if i.file_size <= most else (i.filename, None, f"over {most} bytes")

    return _each(df, parse, "entry string, data binary")


#: Entries that count as text.  (Fixed value.)
TEXT_ENTRY = r"(?i)\.(jsonl?|txt|md|log|csv|tsv|xml|yaml|yml)$"


def archive_info(entries: DataFrame) -> DataFrame:
    """(path, n_entries, text_entries, bytes, packed, ratio)."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return entries.groupBy("path").agg(F.count("entry").alias("n_entries"), F.count_if(F.col("entry").rlike(TEXT_ENTRY)).alias("text_entries"), n("bytes"), n("packed"), F.round(F.sum("bytes") / F.greatest(F.sum("packed"), F.lit(1)), 2).alias("ratio"))


def sniff(content: Column) -> Column:
    """zip, gzip, zstd, plain or null by the first bytes; a NUL or more than one control byte in 20 of the first 4,096 means binary."""
    head = F.hex(F.substring(content, 1, 4))
    start = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    control = F.regexp_count(start, F.lit(r"[\x00-\x08\x0e-\x1f]"))
    plain = (F.length(start) > 0) & ~start.rlike(r"\x00") & (control * 20 <= F.length(start))
    return F.when(head.startswith("504B0304") | head.startswith("504B0506"), "zip").when(head.startswith("1F8B"), "gzip").when(head == "28B52FFD", "zstd").when(plain, "plain")


def _jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2:at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5:at + 9])
            return width, height
        at += 2 + size
    raise ValueError("no frame in the image")


def _webp_size(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    width, height = struct.unpack("<HH", data[26:30])
    return width & 0x3FFF, height & 0x3FFF


def image_facts(df: DataFrame) -> DataFrame:
    """(path, mime, width, height, error) of PNG, GIF, BMP, JPEG and WebP images; other files have an error."""

    def parse(data: bytes) -> Iterator[tuple]:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            yield "image/png", *struct.unpack(">II", data[16:24])
        elif data[:4] == b"GIF8":
            yield "image/gif", *struct.unpack("<HH", data[6:10])
        elif data[:2] == b"BM":
            yield "image/bmp", *struct.unpack("<ii", data[18:26])
        elif data[:3] == b"\xff\xd8\xff":
            yield "image/jpeg", *_jpeg_size(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            yield "image/webp", *_webp_size(data)
        else:
            raise ValueError("no known image")

    return _each(df, parse, "mime string, width int, height int")


def unpacked(content: bytes, entry: str | None = None) -> bytes:
    """The bytes inside a gzip or zstd stream, or of an entry of a package; others as they are."""
    if content[:2] == b"\x1f\x8b":
        return gzip.decompress(content)
    if content[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(content)
        except zstandard.ZstdError as found:
            raise ValueError(str(found)) from None
    if entry is not None:
        with _zip(content) as z:
            return z.read(entry)
    return content


def text_windows(df: DataFrame, offset: int = 0, most: int = 20_000, entry: str | None = None) -> DataFrame:
    """(path, text, next_offset, error): a slice of each file's text, in characters, and where the next begins, null at the end."""

    def parse(content: bytes) -> Iterator[tuple]:
        text = unpacked(content, entry).decode("utf-8", "replace")
        end = offset + most
        yield text[offset:end], end if end < len(text) else None

    return _each(df, parse, "text string, next_offset long")


# --- workbooks ----------------------------------------------------------------

def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def _place(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(ref[len(letters):]), col


def _cell(node: ElementTree.Element, shared: list[str]) -> tuple:
    """(kind, text, number, truth, formula) by the cell's type."""
    parts = {_local(x.tag): x for x in node}
    raw = parts["v"].text if "v" in parts else None
    formula = parts["f"].text if "f" in parts else None
    kind = node.get("t", "n")
    if kind == "s" and raw is not None:
        return "text", shared[int(raw)], None, None, formula
    if kind == "inlineStr":
        return "text", _texts(node), None, None, formula
    if kind == "b":
        return "bool", None, None, raw == "1", formula
    if kind == "e":
        return "error", raw, None, None, formula
    if kind == "str":
        return "text", raw or "", None, None, formula
    return ("empty", None, None, None, formula) if raw is None else ("number", None, float(raw), None, formula)


def _sheets(content: bytes) -> Iterator[tuple]:
    with _zip(content) as z:
        names = set(z.namelist())
        shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            target = next(links[v] for k, v in sheet.attrib.items() if _local(k) == "id")
            for c in ElementTree.fromstring(z.read("xl/" + target.removeprefix("/xl/"))).iter():
                if _local(c.tag) == "c":
                    yield sheet.get("name"), *_place(c.get("r")), *_cell(c, shared)


def workbook_cells(df: DataFrame) -> DataFrame:
    """(path, sheet, row, col, kind, text, num, bool, formula, error): every cell of every sheet."""
    return _each(df, _sheets, "sheet string, row int, col int, kind string, text string, num double, bool boolean, formula string")


def sheet_table(cells: DataFrame, columns: int) -> DataFrame:
    """(path, sheet, row, c1..cn): displayed text of the first columns of each row."""
    shown = F.coalesce("text", F.regexp_replace(F.col("num").cast("string"), r"\.0$", ""), F.upper(F.col("bool").cast("string")))
    return cells.filter("row IS NOT NULL").withColumn("shown", shown).groupBy("path", "sheet", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("shown"))).alias(f"c{k}") for k in range(1, columns + 1)))


# --- documents, decks, TeX, PDF --------------------------------------------------

def _blocks(content: bytes) -> Iterator[tuple]:
    with _zip(content) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next((x for x in root.iter() if _local(x.tag) == "body"), root)
    for n, x in enumerate(x for x in body if _local(x.tag) in ("p", "tbl")):
        if _local(x.tag) == "tbl":
            rows = [[_texts(c) for c in r if _local(c.tag) == "tc"] for r in x if _local(r.tag) == "tr"]
            yield n, "table", None, "\n".join(" | ".join(r) for r in rows)
            continue
        style = next((v for y in x.iter() if _local(y.tag) == "pStyle" for k, v in y.attrib.items() if _local(k) == "val"), "")
        level = re.fullmatch(r"[Hh]eading\s?(\d)", style)
        yield n, "heading" if level else "paragraph", int(level[1]) if level else None, _texts(x)


def document_outline(df: DataFrame) -> DataFrame:
    """(path, n, kind, level, text, error): headings, paragraphs and tables of each document, a table's cells parted by | and its rows by line feeds."""
    return _each(df, _blocks, "n int, kind string, level int, text string")


def document_stats(outline: DataFrame) -> DataFrame:
    """(path, headings, paragraphs, tables, chars)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return outline.groupBy("path").agg(n("heading").alias("headings"), n("paragraph").alias("paragraphs"), n("table").alias("tables"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def _slides(content: bytes) -> Iterator[tuple]:
    with _zip(content) as z:
        names = set(z.namelist())
        found = sorted((int(m[1]), name) for name in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name)))
        for n, name in found:
            root = ElementTree.fromstring(z.read(name))
            shapes = [_texts(s) for s in root.iter() if _local(s.tag) == "sp"]
            links = f"ppt/slides/_rels/slide{n}.xml.rels"
            targets = [posixpath.normpath(posixpath.join("ppt/slides", r.get("Target", ""))) for r in ElementTree.fromstring(z.read(links))] if links in names else []
            notes = ["".join(_texts(s) for s in ElementTree.fromstring(z.read(t)).iter() if _local(s.tag) == "sp") for t in targets if t.startswith("ppt/notesSlides/") and t in names]
            yield n, len(shapes), "\n".join(s for s in shapes if s), "\n".join(notes), [t for t in targets if t.startswith("ppt/media/")]


def deck_slides(df: DataFrame) -> DataFrame:
    """(path, slide, shapes, text, notes, media, error)."""
    return _each(df, _slides, "slide int, shapes int, text string, notes string, media array<string>")


#: Counts of a TeX project by pattern, comments left out.  (Fixed values.)
TEX_COUNTS = {
    "chapters": r"\\chapter\*?\s*\{[^}]*\}", "sections": r"\\section\*?\s*\{[^}]*\}", "subsections": r"\\subsection\*?\s*\{", "figures": r"\\begin\{figure\*?\}", "tables": r"\\begin\{(?:table|longtable)\*?\}",
    "equations": r"\\begin\{(?:equation|align|gather|multline|eqnarray)\*?\}|\\\[",
}
TEX_CITE = r"\\(?:cite|citep|citet|upcite|parencite|textcite)\s*(?:\[[^\]]*\])*\s*\{([^}]*)\}"
TEX_INPUT = r"\\(?:input|include)\s*\{([^}]*)\}"
TEX_MAIN = r"\\documentclass"


def tex_projects(df: DataFrame) -> DataFrame:
    """(main, n_files, missing, text): every file with a document class, the files that it includes put in their place.

    Files are grouped by the folder of the main file, which includes name theirs against;
    a file that includes itself, directly or not, is put in once.  A project is one task's
    work: its files are read together.
    """
    texts = df.filter("content IS NOT NULL").select("path", F.decode("content", "UTF-8").alias("text"))
    mains = texts.filter(F.col("text").rlike(TEX_MAIN)).select(F.col("path").alias("main"), F.regexp_extract("path", r"^(.*/)[^/]*$", 1).alias("folder"))
    # A file meets the mains of all folders above it, by equality.
    depth = F.size(F.split("path", "/"))
    above = texts.select("path", "text", F.explode(F.transform(F.sequence(F.lit(1), depth - 1), lambda k: F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"), F.lit("/")))).alias("folder"))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        main, folder = rows["main"].iloc[0], rows["folder"].iloc[0]
        known, used, missing = dict(zip(rows["path"], rows["text"], strict=True)), [], []

        def put(path: str) -> str:
            used.append(path)
            return re.sub(TEX_INPUT, lambda m: inner(path, m[1].strip()), known[path])

        def inner(path: str, name: str) -> str:
            name = name if name.endswith(".tex") else name + ".tex"
            for base in (posixpath.dirname(path) + "/", folder):
                at = base + posixpath.normpath(name)
                if at in used:
                    return ""
                if at in known:
                    return put(at)
            missing.append(name)
            return ""

        whole = put(main)
        return pd.DataFrame([(main, len(used), missing, whole)], columns=["main", "n_files", "missing", "text"])

    return mains.join(above, "folder").groupBy("main").applyInPandas(join, "main string, n_files int, missing array<string>, text string")


def tex_counts(df: DataFrame, text: str) -> DataFrame:
    """Counts per project text, comments left out; citations by key, and how many keys."""
    bare = F.regexp_replace(F.col(text), r"(?m)(?<!\\)%.*$", "")
    keys = F.filter(F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(TEX_CITE), F.lit(1)), lambda k: F.transform(F.split(k, ","), lambda x: F.trim(x)))), lambda x: x != "")
    return df.select("*", *(F.regexp_count(bare, F.lit(p)).alias(n) for n, p in TEX_COUNTS.items()), F.size(keys).alias("citations"), F.size(F.array_distinct(keys)).alias("citation_keys"))


def tex_texts(df: DataFrame) -> DataFrame:
    """Every TeX project with its counts."""
    return tex_counts(tex_projects(df), "text")


def pdf_facts(df: DataFrame) -> DataFrame:
    """(path, pages, fonts, images, encrypted, bytes) by patterns over the raw bytes."""
    raw = F.decode("content", "ISO-8859-1")
    n = lambda p: F.regexp_count(raw, F.lit(p))
    return df.filter("content IS NOT NULL").select("path", n(r"/Type\s*/Page(?![a-zA-Z])").alias("pages"), n(r"/Type\s*/Font(?![a-zA-Z])").alias("fonts"), n(r"/Subtype\s*/Image").alias("images"), raw.rlike("/Encrypt").alias("encrypted"), F.length("content").alias("bytes"))


READERS = {"tex": tex_texts, "xlsx": workbook_cells, "docx": document_outline, "pptx": deck_slides, "pdf": pdf_facts, "zip": zip_entries}


def read(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Files of one format through its reader."""
    if extension not in READERS:
        raise ValueError(f"no reader for .{extension}")
    return READERS[extension](files(spark, path, f"*.{extension}"))


def sqlite_rows(df: DataFrame, tables: list[str]) -> DataFrame:
    """(path, table, row, error): the rows of whole tables of SQLite files, each as JSON."""

    def parse(content: bytes) -> Iterator[tuple]:
        with contextlib.closing(sqlite3.connect(":memory:")) as con:
            con.deserialize(content)
            con.row_factory = sqlite3.Row
            for table in tables:
                try:
                    for row in con.execute('SELECT * FROM "' + table.replace('"', '""') + '"'):
                        yield table, json.dumps(dict(row), ensure_ascii=False)
                except sqlite3.Error as found:
                    yield table, None, str(found)

    return _each(df, parse, "table string, row string")
