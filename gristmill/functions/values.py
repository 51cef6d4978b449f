"""Column functions over cells: kinds, numbers, dates, references."""

from __future__ import annotations

import ipaddress
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, trimmed

#: Column types of a table specification.
COLUMN_TYPES = ["auto", "text", "number", "currency", "percent", "date"]


#: Kinds of cells and their patterns, in the order in which they are tried.  (Fixed values.)
CELL_KINDS = [
    ("percent", r"^-?[\d,]+(\.\d+)?%$"),
    ("number", r"^-?[\d,]+(\.\d+)?$"),
    ("currency", rf"^-?[¥$€£][{SPACE}]?[\d,]+(\.\d+)?$"),
    ("date", r"^\d{4}[-/年]\d{1,2}([-/月]\d{1,2}日?)?$"),
]


def classify(x: Column) -> Column:
    """The first kind whose pattern the trimmed text has, else text."""
    t = trimmed(F.coalesce(x, F.lit("")))
    return F.coalesce(*(F.when(t.rlike(pattern), kind) for kind, pattern in CELL_KINDS), F.lit("text"))


def to_number(x: Column) -> Column:
    """The number that a text begins with once signs of currency, commas and spaces are gone; a percent sign divides by 100."""
    t = trimmed(F.coalesce(x, F.lit("")))
    lead = F.regexp_extract(F.regexp_replace(t, rf"[¥$€£,{SPACE}]", ""), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    value = F.expr("null").cast("double")
    value = F.when(lead != "", lead.try_cast("double")).otherwise(value)
    return F.when(t.endswith("%"), value / 100).otherwise(value)


def clean_number(x: Column) -> Column:
    """Numbers that are not whole, to 12 significant digits."""
    return F.when(x == F.floor(x), x).otherwise(F.format_string("%.11e", x).cast("double"))


def date_serial(ts: Column) -> Column:
    """Days since 1899-12-30, the time of day as a fraction."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.date_diff(F.to_date(ts), F.lit("1899-12-30").cast("date")) + seconds / 86400.0


def parse_date(x: Column) -> Column:
    """Y-M-D with - / . or 年月日 between, and perhaps h:m[:s]; months and days beyond their range roll over."""
    t = trimmed(x)
    p = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, p, k), F.lit("")).cast("int"), F.lit(0))
    day = F.date_add(F.add_months(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1)
    at = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + part(4) * 3600 + part(5) * 60 + part(6))
    return F.when(t.rlike(p), at)


def is_date_format(code: Column) -> Column:
    """Whether a number format shows dates: y, m, d, h or s outside quotes, brackets and escapes."""
    bare = F.regexp_replace(F.lower(code), r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return bare.rlike("[ymdhs]") & ~bare.rlike("^general$")


def column_letters(index: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters."""
    n = index.cast("long") - 1
    one = lambda v: F.char((v % 26 + 65).cast("int"))
    return (
        F.when(n < 26, one(n))
        .when(n < 702, F.concat(one(F.floor((n - 26) / 26)), one(n - 26)))
        .otherwise(F.concat(one(F.floor((n - 702) / 676)), one(F.floor((n - 702) / 26)), one(n - 702)))
    )


def column_index(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))


def reference(ref: Column) -> Column:
    """struct(col, row) of an A1 reference, $ signs allowed."""
    p = r"^\$?([A-Za-z]{1,3})\$?(\d+)$"
    return F.when(ref.rlike(p), F.struct(column_index(F.regexp_extract(ref, p, 1)).alias("col"), F.regexp_extract(ref, p, 2).cast("long").alias("row")))


def bounded_int(x: Column, fallback: int, least: int, most: int) -> Column:
    """Cut to a whole number and into the range; the fallback where it is none."""
    value = x.cast("string").try_cast("double")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long")
    return F.when(value.isNull(), fallback).otherwise(F.least(F.greatest(whole, F.lit(least)), F.lit(most))).cast("long")


def public_ipv4(ip: Column) -> Column:
    """Whether an IPv4 address is none of the special ranges; null if it is no address."""
    p = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    a, b, c, d = (F.regexp_extract(ip, p, k).try_cast("int") for k in (1, 2, 3, 4))
    special = (
        (a == 0) | (a == 10) | (a == 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.when(ip.rlike(p) & (F.greatest(a, b, c, d) <= 255), ~special)


def content_class(mime: Column) -> Column:
    """html, text or null."""
    bare = F.trim(F.lower(F.regexp_extract(mime, "^[^;]*", 0)))
    return F.when(bare.isin("text/html", "application/xhtml+xml"), "html").when(bare.startswith("text/") | bare.isin("application/json", "application/xml") | bare.rlike(r"\+(json|xml)$"), "text")


def charset(mime: Column) -> Column:
    """The character set that a content type names, or null."""
    return F.nullif(F.trim(F.lower(F.regexp_extract(mime, r'(?i);\s*charset\s*=\s*"?([^";]+)"?', 1))), F.lit(""))


def looks_like_pdf(mime: Column, url: Column) -> Column:
    """By the content type or, where that says nothing, by the address's path."""
    bare = F.trim(F.lower(F.regexp_extract(F.coalesce(mime, F.lit("")), "^[^;]*", 0)))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return bare.isin("application/pdf", "application/x-pdf") | (bare.isin("", "application/octet-stream", "binary/octet-stream") & F.coalesce(path.endswith(".pdf"), F.lit(False)))


def valid_url(url: Column) -> Column:
    """http or https, no credentials, at most 2,048 characters."""
    return F.coalesce((F.length(url) <= 2048) & url.rlike(r"^(?i)https?://[^/?#\s@]+(?:[/?#]\S*)?$"), F.lit(False))


def compiled(x: Column, hint: str = "auto") -> Column:
    """struct(kind, number, text, money, percent) of a cell's text: the hint's kind or else the one it looks like, text where that does not parse.

    Only a text with a percent sign is divided by 100, which ``percent`` says; dates become serial days.
    """
    raw = F.coalesce(x, F.lit(""))
    kind = classify(raw) if hint == "auto" else F.lit(hint)
    number, at = to_number(raw), parse_date(raw)
    made = F.when(raw == "", F.lit(None)).when(kind.isin("number", "currency", "percent"), number).when(kind == "date", date_serial(at))
    told = F.when(made.isNull(), "text").when(kind == "date", "date").otherwise("number")
    return F.struct(told.alias("kind"), made.cast("double").alias("number"), F.when(made.isNull(), raw).alias("text"), (made.isNotNull() & (kind == "currency")).alias("money"), (made.isNotNull() & (kind == "percent") & F.contains(raw, F.lit("%"))).alias("percent"))


MOST_DEPTH, MOST_ITEMS = 4, 40
#: What stands for the rest of a value that is cut.  (Fixed values.)
TOO_DEEP, MORE_ITEMS, MORE_KEYS = "[深度截断]", "…共 {n} 项", ("…", "键过多已截断")


def safe_json(x: Column, kind: T.DataType, depth: int = 0) -> Column:
    """JSON of any value, bounded: four levels, 40 items or keys of each, numbers that JSON lacks as text, null for nothing."""
    plain = F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        out = F.when(F.isnan(x), '"NaN"').when(x == float("inf"), '"Infinity"').when(x == float("-inf"), '"-Infinity"').otherwise(plain)
    elif not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        out = plain
    elif depth >= MOST_DEPTH:
        out = F.lit(f'"{TOO_DEEP}"')
    elif isinstance(kind, T.ArrayType):
        head, tail = MORE_ITEMS.split("{n}")
        items = F.transform(F.slice(x, 1, MOST_ITEMS), lambda v: safe_json(v, kind.elementType, depth + 1))
        more = F.when(F.size(x) > MOST_ITEMS, F.array(F.concat(F.lit(f'"{head}'), F.size(x).cast("string"), F.lit(f'{tail}"')))).otherwise(F.array().cast("array<string>"))
        out = F.concat(F.lit("["), F.array_join(F.concat(items, more), ","), F.lit("]"))
    else:
        rest = f'"{MORE_KEYS[0]}":"{MORE_KEYS[1]}"'
        if isinstance(kind, T.StructType):
            fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), safe_json(x[f.name], f.dataType, depth + 1)) for f in kind.fields[:MOST_ITEMS]]
            pairs = F.array(*fields, *([F.lit(rest)] if len(kind.fields) > MOST_ITEMS else []))
        else:
            entry = lambda e: F.concat(safe_json(e["key"].cast("string"), T.StringType()), F.lit(":"), safe_json(e["value"], kind.valueType, depth + 1))
            pairs = F.concat(F.transform(F.slice(F.map_entries(x), 1, MOST_ITEMS), entry), F.when(F.size(x) > MOST_ITEMS, F.array(F.lit(rest))).otherwise(F.array().cast("array<string>")))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return F.when(x.isNull(), "null").otherwise(out)


#: Networks whose addresses are not public.  (Fixed values.)
SPECIAL_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "100.64.0.0/10", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3"]
SPECIAL_V6 = ["::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32", "64:ff9b::/32", "2002::/16"]


def _public(text: str | None, nets: dict[int, list]) -> bool | None:
    try:
        at = ipaddress.IPv6Address((text or "").strip("[]").partition("%")[0])
    except ValueError:
        return None
    at = at.ipv4_mapped or at
    return not any(at in net for net in nets[at.version])


def public_ipv6(ip: Column) -> Column:
    """Whether an IPv6 address is in none of the special networks, an embedded IPv4 address counting as that; null if it is no address.

    A parser reads the address, on Arrow batches: as an expression the eight groups would be worked out anew for every test.
    """

    @F.pandas_udf("boolean")
    def public(column: pd.Series) -> pd.Series:
        nets = {4: [ipaddress.ip_network(n) for n in SPECIAL_V4], 6: [ipaddress.ip_network(n) for n in SPECIAL_V6]}
        known = {x: _public(x, nets) for x in column.unique()}
        return column.map(known).astype("object")

    return public(ip)

