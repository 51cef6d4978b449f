"""Column functions on how text is shown: widths, displayed numbers, escapes, schema specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that take a whole em, and the narrow and wide ones among the rest.  (Fixed values.)
FULL = r"[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]"
NARROW = r"[iljI.,;:!'|`\[\](){} ]"
WIDE = "[mwMW@%]"


def estimate_em(x: Column) -> Column:
    """Width of a text in em, by counting each class of characters once."""
    rest, parts = x, []
    for pattern, em in ((FULL, 1.0), (r"\t", 1.1), (NARROW, 0.28), (WIDE, 0.9), ("[A-Z]", 0.66), ("[0-9]", 0.56)):
        parts.append(F.regexp_count(rest, F.lit(pattern)) * em)
        rest = F.regexp_replace(rest, pattern, "")
    return sum(parts, F.length(F.regexp_replace(rest, "\n", "")) * 0.54)


#: What a line can break between: Latin words whole, runs of white space, any other character alone.  (Fixed value.)
WRAP_TOKEN = r"[A-Za-z0-9@%._#+\-/]+|\s+|[^\s]"


def wrapped(x: Column, width_pt: float, size_pt: float = 11.0) -> Column:
    """The lines of a text that is broken where the next token would exceed a width; no white space at a line's end or a broken line's start.

    A fold over the tokens of each line, whose widths are estimated once.
    """
    limit = max(size_pt * 0.6, width_pt)
    state = "struct<done:array<string>,line:string,width:double>"

    def one(raw: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(raw, F.lit(WRAP_TOKEN), F.lit(0)), lambda t: F.struct(t.alias("t"), (estimate_em(t) * size_pt).alias("w")))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"), F.lit(0.0).alias("width")).cast(state)

        def step(a: Column, t: Column) -> Column:
            full = (a["width"] + t["w"] > limit) & (F.trim(F.regexp_replace(a["line"], r"\s", " ")) != "")
            head = F.regexp_replace(t["t"], r"^\s+", "")
            broken = F.struct(F.concat(a["done"], F.array(F.regexp_replace(a["line"], r"\s+$", ""))).alias("done"), head.alias("line"), F.when(head == "", 0.0).otherwise(t["w"]).alias("width"))
            return F.when(full, broken.cast(state)).otherwise(F.struct(a["done"].alias("done"), F.concat(a["line"], t["t"]).alias("line"), (a["width"] + t["w"]).alias("width")).cast(state))

        return F.aggregate(tokens, start, step, lambda a: F.concat(a["done"], F.array(F.regexp_replace(a["line"], r"\s+$", ""))))

    return F.flatten(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), one))


def visual_width(x: Column) -> Column:
    """Characters, those of an em or nearly one twice."""
    return F.length(x) + F.regexp_count(x, F.lit(rf"{FULL}|\t"))


def display_number(x: Column, code: Column) -> Column:
    """A number as its format hints: two decimals, thousands, percent, a placeholder for dates."""
    two = lambda v: F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
    whole = x == F.floor(x)
    return (
        F.when(code.rlike(r"0\.00") & code.rlike("#,##0"), F.format_number(x, 2)).when(code.rlike(r"0\.00"), F.format_string("%.2f", x)).when(code.rlike("%"), F.concat(two(F.round(x * 100, 2)), F.lit("%")))
        .when(code.rlike("[ymd]"), "2000-00-00").when(whole & code.rlike("#,##0"), F.format_number(x, 0)).when(whole, F.format_string("%.0f", x)).otherwise(two(F.round(x, 2)))
    )


def escape_latex(x: Column) -> Column:
    out = F.regexp_replace(x, r"\\", F.lit("\\\\textbackslash{}"))
    out = F.regexp_replace(out, r"([&%$#_{}])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(out, "~", F.lit("\\\\textasciitilde{}")), r"\^", F.lit("\\\\textasciicircum{}"))


_TYPES = {"auto": T.StringType(), "text": T.StringType(), "number": T.DoubleType(), "currency": T.DoubleType(), "percent": T.DoubleType(), "date": T.TimestampNTZType()}


def schema_of(columns: list) -> T.StructType:
    """A schema from names or {key, title, type, format, width, align}; unknown types become auto, the rest goes to the fields' metadata."""
    fields = []
    for k, raw in enumerate(columns):
        spec = raw if isinstance(raw, dict) else {"key": f"c{k}", "title": str(raw)}
        kind = spec.get("type") if spec.get("type") in _TYPES else "auto"
        title = spec.get("title") or spec.get("name") or spec.get("label") or spec.get("key") or f"列{k + 1}"
        fields.append(T.StructField(spec.get("key") or f"c{k}", _TYPES[kind], True, {"title": title, "type": kind, "format": spec.get("format", ""), "width": spec.get("width", 0), "align": spec.get("align", "")}))
    return T.StructType(fields)
