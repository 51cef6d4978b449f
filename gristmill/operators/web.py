"""Web pages: metadata, plain text, clean lines, sentinels.

Finding the matching end of nested regions needs a count of depths, which no regular
expression keeps; that step alone runs in Python, on Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, decode_entities, host, squeeze, trimmed

# Tags, attribute words and phrases that mark what is not content.
NON_CONTENT = ["script", "style", "noscript", "template", "svg", "canvas", "iframe", "form", "select", "textarea", "button", "dialog"]
SKELETON = ["nav", "header", "footer", "aside"]
CONTAINERS = ["div", "section", "ul", "ol", "span", "p", "table", "li", "a"]
BOILERPLATE_WORDS = "nav|navbar|menu|sidebar|side-bar|footer|header|comment|comments|reply|cookie|consent|gdpr|advert|ad|ads|banner|promo|share|sharing|social|related|recommend|subscribe|newsletter|breadcrumb|pagination|pager|toolbar|masthead|skip-link|back-to-top|sitemap|site-map|language|lang-switch"
BOILERPLATE = rf"(?i)(?:^|[-_. ])(?:{BOILERPLATE_WORDS})(?:[-_. ]|$)"
ATTRIBUTE = r"""(?i)(?:^|[\s"'/])(?:id|class)\s*=\s*("[^"]{0,240}"|'[^']{0,240}'|[^\s>]{0,240})"""
BOILERPLATE_LINE = (
    r"(?i)^(?:cookie|we use cookies|this (?:site|website) uses|accept (?:all )?cookies|by (?:continuing|using)|manage (?:cookies|preferences)|privacy policy|terms of (?:service|use)|all rights reserved|sign ?(?:in|up)|log ?in|register|subscribe|newsletter|follow us"
    r"|share (?:this|on)|related (?:posts|articles)|recommended|read more|advertisement|sponsored|skip to (?:content|main)|back to top|copyright|©|版权所有|免责声明|隐私政策|用户协议|服务条款|登录|注册|订阅|关注我们|分享到|扫码|下载客户端|相关内容|相关阅读|推荐阅读|热门推荐|上一篇|下一篇|返回顶部|京ICP|沪ICP|粤ICP)"
)
SENTENCE_END = r"""[.!?。！？…；;：:）)】」』"'”’]$"""
# Texts and addresses of pages that are walls, in the order in which they are tried.  The patterns must be these; the second
# value is the verdict, a class to count by, which is this engine's own.
BLOCK_TEXT = [
    (r"attention required", "blocked"),
    (r"you have been blocked", "blocked"),
    (r"cf-error-details|cf_chl_", "blocked"),
    (r"just a moment\.\.\.", "challenge"),
    (r"enable javascript and cookies to continue", "challenge"),
    (r"checking your browser before accessing", "challenge"),
    (r"verify you are human", "challenge"),
    (r"g-recaptcha|hcaptcha", "challenge"),
    (r"unavailable in your (region|country)", "region"),
    (r"not available in your (region|country)", "region"),
    (r"sign in to continue|please (sign|log) in to", "login"),
    (r"accounts\.google\.com/o/oauth2|consent\.google\.com", "login"),
]
BLOCK_URL = [(r"app-unavailable-in-region|unavailable-in-region", "region"), (r"challenge-platform|/cdn-cgi/challenge", "challenge")]
LEAST_CHARS, NOTICE_CHARS, SCANNED_CHARS = 20, 200, 4000
MIN_LINE_CHARS = 12


def sentinel(status: Column, url: Column, text: Column) -> Column:
    """What a fetched page is: an HTTP failure, a wall, empty, short or ok; the first rule that holds.  For uncleaned text."""
    text, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    out = F.when(status >= 500, "server_error").when(status.isin(404, 410), "missing").when(status >= 400, "refused")
    for pattern, name in BLOCK_URL:
        out = out.when(url.rlike(f"(?i){pattern}"), name)
    for pattern, name in BLOCK_TEXT:
        out = out.when((n <= SCANNED_CHARS) & text.rlike(f"(?i){pattern}"), name)
    return out.when(n < LEAST_CHARS, "empty").when(n < NOTICE_CHARS, "short").otherwise("ok")


FAILURE_KINDS = {"server_error": "network", "missing": "blocked", "refused": "blocked", "blocked": "blocked", "challenge": "blocked", "region": "blocked", "login": "blocked", "empty": "empty"}


def failure_kind(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in FAILURE_KINDS.items() for x in pair))[code]


META_PATTERNS = {
    "title": (r"<title[^>]*>(.{0,400}?)</title\s*>", r'<meta[^>]+property\s*=\s*"og:title"[^>]+content\s*=\s*"([^"]{0,400})"'),
    "site": (r'<meta[^>]+property\s*=\s*"og:site_name"[^>]+content\s*=\s*"([^"]{0,200})"',),
    "byline": (r'<meta[^>]+name\s*=\s*"author"[^>]+content\s*=\s*"([^"]{0,200})"',),
    "published_at": (r'<meta[^>]+property\s*=\s*"article:published_time"[^>]+content\s*=\s*"([^"]{0,80})"', r'<time[^>]+datetime\s*=\s*"([^"]{0,80})"'),
    "lang": (r'<html[^>]+lang\s*=\s*"([^"]{0,20})"',),
}
META = list(META_PATTERNS)


def meta(html: Column, patterns: dict[str, tuple[str, ...]] = META_PATTERNS, tidy: Callable[[Column], Column] = lambda x: squeeze(decode_entities(x))) -> list[Column]:
    """title, site, byline, published_at and lang; empty where the page does not say.  The first pattern whose tidied find is not empty counts."""
    found = lambda p: F.nullif(tidy(F.regexp_extract(html, f"(?is){p}", 1)), F.lit(""))
    return [F.coalesce(*map(found, tried), F.lit("")).alias(name) for name, tried in patterns.items()]


def plain_text(html: Column) -> Column:
    """Blocks end lines, list items begin with -, cells with |, headings with up to three #; other tags become spaces."""
    steps = [
        (r"(?is)<a\b[^>]*>(.{0,2000}?)</a\s*>", " $1 "), (r"(?i)<h1\b[^>]*>", "\n\n# "), (r"(?i)<h2\b[^>]*>", "\n\n## "), (r"(?i)<h[3-6]\b[^>]*>", "\n\n### "),
        (r"(?i)</(h[1-6]|p|div|section|article|main|blockquote|table|tr|ul|ol|dl|pre|figure)\s*>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<t[dh]\b[^>]*>", " | "), (r"<[^>]*>", " "),
    ]
    out = html
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return decode_entities(out)


def linked_text(html: Column) -> Column:
    """Plain text that keeps links as [label](address)."""
    return plain_text(F.regexp_replace(html, r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.{0,2000}?)</a\s*>""", "[$2]($1)"))


_ATTRIBUTE = re.compile(ATTRIBUTE)
_WORDS = re.compile(BOILERPLATE)


def boilerplate_tag(tag: str) -> bool:
    """Whether an opening tag's first id or class names something that is not content."""
    found = _ATTRIBUTE.search(tag)
    return bool(found and _WORDS.search(re.sub("[\"']", " ", found[1])))


_ANY_TAG: dict[str, re.Pattern] = {}


def region_end(html: str, name: str, at: int) -> tuple[int, int] | None:
    """(start, end) of the closing tag that ends the element opened before ``at``, nested ones of its name counted; None if it is never closed."""
    pattern = _ANY_TAG.setdefault(name, re.compile(rf"<(/?){name}\b[^>]*>", re.I))
    depth = 1
    for m in pattern.finditer(html, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.start(), m.end()
        elif not m.group().endswith("/>"):
            depth += 1
    return None


def drop_regions(html: str, names: list[str], accept=lambda tag: True) -> tuple[str, int]:
    """Elements of these names that are accepted become a space; of those never closed, the tag alone goes."""
    opener = re.compile(rf"<({'|'.join(names)})\b[^>]*>", re.I)
    out, at, dropped = [], 0, 0
    for m in opener.finditer(html):
        if m.start() < at or not accept(m.group()):
            continue
        end = (m.end(), m.end()) if m.group().endswith("/>") else region_end(html, m[1].lower(), m.end())
        out += [html[at:m.start()], " "]
        at = end[1] if end else m.end()
        dropped += end is not None
    return "".join([*out, html[at:]]), dropped


_COMMENTS = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", re.S)
_MAIN = [
    re.compile(r"<(article)\b[^>]*>", re.I), re.compile(r"<(main)\b[^>]*>", re.I), re.compile(r"<(div|section)\b[^>]*\brole\s*=\s*\"?main\"?[^>]*>", re.I),
    re.compile(r"<(div|section)\b[^>]*\b(?:id|class)\s*=\s*\"[^\"]*(?:article|post|content|entry|main)[^\"]*\"[^>]*>", re.I),
]


def strip_noise(html: str) -> tuple[str, int]:
    """(HTML without comments, scripts, page skeleton and boilerplate containers; regions dropped)."""
    text = _COMMENTS.sub(" ", html)
    for name in NON_CONTENT:
        text = re.sub(rf"<{name}\b[^>]*>.*?</{name}\s*>", " ", text, flags=re.I | re.S)
        text = re.sub(rf"</?{name}\b[^>]*>", " ", text, flags=re.I)
    total = 0
    for names, accept in [*(([n], lambda tag: True) for n in SKELETON), (CONTAINERS, boilerplate_tag)]:
        text, n = drop_regions(text, names, accept)
        total += n
    return text, total


def main_region(html: str) -> tuple[str, bool]:
    """The candidate for the page's content with the longest visible text, or the whole page."""
    best, longest = None, 0
    for pattern in _MAIN:
        at = 0
        while m := pattern.search(html, at):
            end = region_end(html, m[1].lower(), m.end())
            at = end[1] if end else m.end()
            if end:
                inner = html[m.end():end[0]]
                n = len(re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", inner)).strip())
                best, longest = (inner, n) if n > longest or best is None else (best, longest)
    return (html, False) if best is None else (best, True)


def content_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Every page's columns but its HTML, with content, regions and main_region; the sequential step of the page pipeline."""
    rest = pages.drop(html)
    schema = T.StructType([*rest.schema.fields, T.StructField("content", T.StringType()), T.StructField("regions", T.IntegerType()), T.StructField("main_region", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(batch.num_columns - 1).to_pylist():
                bare, n = strip_noise(page or "")
                inner, picked = main_region(bare)
                rows.append((inner, n, picked))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "content", "regions", "main_region"])

    return pages.select(*rest.columns, html).mapInArrow(run, schema)


@dataclass(frozen=True)
class LineRules:
    """How lines are read: what is trimmed, what may follow a heading's #, the lower case of keys, and lines as the boilerplate pattern sees them."""

    ends: str = SPACE
    space: str = SPACE
    lower: Callable[[Column], Column] = F.lower
    read: Callable[[Column], Column] = lambda v: v


#: As DuckDB reads lines: space separators alone are trimmed, letters are lowered one by one, and the long s and the Kelvin sign match s and k.
SQL_RULES = LineRules(r"\p{Zs}", r"\t\n\f\r ", lambda v: F.lower(F.translate(v, "\u0130\u03a3", "i\u03c3")), lambda v: F.translate(v, "\u017f\u212a", "sk"))


def clean_lines(df: DataFrame, key: str, text: str, min_chars: int = MIN_LINE_CHARS, keep: list[str] = (), drop_boilerplate: bool = True, dedupe: bool = True, rules: LineRules = LineRules()) -> DataFrame:
    """(key, text, dropped, deduped, paragraphs, ``keep``): lines squeezed, boilerplate and short non-sentences dropped, repeats dropped, blank lines collapsed.

    Lines stay in their row's array, so there is no shuffle.  Each step hands its arrays
    on through a generator of one row: projections would otherwise be merged, and the
    patterns run again for every use of their results.  A repeat is found by sorting the
    lines by key and place, so long texts cost no more than a sort.
    """
    short = lambda v: (F.length(v) < min_chars) & ~v.rlike(f"(?d){SENTENCE_END}") & ~v.rlike(r"^[#\-|]")  # noqa: E731  (?d): only \n ends a line
    line = lambda v: trimmed(F.regexp_replace(v, "[ \\t\\u00a0]+", " "), rules.ends)
    once = lambda rows, *columns: rows.select(key, *keep, F.inline(F.array(F.struct(*columns))))
    bad = lambda v: (v != "") & (rules.read(v).rlike(BOILERPLATE_LINE) | short(v)) if drop_boilerplate else F.lit(False)
    rows = once(df, F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n"), line).alias("lines"))
    rows = once(rows, F.transform("lines", lambda v: F.struct(v.alias("v"), bad(v).alias("bad"), rules.lower(F.regexp_replace(v, f"^#+[{rules.space}]*", "")).alias("k"))).alias("lines"))
    good = F.filter("lines", lambda x: ~x["bad"])
    rows = once(rows, (F.size("lines") - F.size(good)).alias("dropped"), F.array_sort(F.transform(good, lambda x, n: F.struct(x["k"].alias("k"), n.alias("n"), x["v"].alias("v")))).alias("good"))
    first = lambda x, n: F.lit(not dedupe) | (F.length(x["k"]) < 6) | (n == 0) | (F.element_at("good", F.greatest(n, F.lit(1)))["k"] != x["k"])
    rows = once(rows, "dropped", F.size("good").alias("n_good"), F.transform(F.array_sort(F.transform(F.filter("good", first), lambda x: F.struct(x["n"], x["v"]))), lambda x: x["v"]).alias("kept"))
    joined = trimmed(F.regexp_replace(F.array_join("kept", "\n"), "\n{3,}", "\n\n"), rules.ends + r"\n")
    return once(rows, joined.alias("text"), "dropped", (F.col("n_good") - F.size("kept")).alias("deduped"), F.size(F.filter("kept", lambda v: v != "")).alias("paragraphs"))


@dataclass(frozen=True)
class CleanOptions:
    """How pages are cleaned."""

    mode: str = "article"
    drop_boilerplate: bool = True
    dedupe: bool = True
    min_chars: int = MIN_LINE_CHARS
    keep_title: bool = True


MODES, MOST_LINE_CHARS = ("article", "plain", "off"), 80


def clean_options(raw: dict | None) -> CleanOptions:
    """Options from a configuration: what is missing or of another type becomes the default, numbers are cut to their range."""
    raw, usual = raw if isinstance(raw, dict) else {}, CleanOptions()
    truth = lambda name, default: raw[name] if isinstance(raw.get(name), bool) else default
    n = raw.get("minLineChars")
    number = isinstance(n, (int, float)) and not isinstance(n, bool) and math.isfinite(n)
    return CleanOptions(
        raw["mode"] if raw.get("mode") in MODES else usual.mode, truth("dropBoilerplate", usual.drop_boilerplate), truth("dedupeLines", usual.dedupe),
        min(MOST_LINE_CHARS, max(0, math.trunc(n))) if number else usual.min_chars, truth("keepTitle", usual.keep_title),
    )


def page_pipeline(pages: DataFrame, key: str, html: str, options: CleanOptions = CleanOptions(), text: str | None = None) -> DataFrame:
    """Cleaned text of every page with its metadata and counts; removed_ratio is against the length of what came in.

    Mode article picks the main region and cleans its lines, plain cleans the lines of the
    whole page's text, off hands that text through.  ``text`` names a column of text that
    stands in where a page has no HTML, and in the modes plain and off.  The parser, which
    only article needs, runs once, and everything else travels with its rows: no join.
    """
    source = F.coalesce(F.col(html), F.lit(""))
    given = F.coalesce(F.col(text), F.lit("")) if text else F.lit("")
    known = [c if options.keep_title else F.lit("").alias(name) for c, name in zip(meta(source), META, strict=True)]
    rows = pages.select(key, F.greatest(F.length(source), F.when(source == "", F.length(given)).otherwise(0)).alias("input_chars"), *known, source.alias("_html"), F.when(given == "", plain_text(source)).otherwise(given).alias("_plain"))
    keep = ["input_chars", *META, "regions", "main_region"]
    if options.mode == "article":
        rows = content_html(rows.withColumn("_bare", F.col("_html") == ""), key, "_html")
        rows = rows.withColumn("content", F.when(F.col("_bare"), F.col("_plain")).otherwise(plain_text(F.col("content"))))
        rows = rows.withColumn("regions", F.when(F.col("_bare"), 0).otherwise(F.col("regions"))).withColumn("main_region", ~F.col("_bare") & F.col("main_region"))
    else:
        rows = rows.withColumn("content", F.col("_plain")).withColumn("regions", F.lit(0)).withColumn("main_region", F.lit(False))
    if options.mode == "off":
        out = rows.select(key, *keep, F.col("content").alias("text"), F.lit(0).alias("dropped"), F.lit(0).alias("deduped"), F.size(F.filter(F.split("content", "\n"), lambda v: trimmed(v) != "")).alias("paragraphs"))
        ratio = F.lit(0.0)
    else:
        out = clean_lines(rows, key, "content", options.min_chars, keep, options.drop_boilerplate, options.dedupe)
        ratio = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.length("text") / F.col("input_chars"))) * 10000 + 0.5) / 10000
    return out.withColumn("output_chars", F.length("text")).withColumn("removed_ratio", F.when(F.col("input_chars") > 0, ratio).otherwise(0.0))


def page_report(cleaned: DataFrame) -> DataFrame:
    """One row: pages, characters in and out, the share taken out in percent with one decimal, lines dropped and repeated."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = cleaned.agg(F.count("*").alias("pages"), *map(total, ("input_chars", "output_chars", "dropped", "deduped")))
    percent = F.floor((1 - F.col("output_chars") / F.col("input_chars")) * 1000 + 0.5) / 10
    return sums.withColumn("percent", F.when(F.col("input_chars") == 0, 0.0).otherwise(percent))


def matches_site(url: Column, domain: Column) -> Column:
    """The host is the site's or one below it."""
    name = F.regexp_replace(host(url), r":\d+$", "")
    return (name == domain) | name.endswith(F.concat(F.lit("."), domain))


def site_of(urls: DataFrame, url: str, sites: DataFrame) -> DataFrame:
    """Each address with the first site entry that matches it.

    A host has few suffixes, so addresses meet sites on equality of those: no pair of an
    address and a site is formed that does not match.
    """
    name = F.split(F.regexp_replace(host(F.col(url)), r":\d+$", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(name), F.lit(1))), lambda k: F.array_join(F.slice(name, k, F.size(name)), "."))
    each = urls.select(url, F.explode(suffixes).alias("domain")).join(sites.select("domain", "ordinal", "label"), "domain")
    best = each.groupBy(url).agg(F.min_by("label", "ordinal").alias("label"), F.min("ordinal").alias("ordinal"))
    return urls.join(best, url, "left")


def site_hits(hits: DataFrame, types: list[str]) -> DataFrame:
    """(type, label, n, place): hits of each label, types in the catalogue's order and labels of a type by their hits."""
    counts = hits.filter(F.col("type").isin(types)).groupBy("type", "label").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.col("n").desc(), "label"))  # a row for each label
    return counts.withColumn("place", place).orderBy(F.array_position(F.array(*map(F.lit, types)), F.col("type")), "place")


def boilerplate_words(tag: Column) -> Column:
    """The predicate of boilerplate_tag as a column."""
    return F.regexp_replace(F.regexp_extract(tag, ATTRIBUTE, 1), "[\"']", " ").rlike(BOILERPLATE)


def find_lines(df: DataFrame, key: str, text: str, pattern: str, context: int = 1, most: int | None = None) -> DataFrame:
    """(key, line, before, content, after): lines that match, numbered from 0, with those around them.

    Case does not count, and a pattern that is no regular expression is taken literally.
    A line's neighbours are in its row's own array, so nothing is shuffled.
    """
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    rows = df.select(key, F.inline(F.array(F.struct(F.split(text, "\n").alias("lines")))))
    at = F.filter(F.transform("lines", lambda v, k: F.when(v.rlike(f"(?i){pattern}"), k)), lambda k: k.isNotNull())
    hits = rows.select(key, "lines", F.explode(at if most is None else F.slice(at, 1, most)).alias("line"))
    first = F.greatest(F.col("line") - context, F.lit(0))
    return hits.select(key, "line", F.slice("lines", first + 1, F.col("line") - first).alias("before"), F.get("lines", F.col("line")).alias("content"), F.slice("lines", F.col("line") + 2, F.lit(context)).alias("after"))
