"""Column functions over text: tokens, similarity, hashes, cleaning.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript defines it; Java's and RE2's own class is ASCII only.  (Fixed values.)
SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The CJK range of the search tokeniser.
CJK = r"\u3400-\u9fff"


def squeeze(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, f"(?![!-~])[{SPACE}]+", " "))  # printable ASCII is ruled out first, which is most of it


def trimmed(x: Column, space: str = SPACE) -> Column:
    return F.regexp_replace(x, rf"^[{space}]+|[{space}]+\z", "")


def pairs_of(x: Column) -> Column:
    """All runs of two characters of a string of at least two."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda k: F.substring(x, k, F.lit(2)))


def search_tokens(x: Column) -> Column:
    """Lower-cased pieces between white space and , ; | /; runs of CJK characters as pairs, other runs whole."""
    # Looking for a letter first spares most characters the test against the whole class.
    pieces = F.array_remove(F.split(F.lower(F.coalesce(x, F.lit(""))), rf"(?![a-z0-9])[{SPACE},，、;；|/]+"), "")
    runs = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))))
    parted = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]{{2,}}$"), pairs_of(r)).otherwise(F.array(r))))
    return F.when(x.rlike(f"[{CJK}]"), parted).otherwise(pieces)


def search_terms(x: Column) -> Column:
    return F.array_distinct(search_tokens(x))


def claim_tokens(x: Column) -> Column:
    """Distinct tokens for comparing claims: ASCII words of three characters or more whole, any other word as character pairs."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), rf"[{SPACE}，。、；：！？,.;:!?\"'（）()\[\]【】]+", " "), " ")
    each = lambda w: F.when(w.rlike("^[a-z0-9]+$"), F.when(F.length(w) >= 3, F.array(w)).otherwise(F.array().cast("array<string>"))).when(F.length(w) >= 2, pairs_of(w)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(words, each)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def content_hash(x: Column, profile: str) -> Column:
    """The first 12 hex digits of sha1(profile, NUL, text)."""
    return F.substring(F.sha1(F.concat(F.lit(profile), F.decode(F.unhex(F.lit("00")), "UTF-8"), x)), 1, 12)


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def match_score(x: Column, terms: list[str]) -> Column:
    """How many of the query's terms the text contains, as substrings in lower case."""
    return sum((F.contains(F.lower(x), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))


def urls(x: Column) -> Column:
    """Distinct http(s) addresses in order, without the punctuation behind them."""
    found = F.regexp_extract_all(x, F.lit(rf"""https?://[^{SPACE})\]}}>，。；、"'）】]+"""), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?、，。；：！？]+$", "")), lambda u: u != ""))


def host(url: Column) -> Column:
    """Lower-cased host with its port, without www. in front; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)), r"^www\.", "")


def domain(x: Column) -> Column:
    """What a site entry's address comes down to: no scheme, path, port or www., lower case."""
    bare = F.regexp_replace(F.lower(trimmed(x)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[/?#].*$", ""), r":\d+$", ""), r"^www\.", "")


def slug(x: Column) -> Column:
    """Each character that file names cannot hold, and each run of white space, becomes -; none at the ends; at most 80 characters."""
    out = F.regexp_replace(F.regexp_replace(trimmed(x), r"[\\/:*?\"<>|\x00-\x1f]", "-"), f"[{SPACE}]+", "-")
    return F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, 80)


#: Named entities that are decoded.  (Fixed values.)
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ldquo": "“", "rdquo": "”", "mdash": "—", "ndash": "–", "hellip": "…", "middot": "·", "times": "×", "copy": "©", "reg": "®",
}


def _numeric(x: Column, pattern: str, base: int, head: str) -> Column:
    """Character references of one base, each distinct one replaced by its character."""
    codes = F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)))
    char = lambda c: F.decode(F.unhex(F.lpad(F.conv(c, base, 16), 8, "0")), "UTF-32")
    return F.when(x.rlike(pattern), F.aggregate(codes, x, lambda t, c: F.replace(t, F.concat(F.lit(head), c, F.lit(";")), char(c)))).otherwise(x)


def decode_entities(x: Column) -> Column:
    """Common named entities, then decimal and hexadecimal ones; the ampersand last, so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        x = F.regexp_replace(x, f"(?i)&{name};", char)
    x = _numeric(x, r"&#([0-9]{1,6});", 10, "&#")
    x = _numeric(x, r"&#x([0-9a-fA-F]{1,5});", 16, "&#x")
    return F.regexp_replace(x, "(?i)&amp;", "&")


def strip_tags(x: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(x, "<[^>]*>", " ")))


def escape_xml(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def mask_credentials(x: Column) -> Column:
    """Hides user and password of an address."""
    return F.regexp_replace(x, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1***@")


def clock(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    minutes, rest = F.floor((s % 3600) / 60), s % 60
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), two(minutes), two(rest))).otherwise(F.concat_ws(":", two(minutes), two(rest)))


def string_list(x: Column, most: int = 12) -> Column:
    """Trimmed, without blanks or repeats, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(x, trimmed), lambda v: v != "")), 1, most)


def parse_list(x: Column) -> Column:
    """A JSON array of strings, or text with commas."""
    parsed = F.from_json(x, "array<string>")
    return F.coalesce(F.when(trimmed(x).startswith("["), parsed), F.filter(F.transform(F.split(x, ","), trimmed), lambda v: v != ""))


#: What lines of menus begin with.  (Fixed values.)
MENU = "首页|导航|登录|注册|下载|更多|相关阅读|推荐阅读|热门|栏目|客户端|扫一扫|分享到|版权声明|免责声明"


def excerpt(x: Column, most: int = 180) -> Column:
    """The first two lines of 20 characters or more that are prose (no heading, link or menu), or the first two, or all."""
    long = F.filter(F.transform(F.split(x, "\r?\n"), squeeze), lambda v: F.length(v) >= 20)
    prose = F.filter(long, lambda v: ~F.contains(v, F.lit("](")) & ~v.startswith("#") & ~v.rlike(f"^({MENU})"))
    chosen = F.array_join(F.slice(F.when(F.size(prose) > 0, prose).otherwise(long), 1, 2), " ")
    chosen = F.when(chosen == "", squeeze(x)).otherwise(chosen)
    return F.when(F.length(chosen) > most, F.concat(F.substring(chosen, 1, most), F.lit("…"))).otherwise(chosen)


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """{{key}} in a template becomes the key's value."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value.cast("string"))
    return template


def replace_counted(x: Column, find: str, put: str) -> tuple[Column, Column]:
    """(text with every occurrence replaced, how many there were)."""
    new = F.replace(x, F.lit(find), F.lit(put))
    return new, ((F.length(x) - F.length(F.replace(x, F.lit(find), F.lit("")))) / len(find)).cast("long")


def edited(x: Column, edits: list[dict]) -> Column:
    """struct(text, applied, missing) after literal replacements {find, replace, all} in turn: all occurrences or, for ``all`` False, the first.

    ``applied`` holds each text found, with how often it was replaced; one that is nowhere, or is empty, is in ``missing``.
    """
    applied, missing = [], []
    for edit in edits:
        find, put = edit.get("find") or "", F.lit(edit.get("replace") or "")
        if not find:
            missing.append(F.lit(find))
            continue
        at = F.instr(x, find)
        if edit.get("all") is False:
            new, said = F.when(at > 0, F.overlay(x, put, at, F.lit(len(find)))).otherwise(x), F.lit(find)
        else:
            new, n = replace_counted(x, find, edit.get("replace") or "")
            said = F.concat(F.lit(f"{find} ×"), n.cast("string"))
        applied.append(F.when(at > 0, said))
        missing.append(F.when(at == 0, F.lit(find)))
        x = new
    some = lambda xs: F.filter(F.array(*xs), lambda v: v.isNotNull()) if xs else F.array().cast("array<string>")
    return F.struct(x.alias("text"), some(applied).alias("applied"), some(missing).alias("missing"))


def unescape_xml(x: Column) -> Column:
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x
