"""Record stores as tables: ledgers, links, hot entries, archives, provider payloads, result pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities, strip_tags

LEDGER = "id string, at timestamp, path string, format string, theme string, bytes long, purpose string, outline array<string>, source array<string>, kbRefs array<string>, note string"
LINK = "id string, sourceId string, targetId string, kind string, conflictClass string, conflictState string, note string, at timestamp"
TOMBSTONE = "id string, at timestamp, reason string"
ENTRY = "id string, target string, content string, importance string, entities array<string>, tags array<string>, kbRefs array<string>, sources array<string>, createdAt timestamp, updatedAt timestamp"
STORE = f"struct<version:int,contentRevision:string,entries:array<struct<{', '.join(f.replace(' ', ':', 1) for f in ENTRY.split(', '))}>>>"
#: Values that an entry's importance and target can have; the first is the fallback.  (Fixed values.)
IMPORTANCE, TARGETS = ["normal", "critical", "low"], ["project", "user"]
LINK_KINDS = ["supports", "contradicts", "refines", "depends", "derived", "related"]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; bad lines are passed over and a missing file is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def enum(column: Column, allowed: list[str]) -> Column:
    return F.when(column.isin(allowed), column).otherwise(allowed[0])


def hot_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a store document, those without content left out and unknown values made the fallback."""
    inner = STORE[len("struct<"):-1]
    rows = spark.read.schema(", ".join(_fields(inner))).option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")
    return rows.filter(F.trim("content") != "").withColumn("importance", enum(F.col("importance"), IMPORTANCE)).withColumn("target", enum(F.col("target"), TARGETS))


def _fields(inner: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(inner[at:k])
            at = k + 1
    return [f.strip().replace(":", " ", 1) for f in [*out, inner[at:]]]


def archive_items(digests: DataFrame) -> DataFrame:
    """Items of monthly volumes, flattened with the block and volume they come from."""
    blocks = digests.select("month", "volume", F.explode_outer("blocks").alias("b"))
    return blocks.select("month", "volume", F.col("b.id").alias("block_id"), F.col("b.at").alias("block_at"), F.col("b.reason").alias("reason"), F.explode_outer("b.items").alias("item"))


def union_origins(**stores: DataFrame) -> DataFrame:
    """Stores of one shape, each row tagged with where it comes from."""
    out = None
    for name, df in stores.items():
        tagged = df.withColumn("origin", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


#: Where search providers keep their results, by family: where the list can be, then where url, title, snippet and date can be in an item.  (Fixed values.)
PAYLOADS = {
    "tavily": (["$.results"], ["$.url"], ["$.title"], ["$.content"], []),
    "brave": (["$.web.results"], ["$.url"], ["$.title"], ["$.description"], ["$.age"]),
    "bocha": (["$.data.webPages.value", "$.webPages.value", "$.data.value"], ["$.url", "$.siteUrl"], ["$.name", "$.title"], ["$.snippet", "$.summary", "$.description"], ["$.datePublished", "$.dateLastCrawled"]),
    "exa": (["$.results"], ["$.url"], ["$.title"], ["$.text", "$.summary", "$.highlights[0]"], ["$.publishedDate"]),
    "serper": (["$.organic"], ["$.link", "$.url"], ["$.title"], ["$.snippet"], ["$.date"]),
    "searxng": (["$.results"], ["$.url"], ["$.title"], ["$.content"], ["$.publishedDate"]),
    "openai": (["$.choices[0].message.annotations"], ["$.url_citation.url", "$.url"], ["$.url_citation.title", "$.title"], ["$.url_citation.snippet", "$.url_citation.text", "$.snippet", "$.text"], []),
}
#: Links in markdown, which stand in for missing annotations; the part of a payload that holds them.  (Fixed values.)
MARKDOWN_LINK, MESSAGE = r"\[([^\]]{0,200})\]\((https?://[^\s)]{1,600})\)", "$.choices[0].message.content"


def _first(text: Column, paths: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(text, p), F.lit("")) for p in paths), F.lit(None).cast("string"))


def _once_each(rows: DataFrame, key: str) -> DataFrame:
    """Results with an address, the first of several with the same."""
    first = rows.filter("url IS NOT NULL AND url <> ''").groupBy(key, "url").agg(F.min(F.struct("ord", "title", "snippet", "published_at")).alias("m"))
    return first.select(key, "m.ord", "url", "m.title", "m.snippet", "m.published_at")


def provider_sources(df: DataFrame, key: str, payload: str, family: str) -> DataFrame:
    """(key, ord, url, title, snippet, published_at) of a provider's JSON; results without an address are left out, and repeats keep the first."""
    if family == "anthropic":
        return _cited_sources(df, key, payload)
    lists, url, title, snippet, date = PAYLOADS[family]
    items = F.coalesce(*(F.from_json(F.get_json_object(payload, p), "array<string>") for p in lists))
    each = df.select(key, payload, F.posexplode_outer(items).alias("ord", "r"))
    rows = each.filter("r IS NOT NULL").select(key, "ord", *(_first(F.col("r"), p).alias(n) for n, p in (("url", url), ("title", title), ("snippet", snippet), ("published_at", date))))
    if family == "openai":
        said = F.get_json_object(payload, MESSAGE)
        links = F.arrays_zip(F.regexp_extract_all(said, F.lit(MARKDOWN_LINK), F.lit(2)).alias("url"), F.regexp_extract_all(said, F.lit(MARKDOWN_LINK), F.lit(1)).alias("title"))
        none = F.lit(None).cast("string")
        bare = df.filter(F.coalesce(F.size(items), F.lit(0)) < 1).select(key, F.posexplode(links).alias("ord", "r")).select(key, "ord", "r.url", "r.title", none.alias("snippet"), none.alias("published_at"))
        rows = rows.unionByName(bare)
    return _once_each(rows, key)


def _cited_sources(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Results of tool blocks, with what the text blocks cite of the same address."""
    blocks = df.select(key, F.posexplode(F.from_json(F.get_json_object(payload, "$.content"), "array<string>")).alias("b", "block"))
    of = lambda path: F.from_json(F.get_json_object("block", path), "array<string>")
    kind = F.get_json_object("block", "$.type")
    found = blocks.filter(kind == "web_search_tool_result").select(key, "b", F.posexplode(of("$.content")).alias("k", "r")).filter(F.get_json_object("r", "$.type") == "web_search_result")
    cited = blocks.filter(kind == "text").select(key, "b", F.posexplode(of("$.citations")).alias("k", "c")).select(key, F.struct("b", "k").alias("place"), _first(F.col("c"), ["$.url"]).alias("url"), _first(F.col("c"), ["$.cited_text"]).alias("snippet"))
    cited = cited.filter("url IS NOT NULL AND snippet IS NOT NULL").groupBy(key, "url").agg(F.min_by("snippet", "place").alias("snippet"))
    rows = found.select(key, (F.col("b") * 1000 + F.col("k")).alias("ord"), _first(F.col("r"), ["$.url"]).alias("url"), _first(F.col("r"), ["$.title"]).alias("title"), _first(F.col("r"), ["$.page_age"]).alias("published_at"))
    return _once_each(rows.join(cited, [key, "url"], "left"), key)


def result_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, url, title, snippet) of a results page: result links, else address links; snippets by their position; redirects unwrapped."""
    def links(name: str, most: int) -> Column:
        pattern = rf'(?is)<a\b[^>]*class="[^"]*{name}[^"]*"[^>]*href="([^"]{{1,1000}})"[^>]*>(.{{0,{most}}}?)</a>'
        return F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("title"))

    said = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*class="[^"]*result__snippet[^"]*"[^>]*>(.{0,1200}?)</a>'), F.lit(1))
    found = F.when(F.size(links("result__a", 600)) > 0, links("result__a", 600)).otherwise(links("result__url", 400))
    rows = df.select(key, said.alias("said"), F.posexplode(found).alias("ord", "r"))
    url = decode_entities(F.col("r.url"))
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    target = F.regexp_extract(url, r"[?&]uddg=([^&]+)", 1)
    snippet = F.nullif(strip_tags(F.get("said", F.col("ord"))), F.lit(""))
    return rows.select(key, "ord", F.when(target != "", F.url_decode(target)).otherwise(url).alias("url"), strip_tags(F.col("r.title")).alias("title"), snippet.alias("snippet"))
