"""Findings in markdown: sections, claims with their sources, clusters of like claims."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, claim_tokens, host, jaccard, squeeze, trimmed, urls
from ..scratch import Scratch
from .components import components

#: Headings and the channels that they stand for, the first that matches.  (Fixed values.)
CHANNELS = [
    ("(泛搜|概览|overview|初步)", "泛搜"), ("(权威|官方媒体|人民日报|新华社|通稿|通报|媒体)", "权威媒体"), ("(?i)(百科|wiki|维基)", "百科"), ("(?i)(文献|论文|学术|研究|paper)", "文献"), ("(?i)(官方|文档|reference|手册|manual)", "官方文档"),
    ("(?i)(视频|bilibili|哔哩)", "社交平台：视频"), ("(社区|论坛|v2ex|知乎|讨论)", "社交平台：社区"), ("(?i)(国际|reddit|外网)", "社交平台：国际"), ("(?i)(问答|stackoverflow|stack)", "知识问答"), ("(?i)(仓库|github|release)", "官方仓库"),
]
LIKE = 0.5
#: A bullet that says that nothing was found.  (Fixed value.)
EMPTY_CLAIM = r"(?i)^[（(\[【]?\s*(?:未找到|没找到|没有找到|未发现|没有发现|未检索到|查不到|检索不到|无结果|暂无|无|none|not\s*found|no\s*results?)\s*[）)\]】]?[。.！!]?$"
UNGROUPED = "未分组"
#: What a section's channel must hold to cover a channel of a plan: a word of the plan's kind, then words of the section (and, where set, words of any case).  (Fixed values.)
COVERS = [
    ("泛搜", ["泛搜", "概览", "初步"], []), ("权威媒体", ["权威媒体", "媒体", "通报"], []), ("官方参考文档", ["官方文档", "官方参考", "手册"], ["reference"]), ("官方仓库", ["仓库"], ["github"]),
    ("文献", ["文献"], []), ("百科", ["百科"], ["wiki"]), ("知识问答", ["问答"], ["stack"]), ("正文核实", ["核实", "正文"], []),
]
#: A plan's kind that is just this counts as the third of COVERS; media looked back on count only for the plan's channel over a month.  (Fixed values.)
OFFICIAL, MEDIA, LOOKED_BACK = "官方文档", "权威媒体", "回看"


def channel(heading: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in CHANNELS:
        out = out.when(heading.rlike(pattern), name)
    return out.when(trimmed(heading) == "", UNGROUPED).otherwise(trimmed(heading))


def claim_text(x: Column) -> Column:
    """A bullet without its links and addresses, and without punctuation at its end."""
    for pattern in (r"\[[^\]]*\]\(https?://[^)\s]+\)", r"\(\s*https?://[^)\s]+\s*\)", r"(?<![(\w])https?://[^\s)>\]]+"):
        x = F.regexp_replace(x, pattern, " ")
    x = F.regexp_replace(x, rf"[{SPACE}]*[（(][{SPACE}]*[)）][{SPACE}]*$", "")
    return squeeze(F.regexp_replace(x, rf"[{SPACE},，;；:：、-]+$", ""))


def _lines(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, line, raw, heading, said): lines with the heading above them; ``said`` is what a bullet says, unless that is that nothing was found."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(markdown, "\r\n?", "\n"), "\n")).alias("line", "raw"))
    is_heading = F.col("raw").rlike(r"^#{1,4}\s+")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_heading", is_heading).withColumn("section", F.sum(is_heading.cast("int")).over(w))
    lines = lines.withColumn("heading", F.coalesce(F.last(F.when(is_heading, trimmed(F.regexp_extract("raw", r"^#{1,4}\s+(.*)$", 1))), ignorenulls=True).over(w), F.lit("")))
    bullet = r"^(?:[-*+]|\d+[.)])\s+(.*)$"
    said = F.when(~is_heading & trimmed(F.col("raw")).rlike(bullet), trimmed(F.regexp_extract(trimmed(F.col("raw")), bullet, 1)))
    return lines.withColumn("said", F.when(~said.rlike(EMPTY_CLAIM), said))


def parse(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, line, heading, channel, claim, urls, hosts), one row for each distinct claim of a document, its addresses merged.

    Bullets that only say that nothing was found are no claims.
    """
    found = _lines(docs, key, markdown).filter("said IS NOT NULL")
    return merged(found.select(key, "line", "heading", claim_text(F.col("said")).alias("claim"), urls(F.col("said")).alias("urls")), key)


def merged(found: DataFrame, key: str) -> DataFrame:
    """Claims of the same first 160 characters made one, with all their addresses; also over several files, where ``key`` is their topic."""
    out = found.filter("claim <> ''").groupBy(key, F.substring("claim", 1, 160).alias("_k")).agg(
        F.min("line").alias("line"), F.min_by("heading", "line").alias("heading"), F.min_by("claim", "line").alias("claim"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "urls"))), lambda r: r["urls"]))).alias("urls"),
    )
    return out.select(key, "line", "heading", channel(F.col("heading")).alias("channel"), "claim", "urls", F.filter(F.transform("urls", host), lambda h: h != "").alias("hosts"))


def merge_files(found: DataFrame, topic: str, order: str) -> DataFrame:
    """Parsed claims of several files as one result for each topic, files in their order."""
    rows = found.withColumn("line", F.struct(F.col(order).alias("file"), "line"))
    return merged(rows.select(topic, "line", "heading", "claim", "urls"), topic).withColumn("line", F.col("line.line"))


def empty_channels(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, channels): channels of sections that say nothing, without repeats."""
    sections = _lines(docs, key, markdown).groupBy(key, "section").agg(F.max("heading").alias("heading"), F.count_if(F.coalesce(claim_text(F.col("said")) != "", F.lit(False))).alias("n"))
    none = sections.filter("n = 0").withColumn("channel", channel(F.col("heading"))).filter(F.col("channel") != UNGROUPED)
    return none.groupBy(key).agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def like_pairs(claims: DataFrame, key: str, text: str, least: float = LIKE, within: str | None = None) -> DataFrame:
    """(a, b, similarity) of rows a < b whose token sets are that alike, all or ``within`` one value of a column.

    Each row joins on its rarest tokens only: of two sets with a Jaccard similarity of
    at least ``least``, the rarest ceil((1 - least) * n) + 1 tokens of each share one, by
    a common order of tokens, so frequent tokens produce no pairs.
    """
    group = F.col(within) if within else F.lit(0)
    sets = claims.select(F.col(key).alias("id"), group.alias("g"), claim_tokens(F.col(text)).alias("tokens")).filter(F.size("tokens") > 0)
    each = sets.select("id", "g", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rarity = each.groupBy("g", "token").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, ["g", "token"]).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "token")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "g", "n", "token")
    a, b = prefix.alias("a"), prefix.alias("b")
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id")) & sizes).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    x, y = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= least)


def clusters(claims: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, cluster): the smallest key that pairs reach, however long the chain."""
    found = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), Scratch(claims.sparkSession, "clusters"), "round").withColumnRenamed("id", key)
    return claims.select(key).join(found, key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def cluster_claims(claims: DataFrame, key: str, text: str, least: float = LIKE, within: str | None = None) -> DataFrame:
    """(key, cluster) of claims by likeness, all or within one value of a column.

    Claims of the same tokens are one by a plain aggregation, so that many copies cost a
    row each; only one of them meets the others.
    """
    spark = claims.sparkSession
    tokens = F.array_sort(claim_tokens(F.col(text)))
    rows = claims.select(key, *([within] if within else []), text, F.sha2(F.to_json(F.struct(tokens, *([within] if within else []))), 256).alias("_same"), (F.size(tokens) == 0).alias("_none"))
    rows = Scratch(spark, "claims").table(rows, "rows")
    first = rows.filter("NOT _none").groupBy("_same").agg(F.min(key).alias("_rep"))
    reps = rows.join(first.select(F.col("_rep").alias(key)), key, "left_semi")
    found = clusters(first.select(F.col("_rep").alias(key)), key, like_pairs(reps, key, text, least, within)).withColumnsRenamed({key: "_rep"})
    same = rows.filter("NOT _none").select(key, "_same").join(first, "_same").join(found, "_rep").select(key, "cluster")
    return same.unionByName(rows.filter("_none").select(key, F.col(key).alias("cluster")))


def corroborated(members: DataFrame, cluster: str, host_column: str) -> DataFrame:
    """(cluster, size, hosts, verified): verified if two hosts or more say it."""
    return members.groupBy(cluster).agg(F.count("*").alias("size"), F.count_distinct(host_column).alias("hosts")).withColumn("verified", F.col("hosts") >= 2)


def clustered(findings: DataFrame, key: str, least: float = LIKE) -> DataFrame:
    """Parsed claims with their cluster, how many hosts stand behind it, and whether those are two or more (``verified``)."""
    spark = findings.sparkSession
    rows = findings.withColumn("claim_id", F.concat_ws(":", F.col(key).cast("string"), F.lpad(F.col("line").cast("string"), 12, "0")))
    rows = Scratch(spark, "findings").table(rows, "claims")
    rows = rows.join(cluster_claims(rows, "claim_id", "claim", least, key), "claim_id")
    hosts = rows.select("cluster", F.explode("hosts").alias("h")).groupBy("cluster").agg(F.count_distinct("h").alias("cluster_hosts"))
    return rows.join(hosts, "cluster", "left").withColumn("cluster_hosts", F.coalesce("cluster_hosts", F.lit(0))).withColumn("verified", F.col("cluster_hosts") >= 2)


def coverage(claims: DataFrame, key: str) -> DataFrame:
    """Of each document's clustered claims: how many there are, of one source, without address; hosts; clusters of several hosts and of fewer.

    A claim has a single source if fewer than two hosts stand behind its cluster.
    """
    hosts = claims.select(key, F.explode("hosts").alias("h")).groupBy(key).agg(F.count_distinct("h").alias("distinct_hosts"))
    out = claims.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(~F.col("verified")).alias("single_source"), F.count_if(F.size("urls") == 0).alias("no_url"),
        F.count_distinct(F.when(F.col("verified"), F.col("cluster"))).alias("corroborated"), F.count_distinct(F.when(~F.col("verified"), F.col("cluster"))).alias("unverified"),
    )
    return out.join(hosts, key, "left").withColumn("distinct_hosts", F.coalesce("distinct_hosts", F.lit(0)))


def notes() -> Column:
    """What to say about a document's coverage, as codes, from the columns of ``coverage``."""
    c = F.col
    said = [(c("no_url") > 0, "no_url"), (c("single_source") > 0, "single_source"), ((c("total") > 0) & (c("unverified") > 0), "unverified"), ((c("total") > 0) & (c("distinct_hosts") <= 2), "few_hosts"), (c("total") == 0, "nothing_found")]
    return F.filter(F.array(*(F.when(test, name) for test, name in said)), lambda v: v.isNotNull())


def channel_matches(plan: dict, name: Column, heading: Column) -> Column:
    """Whether a section covers a channel of a plan {kind, platform, timeRange}: narrowly, so that no channel stands in for another."""
    holds = lambda x, words, low=(): F.greatest(F.lit(False), *(F.contains(x, F.lit(w)) for w in words), *(F.contains(F.lower(x), F.lit(w)) for w in low))
    key = re.sub("（[^）]*）", "", plan["kind"]).strip()
    rule = next((r for r in COVERS if r[0] in key), COVERS[2] if key == OFFICIAL else (key, [key], []))
    found = holds(name, rule[1], rule[2])
    if rule[0] == MEDIA and plan.get("timeRange") != "month":
        found = found & ~F.contains(name, F.lit(LOOKED_BACK))
    if plan.get("platform"):
        low = [plan["platform"].lower()]
        found = holds(name, [], low) | holds(F.coalesce(heading, F.lit("")), [], low) | found
    return F.coalesce((name != "") & (name != UNGROUPED) & found, F.lit(False))


def covered_channels(findings: DataFrame, key: str, plan: list[dict]) -> DataFrame:
    """(key, covered, missing): channels of a plan that a document's sections cover, and required ones that none does.

    The plan is a short list given by the caller, so it is tested inside one aggregation.
    """
    label = lambda p: f"{p['kind']}（{p['platform']}）" if p.get("platform") else p["kind"]
    hits = findings.groupBy(key).agg(*(F.coalesce(F.bool_or(channel_matches(p, F.col("channel"), F.col("heading"))), F.lit(False)).alias(f"_{k}") for k, p in enumerate(plan)))
    some = lambda test: F.filter(F.array(*(F.when(test(F.col(f"_{k}"), p), F.lit(label(p))) for k, p in enumerate(plan))), lambda v: v.isNotNull())
    return hits.select(key, some(lambda hit, p: hit).alias("covered"), some(lambda hit, p: ~hit & F.lit(bool(p.get("required")))).alias("missing"))
