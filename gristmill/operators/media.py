"""Time plans for media: overlapping chunks, frame times, word times, transcripts, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_chunks(df: DataFrame, key: str, seconds: str, size: float, overlap: float) -> DataFrame:
    """(key, index, start, end, owned_end): [start, owned_end) every ``size`` seconds, read ``overlap`` further."""
    n = F.greatest(F.ceil(F.col(seconds) / size), F.lit(1)).cast("int")
    rows = df.filter(F.col(seconds) > 0).select(key, seconds, F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    start = F.col("index") * float(size)
    return rows.select(key, "index", start.alias("start"), F.least(start + size + overlap, F.col(seconds)).alias("end"), F.least(start + size, F.col(seconds)).alias("owned_end"))


def frame_times(duration: Column, every: float | None = None, count: int | None = None, at: list[float] | None = None) -> Column:
    """Sorted distinct instants within the duration: given ones, one every so many seconds, or ``count`` in the middles of equal parts."""
    if at is not None:
        times = F.filter(F.array(*(F.lit(float(t)) for t in at)), lambda t: t >= 0)
    elif every is not None:
        times = F.transform(F.sequence(F.lit(0), F.floor(duration / every).cast("int")), lambda k: k * float(every))
    else:
        times = F.transform(F.sequence(F.lit(0), F.lit(int(count or 1) - 1)), lambda k: duration * (k + 0.5) / float(count or 1))
    return F.array_sort(F.array_distinct(F.transform(times, lambda t: F.floor(t * 1000 + 0.5) / 1000)))


def join_transcript(parts: Column) -> Column:
    """Parts with a space between, unless either side of the seam is CJK.  Each seam looks at its two parts only."""
    cjk = r"[⺀-鿿豈-﫿＀-￯]"
    some = F.filter(parts, lambda p: p != "")
    seam = lambda p, k: F.when((k == 0) | p.rlike("^" + cjk) | F.get(some, k - 1).rlike(cjk + "$"), p).otherwise(F.concat(F.lit(" "), p))
    return F.array_join(F.transform(some, seam), "")


def word_times(tokens: Column, stamps: Column, length: Column, base: Column) -> Column:
    """Words with start and end from tokens and their stamps: punctuation joins the word before it, ends are the next start, all within the length."""
    each = F.arrays_zip(tokens.alias("t"), stamps.alias("s"))
    punct = r"^[\p{Punct}。，、；：？！…]+$"
    word = lambda text, s: F.struct(text.alias("text"), F.least(s, length).alias("start"))
    glue = F.aggregate(
        each, F.array().cast("array<struct<text:string,start:double>>"),
        lambda a, x: F.when(x["t"].rlike(punct) & (F.size(a) > 0), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.concat(F.element_at(a, -1)["text"], x["t"]).alias("text"), F.element_at(a, -1)["start"].alias("start"))))).otherwise(F.concat(a, F.array(word(x["t"], x["s"])))),
    )
    end = lambda k: F.coalesce(F.get(glue, k + 1)["start"], length)
    return F.transform(glue, lambda w, k: F.struct(w["text"].alias("text"), F.round(w["start"] + base, 3).alias("start"), F.round(end(k) + base, 3).alias("end")))


def owned_segments(df: DataFrame, media: str, chunk: str, start: str, end: str, owned_end: str, last: Column) -> DataFrame:
    """Segments of each chunk of a recording that it owns: those that end within its own part, all of the last chunk's; of one heard twice the earlier chunk's stays."""
    own = df.filter(last | (F.col(end) <= F.col(owned_end)))
    said = F.max(end).over(Window.partitionBy(media).orderBy(chunk, start).rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("_said", said).filter(F.col("_said").isNull() | (F.col(start) >= F.col("_said"))).drop("_said")


def turn_of(df: DataFrame, session: str, order: str, is_start: Column, turn: str) -> DataFrame:
    """Adds ``turn_id``: the latest turn that started at or before a row of its session."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("turn_id", F.last(F.when(is_start, F.col(turn)), ignorenulls=True).over(w))


def quota(df: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """Adds ``allowed``: the first so many of each group; a limit of 0 or less means no limit."""
    if limit <= 0:
        return df.withColumn("allowed", F.lit(True))
    return df.withColumn("allowed", F.row_number().over(Window.partitionBy(*by).orderBy(order)) <= limit)


def quota_used(df: DataFrame, by: list[str], order: str, refund: Column, limit: int) -> DataFrame:
    """Adds ``allowed``: whether fewer than so many were used before a row of its group, a refund giving one back; 0 or less means no limit."""
    if limit <= 0:
        return df.withColumn("allowed", F.lit(True))
    before = F.sum(F.when(refund, -1).otherwise(1)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("allowed", F.coalesce(before, F.lit(0)) < limit)


def changes(df: DataFrame, by: list[str], order: str, revision: str, refresh: int = 12) -> DataFrame:
    """Adds ``emit``: full at first and on every refresh, partial where the revision moved, else unchanged."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.row_number().over(w)
    return df.withColumn("emit", F.when((n - 1) % refresh == 0, "full").when(F.lag(revision).over(w) != F.col(revision), "partial").otherwise("unchanged"))
