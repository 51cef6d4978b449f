"""Recall from layered stores: windows, scores, quality tiers and budgets, in closed form over windows."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

DAY = dt.timedelta(days=1)
_MS = dt.timedelta(milliseconds=1)


def resolve_time(word: str, now: dt.datetime, end: bool = False) -> dt.datetime:
    """The instant that a word means at one edge of a window: the first or, for ``end``, the last millisecond of its span.

    Weeks begin on Monday.  "last N days" counts today as one of them.  Anything else is
    read as ISO text, a bare date meaning its first or last millisecond.
    """
    text, today = word.strip().lower(), now.replace(hour=0, minute=0, second=0, microsecond=0)
    week, month = today - DAY * today.weekday(), today.replace(day=1)
    before = (month - DAY).replace(day=1)
    year = month.replace(month=1)
    spans = {
        "today": (today, today + DAY), "今天": (today, today + DAY),
        "yesterday": (today - DAY, today), "昨天": (today - DAY, today),
        "this week": (week, week + 7 * DAY), "本周": (week, week + 7 * DAY),
        "last week": (week - 7 * DAY, week), "上周": (week - 7 * DAY, week),
        "this month": (month, (month + 32 * DAY).replace(day=1)), "本月": (month, (month + 32 * DAY).replace(day=1)),
        "last month": (before, month), "上个月": (before, month),
        "this year": (year, year.replace(year=year.year + 1)), "今年": (year, year.replace(year=year.year + 1)),
        "last year": (year.replace(year=year.year - 1), year), "去年": (year.replace(year=year.year - 1), year),
    }
    if text == "now":
        return now
    if text in spans:
        return spans[text][1] - _MS if end else spans[text][0]
    if m := re.fullmatch(r"(?:last|past)\s+(\d+)\s+(day|hour|month)s?", text):
        n, unit = int(m[1]), m[2]
        if end:
            return now
        if unit == "hour":
            return now - dt.timedelta(hours=n)
        if unit == "day":
            return today - DAY * (n - 1)
        months = now.year * 12 + now.month - 1 - n
        return now.replace(year=months // 12, month=months % 12 + 1, day=min(now.day, 28))
    try:
        at = dt.datetime.fromisoformat(text.upper().replace("Z", ""))
    except ValueError:
        raise ValueError(f"no such time: {word}") from None
    return at + DAY - _MS if end and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else at


def resolve_window(since: str | None, until: str | None, now: dt.datetime) -> tuple[dt.datetime | None, dt.datetime | None]:
    a, b = since and resolve_time(since, now), until and resolve_time(until, now, end=True)
    if a and b and a > b:
        raise ValueError("the window ends before it begins")
    return a or None, b or None


def in_window(at: Column, since: dt.datetime | None, until: dt.datetime | None) -> Column:
    """Both ends included."""
    out = at.isNotNull()
    if since is not None:
        out = out & (at >= F.lit(since))
    if until is not None:
        out = out & (at <= F.lit(until))
    return out


def window_counts(df: DataFrame, at: str, since, until) -> DataFrame:
    """Rows within, rows outside and rows without a time, counted apart."""
    inside = in_window(F.col(at), since, until)
    return df.agg(F.count_if(inside).alias("inside"), F.count_if(F.col(at).isNotNull() & ~inside).alias("outside"), F.count_if(F.col(at).isNull()).alias("unstamped"))


def first_stamp(*columns: str) -> Column:
    """The first of several times that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def recency(at: Column, now: dt.datetime, base: float = 0.995) -> Column:
    """base ** days since; 0 without a time.  Orders rows, and never leaves any out."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 864e8)
    return F.coalesce(F.pow(F.lit(base), days), F.lit(0.0))


def quality_tiers(df: DataFrame, by: list[str], order: list[Column], score: str, term_count: int, limit: int, high: float = 0.6, low: float = 0.25, medium: int = 6, unknown: int = 4, pool: int = 5) -> DataFrame:
    """Candidates that stay: of the first limit * pool, all of high relevance, and quotas of the rest, up to the limit.

    A row's tier rank is its number within its tier, and a row that its quota turns away
    uses up nothing, so the sequential rule has this closed form.
    """
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    ranked = df.withColumn("_pool", F.row_number().over(w)).filter(F.col("_pool") <= limit * pool)
    relevance = F.col(score) / term_count
    ranked = ranked.withColumn("tier", F.when(relevance >= high, "high").when(relevance >= low, "medium").otherwise("unknown"))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "tier").orderBy("_pool")))
    kept = ranked.filter((F.col("tier") == "high") | (F.col("_rank") <= F.when(F.col("tier") == "medium", medium).otherwise(unknown)))
    w2 = Window.partitionBy(*by).orderBy("_pool") if by else Window.orderBy("_pool")
    return kept.withColumn("place", F.row_number().over(w2)).filter(F.col("place") <= limit).drop("_pool", "_rank")


def admit(df: DataFrame, by: list[str], order: list[Column], text: str, most_results: int, item_chars: int, total_chars: int) -> DataFrame:
    """Rows within a budget of characters: repeats (up to white space) left out, each text cut, the last to what remains.

    ``order`` tells rows of a group apart.  The first of each text and then the first
    ``most_results`` of a group are picked under a limit that Spark applies before it
    shuffles, so a group of any size comes down to a few rows; and what is carried there is
    the text's beginning, unless the caller selects the text itself.
    """
    digest = F.sha1(squeeze(F.col(text)))
    rows = df.filter(F.length(text) > 0).withColumns({"_digest": digest, "_chars": F.length(text), "_head": F.substring(text, 1, item_chars)})
    first = Window.partitionBy(*by, "_digest").orderBy(*order)
    rows = rows.withColumn("_seen", F.row_number().over(first)).filter("_seen = 1")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most_results)
    so_far = F.sum(F.least("_chars", F.lit(item_chars))).over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_used", F.coalesce(so_far, F.lit(0))).filter(F.col("_used") < total_chars)
    room = F.least(F.lit(item_chars), F.lit(total_chars) - F.col("_used")).cast("int")
    cut = F.when(F.col("_chars") > room, F.concat(F.substring(F.col("_head"), F.lit(1), room - 1), F.lit("…"))).otherwise(F.col("_head"))
    return rows.withColumn("admitted", cut).withColumn("truncated", F.col("_chars") > room).drop("_digest", "_chars", "_head", "_seen", "_used")
