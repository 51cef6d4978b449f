"""Upkeep of record stores: retention, volumes, upserts, deletions, liveness.  Plain DataFrames in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: list[str], order: list[Column], n: int, keep: bool = True) -> DataFrame:
    """The last n rows of each group or, not ``keep``, those that roll over into the archive."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n if keep else F.col("_r") > n).drop("_r")


def pack_volumes(blocks: DataFrame, month: str, order: str, size: str, most: int = 200) -> DataFrame:
    """Adds ``volume``: blocks of a month in order, a new volume where the items would exceed the limit; a larger block stands alone.

    The rule is sequential within a month, so what meets in one task is a month's sizes,
    two numbers a block; ``order`` tells the blocks of a month apart.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        volume, held, out = 1, 0, []
        for n in rows[size]:
            if held and held + n > most:
                volume, held = volume + 1, 0
            held += n
            out.append(volume)
        return rows.assign(volume=pd.Series(out, index=rows.index, dtype="int32"))[[month, order, "volume"]]

    narrow = blocks.select(month, order, size)
    kinds = dict(narrow.dtypes)
    packed = narrow.groupBy(month).applyInPandas(pack, f"{month} {kinds[month]}, {order} {kinds[order]}, volume int")
    return blocks.join(packed, [month, order])


def prune(df: DataFrame, at: str, size: str, key: str, oldest: Column, most: int) -> DataFrame:
    """What a cache keeps: entries not older than a time and, newest first, ties by ``key``, while their sizes fit.

    Sums run within a day, on top of the sums of all later days, which are few rows; so
    no task holds all entries.
    """
    young = df.filter(F.col(at) >= oldest).withColumn("_day", F.to_date(at))
    days = young.groupBy("_day").agg(F.sum(size).alias("_n"))
    later = days.select("_day", (F.sum("_n").over(Window.orderBy(F.col("_day").desc())) - F.col("_n")).alias("_later"))  # a row for each day
    within = F.sum(size).over(Window.partitionBy("_day").orderBy(F.col(at).desc(), key).rowsBetween(Window.unboundedPreceding, 0))
    return young.join(later, "_day").withColumn("_total", F.col("_later") + within).filter(F.col("_total") <= most).drop("_day", "_later", "_total")


def keep_volumes(volumes: DataFrame, most: int) -> DataFrame:
    """The last so many volumes by (month, volume), with all their rows."""
    last = volumes.select("month", "volume").distinct().orderBy(F.col("month").desc(), F.col("volume").desc()).limit(most)
    return volumes.join(last, ["month", "volume"], "left_semi")


def demote(df: DataFrame, by: list[str], at: str, size: str, most: int, hard: int, importance: str = "importance") -> DataFrame:
    """Adds ``evicted``: low rows, then normal ones, oldest first, go until the rest of the group fits; critical ones only while it is still over the hard limit."""
    rank = F.array_position(F.array(*map(F.lit, ("low", "normal", "critical"))), F.col(importance))
    order = Window.partitionBy(*by).orderBy(rank, at)
    gone = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(size).over(Window.partitionBy(*by)) - gone
    return df.withColumn("evicted", F.when(F.col(importance) == "critical", left > hard).otherwise(left > most))


def evict(df: DataFrame, by: list[str], rank: Column, at: str, size: str, most: int) -> DataFrame:
    """Adds ``evicted``: rows go in the order of rank, oldest first, until the rest of the group fits."""
    order = Window.partitionBy(*by).orderBy(rank, at)
    gone = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(Window.partitionBy(*by))
    return df.withColumn("evicted", total - gone > most)


def _matches(df: DataFrame, wanted: str, old: str) -> Column:
    return F.col("id") == wanted if wanted else F.contains(F.col("content"), F.lit(old))


def the_one(df: DataFrame, wanted: str = "", old: str = "") -> str:
    """The id of the only entry with an id, or whose content holds a text; an error if there is none or more than one."""
    if not wanted and not old:
        raise ValueError("an id or a text must say which entry is meant")
    found = [r["id"] for r in df.filter(_matches(df, wanted, old)).select("id").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no entry' if not found else 'several entries'} for {wanted or old!r}")
    return found[0]


def add_entry(df: DataFrame, entry: dict, limit: int) -> DataFrame:
    """The entries and one more, whose content must be there and fit the limit in bytes."""
    text = (entry.get("content") or "").strip()
    if not text or len(text.encode()) > limit:
        raise ValueError("an entry needs content of at most the limit")
    return df.unionByName(df.sparkSession.createDataFrame([{c: entry.get(c) for c in df.columns}], df.schema))


def replace_entry(df: DataFrame, changes: dict, wanted: str = "", old: str = "") -> DataFrame:
    """The entries with some columns of the only one meant replaced."""
    hit = F.col("id") == the_one(df, wanted, old)
    return df.select(*((F.when(hit, F.lit(changes[c])).otherwise(F.col(c)).cast(t).alias(c) if c in changes else F.col(c)) for c, t in df.dtypes))


def remove_entry(df: DataFrame, edges: DataFrame, wanted: str = "", old: str = "") -> dict[str, DataFrame]:
    """``entries`` without the only one meant, ``edges`` that do not touch it, and its ``tombstone``."""
    gone = the_one(df, wanted, old)
    return {"entries": df.filter(F.col("id") != gone), "edges": edges.filter((F.col("src") != gone) & (F.col("dst") != gone)), "tombstone": df.filter(F.col("id") == gone).select("id", F.lit("remove").alias("reason"))}


def upsert(table: DataFrame, changes: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Rows of ``changes`` replace the named columns where the key exists and are added where it does not."""
    t, c = table.alias("t"), changes.withColumn("_changed", F.lit(True)).alias("c")
    joined = t.join(c, [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key], "full")
    old = F.col("c._changed").isNull()
    none = F.coalesce(*(F.col(f"t.{k}").cast("string") for k in key)).isNull()
    pick = lambda x: F.when(old, F.col(f"t.{x}")).when(none, F.col(f"c.{x}")).otherwise(F.col(f"c.{x}") if x in update else F.col(f"t.{x}"))
    return joined.select(*(pick(x).alias(x) for x in table.columns))


def without(df: DataFrame, dead: DataFrame, column: str, dead_id: str = "id") -> DataFrame:
    """Rows whose id is not dead."""
    return df.join(dead.select(F.col(dead_id).alias(column)).distinct(), column, "left_anti")


def append_new(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The table with those rows of ``more`` whose key is new; of several the first stays."""
    return df.unionByName(more.dropDuplicates([key]).join(df.select(key), key, "left_anti"))


def dead_among(candidates: DataFrame, *live: DataFrame) -> DataFrame:
    """Ids of ``candidates`` in none of the live sets."""
    every = live[0]
    for other in live[1:]:
        every = every.unionByName(other)
    return candidates.select("id").distinct().join(every.select("id"), "id", "left_anti")


def block_id(items: Column) -> Column:
    """sha1 of the items' canonical form: fields in a fixed order, rows sorted."""
    return F.sha1(F.to_json(F.array_sort(items)))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table, whatever the order of its rows.

    Rows are reduced to their hashes' sum and exclusive or before anything is gathered,
    so the size of the table does not matter.
    """
    row = F.sha1(F.to_json(F.struct(*columns)))
    part = lambda k: F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.sha1(F.concat_ws(":", F.count("*").cast("string"), *(F.sum(part(k)).cast("string") for k in range(3)))).alias("fingerprint"))


def greedy_fill(lines: DataFrame, by: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Adds ``shown``: lines in order, each that still fits, passing over those that do not (so not a prefix).

    A fold over each group's line sizes; the groups are digests, whose lines are few.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.octet_length(text).cast("long").alias("n"))))
    step = lambda a, r: F.when(a["used"] + r["n"] <= budget, F.struct((a["used"] + r["n"]).alias("used"), F.concat(a["kept"], F.array(r["o"])).alias("kept"))).otherwise(a)
    kind = dict(lines.dtypes)[order]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))
    kept = lines.groupBy(*by).agg(F.aggregate(rows, start, step)["kept"].alias("_kept"))
    return lines.join(kept, by).withColumn("shown", F.array_contains("_kept", F.col(order))).drop("_kept")



def mentions(df: DataFrame, name: str, ref: str, n_refs: int = 6, most: int = 12) -> DataFrame:
    """(name, mentions, refs): the names with most mentions, each with its first references.

    References are first reduced to the smallest few of every part of the table, so a name
    that a third of all rows mention is not sorted in one task.
    """
    parted = df.select(F.col(name).alias("name"), F.col(ref).alias("ref"), F.pmod(F.xxhash64(ref), F.lit(64)).alias("_part"))
    few = parted.withColumn("_r", F.row_number().over(Window.partitionBy("name", "_part").orderBy("ref"))).filter(F.col("_r") <= n_refs)
    refs = few.groupBy("name").agg(F.slice(F.array_sort(F.collect_list("ref")), 1, n_refs).alias("refs"))  # 64 times n_refs at most
    return df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("mentions")).orderBy(F.col("mentions").desc(), "name").limit(most).join(refs, "name").orderBy(F.col("mentions").desc(), "name")


def usage(df: DataFrame, target: str, text: str, delimiter_bytes: int = 4) -> DataFrame:
    """(target, entries, bytes): entries of each target and what they take with a delimiter each."""
    return df.groupBy(target).agg(F.count("*").alias("entries"), F.sum(F.octet_length(text) + delimiter_bytes).alias("bytes"))


def shared_fill(lines: DataFrame, by: list[str], layer: str, layers: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Adds ``shown``, as ``greedy_fill`` does, with one budget for all layers of a group: what the first leaves is the next one's."""
    place = F.struct(F.array_position(F.array(*map(F.lit, layers)), F.col(layer)).alias("layer"), F.col(order).alias("at"))
    return greedy_fill(lines.withColumn("_place", place), by, "_place", text, budget).drop("_place")
