"""Statistics over tables of typed cells."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Names under which statistics can be asked for.  (Fixed values.)
STAT_NAMES = {
    "count": "count", "计数": "count",
    "counta": "counta", "非空计数": "counta",
    "sum": "sum", "total": "sum", "求和": "sum",
    "average": "average", "avg": "average", "mean": "average", "平均值": "average", "均值": "average",
    "median": "median", "中位数": "median",
    "max": "max", "maximum": "max", "最大值": "max",
    "min": "min", "minimum": "min", "最小值": "min",
    "stdev": "stdev", "stddev": "stdev", "std": "stdev", "标准差": "stdev",
    "var": "var", "variance": "var", "方差": "var",
    "product": "product", "乘积": "product",
}
SUMMARY_STATS = ("sum", "count", "average")


def stat_names(asked: list[str]) -> list[str]:
    """Known statistics among those asked for; each unknown one is warned of and left out."""
    out = []
    for name in asked:
        known = STAT_NAMES.get(name.strip().lower())
        if known is None:
            warnings.warn(f"no such statistic: {name}", stacklevel=2)
        elif known not in out:
            out.append(known)
    return out


def statistic(name: str, number: Column, shown: Column | None = None) -> Column:
    filled = number.isNotNull() if shown is None else shown.isNotNull() & (trimmed(shown) != "")
    return {
        "count": lambda: F.count(number),
        "counta": lambda: F.count_if(filled),
        "sum": lambda: F.sum(number),
        "average": lambda: F.avg(number),
        "median": lambda: F.median(number),
        "max": lambda: F.max(number),
        "min": lambda: F.min(number),
        "stdev": lambda: F.stddev_samp(number),
        "var": lambda: F.var_samp(number),
        "product": lambda: F.product(number),
    }[name]()


def column_stats(df: DataFrame, column: str, stats: list[str], by: list[str] | None = None, shown: str | None = None) -> DataFrame:
    """The statistics of one column; every one of them is blank if the range holds no number."""
    number = F.col(column).cast("double")
    some = F.count(number) > 0
    aggregates = [F.when(some, statistic(s, number, F.col(shown) if shown else None)).alias(s) for s in stat_names(stats)]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def group_summary(df: DataFrame, key: str, value: str, stats: list[str] = list(SUMMARY_STATS), total: str | None = "Total", order: str | None = None) -> DataFrame:
    """One row for each trimmed, displayed key, then a total.

    Rows with a blank key are in no group but in the total, so the total is an
    aggregate of its own and not a rollup.  ``n_rows`` counts rows, ``count`` numeric
    cells.  ``position`` orders groups by first appearance if ``order`` names a column.
    """
    shown, number = trimmed(F.col(key).cast("string")), F.col(value).cast("double")
    wanted = [s for s in stat_names(stats) if s in SUMMARY_STATS]
    aggregates = [statistic(s, number).alias(s) for s in wanted]
    first = F.min(order).cast("long") if order else F.lit(None).cast("long")
    groups = df.select("*", shown.alias("_key")).filter("_key <> ''").groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("n_rows"), *aggregates, first.alias("position"))
    if total is None:
        return groups
    every = df.agg(F.count("*").alias("n_rows"), *aggregates).select(F.lit(total).alias("key"), "n_rows", *wanted, F.lit(None).cast("long").alias("position"))
    return groups.unionByName(every)


def blank_keys(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_if(F.col(key).isNull() | (trimmed(F.col(key).cast("string")) == "")).alias("blank_keys"))


def with_total_row(df: DataFrame, label: str, numeric: list[str], text: str = "Total") -> DataFrame:
    """The table with a last row of sums; other columns are blank there."""
    sums = df.agg(*(F.sum(c).alias(c) for c in numeric))
    row = sums.select(*(F.col(c).cast(t) if c in numeric else F.lit(text if c == label else None).cast(t).alias(c) for c, t in df.dtypes))
    return df.unionByName(row)


def pivot_series(df: DataFrame, category: str, series: str, value: str, names: list[str]) -> DataFrame:
    """Categories by series, as a chart takes them; the series are named so that no pass over the data looks for them."""
    return df.groupBy(F.col(category).alias("category")).pivot(series, names).agg(F.sum(value))


def uneven_series(df: DataFrame, category: str, series: str) -> DataFrame:
    """Series that lack some category; charts refuse those."""
    n = df.select(category).distinct().agg(F.count("*").alias("n"))
    return df.groupBy(F.col(series).alias("series")).agg(F.count_distinct(category).alias("have")).crossJoin(F.broadcast(n)).filter("have <> n")


def fit_width(cells: Column, width: int) -> Column:
    """Rows of cells padded with empty text, or cut, to a width."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)

