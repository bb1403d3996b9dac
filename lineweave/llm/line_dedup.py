"""Line dedup: lines that too large a share of a host's pages repeat are dropped.

A line's frequency is relative to its site: the pages of the host that hold it, over all pages of the host. A host has
at most (mean lines of a page) / ratio such lines, whatever its number of pages, so what is carried back to the
pages is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import BROADCAST_ROWS, cut, shuffle_partitions, text_or_empty

RATIO, MIN_PAGES = 0.05, 10
SALTS = 64


def host_of(url: str | Column) -> Column:
    """The host of a URL, lower-cased, without user, port and a leading www."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line): hashes of the trimmed lines on more than ``ratio`` of a host's pages, and on ``min_pages`` at least."""
    pages = df.select(host.alias("host"), text.alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    joined = counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return joined.filter(F.col("n") > ratio * F.col("total")).select("host", "line")


def drop_boilerplate(df: DataFrame, host: str | Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df's columns with the text cleaned, and then n_lines and n_dropped (long), one row per row of df.

    A line counts once a page, trimmed; blank lines are never dropped. A null text counts as empty and becomes empty;
    a null host is a host of its own; repeated rows are pages of their own. Ratios at the limit stay. An empty table
    gives no row. df must not have columns called n_lines, n_dropped or starting with _ln.

    The lines to drop go back to the pages by broadcast if they are few, which is counted; else by a join on host
    and salt that spreads a hot host over many tasks.
    """
    host = F.col(host) if isinstance(host, str) else host
    text = text_or_empty(text_col)
    bad = cut(boilerplate(df, host, text, ratio, min_pages), "boilerplate")
    lists = bad.groupBy(F.col("host").alias("_ln_of")).agg(F.collect_set("line").alias("_ln_bad"))
    pages = df.withColumns({"_ln_host": host, "_ln_text": text})
    if bad.count() <= BROADCAST_ROWS:
        joined = pages.join(F.broadcast(lists), F.col("_ln_host").eqNullSafe(F.col("_ln_of")), "left")
    else:
        salted = lists.withColumn("_ln_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn("_ln_own", F.pmod(F.xxhash64("_ln_text"), F.lit(SALTS)).cast("int"))
        joined = pages.repartition(shuffle_partitions(df.sparkSession), "_ln_host", "_ln_own").join(salted, F.col("_ln_host").eqNullSafe(F.col("_ln_of")) & (F.col("_ln_own") == F.col("_ln_salt")), "left")
    every = _lines(F.col("_ln_text"))
    keep = F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_ln_bad"), _key(x)))
    split = joined.withColumn("_ln_kept", F.when(F.col("_ln_bad").isNotNull(), keep))
    n = F.size(every).cast("long")
    kept = F.col("_ln_kept")
    columns = [F.when(kept.isNull(), F.col("_ln_text")).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return split.select(*columns, n.alias("n_lines"), F.when(kept.isNull(), 0).otherwise(n - F.size(kept)).cast("long").alias("n_dropped"))
