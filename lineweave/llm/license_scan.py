"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment decides.

A window is WINDOW consecutive word 5-grams, one from every STEP-th on; templates give a window at every place. A band
is one minimum hash, so two windows of Jaccard j meet in one of BANDS bands with probability 1 - (1 - j)^BANDS. Where a
text holds a template's wording, whole windows are equal (j = 1); even a template of a single 5-gram is half of two
windows (j = 1/2 each), and both miss it once in 65 000 times. Then the template's distinct 5-grams that the text
holds are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import cut, text_or_empty

SHINGLE, WINDOW, STEP, BANDS = 5, 2, 1, 8
CONTAINED = 0.8

#: The wording of common license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column, short: tuple[str, ...] | None = None) -> Column:
    """Hashes of the word 5-grams of a text, in order, and of each line of one to four words as a whole; or, with short
    (wordings of one to four words), of those of them that stand anywhere in the text."""
    grams = lambda ws: F.transform(F.when(F.size(ws) >= SHINGLE, F.sequence(F.lit(0), F.size(ws) - SHINGLE)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(SHINGLE))))
    if short is not None:
        held = lambda said: F.array_compact(F.array(*(F.when(F.contains(said, F.lit(f" {x} ")), F.xxhash64(F.lit("short"), F.lit(x))) for x in short)).cast("array<bigint>"))
        return _once(_words(text), lambda ws: F.concat(grams(ws), _once(F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" ")), held)))
    own = F.transform(F.filter(F.split(text, "\n"), lambda x: F.char_length(x) <= 100), _words)
    lines = F.transform(F.filter(own, lambda ws: (F.size(ws) > 0) & (F.size(ws) < SHINGLE)), lambda ws: F.xxhash64(F.lit("line"), F.array_join(ws, " ")))
    return F.concat(_once(_words(text), grams), lines)


def short_wordings(spark: SparkSession, templates: dict[str, str]) -> tuple[str, ...]:
    """The words of the templates of one to four words; as many as the templates, whatever the corpus."""
    words = spark.createDataFrame([(t,) for t in templates.values()], "text string").select(_words(F.col("text")).alias("ws"))
    return tuple(sorted({" ".join(r["ws"]) for r in words.filter(F.size("ws").between(1, SHINGLE - 1)).collect()}))


def windows(hashes: Column, step: int) -> Column:
    places = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(*(F.get(hashes, i + k).alias(f"h{k}") for k in range(WINDOW))))


def bands(name: str) -> list[Column]:
    """The minimum hashes of a window struct, one a band; places beyond the text's end count for nothing."""
    value = lambda k, i: F.when(F.col(f"{name}.h{k}").isNotNull(), F.xxhash64(F.col(f"{name}.h{k}"), F.lit(i)))
    return [F.least(*(value(k, i) for k in range(WINDOW))).alias(f"b{i}") for i in range(BANDS)]


def template_tables(spark: SparkSession, templates: dict[str, str], short: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(license, shingle, size) and (license, band, value); as large as the templates, whatever the corpus."""
    given = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    own = shingles(F.col("text"), short)
    if short is not None:  # a longer template is told by its 5-grams, whatever short ones it holds
        n = F.size(_words(F.col("text")))
        own = F.when(n < SHINGLE, F.array(F.xxhash64(F.lit("short"), F.array_join(_words(F.col("text")), " ")))).otherwise(F.slice(own, 1, F.greatest(n - SHINGLE + 1, F.lit(0))))
    hashed = given.select("license", own.alias("hashes"))
    grams = hashed.select("license", F.size(F.array_distinct("hashes")).alias("size"), F.explode(F.array_distinct("hashes")).alias("shingle"))
    seen = hashed.select("license", F.explode(windows(F.col("hashes"), 1)).alias("w")).select("license", *bands("w"))
    listed = seen.select("license", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("value")) for i in range(BANDS)))).alias("x"))
    return grams, listed.select("license", "x.band", "x.value").distinct()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, contained: float = CONTAINED, short_anywhere: bool = False) -> DataFrame:
    """One row per row of df: (id, licenses, n_licenses): the names of the templates that it holds to ``contained`` of
    their distinct 5-grams, sorted and joined by commas, and how many.

    A template of fewer than five words is found as a line of its own, or with ``short_anywhere`` at any place: in a longer
    line or a running text too. A null text is empty and holds none; repeated
    rows are scanned alike; an empty table gives no row; other columns aren't read.
    """
    spark = df.sparkSession
    given = TEMPLATES if templates is None else templates
    short = short_wordings(spark, given) if short_anywhere else None
    grams, banded = template_tables(spark, given, short)
    grams, banded = cut(grams, "templates"), cut(banded, "bands")
    by_band: list[list[int]] = [[] for _ in range(BANDS)]
    for r in banded.select("band", "value").collect():  # of the templates only
        by_band[r["band"]].append(r["value"])
    text = text_or_empty(text_col)
    keyed = df.select(F.col(id_col), F.xxhash64(F.col(id_col), text).alias("row_key"), text.alias("own_text"))
    hashed = keyed.select("row_key", shingles(F.col("own_text"), short).alias("hashes"))
    seen = hashed.select("row_key", F.explode(windows(F.col("hashes"), STEP)).alias("w")).select("row_key", *bands("w"))
    met = F.lit(False)
    for i, values in enumerate(by_band):
        met = met | F.col(f"b{i}").isin(*(values or [0]))
    pairs = seen.filter(met).select("row_key", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("value")) for i in range(BANDS)))).alias("x"))
    candidates = pairs.select("row_key", "x.band", "x.value").join(F.broadcast(banded), ["band", "value"]).select("row_key", "license").distinct()
    known = [r["shingle"] for r in grams.select("shingle").distinct().collect()]  # of the templates only
    held = hashed.select("row_key", F.explode("hashes").alias("shingle")).filter(F.col("shingle").isin(*(known or [0]))).distinct()
    shares = held.join(F.broadcast(grams), "shingle").groupBy("row_key", "license").agg((F.count("*") / F.max("size")).alias("share"))
    found = candidates.join(shares, ["row_key", "license"]).filter(F.col("share") >= contained)
    lists = found.groupBy("row_key").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("found"), F.count("*").alias("n"))
    out = keyed.select(id_col, "row_key").join(lists, "row_key", "left")
    return out.select(F.col(id_col), F.coalesce("found", F.lit("")).alias("licenses"), F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"))
