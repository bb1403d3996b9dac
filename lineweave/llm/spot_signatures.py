"""Document fingerprints: SpotSigs. After each occurrence of a common word (the anchor), the next content words form
a chain; anchor and chain hash to a signature, and the set of signatures is the document's fingerprint.

Sets are compared by Jaccard. For a join, sets are partitioned by length: two sets can only be alike to the threshold
if their lengths are within it, so a set meets its own length class and the next, and inside them only sets
that share one of the first signatures in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.llm.common import cut, shuffle_partitions, small_side, text_or_empty

#: Fixed: common words that serve as anchors, by language.
ANCHORS = {
    "en": "the a an and of to in is was be for with that it are this by",
    "fr": "le la les des et une un de dans pour est sur par que",
    "de": "der die das und ein eine ist den von zu mit für",
    "es": "el los las y que una por con del se",
}
ANCHOR_WORDS = tuple(dict.fromkeys(w for words in ANCHORS.values() for w in words.split()))
CHAIN = 3
#: Documents of neighbouring ids that are looked at together.
BUCKET = 1024


def signatures(text: Column, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHOR_WORDS) -> Column:
    """Sorted distinct 64-bit signatures of a text: array<long>, never empty.

    Words are runs of letters and digits, lower-cased. An anchor followed by fewer content words than the chain has no
    signature. A text without any signature has one, of the whole text, so equal texts always have equal sets.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    content = lambda ws: F.filter(ws, lambda w: ~w.isin(*anchors))
    places = lambda ws: F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(*anchors))
    state = F.struct(content(words).alias("content"), places(words).alias("places"))

    # before the j-th anchor stand j others, so the content words behind it begin at its own place less j
    def of(s: Column) -> Column:
        def one(p: Column, j: Column) -> Column:
            at = p["i"] - j
            return F.when(at + chain <= F.size(s["content"]), F.xxhash64(p["w"], *(F.get(s["content"], at + k) for k in range(chain))))

        return F.sort_array(F.array_distinct(F.filter(F.transform(s["places"], one), lambda x: x.isNotNull())))

    found = F.get(F.transform(F.array(state), of), F.lit(0))  # a one-element array binds the state once
    whole = F.array(F.xxhash64(F.lit("whole text"), text))
    return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(whole)), F.lit(0))


def as_string(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets, 0 to 1; null if one is null."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.get(F.transform(F.array(both), lambda n: n / (F.size(a) + F.size(b) - n)), F.lit(0))


def length_class(n: Column, threshold: float) -> Column:
    """Class of a set length: lengths within the threshold of each other fall in one class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + F.lit(1e-9)).cast("int")


def alike(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Pairs (left_id, right_id, likeness) of representatives with likeness >= threshold and left_id < right_id; equal
    fingerprints are one class, told by members: (id, class_id) of class_members().

    Sets are partitioned by length class; a set is also copied to the class above. A pair shares one of its first
    |x| - ceil(threshold |x|) + 1 signatures in any order common to all sets, so candidates come from an equi-join on
    (class, signature). The rarest come first: a passage that many different documents share leads no candidates together
    while they hold enough other signatures.

    A null text is empty; rows without an id are left out; repeated rows are one class; an empty table gives no pair;
    other columns aren't read.
    """
    classes = cut(_classes(df, id_col, text_col), "classes")
    each = classes.select("class_id", F.explode("spots").alias("spot"))
    held = each.groupBy("spot").agg(F.count("*").alias("held"))
    ordered = each.join(held, "spot").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("held", "spot")))["spot"].alias("spots"))
    n = F.size("spots")
    first = F.slice("spots", 1, (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
    keyed = ordered.select("class_id", n.alias("n"), length_class(n, threshold).alias("own"), F.explode(first).alias("spot"))
    low = keyed.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.explode(F.array("own", F.col("own") + 1)).alias("part"), "spot", F.col("own").alias("oa"))
    high = keyed.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("part"), "spot")
    size_fits = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & ((F.col("oa") < F.col("part")) | (F.col("a") < F.col("b")))
    pairs = low.join(high, ["part", "spot"]).filter(size_fits & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    left = classes.select(F.col("class_id").alias("a"), F.col("spots").alias("sa"))
    right = classes.select(F.col("class_id").alias("b"), F.col("spots").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return scored.filter(F.col("likeness") >= threshold)


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(text_or_empty(text_col)).alias("spots")).groupBy("spots").agg(F.min("id").alias("class_id"))


def class_members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) of every row with an id: class_id is the least id among rows of equal fingerprints. A null text is
    empty; an empty table gives no row; other columns aren't read."""
    own = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(text_or_empty(text_col)).alias("spots"))
    return own.join(own.groupBy("spots").agg(F.min("id").alias("class_id")), "spots").select("id", "class_id")


def fingerprints_and_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots).

    The edited text of a row is its own with the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next row's, by descending id; the row of the least id is followed by that of the greatest. A null text
    is empty. Rows that share an id are ordered by text. Rows without an id come after all others. An empty table
    gives no row; other columns aren't read.

    Rows are dealt into buckets of neighbouring ids, sized so that a bucket holds BUCKET rows where ids are spread
    evenly; each bucket also gets the row that follows its last. So a text is shuffled once, and no window spans
    more than a bucket.
    """
    spark = df.sparkSession
    text = text_or_empty(text_col)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)))
    bounds = df.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    width = max(1, -(-((bounds["high"] or 0) - (bounds["low"] or 0) + 1) * BUCKET // max(1, bounds["n"])))
    bucket = lambda k: F.floor((k - F.lit(bounds["low"] or 0)) / F.lit(width)).cast("long")
    order = F.struct(key.alias("k"), F.xxhash64(text).alias("t"))
    ends = cut(df.select(bucket(key).alias("bucket"), order.alias("last")).groupBy("bucket").agg(F.max("last").alias("last")), "ends")
    n = ends.count()
    # the row before which bucket it stands: that of the next higher bucket that has rows, or the lowest of all
    up = W.orderBy("bucket")
    follows = ends.select("last", F.coalesce(F.lead("bucket").over(up), F.min("bucket").over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("of"))
    rows = df.select(F.col(id_col), text.alias("own_text"), order.alias("place"), bucket(key).alias("bucket"))
    copies = rows.join(small_side(follows, n), F.col("place") == F.col("last"), "left").withColumn("again", F.col("of").isNotNull())
    dealt = copies.select(id_col, "own_text", "place", F.explode(F.when(F.col("again"), F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("of").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest"))))).alias("to"))
    dealt = dealt.select(id_col, "own_text", "place", "to.bucket", "to.guest").repartition(shuffle_partitions(spark), "bucket")
    down = W.partitionBy("bucket").orderBy("guest", F.desc("place"))
    near = dealt.withColumn("spots", signatures(F.col("own_text"))).select("*", F.lead("own_text").over(down).alias("next_text"), F.lead("spots").over(down).alias("next_spots"))
    near = near.filter(~F.col("guest"))
    half = F.floor(F.char_length("own_text") / 2).cast("int")
    edited = F.concat(F.left("own_text", F.char_length("own_text") - half), F.left("next_text", half))
    both = near.select(id_col, "own_text", "spots", "next_spots", edited.alias("edited"))
    both = both.withColumn("edited_spots", signatures(F.col("edited")))
    return both.select(
        id_col,
        F.char_length("own_text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("spots")).alias("fingerprint"),
        as_string(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        F.size("spots").cast("long").alias("n_spots"),
    )
