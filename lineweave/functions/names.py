"""Names, numbers and ids of features, as Column expressions (RE2-friendly patterns, so SQL can say the same)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What kind of structure a name tells, and words that don't identify a place.
KINDS = ("aqueduct", "bridge", "dam", "lock", "tunnel")
IGNORED = ("access", "boat", "center", "lock", "park", "ramp", "state", "visitor")
TELLING = 5  # letters of a word that identifies a place
AMENITIES = ("visitor_center", "canal_quarters", "camping", "boat_ramp", "canoe_kayak_ramp")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_name(name: Column) -> Column:
    """Lower case; possessive 's joined; "no." before a number dropped; everything but letters and digits to one space."""
    plain = F.replace(F.lower(name), F.lit("’"), F.lit("'"))
    plain = F.regexp_replace(plain, r"'s\b", "s")
    plain = F.regexp_replace(plain, r"\bno\.?\s+(\d)", "$1")
    return squeeze(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def kind_of(words: Column) -> Column:
    return F.coalesce(*(F.when(F.array_contains(words, k), F.lit(k)) for k in KINDS))


def names_match(left: Column, right: Column) -> Column:
    """For normalised names: no if their kinds differ; yes if one holds the other, as characters; else if they share a telling word."""
    a, b = F.split(left, " "), F.split(right, " ")
    clash = F.coalesce(kind_of(a) != kind_of(b), F.lit(False))
    inside = F.contains(left, right) | F.contains(right, left)
    shared = F.exists(F.array_except(F.array_intersect(a, b), F.array(*map(F.lit, IGNORED))), lambda w: F.length(w) >= TELLING)
    return ~clash & (inside | shared)


def slug(text: Column) -> Column:
    """Lower-case ASCII groups joined by hyphens; decomposes accented letters in the composed Latin range, drops other characters."""
    upto = range(0xC0, 0x250)
    found = {chr(c): d for c in upto if (d := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) and len(d) == 1}
    plain = F.translate(text, "".join(found), "".join(found.values()))
    plain = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-|-$", "")


def number_slug(number: Column) -> Column:
    return slug(F.replace(number.cast("string"), F.lit("-"), F.lit("minus-")))


def lock_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)\block\s+(\d+(?:\s+\d+/\d+)?)\b", 1), F.lit(""))


def feature_type(name: Column, amenities: dict[str, Column]) -> Column:
    """The first rule that holds, of the name and then of the amenities."""
    low = F.lower(name)
    return (
        F.when(F.contains(low, F.lit("lockhouse")), "lockhouse")
        .when(F.contains(low, F.lit("lock")), "lock")
        .when(F.contains(low, F.lit("aqueduct")), "aqueduct")
        .when(low.rlike(r"\bdam\b"), "dam")
        .when(F.contains(low, F.lit("tunnel")), "tunnel")
        .when(amenities["visitor_center"] | F.contains(low, F.lit("visitor center")), "visitor_center")
        .when(amenities["canal_quarters"], "canal_quarters")
        .when(amenities["camping"], "campground")
        .when(amenities["boat_ramp"] | amenities["canoe_kayak_ramp"], "boat_access")
        .when(F.contains(low, F.lit("fort ")), "historic_site")
        .otherwise("recreation_location")
    )
