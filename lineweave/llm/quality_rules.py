"""Quality rules: word statistics and the divergence of a document's histograms from those of its language.

First pass: counts of every text, and two histograms, of character classes and of common words. The references are
the same histograms summed over all documents of a language that pass the base rules. A document long enough to
judge is rejected if the Jensen-Shannon distance of either histogram from its language's reference is above the limit.
Common words are held against the reference twice, with all other words as one bucket and apart from them: the bucket
alone would make any text of few common words, or of another language's, look alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import cut

#: Common words by language; a document's language outside these counts as "other", with all of them.
COMMON = {
    "en": "the and of to in is that for it was with as on are at by this be from an or a have not",
    "fr": "le la les des et une un de en que dans pour est sur par ne pas au qui du il se plus",
    "de": "der die und das ist den von zu mit ein im eine nicht auf des sich dem es auch als für in",
    "es": "el la los de que y en un una por con no para es al lo del se las su como más",
}
LANGUAGES = (*COMMON, "other")
WORDS = tuple(dict.fromkeys(w for words in COMMON.values() for w in words.split()))
#: The classes: lower-case letters, upper-case, letters beyond ASCII, digits, white space, sentence marks, other ASCII marks, all else.
CLASSES = 8
SYMBOLS = b"#*$%&|<>"


def _class_of_byte() -> np.ndarray:
    """Class of each byte of UTF-8; the bytes after a character's first count for nothing (class CLASSES)."""
    out = np.full(256, 6, np.uint8)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[0xC3:0xC6] = 2
    out[0xC2] = 7
    out[0xC6:] = 7
    out[ord("0") : ord("9") + 1] = 3
    out[[9, 10, 11, 12, 13, 32]] = 4
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    out[0x80:0xC0] = CLASSES
    out[[*range(9), *range(14, 32), 127]] = 7
    return out


CLASS_OF_BYTE = _class_of_byte()


@dataclass(frozen=True)
class Limits:
    """min_words: shorter documents fail; max_repeat: percent of words in repeated three-word windows; js_classes,
    js_words: the largest Jensen-Shannon distance (0 to 1) from the language; guard_words: only documents of as many
    words are held against the common words, whose shares are noise in short texts; guard_common: and apart from the
    other words only those of which the language's share leads to expect as many common words (of 20 drawn from a
    reference, 0.5 percent are above js_words)."""

    min_words: int = 50
    max_repeat: int = 50
    js_classes: float = 0.28
    js_words: float = 0.6
    guard_words: int = 100
    guard_common: int = 20


def measure(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, common words (and all others)."""
    words = text.split()
    n = len(words)
    classes = np.bincount(CLASS_OF_BYTE[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    word_chars = int(classes.sum() - classes[4])
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    n_dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter(map(number.setdefault, words, count()), np.int64, n)  # a word's first place stands for it
        threes = ids[:-2] * n + ids[1:-1]
        if n < 2_000_000:
            threes = threes * n + ids[2:]
        else:  # the product of three no longer fits
            threes = np.unique(threes, return_inverse=True)[1] * n + ids[2:]
        order = np.argsort(threes, kind="stable")
        same = threes[order[1:]] == threes[order[:-1]]
        if same.any():
            often = np.zeros(n - 2, bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= often
            repeated = int(covered.sum())
    common = [0] * (len(WORDS) + 1)
    for place in map(PLACE.get, text.translate(PLAIN_BYTE).split()):
        if place is not None:
            common[place] += 1
    common[-1] = max(0, n - sum(common))
    return n, word_chars, n_symbols, n_dup_lines, repeated, classes.tolist(), common


PLACE = {w.encode(): i for i, w in enumerate(WORDS)}
#: Lower case, and white space for the marks at a word's edges.
PLAIN_BYTE = bytes(ord(" ") if chr(b) in ".,;:!?'\"()" else ord(chr(b).lower()) if b < 128 else b for b in range(256))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first pass: (id, language, the five counts, classes, common)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [*zip(*rows, strict=True)] or [()] * 7
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, longs) for c in columns[5:])], names=[id_col, "language", *COUNTS, "classes", "common"])

    known = F.when(F.lower(F.col(lang_col).cast("string")).isin(*COMMON), F.lower(F.col(lang_col).cast("string"))).otherwise("other")
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, language string, " + ", ".join(f"{c} long" for c in COUNTS) + ", classes array<long>, common array<long>"
    return df.select(F.col(id_col), F.col(text_col), known.alias("language")).mapInArrow(run, schema)


def js_distance(histograms: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence (base 2) of each row from the reference; 0 where one of them is empty."""
    total = histograms.sum(axis=1, keepdims=True)
    if not reference.sum():
        return np.zeros(len(histograms))
    p = histograms / np.maximum(total, 1)
    q = np.broadcast_to(reference / reference.sum(), p.shape)
    middle = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(middle > 0, middle, 1)), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((part(p) + part(q)) / 2, 0)), 0)


def words_distance(histograms: np.ndarray, reference: np.ndarray, n_words: np.ndarray, expected: int) -> np.ndarray:
    """The larger of the distances of the common words with and without the last bucket, all others.

    Without it a text that has none of them is as far as can be, 1. Texts of which the reference's share of common words
    leads to expect fewer than ``expected`` are held with the bucket alone.
    """
    out = js_distance(histograms, reference)
    own, common = histograms[:, :-1], reference[:-1]
    if not common.sum():
        return out
    apart = np.where(own.sum(axis=1) > 0, js_distance(own, common), 1.0)
    return np.where(n_words * (common.sum() / reference.sum()) >= expected, np.maximum(out, apart), out)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row per row of df: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_classes, js_words).

    kept is false where a base rule fails (fewer than ``min_words`` words, or more than ``max_repeat`` percent of the
    words in three-word windows that occur twice), else whether both distances are within the limits; the one of
    common words is guarded by ``guard_words`` and ``guard_common``; "other" is no language of its own, so its common words
    are held with all other words only. A null text has no words; a null or unknown language is "other".
    Repeated rows are judged one by one. An empty table gives no row. Other columns aren't read. The references come
    from all documents that pass the base rules: one row for each of five languages, whatever the size of the table.
    """
    stats = cut(statistics(df, id_col, text_col, lang_col), "quality")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat * F.col("n_words"))
    sums = [F.sum(F.get("classes", F.lit(i))).cast("double").alias(f"c{i}") for i in range(CLASSES)]
    sums += [F.sum(F.get("common", F.lit(i))).cast("double").alias(f"w{i}") for i in range(len(WORDS) + 1)]
    reference = stats.filter(~failed).groupBy(F.col("language").alias("of")).agg(*sums)
    reference = reference.select("of", F.array(*(f"c{i}" for i in range(CLASSES))).alias("ref_classes"), F.array(*(f"w{i}" for i in range(len(WORDS) + 1))).alias("ref_common"))
    references = {r["of"]: (np.array(r["ref_classes"]), np.array(r["ref_common"])) for r in reference.collect()}  # five rows at most

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own = [np.array(batch.column(i).to_pylist(), np.float64).reshape(n, -1) for i in (7, 8)]
            out = [np.zeros(n), np.zeros(n)]
            language, n_words = np.array(batch.column(1).to_pylist(), object), np.array(batch.column(2).to_pylist(), np.int64)
            for name, reference in references.items():
                at = np.flatnonzero(language == name)
                out[0][at] = js_distance(own[0][at], reference[0])
                out[1][at] = js_distance(own[1][at], reference[1]) if name == "other" else words_distance(own[1][at], reference[1], n_words[at], limits.guard_common)
            out[1][n_words < limits.guard_words] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, 7)), *map(pa.array, out)], names=[id_col, *COUNTS, "js_classes", "js_words"])

    kind = dict(df.dtypes)[id_col]
    measured = stats.mapInArrow(distances, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", js_classes double, js_words double")
    kept = ~failed & (F.col("js_classes") <= limits.js_classes) & (F.col("js_words") <= limits.js_words)
    return measured.select(id_col, *COUNTS, failed.alias("base_failed"), kept.alias("kept"), "js_classes", "js_words")
