"""Suffix-array dedup: bytes inside long strings that occur more than once are removed.

The index is a logarithmic family of sparse suffix arrays. A suffix is kept where a byte position is an anchor: the
16-gram of least hash in some window of the match length, which equal windows choose alike. Each suffix is entered by
the digest of what every window that chose it shares (its core, about half a match or more), and an array holds its suffixes in
the order of these digests. A new batch becomes an array of its own, is merge-scanned against the levels that exist,
and levels of equal size merge before the next batch comes, so that n batches leave about log n levels.

What the scans match is then settled exactly. A node stands for the windows that see their anchor at distances l0..l1.
Its core lies in all of them: if the core occurs once, none of them repeats. Its hull is their union: if the hull
occurs twice, all of them repeat. Nodes that are neither are split, 196 distances into cells of 14 and those into
single windows, whose own digests (128 bits) decide. So only the edges of repeats are looked at closely, and no two
occurrences are ever paired.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import cut, drop_cut, slices, text_or_empty

GRAM = 16
CHUNK = 1 << 19  # bytes whose windows are looked at together; places in a chunk take 20 bits
_LOW = np.uint64((1 << 20) - 1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class Shape:
    """The distances of each level's nodes for matches of so many bytes."""

    def __init__(self, match: int):
        if match < 2 * GRAM:
            raise ValueError(f"match must be {2 * GRAM} bytes at least")
        self.match, self.span = match, match - GRAM + 1
        self.narrow = max(1, round((self.span / 2) ** 0.5))
        self.wide = self.narrow * -(-self.span // (2 * self.narrow))  # so no narrow cell lies across two wide ones


def _chunk_anchors(data: np.ndarray, span: int) -> np.ndarray:
    """For each window start of the bytes, the place of the leftmost 16-gram of least hash in it."""
    grams = len(data) - GRAM + 1
    first = np.ndarray(grams, "<u8", data, 0, (1,))
    second = np.ndarray(grams, "<u8", data, 8, (1,))
    key = first * _MIX[0]
    key ^= key >> np.uint64(29)
    key += second * _MIX[1]
    key ^= key >> np.uint64(32)
    key *= _MIX[2]
    key &= ~_LOW
    key |= np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // span)
    padded = np.full(blocks * span, ~np.uint64(0))
    padded[:grams] = key
    rows = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = grams - span + 1
    return (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _LOW).astype(np.int64)


def anchors(text: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text in order, each with the least and the largest distance at which a window sees it."""
    windows = len(text) - shape.match + 1
    places, starts = [], []
    for at in range(0, max(windows, 0), CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK, windows - at) + shape.match - 1, at)
        place = _chunk_anchors(data, shape.span)
        new = np.flatnonzero(np.diff(place, prepend=-1))
        places.append(place[new] + at)
        starts.append(new + at)
    if not places:
        return (np.empty(0, np.int64),) * 3
    place, start = np.concatenate(places), np.concatenate(starts)
    if len(places) > 1:  # a chunk may begin with the anchor that ended the one before
        keep = np.flatnonzero(np.diff(place, prepend=-1))
        place, start = place[keep], start[keep]
    end = np.append(start[1:], windows)
    return place, place - end + 1, place - start


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def cells(place: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, span: int) -> tuple[np.ndarray, ...]:
    """Cuts each anchor's distances low..high along a grid: (place, the grid cell's l0, l1, and the part l of it that is seen)."""
    first, last = low // size, high // size
    each = last - first + 1
    row = np.repeat(np.arange(len(place)), each)
    cell = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first[row]
    l0, l1 = cell * size, np.minimum(cell * size + size, span) - 1
    return place[row], l0, l1, np.maximum(l0, low[row]), np.minimum(l1, high[row])


def digests(text: bytes, place: np.ndarray, l0: np.ndarray, l1: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node's core and of its hull; 0 for a hull that the text has no room for."""
    view, of = memoryview(text), xxhash.xxh3_64_intdigest
    core = [of(view[s:e]) for s, e in zip((place - l0).tolist(), (place - l1 + match).tolist(), strict=True)]
    n = len(text)
    hull = [of(view[s:e]) if s >= 0 and e <= n else 0 for s, e in zip((place - l1).tolist(), (place - l0 + match).tolist(), strict=True)]
    return _signed(core), _signed(hull)


def _removed(n: int, spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of what the spans (pairs start, end) cover."""
    pairs = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
    if not len(pairs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(np.minimum(pairs[:, 1], n))
    start = np.maximum(pairs[:, 0], 0)
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def without(text: bytes, pairs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in pairs:
        kept.append(text[at:s])
        at = max(at, e)
    return b"".join([*kept, text[at:]])


def whole_characters(text: bytes, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, widened so that a character of UTF-8 that loses a byte goes as a whole."""
    out = []
    for s, e in pairs:
        while s > 0 and text[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(text) and text[e] & 0xC0 == 0x80:
            e += 1
        out.append((s, e))
    return out


def _finish(text: bytes, spans: list[np.ndarray], min_words: int) -> tuple[int, int, str, bytes, str]:
    start, end = _removed(len(text), spans)
    if min_words:
        long = np.array([len(text[s:e].split()) >= min_words for s, e in zip(start.tolist(), end.tolist(), strict=True)], bool)
        start, end = start[long], end[long]
    pairs = [*zip(start.tolist(), end.tolist(), strict=True)]
    digest = hashlib.sha256(without(text, pairs)).hexdigest()
    return int((end - start).sum()), len(start), digest, np.column_stack([start, end]).astype("<i8").tobytes(), without(text, whole_characters(text, pairs)).decode(errors="ignore")


def _pairs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, 2)


def _known(found: list | None) -> dict[tuple[int, int], int]:
    return {(x["core"], x["hull"]): x["kind"] for x in found or ()}


_LONGS = pa.list_(pa.int64())
#: What a text leaves behind: settled (n_removed on), or open (the text itself and its nodes).
_STATE = [("row_key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary()), ("kept_text", pa.string()), ("open_text", pa.binary()), *((c, _LONGS) for c in ("core", "hull", "weight", "place", "l0", "l1"))]
_SQL = "row_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept_text string, open_text binary, core array<long>, hull array<long>, weight array<long>, place array<long>, l0 array<long>, l1 array<long>"


def _emit(part: pa.RecordBatch, kept: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [()] * len(_STATE)
    return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(kept)), *(pa.array(c, t) for c, (_, t) in zip(columns, _STATE, strict=True))], names=[*part.schema.names[:kept], *(c for c, _ in _STATE)])


def _state(key: int, text: bytes, spans: list[np.ndarray], nodes: list[tuple[np.ndarray, ...]], give_text: bool, min_words: int) -> tuple:
    """A row of _STATE; nodes: (core, hull, weight, place, l0, l1) that are still open."""
    if not nodes:
        *settled, kept = _finish(text, spans, min_words)
        return (key, len(text), *settled, kept if give_text else None, None, *[None] * 6)
    start, end = _removed(len(text), spans)
    return (key, len(text), 0, 0, None, np.column_stack([start, end]).astype("<i8").tobytes(), None, text, *(np.concatenate(c) for c in zip(*nodes, strict=True)))


class SuffixFamily:
    """Levels of sorted suffix digests. add() takes a batch of (core, weight) and returns the cores in it that now occur twice or more."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, array), largest first

    def add(self, batch: DataFrame) -> DataFrame:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:  # levels of equal size merge
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("core").agg(F.sum("weight").alias("weight"))
            self.levels.append((n + m, cut(merged.sortWithinPartitions("core"), "level")))
            drop_cut(a, b)
        array = cut(batch.groupBy("core").agg(F.sum("weight").alias("weight")).sortWithinPartitions("core"), "level")
        scanned = array.withColumn("new", F.lit(1))
        for _, level in self.levels:
            scanned = scanned.unionByName(level.withColumn("new", F.lit(0)))
        self.levels.append((1, array))
        both = scanned.groupBy("core").agg(F.sum("weight").alias("weight"), F.max("new").alias("new"))
        return both.filter((F.col("weight") > 1) & (F.col("new") == 1)).select("core")

    def drop(self) -> None:
        drop_cut(*(level for _, level in self.levels))


def settle(nodes: DataFrame) -> DataFrame:
    """(row_key, found): for each row the nodes whose core occurs twice or more, kind 0: open, 1: the hull occurs twice
    or more, 2: that too, and this row's copy stands for the class when its open neighbours are split.

    nodes: (row_key, core, hull, weight). Classes are counted with partial sums and joined back on unique keys, which
    a hot class can't hold up: adaptive execution splits its rows.
    """
    classes = nodes.groupBy("core", "hull").agg(F.sum("weight").alias("n"), F.min("row_key").alias("first"))
    classes = classes.withColumn("twice", (F.col("n") > 1) & (F.col("hull") != 0))
    cores = classes.groupBy(F.col("core").alias("of")).agg(F.sum("n").alias("total"), F.max(~F.col("twice")).alias("mixed")).filter("total > 1")
    judged = classes.join(cores, F.col("core") == F.col("of")).select(F.col("core").alias("c"), F.col("hull").alias("h"), "first", "twice", "mixed")
    kind = F.when(~F.col("twice"), 0).when(F.col("mixed") & (F.col("row_key") == F.col("first")), 2).otherwise(1)
    rows = nodes.join(judged, (F.col("core") == F.col("c")) & (F.col("hull") == F.col("h"))).select("row_key", F.struct("core", "hull", kind.alias("kind")).alias("node"))
    return rows.groupBy("row_key").agg(F.collect_set("node").alias("found"))


def _exploded(state: DataFrame) -> DataFrame:
    return state.select("row_key", F.inline(F.arrays_zip("core", "hull", "weight")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = 400, batches: int = 3, keep: tuple[str, ...] = (), give_text: bool = False, min_words: int = 0) -> DataFrame:
    """One row per row of df: (id, the columns named by keep, n_bytes, n_removed, n_spans, kept_sha256, spans), and
    with give_text also kept_text, the text without the characters that lose a byte.

    Every byte that a string of ``match`` bytes covers which also starts anywhere else in the table (same text
    included, overlaps count) is removed; spans holds the maximal removed runs as little-endian 64-bit pairs (start,
    end) of byte offsets. With min_words, a run that holds fewer words (cut ones at its ends included) stays as a whole.
    Strings are judged on the input and never cross texts. A null text is empty; a text shorter
    than ``match`` loses nothing; repeated rows repeat each other and lose all that is long enough. An empty table
    gives no row. Other columns aren't read. Very long texts are looked at in chunks of a megabyte.
    """
    shape = Shape(match)
    kinds = dict(df.dtypes)
    first_columns = [id_col, *keep]
    carried, schema = len(first_columns), ", ".join(f"`{c}` {kinds[c]}" for c in first_columns) + f", {_SQL}"
    text = text_or_empty(text_col)
    docs = df.select(*(F.col(f"`{c}`") for c in first_columns), F.xxhash64(F.col(id_col), text).alias("row_key"), text.cast("binary").alias("own_text"))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            keys, cores, hulls, weights = [], [], [], []
            for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if len(body) < match:
                    continue
                place, l0, l1, *_ = cells(*anchors(body, shape), shape.wide, shape.span)
                core, hull = digests(body, place, l0, l1, match)
                weight = np.ones(len(core), np.int64)
                if len(core) > 8 * len(body) / shape.span:  # periodic text: the same few nodes again and again
                    counted = Counter(zip(core.tolist(), hull.tolist(), strict=True))
                    core, hull = np.array([*counted], np.int64).reshape(-1, 2).T
                    weight = np.array([*counted.values()], np.int64)
                keys.append(np.full(len(core), key))
                cores.append(core)
                hulls.append(hull)
                weights.append(weight)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (keys, cores, hulls, weights)], names=["row_key", "core", "hull", "weight"])

    suffixes = cut(docs.select("row_key", "own_text").mapInArrow(scan, "row_key long, core long, hull long, weight long"), "suffixes")
    family, matched = SuffixFamily(), None
    for k in range(batches):
        found = family.add(suffixes.filter(F.pmod("row_key", F.lit(batches)) == k).select("core", "weight"))
        found = cut(found, "matched")
        matched = [*(matched or []), found]
    cores = matched[0]
    for more in matched[1:]:
        cores = cores.unionByName(more)
    repeated = cut(suffixes.join(cores.distinct(), "core", "left_semi"), "repeated")
    family.drop()
    drop_cut(suffixes, *matched)

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            rows = []
            for key, body, found in zip(*(part.column(carried + i).to_pylist() for i in range(3)), strict=True):
                spans, nodes = [], []
                if known := _known(found):
                    place, l0, l1, low, high = cells(*anchors(body, shape), shape.wide, shape.span)
                    core, hull = digests(body, place, l0, l1, match)
                    what = np.array([known.get(x, -1) for x in zip(core.tolist(), hull.tolist(), strict=True)], np.int64)
                    sure = what > 0
                    spans.append(np.column_stack([place[sure] - l1[sure], place[sure] - l0[sure] + match]))
                    more = (what == 0) | (what == 2)
                    if more.any():
                        p, c0, c1, lo, hi = cells(place[more], low[more], high[more], shape.narrow, shape.span)
                        wide = np.repeat(what[more], high[more] // shape.narrow - low[more] // shape.narrow + 1)
                        core, hull = digests(body, p, c0, c1, match)
                        nodes.append((core, hull, np.where(wide == 2, 2, 1), p, lo, hi))
                rows.append(_state(key, body, spans, nodes, give_text, min_words))
            yield _emit(part, carried, rows)

    wide = docs.join(settle(repeated), "row_key", "left").select(*first_columns, "row_key", "own_text", "found")
    first = cut(wide.mapInArrow(split, schema), "split")
    drop_cut(repeated)

    def single(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh3_128_intdigest
        for part in slices(parts):
            rows = []
            names = part.schema.names
            column = lambda c: part.column(names.index(c)).to_pylist()  # noqa: B023, E731
            for key, body, spans, found, core, hull, place, low, high in zip(*map(column, ("row_key", "open_text", "spans", "found", "core", "hull", "place", "l0", "l1")), strict=True):
                known, view = _known(found), memoryview(body)
                spans, ones, weights, at = [_pairs(spans)], [], [], []
                for c, h, p, lo, hi in zip(core, hull, place, low, high, strict=True):
                    what = known.get((c, h), -1)
                    if what > 0:
                        spans.append(np.array([[p - hi, p - lo + match]]))
                    if what in (0, 2):
                        for d in range(lo, hi + 1):
                            ones.append(of(view[p - d : p - d + match]))
                            at.append(p - d)
                            weights.append(2 if what == 2 else 1)
                nodes = []
                if ones:
                    halves = _signed([x >> 64 for x in ones]), _signed([x & (1 << 64) - 1 or 1 for x in ones])
                    start = np.array(at, np.int64)
                    nodes.append((*halves, np.array(weights, np.int64), start, np.zeros_like(start), np.zeros_like(start)))
                rows.append(_state(key, body, spans, nodes, give_text, min_words))
            yield _emit(part, carried, rows)

    opened = first.filter(F.col("open_text").isNotNull())
    closer = opened.join(settle(_exploded(opened)), "row_key", "left")
    second = cut(closer.select(*first_columns, "row_key", "open_text", "spans", "found", "core", "hull", "place", "l0", "l1").mapInArrow(single, schema), "single")

    def last(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            rows = []
            names = part.schema.names
            column = lambda c: part.column(names.index(c)).to_pylist()  # noqa: B023, E731
            for key, body, spans, found, core, hull, place in zip(*map(column, ("row_key", "open_text", "spans", "found", "core", "hull", "place")), strict=True):
                known = _known(found)
                at = np.array([p for c, h, p in zip(core, hull, place, strict=True) if known.get((c, h), 0) > 0], np.int64)
                rows.append(_state(key, body, [_pairs(spans), np.column_stack([at, at + match])], [], give_text, min_words))
            yield _emit(part, carried, rows)

    windows = second.filter(F.col("open_text").isNotNull())
    third = windows.join(settle(_exploded(windows)), "row_key", "left").select(*first_columns, "row_key", "open_text", "spans", "found", "core", "hull", "place").mapInArrow(last, schema)
    done = [*first_columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept_text"] if give_text else [])]
    settled = lambda x: x.filter(F.col("open_text").isNull()).select(*done)
    return settled(first).unionByName(settled(second)).unionByName(third.select(*done))
