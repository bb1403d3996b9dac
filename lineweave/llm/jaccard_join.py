"""N-gram Jaccard join: documents whose sets of word 5-grams are alike, by a token-group matrix.

1.  Texts with equal sets form one class; from here on its smallest row stands for it. Each class keeps its prefix:
    the first |x| - ceil(0.8 |x|) + 1 tokens in a fixed order. Two sets that are 0.8 alike share a prefix token, so a
    class without a shared one links with nothing. The order puts tokens last that many documents of a task hold; any
    order is right, and this one keeps common passages out of prefixes.
2.  Similar classes are partitioned into groups: by minimum hash, each compared with the leaders of its block, three
    times with another hash, only one of each group going on. Those whose tokens many documents hold lead: of a text and
    its edited copies it is the text, which all that link with any are likely to link with. Were one edited copy to lead,
    the others would stay alone and meet each other in the matrix, pair by pair.
3.  The matrix holds each group's union of prefix tokens, each with the best place that it has in a member's order. A
    document is bound to a group it may link with by the tokens it shares with that union, of which only those count
    that stand early enough, in the document and in the group, to be among the first few that a linked pair shares.
    So a token that thousands of copies hold, and the order puts last, brings no two of them together. Only groups
    that share enough are opened, and their members are streamed past the documents that ask. A link joins the groups.

Members of a block or of an opened group are dealt into parts of bounded size that each get a copy of the few that
they are compared with, so no task holds a whole group and no two copies of a text are ever paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import cut, drop_cut, shuffle_partitions, slices, text_or_empty
from lineweave.operators.graph import components

SHINGLE, PERCENT = 5, 80
#: Members that one task compares with the documents of a block, and their tokens; documents of a block held at a time.
PART, PART_TOKENS, ASKING = 2000, 4_000_000, 500
#: Documents of a block's part that others are compared with while groups are formed.
LEADERS = 24
#: A document asks a group if they share so many more tokens than one, early enough in both; one of fewer than SHORT tokens,
#: which is soon compared, if they share one.
EXTRA, SHORT = 1, 256
#: The map of frequent tokens has this many cells of two bits whatever the size of the table: 4 MB.
CELLS = 1 << 24
#: Tokens that so many documents of some thousands hold are told; from so many documents over all, a token is of level 1, 2, 3.
LOCAL_COUNT, LEVELS = 2, (12, 48, 192)
#: Tokens that are counted at a time.
COUNTED = 4_000_000
KEYS = 3
#: Of the keys, those that groups are formed by before the matrix; it finds all links whatever they do.
ROUNDS = KEYS

_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
_SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles: A-Z lower-cased, words without ASCII white space; a text of fewer words is one shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = len(hashes) - shingle + 1
    if n < 1:
        return _scramble(np.array([np.bitwise_xor.reduce(hashes * _power(len(hashes))) + np.uint64(len(hashes))], np.uint64))
    power = _power(shingle)
    total = hashes[:n] * power[0]
    for k in range(1, shingle):
        total += _scramble(hashes[k : k + n] * power[k])
    return np.unique(_scramble(total))


def _power(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= len(_POWERS) else _scramble(np.arange(1, n + 1, dtype=np.uint64) * _POWERS[0]) | np.uint64(1)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def frequent_cells(docs: DataFrame) -> np.ndarray:
    """Levels of token cells, two bits each: how many documents hold a cell's tokens, of those tokens that LOCAL_COUNT or
    more documents hold among COUNTED tokens (cells that fill by chance in a large table count for nothing). It only
    orders tokens; what it misses costs no link."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL_COUNT
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((own[often] & np.uint64(CELLS - 1)).astype(np.int64)), pa.array(n[often])], names=["cell", "n"])

        for part in slices(parts):
            for body in part.column(0).to_pylist():
                held.append(tokens(body))
                size += len(held[-1])
                if size > COUNTED:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    cells = cut(docs.select("own_text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    chance = 4 * (cells.agg(F.sum("n")).first()[0] or 0) // CELLS  # what a cell holds on average, four times
    n = F.col("n")
    level = F.lit(0)
    for k in LEVELS:
        level = level + F.when(n >= max(k, chance), 1).otherwise(0)
    of = cells.select("cell", level.cast("long").alias("level")).filter("level > 0")
    words = of.groupBy(F.shiftright("cell", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(level, cast(2 * (cell & 31) as int))")).alias("bits"))
    found = words.toArrow()  # CELLS / 32 rows at most
    levels = np.zeros(CELLS // 32, np.int64)
    levels[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    drop_cut(cells)
    return levels.view(np.uint64)


def levels_of(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    cell = own & np.uint64(CELLS - 1)
    return (levels[(cell >> np.uint64(5)).astype(np.int64)] >> (np.uint64(2) * (cell & np.uint64(31))) & np.uint64(3)).astype(np.uint8)


def ordered_prefix(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The prefix of a set in the global order: by level, rare ones first, then by hash."""
    return own[np.argsort(level, kind="stable")[: prefix_length(len(own))]]


def apart(level: np.ndarray) -> int:
    """How far a set is from what many documents hold, 0 (all its tokens are of the highest level) to 1000 (all rare)."""
    return 1000 * int(len(LEVELS) * len(level) - level.sum(dtype=np.int64)) // (len(LEVELS) * len(level))


def _bounds() -> dict[str, str]:
    """What a document of n tokens and a group with sets of group_low to group_high tokens must meet to link, as SQL.

    For sets of n and m tokens to link, a = ceil(0.8 (n + m) / 1.8) must be shared; then the k-th shared one in the
    order (from 0) stands at n - a + k at most in one and at m - a + k in the other. So the first 1 + EXTRA of them (the
    first, for a short document that asks) are at ``early`` places in both, or fewer where the kept prefixes, n - ceil(0.8 n) + 1 long, end before: ``need`` are left.
    The least of a is at the group's smallest set that fits, the least of what is left at the ends of its sizes; a group
    keeps of each token the least of (place - m + 0.8 m / 1.8) over its members.
    """
    up = lambda x, y: f"(({x} + {y} - 1) div {y})"
    least, most = f"greatest(group_low, {up(f'{PERCENT} * n', 100)})", f"least(group_high, 100 * n div {PERCENT})"
    alpha = lambda m: up(f"{PERCENT} * (n + {m})", 100 + PERCENT)
    own = f"{alpha(least)} - {up(f'{PERCENT} * n', 100)} + 1"
    other = f"{alpha(most)} - {up(f'{PERCENT} * {most}', 100)} + 1 - if(group_low < group_high, 1, 0)"
    extra = f"if(n < {SHORT}, 0, {EXTRA})"
    early = f"place <= n - {alpha(least)} + {extra} and group_place + {PERCENT} * n <= {100 + PERCENT} * {extra}"
    return {"fits": f"{least} <= {most}", "early": early, "need": f"greatest(1, least({own}, {other}, 1 + {extra}))"}


def _dealt(rows: DataFrame) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    order = ["apart"] if "apart" in rows.columns else []
    dealt = rows.repartition(n, "block", "part").sortWithinPartitions("block", "part", F.desc("asks"), *order, "id")
    return dealt.select("block", "part", "asks", "id", "text")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["asked", "member"])


def compare(rows: DataFrame) -> DataFrame:
    """Links (asked, member): rows are (block, part, asks, id, text); within a block's part, every member is compared
    with those that ask, up to the first that it links with."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking = None, []
        for part in slices(parts):
            links = []
            for block, k, asks, i, body in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True):
                if (block, k) != at:
                    at, asking = (block, k), []
                own = tokens(body)
                if asks:
                    asking.append((i, own))
                    continue
                for other, theirs in asking:
                    if linked(own, theirs):
                        links.append((other, i))
                        break
            if links:
                yield _links(links)

    return _dealt(rows).mapInArrow(run, "asked long, member long")


def lead(rows: DataFrame) -> DataFrame:
    """Links (asked, member) that make stars: rows as for compare(), with apart, by which they come. In a block's part,
    members that link with no leader become leaders themselves, LEADERS at most; one that links with several joins what
    they lead. Each member's link is to the first of the block where that is joined to it, else to the first that came
    of those joined."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders, first, up = None, [], None, {}

        def find(x: int) -> int:
            while up[x] != x:
                x = up[x]
            return x

        def told() -> list[tuple[int, int]]:
            joined: dict[int, list[int]] = {}
            for x in up:
                joined.setdefault(find(x), []).append(x)
            out = []
            for own in joined.values():
                root = first if first in own else own[0]
                out += [(root, x) for x in own if x != root]
            return out

        for part in slices(parts):
            links = []
            for block, k, asks, i, body in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True):
                if (block, k) != at:
                    links += told()
                    at, leaders, first, up = (block, k), [], None, {}
                own = tokens(body)
                up[i] = i
                if asks:
                    first = i
                alone = True
                for other, theirs in leaders:
                    if linked(own, theirs):
                        up[find(i)] = find(other)
                        alone = False
                if alone and len(leaders) < LEADERS:
                    leaders.append((i, own))
            if links:
                yield _links(links)
        if links := told():
            yield _links(links)

    return _dealt(rows).mapInArrow(run, "asked long, member long")


def join_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id, n_shingles, component_id).

    Two texts link when 100 * |a and b| >= 80 * |a or b| over their distinct word 5-grams; component_id is the
    smallest id that links reach, the row's own included. A null text, or one without words, has no shingles and links
    with nothing; nor does one link through it. Repeated rows link with each other, and rows that share an id but not
    a text are separate. A null id gives a row with its n_shingles that takes no part in links; its component is null.
    An empty table gives no row. Other columns aren't read.
    """
    text = text_or_empty(text_col)
    docs = df.select(F.col(id_col).alias("given"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), text).alias("row_key"), text.cast("binary").alias("own_text"))
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(frequent_cells(docs))  # CELLS bits

    def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            rows = []
            for body in part.column(3).to_pylist():
                own = tokens(body)
                if len(own):
                    level = levels_of(own, shared.value)
                    rows.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), *(int(_scramble(own ^ salt).min().view(np.int64)) for salt in _SALTS), apart(level), ordered_prefix(own, level).view(np.int64)))
                else:
                    rows.append((0, None, *[None] * KEYS, None, None))
            kinds = [pa.int64(), pa.binary(), *[pa.int64()] * KEYS, pa.int32(), pa.list_(pa.int64())]
            columns = [*zip(*rows, strict=True)] or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *map(pa.array, columns, kinds)], names=["given", "id", "row_key", "n_shingles", "digest", *key_names, "apart", "prefix"])

    key_names = [f"key{k}" for k in range(KEYS)]
    described = cut(docs.mapInArrow(describe, f"given {kind}, id long, row_key long, n_shingles long, digest binary, " + "".join(f"{k} long, " for k in key_names) + "apart int, prefix array<long>"), "sets")
    whole = described.filter("digest is not null and id is not null")
    # equal sets have equal prefixes and keys, so any row's will do; node numbers are fixed once the table is written
    classes = whole.groupBy("digest").agg(F.min("id").alias("least_id"), F.min(F.struct("id", "row_key")).alias("of"), F.any_value("n_shingles").alias("n"), *(F.any_value(k).alias(k) for k in (*key_names, "apart")), F.any_value("prefix").alias("prefix"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    slim = cut(described.select("given", "id", "n_shingles", "digest"), "sizes")
    drop_cut(described)

    postings = classes.select("rep", "n", F.posexplode("prefix").alias("place", "token"))
    often = postings.groupBy("token").count().filter(F.col("count") > 1).select("token")
    postings = cut(postings.join(often, "token", "left_semi"), "postings")
    active = postings.select("rep").distinct().join(classes.select("rep", "of.id", "of.row_key"), "rep")
    texts = cut(docs.join(active, ["id", "row_key"]).select("rep", F.col("own_text").alias("text")).dropDuplicates(["rep"]), "texts")

    # groups: (rep, head), head the rep that stands for its group
    heads = cut(texts.select("rep", F.col("rep").alias("head")), "heads")
    for key in key_names[:ROUNDS]:
        now = heads.filter("rep = head").join(classes.select("rep", F.col(key).alias("block"), "apart"), "rep").select("rep", "block", "apart")
        sizes = now.groupBy("block").agg(F.count("*").alias("size"), F.min(F.struct("apart", "rep"))["rep"].alias("first")).filter("size > 1")
        parts = F.ceil(F.col("size") / PART).cast("int")
        members = now.join(sizes, "block").filter("rep <> first").select("block", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), F.lit(0).alias("asks"), F.col("rep").alias("id"), "apart")
        asking = sizes.select("block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("asks"), F.col("first").alias("id"), F.lit(0).alias("apart"))
        links = lead(_with_text(members.unionByName(asking), texts))
        to = links.select(F.col("member").alias("old"), F.col("asked").alias("new"))
        fresh = cut(heads.join(to, F.col("head") == F.col("old"), "left").select("rep", F.coalesce("new", "head").alias("head")), "heads")
        drop_cut(heads)
        heads = fresh

    # the matrix: (token, group); tokens of one group only ask nothing of any other
    members = heads.join(classes.select("rep", "n"), "rep").groupBy(F.col("head").alias("of")).agg(F.count("*").alias("members"), F.sum("n").alias("mass"), F.min("n").alias("low"), F.max("n").alias("high"))
    placed = postings.join(heads, "rep").select("token", "rep", "n", "place", "head")
    held = placed.select("token", "head").distinct().groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1")
    placed = cut(placed.join(held.select("token"), "token").join(members, F.col("head") == F.col("of")).drop("of"), "matrix")
    at = F.expr(f"(place - n) * {100 + PERCENT} + {PERCENT} * n")  # in parts of 1 / 180
    unions = placed.groupBy("token", F.col("head").alias("group"), F.col("members").alias("group_members"), F.col("mass").alias("group_mass"), F.col("low").alias("group_low"), F.col("high").alias("group_high")).agg(F.min(at).alias("group_place"))
    smaller = (F.col("members") < F.col("group_members")) | ((F.col("members") == F.col("group_members")) & (F.col("head") > F.col("group")))
    bounds = {k: F.expr(x) for k, x in _bounds().items()}
    open_ = (F.col("head") != F.col("group")) & smaller & bounds["fits"] & bounds["early"]
    met = placed.join(unions.withColumnRenamed("token", "t"), (F.col("token") == F.col("t")) & open_).groupBy("rep", "n", F.col("group").alias("block"), "group_members", "group_mass", "group_low", "group_high").agg(F.count("*").alias("shared"))
    ask = cut(met.filter(F.col("shared") >= bounds["need"]).select("rep", "block", "group_members", "group_mass"), "ask")
    rounds = ask.groupBy("block").agg(F.count("*").alias("asking"), F.max(F.greatest(F.col("group_members") / PART, F.col("group_mass") / PART_TOKENS)).alias("size"))
    rounds = rounds.select("block", F.ceil(F.col("asking") / ASKING).cast("int").alias("turns"), F.ceil("size").cast("int").alias("parts"))
    place = lambda own, other, of: F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), of(F.pmod(F.xxhash64(F.col("id")), F.col(own)).cast("int")))).alias("part")
    # a group's part is held, the documents that ask stream past it
    opened = heads.select(F.col("rep").alias("id"), F.col("head").alias("block")).join(rounds, "block").select("block", place("parts", "turns", lambda own: lambda turn: own * F.col("turns") + turn), F.lit(1).alias("asks"), "id")
    asking = ask.select(F.col("rep").alias("id"), "block").join(rounds, "block").select("block", place("turns", "parts", lambda own: lambda part: part * F.col("turns") + own), F.lit(0).alias("asks"), "id")
    links = cut(compare(_with_text(opened.unionByName(asking), texts)), "links")
    head_of = lambda c, name: heads.select(F.col("rep").alias(c), F.col("head").alias(name))
    roots = components(links.join(head_of("asked", "a"), "asked").join(head_of("member", "b"), "member").select("a", "b")).withColumnRenamed("component", "root")
    final = heads.join(roots, F.col("head") == F.col("node"), "left").select(F.col("rep").alias("of"), F.coalesce("root", "head").alias("root"))
    numbers = cut(classes.select("digest", "least_id", "rep"), "numbers")
    grouped = numbers.join(final, F.col("rep") == F.col("of"), "left").select("digest", "least_id", F.coalesce("root", "rep").alias("root"))
    smallest = grouped.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component"))
    component = grouped.join(smallest, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "component")
    out = slim.join(component, F.col("digest") == F.col("d"), "left").select(F.col("given").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).cast(kind).alias("component_id"))
    drop_cut(classes, postings, placed, ask, texts, links)
    return out


def _with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts.select(F.col("rep").alias("of"), "text"), F.col("id") == F.col("of")).drop("of")
