"""SentencePiece encoding and decoding over a relational lattice.

The text is cut where no piece can lie across: a pair of neighbouring characters that stands in no piece is a safe cut.
The distinct segments between cuts explode into their substrings of bounded length, an equi-join with the piece table
keeps those that are pieces, and the edges of a segment are grouped into its lattice. The lattice is then folded:

*   for a unigram model by Viterbi, with Spark's higher-order aggregate, as the path of greatest score;
*   for a BPE model by its merges. Viterbi can't give the library's ids there: BPE joins the best pair of neighbours
    again and again, and the path of greatest score is often another one.

The encodings of the commonest segments, a fixed number, go to every task; those of the others are joined to the
documents that hold them. A document's ids are those of its segments in their order; decoding takes them back to text.
Python works on whole slices of documents or segments at a time, as arrays: no string is made for a word or segment of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lineweave.llm.common import cut, drop_cut, slices, text_or_empty

SPACE = "▁"
#: The commonest segments, whose encodings every task may hold: at most so many of at most so many characters.
COMMON, LONGEST_COMMON = 200_000, 48
#: Segments longer than this (text without cuts) aren't exploded but encoded by the library itself.
LONGEST = 64
MASK = (1 << 40) - 1
#: Segments that a task counts before it tells them; documents that it takes at a time, and bytes.
COUNTED, TAKEN, TAKEN_BYTES = 150_000, 2048, 6 << 20


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        kinds = (self.model.is_control, self.model.is_unknown, self.model.is_unused, self.model.is_byte)
        normal = [i for i in range(n) if not any(k(i) for k in kinds)]
        self.rows = [(self.model.id_to_piece(i), i, float(self.model.get_score(i))) for i in normal]
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        pairs = {p[i : i + 2] for p, *_ in self.rows for i in range(len(p) - 1)}
        follows: dict[str, list[str]] = {}
        for a, b in sorted(pairs):
            follows.setdefault(a, []).append(b)
        self.follows = {a: "".join(bs) for a, bs in follows.items()}
        self.longest = max(len(p) for p, *_ in self.rows)


def normalized(text: str) -> str:
    """What a model without normalisation sees: a space in front, spaces marked. An empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def segments(text: str, follows: dict[str, str]) -> list[str]:
    """The marked text cut at every pair of characters that no piece holds."""
    out, start = [], 0
    for i in range(1, len(text)):
        if text[i] not in follows.get(text[i - 1], ""):
            out.append(text[start:i])
            start = i
    if text:
        out.append(text[start:])
    return out


WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... (sizes[0] of them), then those from starts[1] on, and so forth."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Cutter:
    """Texts -> their words (marked spaces and what follows them), and words -> their segments."""

    def __init__(self, follows: dict[str, str]):
        self.follows = follows
        self.safe = not any(SPACE in bs for a, bs in follows.items() if a != SPACE)
        chars = sorted({*follows, *"".join(follows.values())})
        self.place = np.zeros(0x110000, np.uint16 if len(chars) < 65535 else np.uint32)  # 0: in no pair
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, bs in follows.items():
            self.joined[self.place[ord(a)], self.place[[ord(b) for b in bs]]] = True

    def segments(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The segments of words, none of them empty, one word after the other; how many each word has; their characters."""
        if not len(words):
            return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = code_points(str(_bytes(words), "utf-8"))
        place = self.place[points]
        first = np.ones(len(place) + 1, bool)
        first[1:-1] = ~self.joined[place[:-1], place[1:]]
        wide = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64))
        begins = np.cumsum(sizes := pc.utf8_length(words).to_numpy().astype(np.int64)) - sizes
        first[begins] = True
        at = np.flatnonzero(first)
        ends = np.concatenate([[0], wide])[at].astype(np.int32)
        segs = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends), pa.py_buffer(_bytes(words)))
        return segs, np.add.reduceat(first[:-1], begins, dtype=np.int64), np.diff(at)

    def words(self, text: str) -> list[str]:
        marked = normalized(text)
        return WORD.findall(marked) if self.safe else [marked] if marked else []

    def coded(self, bodies: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words that hold every word of the texts, the texts' words as places in that list, and each text's number of words.

        Texts of single spaces between words are split and numbered by Arrow, the others by ``words``.
        """
        odd = pc.or_(pc.or_(pc.match_substring(bodies, "  "), pc.match_substring(bodies, SPACE)), pc.or_(pc.starts_with(bodies, " "), pc.equal(bodies, "")))
        odd = odd.to_numpy(zero_copy_only=False) if self.safe else np.ones(len(bodies), bool)
        parted = pc.split_pattern(bodies.filter(pa.array(~odd)) if odd.any() else bodies, " ")
        numbered = parted.flatten().dictionary_encode()
        words = pc.binary_join_element_wise(SPACE, numbered.dictionary, "")
        own, indices = pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64), numbered.indices.to_numpy(zero_copy_only=False)
        if not odd.any():
            return words, indices, own
        others = [self.words(t) for t in bodies.filter(pa.array(odd)).to_pylist()]
        number: dict[str, int] = {}
        late = np.array([number.setdefault(w, len(number)) for found in others for w in found], np.int64) + len(words)
        sizes = np.zeros(len(bodies), np.int64)
        sizes[~odd], sizes[odd] = own, [len(found) for found in others]
        begins = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        out[spread(begins[~odd], own)] = indices
        out[spread(begins[odd], sizes[odd])] = late
        return pa.concat_arrays([words, pa.array([*number], pa.string())]), out, sizes


def _bytes(texts: pa.Array) -> memoryview:
    """The bytes of texts, one after the other."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    return memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]


def lattice(words: DataFrame, pieces: DataFrame, longest: int, shortest: int = 1) -> DataFrame:
    """words (segment and other columns) with first, last, score, id: a row for each of the segment's substrings of at least
    ``shortest`` characters that is a piece, by an equi-join, and one for an empty substring, without id. Segments
    of over LONGEST characters have only that one.

    first and last are character places, last exclusive. pieces is as large as the model, whatever the corpus. Nothing is
    shuffled: a segment's rows stay together, the empty substring's first.
    """
    n = F.char_length("segment")
    starts = words.select("*", F.explode(F.when(n <= LONGEST, F.sequence(F.lit(-1), n - 1)).otherwise(F.array(F.lit(-1)))).alias("first"))
    sizes = F.when(F.col("first") < 0, F.array(F.lit(0))).when(n - F.col("first") >= shortest, F.sequence(F.lit(shortest), F.least(F.lit(longest), n - F.col("first"))))
    spans = starts.select("*", F.explode(sizes).alias("size"))
    cut_out = spans.select(*words.columns, F.greatest("first", F.lit(0)).alias("first"), "size", F.expr("substring(segment, first + 1, size)").alias("piece"))
    empty = pieces.limit(1).select(F.lit("").alias("piece"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("double").alias("score"))
    met = cut_out.join(F.broadcast(pieces.filter("piece <> ''").unionByName(empty)), "piece")
    return met.select(*words.columns, "first", (F.col("first") + F.col("size")).alias("last"), "score", "id")


def edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """words (segment and other keys) with edges: array of (first, last, score, id), the rows of ``lattice`` that have an id."""
    edge = F.when(F.col("id").isNotNull(), F.struct("first", "last", "score", "id"))
    return lattice(words, pieces, longest).groupBy(*words.columns).agg(F.collect_list(edge).alias("edges"))


def viterbi(edges_col: Column, n: Column, unknown: float = -100.0) -> Column:
    """Ids of the path of greatest score through a lattice of n characters (ties: the shorter last piece first); a
    character that no piece spells is an unknown step of its own (id -1)."""
    state = "array<struct<best:double,back:int,id:int>>"

    def step(done: Column, last: Column) -> Column:
        into = F.filter(edges_col, lambda e: e["last"] == last)
        ways = F.transform(into, lambda e: F.struct((F.get(done, e["first"])["best"] + e["score"]).alias("best"), e["first"].alias("back"), e["id"].alias("id")))
        skip = F.struct((F.get(done, last - 1)["best"] + F.lit(unknown)).alias("best"), (last - 1).alias("back"), F.lit(-1).alias("id"))
        return F.concat(done, F.array(F.array_max(F.concat(ways, F.array(skip)).cast(state))))

    start = F.array(F.struct(F.lit(0.0).alias("best"), F.lit(-1).alias("back"), F.lit(-1).alias("id"))).cast(state)
    table = F.aggregate(F.sequence(F.lit(1), n), start, step)
    walk = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"), table.alias("table"))

    def back(w: Column, _: Column) -> Column:
        here = F.get(w["table"], w["at"])
        return F.when(w["at"] <= 0, w).otherwise(F.struct(here["back"].alias("at"), F.concat(F.array(here["id"]), w["ids"]).alias("ids"), w["table"].alias("table")))

    return F.aggregate(F.sequence(F.lit(1), n), walk, back, lambda w: w["ids"])


def width(model: sentencepiece.SentencePieceProcessor) -> str:
    """The numbers that ids are packed as."""
    return "<u2" if model.get_piece_size() <= 1 << 16 else "<i4"


class Merger:
    """BPE over the lattices of many segments: the best edge over two neighbours joins them, the leftmost of equals, until
    none does. Segments of equal length take their steps together."""

    def __init__(self, path: str):
        table = Pieces(path)
        self.longest, self.bytes, self.model, self.width = table.longest, table.bytes, table.model, width(table.model)
        scores = np.full(table.model.get_piece_size(), -np.inf)
        scores[[i for _, i, _ in table.rows]] = [x for *_, x in table.rows]
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores have equal ranks
        self.single = {p: i for p, i, _ in table.rows if len(p) == 1}

    def spell(self, segment: str) -> list[int]:
        return [y for x in segment for y in ([self.single[x]] if x in self.single else [self.bytes[z] for z in x.encode()])]

    def fold(self, segs: list[str], of: np.ndarray, first: np.ndarray, last: np.ndarray, piece: np.ndarray) -> list[list[int]]:
        """The ids of each segment; edge k lies in segment of[k]. Single characters need no edge."""
        sizes = np.fromiter(map(len, segs), np.int64, len(segs))
        out: list[list[int]] = [[]] * len(segs)
        long = last - first > 1
        of, first, last, piece = of[long], first[long], last[long], piece[long]
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            if n > LONGEST:
                for k in own.tolist():
                    out[k] = self._whole(segs[k])
                continue
            row = np.full(len(segs), -1, np.int64)
            row[own] = np.arange(len(own))
            mine = row[of] >= 0
            found = np.full((len(own), n + 1, self.longest + 1), -1, np.int32)  # by row, first place, number of characters
            found[row[of[mine]], first[mine], (last - first)[mine]] = piece[mine]
            for k, ids in zip(own.tolist(), self._steps([segs[k] for k in own.tolist()], n, found), strict=True):
                out[k] = ids
        return out

    def _steps(self, segs: list[str], n: int, found: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(segs)
        who, cuts, worst = np.arange(len(segs)), np.tile(np.arange(n + 1), (len(segs), 1)), np.iinfo(np.int32).max
        while len(who):
            m = cuts.shape[1]
            if m > 2:
                width = cuts[:, 2:] - cuts[:, :-2]
                ways = found[who[:, None], cuts[:, :-2], np.minimum(width, self.longest)]
                ranks = np.where((ways >= 0) & (width <= self.longest), self.rank[ways], worst)
                best = ranks.argmin(1)
                on = ranks[np.arange(len(who)), best] < worst
            else:
                on = np.zeros(len(who), bool)
            for k, own in zip(who[~on].tolist(), cuts[~on].tolist(), strict=True):
                ids = []
                for a, b in zip(own, own[1:], strict=False):
                    ids += [int(found[k, a, b - a])] if b - a > 1 else self.spell(segs[k][a:b])
                out[k] = ids
            if not on.any():
                break
            stay = np.ones((int(on.sum()), m), bool)
            stay[np.arange(len(stay)), best[on] + 1] = False
            who, cuts = who[on], cuts[on][stay].reshape(-1, m - 1)
        return out

    def _whole(self, segment: str) -> list[int]:
        if segment.startswith(SPACE):  # the library puts a space in front, which is not the segment's
            return self.model.encode(segment.replace(SPACE, " ")[1:])
        return self.model.encode("\n" + segment.replace(SPACE, " "))[2:]  # behind a line break, which no piece joins to anything


def decode(pieces: list[str]) -> str:
    """The text that pieces spell: byte pieces joined to characters, marks to spaces, without the space put in front."""
    raw = b"".join(bytes([int(p[3:5], 16)]) if BYTE.fullmatch(p) else p.encode() for p in pieces)
    return raw.decode(errors="replace").replace(SPACE, " ").removeprefix(" ")


BYTE = re.compile("<0x[0-9A-F]{2}>")
_cutters: dict[str, Cutter] = {}


def _cutter(path: str) -> Cutter:
    if path not in _cutters:
        _cutters[path] = Cutter(Pieces(path).follows)
    return _cutters[path]


_mergers: dict[str, Merger] = {}


def _merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def code(ids: list[int]) -> int:
    return _code(b"".join(i.to_bytes(4, "little") for i in ids))


def _code(packed: bytes | memoryview) -> int:
    return xxhash.xxh3_64_intdigest(packed) & MASK


def share(offset, coded):
    """What a segment at a place adds to a document's digest; of numbers, or of arrays of 64 unsigned bits."""
    return (offset * 0x9E3779B1 ^ coded) & MASK


def _told(segs: list[str], n: pa.Array, ids: list[list[int]], kind: str) -> pa.RecordBatch:
    packed = [np.array(x, kind).tobytes() for x in ids]
    return pa.RecordBatch.from_arrays([pa.array(segs, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(packed, pa.binary()), n], names=["segment", "ids", "packed", "n"])


def fold(parts: Iterator[pa.RecordBatch], path: str, byte_ids: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches of (segment, n, edges), as ``edges`` groups them, as (segment, ids, packed, n), in small slices."""
    merger = _merger(path)
    merger.bytes = byte_ids
    for part in slices(parts):
        found = part.column(2)
        own = found.flatten()  # of this slice
        first, last, _, piece = (own.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        of = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        segs = part.column(0).to_pylist()
        yield _told(segs, part.column(1), merger.fold(segs, of, first, last, piece), merger.width)


def fold_rows(parts: Iterator[pa.RecordBatch], path: str, some: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of (number, segment, n, first, last, id), the rows of ``lattice``, as (segment, ids, packed, n). A segment's number is
    its own and rises from one to the next; segment and n stand in its first row only. ``some``: segments at a time."""
    merger, kept = _merger(path), None
    step, before = 16 * some, -1

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        heads = pc.is_valid(rows.column(1)).to_numpy(zero_copy_only=False)
        tail = rows.filter(pa.array(~heads))
        heads_only = rows.filter(pa.array(heads))
        of = (np.cumsum(heads) - 1)[~heads]
        segs = heads_only.column(1).to_pylist()
        return _told(segs, heads_only.column(2), merger.fold(segs, of, *(tail.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))), merger.width)

    for part in parts:
        for at in range(0, part.num_rows, step):
            rows = part.slice(at, step)
            number, heads = rows.column(0).to_numpy(), pc.is_valid(rows.column(1)).to_numpy(zero_copy_only=False)
            if number[0] < before or (np.diff(number, prepend=before) > 0).tolist() != heads.tolist():
                raise RuntimeError("the rows of a segment don't stand together")
            before = int(number[-1])
            if kept is not None:
                rows = pa.Table.from_batches([kept, rows]).combine_chunks().to_batches()[0]
                heads = pc.is_valid(rows.column(1)).to_numpy(zero_copy_only=False)
            split = int(np.flatnonzero(heads)[-1])  # the last segment may go on in the next rows
            if split:
                yield told(rows.slice(0, split))
            kept = rows.slice(split)
    if kept is not None:
        yield told(kept)


def encode_vocabulary(spark: SparkSession, vocabulary: DataFrame, path: str) -> DataFrame:
    """(segment, ids, packed: the ids as bytes, n) of every distinct segment."""
    table = Pieces(path)
    pieces = spark.createDataFrame(table.rows, "piece string, id int, score double")
    n = F.col("n") if "n" in vocabulary.columns else F.lit(1).cast("long")
    numbered = vocabulary.select(F.monotonically_increasing_id().alias("number"), "segment", n.alias("n"))
    head = F.col("id").isNull()
    rows = lattice(numbered, pieces, table.longest, 2).select("number", F.when(head, F.col("segment")).alias("segment"), F.when(head, F.col("n")).alias("n"), "first", "last", F.coalesce("id", F.lit(-1)).alias("id"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold_rows(parts, path)

    return rows.mapInArrow(run, "segment string, ids array<int>, packed binary, n long")


class Common:
    """The encodings of the commonest segments, as a few arrays."""

    def __init__(self, segs: list[str], packed: list[bytes], kind: str):
        self.segs = segs
        self.ids = np.frombuffer(b"".join(packed), kind).astype("<i4")
        self.sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(kind).itemsize
        ends = (4 * np.cumsum(self.sizes)).tolist()
        view = memoryview(self.ids.tobytes())
        self.codes = np.array([_code(view[a:b]) for a, b in zip([0, *ends], ends, strict=False)], np.uint64)


def encode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id, text, ids, ids_digest), with the ids in the order of the text.

    ids_digest adds a hash of each segment's place and ids, modulo 2^40. A null text is empty: no id. Repeated rows each
    give their row; an empty table gives none; other columns aren't read. Segments of over LONGEST characters go to the
    library.
    """
    spark = df.sparkSession
    text = text_or_empty(text_col)
    kind, packing = dict(df.dtypes)[id_col], width(sentencepiece.SentencePieceProcessor(model_file=model_path))
    # rows that share a key only share what is looked up for them
    docs = df.select(F.col(id_col).alias("given"), text.alias("own_text"), F.xxhash64(F.col(id_col), text).alias("row_key"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter_, found, new, waiting = _cutter(model_path), None, [], 0

        def merged() -> pa.Table:
            whole = pa.concat_tables([*([] if found is None else [found]), *new])
            new.clear()
            return whole.group_by("segment", use_threads=False).aggregate([("n", "sum")]).rename_columns(["segment", "n"])

        for part in slices(parts, TAKEN, TAKEN_BYTES):
            words, places, _ = cutter_.coded(part.column(0))
            segs, sizes, _ = cutter_.segments(words)
            new.append(pa.table({"segment": segs, "n": pa.array(np.repeat(np.bincount(places, minlength=len(words)), sizes), pa.int64())}))
            waiting += len(segs)
            if waiting > 2 * COUNTED:
                found, waiting = merged(), 0
                if len(found) > COUNTED:
                    yield from found.to_batches()
                    found = None
        if new or found is not None:
            yield from merged().to_batches()

    vocabulary = docs.select("own_text").mapInArrow(count, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    encoded = cut(encode_vocabulary(spark, vocabulary, model_path).drop("ids"), "encoded", codec="zstd")
    common = encoded.filter(F.char_length("segment") <= LONGEST_COMMON).orderBy(F.desc("n"), "segment").limit(COMMON)
    known = common.select("segment", "packed").toArrow()
    shared = spark.sparkContext.broadcast(Common(known.column(0).to_pylist(), known.column(1).to_pylist(), packing))  # COMMON entries at most
    del known

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments of each row that aren't among the common ones."""
        cutter_, held = _cutter(model_path), pa.array(shared.value.segs, pa.string())
        for part in slices(parts, TAKEN, TAKEN_BYTES):
            words, places, sizes = cutter_.coded(part.column(1))
            segs, counts, _ = cutter_.segments(words)
            unheld = pc.invert(pc.is_in(segs, value_set=held))
            number = segs.filter(unheld).dictionary_encode()
            own, rare = number.indices.to_numpy(zero_copy_only=False), _sums(unheld.to_numpy(zero_copy_only=False).astype(np.int64), counts)
            some = rare[places] > 0
            row, at = np.repeat(np.arange(len(sizes)), sizes)[some], places[some]
            of = max(1, len(number.dictionary))
            pairs = np.unique(np.repeat(row, rare[at]) * of + own[spread((np.cumsum(rare) - rare)[at], rare[at])])
            row, at = np.divmod(pairs, of)
            keys = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row], pa.int64()), number.dictionary.take(pa.array(at))], names=["row_key", "segment"])

    cold = docs.select("row_key", "own_text").mapInArrow(look_up, "row_key long, segment string")
    met = cold.join(encoded.select("segment", "packed"), "segment")
    rest = cut(met.groupBy("row_key").agg(F.collect_list(F.struct("segment", "packed")).alias("rare")), "rare", codec="zstd")
    drop_cut(encoded)

    def shrink(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts compressed, for the shuffle."""
        for part in slices(parts):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_small(x) for x in part.column(2).to_pylist()], pa.binary())], names=["given", "row_key", "small"])

    small = docs.select("given", "row_key", "own_text").mapInArrow(shrink, f"given {kind}, row_key long, small binary")
    dealt = small.join(rest.hint("shuffle_hash"), "row_key", "left").select("given", "small", "rare.segment", "rare.packed")

    def assemble(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of the words of each row, put together in their order."""
        cutter_, base = _cutter(model_path), shared.value
        held = pa.array(base.segs, pa.string())
        for part in slices(parts, TAKEN // 2, TAKEN_BYTES // 4):
            bodies = pa.array([_large(x) for x in part.column(1).to_pylist()], pa.string())
            words, places, sizes = cutter_.coded(bodies)
            segs, counts, chars = cutter_.segments(words)
            packed = dict(zip(part.column(2).flatten().to_pylist(), part.column(3).flatten().to_pylist(), strict=True))
            which = pc.index_in(segs, value_set=held)
            own = pc.add(pc.index_in(segs, value_set=pa.array([*packed], pa.string())), pa.scalar(len(held), pa.int32()))
            which = pc.coalesce(which, own).to_numpy()  # every segment is among one of both
            more = Common([], [*packed.values()], packing)
            flat, each = np.concatenate([base.ids, more.ids]), np.concatenate([base.sizes, more.sizes])
            begins, codes = np.cumsum(each) - each, np.concatenate([base.codes, more.codes])[which]
            at = spread((np.cumsum(counts) - counts)[places], counts[places])  # every segment of the texts, in order
            per_row = _sums(counts[places], sizes)
            ends = np.cumsum(chars[at])
            starts = np.cumsum(per_row) - per_row  # of the rows, among the segments
            before = np.concatenate([[0], ends])[starts]
            offsets = (ends - chars[at] - np.repeat(before, per_row)).astype(np.uint64)
            digests = _sums(share(offsets, codes[at]), per_row) & np.uint64(MASK)
            kinds = which[at]
            ids = flat[spread(begins[kinds], each[kinds])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_sums(each[kinds], per_row))]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), bodies, lists, pa.array(digests.astype(np.int64))], names=["given", "own_text", "ids", "ids_digest"])

    return dealt.mapInArrow(assemble, f"given {kind}, own_text string, ids array<int>, ids_digest long").select(F.col("given").alias(id_col), F.col("own_text").alias(text_col), "ids", "ids_digest")


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of so many values, one after the other; of no values 0. Unsigned numbers wrap around."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[ends] - total[ends - sizes]


_zstd = pa.Codec("zstd", 9)


def _small(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def _large(small: bytes) -> str:
    return _zstd.decompress(small[8:], int.from_bytes(small[:8], "little"), asbytes=True).decode()


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with one more column, the text that the ids of each row spell; control pieces spell nothing."""
    schema = StructType([*df.schema.fields, StructField(to, StringType())])
    place, names = df.columns.index(ids_col), [*df.columns, to]

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(model_path)
        raw = [b""] * table.model.get_piece_size()
        for p, i, _ in table.rows:
            raw[i] = p.encode()
        for value, i in enumerate(table.bytes):
            raw[i] = bytes([value])
        spelt = pa.array(raw, pa.large_binary())
        for part in slices(parts, TAKEN // 2, TAKEN_BYTES):
            lists = part.column(place)
            said = spelt.take(lists.flatten())  # the bytes of all rows, one after the other
            ends = np.frombuffer(said.buffers()[1], np.int64, len(said) + 1, 8 * said.offset)
            ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])].tolist()
            whole = said.buffers()[2].to_pybytes() if said.buffers()[2] else b""
            texts = [whole[a:b].decode(errors="replace").replace(SPACE, " ").removeprefix(" ") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(spell, schema)


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id, n_tokens, ids_digest, round_trip), from the ids of ``encode_ids``; round_trip: whether
    ``decode_ids`` gives the text back. A text with a literal U+2581 doesn't come back, for it decodes to a space."""
    back = decode_ids(encode_ids(df, model_path, id_col, text_col), model_path)
    return back.select(id_col, F.size("ids").cast("long").alias("n_tokens"), "ids_digest", (F.col("decoded") == F.col(text_col)).alias("round_trip"))
