"""Packing: documents' token ids cut into sequences of a fixed window, by Karmarkar-Karp multiway differencing.

Each task reads its documents once, in groups. Whole windows are cut off long documents; what remains of each is an
item. Differencing starts from one partial partition an item and always merges the two with the widest spread, the
fullest windows of one with the emptiest of the other, until one partition into near-equal windows is left. Where a
window would exceed the capacity, the window count rises and the group is partitioned again. Then the emptiest
windows are cut to fill the small gaps of the others, and what is left over is cut at powers of two, so that no
sequence needs padding.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lineweave.llm.common import ship
from lineweave.llm.token_counts import byte_letters

WINDOW = 2048
GROUP_DOCUMENTS, GROUP_TOKENS = 256, 4_000_000
REMEMBERED = 1_000_000

#: Text whose normal form is its lower case, and which only this splits: printable ASCII, Latin letters in composed form.
PLAIN = re.compile("[!-~À-ÖØ-öø-įıĲ-ſ]*")
#: Fixed: how the word vocabulary's file splits normalised text.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")
END_OF_WORD = "\x01"


class WordIds(dict):
    """Little-endian 32-bit ids of each white-space-free chunk of UTF-8, learned as they come."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str) -> tiktoken.Encoding | None:
        """The same merges for a library that is faster on single words; None if the file isn't of that form."""
        model = json.load(open(path, encoding="utf-8"))["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            return None
        letters, ranks = byte_letters(), {}
        for token, n in model["vocab"].items():
            body = token.removesuffix("</w>")
            if not token.startswith("<|") and all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + (END_OF_WORD.encode() if body != token else b"")] = n
        if sorted(ranks[bytes([b])] for b in range(256)) != [*range(256)]:
            return None
        return tiktoken.Encoding("words", pat_str=f"[^{END_OF_WORD}]+{END_OF_WORD}", mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _piece(self, piece: str) -> bytes:
        if (known := self.pieces.get(piece)) is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            known = self.pieces[piece] = b"".join(i.to_bytes(4, "little") for i in self.fast.encode_ordinary(piece + END_OF_WORD))
        return known

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = chunk.decode()
        if self.fast and "<|" not in text and PLAIN.fullmatch(text):
            value = b"".join(map(self._piece, PIECE.findall(text.lower())))
        else:
            value = self._encode(text)
        self[chunk] = value
        return value

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def partition(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: item numbers dealt into so many windows of near-equal sums."""
    partial = [(-n, k, [(0, ())] * (windows - 1) + [(n, (k,))]) for k, n in enumerate(sizes)]
    heapq.heapify(partial)
    while len(partial) > 1:
        _, k, a = heapq.heappop(partial)
        _, _, b = heapq.heappop(partial)
        both = sorted(((x + y, (own, other) if own and other else own or other) for (x, own), (y, other) in zip(a, reversed(b), strict=True)), key=itemgetter(0))
        heapq.heappush(partial, (both[0][0] - both[-1][0], k, both))

    def flat(own: tuple) -> list[int]:
        out, open_ = [], [own]
        while open_:
            x = open_.pop()
            if isinstance(x, int):
                out.append(x)
            else:
                open_.extend(reversed(x))
        return out

    return [flat(own) for _, own in partial[0][2]]


def near_equal(sizes: list[int], window: int) -> list[list[int]]:
    """Windows by differencing, as few as hold everything; one more each time that one exceeds the capacity."""
    windows = -(-sum(sizes) // window)
    while windows:
        found = partition(sizes, windows)
        if max(sum(sizes[k] for k in own) for own in found) <= window:
            return found
        windows += 1
    return []


Piece = tuple[int, int, int]  # item, start, length


def pack(lengths: list[int], window: int = WINDOW) -> list[list[Piece]]:
    """Sequences of pieces: every position of every item in exactly one, each sequence full or a power of two long."""
    out: list[list[Piece]] = []
    rest: list[tuple[int, int, int]] = []
    for k, n in enumerate(lengths):
        whole = n // window
        out += [[(k, i * window, window)] for i in range(whole)]
        if n % window:
            rest.append((k, whole * window, n % window))
    bins = [[rest[i] for i in own] for own in near_equal([n for *_, n in rest], window)]
    bins.sort(key=lambda own: sum(n for *_, n in own))
    spare: list[Piece] = []  # pieces of emptied windows
    gap = lambda own: window - sum(n for *_, n in own)
    low, high = 0, len(bins) - 1
    while low <= high:
        own, need = bins[high], gap(bins[high])
        high -= 1
        while need:
            if not spare:
                if low > high:
                    break
                spare, low = bins[low], low + 1
            k, at, n = spare.pop()
            take = min(n, need)
            own.append((k, at, take))
            need -= take
            if take < n:
                spare.append((k, at + take, n - take))
        if need:
            spare = own
        else:
            out.append(own)
    left = sum(n for *_, n in spare)
    while left:
        size = 1 << (left.bit_length() - 1)
        own, need = [], size
        while need:
            k, at, n = spare.pop()
            take = min(n, need)
            own.append((k, at, take))
            need -= take
            if take < n:
                spare.append((k, at + take, n - take))
        out.append(own)
        left -= size
    return out


_words: dict[str, WordIds] = {}


def encoder(path: str) -> Callable[[bytes], bytes]:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path].of


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids under the tokenizer, without special tokens added, and then ``end_id``; so a null or empty
    text is one token, and every row of df gives at least one piece. Repeated rows are packed as separate documents;
    ties in length keep the rows' order. An empty table gives no piece. Other columns aren't read. Each task packs its
    own documents in groups of bounded size, without a shuffle; sequence_id holds the task's number in its upper bits
    and is the same when a lost task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 36
        ids: list = []
        buffers: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths, rows = [len(b) // 4 for b in buffers], []
            for own in pack(lengths, window):
                offset = 0
                for k, start, n in own:
                    rows.append((ids[k], start, n, zlib.crc32(memoryview(buffers[k])[4 * start : 4 * (start + n)]), lengths[k], sequence, offset))
                    offset += n
                sequence += 1
            ids.clear()
            buffers.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_types, strict=True)], names=[id_col, *OUT])

        out_types = None
        held = 0
        for batch in batches:
            out_types = [batch.schema.field(0).type] + [pa.int64()] * len(OUT)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                buffers.append(encode(text or b"") + end)
                held += len(buffers[-1]) // 4
                if len(buffers) >= GROUP_DOCUMENTS or held >= GROUP_TOKENS:
                    yield flush()
                    held = 0
        if buffers:
            yield flush()

    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{c}` long" for c in OUT))


OUT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
