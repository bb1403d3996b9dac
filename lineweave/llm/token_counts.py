"""Token counts: the exact number of byte-BPE tokens at every prefix of a text.

Inside a pre-token, dynamic programming over prefixes finds for each prefix its last token and its count: token t
may end prefix i if it is the whole prefix, or if the pair (last token of prefix i-len(t), t) is one that BPE leaves
unmerged. Exactly one t qualifies, so each prefix costs a few lookups and no prefix is encoded anew. Counts of
pre-tokens add up, so the table answers "how many tokens", "what fits a budget" and "how long is this cut"
from the stored counts.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WHITE = r"\t-\r \x85\xa0  -     　"
#: Fixed: how byte-level BPE of this family splits a text before merging.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space that a split at single spaces would divide otherwise than PRE_TOKEN.
BETWEEN = re.compile(r"\s \s")


def mixed(text: str) -> bool:
    return "  " in text or text[-1:].isspace() or BETWEEN.search(text) is not None


#: Distinct chunks that a worker remembers before it starts afresh.
REMEMBERED = 800_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """Remembers what of() gave for each key, afresh when full."""

    def __init__(self, of: Callable[[str], int]):
        self.of = of

    def __missing__(self, key: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.of(key)
        return value


class PrefixCounter:
    """Counts tokens at prefixes under the byte-BPE vocabulary file at path (tokenizers' JSON)."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.specials = [t["content"] for t in model["added_tokens"]]
        special = set(self.specials)
        self.vocabulary = {spell(s) for s in model["model"]["vocab"] if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.rank = {(spell(a), spell(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocabulary))
        self.split_special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self._stays: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._pre_tokens = Memory(lambda token: self.prefix_counts(token.encode())[-1])
        self._chunks = Memory(self._learn)
        self._spaced = Memory(lambda chunk: self._learn(" " + chunk))  # by the chunk without the space before it

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes; only tells which pairs of tokens stay apart."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _one(self, t: bytes) -> bool:
        if (known := self._whole.get(t)) is None:
            known = self._whole[t] = t in self.vocabulary and self.merged(t) == [t]
        return known

    def prefix_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for i = 0..len(data), as one pre-token."""
        counts, last, vocabulary, stays, longest = [0], [b""], self.vocabulary, self._stays, self.longest
        for i in range(1, len(data) + 1):
            for start in range(i - longest if i > longest else 0, i):
                t = data[start:i]
                if t in vocabulary:
                    if not start:
                        if self._one(t):
                            break
                    else:
                        pair = (last[start], t)
                        if (apart := stays.get(pair)) is None:
                            apart = stays[pair] = self.merged(pair[0] + t) == [*pair]
                        if apart:
                            break
            counts.append(counts[start] + 1)
            last.append(t)
        return counts

    def _learn(self, chunk: str) -> int:
        """Tokens of a piece of text whose pre-tokens don't depend on its surroundings."""
        known = self._pre_tokens
        if len(self._stays) >= REMEMBERED:
            self._stays.clear()
        return sum(map(known.__getitem__, PRE_TOKEN.findall(chunk)))

    def chunks(self, text: str) -> tuple[list[str], list[int], bool]:
        """A text without special tokens, cut where that can't change any pre-token: chunks, their tokens, whether a space before each but the first is left out."""
        if mixed(text):
            chunks = PRE_TOKEN.findall(text)
            return chunks, list(map(self._pre_tokens.__getitem__, chunks)), False
        chunks = text.split(" ")
        return chunks, [self._chunks[chunks[0]], *map(self._spaced.__getitem__, chunks[1:])], True

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special tokens: (part, whether it is a special token)."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str) -> int:
        return sum(1 if special else sum(self.chunks(part)[1]) for part, special in self.pieces(text))

    def table(self, text: str) -> list[int]:
        """Tokens of text[:i] for every i (code points); text holds no special token."""
        out, done, start, before = [0], 0, 0, ""
        for token in PRE_TOKEN.findall(text):
            blank = before.isspace() and token[0].isspace()
            base = done - self._pre_tokens[before] if blank else done  # a cut inside white space joins it into one pre-token
            if blank or token[0] == "'" and len(token) > 2:
                lead = before if blank else ""
                out += [base + sum(map(self._pre_tokens.__getitem__, PRE_TOKEN.findall(lead + token[:i]))) for i in range(1, len(token) + 1)]
                out[-1] = done + self._pre_tokens[token] if start + len(token) < len(text) and not token.isspace() else out[-1]
            else:
                counts, at = self.prefix_counts(token.encode()), 0
                for c in token:
                    at += len(c.encode())
                    out.append(base + counts[at])
            done, start, before = done + self._pre_tokens[token], start + len(token), token
        return out

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the code points of its longest prefix of at most budget tokens (cut inside the chunk that goes beyond it)."""
        total, fits, open_ = 0, 0, True
        for part, special in self.pieces(text):
            if special:
                total += 1
                open_ &= total <= budget
                fits += len(part) * open_
                continue
            chunks, counts, spaced = self.chunks(part)
            own = sum(counts)
            if open_ and total + own <= budget:
                fits += len(part)
            elif open_:
                open_ = False
                if not spaced:  # white space may join across any of these cuts
                    fits += max(i for i, n in enumerate(self.table(part)) if total + n <= budget)
                    total += own
                    continue
                upto = list(accumulate(counts, initial=total))
                k = bisect_right(upto, budget) - 1  # so many chunks fit as a whole
                chunk = " " * (k > 0) + chunks[k]
                fits += sum(map(len, chunks[:k])) + max(0, k - 1)
                fits += max((i for i, n in enumerate(self.table(chunk)) if upto[k] + n <= budget), default=0)
            total += own
        return total, fits


_counters: dict[str, PrefixCounter] = {}


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of df: (id, n_bytes, n_tokens, over_limit, fit_chars).

    fit_chars: code points of the longest prefix, cut within one chunk, that has at most ``limit`` tokens. A null text
    counts as empty (0 tokens). Repeated rows each give a row; an empty table gives none; other columns of df are not
    read. Long texts take time in proportion to their length. No shuffle; a worker's memory of chunks is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (counter := _counters.get(tokenizer_path)) is None:
            counter = _counters[tokenizer_path] = PrefixCounter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [counter.count_and_fit(t, limit) for t in texts]
            counts = [n for n, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array([f for _, f in found], pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
