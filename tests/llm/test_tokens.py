"""Token counts, SentencePiece and packing against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lineweave.llm import packing, sentencepiece_lattice
from lineweave.llm.token_counts import PrefixCounter, count_tokens

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "b", " ", "'", "s", "re", "\n", "\t", "é", "ß", "1", "2.", ",!<", " 　", "漢字", "<|endoftext|>", "  ", "\n\n", " the", "ing", "'RE", "\x1c", "İ", "Σ", "e\u0301", "<|startoftext|>", "\x01"]
ROWS = [(1, None), (2, ""), (3, " \n "), (3, " \n "), (4, "x" * 5000), (5, "the cat " * 900), (6, "a<|endoftext|>b")]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 20))) for _ in range(n)]


def test_prefix_table():
    counter, library = PrefixCounter(BYTE), Tokenizer.from_file(BYTE)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in texts(400):
        assert counter.count(t) == size(t)
        if "<|endoftext|>" in t:
            continue
        table = [size(t[:i]) for i in range(len(t) + 1)]
        assert counter.table(t) == table
        for budget in range(5):
            assert counter.count_and_fit(t, budget) == (table[-1], max(i for i, n in enumerate(table) if n <= budget))


def test_count_tokens(spark):
    library = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted(tuple(r)[:4] for r in count_tokens(df, BYTE).collect())
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS]
    assert got == sorted((*w, w[2] > 512) for w in want)
    assert count_tokens(df.limit(0), BYTE).count() == 0


def test_words():
    own, library = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    assert own.fast
    for t in texts(1500, 2):
        assert np.frombuffer(own.of(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 1], [2047, 2], [700] * 40, [1, 2, 3, 4096, 2048, 2049, 31], list(range(1, 300))])
def test_pack(lengths):
    out = packing.pack(lengths)
    sizes = [sum(n for *_, n in own) for own in out]
    assert all(s == 2048 or s & s - 1 == 0 and s < 2048 for s in sizes) and sum(sizes) == sum(lengths)
    seen = {}
    for own in out:
        for k, at, n in own:
            assert n > 0
            seen.setdefault(k, []).append((at, n))
    for k, length in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[k]):
            assert start == at
            at += n
        assert at == length


def test_differencing_beats_spread():
    rng = random.Random(3)
    sizes = [rng.randint(1, 2047) for _ in range(200)]
    found = packing.partition(sizes, 100)
    sums = [sum(sizes[k] for k in own) for own in found]
    assert sorted(k for own in found for k in own) == [*range(200)]
    assert max(sums) - min(sums) < max(sizes)


def test_pack_documents(spark):
    library = Tokenizer.from_file(WORD)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("start", F.lit("x"))
    rows = packing.pack_documents(df, WORD).collect()
    left = {}
    for i, t in ROWS:
        left.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for r in rows:
        ids = left[r.doc_id][0][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(left[r.doc_id][0])
    assert sum(r.length for r in rows) == sum(len(x) for xs in left.values() for x in xs)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), WORD).count() == 0


def test_sentencepiece_is_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece_lattice, "COMMON", 40)  # so that most segments take the way of rare ones
    library, table = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_lattice.Pieces(PIECE)
    rows = [(100 + i, t) for i, t in enumerate(texts(80, 4))] + ROWS + [(7, "abcdefghij" * 30), (8, " " * 90), (9, "\n" + "q" * 90 + "  é")]
    segs = {s for _, t in rows for s in sentencepiece_lattice.segments(sentencepiece_lattice.normalized(t or ""), table.follows)}
    ids = {r.segment: r.ids for r in sentencepiece_lattice.encode_vocabulary(spark, spark.createDataFrame([(s,) for s in segs], "segment string"), PIECE).collect()}
    digests = {}
    for i, t in rows:
        at, all_ids, digest = 0, [], 0
        for s in sentencepiece_lattice.segments(sentencepiece_lattice.normalized(t or ""), table.follows):
            all_ids += ids[s]
            digest += sentencepiece_lattice.share(at, sentencepiece_lattice.code(ids[s]))
            at += len(s)
        assert all_ids == library.encode(t or "")
        assert sentencepiece_lattice.decode([library.id_to_piece(k) for k in all_ids]) == (t or "")
        digests.setdefault(i, []).append((len(all_ids), digest & sentencepiece_lattice.MASK, True))
    got = {}
    for r in sentencepiece_lattice.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PIECE).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_digest, r.round_trip))
    assert got == digests


def test_lattices_are_folded_in_small_slices():
    table = sentencepiece_lattice.Pieces(PIECE)
    pieces = {p: (s, i) for p, i, s in table.rows}
    segs = [f"\u2581word{k}" for k in range(600)] + ["\u2581" + "long" * 20] * 40
    edges = [[dict(zip(("first", "last", "score", "id"), (a, z, *pieces[s[a:z]]))) for a in range(len(s)) for z in range(a + 1, len(s) + 1) if s[a:z] in pieces] if len(s) <= sentencepiece_lattice.LONGEST else [] for s in segs]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("id", pa.int32())]))
    part = pa.RecordBatch.from_arrays([pa.array(segs), pa.array([1] * len(segs), pa.int64()), pa.array(edges, kind)], names=["segment", "n", "edges"])
    out = [*sentencepiece_lattice.fold(iter([part]), PIECE, table.bytes)]
    assert max(x.num_rows for x in out) <= 256 and [s for x in out for s in x.column(0).to_pylist()] == segs
    assert [i for x in out for i in x.column(1).to_pylist()] == [table.model.encode(s[1:]) for s in segs]


def test_words_and_segments_of_slices():
    cutter = sentencepiece_lattice.Cutter(sentencepiece_lattice.Pieces(PIECE).follows)
    bodies = ["", " ", "a  b", "a b. b", "x\u2581y", " a", "b ", *texts(300, 12)]
    words, places, sizes = cutter.coded(pa.array(bodies, pa.string()))
    assert [words[k].as_py() for k in places] == [w for t in bodies for w in cutter.words(t)] and sizes.tolist() == [len(cutter.words(t)) for t in bodies]
    segs, counts, chars = cutter.segments(words)
    words, segs = words.to_pylist(), segs.to_pylist()
    assert chars.tolist() == [*map(len, segs)] and segs == [s for w in words for s in sentencepiece_lattice.segments(w, cutter.follows)]
    assert counts.tolist() == [len(sentencepiece_lattice.segments(w, cutter.follows)) for w in words]


def test_lattice_rows_need_no_grouping(spark):
    """A lattice's edges reach the fold as they are joined: no aggregation holds or sorts them, in whatever batches they come."""
    table = sentencepiece_lattice.Pieces(PIECE)
    pieces = {p: i for p, i, _ in table.rows}
    segs = [*{s for t in texts(200, 21) for s in sentencepiece_lattice.segments(sentencepiece_lattice.normalized(t), table.follows)}]
    rows = []
    for k, s in enumerate(segs):
        rows += [(k, s, 1, 0, 0, -1)] + [(k, None, None, a, z, pieces[s[a:z]]) for a in range(len(s)) for z in range(a + 2, len(s) + 1) if s[a:z] in pieces]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["number", "segment", "n", "first", "last", "id"])
    want = {s: r.ids for s, r in ((r.segment, r) for r in sentencepiece_lattice.encode_vocabulary(spark, spark.createDataFrame([(s,) for s in segs], "segment string"), PIECE).collect())}
    for size in (1, 7, len(rows)):
        out = [*sentencepiece_lattice.fold_rows((whole.slice(k, size) for k in range(0, len(rows), size)), PIECE, 50)]
        assert [s for x in out for s in x.column(0).to_pylist()] == segs and [i for x in out for i in x.column(1).to_pylist()] == [want[s] for s in segs]
    with pytest.raises(RuntimeError):
        [*sentencepiece_lattice.fold_rows(iter([whole.take([*range(1, len(rows)), 0])]), PIECE)]
    plan = sentencepiece_lattice.encode_vocabulary(spark, spark.createDataFrame([("a",)], "segment string"), PIECE)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan


def test_sentencepiece_ids_and_back(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece_lattice, "COMMON", 40)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(100 + i, t) for i, t in enumerate(texts(60, 9))] + ROWS + [(7, "abcdefghij" * 30), (8, "a\u2581b"), (9, "\u2581"), (10, "a  b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = sentencepiece_lattice.encode_ids(df, PIECE)
    assert sorted((r.doc_id, r.text, r.ids) for r in encoded.collect()) == sorted((i, t or "", library.encode(t or "")) for i, t in rows)
    back = sentencepiece_lattice.decode_ids(encoded.drop("text"), PIECE)
    assert sorted((r.doc_id, r.decoded) for r in back.collect()) == sorted((i, (t or "").replace("\u2581", " ")) for i, t in rows)
    # a literal mark comes back as a space
    assert {r.doc_id for r in sentencepiece_lattice.encode_documents(df, PIECE).collect() if not r.round_trip} == {8, 9}
    assert sentencepiece_lattice.encode_documents(df.limit(0), PIECE).count() == 0


def test_viterbi(spark):
    """The unigram fold against every segmentation."""
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -6.0, "bc": -1.2, "c": -3.0}
    table = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(pieces.items())], "piece string, id int, score double")
    words = ["abc", "aabbcc", "cab", "abcabc", "xab"]
    found = sentencepiece_lattice.edges(spark.createDataFrame([(w,) for w in words], "segment string"), table, 3)
    got = {r.segment: r.ids for r in found.select("segment", sentencepiece_lattice.viterbi(F.col("edges"), F.char_length("segment")).alias("ids")).collect()}
    names = [*pieces]

    def best(w):
        if not w:
            return 0.0
        return max([pieces[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces] + [-100.0 + best(w[1:])])

    for w in words:
        assert abs(sum(pieces[names[i]] if i >= 0 else -100.0 for i in got[w]) - best(w)) < 1e-9
