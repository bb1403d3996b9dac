"""Repeats, near copies and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lineweave.llm import jaccard_join
from lineweave.llm.common import cut
from lineweave.llm.jaccard_join import join_groups
from lineweave.llm.suffix_dedup import remove_repeats


def brute_repeats(rows, m):
    at = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        at.update(b[p : p + m] for p in range(len(b) - m + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - m + 1):
            if at[b[p : p + m]] > 1:
                gone[p : p + m] = b"\1" * m
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdé ", k=rng.randint(0, 400))) for _ in range(10)]
    rows = []
    for i in range(40):
        t = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            t += x[a : rng.randint(a, len(x))] + "".join(rng.choices("xyz", k=rng.randint(0, 30)))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "a" * 3000), (103, "ab" * 300), (104, rows[3][1]), (104, rows[3][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("core", F.lit(0))
    got = remove_repeats(df, match=32).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_repeats(rows, 32)
    assert remove_repeats(df.limit(0)).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = [*range(len(rows))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least[find(a)], i)
    return sorted([(i, len(sets[a]), None if i is None else least[find(a)]) for a, (i, _) in enumerate(rows)], key=str)


def near_copy_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage, rows = rng.choices(words, k=60), []
    for _ in range(14):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 30, 80, 200]))
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3 and len(w) > 100:
                w += passage
            rows.append((1000 - len(rows), (" " if rng.random() < 0.5 else "\n").join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows + [(5, None), (6, ""), (7, " \n"), (None, rows[0][1]), (8, rows[2][1]), (8, rows[9][1]), (8, rows[9][1]), (9, "a b"), (10, "A B"), (11, "a\xa0b c d e")]


def test_near_copies(spark, monkeypatch):
    rows = near_copy_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(0))
    want = brute_groups(rows)
    assert sorted((tuple(r) for r in join_groups(df).collect()), key=str) == want
    # the matrix alone, in parts of two: no grouping by minimum hash before it
    monkeypatch.setattr(jaccard_join, "PART", 2)
    monkeypatch.setattr(jaccard_join, "ASKING", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "SHORT", 20)
    monkeypatch.setattr(jaccard_join, "LEVELS", (2, 3, 5))
    monkeypatch.setattr(jaccard_join, "PART_TOKENS", 100)
    assert sorted((tuple(r) for r in join_groups(df).collect()), key=str) == want


def test_edited_copies_meet_in_one_group(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(80):  # any two differ too much to link, but each links with the text itself, which has the last id
        w = list(base)
        for k, at in enumerate(rng.sample(range(5, 140), 3)):
            w[at] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    rows.append((80, " ".join(base)))
    kept = {}
    monkeypatch.setattr(jaccard_join, "cut", lambda df, name: kept.setdefault(name, []).append(cut(df, name)) or kept[name][-1])
    monkeypatch.setattr(jaccard_join, "drop_cut", lambda *tables: None)
    monkeypatch.setattr(jaccard_join, "LEADERS", 4)
    got = join_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_groups(rows)
    assert kept["heads"][-1].filter("rep = head").count() <= 8 and kept["ask"][0].count() <= 2 * len(rows)


def test_no_rows(spark):
    assert join_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline(spark):
    rng = random.Random(8)
    vocabulary = ["the", "and", "of", "to", "in", "is", "that", "for", "it", "was"] + [f"{a}{b}" for a in ("lo", "mi", "ra", "ten", "sul") for b in ("na", "ver", "dor", "lith", "ka")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, "\n".join([prose(40) + ".", prose(60) + ".", "A line on every page."]), "en", "site", 0) for i in range(60)]
    passage = prose(120)
    rows += [(100, rows[3][1], "en", "site", 0), (101, "more " + rows[4][1], "en", "site", 0)]
    rows += [(110 + k, prose(50) + " " + passage + " " + prose(50), "en", None, 0) for k in range(2)]
    rows += [(200, "too short", "en", "site", 0), (201, " ".join(f"x{k}$$$ y{k}%%% z{k}&&&" for k in range(80)), "en", "site", 0), (202, None, None, None, None), (100, rows[3][1], "en", "site", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, ""), "test")
        out[name] = docs.collect()
    ids = lambda name: sorted(r.doc_id for r in out[name])
    assert not {200, 201, 202} & set(ids("quality")) and set(range(60)) <= set(ids("quality"))
    assert all("every page" not in r.text for r in out["lines"] if r.source == "site") and all(r.n_chars == len(r.text) for r in out["lines"])
    assert ids("near copies") == [*range(60), 110, 111]
    assert [r.text for r in out["repeats"] if passage in r.text] == [] and len(out["repeats"]) == 62
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in out["packing"]) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in out["repeats"])
