"""Quality rules, line dedup, licenses, fingerprints and chats against brute force."""

import hashlib
import random
import re
import string
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from lineweave.llm import chat_format, license_scan, line_dedup, quality_rules, queries, spot_signatures

from ..conftest import SMALL
from ..oracle import compare

WORDS = r"[^\x20\x09-\x0D]+"
CASES = [(1, None, "en"), (2, "", None), (3, " \n\t ", "xx"), (4, "the cat " * 60, "en"), (4, "the cat " * 60, "en"), (5, "a b\na b\nc", "fr"), (6, "#*$%&|<> é\xa0漢", "de")]


def test_measure():
    rows = [t for _, t, _ in CASES if t] + ["one two three four one two three", "x " * 3, "a\n\na\n \n a\na "]
    for t in rows:
        ws = re.findall(WORDS, t)
        three = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        often, covered = Counter(three), set()
        for i, x in enumerate(three):
            if often[x] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if re.search(WORDS, x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert quality_rules.measure(t.encode())[:5] == want


def test_judge(spark):
    prose = "the house and the garden of a man that was in it with his dog on the hill by this "
    junk = "th%%% th%%% of%%% ou.&&& A$$$ he*** en*** "
    rows = CASES + [(20 + i, " ".join(f"{w}{i}{k}" if k % 3 else w for k, w in enumerate(prose.split() * 5)), "en") for i in range(30)] + [(99, " ".join(f"w{k}$$$ of%%% x{k}&&&" for k in range(60)) + junk, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1))
    got = quality_rules.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[20 + i].kept for i in range(30)) and not by[99].kept and not by[99].base_failed
    assert by[4].base_failed and by[1].base_failed and by[1].n_words == 0
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_judge_by_words_alone(spark):
    """Texts in plain letters, which no other rule rejects: word salad, a keyword list, another language's text."""
    common, rng = {k: v.split() for k, v in quality_rules.COMMON.items()}, random.Random(5)
    plain = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))

    def prose(lang, n, every):
        return " ".join(rng.choice(common[lang]) if k % every == 0 else plain() for k in range(n))

    rows = [(i, prose("en", 150 + i, 3), "en") for i in range(40)] + [(100 + i, prose("es", 150 + i, 3), "es") for i in range(40)]
    rows += [(200, " ".join(plain() for _ in range(150)), "en"), (201, " ".join(plain() for _ in range(4000)), "en"), (202, prose("en", 300, 60), "en")]
    rows += [(203, prose("es", 200, 3), "en"), (204, prose("en", 200, 3), "es"), (205, prose("en", 200, 3), "EN"), (206, prose("en", 200, 3), "it")]
    rows += [(207, " ".join(plain() for _ in range(90)), "en")]
    by = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in by.values()) and all(r.js_classes <= 0.28 for r in by.values())
    assert {i for i, r in by.items() if not r.kept} == {200, 201, 202, 203, 204}


def test_line_dedup(spark):
    rows = [(i, "h" if i % 2 else None, f"own {i}\nfooter\n\nfooter \nlast") for i in range(40)] + [(90, "h", None), (91, "h", ""), (92, "g", "footer")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit(0))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, "source", min_pages=10).collect()}
    assert got[1].text == "own 1\n" and (got[1].n_lines, got[1].n_dropped) == (5, 3) and got[2].text == "own 2\n"
    assert got[90].text == "" and got[92].text == "footer" and got[91].n_dropped == 0
    # at the limit a line stays
    ten = spark.createDataFrame([(i, "h", "x" if i < 10 else f"y{i}") for i in range(200)], "doc_id long, source string, text string")
    assert line_dedup.drop_boilerplate(ten, "source").filter("n_dropped > 0").count() == 0
    assert line_dedup.drop_boilerplate(df.limit(0), "source").count() == 0
    hosts = spark.createDataFrame([("https://u@www.Ex.org:80/a",), ("x",)], "u string").select(line_dedup.host_of("u").alias("h")).collect()
    assert [h.h for h in hosts] == ["ex.org", ""]


def test_line_dedup_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "h", f"own {i}\nfooter") for i in range(40)], "doc_id long, source string, text string")
    want = sorted(map(tuple, line_dedup.drop_boilerplate(df, "source").collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_dedup.drop_boilerplate(df, "source").collect())) == want


def test_licenses(spark):
    def grams(t):
        ws = [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} | {tuple(y) for x in t.split("\n") if 0 < len(y := [w for w in re.split(r"[^\w]+|_", x.lower()) if w]) < 5 and len(x) <= 100}

    filler = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"{filler}\n{t.upper() if i % 2 else t}\n{filler}") for i, t in enumerate(license_scan.TEMPLATES.values())]
    mit = license_scan.TEMPLATES["mit-permission"].split()
    rows += [(50, " ".join(mit[:-1])), (51, " ".join(mit[:12])), (52, None), (53, ""), (54, filler * 20), (55, "all rights reserved\nall rights reserved"), (56, "x all rights reserved")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()}
    for i, t in rows:
        have = grams(t or "")
        want = sorted(n for n, w in license_scan.TEMPLATES.items() if len(grams(w) & have) >= 0.8 * len(grams(w)))
        assert got[i].licenses == ",".join(want) and got[i].n_licenses == len(want)


def test_short_licenses_anywhere(spark):
    filler = " ".join(f"word{i}" for i in range(200))
    rows = [(1, "Copyright 2024 Acme. All rights reserved."), (2, f"{filler} all Rights, reserved {filler}"), (3, "all rights are reserved"), (4, "All rights\nreserved."), (5, None), (6, "x mit y. Released under the MIT License."), (7, "mit"), (8, filler)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(df, short_anywhere=True).collect()}
    assert got == {1: "all-rights-reserved", 2: "all-rights-reserved", 3: "", 4: "all-rights-reserved", 5: "", 6: "mit", 7: "", 8: ""}
    two = {r.doc_id: r.licenses for r in license_scan.scan(df, templates={"m": "MIT", "r": "rights reserved", "long": license_scan.TEMPLATES["mit"]}, short_anywhere=True).collect()}
    assert two == {1: "r", 2: "r", 3: "", 4: "r", 5: "", 6: "long,m", 7: "m", 8: ""}


def spots(text):
    ws = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [w for w in ws if w not in spot_signatures.ANCHOR_WORDS]
    out, seen = set(), 0
    for i, w in enumerate(ws):
        if w in spot_signatures.ANCHOR_WORDS:
            chain = content[i - seen : i - seen + 3]
            seen += 1
            if len(chain) == 3:
                out.add((w, *chain))
    return out or {text}


def test_fingerprints(spark):
    rows = [(i * 7, f"the house{i} near a river{i % 3} and of hill{i} was green{i % 2} with trees in the {'wood ' * (i % 4)} by stone{i}") for i in range(25)]
    rows += [(1000, None), (1001, ""), (1002, "xyz"), (1003, rows[3][1]), (1003, rows[3][1]), (1004, "le é the 漢 chat noir grand")]
    got = sorted((tuple(r) for r in spot_signatures.fingerprints_and_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: (-r[0], r[2]))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        like = lambda a, b: len(a & b) / len(a | b)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(spots(t), spots(edited)), like(spots(t), spots(nxt))))
    want.sort(key=lambda r: (-r[0], r[2]))
    # the two rows of one id and text have different next rows
    assert [(r[0], r[1], r[2]) for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want):
        if r[0] != 1003:
            assert abs(r[5] - w[3]) < 1e-9 and abs(r[6] - w[4]) < 1e-9
    prints = {}
    for (i, t), r in zip(sorted(order, key=lambda r: -r[0]), sorted(got, key=lambda r: -r[0])):
        assert prints.setdefault(t, r[3]) == r[3]
    one = spark.createDataFrame([(5, "abc")], "doc_id long, text string")
    assert spot_signatures.fingerprints_and_edits(one).first().near_next == 1.0
    assert spot_signatures.fingerprints_and_edits(one.limit(0)).count() == 0


def test_alike(spark):
    base = " ".join(f"the a{i} b{i} of c{i}" for i in range(40))
    rows = [(i, base.replace(f"a{i} ", "zz ")) for i in range(6)] + [(20, "the one two three"), (21, base + " the q r s" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.left_id, r.right_id): round(r.likeness, 9) for r in spot_signatures.alike(df, threshold=0.8).collect()}
    sets = {i: spots(t) for i, t in rows}
    want = {(a, b): round(len(x & y) / len(x | y), 9) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    assert got == want


def test_alike_with_a_shared_passage(spark):
    passage = " ".join(f"the p{i} q{i} of r{i}" for i in range(4))
    own = lambda k: " ".join(f"the u{k}v{i} w{i} of x{k}y{i}" for i in range(20))
    rows = [(k, f"{own(k)} {passage}") for k in range(12)] + [(50, f"{own(3)} {passage} the last new words"), (51, passage), (52, passage), (53, None), (54, ""), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spot", F.lit("x"))
    got = {(r.left_id, r.right_id) for r in spot_signatures.alike(df).collect()}
    assert got == {(3, 50)}
    members = {r.id: r.class_id for r in spot_signatures.class_members(df).collect()}
    assert members == {**{k: k for k in range(12)}, 50: 50, 51: 51, 52: 51, 53: 53, 54: 53}
    assert spot_signatures.alike(df.limit(0)).count() == spot_signatures.class_members(df.limit(0)).count() == 0


def test_license_sql_is_the_query(spark):
    """Notices inside longer lines too, over a table that holds each template whole, in part, and run into other words."""
    rows = [(i, f"{' '.join(t.split()[:k])} and more") for i, (t, k) in enumerate((t, k) for t in license_scan.TEMPLATES.values() for k in (2, 4, 99))]
    rows += [(100, "Copyright 2024 Acme. All rights reserved. Contact us"), (101, "all\nrights\nreserved"), (102, "all rights unreserved"), (103, None), (104, ""), (105, "rights reserved all")]
    got = sorted(tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), short_anywhere=True).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(queries.oracle_sql()["op7_license_scan"]).fetchall())
    assert dict((i, x) for i, x, _ in got)[100] == dict((i, x) for i, x, _ in got)[101] == "all-rights-reserved"


def test_chat_round_trip(spark):
    texts = ["hi", "", "</s>[INST] ok [/INST]", "\\</s> \\\\<|im_end|>\n<|im_end|>\n", "ends with \\", "<|im_start|>user\nx", "[INST[INST]] é漢", "a\nb\n"]
    turns = [{"role": ["user", "assistant", "sys tem\n<s>", ""][k % 4], "text": t} for k, t in enumerate(texts)]
    df = spark.createDataFrame([(1, turns), (2, [])], "id int, turns array<struct<role:string,text:string>>")
    out = chat_format.format_turns(df, "turns", ("id",))
    got = {r.id: r for r in out.select("id", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [b.asDict() for b in got[1].back] == turns and got[2].formatted == "" and got[2].back == []
    assert got[1].loss == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "gpt", "content": None}], "extra": 1},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"prompt": "p", "completion": "c"},
        {"question": "q", "context": "k"},
        {"text": "t"},
        {"strange": 1},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(50, "no json"), (51, None)], "id int, record string").withColumn("layout", F.lit(0))
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.canonical_turns(df, "record", ("id",)).collect()}
    assert got[0] == ("messages", [("user", "a"), ("gpt", "")]) and got[1] == ("conversations", [("system", "s"), ("user", "a"), ("assistant", "b")])
    assert got[2][1] == [("user", "i"), ("user", "x"), ("assistant", "o")] and got[3][1] == [("user", "p"), ("assistant", "c")]
    assert got[4][1] == [("system", "k"), ("user", "q")] and got[5] == ("text", [("assistant", "t")])
    assert got[6] == (None, []) and got[50] == (None, []) and got[51] == (None, [])


def test_records_of_two_layouts(spark):
    import json

    records = [
        {"instruction": "i", "input": "x", "output": "o", "text": "all of it"},
        {"prompt": "p", "messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "b"}]},
        {"messages": [{"role": "assistant"}, {"role": "user", "content": "b"}]},
        {"conversations": [{"from": "gpt"}, {"from": "human", "value": "b"}], "text": "t", "prompt": "p"},
        {"question": "q", "output": "o"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id int, record string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.canonical_turns(df, "record", ("id",)).collect()}
    assert got[0] == ("instruction", [("user", "i"), ("user", "x"), ("assistant", "o")])
    assert got[1] == ("messages", [("user", "p"), ("assistant", "b")])
    assert got[2] == ("messages", [("assistant", ""), ("user", "b")])
    assert got[3] == ("conversations", [("assistant", ""), ("user", "b")])
    assert got[4] == ("question", [("user", "q")])


def test_contents_in_parts(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image","url":"u"},{"type":"text","text":"b"}]},{"role":"assistant","content":["c","d"]}]}'),
        (2, '{"messages":[]}'),
        (3, '{"messages":[{"role":"user","content":null},{"role":"assistant","content":"[1]"}]}'),
    ]
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.canonical_turns(spark.createDataFrame(rows, "id int, j string"), "j", ("id",)).collect()}
    assert got == {1: ("messages", [("user", "ab"), ("assistant", "cd")]), 2: ("messages", []), 3: ("messages", [("user", ""), ("assistant", "[1]")])}


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (None, 0, "user", "x"), (2, 0, None, ""), (2, 0, None, "")]
    got = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit(0))).collect()}
    assert got[1].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert got[2].n_turns == 2 and got[None].n_turns == 1
    long = spark.createDataFrame([(1, 0, "assistant", "é" * 9_000_000), (1, 1, "user", "</s>")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(long).first()  # more than a VARIANT holds
    assert (row.loss_chars, row.n_turns, row.layout) == (9_000_000, 2, "messages")


def test_sql(spark):
    sql = queries.oracle_sql()
    for name in sql:
        compare(spark, queries.queries()[name], sql[name], SMALL)
