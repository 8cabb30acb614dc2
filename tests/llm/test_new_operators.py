"""Prefix trie, alignment and quality rules against plain versions."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from reviewlab.llm import align, rules, trie

FILE = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


# ------------------------------------------------------------------ the trie

def plain_trie(rows, family=5, heads=9):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    convs = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, family))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = {}
    kids = Counter(p[:-1] for p in members if p)
    leaves, kept = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            if not kids[p]:
                leaves[p[:d]] += 1
            kept[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    for p, m in members.items():
        ends = sorted(c for c in m if built[c] == p)
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], kept[p],
                               hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    assert len(out) == len(members)
    return out


def nodes(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


CONV = "conv_id long, turn long, role string, text string"


def test_trie_of_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert nodes(trie.family_trie(df)) == want
    assert nodes(trie.family_trie(df, limit=20)) == want


@pytest.mark.parametrize("segment,limit,block", [(256, 4096, 256), (256, 1, 256), (4, 5, 256), (3, 1, 2), (2, 30, 2)])
def test_trie_of_hot_and_long_conversations(spark, monkeypatch, segment, limit, block):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "STRETCH", 7)
    rng = random.Random(segment * 100 + limit)
    rows = []
    for c in list(range(-6, 60)) + [100, 105, 110, 111, 112]:
        n = rng.choice([1, 2, 3, 5, 8])
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice("ab")) for t in range(n)]
    for c in range(200, 260, 5):  # a group of copies
        rows += [(c, t, "user", f"turn {t}") for t in range(12)]
    for c, n in ((300, 60), (305, 60), (310, 41), (301, 60)):  # long ones, of which one is a prefix
        rows += [(c, t, "user", "é" * (t % 3)) for t in range(n)]
    rows += [(400, None, None, None), (400, None, "user", "x"), (400, 1, "user", "x"), (400, 1, "user", "x"), (None, 1, "a", "b"), (401, 3, "", "")]
    rows += [(402, 5, "a", "same")] * 30
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], CONV + ", depth int").repartition(5)
    assert nodes(trie.family_trie(df, limit=limit)) == plain_trie(rows)


def test_trie_without_turns_or_conversations(spark):
    assert trie.family_trie(spark.createDataFrame([], CONV)).count() == 0
    assert trie.family_trie(spark.createDataFrame([(None, 1, "a", "b")], CONV)).count() == 0
    rows = [(c, 0, "user", "x") for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9]  # the base is absent, their only turn goes
    assert nodes(trie.family_trie(spark.createDataFrame(rows, CONV))) == plain_trie(rows)


def test_ends_of_many_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 50)
    ends = spark.range(500).selectExpr("if(id % 3 = 0, 'a', 'b') as node", "id * 7 - 900 as conv").repartition(7)
    want = {n: hashlib.sha256(",".join(str(i * 7 - 900) for i in range(500) if (i % 3 == 0) == (n == "a")).encode()).hexdigest() for n in "ab"}
    assert {r["node"]: r["ends"] for r in trie.ends_hash(ends).collect()} == want


# ----------------------------------------------------------------- alignment

def plain_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(FILE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    first = lambda i: bytes(byte_of[c] for c in t.id_to_token(i)) if i != 50256 else b"<|endoftext|>"

    def second(i):
        x = sp.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode()

    found, df = {}, Counter()
    for i, text in docs:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        xa, xb = [first(k) for k in a], [second(k) for k in b]
        if not text or b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            found[i] = None
            continue
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        groups, ia, ib = [], 0, 0
        for cut in sorted({*ea} & {*eb}):
            ja, jb = bisect_left(ea, cut) + 1, bisect_left(eb, cut) + 1
            groups.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        df.update(links.keys())
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found[i] = (len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest())
    top = {}
    for (p, _), n in df.items():
        top[p] = max(top.get(p, 0), n)
    return {i: (0, 0, 0, 0, 0, 0, "") if f is None else
            (f[0], f[1], f[2], sum(f[3].values()), sum(n for k, n in f[3].items() if df[k] == top[k[0]]), sum(n * df[k] for k, n in f[3].items()), f[4])
            for i, f in found.items()}


def odd_texts():
    rng = random.Random(5)
    docs = [None, "", " ", "  a  b \n\n c\t d ", "<|endoftext|> é\xa0ü　 x  <s> </s>", "a" * 3000, "a▁b", "日本語 テキスト😀😀 です", "x", "<0x41> ",
            "\x00a\r\n", "😀" * 700, "same text", "same text", "q".join("日" * 500), "ends with space "]
    docs += ["".join(rng.choice("ab é日😀\n ,.<") for _ in range(rng.randint(1, 200))) for _ in range(120)]
    return list(enumerate(docs))


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 900, "STEP": 300}])
def test_alignment_of_odd_texts(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(align, k, v)
    docs = odd_texts()
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_a int").repartition(3)
    got = align.alignment(df, FILE, MODEL).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain_alignment(docs) and len(got) == len(docs)


@pytest.mark.parametrize("limits", [{}, {"WIDE": 6, "NEAR": 1, "REMEMBERED": 2}])
def test_alignment_of_parts_is_of_whole_texts(monkeypatch, limits):
    """Also where no text is cut, and where what is remembered is forgotten between steps."""
    for k, v in limits.items():
        monkeypatch.setattr(align, k, v)
    texts = [t for _, t in odd_texts()]
    cut, whole = align.Parts(align.Tokenizers(FILE, MODEL)), align.Parts(align.Tokenizers(FILE, MODEL))
    whole.of.whole = True
    a, b = align.Step(texts, cut), align.Step(texts, whole)
    assert a.sha == b.sha and all((getattr(a, k) == getattr(b, k)).all() for k in ("n_a", "n_b", "n_groups", "n_links", "text", "key", "times"))
    cut.forget()
    again = [align.Step([t], cut) for t in texts]
    assert [s.sha[0] for s in again] == a.sha and sum(len(s.key) for s in again) == len(a.key)


def test_alignment_of_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = align.alignment(df, FILE, MODEL).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain_alignment([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_alignment_of_repeats_null_ids_and_nothing(spark):
    rows = [(1, "one two")] * 3 + [(None, "one two"), (None, None)]
    got = align.alignment(spark.createDataFrame(rows, "doc_id long, text string"), FILE, MODEL).collect()
    assert len(got) == 5 and {r["count_sum"] // r["n_links"] for r in got if r["n_links"]} == {4}
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), FILE, MODEL).count() == 0


def test_shared_cuts_with_distant_ends():
    rng = np.random.default_rng(3)
    for density in (0.001, 0.3, 0.95):
        a = np.flatnonzero(rng.random(5000) < 0.5)
        b = np.unique(np.append(np.flatnonzero(rng.random(5000) < 0.5 * density), a[-1]))
        assert align.shared_cuts(a, b, np.array([0]), np.array([len(a)])).tolist() == np.flatnonzero(np.isin(a, b)).tolist()
    a, b = np.arange(0, 9000, 2), np.append(np.arange(1, 8998, 2), 8998)
    assert align.shared_cuts(a, b, np.array([0]), np.array([len(a)])).tolist() == [len(a) - 1]


# -------------------------------------------------------------- quality rules

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    again = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 8)}
    base = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), base)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_count_as_plain_python(spark):
    rng = random.Random(2)
    texts = [None, "", " \x0b\n", "a", "  　x y", "🙂 é\n🙂 é\n\n 🙂 é", "# * $ % & | < > #", "a b c d e f g h " * 4, "x " * 30, "w " * 50_000,
             " ".join(map(str, range(3000))) + " 5 6 7 8 9 10 11 12"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    texts += ["\n".join(rng.choice(["aa b", "aa b ", "c", "", " "]) for _ in range(20)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in rules.quality_rules(df).collect()}
    assert got == {i: plain_rules(t) for i, t in enumerate(texts)}
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in rules.quality_rules(given).collect()}
    assert got == {r["doc_id"]: plain_rules(r["text"]) for r in given.select("doc_id", "text").collect()}


def test_rules_verdicts(spark):
    clean = "The history of the town is long and it was told to us by the people that lived there for many years of it."
    cases = {"clean": clean, "symbols": clean + " ### $$$ %%%", "letters": clean + " 12 34 | - " * 5, "stop_words": "lorem ipsum dolor " * 3 + " ".join(f"zork{i}" for i in range(60)),
             "ellipsis_lines": "\n".join(f"this is the line {'abcdefgh'[i]} of it..." for i in range(8)),
             "bullet_lines": "\n".join(f"- this is the item {'abcdefgh'[i]}" for i in range(8)), "word_length": " ".join("the of" + str(i) + "x" * 60 for i in range(30))}
    df = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    got = {r["doc_id"]: (r["kept"], r["broken"]) for r in rules.quality_rules(df).collect()}
    assert got.pop("clean") == (True, [])
    for name, (kept, broken) in got.items():
        assert not kept and name in broken, (name, broken)
    assert [r["kept"] for r in rules.quality_rules(df, rules=[]).where("doc_id = 'symbols'").collect()] == [True]


def test_rules_of_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b")] * 3 + [(None, "x"), (None, None)], "doc_id long, text string")
    got = rules.quality_rules(df)
    assert got.count() == 5 and got.where("kept").count() == 0 and got.where("n_words = 2").count() == 3
    assert rules.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_use_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = rules.quality_rules(df).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("array_distinct") <= 4  # a later filter is not written out in the windows
