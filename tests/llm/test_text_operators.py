"""Decontamination, licence scan, chat, sharding and packing against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.llm import chat, decontam, licenses, packing, shards
from reviewlab.llm.common import tokenizer_file
from reviewlab.llm.queries import ORACLES, SHARD_BYTES, op5_decontamination, op7_license_scan, op8_packing
from tests.conftest import SF_SMALL
from tests.llm import brute


def text(rng, n, vocabulary=3000):
    return " ".join(f"{rng.choice('abcdefg')}{rng.randrange(vocabulary)}" for _ in range(n))


# ----------------------------------------------------------- decontamination

def test_leaks_are_all_windows(spark):
    rng = random.Random(4)
    items = [text(rng, n) for n in (3, 5, 8, 20, 20, 40, 65, 120)] + ["", None, "one", "É ß ü été x", "a a a a a a a a a b"]
    docs = []
    for k in range(60):
        words = text(rng, rng.randrange(1, 200)).split()
        item = (rng.choice(items) or "").split()
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 5])):
            if item:
                item[rng.randrange(len(item))] = "changed"
        if rng.random() < 0.3 and len(item) > 8:
            del item[rng.randrange(len(item))]
        at = rng.randrange(len(words) + 1)
        docs.append(" ".join(words[:at] + [w.upper() + rng.choice(["", ",", "."]) for w in item] + words[at:]))
    docs += [None, "", "...", items[5], items[2], docs[3]]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(docs)]
    want = {(i, j): round(s, 9) for i, t in rows for j, x in enumerate(items) if (s := brute.leaks(t, x)) >= 0.8}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("x"))
    found = decontam.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == want and len(want) > 25
    for r in found:  # the span is the window
        t = dict(rows)[r["doc_id"]] if r["doc_id"] is not None else docs[9]
        span = t.encode()[r["first_byte"]:r["last_byte"]].decode()
        assert brute.words_of(span) == brute.words_of(t)[r["first_word"]:r["last_word"]] and r["distance"] <= decontam.RADIUS
    clean = decontam.drop_contaminated(df, bench)
    gone = {r["doc_id"] for r in found}
    assert clean.columns == df.columns
    assert sorted(x["doc_id"] for x in clean.collect() if x["doc_id"] is not None) == sorted(i for i, _ in rows if i is not None and i not in gone)


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, text(rng, 20)) for i in range(30)]
    docs = spark.createDataFrame([(i, text(rng, 30) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == whole and len(whole) == 30


def test_no_leaks_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_leaks_of_the_table(spark, duck):
    docs, items = (duck.execute(f"select {k}, text from {t}").fetchall() for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    joined = {i: " " + " ".join(brute.words_of(t)) + " " for i, t in docs}
    want = {(d, i) for i, t in items for d, x in joined.items() if " " + " ".join(brute.words_of(t)) + " " in x}
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontamination(spark, SF_SMALL).where("similarity = 1").collect()}
    assert got == want and want


# ----------------------------------------------------------------- licences

def plain_scan(t):
    t = t or ""
    import re
    spans = [t] + re.split(r"\n(?:[^0-9a-zA-Z\x80-\U0010ffff\n]*\n)+", t)
    for line in t.split("\n"):
        spans += [line, *re.split(r"(?<=[.!?;])(?=[ \t\n\r])", line)]
    out = {}
    for s in spans:
        for name, texts in licenses.TEMPLATES.items():
            for x in texts:
                if (d := brute.dice(s, x)) >= 0.8:
                    out[name] = max(out.get(name, 0), round(d, 9))
    return out


def test_licences_are_plain(spark):
    rng = random.Random(6)
    mit = licenses.TEMPLATES["MIT"][2]
    rows = [mit, "(c) x\n\n" + mit.replace(", ", ",\n") + "\n\nprose goes on here", "Some words. Released under the MIT license! More words.",
            "All rights reserved.", "all RIGHTS reserved", "rights", "", None, "Licensed under CC BY-NC 4.0.\n", "Licensed under the Apache License, Version 2.0.",
            text(rng, 300) + "\nThis work is licensed under the GNU General Public License, version 2.\n" + text(rng, 40), "no licence here; none at all",
            " ".join(w if rng.random() > 0.05 else "word" for w in licenses.TEMPLATES["BSD-3-Clause"][0].split()), "x\n" * 3000 + "All rights reserved.\n" + "y z " * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(None, rows[3]), (3, rows[3])], "doc_id long, text string").withColumn("license", F.lit("?"))
    got = licenses.license_scan(df).collect()
    want = Counter()
    for i, t in [*enumerate(rows), (None, rows[3]), (3, rows[3])]:
        for name, d in plain_scan(t).items():
            want[i, name, d] += 1
    assert Counter((r["doc_id"], r["license"], round(r["dice"], 9)) for r in got) == want and len(want) >= 9
    for r in got:
        if r["doc_id"] is not None:
            span = rows[r["doc_id"]].encode()[r["first_byte"]:r["last_byte"]].decode()
            assert max(brute.dice(span, x) for x in licenses.TEMPLATES[r["license"]]) == pytest.approx(r["dice"])


def test_licences_of_the_table(spark, duck):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    want = {(i, n, d) for i, t in rows if "icense" in t or "rights" in t.lower() or "permission" in t.lower() for n, d in plain_scan(t).items()}
    assert {(r["doc_id"], r["license"], round(r["dice"], 9)) for r in op7_license_scan(spark, SF_SMALL).collect()} == want and want
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licences_across_lines_are_all_windows(spark):
    rng = random.Random(9)
    mit, gpl, bsd = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["BSD-3-Clause"][0]
    usual = [mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE"),
             gpl.replace("version. This", "version.\n\nThis"), bsd.replace(" 1.", "\n\n1.").replace(" 2.", "\n\n2.").replace(" 3.", "\n\n3.")]
    rows = [text(rng, 40) + "\n\n" + x + "\n\n" + text(rng, 60) for x in usual]
    rows += [f"some words here and this file is\nlicensed under the MIT\nLicense. {text(rng, 30)}", text(rng, 90), "rights", "", None, "all rights\n\nreserved x all\nrights reserved"]
    for k in range(25):
        words = rng.choice(usual[:3] + licenses.TEMPLATES["ISC"]).split()
        for _ in range(rng.randrange(0, len(words) // 5)):
            words[rng.randrange(len(words))] = rng.choice([*words, "changed"])
        rows.append("\n\n".join([text(rng, rng.randrange(1, 9)), *(" ".join(words[i:i + 15]) for i in range(0, len(words), 15)), text(rng, 5)]))
    want, best = set(), {}
    for i, t in enumerate(rows):
        words = brute.words_of(t or "")
        pairs = list(zip(words, words[1:]))
        for name, texts in licenses.TEMPLATES.items():
            for x in texts:
                bag = Counter(zip(brute.words_of(x), brute.words_of(x)[1:]))
                size = sum(bag.values())
                for a in range(len(pairs)):
                    seen, common = Counter(), 0
                    for b in range(a, min(len(pairs), a + 2 * size)):
                        seen[pairs[b]] += 1
                        common += seen[pairs[b]] <= bag[pairs[b]]
                        if (d := 2 * common / (b - a + 1 + size)) >= 0.8:
                            want.add((i, name))
                            best[i, name] = max(best.get((i, name), 0), d)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = licenses.license_scan(df, templates=licenses.TEMPLATES).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(want) > 12 and (0, "MIT") in want and (2, "BSD-3-Clause") in want
    for r in got:
        span = rows[r["doc_id"]].encode()[r["first_byte"]:r["last_byte"]].decode()
        assert max(brute.dice(span, x) for x in licenses.TEMPLATES[r["license"]]) == pytest.approx(r["dice"])
        assert r["dice"] == pytest.approx(best[r["doc_id"], r["license"]]) or r["license"] in plain_scan(rows[r["doc_id"]])
    assert next(r["n_places"] for r in got if r["doc_id"] == 8) == 2


def test_full_licence_texts(spark):
    rng = random.Random(10)
    full = {name: texts for name, texts in licenses.all_templates().items() if name in licenses.TEXTS}
    rows = [(i, text(rng, 50) + "\n\n" + max(texts, key=len) + "\n" + text(rng, 50), name) for i, (name, texts) in enumerate(full.items())]
    got = {(r["doc_id"], r["license"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert {(i, name) for i, _, name in rows} <= got and len(rows) == 7


# --------------------------------------------------------------------- chat

def test_chat_edges(spark):
    import duckdb
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 6, "assistant", "yo"), (3, 7, "user", "<|im_end|> x"),
            (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (5, 0, "user", None), (6, 0, "user", ""), (6, 0, "user", ""), (7, None, None, "a"), (7, 0, "user", "b"),
            (None, 0, "user", "solo"), (8, 0, "user", "b"), (8, 0, "user", "a"), (9, 0, "user", "a"), (10, 0, "user", "z" * 50_000)]
    rows += [(20, i, "user", f"t{i}") for i in range(700)] + [(21, i + 3, "user", f"t{i}") for i in range(512)] + [(22, i, "user", f"t{i}") for i in range(300)]
    rows += [(23, i, "user", f"t{i}" if i != 299 else "else") for i in range(300)]
    schema = "conv_id long, turn long, role string, text string"
    got = sorted((tuple(r) for r in chat.chat_documents(spark.createDataFrame(rows, schema).withColumn("len", F.lit(1))).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    res = con.execute("select conv_id, segment, n_turns, n_equal, rendered from (" + ORACLES["op9_chat"] + ")").fetchall()
    assert got == sorted(res, key=str) and {r[0] for r in got} == {None, 3, 5, 6, 7, 8, 10, 20, 23}
    assert chat.chat_documents(spark.createDataFrame([], schema)).count() == 0


def test_chat_of_many_levels(spark, monkeypatch):
    """Blocks of three turns, so that heads are made over several levels, and a
    conversation of a third of the rows whose turns share one number."""
    rows = [(c, i, "user", f"t{i % 7}") for c, n in ((1, 40), (2, 41), (3, 27), (4, 28), (5, 81), (6, 9), (7, 3)) for i in range(n)]
    rows += [(8, i, "user", f"t{i % 7}" if i != 13 else "else") for i in range(40)] + [(9, i, "user", f"t{i % 7}" if i != 13 else "else") for i in range(14)]
    rows += [(10, None if i % 2 else 5, "user", f"u{i:04}") for i in range(300)]
    rows += [(11, 1, "user", f"u{i:04}") for i in range(1, 300, 2)]
    monkeypatch.setattr(chat, "BLOCK", 3)
    turns = chat.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by_conv = {}
    for c, t, _, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[3])):
        by_conv.setdefault(c, []).append(x)
    for c, texts in by_conv.items():
        assert [r["text"] for r in sorted((r for r in turns if r["conv_id"] == c), key=lambda r: r["at"])] == texts
        assert sorted(r["at"] for r in turns if r["conv_id"] == c) == list(range(len(texts)))
    hashes = chat.rolling_hashes(spark.createDataFrame(turns)).collect()
    seen = {}
    for r in hashes:  # equal hashes are equal prefixes, and the other way round
        seen.setdefault(r["hash"], set()).add(tuple(by_conv[r["conv_id"]][:r["len"]]))
    assert all(len(v) == 1 for v in seen.values()) and len(hashes) == sum(map(len, by_conv.values()))
    assert len(seen) == len({tuple(x[:i + 1]) for x in by_conv.values() for i in range(len(x))})
    best = chat.maximal_conversations(spark.createDataFrame(turns)).collect()
    assert sorted(r["conv_id"] for r in best) == [5, 8, 10]


# ----------------------------------------------------------------- sharding

def check_shards(rows, limit):
    """Each shard fits or can't be split; prefixes don't overlap; sums agree."""
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"] or 0
    n = Counter(r["shard"] for r in rows)
    for r in rows:
        assert (r["shard_bytes"], r["shard_rows"]) == (sizes[r["shard"]], n[r["shard"]])
        assert r["shard_bytes"] <= limit or r["shard_rows"] == 1 or len(r["shard"]) == 120
    names = sorted(n)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    return sizes


def test_shards_split_only_where_needed(spark):
    rows = [(i, i % 50) for i in range(3000)] + [(None, 5), (None, 7), (-1, None), (9999, 5000)]
    df = spark.createDataFrame(rows, "k long, size long").withColumn("shard", F.lit("old")).withColumn("bits", F.lit(1))
    got = shards.extendible_shards(df, "k", F.col("size"), 1000).collect()
    assert sorted((r["k"], r["size"]) for r in got if r["k"] is not None) == sorted((k, s) for k, s in rows if k is not None) and len(got) == len(rows)
    sizes = check_shards(got, 1000)
    parents = Counter()
    for s, b in sizes.items():
        for d in range(len(s)):
            parents[s[:d]] += b
    assert all(b > 1000 for b in parents.values())  # every split was of an oversized bucket
    d = shards.directory(spark.createDataFrame(got)).collect()
    assert len(d) == len(sizes) and all(len(r["shard"]) == r["depth"] for r in d)


def test_one_key_holds_most_rows(spark):
    rows = [(7, 10)] * 500 + [(i, 10) for i in range(100)]
    got = shards.extendible_shards(spark.createDataFrame(rows, "k long, size long"), "k", F.col("size"), 200).collect()
    assert len(got) == 600
    check_shards(got, 200)


def test_shard_edges(spark, tmp_path):
    none = spark.createDataFrame([], "k long, size long")
    assert shards.extendible_shards(none, "k", F.col("size"), 10).count() == 0
    one = shards.extendible_shards(spark.createDataFrame([(1, 5)], "k long, size long"), "k", F.col("size"), 10)
    assert [tuple(r) for r in one.collect()] == [(1, 5, "", 5, 1)]
    with pytest.raises(ValueError):
        shards.extendible_shards(none, "k", F.col("size"), 0)
    many = shards.extendible_shards(spark.createDataFrame([(i, 5) for i in range(20)], "k long, size long"), "k", F.col("size"), 30)
    shards.write_shards(many, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert SHARD_BYTES == 1 << 20


def test_shards_come_back_whole(spark, tmp_path):
    """A key with a third of the bytes, long texts, empty and null ones: rows
    read back are those written, each shard's folder within the limit."""
    rows = [(7, "hot", "x" * (i % 90)) for i in range(300)] + [(i, None, "y" * 50) for i in range(100, 400)] + [(1, "long", "z" * 5000), (None, "n", None), (2, "e", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for limit, name in ((2000, "many"), (1 << 30, "one")):
        shards.write_shards(shards.extendible_shards(df, "doc_id", F.octet_length("text"), limit), str(tmp_path / name))
        back = shards.read_shards(spark, str(tmp_path / name), df.schema).collect()
        assert sorted((tuple(r)[:3] for r in back), key=str) == sorted(rows, key=str)
        sizes = Counter()
        for r in back:
            sizes[r["shard"]] += len(r["text"] or "")
        assert all(b <= limit or b == 5000 for b in sizes.values())
        assert (len(sizes) > 10 and all(set(s) <= set("01") for s in sizes)) if name == "many" else set(sizes) == {""}



# ------------------------------------------------------------------ packing

def check_pieces(rows, docs, window=1024):
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(tokenizer_file())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            want = np.array(ids[i][at:at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(want)) and r["length"] > 0
            at += r["length"]
        assert at == len(ids[i])
    padded = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padded += 0 if at.bit_count() == 1 else window - at
    assert padded == 0


def test_pieces_of_the_table(spark, duck):
    check_pieces(op8_packing(spark, SF_SMALL).collect(), duck.execute("select doc_id, text from documents").fetchall())


def test_packing_edges(spark):
    rng = random.Random(7)
    docs = [(0, None), (1, ""), (2, " "), (3, "  a  b \n\n c\t d "), (4, "<|endoftext|> é ü　 x  "), (5, "a" * 30_000), (6, text(rng, 9000)), (7, "word " * 5000), (8, "\x1c y \x85z")]
    docs += [(100 + i, text(rng, rng.randrange(1, 900))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "width", "m1")})
    rows = packing.pack(df, tokenizer_file()).collect()
    check_pieces(rows, docs)
    whole = packing.sequences(df, spark.createDataFrame(rows), tokenizer_file())
    assert {len(r["ids"]) for r in whole.collect()} <= {1 << k for k in range(11)}
    assert packing.pack(df.limit(0), tokenizer_file()).count() == 0
    again = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "no id")], "doc_id long, text string")
    got = packing.pack(again, tokenizer_file()).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 1)
    assert sum(r["length"] for r in got if r["doc_id"] is None) == next(r["doc_tokens"] for r in got if r["doc_id"] is None)


def test_ids_are_those_of_the_unmodified_tokenizer(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(tokenizer_file())
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|><|endoftext|>  x \n", "<|endoftext |> <|endof", "<|endoftext|>" * 700 + " word", "it's\n <|endoftext|>\n\n é"]
    encoder = packing.Encoder(tokenizer_file())
    for t in texts:
        assert np.frombuffer(encoder.encode(t), np.uint16).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_file()).collect()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        parts = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == i)
        assert sum(p[1] for p in parts) == len(ids)
        assert all(n == len(ids) and crc == zlib.crc32(np.array(ids[a:a + k], "<u4").tobytes()) for a, k, crc, n in parts)


def test_neighbours_are_ranked_by_bm25():
    units = []
    corpora = [[1, 2, 3, 3], [3, 3, 4], [5, 6], [1, 3, 9, 9]]
    weight = {t: float(np.log(1 + 1 / t)) for c in corpora for t in c}
    for i, c in enumerate(corpora):
        terms, tf = np.unique(np.array(c, np.uint16), return_counts=True)
        units.append(packing.Unit(i, np.array(c, np.uint16), 0, terms, np.array([weight[t] * n for t, n in zip(terms.tolist(), tf.tolist())], np.float32)))
    index = packing.Index(units)
    for u in units:
        want = [sum(w for t, w in zip(v.terms.tolist(), v.weights.tolist()) if t in set(u.terms.tolist())) for v in units]
        assert index.scores(u) == pytest.approx(want, rel=1e-5)


def test_terms_of_many_documents_are_counted_and_hashed_together(spark):
    """Document frequencies and min-hashes over more than a block of documents, of two and of four bytes an id."""
    import numpy as np
    from reviewlab.llm import packing
    from reviewlab.llm.common import mix, tokenizer_file
    docs = spark.range(0, 700, 1, 2).selectExpr("id as doc_id", "case when id % 7 = 0 then null else repeat(concat('word ', id % 50, ' x'), cast(id % 9 as int)) end as text")
    tokens = packing.token_ids(docs, tokenizer_file())
    rows = tokens.collect()
    ids = {r["doc_id"]: np.frombuffer(r["ids"], np.uint16) for r in rows}
    assert len(ids) == 700 and all(r["width"] == 2 for r in rows)
    for r in rows:
        for m, s in ((r["m1"], 1), (r["m2"], 2)):
            assert m == int(mix(ids[r["doc_id"]].astype(np.uint64) + np.uint64(s << 32)).min() >> np.uint64(32))
    names, df = np.unique(np.concatenate([np.unique(x) for x in ids.values()]), return_counts=True)
    wide = spark.createDataFrame([(bytearray(x.astype(np.uint32).tobytes()), 4) for x in ids.values()], "ids binary, width int")
    for t in (tokens, wide, tokens.select("ids", "width").where("m1 % 2 = 0").unionByName(tokens.select("ids", "width").where("m1 % 2 = 1"))):
        got = {r["term"]: (r["df"], r["total"]) for r in packing.term_frequencies(t).collect()}
        assert got.pop(-1) == (700, sum(map(len, ids.values())))
        assert got == {int(k): (int(n), 0) for k, n in zip(names, df)}
