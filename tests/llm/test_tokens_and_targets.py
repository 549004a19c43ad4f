"""Token files, resampling towards a target, and repair of conversations, against brute force."""

import glob
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from soundlake.llm import chat_repair, target_resampling, token_files

CLASHING = "doc_id long, text string, ids string, shard string, at long, stop string, key string, row string, _row string, score string"


def odd_docs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeABß éñ.,!'0") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[3]), (7, texts[3]), (7, "other"), (None, "no id"), (None, None), (100, None), (101, ""), (102, " \n\t "), (103, "word " * 400_000), (104, "x" * 5000), (105, "It's <|endoftext|> é ́a 가  b\x1cc d　e")]
    return rows, spark.createDataFrame([(i, t, "a", "b", 1, "c", "d", "e", "f", "g") for i, t in rows], CLASHING).repartition(5)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list(" \n\tabcXYZ'sd-_*.,क़.,!1́é각 \x1c Σİ<|>endoftx")), max_size=60))
def test_chunks_encode_as_whole_texts(text):
    c = token_files.codec(token_files.TOKENIZER)
    assert np.frombuffer(c.encode([text])[0], np.int32).tolist() == c.tokenizer.encode(text, add_special_tokens=False).ids
    assert c.groups
    assert b"".join(c.encode([p])[0] for p in token_files.pieces(text, 5)) == c.encode([text])[0]


def test_marks_after_words_and_a_full_memory(monkeypatch):
    """Chunks and their tails encode as whole texts, and words met first are still known once the memory is full."""
    monkeypatch.setattr(token_files, "CACHED", 200)
    rng, c = random.Random(4), token_files.Codec(token_files.TOKENIZER)
    whole = lambda t: c.tokenizer.encode(t, add_special_tokens=False).ids
    parts = ["word", "Ab9", "\u0130", "\u00e9", "\u03a3", "\u0431", "\u00d7", "\u0482", "e\u0301", "'s", "'", ",", ".", "...", "\u201d", "_", "]", "<|", "|>", "endoftext", "[SEP]", "\u00b2", "\x1c", " ", " ", "\n", "\t", "\u00a0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + ["word, " + " ".join(f"w{i}, x{i}." for i in range(300))]
    for t in texts:
        assert np.frombuffer(c.encode([t])[0], np.int32).tolist() == whole(t), t
    for i in range(5):
        c.encode(["word, " + " ".join(f"{chr(97 + i)}{k:x}." for k in range(300))])
    assert "word" in c.known and len(c.known) < 1000 and "word," not in c.known


def test_token_files(spark, tmp_path):
    rows, docs = odd_docs(spark)
    t = Tokenizer.from_file(token_files.TOKENIZER)
    ids = {(i, x): t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in set(rows)}
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(docs, folder, row_group=64 << 10, page=4 << 10, page_rows=8)
    got = token_files.read_documents(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows if i is not None)) + [None, None]
    want = sorted((str(i), ids[i, x]) for i, x in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert {(r.start, r.ids_crc32) for r in token_files.digests(token_files.read_documents(spark, folder)).collect()} == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    stream = [x for r in got for x in r.ids]
    for first, last in ((0, 5), (3, 3), (17, 900), (len(stream) - 20, len(stream) + 9), (0, len(stream)), (len(stream), len(stream) + 1)):
        part = token_files.read_range(spark, folder, first, last).orderBy("start").collect()
        assert [x for r in part for x in r.ids] == stream[first:last]
        assert all(stream[r.start : r.start + len(r.ids)] == r.ids for r in part)
    assert [r.doc_id for r in token_files.read_documents(spark, folder, F.col("doc_id").isin(7, 101)).orderBy("start").collect()] == [7, 7, 7, 7, 101]


def test_layout_of_token_files(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("the same words in every text")).alias("text"))
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(docs, folder, row_group=32 << 10, page=4 << 10, page_rows=64)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    assert sum(f.num_rows for f in files) == 3000
    assert max(f.num_row_groups for f in files) > 1
    column = {files[0].schema.column(k).path: k for k in range(files[0].num_columns)}
    for f in files:
        for g in range(f.num_row_groups):
            ids, at = f.row_group(g).column(column["ids.list.element"]), f.row_group(g).column(column["at"])
            assert ids.has_dictionary_page and ids.has_offset_index and at.has_offset_index and at.has_column_index
            assert "DELTA_BINARY_PACKED" in at.encodings and not at.has_dictionary_page
    plan = token_files.shards(spark, folder)
    assert sum(r.n_docs for r in plan.collect()) == 3000
    shown = spark.read.parquet(folder).groupBy("shard").agg(F.max("stop"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<shard:int,stop:bigint>" in shown


def test_empty_token_files(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert token_files.digests(token_files.read_documents(spark, folder)).collect() == []
    assert token_files.read_range(spark, folder, 0, 10).collect() == []


def brute_weights(docs, target, n, n_buckets, percent, least, seed):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "").translate(low)).split(" ") if w]

    def features(t):
        ws = split(t)
        return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % n_buckets for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for _, x in docs:
        np.add.at(s, np.array(features(x), int), 1)
    for x in target:
        np.add.at(t, np.array(features(x), int), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + n_buckets) / ((s[b] + 1) * (t.sum() + n_buckets)))) for b in range(n_buckets)]
    out = []
    for i, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(split(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able):
        r.append(place + 1 if place < len(able) * percent // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=str)


@pytest.mark.parametrize(("n", "n_buckets", "percent", "least", "seed"), [(1, 10_000, 10, 20, 2024), (3, 65_536, 50, 1, 7), (2, 7, 100, 0, 1)])
def test_resampling(spark, monkeypatch, n, n_buckets, percent, least, seed):
    monkeypatch.setattr(target_resampling, "PIECE", 11)
    rows, docs = odd_docs(spark)
    rows = [r for r in rows if r[0] != 103]
    target = ["a b c ABC", None, "", "éñ no id a b"]
    items = spark.createDataFrame([(f"item {i}", x) for i, x in enumerate(target)], "item_id string, text string")
    got = target_resampling.target_resampling(docs.where("doc_id is null or doc_id <> 103"), items, n, n_buckets, percent, least, seed)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_weights(rows, target, n, n_buckets, percent, least, seed)


def test_long_text_and_no_target(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    long = spark.createDataFrame([(1, "Some words " * 400_000), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in target_resampling.target_resampling(long, none, min_words=1, percent=100).collect()}
    assert (got[1].n_features, got[1].rank, got[2].n_features, got[2].weight, got[2].rank) == (800_000, 1, 0, 0, None)
    assert target_resampling.target_resampling(long.where("false"), none).collect() == []
    with pytest.raises(ValueError):
        target_resampling.bucket_streams(long, n_buckets=65_537)


def test_ranks_of_equal_rows(spark):
    same = spark.range(5000).select(F.lit(4).alias("doc_id"), F.lit("one two three").alias("text"))
    got = target_resampling.target_resampling(same, same.limit(1), min_words=3, percent=40)
    assert sorted(r.rank for r in got.where("rank is not null").collect()) == list(range(1, 2001))
    assert got.count() == 5000


def brute_repair(roles, texts):
    """Every edit of short conversations, with at most two inserts in a row."""
    seen, marks = set(), []
    for r, x in zip(roles, texts, strict=True):
        bare = x.strip(" \t\n\r\x0b\x0c")
        marks.append("b" if not bare else "d" if (r, x) in seen else "." if bare[-1] in ".!?" else "t")
        seen.add((r, x))
    best = None
    for inserts in itertools.product(range(3), repeat=len(roles) + 1):
        if sum(inserts) > 4:
            continue
        for edits in itertools.product("DKR", repeat=len(roles)):
            if any(m in "bd" and e != "D" for m, e in zip(marks, edits, strict=True)):
                continue
            audit = "".join("I" * k + e for k, e in zip(inserts, (*edits, ""), strict=True))
            cost = 5 * sum(inserts) + sum({"D": 2, "K": 0, "R": 1}[e] + (5 if m == "t" and e != "D" else 0) for m, e in zip(marks, edits, strict=True))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            out, i = [], 0
            for e in audit:
                if e == "I":
                    out.append((None, ""))
                else:
                    if e != "D":
                        out.append((roles[i] if e == "K" else None, texts[i]))
                    i += 1
            at, ok = 1 if out and out[0][0] is not None and out[0][0][:1] == "s" else 0, True
            for o, (role, text) in enumerate(out[at:]):
                due = ("user", "assistant")[o % 2]
                ok = ok and (role is None or role[:1] == due[0])
                out[at + o] = (role or due, text)
            if ok and (len(out) - at) % 2 == 0 and (not out or len(out) > at):
                best = (cost, audit, "\n".join(f"{r}:{x}" for r, x in out))
    pairs = [a[:1] + b[:1] for a, b in zip(roles, roles[1:], strict=False)]
    return (*(marks.count(m) for m in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


@pytest.mark.parametrize(("most_turns", "most_chars"), [(1024, 1 << 20), (1, 1 << 20), (2, 6)])
def test_repairs_of_short_conversations(spark, most_turns, most_chars):
    rng = random.Random(3)
    texts = ["a.", "b", "a.", " \n", "", "c?! ", "dd"]
    convs = {c: [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "unknown"]), rng.choice(texts)) for _ in range(rng.randint(0, 4))] for c in range(220)}
    rows = [(c, k, r, x, True) for c, turns in convs.items() for k, (r, x) in enumerate(turns)] + [(c, 0, "user", "", False) for c, turns in convs.items() if not turns]
    damaged = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean").repartition(3)
    got = {r.conv_id: tuple(r)[2:] for r in chat_repair.digest(chat_repair.repair_conversations(damaged, most_turns, most_chars)).collect()}
    assert got == {c: brute_repair([r for r, _ in turns], [x for _, x in turns]) for c, turns in convs.items()}


def test_a_hot_conversation_in_segments(spark):
    """Whatever the cut, the same edits."""
    rng = random.Random(8)
    turns = spark.createDataFrame([(1, k if k % 7 else None, rng.choice(["user", "assistant", "system", None]), rng.choice([f"t{k}.", f"t{k}", "same.", None]), "x") for k in range(1500)] + [(None, 1, "user", "null id.", "y"), (None, 2, "assistant", "yes.", "y")], "conv_id long, turn long, role string, text string, part string")
    damaged = chat_repair.damage(turns)
    whole = sorted(map(str, chat_repair.digest(chat_repair.repair_conversations(damaged, 10_000)).collect()))
    assert whole == sorted(map(str, chat_repair.digest(chat_repair.repair_conversations(damaged, 9)).collect()))
    assert whole == sorted(map(str, chat_repair.digest(chat_repair.repair_conversations(damaged, 200, 40)).collect()))
    assert chat_repair.segments(damaged, 9).count() > 100


def test_damage(spark):
    turns = [(c, k, "assistant", "One. Two! Three?") for c in range(40) for k in range(6)] + [(None, None, None, None)]
    got = chat_repair.damage(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, k, r, x in turns:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if k is None else k}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        row = (c, k, "user" if kind == 4 else r, "" if kind in (0, 1) else x.translate({46: None, 33: None, 63: None}) if kind == 2 else x, kind != 0)
        want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_nothing_left_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = chat_repair.digest(chat_repair.repair_conversations(chat_repair.damage(spark.createDataFrame([(dropped, 0, "user", "hi.")], schema)))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert chat_repair.digest(chat_repair.repair_conversations(chat_repair.damage(spark.createDataFrame([], schema)))).collect() == []
