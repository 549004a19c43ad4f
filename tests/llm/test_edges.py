"""Cases that every operator must take: long texts, regular texts, nulls, repeated rows, clashing names, hot conversations."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundlake.llm import chat, media, secrets, shared, stages
from soundlake.llm.decontaminate import decontaminate
from soundlake.llm.length_buckets import boundaries, pack, token_counts
from soundlake.llm.line_dedup import line_dedup
from soundlake.llm.near_dedup import near_dedup
from soundlake.llm.quality import resample

#: Names that the operators use themselves.
CLASHING = "doc_id long, text string, keep string, n_dropped int, __keep string, __id long, __key string, __n_dropped int, row_key long, n_chars long"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


ONE = thue_morse(2048)
TWO = ONE.translate(str.maketrans("ab", "ba"))


def test_regular_texts(spark):
    """Complementary Thue-Morse strings, which polynomials modulo powers of 2 don't tell apart."""
    docs = spark.createDataFrame([(1, ONE), (2, TWO)], "doc_id long, text string")
    assert {(r.n_lines, r.n_dropped) for r in line_dedup(docs).collect()} == {(1, 0)}
    assert {r.component_id for r in near_dedup(docs).collect()} == {1, 2}
    item = spark.createDataFrame([(7, ONE)], "item_id long, text string")
    assert {r.doc_id: r.n_items for r in decontaminate(docs, item).collect()} == {1: 1, 2: 0}


def long_rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(3, 9)))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(35_000))
    assert len(long.encode()) > 2 << 20
    return [(1, long), (2, long + "\ntail of the copy"), (3, "short text, api_key = abcdefgh12345"), (3, "short text, api_key = abcdefgh12345"), (4, None), (5, ""), (None, "no id"), (None, None)]


def test_long_and_odd_rows(spark, tmp_path):
    rows = long_rows()
    long = rows[0][1]
    docs = spark.createDataFrame([(i, t, "", 1, "", 5, "", 2, 9, len(t or "")) for i, t in rows], CLASHING).repartition(3)
    n = len(rows)
    found = secrets.digest(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs)))).collect()
    assert len(found) == n and sum(r.n_assign for r in found) == 2
    item = " ".join(long.split()[200_000:200_012])
    items = spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string")
    for most in (1 << 20, 0):
        got = decontaminate(docs, items, max_broadcast=most).collect()
        assert len(got) == n and sorted(r.doc_id for r in got if r.contaminated) == [1, 2]
    packed = pack(token_counts(docs, with_text=True)).collect()
    assert len(packed) == n and sorted(str(r.text) for r in packed) == sorted(str(t) for _, t in rows)
    assert all(r.padding >= 0 for r in packed)
    stored = media.describe(media.store_texts(docs)).collect()
    payload = (long.encode() + bytes(-len(long.encode()) % 64))
    assert next(r.payload_sha256 for r in stored if r.doc_id == 1) == hashlib.sha256(payload).hexdigest() and len(stored) == n
    lines = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert lines[2].n_lines == 35_001 and lines[2].n_dropped == 35_000 and lines[1].n_dropped == 0
    near = near_dedup(docs).collect()
    assert len(near) == n and {r.component_id for r in near if r.doc_id in (1, 2)} == {1}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int")
    assert resample(docs, labels).count() == n
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    cut = stages.lines(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and cut.count() == n
    assert next(r.text for r in cut.collect() if r.doc_id == 2) == "tail of the copy"
    clean = stages.decontaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.where("doc_id in (1, 2)").count() == 0 and clean.count() == n - 2


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], CLASHING)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (stages.quality, stages.lines, stages.near, stages.decontaminated, stages.packed):
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_boundaries_of_many_lengths():
    """Against the plain recurrence, over lengths that all differ."""
    rng = np.random.default_rng(3)
    size = np.unique(rng.integers(0, 3000, 120))
    counts = rng.integers(1, 50, len(size))
    rows = np.concatenate([[0], np.cumsum(counts)])
    for k in (1, 2, 5, 16):
        best = size * rows[1:]
        for _ in range(k - 1):
            best = np.array([min([best[j], *(best[i] + size[j] * (rows[j + 1] - rows[i + 1]) for i in range(j))]) for j in range(len(size))])
        ends = boundaries(size, counts, k)
        assert len(ends) <= k and ends[-1] == size[-1]
        assert sum(c * min(e for e in ends if e >= s) for s, c in zip(size, counts)) == best[-1]


def test_spans_outside():
    rng = random.Random(4)
    base = sorted((s := rng.randrange(300), rng.randrange(3), s + rng.randrange(1, 40)) for _ in range(12))
    spans = np.array(sorted((s := rng.randrange(330), s + 16) for _ in range(80)))
    want = [all(e <= x or y <= s for x, _, y in base) for s, e in spans.tolist()]
    assert secrets._outside(spans[:, 0], spans[:, 1], base).tolist() == want


def test_hot_conversation(spark):
    """One conversation in many parts and partitions, with a turn that has no place to cut."""
    texts = ["x" * 50_000 + " <turn>", "\\### Assistant: </turn> ok", *(f"turn {j} says é" for j in range(400))]
    turns = spark.createDataFrame([(9, j, "assistant" if j % 2 else "user", t) for j, t in enumerate(texts)] + [(None, None, None, None), (8, 0, "user", "hi")], "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    formatted = shared.checkpointed(chat.format_conversations(turns, part_tokens=200))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert formatted.where("conv_id = 9").count() > 10 and formatted.select(F.spark_partition_id()).distinct().count() > 1
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    whole = "".join(f"{'assistant' if j % 2 else 'user'}\n{t}\n" for j, t in enumerate(texts))
    loss = "".join(t for j, t in enumerate(texts) if j % 2)
    assert got[9].n_turns == len(texts) and got[9].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert got[9].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[9].loss_chars == len(loss)
    assert got[None].n_turns == got[8].n_turns == 1 and len(got) == 3
    c = chat.codec(chat.TOKENIZER)
    first = formatted.where("conv_id = 9").orderBy("part").first().input_ids
    assert first[first.index(c.sep) + 1 : first.index(c.end)] == c.codec.encode_ordinary(chat.escape(texts[0]))


def test_no_local_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *_: None)

    class Frame:
        sparkSession = Session

    with pytest.raises(ValueError):
        shared.checkpointed(Frame)
