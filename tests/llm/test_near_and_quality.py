"""Near duplicates against all pairs; the quality classifier on held-out rows."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from soundlake.llm import quality, stages
from soundlake.llm.blocks import blocks
from soundlake.llm.components import components
from soundlake.llm.near_dedup import _by_differences, near_dedup
from soundlake.llm.quality import gumbel_top_k, resample

SCHEMA = "doc_id long, text string, n long, body string, bands string"


def near_brute(rows, k=2):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    cut = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(cut):
        for j, t in cut[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else root(i) if s else i, i is None or not s or root(i) == i) for i, s in cut)


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("XYZuvwé") * rng.randint(1, 3)
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice((1, 2, 3, 8, 30, 120)))]
        for _ in range(rng.choice((1, 1, 2, 12))):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, rng.choice((" ", "\n", "  ")).join(copy)))
            i += 1
    chain = [word() for _ in range(200)]
    for _ in range(25):  # each a little further from the first
        rows.append((i, " ".join(chain)))
        for _ in range(6):
            chain[rng.randrange(200)] = word()
        i += 1
    rng.shuffle(rows)
    return [*rows, rows[0], (5000, None), (5001, ""), (5002, " \n"), (None, rows[1][1]), (5003, "one"), (5004, "ONE"), (5005, "two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    rows = near_rows(seed)
    docs = spark.createDataFrame([(i, t, 1, "", "") for i, t in rows], SCHEMA)
    for rounds in (0, 2):
        assert Counter(map(tuple, near_dedup(docs, shingle=2, pivot_rounds=rounds).collect())) == near_brute(rows)
    assert Counter(map(tuple, near_dedup(docs).collect())) == near_brute(rows, 5)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}
    for a, b in pairs:
        if a is None or a == b:
            continue
        x, y = a, b
        while parent.setdefault(x, x) != x:
            x = parent[x]
        while parent.setdefault(y, y) != y:
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    for n in parent:
        x = n
        while parent[x] != x:
            x = parent[x]
        assert got[n] == x
    assert len(got) == len(parent)


def test_quality(spark):
    rng = random.Random(9)
    good = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels, bad = [], [], set()
    for i in range(1500):
        w = [rng.choice(good) for _ in range(rng.randint(20, 80))]
        kind = rng.random()
        if kind < 0.15:
            w = [x.upper() + "!!" for x in w]
        elif kind < 0.3:
            w[3:3] = [rng.choice(("vexgrum", "vexpoll", "zoggle"))] * 2
        if kind < 0.3:
            bad.add(i)
        rows.append((i, " ".join(w), 1, "", ""))
        if i % 2:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    rows += [(None, "text", 1, "", ""), (9000, None, 1, "", ""), (9001, "", 1, "", "")]
    labels += [(None, 1, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [r.doc_id for r in resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    assert not bad & set(kept) and len(kept) == len(rows) - len(bad)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample(docs, none).count() == len(rows)
    assert resample(docs.limit(0), none).count() == 0


def _made(rng, n, size=60):
    return ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 7))) for _ in range(n)], lambda words: [rng.choice(words) for _ in range(size)]


def _taken(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 1, "", "") for i, t in rows], SCHEMA)
    return {r.doc_id for r in resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}


def test_quality_stage_with_few_labels(spark, tmp_path):
    rng = random.Random(11)
    vocabulary, text = _made(rng, 300)
    bad = {i for i in range(200) if i % 10 == 0}
    rows = [(i, " ".join(x.upper() + "!!" if i in bad else x for x in text(vocabulary)), 1, "", "") for i in range(200)]
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(0, 200) if i % 3 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in stages.quality(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert kept == set(range(200)) - bad


def test_quality_keeps_long_clean_texts(spark):
    rng = random.Random(12)
    vocabulary, text = _made(rng, 300)
    marks = [f"zq{rng.randrange(10**9)}{j}" for j in range(2500)]
    bad = {i for i in range(600) if i % 4 == 0}
    rows = [(i, " ".join(marks if i in bad else text(vocabulary))) for i in range(600)]
    rows += [(1000 + j, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(8)) for _ in range(9000))) for j in range(3)]
    kept = _taken(spark, rows, [(i, int(i not in bad), 0) for i in range(600)])
    assert not kept & bad and {1000, 1001, 1002} <= kept and len(kept) == len(rows) - len(bad)


def test_quality_phrases_and_unlabelled_kinds(spark):
    rng = random.Random(13)
    vocabulary, text = _made(rng, 300)
    rows, labels, bad = [], [], set()
    for i in range(1000):
        w = text(vocabulary)
        w[5:5], w[30:30] = ["hollow"], ["lantern"]  # both words are in every text
        if i % 5 == 0:
            w[50:50] = ["hollow", "lantern"]
        elif i % 5 == 1:
            w = [f"{x}@{x}" for x in w]  # no labelled text is like these
        bad |= {i} if i % 5 < 2 else set()
        rows.append((i, " ".join(w)))
        if i % 5 != 1:
            labels.append((i, 1, int(i % 5 == 0)))
    kept = _taken(spark, rows, labels)
    assert not kept & bad and len(kept) == len(rows) - len(bad)


def test_gumbel_top_k(spark):
    for key in (F.pmod(F.xxhash64("id"), F.lit(1000)) / 70.0 - 5, F.pmod(F.xxhash64("id"), F.lit(30)) * -1e3 - 1e6, F.lit(0.5)):
        rows = spark.range(3000).select("id", key.cast("double").alias("key"))
        best = sorted((-r.key, r.id) for r in rows.collect())
        for k in (0, 1, 7, 1500, 2999, 3000, 4000):
            assert sorted((-r.key, r.id) for r in gumbel_top_k(rows, k, row="id").collect()) == best[:k]


def test_resampling_by_weight(spark):
    rng = random.Random(14)
    vocabulary, text = _made(rng, 200)
    rows = [(i, " ".join(x.upper() if i % 2 else x for x in text(vocabulary)), 1, "", "") for i in range(600)] * 2
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = resample(docs, labels, k=500).collect()
    assert len(got) == 500 and sum(r.doc_id % 2 == 0 for r in got) > 450
    assert {r.doc_id for r in got} != {r.doc_id for r in resample(docs, labels, k=500, seed=1).collect()}


def test_weights_against_brute_force(spark):
    rng = random.Random(15)
    vocabulary, text = _made(rng, 150, 25)
    rows = [(i, " ".join(x + "?!" if i % 7 == 0 and rng.random() < 0.3 else x for x in text(vocabulary)), 1, "", "") for i in range(400)]
    some = [(i, i % 7 > 0) for i in range(0, 400, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = quality.fit(docs.select("doc_id", "text").repartition(7), spark.createDataFrame(some, "doc_id long, good boolean"))
    held = {i: set(quality.features(next(blocks(pa.record_batch({"i": pa.array([i]), "t": pa.array([t])}))))[1].tolist()) for i, t, *_ in rows}
    raw = Counter(h for x in held.values() for h in x)
    target = Counter(h for i, good in some if good for h in held[i])
    n_target = sum(good for _, good in some)
    weight = {}
    for h, n in raw.items():
        t, e = target[h], n * n_target / 400
        deviance = 2 * ((t * math.log(t / e) if t else 0) - t + e)
        if deviance > 4 and (t >= 5 or n / 400 >= 2 / n_target):
            weight[h] = math.log((t + 1) / (e + 1)) * (1 - 4 / deviance)
    got = quality.weigh(docs.select("doc_id", "text", F.lit(0).cast("long").alias("row_key")), model, 2.0)
    for r in got.collect():
        assert abs(r.weight - sum(weight.get(h, 0) for h in held[r.doc_id])) < 1e-9


def test_a_cut_of_nothing(spark):
    """0 is the natural cut: rows whose weight lies above it stay."""
    docs = spark.createDataFrame([(i, ("good words of every kind here " if i % 2 else "buy cheap pills now now ") * 6) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = resample(docs, labels, cut=0.0).collect()
    assert all(r.weight > 0 and r.doc_id % 2 for r in kept) and len(kept) < 400


def test_a_cluster_under_a_foreign_pivot(spark):
    """Many near copies that share bands with a document that is similar to none of them; and the shingles that differ link nodes of other components only."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    pivot = base[:240] + [word() for _ in range(60)]
    rows = [(0, " ".join(pivot))]
    for i in range(1, 500):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = word()
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {0: 0} | dict.fromkeys(range(1, 500), 1)


def test_differences_against_all_pairs(spark):
    """Pairs of different components under one pivot whose differences share enough, each from the rarest shingles that they need."""
    rng = random.Random(23)
    percent, size = 80, 40
    pivot = frozenset(range(size))
    nodes = {}
    bases = [set(rng.sample(range(size), n)) | {1000 + 100 * n + k for k in range(12)} for n in (24, 28, 31, 35)]
    for x in range(1, 160):
        kind = rng.randrange(4)
        changed = bases[kind] ^ set(rng.sample(sorted(bases[kind]), rng.randint(0, 4))) | {9000 + 10 * x + k for k in range(rng.randint(0, 3))}
        nodes[x] = (frozenset(changed), 1 + kind if rng.random() < 0.7 else x)
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    rows = [(0, x, c, size, len(s), len(s ^ pivot), like(s, pivot), e) for x, (s, c) in nodes.items() for e in s ^ pivot]
    schema = "p long, x long, c long, np long, n long, d long, like boolean, e int"
    got = {(p.a, p.b) for p in _by_differences(spark.createDataFrame(rows, schema), percent).distinct().collect()}
    want = {(a, b) for a in nodes for b in nodes if a < b and nodes[a][1] != nodes[b][1] and like(nodes[a][0], nodes[b][0]) and not (like(nodes[a][0], pivot) and like(nodes[b][0], pivot))}
    assert len(want) > 100 and want <= got
    assert all(nodes[a][1] != nodes[b][1] for a, b in got)
