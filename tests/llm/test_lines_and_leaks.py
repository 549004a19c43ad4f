"""Line dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from soundlake.llm.decontaminate import decontaminate
from soundlake.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, item string, line long, row_key string, n long"
WS = " \t\n\x0b\x0c\r"


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcDEé9") for _ in range(rng.randint(1, 5)))
    lines = [" ".join(word() for _ in range(rng.randint(1, 20))) for _ in range(60)] + ["", "short", " wide space line ", "x" * 9, "y" * 10, "É" * 10]
    docs = ["\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.lower, str.upper, str])(rng.choice(lines)) + rng.choice(["", "\r"]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    docs += [None, "", "\n", "\n\n", lines[0], "the hot line of all\n" + lines[1]] + ["the hot line of all"] * 40
    rows = [(i * 7 % 1009, t) for i, t in enumerate(docs)]
    return [*rows, rows[4], (None, docs[0]), (None, docs[1])]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def lines_brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k := low(x.strip(WS))) >= 10:
                holders[k].add(1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(k := low(x.strip(WS))) < 10 or min(holders[k]) == (1 << 62 if i is None else i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, t, "", 0, "", 1) for i, t in rows], SCHEMA)
    for n in ("3", "17"):  # 17: runs go over partitions' edges
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", str(n == "3").lower())
        try:
            assert Counter(map(tuple, line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == lines_brute(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def leaks_brute(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[j : j + n])].add(i)
    out = []
    for i, t in rows:
        w = cut(t)
        hit, named = set(), set()
        for n in range(1, 11):
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in wins:
                    hit |= set(range(j, j + n))
                    named |= wins[g]
        named = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("bound", [1 << 20, 3])
def test_leaks(spark, bound):
    rows = rows_of(5)
    texts = [t for _, t in rows if t]
    items = [(j, texts[j]) for j in range(12)] + [(90, "abc, DEF"), (91, None), (92, ""), (93, "!!"), (None, texts[20]), (5, texts[21]), (94, "hot LINE, of all"), (10, "the")]
    docs = spark.createDataFrame([(i, t, "", 0, "", 1) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert Counter(map(tuple, decontaminate(docs, bench, max_broadcast=bound).collect())) == leaks_brute(rows, items)


def test_empty(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert line_dedup(docs).count() == decontaminate(docs, bench).count() == 0
    docs = spark.createDataFrame([(1, "a b", "", 0, "", 1)], SCHEMA)
    assert decontaminate(docs, bench).collect()[0].n_hit == 0
