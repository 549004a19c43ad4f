"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from soundlake.llm.substring_dedup import substring_dedup
from soundlake.llm.suffix_dedup import CORE, LENGTH, REACH, WIDTH, corpus_order, suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes long, keep string"


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (14, 40, 60, 13, 90)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), p)
        docs.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    docs += [docs[3], docs[5] + " tail", "x" + docs[7], "a" * 500, "ab" * 300, "a" * 199, "a b " * 40, "", None, passages[4], "\x00 \x1f" * 30, "é" * 150]
    near = passages[4].split() + passages[2].split()
    for _ in range(20):
        copy = list(near)
        copy[rng.randrange(len(copy))] = word()
        docs.append(" ".join(copy))
    rows = [(i * 3 % 997, t) for i, t in enumerate(docs)]
    return [*rows, rows[0], (None, docs[3]), (None, passages[2])]


def words_brute(rows):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = [1 << 62 if i is None else i for i, _ in rows]
    least = {}
    for k, w in zip(key, cut, strict=True):
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            least[g] = min(least.get(g, 1 << 63), k)
    out = []
    for (i, _), k, w in zip(rows, key, cut, strict=True):
        gone = set()
        for j in range(len(w) - 12):
            if least[tuple(w[j : j + 13])] < k:
                gone |= set(range(j, j + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return Counter(out)


def bytes_brute(rows, n=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[j : j + n] for d in data for j in range(len(d) - n + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for j in range(len(d) - n + 1):
            if seen[d[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, "other") for i, t in rows], SCHEMA).repartition(3)
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == words_brute(rows)
    got = suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == bytes_brute(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(docs).count() == suffix_dedup(docs).count() == 0


def test_many_packs(spark):
    """One document a partition, so that every answer comes from other packs."""
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(len(rows))
    got = suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == bytes_brute(rows)
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == words_brute(rows)


def bytes_of(docs, **kw):
    return Counter(map(tuple, suffix_dedup(docs, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


def test_crowded_cores(spark):
    """With hardly any core sorted, strings are compared by hash: same rows."""
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(7)
    assert bytes_of(docs, most_sorted=3) == bytes_brute(rows)


def test_corpus_order_against_naive_suffixes():
    rng = random.Random(5)
    body = np.array([[rng.choice(b"ab\0") for _ in range(WIDTH)] for _ in range(60)], np.uint8)
    for i in range(1, 60):  # neighbours share all but a short head or tail
        body[i, rng.randrange(60) : WIDTH - rng.randrange(60)] = body[i - 1, : WIDTH][0]
        body[i, REACH - 1 - rng.randrange(40) : REACH - 1 + CORE + rng.randrange(LENGTH - CORE)] = 97
    nearest = np.array([rng.randrange(20) for _ in body])
    farthest = nearest + [rng.randrange(100) for _ in body]
    for d, here, same in corpus_order(body, nearest, farthest):
        suffix = [body[i, REACH - 1 - d :].tobytes() for i in here]
        assert suffix == sorted(suffix) and set(here) == {i for i in range(60) if nearest[i] <= d <= farthest[i]}
        assert [False, *(a[:LENGTH] == b[:LENGTH] for a, b in zip(suffix, suffix[1:]))][: len(here)] == same.tolist()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_regular_and_long_texts(spark):
    """Complementary Thue-Morse texts, which polynomials modulo powers of 2 don't tell apart, and a text longer than a block."""
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300_000))
    words = " ".join(f"w{j}" for j in range(6))
    rows = [(1, f"{one} {words} {words} {words}"), (2, f"{two} {words} {words} {words}"), (3, long), (4, long[500_000:502_000])]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(2)
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == words_brute(rows)
    assert bytes_of(docs) == bytes_brute(rows)
