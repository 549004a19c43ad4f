"""Secrets, packing, media and chat against brute force and round trips."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from soundlake.llm import chat, media, secrets
from soundlake.llm.length_buckets import boundaries, pack, token_counts

SCHEMA = "doc_id long, text string, media string, findings int, bucket string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA)


# --- secrets


def base_brute(t):
    found = []
    word = "(password|passwd|secret|token|api_?key)"
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
    for m in re.finditer(either + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(spark):
    rng = random.Random(3)
    plain = "the quick brown identifiers userAccountName max_value_index wonderfulinternationalisation http/www.site.org/index.html".split()
    parts = [*plain, "é", "PassWord='", "api_key: ", "apikey=", "TOKEN = short", 'secret" : "abcdefgh', "toKen=abcdefghij", "AKIA" + "A1" * 8, "AKIAshort", "0123456789abcdef" * 2, "0123456789abcdef" * 5 + "g", "token=secret=abcdefghi", "\n"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(200)] + [(500, None), (501, ""), (None, "password=hunter22222")]
    secret = "Zq8vXw2LpTn4RkYb7MsJ"
    rows.append((502, f"see ñ {secret} here"))
    docs = docs_of(spark, rows)
    model = secrets.train(secrets.labelled_samples(docs))
    got = secrets.digest(secrets.find_secrets(docs, model)).collect()
    assert len(got) == len(rows)
    want = Counter((i, base_brute(t or "")) for i, t in rows)
    assert Counter((r.doc_id, ",".join(x for x in r.spans.split(",") if x and not x.startswith("random"))) for r in got) == want
    for r in got:
        base = [x for x in r.spans.split(",") if x and not x.startswith("random")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(base)
    assert next(r.spans for r in got if r.doc_id == 502) == f"random:6:{6 + len(secret)}"
    assert secrets.digest(secrets.find_secrets(docs.limit(0), model)).count() == 0


def test_secret_model_on_held_out_samples(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice(["ba", "ter", "lo", "ing", "sch", "est", "un"]) for _ in range(rng.randint(2, 5))) for _ in range(400)]
    docs = docs_of(spark, [(i, " ".join(rng.choices(words, k=60))) for i in range(60)])
    model = secrets.train(secrets.labelled_samples(docs))

    def score(t):
        d = np.frombuffer(t.encode(), np.uint8)
        return model.scores(d, np.array([0]), np.array([len(d)]))[0]

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = [score("".join(rng.choice(letters) for _ in range(24))) for _ in range(300)]
    ordinary = [score("_".join(rng.choices(words, k=3))) for _ in range(300)] + [score(f"{rng.randrange(10**16):016d}") for _ in range(100)]
    assert np.mean(np.array(drawn) >= secrets.MIN_LLR) > 0.97 and np.mean(np.array(ordinary) >= secrets.MIN_LLR) < 0.01


# --- packing


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_boundaries(cells, k):
    cells.sort()
    longest, counts = (np.array(x) for x in zip(*cells, strict=True))

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in cells)

    best = min(padding((*chosen, cells[-1][0])) for r in range(k) for chosen in itertools.combinations([n for n, _ in cells[:-1]], r))
    got = boundaries(longest, counts, k)
    assert len(got) <= k and got == sorted(got) and got[-1] == cells[-1][0] and padding(got) == best


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "bb.", "ñ", "x-y"]) for _ in range(rng.choice((0, 3, 40, 41, 700, 3000))))) for i in range(300)] + [(None, None), (3, "dup"), (3, "dup")]
    lengths = token_counts(docs_of(spark, rows))
    want = Counter((i, len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]", t or "", re.ASCII))) for i, t in rows)
    assert Counter(map(tuple, lengths.collect())) == want
    got = pack(lengths, n_buckets=5, token_budget=2000, shard_rows=20).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    fill = defaultdict(list)
    for (bucket, batch), members in batches.items():
        assert len(members) == 1 or len(members) * members[0].bucket_len <= 2000 or members[0].bucket_len == 0
        assert sorted(m.slot for m in members) == list(range(len(members)))
        fill[bucket].append((batch, len(members)))
    for counts in fill.values():  # all batches but the last are full
        counts.sort()
        assert [b for b, _ in counts] == list(range(len(counts))) and len({n for _, n in counts[:-1]}) <= 1
    assert pack(lengths.limit(0)).count() == 0


# --- media


def test_media(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abé\n") for _ in range(n))) for i, n in enumerate((0, 1, 63, 64, 65, 4000, 50_000))] + [(50, None), (None, "same"), (51, "same"), (51, "same")]
    got = media.describe(media.store_texts(docs_of(spark, rows))).collect()
    seen = {}
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, dict(rows).get(r.doc_id)))), strict=True):
        assert r.doc_id == i
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(raw, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
    assert media.describe(media.store_texts(docs_of(spark, [])).limit(0)).count() == 0


def _filtered(image, kind):
    """Plain filters of the format, byte by byte."""
    h, w, s = image.shape
    flat = image.reshape(h, w * s).astype(int)
    out = bytearray()
    for y in range(h):
        out.append(kind[y])
        for x in range(w * s):
            a = flat[y, x - s] if x >= s else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - s] if y and x >= s else 0
            p = a + b - c
            near = min((abs(p - v), k) for k, v in enumerate((a, b, c)))[1]
            out.append((flat[y, x] - (0, a, b, (a + b) // 2, (a, b, c)[near])[kind[y]]) % 256)
    return bytes(out)


@pytest.mark.parametrize("colour,samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters_and_checksums(colour, samples):
    rng = np.random.default_rng(colour)
    image = rng.integers(0, 256, (11, 7, samples), dtype=np.uint8)
    body = zlib.compress(_filtered(image, [0, 1, 1, 2, 2, 3, 3, 4, 4, 1, 2]))
    head = struct.pack(">IIBBBBB", 7, 11, 8, colour, 0, 0, 0)
    data = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", body[:20]) + media._chunk(b"IDAT", body[20:]) + media._chunk(b"IEND", b"")
    got = media.decode_png(data)
    assert np.array_equal(got.reshape(image.shape), image) and len(media.cosine_hash(got)) == 16
    for at in (5, 20, 60, len(data) - 3):
        with pytest.raises(ValueError):
            media.decode_png(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(data[:-6])


def test_similar_pictures_have_near_hashes():
    rng = np.random.default_rng(1)
    picture, other = (np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 16))).astype(np.uint8) for _ in range(2))
    bits = lambda a, b: bin(int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).count("1")
    assert bits(picture, picture[::2, ::2]) <= 12 < bits(picture, other)


# --- chat


@given(st.lists(st.sampled_from(["\\", "<", "turn>", "text>", "/turn>", "a", "é", "\n"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


@given(st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_codec(text):
    text = text.encode("utf-8", "ignore").decode()
    c = chat.codec(chat.TOKENIZER)
    ids = c.encode(text)
    assert c.decode(np.array(ids)) == text and not {c.start, c.sep, c.end} & set(ids)


@pytest.mark.parametrize("part", [65_536, 9])
def test_chat(spark, part):
    rng = random.Random(part)
    bits = ["\\### Assistant: </turn> ok", "<turn>", "<text>", "\\", "hello", "ñ 😀", "", None, "<\\turn>", "long " * 30]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<turn>", None]), rng.choice(bits), 1))
    rows += [rows[0], (None, None, "assistant", "x", 1), (None, 1, "assistant", "y", 1), (40, None, "user", "first", 1), (40, 0, "assistant", "second", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = chat.read_back(chat.format_conversations(turns, part_tokens=part)).collect()
    grouped = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        grouped[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(grouped)
    for r in got:
        own = sorted(grouped[r.conv_id], key=lambda x: x[0])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.escape(role)) + len(chat.escape(t)) + 19 for _, role, t in own)
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
