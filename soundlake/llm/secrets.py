"""Secret scans: fixed patterns, and Markov models of random strings and identifiers.

Patterns find assignments, access keys and hex strings. The models are two
first-order character chains, trained by one grouped count from labelled samples:
random strings, and ordinary identifiers. Every run of 16 or more letters, digits
and ``+/_.=-`` outside the patterns' matches is a candidate; it is a finding,
of kind ``random``, if the logarithm of its likelihood under the model of random
strings less that under the model of identifiers reaches ``min_llr``.

Random samples are made by a rule (digests in three alphabets). Identifiers are
words of at most ``max_samples`` documents, those of least hash, alone and joined
by the usual conventions; words that a pattern matches are left out. This bounded
sample only trains the models; every text is scanned in full.

Nulls: a null text is empty and has no findings; a null doc_id is kept. Repeated
rows are scanned each. Texts of any length are scanned whole, in time proportional
to it. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, byte_set, words
from .shared import id_and_text

MIN_RUN, MIN_LLR, MAX_SAMPLES = 16, 20.0, 2_000
#: The alphabet of candidates and the patterns of the three kinds.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *((ord(c), ord(c)) for c in "+/_.=-"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in code points, sorted."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def labelled_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """(text, random): random strings by rule, and identifiers of at most max_samples documents."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 512)
    made = spark.range(20_000).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9+/]", ""), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 32)), F.regexp_replace(F.base64(F.unhex(F.substring(digest, 1, 60))), "[+/=]", "_"))).alias("text"),
        F.lit(True).alias("random"),
    )
    rows = id_and_text(docs, doc_id, text).select("text", F.xxhash64("text").alias("h")).where("text is not null")
    least = rows.select("h").distinct().orderBy("h").limit(max_samples)  # only hashes move
    rows = rows.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])
    clean = F.regexp_replace("text", r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", " ")
    found = rows.select(F.regexp_extract_all(clean, F.lit(r"[A-Za-z][A-Za-z0-9+/_.=-]{3,}"), F.lit(0)).alias("w")).where("size(w) >= 3")
    joined = [F.array_join(F.slice("w", 1, 3), sep) for sep in ("_", "-", ".", "/")] + [F.array_join(F.transform(F.slice("w", 1, 3), F.initcap), "")]  # one name a document and convention
    usual = spark.createDataFrame([(f"{a}{s}{b}{s}{c}{d}",) for s in ("_", "-", ".", "/", "") for a in ("get", "user", "http", "max") for b in ("Account", "value", "path", "request") for c in ("Name", "index", "2", "html") for d in ("", "1", "2024", ".txt")], "text string")
    names = found.select(F.explode(F.array_union(F.col("w"), F.array(*joined))).alias("text")).union(usual)
    numbers = spark.range(5_000).select(F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string"), 16, "0").alias("text"))  # serial, card and phone numbers
    rules = spark.range(100).select(F.explode(F.array(*(F.lit(c * 24) for c in "-=_.+/"))).alias("text"))
    return made.union(names.union(numbers).union(rules).withColumn("random", F.lit(False)))


class Model:
    """Log-likelihood ratio of each pair of characters; row 0 stands for the start."""

    def __init__(self, counts: dict[tuple[bool, str], int], prior: float = 0.5):
        place = {c: i + 1 for i, c in enumerate(ALPHABET)}
        n = np.full((2, len(ALPHABET) + 1, len(ALPHABET)), prior)
        for (random, pair), c in counts.items():
            a, b = pair[0], pair[1]
            if b in place and (a == "\x01" or a in place):
                n[int(random), place.get(a, 0), place[b] - 1] += c
        logs = np.log(n / n.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]
        self.code = np.zeros(256, np.int64)
        for c, i in place.items():
            self.code[ord(c)] = i

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ratio of each run of the alphabet's bytes."""
        if not len(starts):
            return np.empty(0)
        codes = self.code[data]
        before = np.concatenate([[0], codes[:-1]])
        before[starts] = 0
        sums = np.concatenate([[0.0], np.cumsum(np.where(codes > 0, self.ratio[before, codes - 1], 0.0))])
        return sums[ends] - sums[starts]


def train(samples: DataFrame, prior: float = 0.5) -> Model:
    """Counts of neighbouring characters by label; at most 2 x 69 x 68 of them come to the driver."""
    t = F.concat(F.lit("\x01"), F.col("text"))
    pairs = samples.where("length(text) >= 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).alias("pair"))
    pairs = pairs.where(F.col("pair").rlike(r"^[\x01A-Za-z0-9+/_.=-][A-Za-z0-9+/_.=-]$"))
    return Model({(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}, prior)


def _outside(starts: np.ndarray, ends: np.ndarray, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Which spans share no place with those of base (sorted by start)."""
    if not base:
        return np.ones(len(starts), bool)
    reach = np.append(-1, np.maximum.accumulate([e for _, _, e in base]))
    return reach[np.searchsorted([s for s, _, _ in base], ends)] <= starts


def find_secrets(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", min_llr: float = MIN_LLR, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, findings): arrays of (kind, start, end) in code points, by start, then kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                runs = words(b, _RUN)
                long = runs.ends - runs.starts >= min_run
                starts, ends, row = runs.starts[long], runs.ends[long], runs.row[long]
                hit = model.scores(b.data, starts, ends) >= min_llr
                starts, ends, row = starts[hit], ends[hit], row[hit]
                points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
                size, starts = ends - starts, points[starts] - points[b.offsets[row]]  # a run is ASCII
                first = np.searchsorted(row, np.arange(len(b) + 1))
                found = []
                for i, t in enumerate(batch.column(1).slice(b.lo, len(b)).to_pylist()):
                    base = base_spans(t or "")
                    s, e = (x[first[i] : first[i + 1]] for x in (starts, starts + size))
                    free = _outside(s, e, base)
                    more = [(x, 3, y) for x, y in zip(s[free].tolist(), e[free].tolist(), strict=True)]
                    found.append([{"kind": KINDS[k], "start": x, "end": y} for x, k, y in sorted(base + more)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, len(b)), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "findings"])

    return id_and_text(docs, doc_id, text).mapInArrow(scan, "doc_id long, findings array<struct<kind: string, start: bigint, end: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the patterns' spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("findings", lambda f: f["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        count("random").alias("n_random"),
    )
