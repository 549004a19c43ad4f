"""The pipeline's stages against brute force, each on its own input, and the whole run on the smallest tables."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from soundlake.llm import blocks, stages
from soundlake.llm.shared import BATCH_BYTES

from .test_lines_and_leaks import leaks_brute, lines_brute, rows_of
from .test_near_and_quality import near_brute, near_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], SCHEMA)


def test_lines(spark):
    rows = rows_of(3)
    got = stages.lines(spark, docs_of(spark, rows), "").collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.doc_id, digest(r.text)) for r in got) == Counter({k: n for k, n in Counter((i, s) for (i, _, _, s), c in lines_brute(rows).items() for _ in range(c)).items()})
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_near(spark):
    rows = near_rows(4)
    got = stages.near(spark, docs_of(spark, rows), "")
    assert got.columns == docs_of(spark, rows[:1]).columns
    want = Counter(i for (i, _, _, kept), c in near_brute(rows, 5).items() for _ in range(c) if kept)
    assert Counter(r.doc_id for r in got.collect()) == want


def test_decontaminated(spark, tmp_path):
    rows = rows_of(6)
    texts = [t for _, t in rows if t]
    items = [(j, texts[j]) for j in range(5)] + [(90, None), (91, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = stages.decontaminated(spark, docs_of(spark, rows), str(tmp_path)).collect()
    want = Counter(i for (i, *_, hit), c in leaks_brute(rows, items).items() for _ in range(c) if not hit)
    assert Counter(r.doc_id for r in got) == want


def test_packed(spark):
    rows = rows_of(7)
    got = stages.packed(spark, docs_of(spark, rows), "").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    places = Counter((r.bucket, r.batch, r.slot) for r in got)
    sizes = Counter((r.bucket, r.batch, r.bucket_len) for r in got)
    assert max(places.values()) == 1 and all(n == 1 or n * length <= 65_536 for (_, _, length), n in sizes.items())


def test_workers_hold_little(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for stage in (stages.lines, stages.near, stages.packed):
        spark.conf.unset(key)
        stage(spark, docs_of(spark, rows_of(7)), "")
        wide = spark.range(0, 500, 1, 1).select(F.repeat(F.lit("ab "), 5_000).alias("text"))
        assert max(r.n for r in wide.mapInArrow(sizes, "n long").collect()) <= BATCH_BYTES + 20_000


def test_powers_grow_with_blocks():
    data = np.random.default_rng(1).integers(0, 256, 5_000, np.uint8)
    blocks._powers.clear()
    few = blocks.Spans(data[:300])(np.array([0, 17]), np.array([300, 90]))
    assert sum(x.nbytes for x in blocks._powers[0]) < 100_000
    assert (blocks.Spans(data)(np.array([0, 17]), np.array([300, 90])) == few).all()
    assert all(len(x) > 5_000 for x in blocks._powers[0])


def test_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema if stage is not stages.packed else stage(spark, docs, sf_dir).schema)
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == docs.columns
    assert 0 < got.count() == docs.count() and {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
