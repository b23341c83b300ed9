"""The pipeline against plain versions: every stage on its own input, and run() as a whole."""

import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colorjobs.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def plain_votes(spark, docs):
    """doc_id -> score: one document after the other, its cosines sorted."""
    labels = quality.table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.select("doc_id", "text"), labels, F.coalesce(quality.crc_mod("doc_id", 3) != 1, F.lit(False)))
    known, out = model.known.astype(float), {}
    for r in docs.collect():
        v = model.latent(r.text).astype(float)
        cosine = known @ v / max(1e-9, np.linalg.norm(v))
        best = sorted(range(len(known)), key=lambda k: -cosine[k])[: model.k]
        w = np.maximum(cosine[best], 1e-6) ** 4
        out[r.doc_id] = float((w * model.labels[best]).sum() / w.sum())
    return out


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs.collect()
        scores = plain_votes(spark, docs) if name.startswith("quality") else None
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id for r in docs.collect()}
        if scores:
            assert len(after) < len(before) and all((s >= 0.5) == (i in after) for i, s in scores.items() if abs(s - 0.5) > 1e-4)
        if name.startswith("SimHash"):
            assert after == set(plain.components({r.doc_id: plain.fingerprint(r.text) for r in before}).values())
        if name.startswith("benchmark"):
            verdict = plain.contaminated([(r.doc_id, r.text) for r in before], bench)
            assert after == {i for i, v in verdict.items() if not v[4]}
    before = docs.collect()
    size = {r.doc_id: len(plain.WORD.findall(r.text or "")) for r in before}
    mixed = corpus_pipeline.cut(corpus_pipeline.STAGES[3][1](spark, docs, SF), "test")
    assert mixed.columns == docs.columns
    rows, sizes, got, copies = mixed.collect(), {}, {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + size[r.doc_id]
    for r in rows:
        got[r.source] = got.get(r.source, 0) + size[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    want = plain.targets(sizes)
    assert set(copies) <= {r.doc_id for r in before} and max(copies.values()) <= 3
    assert all(abs(got.get(s, 0) - want[s]) <= max(5, 0.01 * want[s]) for s in want)
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = sorted(tuple(r) for r in corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect())
    assert out == expected
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == expected
