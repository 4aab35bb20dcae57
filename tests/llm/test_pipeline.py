"""The pipeline's stages against plain Python on a small table with odd rows."""

import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from parley.llm import pseudonyms as ps
from parley.llm import quality_classifier as qc
from parley.llm import sentence_pieces as sp
from tests.llm.conftest import SCHEMA, odd_rows
from tests.llm.test_simhash import fingerprint, groups


def test_stages_against_plain_python(spark, labels):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [tuple(r) for r in rows] + [(10_000 + i, *r[1:]) for i, r in enumerate(odd_rows())]
    sf_dir = tempfile.mkdtemp(prefix="parley-pipeline-")
    spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(sf_dir, "documents.parquet"))
    labels.write.parquet(os.path.join(sf_dir, "labels.parquet"))
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))

    good = cp.keep_quality(spark, docs, sf_dir)
    model = qc.train(docs, labels)
    scores = np.round(model.score(pa.array([r[1] for r in rows], pa.string())), 6)
    assert good.columns == docs.columns
    kept = [r for r, s in zip(rows, scores) if s >= qc.THRESHOLD]
    assert Counter(map(tuple, good.collect())) == Counter(kept)

    lone = cp.drop_near_copies(spark, spark.createDataFrame(kept, SCHEMA), sf_dir)
    assert sorted(r.doc_id for r in lone.collect()) == sorted(set(groups([(r[0], fingerprint(r[1])) for r in kept])))

    few = [r for r in kept if r[1]][:40]
    private = cp.pseudonymise(spark, spark.createDataFrame(few, SCHEMA), sf_dir)
    cipher = ps.Cipher()
    assert {r.doc_id: r.text for r in private.collect()} == {r[0]: ps.pseudonymise(r[1], cipher)[0] for r in few}

    ids = cp.encode(spark, private, sf_dir).collect()
    pieces = sp.load()
    assert {r.doc_id: sp.decode(r.ids, pieces) for r in ids} == {r[0]: ps.pseudonymise(r[1], cipher)[0] for r in few}


def test_stage_list():
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii", "mixing", "sentence_pieces"]
    assert cp.ORACLE_SQL is None
