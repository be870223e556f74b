"""The pipeline against its stages done by hand."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import pii, quality, simhash, toxicity
from engram.llm.common import table
from tests.llm.test_exact import plain_groups


def test_stages_by_hand(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    keys = sorted(docs)
    patterns = quality._patterns(pa.array([docs[k] for k in keys], pa.string()), quality.RULES)
    own, counts = np.unique(patterns, return_counts=True)
    p = np.round(quality.expectation_maximisation(own, counts, len(quality.RULES)).posterior(own), 9)
    good = set(own[p >= 0.5].tolist())
    left = [k for k, x in zip(keys, patterns.tolist()) if x in good]
    lexicon = toxicity.learn([(docs[k], int(labels[k])) for k in sorted(labels) if k in docs])
    matcher = toxicity.Matcher(lexicon)
    left = [k for k in left if not (matcher.score(docs[k])[0] >= lexicon.threshold and matcher.score(docs[k])[1])]
    groups = plain_groups([docs[k] for k in left])
    left = [k for i, k in enumerate(left) if groups.get(i, i) == i]
    field = pii.fit([tuple(r) for r in pii.labelled_rows()])
    want = {k: pii.redacted(docs[k], s) for k, s in zip(left, pii.spans(field, [docs[k] for k in left]))}
    got: dict = {}
    for b in corpus_pipeline.run(spark, sf_dir).collect():
        for k, part, at, end in zip(b.doc_ids, b.parts, b.starts, [*b.starts[1:], len(b.text)]):
            got.setdefault(k, {})[part] = b.text[at : end - 1]
    assert {k: "".join(v[i] for i in range(len(v))) for k, v in got.items()} == want
    assert len(want) < len(docs)


def test_all_but_the_last_stage_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
