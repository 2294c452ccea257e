"""The pipeline against a brute-force version of all its stages."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from lodeseek.llm import common, quality

from ..conftest import DATA
from .fixtures import clashing, rows
from .plain_kn import Plain
from .test_licenses_mixing import waterfill
from .test_line_dedup import brute as brute_lines
from .test_near import brute_one_of_each
from .test_tokens import check_pieces


def brute_quality(docs, labels):
    trusted = {l.doc_id for l in labels if l.quality == 1 and not l.toxic and l.doc_id is not None}
    model = Plain([d.text or "" for d in docs if d.doc_id in trusted])
    ppl = [model.perplexity(d.text or "") for d in docs]
    known = {}
    for d, p in zip(docs, ppl):
        if d.doc_id in trusted and p is not None:
            known.setdefault(d.lang, []).append(math.floor(math.log10(p) * quality.STEPS))
    reached = {lang: math.ceil(round(float(np.quantile(v, quality.QUANTILE)), 6)) for lang, v in known.items()}
    limit = {lang: 10 ** ((step + 1) / quality.STEPS) * quality.MARGIN for lang, step in reached.items()}
    top = max(limit.values(), default=math.inf)
    return [d for d, p in zip(docs, ppl) if p is not None and p <= limit.get(d.lang, top)]


def brute(docs, labels):
    docs = brute_quality(docs, labels)
    source = {d.doc_id: d.source for d in docs}
    lines = [(i, t) for i, t, _, _ in brute_lines([(d.doc_id, d.text) for d in docs])]
    kept = [lines[at] for at in brute_one_of_each(lines)]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept}
    total = Counter()
    for i, _ in kept:
        total[source[i]] += size[i]
    target = waterfill(dict(total))
    out = []
    for i, t in kept:
        rate = min(3.0, target[source[i]] / total[source[i]]) if total[source[i]] else 0.0
        draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(i, t)] * (int(rate) + (draw < rate - int(rate)))
    return out


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    want = brute(docs, labels)
    assert 0 < len({i for i, _ in want}) < len(docs)
    check_pieces(corpus_pipeline.run(spark, DATA).collect(), want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = clashing(spark)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, DATA)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert docs.count() >= 0


def test_each_stage_takes_awkward_and_no_rows(spark):
    for _, step in corpus_pipeline.STAGES:
        for docs in (clashing(spark), clashing(spark).limit(0)):
            assert step(spark, docs, DATA).count() >= 0
    n = len(rows())
    assert corpus_pipeline.line_dedup(spark, clashing(spark), DATA).count() == n
    assert corpus_pipeline.near_dedup(spark, clashing(spark), DATA).count() < n


def test_a_stage_deletes_what_the_ones_before_left_and_it_does_not_read(spark, tmp_path):
    exists = lambda path: os.path.exists(re.sub("^file:", "", path))
    docs = clashing(spark)
    lazy = corpus_pipeline.line_dedup(spark, docs, DATA)
    before = [p for p in corpus_pipeline._left if exists(p)]
    assert before and common.paths_read(lazy) & set(before)
    corpus_pipeline.mixing(spark, lazy, DATA)  # not written: what it reads stays
    assert lazy.count() == len(rows()) and all(exists(p) for p in set(before) & common.paths_read(lazy))
    lazy.write.parquet(str(tmp_path / "written"))
    corpus_pipeline.mixing(spark, spark.read.parquet(str(tmp_path / "written")), DATA).count()
    assert not any(exists(p) for p in before)


def test_scratch_deletes_its_own_tables_alone(spark):
    kept = common.stage(spark.range(3), "kept")
    with common.scratch(spark):
        inside = common.stage(spark.range(5), "inside")
        assert inside.count() == 5
    assert kept.count() == 3 and not os.path.exists(inside._lodeseek_path)
    common.discard(kept)
