"""The pipeline on the smallest tables against brute force, stage by stage."""

import corpus_pipeline
import pytest

from rivulet.llm import quality, substring_dedup
from rivulet.llm.common import Memo

from . import brute
from .test_edges import brute_force_groups
from .test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_columns_stay(stages):
    for name in list(stages)[1:-1]:
        assert stages[name].columns == stages["input"].columns


def test_quality(spark, stages):
    model, memo = quality.train(stages["input"], spark.read.parquet(f"{SF}/labels.parquet")), Memo(quality._hashed)
    want = [(i, t) for i, t in rows(stages["input"]) if 1 / (1 + 2.718281828459045 ** (model.thresholds[0] - model.score(t, memo))) >= quality.SELECT]
    assert rows(stages["quality_classifier"]) == want and want


def test_near_duplicates(stages):
    before = rows(stages["quality_classifier"])
    first = {i for i, _, c in brute_force_groups(before, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT) if i == c}
    assert rows(stages["ngram_jaccard_join"]) == [(i, t) for i, t in before if i in first]


def test_substrings(stages):
    before = rows(stages["ngram_jaccard_join"])
    texts = brute.deduplicated(before, substring_dedup.SPAN, substring_dedup.MIN_WORDS)
    want = [(i, new) for (i, old), new in zip(before, texts, strict=True) if new == old or new.strip()]
    assert rows(stages["substring_dedup"]) == want and any(new != old for (_, old), new in zip(before, texts, strict=True))
    assert all(r.n_chars == len(r.text) for r in stages["substring_dedup"].collect())


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows(stages["substring_dedup"])
    bad = {i for i, _ in brute.contaminated(before, items)}
    assert rows(stages["benchmark_decontamination"]) == [(i, t) for i, t in before if i not in bad] and bad


def test_packing_and_run(spark, stages):
    docs = rows(stages["benchmark_decontamination"])
    from rivulet.llm import packing

    from .test_packing import PATH

    check(docs, packing.pack(stages["benchmark_decontamination"], PATH).collect(), 2048)
    pieces = sorted(map(tuple, stages["packing"].collect()))
    assert sum(p[2] for p in pieces) == sum({p[0]: p[4] for p in pieces}.values()) and {p[0] for p in pieces} == {i for i, _ in docs}
    again = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.length for r in again) == sum(p[2] for p in pieces) and {r.doc_id for r in again} == {p[0] for p in pieces}
