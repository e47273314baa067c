"""Each stage of the pipeline against a brute-force version on its own input."""

import importlib
import sys

import numpy as np
import pytest
from test_methods import brute_leaks, brute_links

import corpus_pipeline
from caseloom.llm import mixing, quality_gam
from caseloom.llm.common import stored
from caseloom.sources.sample_tables import table


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = table(spark, folder, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], folder), name))
    return found


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_rejected_documents_go(spark, steps, folder):
    scores = quality_gam.quality_scores(steps[0], table(spark, folder, "labels"))
    assert {r.doc_id for r in scores.where("predicted = 1").collect()} == set(texts(steps[1]))


def test_one_of_each_group_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    wanted = {i for i, (_, root, _) in brute_links(before, 5, 8, 10).items() if root == i}
    assert set(after) == wanted and len(after) < len(before)


def test_leaks_go(spark, steps, folder):
    before, after = texts(steps[2]), texts(steps[3])
    items = {r.item_id: r.text for r in table(spark, folder, "benchmark").collect()}
    bad = {d for d, _ in brute_leaks(before, items)}
    assert bad and set(after) == set(before) - bad


def test_sample_is_the_mixture(steps):
    kept = mixing.mixed(steps[3]).where("kept").collect()
    assert {r.doc_id for r in kept} == set(texts(steps[4]))


def test_shards_hold_all(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(texts(steps[4]))
    sums = np.bincount([r.shard for r in rows], [r.size for r in rows], 16)
    assert sums.min() > 0


def test_rows_are_those_of_documents(steps):
    first = {tuple(r) for r in steps[0].collect()}
    for frame in steps[1:5]:
        assert frame.columns == steps[0].columns
        assert {tuple(r) for r in frame.collect()} <= first


def test_run_gives_the_last_stage(spark, steps, folder):
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()} == {tuple(r) for r in steps[5].collect()}


def test_entry_stands_without_the_operators(monkeypatch):
    import __spark_entry__ as entry

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("caseloom.llm"):
                raise ModuleNotFoundError(name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("caseloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import caseloom

    monkeypatch.delattr(caseloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    bare = importlib.reload(entry)
    assert bare.queries() and not any(n.startswith("op") or n == "pipeline" for n in bare.queries())
    assert set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)
