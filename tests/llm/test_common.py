"""Shared helpers against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm import distribution_rules, mixing, quality_gam, trie_join
from caseloom.llm.common import BATCH_BYTES, BATCH_SETTING, TEXTS_AT_ONCE, components, for_python, running_total, text_lists


def test_components_of_random_links(spark):
    picked = random.Random(3)
    links = [(picked.randrange(300), picked.randrange(300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 90)]  # a path and a star
    links += [(5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    wanted = {x: find(x) for x in root}
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["root"] for r in found.collect()} == wanted


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_running_total_with_ties_and_nulls(spark):
    rows = [(i % 7 if i % 5 else None, i, i % 4) for i in range(500)]
    order = [F.col("k").asc_nulls_last(), F.col("i")]
    found = running_total(spark.createDataFrame(rows, "k int, i int, w long").repartition(6), order, "w", "before")
    total = 0
    wanted = {}
    for _, i, w in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        wanted[i] = total
        total += w
    assert {r["i"]: r["before"] for r in found.collect()} == wanted


def test_texts_become_strings_some_at_a_time():
    texts = [None if i % 7 == 0 else f"text {i}" for i in range(2 * TEXTS_AT_ONCE + 3)]
    found = list(text_lists(pa.array(texts, pa.string())))
    assert [x for part in found for x in part] == texts and max(map(len, found)) == TEXTS_AT_ONCE
    assert list(text_lists(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("step", [
    lambda docs: quality_gam.without_rejected(docs, docs.selectExpr("doc_id", "1 as quality")),
    lambda docs: quality_gam.quality_scores(docs, docs.selectExpr("doc_id", "1 as quality")),
    trie_join.one_of_each, trie_join.linked_documents, mixing.sampled, mixing.mixed,
])
def test_texts_go_to_python_in_small_batches(spark, step):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.newSession().range(0, 2000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source")
    )
    step(docs.limit(3)).collect()
    found = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 2000 and max(r["size"] for r in found) < BATCH_BYTES + 10_000


def test_a_limit_of_the_session_holds(spark):
    own = spark.newSession()
    own.conf.set(BATCH_SETTING, "7m")
    for_python(own.range(1))
    assert own.conf.get(BATCH_SETTING) == "7m"


@pytest.mark.parametrize("step", [distribution_rules.references, lambda docs: distribution_rules.quality_rules(docs).collect()])
def test_quality_rules_take_texts_in_small_batches(spark, step):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.newSession().range(0, 2000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"), F.lit("en").alias("lang")
    )
    step(docs.limit(3))
    found = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 2000 and max(r["size"] for r in found) < BATCH_BYTES + 10_000


def test_quality_rules_count_and_judge_some_texts_at_a_time(monkeypatch):
    n = 2 * TEXTS_AT_ONCE + 3
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n)]
    texts = [f"{word} the and " * 20 for word in words]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * n), pa.array(texts)], names=["lang", "text"])
    monkeypatch.setattr(distribution_rules, "FLUSH", TEXTS_AT_ONCE // 2)
    found = [part.to_pylist() for part in distribution_rules._count(iter([batch, batch.slice(0, 0)]))]
    assert max(map(len, found)) <= TEXTS_AT_ONCE + 20  # all words of the batch before
    total = {}
    for row in (row for part in found for row in part):
        total[row["kind"], row["item"]] = total.get((row["kind"], row["item"]), 0) + row["n"]
    assert total["word", "the"] == 20 * n and total["word", ""] == 60 * n and all(total["word", word] == 20 for word in words)
    assert total["class", "lower"] == sum(len(text) - text.count(" ") for text in texts)
    assert [part.num_rows for part in distribution_rules._few_texts([batch])] == [TEXTS_AT_ONCE, TEXTS_AT_ONCE, 3]
