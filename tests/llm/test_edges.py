"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import (
    decontaminate,
    distribution_rules,
    host_paths,
    line_runs,
    mixing,
    private_spans,
    quality_gam,
    secret_ledger,
    shards,
    trie_join,
)
from caseloom.session import run_dir

EMPTY = hashlib.sha256(b"").hexdigest()


def labels(spark, rows=((5, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0), (8, 0, 0), (8, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def scan(docs):
    spark = docs.sparkSession
    ledger = secret_ledger.SecretLedger(spark, run_dir(spark, "ledger"))
    return secret_ledger.secret_digest(ledger.scan(docs))


OPERATORS = {
    1: distribution_rules.quality_rules,
    2: lambda docs: decontaminate.matches(docs, items(docs.sparkSession, [(1, "a few words that nobody wrote anywhere")])),
    3: trie_join.linked_documents,
    4: scan,
    5: shards.shards,
    6: line_runs.without_repeated_lines,
    7: mixing.mixed,
    8: lambda docs: quality_gam.quality_scores(docs, labels(docs.sparkSession)),
    10: private_spans.private_spans,
}


@pytest.mark.parametrize("number", OPERATORS)
def test_empty_table(number, nothing):
    assert OPERATORS[number](nothing).collect() == []


@pytest.mark.parametrize("number", [n for n in OPERATORS if n != 2])
def test_one_row_for_each_row(number, messy):
    found = OPERATORS[number](messy).select("doc_id").collect()
    ids = [r["doc_id"] for r in messy.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in found)


def by_id(frame):
    rows = {}
    for row in frame.collect():
        rows.setdefault(row["doc_id"], []).append(row)
    return rows


def test_rules(messy):
    found = by_id(distribution_rules.quality_rules(messy))
    for i in (1, 2, 3, 10):
        assert found[i][0][1:8] == (0, 0, 0, 0, 0, True, False)
    assert found[4][0].n_words == 1 and found[4][0].base_failed
    assert found[5][0].n_words == 360 and not found[5][0].base_failed
    assert sorted(r.n_words for r in found[8]) == [4, 60_000]


def test_leaks(spark, messy):
    asked = items(spark, [(1, None), (2, ""), (3, "ONE!"), (None, "one"), (4, "another text, under EIGHT"), (4, "one")])
    found = decontaminate.matches(messy, asked).select("doc_id", "item_id", "similarity").collect()
    assert {tuple(r) for r in found} == {(4, 3, 1.0), (4, 4, 1.0), (8, 4, 1.0)}
    assert decontaminate.matches(messy, items(spark, [])).collect() == []
    kept = decontaminate.without_items(messy, asked)
    assert kept.columns == messy.columns
    assert kept.count() == messy.count() - 2
    assert len(kept.where("doc_id = 8").collect()) == 1  # the other text under that id


def test_links(messy):
    found = by_id(trie_join.linked_documents(messy))
    for i in (1, 2, 3, 10):
        assert found[i][0][1:4] == (0, i, 0)
    assert found[4][0][1:4] == (1, 4, 0)
    assert found[5][0].component_id == 5 and found[5][0].n_links == 2  # both rows of 6; the null id links nothing
    assert {r.component_id for r in found[6]} == {5}
    assert {(r.component_id, r.n_links) for r in found[None]} == {(None, 0)}
    kept = trie_join.one_of_each(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and ids.count(8) == 2 and ids.count(None) == 2


def test_secrets(messy):
    found = by_id(scan(messy))
    assert {tuple(r)[1:] for rows in found.values() for r in rows} == {(0, 0, 0, EMPTY, "")}


def test_shards(messy):
    rows = shards.shards(messy, 4).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    same = {r.shard for r in rows if r.size == next(x.size for x in rows if x.doc_id == 5)}
    assert len(same) == 1


def test_lines(messy):
    found = by_id(line_runs.without_repeated_lines(messy))
    for i in (1, 2):
        assert found[i][0][1:] == (1, 0, "")
    assert found[10][0].n_lines == 4 and found[10][0].text == "\n\n\n"
    assert found[5][0].n_dropped == 0  # with both rows of 6 the line stands in two documents


def test_mixture(messy):
    rows = mixing.mixed(messy).collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    assert {r.kept for r in rows if r.doc_id == 6} in ({True}, {False})
    assert {r.source for r in rows} == {"", "a", "b"} and {r.lang for r in rows} == {"", "en", "de", "xx"}
    assert mixing.sampled(messy).columns == messy.columns


def test_rows_do_not_pass_through_python(spark, messy):
    """Only texts go to Python and only what is found in them comes back, whatever columns the rows have."""
    for found in (mixing.sampled(messy), quality_gam.without_rejected(messy, labels(spark))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_scores(spark, messy):
    found = by_id(quality_gam.quality_scores(messy, labels(spark)))
    assert found[1][0].score == found[2][0].score
    assert not any(r.held_out for r in found[None])
    none = quality_gam.quality_scores(messy, labels(spark, []))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.5, 1)}
    assert quality_gam.without_rejected(messy, labels(spark)).columns == messy.columns


def test_private(messy):
    found = by_id(private_spans.private_spans(messy))
    for i in (1, 2, 3, 10):
        assert tuple(found[i][0])[1:] == (0, 0, 0, 0, EMPTY, "")


def test_pages(spark):
    rows = [
        (1, None, None, 0), (2, "", "", 0), (3, "no address", "plain words", 0), (None, "https://h.org/x", "<p>one<p>two", 0),
        (4, "https://h.org/y", "<p>a" * 3000, 0), (5, "https://h.org/z", "<div " * 2000 + "<p>b &amp; c</p>", 0),
        (6, "https://h.org/z", "<" * 500 + "text" + ">" * 10, 0), (7, "http://h.org", "<div>" * 2000 + "deep", 0),
        (7, "http://h.org", "<div>" * 2000 + "deep", 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, paths int")
    found = {}
    for r in host_paths.main_texts(pages).collect():
        found.setdefault(r.page_id, []).append(r)
    assert found[1][0].text == found[2][0].text == "" and found[1][0].n_chars == 0
    assert found[3][0].text == "plain words"
    assert found[None][0].text == "one\ntwo"
    assert found[4][0].text == "\n".join(["a"] * 3000)
    assert [r.text for r in found[7]] == ["deep", "deep"]
    assert host_paths.main_texts(pages.limit(0)).collect() == []


def test_stages_keep_columns_and_take_empty_tables(spark, messy, nothing, folder):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, messy, folder).columns == messy.columns
        assert stage(spark, nothing, folder).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, folder).count() == 0
    assert messy.where(F.col("doc_id").isNull()).count() == 2
