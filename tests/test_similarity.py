"""Search against brute force, in every layout, with ties, copies, zero and missing vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions.vectors import cosine, hash_embed
from caseloom.operators import neighbours, scoring, similarity
from caseloom.operators.joins import attach_embeddings, embed_once, salted_join
from caseloom.operators.scoring import BY_RECENCY, Rule, top_k
from caseloom.plans import registry
from caseloom.sources.schema import as_tickets

TICKETS = "id string, ts long, summary string, latest_comments string, embedding array<float>"


def make_tickets(spark, rows):
    return as_tickets(spark.createDataFrame(rows, TICKETS))


def make_queries(spark, rows):
    return spark.createDataFrame(rows, "query_id string, query_vec array<float>")


@pytest.fixture(scope="module")
def vectors():
    random = np.random.RandomState(7)
    base = random.standard_normal((40, 6)).astype(np.float32)
    copies = np.repeat(base[:2], 30, axis=0)  # two vectors hold most rows
    return [v.tolist() for v in np.concatenate([base, copies, np.zeros((1, 6), np.float32)])]


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(f"t{i:03d}", i // 3, f"summary {i}", "done", v) for i, v in enumerate(vectors)]
    rows += [("none", 5, "no vector at all", "", None), ("short", 6, "tiny", "", vectors[0])]
    rows += [("blank", 7, "        ", "", vectors[0])]
    return make_tickets(spark, rows)


@pytest.fixture(scope="module")
def queries(spark, vectors):
    return make_queries(spark, [(f"t{i:03d}", v) for i, v in enumerate(vectors)])


def brute(vectors, threshold, k, recency=False, exclude_self=True, newest=None):
    unit = np.array(vectors, dtype=np.float64)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(norms == 0, 1, norms)
    found = []
    for q in range(len(vectors)):
        scored = []
        for i in range(len(vectors)):
            if newest is not None and i not in newest:
                continue
            score = round(float(unit[q] @ unit[i]), 9) + 0.0
            if score >= threshold and not (exclude_self and i == q):
                scored.append((score, i // 3, f"t{i:03d}"))
        scored.sort(key=(lambda s: s[1:]) if recency else None, reverse=True)
        found += [(f"t{q:03d}", s[2], rank + 1) for rank, s in enumerate(scored[:k])]
    return sorted(found)


def rows(hits):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in hits.collect())


LAYOUTS = {"queries held": (1000, 8192), "tickets held": (0, 8192), "grid": (0, 16)}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("recency", [False, True])
def test_layouts_equal_brute_force(layout, recency, corpus, queries, vectors):
    block, cell = LAYOUTS[layout]
    rule = Rule(0.2, 4, BY_RECENCY if recency else "score", True)
    usable = corpus.where(F.col("id").startswith("t"))
    got = rows(top_k(queries, usable, rule, block, cell).hits)
    assert got == brute(vectors, 0.2, 4, recency)


def test_tickets_held(corpus, queries, vectors):
    candidates = similarity.Candidates.of(corpus, 300)
    assert candidates.newest is not None
    got = similarity.similar(candidates, queries, 0.2, 4, exclude_self=True)
    assert rows(got) == brute(vectors, 0.2, 4)


def test_candidate_limit_cuts_before_scoring(corpus, queries, vectors):
    order = sorted(range(len(vectors)), key=lambda i: (i // 3, f"t{i:03d}"), reverse=True)
    got = similarity.similar(similarity.Candidates.of(corpus, 20), queries, 0.2, 4, exclude_self=True)
    assert rows(got) == brute(vectors, 0.2, 4, newest=set(order[:20]))


def test_map_only_plan_for_held_tickets(corpus, queries):
    hits = similarity.Candidates.of(corpus, 300).scored(queries, Rule(0.2, 4)).hits
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block,cell", [(1000, 8192), (0, 16)])
def test_every_ticket_with_copies(corpus, vectors, block, cell):
    got = neighbours.similar_for_all(corpus, 0.2, 4, block, cell)
    assert rows(got) == brute(vectors, 0.2, 4)


def test_likely_neighbours_are_true_ones_and_copies_are_found(corpus, vectors):
    exact = {(q, i) for q, i, _ in brute(vectors, 0.2, 1000)}
    likely = neighbours.likely_similar_for_all(corpus, 6, 0.2, 4, bands=4, bits=3, cell_rows=8)
    found = {(r["query_id"], r["id"]) for r in likely.collect()}
    assert found and found <= exact
    assert len([f for f in found if f[0] == "t050"]) == 4  # one of thirty copies


def test_one_bucket_finds_all(corpus, vectors):
    everything = neighbours.likely_similar_for_all(corpus, 6, -1.0, 4, bands=1, bits=0, cell_rows=8)
    assert rows(everything) == brute(vectors, -1.0, 4)


def brute_context(vectors, high, low, recent):
    order = sorted(range(len(vectors)), key=lambda i: (i // 3, f"t{i:03d}"), reverse=True)
    unit = np.array(vectors, dtype=np.float64)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(norms == 0, 1, norms)
    result = []
    for q in range(len(vectors)):
        scores = {i: round(float(unit[q] @ unit[i]), 9) for i in order if i != q}
        hits = [i for i in order if scores.get(i, -9) >= high]
        if not hits:
            hits = [i for i in order[:recent] if scores.get(i, -9) >= low][:3]
        hits = sorted(hits, key=lambda i: -scores[i])[:3]
        result += [(f"t{q:03d}", f"t{i:03d}", n + 1) for n, i in enumerate(hits)]
    return sorted(result)


@pytest.mark.parametrize("limit", [300, None])
@pytest.mark.parametrize("high", [0.8, 0.95])
def test_context_and_its_fallback(corpus, queries, vectors, limit, high):
    usable = corpus.where(F.col("id").startswith("t"))
    got = similarity.context(
        similarity.Candidates.of(usable, limit), queries, high,
        fallback_threshold=0.3, fallback_recent=60, exclude_self=True,
    )
    kinds = {r["is_fallback"] for r in got.select("is_fallback").distinct().collect()}
    assert kinds == {True, False}
    assert rows(got) == brute_context(vectors, high, 0.3, 60)


def test_unusable_tickets_count_among_the_newest(spark):
    rows_ = [("old", 1, "an old ticket", "", [1.0, 0.9]), ("new", 2, "a new ticket", "", [1.0, 0.8])]
    rows_ += [(f"n{i:03d}", 10 + i, "without vector", "", None) for i in range(99)]
    tickets = make_tickets(spark, rows_)
    asked = make_queries(spark, [("q", [1.0, -0.4])])
    for limit in (300, None):
        found = similarity.context(similarity.Candidates.of(tickets, limit), asked, 0.9)
        assert [(r["id"], r["rank"], r["is_fallback"]) for r in found.collect()] == [("new", 1, True)]


def test_context_of_held_tickets_is_map_only(corpus, queries):
    found = similarity.context(similarity.Candidates.of(corpus, 300), queries)
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()


def test_fallback_ignores_older_hits(spark):
    old = [("old", 1, "an old ticket", "", [1.0, 0.9])]
    new = [(f"n{i:03d}", 10 + i, "a new ticket", "", [0.0, -1.0]) for i in range(100)]
    tickets = make_tickets(spark, old + new)
    asked = make_queries(spark, [("q", [1.0, -0.4])])
    found = similarity.context(similarity.Candidates.of(tickets, None), asked, 0.9)
    assert "old" not in {r["id"] for r in found.collect()}


def test_recommend_texts(spark):
    tickets = make_tickets(spark, [
        ("a", 1, "printer jam", "cleared it", [1.0, 0.0]), ("b", 2, "printer jam", " \n ", [1.0, 0.1]),
        ("c", 3, "printer jam", None, [1.0, 0.2]), ("d", 4, "printer jam", "no", [-1.0, 0.0]),
    ])
    got = similarity.recommend(similarity.Candidates.of(tickets), make_queries(spark, [("q", [1.0, 0.0])]))
    texts = {r["ticket_info"]["id"]: r["probable_resolution"] for r in got.collect()}
    none = "No explicit resolution information found."
    assert texts == {"a": "cleared it", "b": none, "c": none}


def test_cosine_edges(spark):
    rows_ = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows_, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, -1.0, 0.0, 0.0]
    swapped = [r[0] for r in df.select(cosine(F.col("b"), F.col("a"))).collect()]
    assert got == swapped


def test_vectors_of_different_length_are_refused(spark):
    tickets = make_tickets(spark, [("a", 1, "printer jam", "", [1.0, 0.0])])
    with pytest.raises(Exception):
        similarity.similar(similarity.Candidates.of(tickets), make_queries(spark, [("q", [1.0])])).collect()


def test_hash_embedding(spark):
    df = spark.createDataFrame([("printer is broken",), ("printer is broken",), ("   ",), (None,)], "text string")
    a, b, blank, missing = [r["embedding"] for r in hash_embed(df, "text", dim=32).collect()]
    assert a == b and blank is None and missing is None
    assert np.linalg.norm(a) == pytest.approx(1.0, abs=1e-6)


def test_embed_once_embeds_each_text_once(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(30)], "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    def embed(df, column):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return hash_embed(df.mapInArrow(count, df.schema), column)

    got = embed_once(docs, "id", "text", embed).collect()
    assert len(got) == 30 and seen.value == 11
    assert {r["copies"] for r in got if r["id"] % 3} == {20}


def test_embed_once_cuts_only_when_asked(spark):
    docs = spark.createDataFrame([(1, "same start a"), (2, "same start b")], "id int, text string")
    assert embed_once(docs, "id", "text").select("text_key").distinct().count() == 2
    assert embed_once(docs, "id", "text", max_chars=10).select("text_key").distinct().count() == 1


def test_attach_drops_tickets_without_vector(spark):
    tickets = spark.createDataFrame([("a",), ("b",)], "id string")
    vectors_ = spark.createDataFrame([("b", [1.0])], "id string, embedding array<float>")
    assert [r["id"] for r in attach_embeddings(tickets, vectors_).collect()] == ["b"]


def test_salted_join_is_an_inner_join(spark):
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "id int, k string")
    one = spark.createDataFrame([("hot", 1), ("k0", 2), ("other", 3)], "k string, v int")
    got = sorted(salted_join(many, one, "k", F.col("id")).select("id", "k", "v").collect())
    assert got == sorted(many.join(one, "k").select("id", "k", "v").collect())


@pytest.mark.parametrize("limit", [300, None])
def test_tickets_without_a_time(spark, limit):
    rows_ = [("a", None, "printer jam", "", [1.0, 0.0]), ("b", None, "printer jam", "", [1.0, 0.0])]
    rows_ += [("c", 7, "printer jam", "", [1.0, 0.0])]
    tickets = make_tickets(spark, rows_)
    for some, wanted in ((tickets, ["c", "b", "a"]), (tickets.where("ts IS NULL"), ["b", "a"])):
        found = similarity.similar(similarity.Candidates.of(some, limit), make_queries(spark, [("q", [1.0, 0.0])]))
        assert [r["id"] for r in found.orderBy("rank").collect()] == wanted


def test_no_candidates_and_no_queries(spark):
    tickets = make_tickets(spark, [("a", 1, "printer jam", "", [1.0, 0.0])])
    asked = make_queries(spark, [("q", [1.0, 0.0])])
    for limit in (300, None):
        for some, queries_ in ((tickets.limit(0), asked), (tickets, asked.limit(0))):
            candidates = similarity.Candidates.of(some, limit)
            assert similarity.similar(candidates, queries_).count() == 0
            assert similarity.context(candidates, queries_).count() == 0
    assert neighbours.similar_for_all(tickets.limit(0)).count() == 0


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("copies", [False, True])
def test_rough_scores_lose_no_hit(copies, exclude_self):
    random = np.random.default_rng(3)
    vectors = random.random((3000, 26)) ** 4
    if copies:
        vectors[500:2500] = vectors[7]
    ids = np.array([f"{i:05d}" for i in range(3000)])
    block = scoring.Block(ids, np.arange(3000)[::-1].copy(), scoring.unit_matrix(vectors))
    got = scoring.top_hits(block, block, Rule(0.6, 5, exclude_self=exclude_self))
    scores = np.round(block.matrix @ block.matrix.T, scoring.SCORE_DIGITS)
    if exclude_self:
        np.fill_diagonal(scores, -1)
    places = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    wanted = [
        (ids[i], ids[j], scores[i, j]) for i in range(3000) for j in places[i] if scores[i, j] >= 0.6
    ]
    found = got.sort_values(["query_id", "rank"])
    assert len(wanted) > 1000 and list(found["query_id"]) == [w[0] for w in wanted]
    # Scores one digit apart in the last place may change places.
    assert np.abs(found["score"].to_numpy(float) - [w[2] for w in wanted]).max() < 2e-9
    assert np.mean([a == w[1] for a, w in zip(found["id"], wanted)]) > 0.999


def test_many_of_both_are_dealt_once(spark):
    """No row is shuffled more than once, however many blocks there are: the rows written for the scoring are as many as came."""
    rows = [(f"{i}", i, [float((i * k) % 7 + 1) for k in range(1, 9)]) for i in range(600)]
    tickets = spark.createDataFrame(rows, "id string, ts long, embedding array<float>")
    queries = tickets.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = top_k(queries, tickets, Rule(0.9, 3), 0, 16).hits
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    stored = scoring.blocks(tickets, ["id", "ts"], "embedding", 16)
    sizes = [r["n"] for r in stored.select(F.size("id").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) <= 32 and len(sizes) >= 600 // 32
    in_one = sorted(map(tuple, top_k(queries, tickets, Rule(0.9, 3), 1000, 16).hits.collect()))
    assert sorted(map(tuple, found.collect())) == in_one


def test_only_hot_keys_are_repeated(spark, monkeypatch):
    from caseloom.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    docs = spark.createDataFrame([(i, "often" if i < 50 else f"once {i}") for i in range(90)], "id int, text string")
    joined = embed_once(docs, "id", "text")
    assert {(r["id"], r["copies"]) for r in joined.collect()} == {(i, 50 if i < 50 else 1) for i in range(90)}
    hot = joins.hot_keys(docs, "text")
    assert [r["text"] for r in hot.collect()] == ["often"]
    # 41 texts, of which one goes to every salt.
    one = docs.select("text").distinct().withColumn("x", F.lit(1))
    got = salted_join(docs, one, "text", F.col("id"), hot=hot)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 90 and "_hot" in plan
    tasks = salted_join(docs, one, "text", F.col("id"), 4, hot)
    assert tasks.select("id").distinct().count() == 90


@pytest.fixture(scope="module")
def many_tickets(spark, tmp_path_factory):
    """350 tickets, more than the 300 newest, of which the oldest 40 alone are about one thing and near each other."""
    folder = str(tmp_path_factory.mktemp("tables"))
    number = F.col("id")
    old = number < 40
    rows = spark.range(350)
    rows.select(
        number.alias("doc_id"), F.concat(F.when(old, "the replaced router ").otherwise("printer "), number, F.lit("\nfixed")).alias("text"),
        F.lit("en").alias("lang"), F.lit("web").alias("source"),
    ).write.parquet(f"{folder}/documents.parquet")
    rows.select(
        number.alias("o_orderkey"), F.timestamp_seconds(number * 86400).alias("o_orderdate"), F.lit("F").alias("o_orderstatus"),
        F.lit("3-MEDIUM").alias("o_orderpriority"), F.lit(1).alias("o_custkey"),
    ).write.parquet(f"{folder}/orders.parquet")
    rows.select(number.alias("l_orderkey"), F.timestamp_seconds(number * 86400).alias("l_shipdate")).write.parquet(
        f"{folder}/lineitem.parquet")
    axis = F.when(old, F.array(F.lit(1.0), F.lit(0.0), number / 1000)).otherwise(F.array(F.lit(0.0), F.lit(1.0), number / 1000))
    rows.select(number.alias("vec_id"), axis.cast("array<float>").alias("embedding"), F.lit(0).alias("label")).write.parquet(
        f"{folder}/embeddings.parquet")
    return folder


def test_search_finds_tickets_older_than_the_newest_300(spark, many_tickets):
    assert registry.QUERIES["search_recent"](spark, many_tickets).count() == 40


@pytest.mark.parametrize("name", ["similar_top5", "recommend_top3", "ask_assistant"])
def test_whole_table_is_searched(name, spark, many_tickets):
    got = registry.QUERIES[name](spark, many_tickets)
    every = registry.QUERIES[f"{name}_all"](spark, many_tickets)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert got.where("query_id = '3'").count() > 0
    if name == "ask_assistant":
        assert got.agg(F.max("incidents_processed")).first()[0] == 350


def test_tickets_meet_orders_and_vectors_by_one_number(spark, many_tickets):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from caseloom.sources import sample_tables

        found = sample_tables.embedded_tickets(spark, many_tickets)
        plan = found.select("latest_comments", "status", "embedding")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(doc_id") == 2 and "cast(doc_id" not in plan.split("Exchange", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
