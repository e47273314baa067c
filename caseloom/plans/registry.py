"""Every operator as a query over the sample tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.fixed_values import (
    BATCH_SAMPLES,
    CANDIDATE_LIMIT,
    CLUSTER_SAMPLES,
    MAX_FEATURES,
    NO_RESOLUTION,
    RECOMMEND_THRESHOLD,
    RECOMMENDED_TITLE,
    SIMILAR_KEYWORDS,
    SIMILAR_THRESHOLD,
    SIMILAR_TITLE,
)
from caseloom.functions import links, text
from caseloom.functions.dates import day, is_bad_date, parsed
from caseloom.functions.messages import arrived, command_argument, topic
from caseloom.functions.vectors import cosine, hash_embed, norm
from caseloom.operators import clustering, metrics, neighbours, prompts, scans, similarity, tfidf
from caseloom.operators.joins import attach_embeddings, embed_once
from caseloom.operators.memo import EmbeddingMemo
from caseloom.plans import reports, searches
from caseloom.session import run_dir
from caseloom.sources import readers, sample_tables, sinks
from caseloom.sources.sample_tables import (
    accounts,
    embedded_tickets,
    embeddings,
    stream_of,
    table,
    texts,
    ticket_queries,
    tickets,
)
from caseloom.streaming import expiry
from caseloom.streaming import messages as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Settings of the queries, the same in the SQL they are checked against.
ACCESS_KEY = "sample-key"
BASE_URL = "https://tickets.example.org"
NOW = 1_700_000_000
LOADED_AT = NOW - 42
SEARCHED = "The RE"
LOOKED_UP = "INC-7"
# Sign bits of a band where likely neighbours are searched for, so that there are buckets at any size of the tables.
LIKELY_BITS = 4
RECALL_ASKED = 0.9
EXPIRY_HOURS = 4


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _score(name: str):
    return F.round(name, 6).alias(name)


# --- scans, filters, lists ---

@query
def full_scan(spark, folder):
    return scans.full_scan(tickets(spark, folder))


@query
def recent_tickets(spark, folder):
    return scans.recent_candidates(tickets(spark, folder), CANDIDATE_LIMIT)


@query
def recent_tickets_page(spark, folder):
    return scans.recent_candidates(tickets(spark, folder), limit=20, offset=40).select("id", "ts", "summary")


@query
def latest_tickets(spark, folder):
    return scans.latest(tickets(spark, folder))


@query
def search_substring(spark, folder):
    return scans.search_substring(tickets(spark, folder), SEARCHED)


@query
def search_recent(spark, folder):
    return scans.search_substring(tickets(spark, folder), SEARCHED)


@query
def high_priority_all(spark, folder):
    return scans.high_priority(tickets(spark, folder))


@query
def high_priority(spark, folder):
    return scans.high_priority(tickets(spark, folder), limit=CANDIDATE_LIMIT)


@query
def ticket_lookup(spark, folder):
    return scans.ticket(tickets(spark, folder), LOOKED_UP)


@query
def ticket_details(spark, folder):
    return scans.details(tickets(spark, folder))


@query
def profile(spark, folder):
    return scans.profile(scans.recent_candidates(tickets(spark, folder)), NOW, LOADED_AT)


@query
def profile_all(spark, folder):
    return scans.profile(tickets(spark, folder, for_text=True), NOW, LOADED_AT)


@query
def profile_samples(spark, folder):
    return scans.profile_samples(scans.recent_candidates(tickets(spark, folder)))


@query
def json_rows(spark, folder):
    return sinks.as_json(tickets(spark, folder).select("id", "ts", "project", "category", "resolution_date"))


# --- similarity ---

def _similar(spark, folder, limit):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder), limit)
    found = similarity.similar(candidates, ticket_queries(spark, folder), exclude_self=True)
    return found.withColumn("similarity_score", F.round("similarity_score", 6))


@query
def similar_top5(spark, folder):
    return _similar(spark, folder, None)


@query
def similar_top5_all(spark, folder):
    return _similar(spark, folder, None)


def _recommend(spark, folder, limit):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder), limit)
    found = similarity.recommend(candidates, ticket_queries(spark, folder), exclude_self=True)
    return found.select("query_id", "rank", "ticket_info.*", "probable_resolution", _score("similarity_score"))


@query
def recommend_top3(spark, folder):
    return _recommend(spark, folder, None)


@query
def recommend_top3_all(spark, folder):
    return _recommend(spark, folder, None)


def _context(spark, folder, limit, threshold, fallback=0.3):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder), limit)
    return similarity.context(
        candidates, ticket_queries(spark, folder), threshold, fallback_threshold=fallback, exclude_self=True
    )


@query
def context_top3(spark, folder):
    return _context(spark, folder, None, 0.5).withColumn("similarity", F.round("similarity", 6))


@query
def context_top3_all(spark, folder):
    return _context(spark, folder, None, 0.5, 0.1).withColumn("similarity", F.round("similarity", 6))


@query
def context_top3_035(spark, folder):
    return _context(spark, folder, None, 0.35, 0.1).withColumn("similarity", F.round("similarity", 6))


@query
def similar_for_every_ticket(spark, folder):
    return neighbours.similar_for_all(embedded_tickets(spark, folder)).select(
        "query_id", "id", "rank", _score("score")
    )


@query
def similar_for_every_ticket_by_grid(spark, folder):
    """The layout for many queries and many tickets, on cells small enough to need several."""
    found = neighbours.similar_for_all(embedded_tickets(spark, folder), block_rows=0, cell_rows=128)
    return found.select("query_id", "id", "rank", _score("score"))


def _likely(spark, folder, threshold):
    with_vectors = attach_embeddings(tickets(spark, folder), embeddings(spark, folder))
    found = neighbours.likely_similar_for_all(with_vectors, dim=64, threshold=threshold, bits=LIKELY_BITS)
    return found.select("query_id", "id", "rank", _score("score"))


@query
def likely_similar_for_every_ticket(spark, folder):
    return _likely(spark, folder, RECOMMEND_THRESHOLD)


@query
def likely_similar_at_low_threshold(spark, folder):
    return _likely(spark, folder, SIMILAR_THRESHOLD)


@query
def likely_similar_recall(spark, folder):
    """Of the neighbours that the exact search finds, how many the index finds."""
    with_vectors = attach_embeddings(tickets(spark, folder), embeddings(spark, folder))
    parts = []
    for threshold in (SIMILAR_THRESHOLD, RECOMMEND_THRESHOLD):
        exact = neighbours.similar_for_all(with_vectors, threshold, 10).select("query_id", "id")
        likely = neighbours.likely_similar_for_all(with_vectors, 64, threshold, 10, bits=LIKELY_BITS)
        both = exact.join(likely.select("query_id", "id", F.lit(1).alias("_found")), ["query_id", "id"], "left")
        parts.append(both.agg(
            F.lit(threshold).alias("threshold"), F.count(F.lit(1)).alias("neighbours"),
            (F.count("_found") >= RECALL_ASKED * F.count(F.lit(1))).alias("enough"),
        ))
    return parts[0].unionByName(parts[1])


@query
def assign_centroid(spark, folder):
    points = embeddings(spark, folder)
    centroids = clustering.mean_vectors(points, "label", "embedding")
    return clustering.assign(points.select("id", "embedding"), "embedding", centroids, "label").select(
        "id", "cluster", _score("distance")
    )


@query
def cosine_to_centroid(spark, folder):
    points = embeddings(spark, folder)
    centroids = clustering.mean_vectors(points, "label", "embedding")
    return points.join(centroids, "label").select(
        "id", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity")
    )


@query
def embed_distinct_texts(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return embed_once(documents, "doc_id", "text").select(
        "doc_id", "text_key", "copies", (F.size("embedding") > 0).alias("embedded")
    )


@query
def hash_embedding(spark, folder):
    return hash_embed(table(spark, folder, "documents"), "text").select("doc_id", "embedding")


@query
def hash_embedding_lengths(spark, folder):
    embedded = hash_embed(table(spark, folder, "documents"), "text")
    return embedded.select("doc_id", F.round(norm(F.col("embedding")), 3).alias("length"))


# --- counts and times ---

@query
def overview_counts(spark, folder):
    return metrics.value_counts(tickets(spark, folder), reports.OVERVIEW_FIELDS)


@query
def value_count_maps(spark, folder):
    maps = metrics.value_count_maps(tickets(spark, folder), reports.METADATA, ["project"])
    return maps.select("project", *[prompts.counts_text(F.col(f)).alias(f) for f in reports.METADATA])


@query
def tied_modes(spark, folder):
    found = metrics.tied_modes(tickets(spark, folder), ["category", "severity", "status", "ticket_owner"], ["project"])
    return found.withColumn("modes", F.array_join("modes", ","))


@query
def category_metrics(spark, folder):
    return metrics.resolution_metrics(tickets(spark, folder), ["category"]).select(
        "category", "size", F.round("avg_hours", 4).alias("avg_hours"),
        F.round("median_hours", 4).alias("median_hours"),
        day(F.col("earliest")).alias("earliest"), day(F.col("latest")).alias("latest"),
        "peak_month", "n_bad_dates",
    )


@query
def category_approximate_medians(spark, folder):
    timed = metrics.with_times(tickets(spark, folder))
    found = metrics.approximate_median(timed, "resolution_micros", ["category"])
    return found.select("category", "median")


@query
def overall_metrics(spark, folder):
    return metrics.resolution_metrics(tickets(spark, folder), []).select(
        "size", F.round("avg_hours", 4).alias("avg_hours"),
        F.round("median_hours", 4).alias("median_hours"), "peak_month",
    )


@query
def metrics_rollup(spark, folder):
    return metrics.roll_up(metrics.resolution_metrics(tickets(spark, folder), ["category"]))


@query
def group_samples(spark, folder):
    found = metrics.samples(tickets(spark, folder), ["category"], "summary", CLUSTER_SAMPLES, scans.recency())
    return found.withColumn("samples", F.array_join("samples", "\n"))


# --- text ---

def _texts(spark, folder):
    return reports.with_text(tickets(spark, folder, for_text=True)).select("id", "category", "ts", "cluster_text")


@query
def combined_text(spark, folder):
    return reports.with_text(tickets(spark, folder)).select("id", "combined_text")


@query
def clean_text(spark, folder):
    cleaned = reports.with_text(tickets(spark, folder, for_text=True), batch=True, stop_words=text.default_stop_words())
    return cleaned.select("id", F.col("cluster_text").alias("clean"))


@query
def tokens(spark, folder):
    return texts(spark, folder).select(
        "doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens")
    )


@query
def ngrams(spark, folder):
    documents = texts(spark, folder)
    return text.with_terms(documents, "text", text.default_stop_words()).select(
        "doc_id", F.array_join("terms", "|").alias("terms")
    )


@query
def vocabulary(spark, folder):
    found = tfidf.vocabulary(_texts(spark, folder), "cluster_text", text.default_stop_words(), max_features=None)
    return found.withColumn("idf", F.round("idf", 6))


@query
def tfidf_weights(spark, folder):
    weighted = tfidf.weights(_texts(spark, folder), "cluster_text", text.default_stop_words(), max_features=None)
    return weighted.withColumn("weight", F.round("weight", 6))


@query
def keywords_top7(spark, folder):
    docs = _texts(spark, folder)
    weighted = tfidf.weights(docs, "cluster_text", text.default_stop_words(), keep=["id", "category"])
    return tfidf.keywords(weighted, "category").withColumn("weight", F.round("weight", 6))


@query
def category_term_weights(spark, folder):
    docs = _texts(spark, folder)
    weighted = tfidf.weights(docs, "cluster_text", text.default_stop_words(), None, keep=["id", "category"])
    return tfidf.group_weights(weighted, "category").withColumn("weight", F.round("weight", 6))


@query
def text_pieces(spark, folder):
    summary, comments = F.col("summary"), F.col("latest_comments")
    return tickets(spark, folder).select(
        "id", text.preview(summary).alias("preview"), text.query_text(summary, comments).alias("query_text"),
        text.resolution(comments, NO_RESOLUTION).alias("resolution"),
    )


@query
def reflowed(spark, folder):
    prepared = table(spark, folder, "documents").withColumn(
        "answer", F.concat(F.lit("1. "), F.col("text"), F.lit(" 2. see 21. and 0.1."))
    )
    return prepared.select("doc_id", text.reflow_numbered(F.col("answer")).alias("answer"))


# --- reports and prompts ---

def _by_category(spark, folder):
    """Texts are read for their tokens, and for the few samples; all else comes of the columns written with the tokens."""
    docs = reports.with_text(tickets(spark, folder, for_text=True)).withColumn("cluster", F.col("category"))
    narrow = [*reports.NARROW, "cluster"]
    split = tfidf.tokenised(docs, "cluster_text", text.default_stop_words(), narrow)
    weighted = tfidf.weights_of(split, MAX_FEATURES, keep=["id", "cluster"])
    keywords = tfidf.keyword_lists(tfidf.keywords(weighted, "cluster"), "cluster")
    grouped = split.select(*narrow)
    # No more than a few rows for each of the seven categories.
    chosen = metrics.first_of_group(grouped, ["cluster"], CLUSTER_SAMPLES, scans.recency()).select("cluster", "_at", "id")
    sampled = docs.select("id", "combined_text").join(F.broadcast(chosen), "id")
    return reports.group_report(grouped, keywords, metrics.listed(sampled, ["cluster"], "combined_text"))


@query
def category_report(spark, folder):
    return _by_category(spark, folder).select(
        "cluster", "size", F.array_join("keywords", ",").alias("keywords"), "peak_month",
        *[prompts.counts_text(F.col(f)).alias(f) for f in reports.METADATA],
        F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("prompt"),
    )


@query
def category_batch_prompts(spark, folder):
    docs = reports.with_text(tickets(spark, folder), batch=True)
    texts = metrics.samples(docs, ["category"], "combined_text", BATCH_SAMPLES, scans.recency())
    return prompts.batch_prompts(texts, "category")


@query
def context_prompts(spark, folder):
    return prompts.context_texts(_context(spark, folder, None, 0.35, 0.1))


def _questions(spark, folder):
    """A question about every ticket: some with its fields, some about nothing else."""
    number = F.col("id").cast("long")
    incident = F.create_map(
        F.lit("summary"), F.col("summary"), F.lit("category"), F.col("category"),
        F.lit("priority"), F.col("priority"),
    )
    return tickets(spark, folder).select(
        F.col("id").alias("query_id"),
        F.concat(F.lit("How to resolve "), F.col("ticket_number"), F.lit("?")).alias("query"),
        F.when(number % 4 != 3, F.col("ticket_number")).alias("ticket_id"),
        (number % 2 == 1).alias("focus_on_ticket_only"),
        F.when(number % 3 != 0, incident).alias("incident"),
    )


def _with_shown_messages(prompts_):
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return prompts_.withColumn("messages", F.array_join(shown, "\n--\n"))


@query
def assistant_prompts(spark, folder):
    contexts = prompts.context_texts(_context(spark, folder, None, 0.35, 0.1))
    return _with_shown_messages(prompts.assistant_prompts(_questions(spark, folder), contexts))


def _by_id(spark, folder):
    """Embeds a query by the vector of the ticket it is about."""
    vectors = embeddings(spark, folder).select(F.col("id").alias("query_id"), "embedding")
    return lambda df, column: df.join(vectors, "query_id", "left")


@query
def ask_assistant(spark, folder):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder), None)
    return _with_shown_messages(searches.ask(_questions(spark, folder), candidates, _by_id(spark, folder)))


@query
def ask_assistant_all(spark, folder):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder), None)
    return _with_shown_messages(searches.ask(_questions(spark, folder), candidates, _by_id(spark, folder)))


@query
def recommend_for_incidents(spark, folder):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder))
    incidents = tickets(spark, folder).select(
        F.col("id").alias("query_id"), "summary", F.col("latest_comments").alias("description")
    )
    found = searches.recommend_for(incidents, candidates, _by_id(spark, folder))
    return found.select("query_id", "rank", "ticket_info.*", "probable_resolution", _score("similarity_score"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def by_letters(df, column):
    """An embedder any engine can compute: how often each letter occurs. Null for blank texts."""
    said = F.when(text.non_blank(F.col(column)), F.lower(column))
    return df.withColumn("embedding", text.letter_counts(said, LETTERS))


@query
def similar_to_texts_by_letters(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), "text")
    candidates = similarity.Candidates.of(by_letters(scans.recent(tickets(spark, folder)), "summary"))
    found = searches.similar_to(texts, candidates, by_letters)
    return found.select("query_id", "rank", "id", _score("similarity_score"))


@query
def similar_to_texts_by_memo(spark, folder):
    """The same, its vectors kept from one search to the next: the second finds them all, and embeds nothing."""
    path = run_dir(spark, "memo")
    candidate_texts = scans.recent(tickets(spark, folder))
    asked = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), "text")
    for embed in (by_letters, _no_vectors):
        memo = EmbeddingMemo(spark, path, "letters", embed)
        candidates = similarity.Candidates.of(memo(candidate_texts, "summary"))
        found = searches.similar_to(asked, candidates, memo)
    return found.select("query_id", "rank", "id", _score("similarity_score"))


def _no_vectors(df, column):
    """An embedder that knows nothing: what it is asked for is not found."""
    return df.withColumn("embedding", F.lit(None).cast("array<float>"))


@query
def similar_to_texts(spark, folder):
    """Documents searched for by their whole texts, with hashed vectors."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), "text")
    newest = scans.recent(tickets(spark, folder))
    candidates = similarity.Candidates.of(hash_embed(newest, "summary"))
    return searches.similar_to(texts, candidates).select("query_id", "rank", "id", _score("similarity_score"))


@query
def search_texts(spark, folder):
    number = F.col("id").cast("long")
    incident = F.create_map(
        F.lit("summary"), F.col("summary"), F.lit("description"), F.col("latest_comments")
    )
    questions = tickets(spark, folder).select(
        F.col("id").alias("query_id"), F.col("category").alias("query"),
        (number % 5 == 4).alias("focus_on_ticket_only"), F.when(number % 3 != 0, incident).alias("incident"),
    )
    return prompts.search_texts(questions).select("query_id", "search_text")


@query
def similar_replies(spark, folder):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder), None)
    found = similarity.similar(candidates, ticket_queries(spark, folder), exclude_self=True)
    return prompts.markdown(prompts.with_link(found, BASE_URL, ACCESS_KEY, NOW), SIMILAR_TITLE)


@query
def recommended_replies(spark, folder):
    candidates = similarity.Candidates.of(embedded_tickets(spark, folder), None)
    found = similarity.recommend(candidates, ticket_queries(spark, folder), exclude_self=True)
    found = found.select("query_id", "rank", "ticket_info.*", "similarity_score")
    return prompts.markdown(prompts.with_link(found, BASE_URL, ACCESS_KEY, NOW), RECOMMENDED_TITLE)


@query
def latest_reply(spark, folder):
    return streaming.latest_reply(tickets(spark, folder), BASE_URL, ACCESS_KEY, NOW)


@query
def access_links(spark, folder):
    linked = prompts.with_link(tickets(spark, folder), BASE_URL, ACCESS_KEY, NOW)
    return linked.select("id", "link")


@query
def token_check(spark, folder):
    issued = NOW - F.col("doc_id") * 1000
    own = links.access_token(F.col("doc_id"), issued, ACCESS_KEY)
    shown = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("0x"), F.substring(own, 1, 30)))
        .when(F.col("doc_id") % 4 == 1, F.substring(own, 1, 31))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("g"), F.substring(own, 1, 31)))
        .otherwise(own)
    )
    offered = table(spark, folder, "documents").select("doc_id", shown.alias("token"), issued.alias("issued"))
    valid = links.is_valid_token(F.col("token"), F.col("doc_id"), F.col("issued"), F.lit(NOW), ACCESS_KEY)
    return offered.select(
        "doc_id", "token", links.looks_like_token(F.col("token")).alias("well_formed"), valid.alias("valid")
    )


# --- messages ---

@query
def route_messages(spark, folder):
    return streaming.routed(sample_tables.messages(spark, folder)).select("message_id", "intent", "search_text")


@query
def route_messages_no_model(spark, folder):
    found = streaming.routed(sample_tables.messages(spark, folder), model_available=False)
    return found.select("message_id", "intent", "search_text")


@query
def message_topics(spark, folder):
    read = sample_tables.messages(spark, folder).withColumn("arrived", arrived(F.col("text")))
    return read.select(
        "message_id", topic(F.col("arrived"), SIMILAR_KEYWORDS).alias("topic"),
        command_argument(F.col("arrived")).alias("argument"),
    )


@query
def route_messages_stream(spark, folder):
    """The router on a stream of the conversations, stored batch by batch."""
    arriving = stream_of(spark, folder, "conversations")
    out = run_dir(spark, "routed")
    found = streaming.routed(sample_tables.opened(arriving)).select("message_id", "intent", "search_text")
    found.writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _newest_event(events):
    order = [F.col("ts"), F.col("event_id")]
    return streaming.latest_per_user(events, "user_id", F.col("event_type"), order)


@query
def latest_per_user(spark, folder):
    return _newest_event(table(spark, folder, "events")).select("user_id", "reference", "event_id")


@query
def latest_per_user_stream(spark, folder):
    """The same as a running aggregate; of the changes stored the newest of each user counts."""
    arriving = stream_of(spark, folder, "events")
    out = run_dir(spark, "latest")
    streaming.write_changes(_newest_event(arriving), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    changes = spark.read.parquet(f"{out}/rows").withColumn("event_type", F.col("reference"))
    return _newest_event(changes).select("user_id", "reference", "event_id")


@query
def latest_per_user_until_stream(spark, folder):
    """The newest event of each user of the last hours of a stream; the others' state has expired."""
    arriving = stream_of(spark, folder, "events")
    out = run_dir(spark, "latest")
    changes = expiry.latest_per_user_until(
        arriving, "user_id", F.col("event_type"), F.col("ts").cast("timestamp"),
        F.format_string("%018d", F.col("event_id")), 3600 * EXPIRY_HOURS,
    )
    store, before = expiry.STATE_STORE[0], spark.conf.get(expiry.STATE_STORE[0])
    spark.conf.set(*expiry.STATE_STORE)
    try:
        streaming.write_changes(changes, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(store, before)
    order = F.struct("moment", "message", "expired")
    last = spark.read.parquet(f"{out}/rows").groupBy("user").agg(F.max_by(F.struct("*"), order).alias("x")).select("x.*")
    return last.where(~F.col("expired")).select(
        F.col("user").cast("long").alias("user_id"), "reference", F.col("message").cast("long").alias("event_id")
    )


def _answered(spark, folder, embed):
    arriving = stream_of(spark, folder, "conversations")
    out = run_dir(spark, "answers")
    snapshot = readers.TicketSnapshot(lambda: scans.recent(tickets(spark, folder)))
    streaming.answer_stream(
        sample_tables.opened(arriving), snapshot, "message_id", f"{out}/rows", f"{out}/checkpoint",
        BASE_URL, ACCESS_KEY, lambda: NOW, embed,
    ).awaitTermination()
    snapshot.clear()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query
def answered_messages(spark, folder):
    """Route, search and answer a stream of messages against the newest tickets."""
    return _answered(spark, folder, hash_embed)


@query
def answered_messages_by_letters(spark, folder):
    return _answered(spark, folder, by_letters)


# --- stores ---

@query
def insert_if_absent(spark, folder):
    signups, known = accounts(spark, folder)
    return sinks.absent_from(signups, known, "email", [F.col("name")])


@query
def accounts_by_bucket(spark, folder):
    """Known accounts and then sign-ups in a store laid out by email: who is known stays as first stored."""
    signups, known = accounts(spark, folder)
    path = run_dir(spark, "accounts")
    sinks.insert_absent_by_bucket(known.select("email", F.lit("known").alias("name")), path, "email", [F.col("name")])
    sinks.insert_absent_by_bucket(signups.select("email", "name"), path, "email", [F.col("name")])
    return spark.read.parquet(path).select("email", "name")


@query
def append_twice(spark, folder):
    """Appending the same tickets twice stores them once."""
    path = run_dir(spark, "tickets")
    sinks.append_once(tickets(spark, folder), path)
    sinks.append_once(tickets(spark, folder), path)
    return spark.read.parquet(path).groupBy("ticket_number", "summary").agg(F.count(F.lit(1)).alias("copies"))


@query
def report_tables(spark, folder):
    """All tables of the offline report, published and read back: what they say of the whole table of tickets, whatever the
    clusters are."""
    path = run_dir(spark, "report")
    sinks.publish(reports.root_cause_patterns(tickets(spark, folder, for_text=True), batch=True), path)
    found = sinks.published(spark, path)

    def whole(name: str, n) -> DataFrame:
        return found[name].agg(F.lit(name).alias("report_table"), F.lit(None).cast("string").alias("field"),
                               F.lit(None).cast("string").alias("value"), n.cast("long").alias("n"))

    rows = found["overview_counts"].select(F.lit("overview_counts").alias("report_table"), "field", "value", "n")
    by_value = found["cluster_counts"].groupBy("field", "value").agg(F.sum("n").alias("n"))
    parts = [
        by_value.select(F.lit("cluster_counts").alias("report_table"), "field", "value", "n"),
        whole("labels", F.count_distinct("id")), whole("clusters", F.sum("size")), whole("summary", F.max("total")),
        whole("projection2d", F.count_distinct("id")), whole("cluster_modes", F.count_distinct("field")),
        whole("cluster_keywords", F.max("rank")), whole("cluster_prompts", F.count_distinct("cluster")),
    ]
    for part in parts:
        rows = rows.unionByName(part)
    return rows


@query
def sheet_round_trip(spark, folder):
    """Tickets exported as a sheet, loaded from it and stored."""
    path = run_dir(spark, "sheet")
    names = {new: old for old, new in readers.HEADINGS.items()}
    exported = tickets(spark, folder).select(*[F.col(n).alias(h) for n, h in names.items()])
    exported.write.option("header", True).option("escape", '"').csv(f"{path}/sheet")
    sheet = readers.read_sheet(spark, f"{path}/sheet", multiline=True)
    sinks.load_sheet(sheet, f"{path}/stored")
    return spark.read.parquet(f"{path}/stored").select(*names)


@query
def sheet_by_heading(spark, folder):
    """A sheet with its columns in another order, some missing, some in other letters, and one more."""
    path = run_dir(spark, "sheet")
    exported = table(spark, folder, "documents").select(
        F.col("lang").alias("SEVERITY "), F.col("n_chars").cast("string").alias("Room"), F.col("source").alias("Summary"),
        F.concat(F.lit("INC-"), "doc_id").alias("Ticket Number"),
    )
    exported.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.good_rows(readers.read_sheet(spark, path)).select(
        "ticket_number", "summary", F.nullif("project", F.lit("")).alias("project"), "severity", F.col("Room").alias("room")
    )


@query
def sheets_of_other_headings(spark, folder):
    """A folder of sheets, some with their columns in another order and one heading more."""
    path = run_dir(spark, "sheets")
    number, doc = F.concat(F.lit("INC-"), "doc_id"), F.col("doc_id")
    documents = texts(spark, folder)
    first = documents.where(doc % 2 == 0).select(F.concat_ws(",", number, "source", "lang").alias("line"))
    other = documents.where(doc % 2 == 1).select(F.concat_ws(",", "lang", number, doc.cast("string"), "source").alias("line"))
    sinks.write_under(first, ["Ticket Number,Summary,Project"], f"{path}/sheet")
    sinks.write_under(other, ["Project,Ticket Number,Room,Summary"], f"{path}/more")
    rows = readers.read_sheets(spark, f"{path}/*")
    return readers.good_rows(rows).select("ticket_number", "summary", "project", F.col("Room").alias("room"))


@query
def sheet_with_title(spark, folder):
    """Sheets with a title above their headings."""
    path = run_dir(spark, "sheet")
    number = F.concat(F.lit("INC-"), "doc_id")
    lines = texts(spark, folder).select(F.concat_ws(",", "lang", "source", number).alias("line"))
    sinks.write_under(lines, ["Exported tickets,,", "Project,Summary,Ticket Number"], path)
    rows = readers.read_sheet(spark, path, title_row=True)
    return readers.good_rows(rows).select("ticket_number", "summary", "project")


@query
def sheet_load_summary(spark, folder):
    """Counts of a load with rows that do not fit, and the rejected rows as they were stored."""
    path = run_dir(spark, "load")
    row = F.concat_ws(",", F.concat(F.lit("INC-"), "doc_id"), "lang", F.when(F.col("doc_id") % 10 == 0, F.lit("too,many")))
    sinks.write_under(texts(spark, folder).select(row.alias("line")), ["Ticket Number,Project"], f"{path}/sheet")
    counts = sinks.load_sheet(readers.read_sheet(spark, f"{path}/sheet"), f"{path}/stored", rejected_path=f"{path}/rejected")
    return spark.read.parquet(f"{path}/rejected").agg(
        *[F.lit(int(counts[k])).cast("long").alias(k) for k in ("read", "rejected", "written")],
        F.count(F.lit(1)).alias("rejected_stored"), F.min(readers.REJECTED).alias("first_rejected"),
    )


#: Forms in which ``date_forms`` writes moments; the last two are no moments.
_FORMS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d",
    "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d.M.yyyy",
]


def _written_dates(spark, folder):
    number = F.col("doc_id")
    # Days from the 13th on, so that no form can be taken for month and day the other way round.
    moment = F.make_timestamp(
        2020 + number % 3, 1 + number % 12, 13 + number % 16, number % 24, number % 60, number * 7 % 60
    )
    said = F.when(number % 14 == 12, F.lit("  ")).when(number % 14 == 13, F.lit("sometime in spring"))
    for place, form in enumerate(_FORMS):
        said = said.when(number % 14 == place, F.date_format(moment, form))
    return table(spark, folder, "documents").select("doc_id", "source", said.alias("said"))


@query
def date_forms(spark, folder):
    """Moments written in a dozen forms, blank texts and texts that are no dates."""
    read = _written_dates(spark, folder).withColumn("moment", parsed(F.col("said")))
    return read.select(
        "doc_id", F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        is_bad_date(F.col("said"), F.col("moment")).alias("is_bad"),
    )


@query
def bad_dates(spark, folder):
    """Texts that are no dates, counted per source."""
    read = _written_dates(spark, folder).withColumn("moment", parsed(F.col("said")))
    return read.groupBy("source").agg(
        F.count_if(is_bad_date(F.col("said"), F.col("moment"))).alias("n_bad"),
        F.count_if(~text.non_blank(F.col("said"))).alias("n_blank"),
    )


# --- clusters by learning ---

def _features(spark, folder, keep=("id",)):
    found, _ = clustering.text_features(_texts(spark, folder), "cluster_text", text.default_stop_words(), keep=keep)
    return found


@query
def kmeans_clusters(spark, folder):
    features = _features(spark, folder)
    return clustering.labelled(features, clustering.kmeans(features)).select("id", "cluster")


@query
def kmeans_from_categories(spark, folder):
    """Three steps from the means of the categories, then the nearest centre of every ticket."""
    features = _features(spark, folder, ["id", "category"])
    means = features.groupBy("category").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("m"))
    start = [r["m"] for r in means.orderBy("category").collect()]  # seven categories
    moved = clustering.kmeans(features, start=[start], max_iter=3, tolerance=-1.0)
    return clustering.labelled(features, moved).select("id", "cluster")


@query
def kmeans_coverage(spark, folder):
    """Every ticket is in exactly one of the clusters, and nearly none is nearer to the mean of another one."""
    features = _features(spark, folder)
    found = clustering.labelled(features, clustering.kmeans(features))
    means = found.groupBy("cluster").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("m"))
    centres = [r["m"] for r in means.orderBy("cluster").collect()]
    again = clustering.labelled(found.withColumnRenamed("cluster", "first"), clustering.Clusters(np.array(centres), 0.0))
    return again.agg(
        F.count(F.lit(1)).alias("tickets"), F.count_distinct("id").alias("ids"),
        F.count_distinct("first").alias("clusters"),
        (F.count_if(F.col("first") != F.col("cluster")) <= 0.01 * F.count(F.lit(1))).alias("settled"),
    )


@query
def cluster_report(spark, folder):
    found = reports.root_cause_patterns(tickets(spark, folder, for_text=True))
    centre = found["projection2d"].groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return found["clusters"].join(centre, "cluster").select(
        "cluster", "size", F.array_join("keywords", ",").alias("keywords"), "avg_hours", "median_hours",
        "peak_month", F.col("messages")[1]["content"].alias("prompt"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
    )


@query
def pca_2d(spark, folder):
    return clustering.project_2d(_features(spark, folder))


@query
def pca_2d_embeddings(spark, folder):
    """The vectors of the tickets on their first two principal components."""
    vectors = embeddings(spark, folder).select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    placed = clustering.project_2d(vectors, tolerance=1e-13)
    return placed.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query
def pca_2d_moments(spark, folder):
    """The coordinates are centred and uncorrelated, and the first spreads the most."""
    found = pca_2d(spark, folder)
    return found.agg(
        F.count(F.lit(1)).alias("tickets"),
        F.abs(F.round(F.avg("x"), 6)).alias("mean_x"), F.abs(F.round(F.avg("y"), 6)).alias("mean_y"),
        F.abs(F.round(F.corr("x", "y"), 6)).alias("correlation"),
        (F.stddev("x") >= F.stddev("y")).alias("in_order"),
    )
