"""Loading, storing, snapshots and streams."""

import json

import pytest
from pyspark.sql import functions as F

from caseloom.functions.vectors import hash_embed
from caseloom.operators import prompts, similarity
from caseloom.operators.scans import details, profile, profile_samples, recent
from caseloom.plans import registry
from caseloom.sources import readers, sample_tables, sinks
from caseloom.sources.schema import TICKET_SCHEMA, as_tickets, fill_missing
from caseloom.streaming import messages as streaming

SHEET = '''Exported tickets,,,
Ticket Number,Summary,Date Submitted,Latest Comments
INC-1,"Printer, again",2024-01-01,"He said ""off"" and
left"
INC-2,VPN down,,
INC-3,one,2024-01-01,x,too,many
'''


@pytest.fixture
def sheet(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text(SHEET)
    headings = ["Ticket Number", "Summary", "Date Submitted", "Latest Comments"]
    return readers.read_sheet(spark, str(tmp_path / "sheet.csv"), headings, title_row=True, multiline=True)


def test_sheet_with_title_row(sheet):
    good = {r["ticket_number"]: r for r in readers.good_rows(sheet).collect()}
    assert set(good) == {"INC-1", "INC-2"}
    assert good["INC-1"]["latest_comments"] == 'He said "off" and\nleft'
    assert good["INC-2"]["date_submitted"] == "" and good["INC-2"]["latest_comments"] == ""
    assert set(TICKET_SCHEMA.names) <= set(readers.good_rows(sheet).columns)
    rejected = readers.rejected_rows(sheet).collect()
    assert len(rejected) == 1 and "too,many" in rejected[0][readers.REJECTED]


def test_load_summary_and_repeat(spark, sheet, tmp_path):
    path = str(tmp_path / "stored")
    first = sinks.load_sheet(sheet, path)
    assert (first["read"], first["rejected"], first["written"]) == (3, 1, 2)
    assert "summary" in first["columns"]
    assert sinks.load_sheet(sheet, path)["written"] == 0
    assert sinks.load_sheet(sheet, path, once=False)["written"] == 2
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4


def test_new_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda names: as_tickets(spark.createDataFrame([(n,) for n in names], "summary string"))
    assert sinks.append_once(make(["a", "a", "b"]), path) == 2
    assert sinks.append_once(make(["b", "c"]), path) == 1
    found = spark.read.parquet(path)
    assert sorted(r["summary"] for r in found.collect()) == ["a", "b", "c"]
    assert found.where("ts IS NULL").count() == 0


def test_formats(spark, tmp_path):
    df = as_tickets(spark.createDataFrame([("1", 5, "one two", None)], "id string, ts long, summary string, status string"))
    sinks.write_json(df, str(tmp_path / "j"))
    back = readers.read_tickets(spark, str(tmp_path / "j"), "json").select(*df.columns)
    assert back.collect() == df.collect()
    df.write.parquet(str(tmp_path / "p"))
    assert readers.read_tickets(spark, str(tmp_path / "p")).select(*df.columns).collect() == df.collect()
    line = json.loads(sinks.as_json(df.select("id", "status")).first()["json"])
    assert line == {"id": "1", "status": None}
    sinks.write_report({"a": df, "b": df.select("id")}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "b")).columns == ["id"]
    assert fill_missing(df).first()["status"] == ""


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(50).select(F.col("id").cast("string").alias("id"))
        spark.sql(f"CREATE DATABASE IF NOT EXISTS loom LOCATION '{tmp_path}/db'")
        sinks.write_bucketed(ids.withColumn("summary", F.lit("s")), "loom.left_t", 4)
        sinks.write_bucketed(ids.withColumn("embedding", F.array(F.lit(1.0))), "loom.right_t", 4)
        joined = spark.table("loom.left_t").join(spark.table("loom.right_t"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.sql("DROP DATABASE IF EXISTS loom CASCADE")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_absent_from(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 1)], "email string, n int")
    known = spark.createDataFrame([("b",), ("b",)], "email string")
    got = sinks.absent_from(new, known, "email", [F.col("n")]).collect()
    assert sorted((r["email"], r["n"]) for r in got) == [("a", 1), ("c", 1)]


def test_insert_by_bucket_reads_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "store")

    def insert(keys, buckets=16):
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "email string, n int")
        return rows, sinks.insert_absent_by_bucket(rows, path, "email", [F.col("n")], buckets)

    assert insert([f"u{i}" for i in range(2000)])[1] == 2000
    files = {f.parent.name for f in (tmp_path / "store").rglob("*.parquet")}
    assert len(files) == 16
    assert insert(["u7", "u7", "new", None])[1] == 2
    assert insert([f"u{i}" for i in range(1900, 2100)])[1] == 100
    kept = spark.read.parquet(path)
    assert kept.count() == 2102 and kept.where("email = 'u7'").first()["n"] == 7
    # Of the files, one bucket's are read for one key.
    schema = "email string, n int, key_bucket int"
    one = spark.createDataFrame([("u7", 0)], "email string, n int").withColumn(
        "key_bucket", F.pmod(F.xxhash64("email"), F.lit(16)).cast("int")
    )
    held = sinks._held(spark.read.schema(schema).parquet(path), one, "email", [one.first()["key_bucket"]])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and "EqualTo(email,u7)" in plan
    assert [tuple(r) for r in held.collect()] == [(one.first()["key_bucket"], "u7")]


def test_insert_absent(spark, tmp_path):
    path = str(tmp_path / "accounts")
    make = lambda rows: spark.createDataFrame(rows, "email string, n int")
    assert sinks.insert_absent(make([("a", 2), ("a", 1)]), path, "email", [F.col("n")]) == 1
    assert sinks.insert_absent(make([("a", 0), ("b", 5)]), path, "email", [F.col("n")]) == 1
    stored = [tuple(r) for r in spark.read.parquet(path).orderBy("email").collect()]
    assert stored == [("a", 1), ("b", 5)]


def test_snapshot_is_read_again_when_old(spark):
    now, loads = [1000.0], []

    def load():
        loads.append(1)
        return spark.range(len(loads))

    snapshot = readers.TicketSnapshot(load, ttl=180, clock=lambda: now[0])
    assert snapshot.age_seconds() == 0.0
    assert snapshot.get().count() == 1
    now[0] += 179
    assert snapshot.get().count() == 1 and snapshot.age_seconds() == 179
    now[0] += 1
    assert snapshot.get().count() == 2
    snapshot.clear()


def test_profile_and_details(spark):
    rows = [("1", 1, "a summary", " ", None), ("2", 2, "x" * 120, "fixed", ""), ("3", 3, " ", None, "2024-01-01")]
    df = as_tickets(spark.createDataFrame(
        rows, "id string, ts long, summary string, latest_comments string, resolution_date string"
    ))
    assert tuple(profile(df, 100, 40).first()) == (3, 2, 1, 60, 0.3, 0.4, 0.5)
    shown = [tuple(r) for r in profile_samples(df, 2).collect()]
    assert shown == [("N/A", " ", False, "N/A"), ("N/A", "x" * 100 + "...", True, "N/A")]
    assert [r["resolution_date"] for r in details(df).collect()] == ["Not resolved", "Not resolved", "2024-01-01"]
    assert [r["latest_comments"] for r in details(df).collect()] == [" ", "fixed", "No comments"]


QUESTION = "query_id string, query string, ticket_id string, focus_on_ticket_only boolean, incident map<string,string>"


def test_assistant_prompts(spark):
    questions = spark.createDataFrame([
        ("focus", "why?", "T1", True, {"summary": "s"}),
        ("found", "how?", None, False, None),
        ("lost", "how?", "T2", None, {}),
        ("blank", "  ", None, False, None),
        ("nameless", "why?", "", True, None),
    ], QUESTION)
    contexts = spark.createDataFrame([("found", "CTX"), ("focus", "CTX")], "query_id string, context string")
    got = {r["query_id"]: r for r in prompts.assistant_prompts(questions, contexts).collect()}
    assert set(got) == {"focus", "found", "lost", "nameless"}
    roles = {k: [m["role"] for m in r["messages"]] for k, r in got.items()}
    assert roles["focus"] == ["system", "system", "user"]
    assert "ticket #T1" in got["focus"]["messages"][0]["content"]
    assert got["focus"]["messages"][1]["content"] == "Current Incident Details:\n- summary: s\n"
    assert (got["focus"]["context_used"], got["focus"]["context_summary"]) == (False, None)
    assert got["found"]["messages"][1]["content"] == "Knowledge Base Context:\nCTX"
    assert (got["found"]["context_used"], got["found"]["context_summary"]) == (True, "CTX")
    assert got["lost"]["messages"][1]["content"].startswith("No specific historical")
    assert len(got["lost"]["messages"]) == 3
    assert got["nameless"]["messages"][0]["content"] == got["lost"]["messages"][0]["content"]


def test_search_texts(spark):
    questions = spark.createDataFrame([
        ("a", "q", None, False, {"summary": "s", "description": "d"}),
        ("b", "q", None, False, {"summary": "s", "description": None}),
        ("c", "q", None, False, {"category": "c"}),
        ("d", "q", None, True, None),
        ("e", "q", None, False, {"summary": " "}),
    ], QUESTION)
    got = {r["query_id"]: r["search_text"] for r in prompts.search_texts(questions).collect()}
    assert got == {"a": "s d", "b": "s ", "c": "q", "d": None, "e": None}


def test_stream_and_table_are_routed_alike(spark, folder):
    on_table = registry.QUERIES["route_messages"](spark, folder).collect()
    assert sorted(registry.QUERIES["route_messages_stream"](spark, folder).collect()) == sorted(on_table)


def test_streams_read_tables_stored_as_folders(spark, tmp_path):
    # One folder per table, of several files, next to a table of a like name.
    turns = [(i, t, "user" if t % 2 == 0 else "assistant", f"vpn drops {i}") for i in range(4) for t in range(3)]
    schema = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(turns, schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(turns, schema).write.parquet(str(tmp_path / "old_conversations.parquet"))
    spark.createDataFrame(turns, schema).write.parquet(str(tmp_path / "conversations.parquet2"))
    on_table = registry.QUERIES["route_messages"](spark, str(tmp_path)).collect()
    on_stream = registry.QUERIES["route_messages_stream"](spark, str(tmp_path)).collect()
    assert len(on_table) == 12 and sorted(on_stream) == sorted(on_table)
    events = [(i, i % 3, "click", f"2024-01-0{i + 1} 00:00:00") for i in range(6)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts string")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["latest_per_user_stream"](spark, str(tmp_path)).collect()
    assert sorted((r["user_id"], r["event_id"]) for r in got) == [(0, 3), (1, 4), (2, 5)]


def test_latest_reference_over_several_batches(spark, tmp_path):
    schema = "user string, ts long, ref string"
    batches = [[("a", 1, "a1"), ("b", 5, "b5")], [("a", 3, "a3"), ("b", 2, "b2")], [("c", 1, "c1"), ("a", 2, "a2")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    newest = streaming.latest_per_user(arriving, "user", F.col("ref"), [F.col("ts")])
    streaming.write_changes(newest, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out")).withColumn("ref", F.col("reference"))
    got = streaming.latest_per_user(changes, "user", F.col("ref"), [F.col("ts")]).collect()
    assert {r["user"]: r["reference"] for r in got} == {"a": "a3", "b": "b5", "c": "c1"}


def test_answers(spark, tmp_path):
    rows = [(f"{i}", i, f"INC-{i}", s) for i, s in enumerate([
        "vpn connection drops daily", "printer paper jam", "email not syncing", "high priority tickets",
        "vpn connection slow", "new laptop request", "password reset needed",
    ])]
    tickets = as_tickets(spark.createDataFrame(rows, "id string, ts long, ticket_number string, summary string"))
    said = [
        ("m1", "/similar vpn connection"), ("m2", "/similar"), ("m3", "/recommend"), ("m4", "hello there"),
        ("m5", "similar tickets to printer jam"), ("m6", "/similar zzz qqq"), ("m7", "/help"),
    ]
    spark.createDataFrame(said, "message_id string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("message_id string, text string").parquet(str(tmp_path / "in"))
    streaming.answer_stream(
        arriving, readers.TicketSnapshot(lambda: tickets), "message_id", str(tmp_path / "out"), str(tmp_path / "cp"),
        "https://h", "key", lambda: 100,
    ).awaitTermination()
    got = {r["message_id"]: r["reply"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 7
    assert got["m1"].startswith("## Similar Tickets Found\n\n|Ticket Number|Description|Similarity|\n")
    assert "INC-0" in got["m1"] and "INC-4" in got["m1"] and "INC-1|" not in got["m1"]
    assert got["m2"].count("direct-ticket") == 5 and got["m2"].index("INC-6") < got["m2"].index("INC-5")
    assert got["m3"].startswith("## Recommended Tickets") and "|INC-3|high priority tickets|100.0%|" in got["m3"]
    assert got["m4"] is None and got["m6"] is None and got["m7"] is None
    assert "INC-1" in got["m5"]


def test_answer_to_one_table_of_messages(spark, folder):
    tickets = sample_tables.tickets(spark, folder)
    candidates = similarity.Candidates.of(hash_embed(recent(tickets, 50), "summary"), 50)
    said = streaming.routed(sample_tables.messages(spark, folder))
    got = streaming.replies(said, candidates, tickets, "message_id", "https://h", "k", 1).collect()
    assert len(got) == said.count()
    assert all(r["reply"] is None for r in got if r["intent"] in ("ignored", "help_command", "chat", "empty"))


def test_sheets_with_other_headings_meet_by_name(spark, tmp_path):
    folder = tmp_path / "sheets"
    folder.mkdir()
    (folder / "a.csv").write_text("Summary,Ticket Number\none,INC-1\ntwo,INC-2\nthree,INC-3,x\n")
    (folder / "b.csv").write_text("Ticket Number,Room,Summary\nINC-4,r1,four\n")
    (folder / "c.csv").write_text("Summary,Ticket Number\n")
    (folder / "d.csv").write_text("")
    rows = readers.read_sheets(spark, str(folder))
    good = {r["ticket_number"]: (r["summary"], r["Room"]) for r in readers.good_rows(rows).collect()}
    assert good == {"INC-1": ("one", None), "INC-2": ("two", None), "INC-4": ("four", "r1")}
    assert readers.good_rows(rows).count() == 3 and readers.rejected_rows(rows).count() == 1


def test_few_partitions_are_dealt_to_all_cores(spark, tmp_path):
    from caseloom.session import spread, written

    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    dealt = spread(one, "id")
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and dealt.count() == 50
    assert spread(dealt, "id") is dealt
    assert written(one, "kept").count() == 50
