"""Prompts and chat replies as texts: one row per query, group or message. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed_texts
from caseloom.functions.links import access_token, ticket_link
from caseloom.functions.text import fixed, non_blank, percent


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def search_texts(questions: DataFrame) -> DataFrame:
    """Add the text a question searches with: the ticket it is asked about, else the question itself.

    ``incident`` is a map of the ticket's fields, or null. The text is null where nothing is searched.
    """
    incident = F.col("incident")
    has_summary = F.coalesce(F.map_contains_key(incident, F.lit("summary")), F.lit(False))
    about = F.concat(
        F.coalesce(incident["summary"], F.lit("")),
        F.when(
            F.map_contains_key(incident, F.lit("description")),
            F.concat(F.lit(" "), F.coalesce(incident["description"], F.lit(""))),
        ).otherwise(""),
    )
    text = F.when(has_summary, about).otherwise(F.col("query"))
    searched = ~F.coalesce(F.col("focus_on_ticket_only"), F.lit(False)) & non_blank(text)
    return questions.withColumn("search_text", F.when(searched, text))


def context_texts(context: DataFrame) -> DataFrame:
    """The context rows of each query as one text: ``query_id, context``. At most k rows per query."""
    item = F.format_string(
        fixed_texts.CONTEXT_ITEM, "rank", "ticket", "category", fixed(F.col("similarity"), 2),
        "summary", "resolution",
    )
    items = F.sort_array(F.collect_list(F.struct("rank", item.alias("text"))))
    return context.groupBy("query_id").agg(items.alias("_items")).select(
        "query_id",
        F.concat(F.lit(fixed_texts.CONTEXT_HEAD), F.array_join(F.col("_items.text"), "\n")).alias("context"),
    )


def incident_text(incident: Column) -> Column:
    lines = F.transform(
        F.map_entries(incident),
        lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")), F.lit("\n")),
    )
    return F.concat(F.lit(fixed_texts.INCIDENT_HEAD), F.array_join(lines, ""))


def assistant_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The messages to send for each question, and whether past tickets are among them.

    ``questions`` has ``query_id, query, ticket_id, focus_on_ticket_only, incident``; ``contexts`` comes
    from ``context_texts``. Questions without a context get told so.
    """
    asked = questions.where(non_blank(F.col("query"))).join(contexts, "query_id", "left")
    focus = F.coalesce(F.col("focus_on_ticket_only"), F.lit(False))
    about_ticket = focus & (F.coalesce(F.col("ticket_id"), F.lit("")) != "")
    system = F.when(
        about_ticket, F.format_string(fixed_texts.TICKET_PROMPT, F.col("ticket_id"))
    ).otherwise(fixed_texts.GENERAL_PROMPT)
    knowledge = F.when(
        F.col("context").isNotNull(), F.concat(F.lit(fixed_texts.CONTEXT_PROMPT_HEAD), F.col("context"))
    ).otherwise(fixed_texts.NO_CONTEXT_PROMPT)
    messages = F.array(
        message("system", system),
        F.when(~focus, message("system", knowledge)),
        F.when(F.size("incident") > 0, message("system", incident_text(F.col("incident")))),
        message("user", F.col("query")),
    )
    return asked.select(
        "query_id",
        "ticket_id",
        F.filter(messages, lambda m: m.isNotNull()).alias("messages"),
        (~focus & F.col("context").isNotNull()).alias("context_used"),
        F.when(~focus, F.coalesce("context", F.lit(fixed_texts.NO_CONTEXT_SUMMARY))).alias("context_summary"),
    )


def counts_text(counts: Column) -> Column:
    shown = F.transform(
        F.map_entries(counts),
        lambda e: F.concat(e["key"], F.lit("("), e["value"].cast("string"), F.lit(")")),
    )
    return F.coalesce(F.array_join(shown, ", "), F.lit(""))


def cluster_prompt() -> Column:
    """The question about a group, from the columns of a group report."""

    def shown_hours(name: str) -> Column:
        return F.coalesce(fixed(F.col(name), 1), F.lit(fixed_texts.NOT_AVAILABLE))

    lines = F.transform("samples", lambda text: F.concat(F.lit("- "), text))
    return F.format_string(
        fixed_texts.CLUSTER_PROMPT,
        F.col("size").cast("string"), shown_hours("avg_hours"), shown_hours("median_hours"),
        counts_text(F.col("category")), counts_text(F.col("task_type")), counts_text(F.col("severity")),
        F.coalesce(F.array_join("keywords", ", "), F.lit("")), F.array_join(lines, "\n"),
    )


def cluster_messages() -> Column:
    return F.array(
        message("system", F.lit(fixed_texts.ANALYST_PROMPT)), message("user", cluster_prompt())
    )


def batch_prompts(samples: DataFrame, key: str) -> DataFrame:
    """The two questions of the batch report about each group's sample texts, and what the model is told before them."""
    listed = F.concat(F.lit("\n- "), F.array_join("samples", "\n- "))
    return samples.select(
        key,
        F.format_string(fixed_texts.BATCH_SUMMARY_PROMPT, listed).alias("summary_prompt"),
        F.format_string(fixed_texts.BATCH_ROOT_CAUSE_PROMPT, listed).alias("root_cause_prompt"),
        F.lit(fixed_texts.BATCH_ANALYST_PROMPT).alias("system_prompt"),
    )


def with_link(tickets: DataFrame, base_url: str, key: str, issued: int) -> DataFrame:
    """Add a direct link per ticket, issued at a time in epoch seconds."""
    number = F.coalesce("ticket_number", F.lit(fixed_texts.NOT_AVAILABLE))
    token = access_token(number, F.lit(issued), key)
    return tickets.withColumn("link", ticket_link(base_url, number, token))


def markdown(hits: DataFrame, title: str, scored: bool = True, shown: int = fixed_texts.LIST_K) -> DataFrame:
    """One reply per query: a table of its hits and their links.

    ``hits`` has ``query_id, rank, ticket_number, summary, link`` and, where scored, ``similarity_score``.
    """
    number = F.coalesce("ticket_number", F.lit(fixed_texts.NOT_AVAILABLE))
    summary = F.coalesce("summary", F.lit(fixed_texts.NO_SUMMARY))
    cells = [number, summary, *([percent(F.col("similarity_score"))] if scored else [])]
    row = F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|\n"))
    link = F.format_string(fixed_texts.LINK_LINE, number, F.col("link"))
    listed = F.sort_array(F.collect_list(F.struct("rank", row.alias("row"), link.alias("link"))))
    head = fixed_texts.SCORED_TABLE_HEAD if scored else fixed_texts.PLAIN_TABLE_HEAD
    return (
        hits.where(F.col("rank") <= shown)
        .groupBy("query_id")
        .agg(listed.alias("_l"))
        .select(
            "query_id",
            F.concat(
                F.lit(f"## {title}\n\n{head}"), F.array_join(F.col("_l.row"), ""),
                F.lit(fixed_texts.LINKS_HEAD), F.array_join(F.col("_l.link"), ""),
            ).alias("reply"),
        )
    )
