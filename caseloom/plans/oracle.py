"""The registered queries once more, as SQL for another engine on the same tables."""

from __future__ import annotations

from caseloom import fixed_values as v
from caseloom.functions.links import BASE_16
from caseloom.functions.text import SPACE, TOKEN
from caseloom.operators.neighbours import Index, planes_of
from caseloom.plans.registry import (
    ACCESS_KEY,
    BASE_URL,
    EXPIRY_HOURS,
    LETTERS,
    LIKELY_BITS,
    LOADED_AT,
    LOOKED_UP,
    NOW,
    SEARCHED,
)
from caseloom.sources.sample_tables import OPENINGS

# --- fixed values: Spark's English stop words ---
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(x) for x in values) + "]"


STOP = texts(STOP_WORDS)
NL = "chr(10)"

TICKETS = """
t AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, CAST(epoch(o.o_orderdate) AS BIGINT) AS ts,
    'INC-' || d.doc_id AS ticket_number,
    split_part(d.text, chr(10), 1) AS summary,
    CASE WHEN instr(d.text, chr(10)) > 0 THEN substr(d.text, instr(d.text, chr(10)) + 1) ELSE '' END
      AS latest_comments,
    d.source AS project, 'cat' || (d.doc_id % 7) AS category, d.lang AS task_type,
    o.o_orderstatus AS status,
    CASE WHEN o.o_orderpriority = '2-HIGH' THEN 'High' ELSE substr(o.o_orderpriority, 3) END AS priority,
    'Severity ' || left(o.o_orderpriority, 1) AS severity, 'owner' || o.o_custkey AS ticket_owner,
    o.o_orderdate AS submitted,
    CASE WHEN o.o_orderstatus <> 'O' AND s.shipped >= o.o_orderdate THEN s.shipped END AS resolved,
    strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_submitted,
    CASE WHEN o.o_orderstatus <> 'O' AND s.shipped >= o.o_orderdate
      THEN strftime(s.shipped, '%Y-%m-%d %H:%M:%S') ELSE '' END AS resolution_date
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) s
    ON s.l_orderkey = o.o_orderkey
)"""
CANDIDATE = (
    "id, ticket_number, summary, project, category, severity, priority, status, resolution_date, "
    "latest_comments, ts"
)
RECENT = ", r AS (SELECT * FROM t WHERE length(summary) > 5 ORDER BY ts DESC, id DESC LIMIT 300)"
SEARCHABLE = ", r AS (SELECT * FROM t WHERE length(summary) > 5)"


def on_tickets(select: str, more: str = "") -> str:
    return f"WITH {TICKETS}{more} {select}"


def scored(limit: int | None, but: str = "query_id <> id") -> str:
    """Candidates, the usable ones with their vectors, and all their scores."""
    newest = f"ORDER BY ts DESC, id DESC LIMIT {limit}" if limit else ""
    return f""",
c AS (SELECT * FROM t WHERE length(summary) > 5 {newest}),
u AS (SELECT c.id, c.ts, e.embedding FROM c JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = c.id),
q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding FROM embeddings),
s AS (
  SELECT query_id, id, ts,
    round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 0), 9) AS score
  FROM q CROSS JOIN u WHERE {but}
)"""


def best(limit: int | None, threshold: float, k: int, but: str = "query_id <> id") -> str:
    return scored(limit, but) + f""",
h AS (
  SELECT query_id, id, score, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, ts DESC, id DESC) AS rank
  FROM s WHERE score >= {threshold} QUALIFY rank <= {k}
)"""


def similar(limit: int | None) -> str:
    return on_tickets(
        """SELECT query_id, rank, ticket_number, summary, project, category, severity, priority, status,
  resolution_date, latest_comments, id, round(score, 6) AS similarity_score FROM h JOIN c USING (id)""",
        best(limit, 0.3, 5),
    )


def recommend(limit: int | None, but: str = "query_id <> id") -> str:
    return on_tickets(
        f"""SELECT query_id, rank, ticket_number, summary, project, category, id,
  CASE WHEN {non_blank('latest_comments')} THEN latest_comments ELSE {text(v.NO_RESOLUTION)} END
    AS probable_resolution, round(score, 6) AS similarity_score FROM h JOIN c USING (id)""",
        best(limit, 0.4, 3, but),
    )


def context(limit: int | None, threshold: float, fallback: float, but: str = "query_id <> id") -> str:
    return scored(limit, but) + f""",
recent AS (SELECT id FROM c ORDER BY ts DESC, id DESC LIMIT 100),
strict AS (SELECT query_id, id, ts, score, false AS is_fallback FROM s WHERE score >= {threshold}),
loose AS (
  SELECT query_id, id, ts, score, true AS is_fallback FROM s
  WHERE score >= {fallback} AND id IN (SELECT id FROM recent)
    AND query_id NOT IN (SELECT query_id FROM strict)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, id DESC) <= 3
),
x AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, id DESC) AS rank
  FROM (SELECT * FROM strict UNION ALL SELECT * FROM loose) QUALIFY rank <= 3
),
found AS (
  SELECT query_id, rank, is_fallback, id, ticket_number AS ticket, summary,
    latest_comments AS resolution, category, score
  FROM x JOIN c USING (id)
)"""


FOUND = """SELECT query_id, rank, is_fallback, id, ticket, summary, resolution, category,
  round(score, 6) AS similarity FROM found"""
ITEM = f"""rank || '. Ticket ' || ticket || ' (Category: ' || category || ', Similarity: ' ||
    format('{{:.2f}}', score) || '):' || {NL} || '   Summary: ' || summary || {NL} ||
    '   Resolution/Comments: ' || resolution || {NL}"""
CONTEXT_TEXT = f"""SELECT query_id, {text(v.CONTEXT_HEAD)} || string_agg({ITEM}, {NL} ORDER BY rank) AS context
FROM found GROUP BY query_id"""


def non_blank(column: str) -> str:
    return f"regexp_matches({column}, '[^{SPACE}]')"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def tokens(expression: str) -> str:
    return f"regexp_extract_all(lower({expression}), '{TOKEN}')"


def fixed(expression: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {expression})"


COMBINED = strip(
    "summary || ' ' || latest_comments || ' Task Type: ' || task_type || ' Status: ' || status || ' '"
)
COMBINED_BATCH = strip(
    "summary || ' ' || latest_comments || ' Task Type: ' || task_type || ' Status: ' || status || ' Owner: '"
    " || ticket_owner"
)
GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
TERMS = f""",
d AS (SELECT id, category, ts, {COMBINED} AS combined FROM t),
w AS (SELECT id, list_filter({tokens('combined')}, lambda x: NOT list_contains({STOP}, x)) AS w FROM d),
tc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({GRAMS}) AS term FROM w) GROUP BY ALL),
voc AS (
  SELECT term, count(*) AS df, sum(tf) AS total, ln((1 + n) / (1 + count(*))) + 1 AS idf
  FROM tc, (SELECT count(*)::DOUBLE AS n FROM d) GROUP BY term, n
  HAVING count(*) >= 2 AND count(*) <= 0.85 * n ORDER BY total DESC, term LIMIT 2000
)"""
WEIGHTS = TERMS + """,
raw AS (SELECT id, term, tf * idf AS x FROM tc JOIN voc USING (term)),
wt AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw)"""
KEYWORDS = WEIGHTS + """,
k AS (
  SELECT category, term, sum(weight) AS weight, row_number() OVER (
    PARTITION BY category ORDER BY round(sum(weight), 9) DESC, term) AS rank
  FROM wt JOIN t USING (id) GROUP BY category, term QUALIFY rank <= 7
)"""
HOURS = "date_diff('microsecond', submitted, resolved) / 3600e6"
TIMES = f""",
m AS (
  SELECT category, count(*) AS size, avg({HOURS}) AS avg_hours, median({HOURS}) AS median_hours,
    strftime(min(submitted), '%Y-%m-%d') AS earliest, strftime(max(submitted), '%Y-%m-%d') AS latest
  FROM t GROUP BY category
),
p AS (
  SELECT category, peak_month FROM (
    SELECT category, strftime(submitted, '%Y-%m') AS peak_month, count(*) AS n FROM t GROUP BY 1, 2
  ) QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, peak_month) = 1
)"""


def counted(key: str, field: str) -> str:
    """Value counts of a field per group as one text."""
    return (
        f"SELECT {key} AS g, string_agg(x || '(' || n || ')', ', ' ORDER BY n DESC, x) AS {field}_counts FROM "
        f"(SELECT {key}, {field} AS x, count(*) AS n FROM t GROUP BY ALL) GROUP BY {key}"
    )


COUNT_MAPS = ", " + ", ".join(
    f"n_{f} AS ({counted('KEY', f)})" for f in ("category", "task_type", "severity")
)


def sampled(column: str, source: str, n: int) -> str:
    return (
        f"SELECT category, list({column} ORDER BY ts DESC, id DESC) AS samples FROM (SELECT * FROM {source} "
        f"QUALIFY row_number() OVER (PARTITION BY category ORDER BY ts DESC, id DESC) <= {n}) GROUP BY category"
    )


def filled_in(template: str, *values: str) -> str:
    """A prompt text as an SQL expression, with expressions in its places."""
    parts = template.split("%s")
    pieces = [text(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [value, text(part)]
    return " || ".join(pieces)


def category_report() -> str:
    prompt = filled_in(
        v.CLUSTER_PROMPT, "size", fixed("avg_hours", 1), fixed("median_hours", 1),
        "category_counts", "task_type_counts", "severity_counts", "replace(keywords, ',', ', ')",
        f"array_to_string(list_transform(samples, lambda x: '- ' || x), {NL})",
    )
    return on_tickets(
        f"""SELECT category AS cluster, size, keywords, peak_month, category_counts AS category,
  task_type_counts AS task_type, severity_counts AS severity, {text(v.ANALYST_PROMPT)} AS system,
  {prompt} AS prompt
FROM m JOIN p USING (category) JOIN (
  SELECT category, string_agg(term, ',' ORDER BY rank) AS keywords FROM k GROUP BY category
) USING (category) JOIN ({sampled('combined', 'd', v.CLUSTER_SAMPLES)}) USING (category)
JOIN n_category c ON c.g = category JOIN n_task_type y ON y.g = category JOIN n_severity z ON z.g = category""",
        KEYWORDS + TIMES + COUNT_MAPS.replace("KEY", "category"),
    )


def batch_prompts() -> str:
    listed = f"{NL} || '- ' || array_to_string(samples, {NL} || '- ')"
    return on_tickets(
        f"""SELECT category, {filled_in(v.BATCH_SUMMARY_PROMPT, listed)} AS summary_prompt,
  {filled_in(v.BATCH_ROOT_CAUSE_PROMPT, listed)} AS root_cause_prompt, {text(v.BATCH_ANALYST_PROMPT)} AS system_prompt
FROM ({sampled('combined', 'd', v.BATCH_SAMPLES)})""",
        f", d AS (SELECT *, {COMBINED_BATCH} AS combined FROM t)",
    )


def assistant_prompts(found: str, more: str = "") -> str:
    incident = (
        f"{text(v.INCIDENT_HEAD)} || '- summary: ' || summary || {NL} || '- category: ' || category || {NL} || "
        f"'- priority: ' || priority || {NL}"
    )
    gap = f" || {NL} || '--' || {NL} || "
    return on_tickets(
        f"""SELECT query_id, ticket_id,
  'system: ' || CASE WHEN focus AND ticket_id IS NOT NULL
    THEN {filled_in(v.TICKET_PROMPT, 'ticket_id')} ELSE {text(v.GENERAL_PROMPT)} END
  || CASE WHEN focus THEN '' ELSE ''{gap}'system: ' ||
    coalesce({text(v.CONTEXT_PROMPT_HEAD)} || context, {text(v.NO_CONTEXT_PROMPT)}) END
  || CASE WHEN with_incident THEN ''{gap}'system: ' || {incident} ELSE '' END
  {gap}'user: How to resolve ' || ticket_number || '?' AS messages,
  NOT focus AND context IS NOT NULL AS context_used,
  CASE WHEN NOT focus THEN coalesce(context, {text(v.NO_CONTEXT_SUMMARY)}) END AS context_summary {more}
FROM (
  SELECT id AS query_id, CASE WHEN id::BIGINT % 4 <> 3 THEN ticket_number END AS ticket_id,
    id::BIGINT % 2 = 1 AS focus, id::BIGINT % 3 <> 0 AS with_incident, summary, category, priority,
    ticket_number
  FROM t
) LEFT JOIN ({CONTEXT_TEXT}) USING (query_id)""",
        found,
    )


PROCESSED = """, CASE WHEN NOT focus AND query_id IN (SELECT query_id FROM q)
  THEN (SELECT count(*) FROM c) ELSE 0 END AS incidents_processed"""


def link(number: str) -> str:
    token = f"left(sha256({number} || '-{NOW}-{ACCESS_KEY}'), 32)"
    return f"'{BASE_URL}/direct-ticket/' || {number} || '/' || {token}"


def replies(title: str, table_head: str, cells: str, source: str, group: str = "") -> str:
    line = f"'- Ticket ' || ticket_number || ': ' || {link('ticket_number')} || {NL}"
    return f"""SELECT {group + ',' if group else ''}
  {text(f'## {title}' + chr(10) * 2 + table_head)} ||
  string_agg('|' || ticket_number || '|' || summary || '|' || {cells} || {NL}, '' ORDER BY rank) ||
  {text(v.LINKS_HEAD)} || string_agg({line}, '' ORDER BY rank) AS reply
FROM {source} {'GROUP BY ' + group if group else ''}"""


def scored_replies(title: str, threshold: float, k: int) -> str:
    cells = f"{fixed('score * 100', 1)} || '%|'"
    return on_tickets(
        replies(title, v.SCORED_TABLE_HEAD, cells, "h JOIN c USING (id)", "query_id"), best(None, threshold, k)
    )


MESSAGES = f"""
msg AS (
  SELECT conv_id || '-' || turn AS message_id,
    lower({texts(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] || text) AS x FROM conversations
)"""


def any_of(keywords) -> str:
    return "(" + " OR ".join(f"contains(x, {text(k)})" for k in keywords) + ")"


def topic_words(expression: str) -> str:
    stop = texts(v.TOPIC_STOP_WORDS)
    return (
        f"list_filter(regexp_split_to_array({expression}, '[{SPACE}]+'), "
        f"lambda a: length(a) > 2 AND NOT list_contains({stop}, a))"
    )


def topic(keywords) -> str:
    after = topic_words("substr(x, instr(x, k) + length(k))")
    found = f"list_filter({texts(keywords)}, lambda k: contains(x, k))"
    telling = (
        f"list_filter(list_concat(list_transform({found}, lambda k: {after}), [{topic_words('x')}]), "
        "lambda b: len(b) > 0)"
    )
    return f"coalesce(array_to_string({telling}[1][1:3], ' '), x)"


ARGUMENT = strip("substr(x, 9)")


def routed(otherwise: str) -> str:
    def or_text(keywords) -> str:
        return f"CASE WHEN {non_blank(topic(keywords))} THEN {topic(keywords)} ELSE x END"

    return f"""WITH {MESSAGES}, i AS (
  SELECT message_id, x, CASE
    WHEN starts_with(x, '/similar') THEN 'similar_command'
    WHEN starts_with(x, '/recommend') THEN 'recommend_command'
    WHEN starts_with(x, '/help') THEN 'help_command'
    WHEN starts_with(x, '/') THEN 'ignored'
    WHEN NOT {non_blank('x')} THEN 'empty'
    WHEN {any_of(v.RECOMMEND_KEYWORDS)} THEN 'recommend'
    WHEN {any_of(v.SIMILAR_KEYWORDS)} THEN 'similar'
    ELSE '{otherwise}' END AS intent FROM msg
)
SELECT message_id, intent, CASE intent
  WHEN 'similar_command' THEN nullif({ARGUMENT}, '')
  WHEN 'recommend_command' THEN {text(v.RECOMMEND_COMMAND_TEXT)}
  WHEN 'recommend' THEN {or_text(v.RECOMMEND_KEYWORDS)}
  WHEN 'similar' THEN {or_text(v.SIMILAR_KEYWORDS)}
  WHEN 'fallback_similar' THEN x END AS search_text FROM i"""


def letters(expression: str) -> str:
    return (
        f"list_transform({texts(LETTERS)}, lambda a: length(lower({expression})) - "
        f"length(replace(lower({expression}), a, '')))::DOUBLE[]"
    )


def by_letters(queries: str) -> str:
    """Scores of query texts, ``query_id, x``, against all searchable tickets."""
    return f""",
c AS (SELECT * FROM t WHERE length(summary) > 5),
u AS (SELECT id, ts, {letters('summary')} AS e FROM c WHERE {non_blank('summary')}),
q AS (SELECT query_id, {letters('x')} AS e FROM ({queries}) WHERE {non_blank('x')}),
s AS (
  SELECT query_id, id, ts, CASE WHEN isnan(score) THEN 0 ELSE score END AS score FROM (
    SELECT query_id, id, ts, round(coalesce(list_cosine_similarity(q.e, u.e), 0), 9) AS score FROM q CROSS JOIN u
  )
),
h AS (
  SELECT query_id, id, score, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, ts DESC, id DESC) AS rank
  FROM s WHERE score >= 0.3 QUALIFY rank <= 5
)"""


def answered_by_letters() -> str:
    cells = f"{fixed('score * 100', 1)} || '%|'"
    similar_reply = replies(
        v.SIMILAR_TITLE, v.SCORED_TABLE_HEAD, cells,
        "h JOIN c USING (id) JOIN m ON m.message_id = query_id "
        "WHERE m.intent IN ('similar_command', 'similar')", "query_id",
    )
    recommend_reply = replies(
        v.RECOMMENDED_TITLE, v.SCORED_TABLE_HEAD, cells,
        "(SELECT * FROM h WHERE score >= 0.4 AND rank <= 3) JOIN c USING (id) JOIN m ON m.message_id = query_id "
        "WHERE m.intent IN ('recommend_command', 'recommend')", "query_id",
    )
    asked = "SELECT message_id AS query_id, search_text AS x FROM m WHERE search_text IS NOT NULL"
    return on_tickets(
        f"""SELECT message_id, intent, reply FROM m LEFT JOIN (
  {similar_reply} UNION ALL {recommend_reply}
) ON query_id = message_id""",
        f", m AS ({routed('chat')})" + by_letters(asked),
    )


CENTROIDS = """WITH m AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, len(embedding) + 1) r(i) GROUP BY ALL
), c AS (SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY label)"""
NEWEST_EVENT = """SELECT user_id, event_type AS reference, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
HIGH = "(lower(priority) = 'high' OR lower(severity) IN ('severity 1', 'severity 2'))"


_MOMENT = """make_timestamp(2020 + doc_id % 3, 1 + doc_id % 12, 13 + doc_id % 16, doc_id % 24, doc_id % 60,
  (doc_id * 7 % 60)::DOUBLE)"""


def profiled(source: str) -> str:
    return f"""SELECT count(*) AS total, count(*) FILTER ({non_blank('summary')}) AS with_summary,
  count(*) FILTER ({non_blank('latest_comments')}) AS with_comments, {NOW - LOADED_AT} AS age_seconds,
  0.3::DOUBLE AS similar_threshold, 0.4::DOUBLE AS recommend_threshold, 0.5::DOUBLE AS context_threshold
FROM {source}"""


def by_field(fields, key: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {key} '{f}' AS field, {f} AS value, count(*) AS n FROM t GROUP BY ALL" for f in fields
    )


def likely_similar(threshold: float, k: int = v.SIMILAR_K, seed: int = 42) -> str:
    """The search by sign bits: planes written out, each ticket in its own bucket of every band, each query also in those
    beyond its nearest planes."""
    index = Index.of(0, threshold, bits=LIKELY_BITS)
    normals = planes_of(index, 64, seed)
    planes = ", ".join(
        f"({i // index.bits}, {i % index.bits}, [{', '.join(map(repr, row))}]::DOUBLE[])"
        for i, row in enumerate(normals.tolist())
    )
    return on_tickets(
        f"""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, id DESC) AS rank,
  round(score, 6) AS score FROM (
  SELECT DISTINCT a.id AS query_id, b.id, b.ts, round(list_cosine_similarity(a.e, b.e), 9) AS score
  FROM looked l JOIN own o ON l.band = o.band AND l.bucket = o.bucket AND l.id <> o.id
  JOIN vectors a ON a.id = l.id JOIN vectors b ON b.id = o.id)
WHERE score >= {threshold} QUALIFY rank <= {k}""",
        f""", planes(band, bit, normal) AS (VALUES {planes}),
vectors AS (
  SELECT t.id, t.ts, embedding::DOUBLE[] AS e FROM t JOIN embeddings ON vec_id::VARCHAR = t.id
  WHERE length(summary) > 5 AND {non_blank('summary')}),
sides AS (SELECT id, band, bit, list_dot_product(e, normal) AS side FROM vectors CROSS JOIN planes),
own AS (SELECT id, band, sum(CASE WHEN side >= 0 THEN 1 << bit ELSE 0 END)::BIGINT AS bucket FROM sides GROUP BY id, band),
near AS (
  SELECT id, band, bit FROM sides QUALIFY row_number() OVER (PARTITION BY id, band ORDER BY abs(side), bit) <= {index.probes}),
looked AS (
  SELECT id, band, bucket FROM own UNION ALL
  SELECT id, band, xor(bucket, (1 << bit)::BIGINT) FROM own JOIN near USING (id, band))""",
    )


def likely_recall() -> str:
    parts = [
        f"SELECT {t}::DOUBLE AS threshold, (SELECT count(*) FROM ({exact_neighbours(t, 10)})) AS neighbours, true AS enough"
        for t in (v.SIMILAR_THRESHOLD, v.RECOMMEND_THRESHOLD)
    ]
    return " UNION ALL ".join(parts)


def exact_neighbours(threshold: float, k: int) -> str:
    return on_tickets(
        f"""SELECT a.id AS query_id, b.id FROM vectors a JOIN vectors b ON a.id <> b.id
WHERE round(list_cosine_similarity(a.e, b.e), 9) >= {threshold}
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.ts DESC, b.id DESC) <= {k}""",
        f""", vectors AS (
  SELECT t.id, t.ts, embedding::DOUBLE[] AS e FROM t JOIN embeddings ON vec_id::VARCHAR = t.id
  WHERE length(summary) > 5 AND {non_blank('summary')})""",
    )


def all_terms(sql: str) -> str:
    return sql.replace("ORDER BY total DESC, term LIMIT 2000", "")


def kmeans_from_categories(steps: int) -> str:
    """Centres as rows per term, moved and asked again step by step."""
    more = WEIGHTS + """,
a0 AS (SELECT id, dense_rank() OVER (ORDER BY category) - 1 AS cluster FROM t)"""
    for i in range(1, steps + 2):
        # The first step asks the means of the categories, the last only places the tickets.
        more += f""",
n{i} AS (SELECT cluster, count(*) AS n FROM a{i - 1} GROUP BY cluster),
c{i} AS MATERIALIZED (
  SELECT cluster, term, sum(weight) / any_value(n) AS x
  FROM a{i - 1} JOIN wt USING (id) JOIN n{i} USING (cluster) GROUP BY cluster, term),
l{i} AS (SELECT cluster, sum(x * x) AS l FROM n{i} LEFT JOIN c{i} USING (cluster) GROUP BY cluster),
p{i} AS (SELECT id, cluster, sum(weight * x) AS p FROM wt JOIN c{i} USING (term) GROUP BY id, cluster),
a{i} AS MATERIALIZED (
  SELECT t.id, l.cluster FROM t CROSS JOIN l{i} l LEFT JOIN p{i} p ON p.id = t.id AND p.cluster = l.cluster
  QUALIFY row_number() OVER (
    PARTITION BY t.id ORDER BY round(coalesce(l, 0) - 2 * coalesce(p, 0), 9), l.cluster) = 1)"""
    return on_tickets(f"SELECT id, cluster FROM a{steps + 1}", more)


def _squared(times: int, start: str, name: str) -> str:
    """A matrix (i, j, v) squared again and again, scaled by its trace each time."""
    parts, last = [], start
    for k in range(times):
        parts.append(f"""{name}{k} AS MATERIALIZED (
  SELECT a.i, b.j, sum(a.v * b.v) / (SELECT sum(v) ** 2 FROM {last} WHERE i = j) AS v
  FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j)""")
        last = f"{name}{k}"
    return ", ".join(parts)


def _axis(power: str, matrix: str, name: str) -> str:
    """The first axis of a matrix, from the column of its power with the largest diagonal; the largest loading positive."""
    return f"""{name}_raw AS (
  SELECT i, v FROM {power} WHERE j = (SELECT arg_max(i, v) FROM {power} WHERE i = j)),
{name} AS MATERIALIZED (
  SELECT i, v * (SELECT sign(arg_max(v, abs(v))) FROM {name}_raw) / (SELECT sqrt(sum(v * v)) FROM {name}_raw) AS v
  FROM {name}_raw),
{name}_l AS (
  SELECT sum(a.v * m.v * b.v) AS l FROM {matrix} m JOIN {name} a ON a.i = m.i JOIN {name} b ON b.i = m.j)"""


PCA = f"""WITH e AS (
  SELECT vec_id::VARCHAR AS id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
m AS (SELECT i, avg(v) AS mean FROM e GROUP BY i),
x AS MATERIALIZED (SELECT id, i, v - mean AS v FROM e JOIN m USING (i)),
n AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
c AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.v * b.v) / any_value(n) AS v FROM x a JOIN x b USING (id) CROSS JOIN n GROUP BY a.i, b.i),
{_squared(13, "c", "f")}, {_axis("f12", "c", "one")},
d AS MATERIALIZED (
  SELECT c.i, c.j, c.v - (SELECT l FROM one_l) * a.v * b.v AS v FROM c JOIN one a ON a.i = c.i JOIN one b ON b.i = c.j),
{_squared(13, "d", "g")}, {_axis("g12", "d", "two")}
SELECT id, round(sum(x.v * one.v), 5) AS x, round(sum(x.v * two.v), 5) AS y
FROM x JOIN one USING (i) JOIN two USING (i) GROUP BY id"""


def report_tables() -> str:
    def listed(table: str, fields) -> str:
        return f"SELECT '{table}' AS report_table, field, value, n FROM ({by_field(fields)})"

    def whole(table: str, n: str) -> str:
        return f"SELECT '{table}', NULL, NULL, ({n})::BIGINT"

    parts = [
        listed("overview_counts", ["category", "severity", "status"]),
        listed("cluster_counts", ["category", "task_type", "severity"]),
        *(whole(x, "SELECT count(*) FROM t") for x in ("labels", "clusters", "summary", "projection2d")),
        whole("cluster_modes", "6"), whole("cluster_keywords", "7"), whole("cluster_prompts", "5"),
    ]
    return on_tickets(" UNION ALL ".join(parts))


def oracle_sql() -> dict[str, str]:
    modes = by_field(["category", "severity", "status", "ticket_owner"], "project,")
    clean = (
        f"regexp_split_to_array(regexp_replace(lower({COMBINED_BATCH}), '[^a-z0-9{SPACE}]', '', 'g'), '[{SPACE}]+')"
    )
    reflow = "'1. ' || text || ' 2. see 21. and 0.1.'"
    for i in range(1, 7):
        reflow = f"replace({reflow}, '{i}.', {NL} || '{i}.')"
    every_ticket = on_tickets(
        "SELECT query_id, id, rank, round(score, 6) AS score FROM h WHERE query_id IN (SELECT id FROM u)",
        best(None, 0.3, 5),
    )
    overview = on_tickets(by_field(["category", "severity", "status"]))
    texts_by_letters = on_tickets(
        "SELECT query_id, rank, id, round(score, 6) AS similarity_score FROM h",
        by_letters("SELECT doc_id AS query_id, text AS x FROM documents"),
    )
    own = f"left(sha256(doc_id || '-' || ({NOW} - doc_id * 1000) || '-{ACCESS_KEY}'), 32)"
    return {
        "full_scan": on_tickets(
            "SELECT summary, latest_comments, task_type, status, category, severity, priority, "
            "resolution_date, date_submitted FROM t"
        ),
        "recent_tickets": on_tickets(f"SELECT {CANDIDATE} FROM r", RECENT),
        "recent_tickets_page": on_tickets(
            "SELECT id, ts, summary FROM t WHERE length(summary) > 5 ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 40"
        ),
        "latest_tickets": on_tickets(
            f"SELECT {CANDIDATE} FROM t WHERE length(summary) > 5 ORDER BY ts DESC, id DESC LIMIT 5"
        ),
        "search_substring": on_tickets(
            f"SELECT {CANDIDATE} FROM t WHERE length(summary) > 5 AND contains(lower(summary), lower({text(SEARCHED)}))"
        ),
        "search_recent": on_tickets(
            f"SELECT {CANDIDATE} FROM r WHERE contains(lower(summary), lower({text(SEARCHED)}))", SEARCHABLE
        ),
        "high_priority_all": on_tickets(
            f"SELECT {CANDIDATE} FROM t WHERE length(summary) > 5 AND {HIGH} ORDER BY ts DESC, id DESC LIMIT 5"
        ),
        "high_priority": on_tickets(
            f"SELECT {CANDIDATE} FROM r WHERE {HIGH} ORDER BY ts DESC, id DESC LIMIT 5", RECENT
        ),
        "ticket_lookup": on_tickets(f"SELECT {CANDIDATE} FROM t WHERE ticket_number = {text(LOOKED_UP)}"),
        "ticket_details": on_tickets(
            f"""SELECT ticket_number, status, priority, category, severity, project, date_submitted,
  coalesce(nullif(resolution_date, ''), {text(v.NOT_RESOLVED)}) AS resolution_date,
  coalesce(nullif(latest_comments, ''), {text(v.NO_COMMENTS)}) AS latest_comments FROM t"""
        ),
        "profile": on_tickets(profiled("r"), SEARCHABLE),
        "profile_all": on_tickets(profiled("t")),
        "profile_samples": on_tickets(
            f"""SELECT ticket_number,
  CASE WHEN length(summary) > 100 THEN left(summary, 100) || '...' ELSE summary END AS summary,
  {non_blank('latest_comments')} AS has_comments, category FROM r ORDER BY ts DESC, id DESC LIMIT 3""",
            SEARCHABLE,
        ),
        "json_rows": on_tickets(
            """SELECT to_json({'id': id, 'ts': ts, 'project': project, 'category': category,
  'resolution_date': resolution_date})::VARCHAR AS json FROM t"""
        ),
        "similar_top5": similar(None),
        "similar_top5_all": similar(None),
        "recommend_top3": recommend(None),
        "recommend_top3_all": recommend(None),
        "context_top3": on_tickets(FOUND, context(None, 0.5, 0.3)),
        "context_top3_all": on_tickets(FOUND, context(None, 0.5, 0.1)),
        "context_top3_035": on_tickets(FOUND, context(None, 0.35, 0.1)),
        "similar_for_every_ticket": every_ticket,
        "similar_for_every_ticket_by_grid": every_ticket,
        "likely_similar_for_every_ticket": likely_similar(v.RECOMMEND_THRESHOLD),
        "likely_similar_at_low_threshold": likely_similar(v.SIMILAR_THRESHOLD),
        "likely_similar_recall": likely_recall(),
        "hash_embedding_lengths": f"""SELECT doc_id, CASE WHEN len({tokens('text')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length
FROM documents WHERE {non_blank('text')} UNION ALL
SELECT doc_id, NULL FROM documents WHERE NOT {non_blank('text')}""",
        "kmeans_coverage": on_tickets(
            "SELECT count(*) AS tickets, count(DISTINCT id) AS ids, 5 AS clusters, true AS settled FROM t"
        ),
        "kmeans_from_categories": kmeans_from_categories(3),
        "pca_2d_embeddings": PCA,
        "pca_2d_moments": on_tickets("""SELECT count(*) AS tickets, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y,
  0.0::DOUBLE AS correlation, true AS in_order FROM t"""),
        "assign_centroid": CENTROIDS + """, d AS (
  SELECT vec_id, label, sqrt(greatest(round(
    list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - centroid[i]) ** 2)), 9), 0)) AS distance
  FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN c
) SELECT vec_id::VARCHAR AS id, label AS cluster, round(distance, 6) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) = 1""",
        "cosine_to_centroid": CENTROIDS + """
SELECT vec_id::VARCHAR AS id, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS similarity
FROM embeddings JOIN c USING (label)""",
        "embed_distinct_texts": f"""SELECT doc_id, sha256(text) AS text_key,
  count(*) OVER (PARTITION BY text) AS copies, true AS embedded FROM documents WHERE {non_blank('text')}""",
        "overview_counts": overview,
        "report_tables": report_tables(),
        "value_count_maps": on_tickets(
            """SELECT a.g AS project, category_counts AS category, task_type_counts AS task_type,
  severity_counts AS severity FROM n_category a JOIN n_task_type b USING (g) JOIN n_severity c USING (g)""",
            COUNT_MAPS.replace("KEY", "project"),
        ),
        "tied_modes": on_tickets(
            f"""SELECT project, field, array_to_string(list(value ORDER BY value)[1:3], ',') AS modes FROM (
  SELECT * FROM ({modes}) QUALIFY rank() OVER (PARTITION BY project, field ORDER BY n DESC) = 1
) GROUP BY project, field"""
        ),
        "category_metrics": on_tickets(
            """SELECT category, size, round(avg_hours, 4) AS avg_hours, round(median_hours, 4) AS median_hours,
  earliest, latest, peak_month, 0 AS n_bad_dates FROM m JOIN p USING (category)""",
            TIMES,
        ),
        "category_approximate_medians": on_tickets(
            """SELECT category, quantile_disc(date_diff('microsecond', submitted, resolved), 0.5) AS median
FROM t GROUP BY category"""
        ),
        "overall_metrics": on_tickets(
            f"""SELECT count(*) AS size, round(avg({HOURS}), 4) AS avg_hours,
  round(median({HOURS}), 4) AS median_hours, (
    SELECT strftime(submitted, '%Y-%m') AS month FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
  ) AS peak_month FROM t"""
        ),
        "metrics_rollup": on_tickets(
            f"""SELECT sum(size)::BIGINT AS total, {fixed(f"avg({fixed('avg_hours', 1)}::DOUBLE)", 1)}::DOUBLE AS avg_hours,
  count(*) AS groups FROM m""",
            TIMES,
        ),
        "group_samples": on_tickets(
            f"SELECT category, array_to_string(samples, {NL}) AS samples FROM ({sampled('summary', 't', 5)})"
        ),
        "combined_text": on_tickets(f"SELECT id, {COMBINED} AS combined_text FROM t"),
        "clean_text": on_tickets(
            f"""SELECT id, array_to_string(list_filter({clean},
  lambda x: x <> '' AND NOT list_contains({STOP}, x)), ' ') AS clean FROM t"""
        ),
        "tokens": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
        "ngrams": f"""SELECT doc_id, array_to_string({GRAMS}, '|') AS terms FROM (
  SELECT doc_id, list_filter({tokens('text')}, lambda x: NOT list_contains({STOP}, x)) AS w FROM documents)""",
        "vocabulary": on_tickets(
            "SELECT term, df, total::BIGINT AS total, round(idf, 6) AS idf FROM voc", all_terms(TERMS)
        ),
        "tfidf_weights": on_tickets("SELECT id, term, round(weight, 6) AS weight FROM wt", all_terms(WEIGHTS)),
        "keywords_top7": on_tickets(
            "SELECT category, rank, term, round(weight, 6) AS weight FROM k", KEYWORDS
        ),
        "category_term_weights": on_tickets(
            "SELECT category, term, round(sum(weight), 6) AS weight FROM wt JOIN t USING (id) GROUP BY ALL",
            all_terms(WEIGHTS),
        ),
        "text_pieces": on_tickets(
            f"""SELECT id,
  CASE WHEN length(summary) > 100 THEN left(summary, 100) || '...' ELSE summary END AS preview,
  CASE WHEN {non_blank('latest_comments')} THEN summary || ' ' || latest_comments ELSE summary END AS query_text,
  CASE WHEN {non_blank('latest_comments')} THEN latest_comments ELSE {text(v.NO_RESOLUTION)} END AS resolution
FROM t"""
        ),
        "reflowed": f"SELECT doc_id, {reflow} AS answer FROM documents",
        "category_report": category_report(),
        "category_batch_prompts": batch_prompts(),
        "context_prompts": on_tickets(CONTEXT_TEXT, context(None, 0.35, 0.1)),
        "assistant_prompts": assistant_prompts(context(None, 0.35, 0.1)),
        "ask_assistant": assistant_prompts(context(None, 0.5, 0.3, "true"), PROCESSED),
        "ask_assistant_all": assistant_prompts(context(None, 0.5, 0.3, "true"), PROCESSED),
        "similar_to_texts_by_letters": texts_by_letters,
        "similar_to_texts_by_memo": texts_by_letters,
        "answered_messages_by_letters": answered_by_letters(),
        "recommend_for_incidents": recommend(None, "query_id IN (SELECT id FROM t)"),
        "search_texts": on_tickets(
            f"""SELECT id AS query_id, CASE WHEN id::BIGINT % 5 <> 4 AND {non_blank('x')} THEN x END AS search_text
FROM (SELECT id, CASE WHEN id::BIGINT % 3 <> 0 THEN summary || ' ' || latest_comments ELSE category END AS x FROM t)"""
        ),
        "similar_replies": scored_replies(v.SIMILAR_TITLE, 0.3, 5),
        "recommended_replies": scored_replies(v.RECOMMENDED_TITLE, 0.4, 3),
        "latest_reply": on_tickets(
            replies(v.LATEST_TITLE, v.PLAIN_TABLE_HEAD, "''", """(
  SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rank FROM t WHERE length(summary) > 5 QUALIFY rank <= 5
)"""),
        ),
        "access_links": on_tickets(f"SELECT id, {link('ticket_number')} AS link FROM t"),
        "token_check": f"""SELECT doc_id, token,
  length(token) = 32 AND regexp_matches(token, '{BASE_16}') AS well_formed,
  token = own AND doc_id * 1000 <= {v.TOKEN_TTL_SECONDS} AS valid FROM (
  SELECT doc_id, {own} AS own, CASE doc_id % 4 WHEN 0 THEN '0x' || left(own, 30) WHEN 1 THEN left(own, 31)
    WHEN 2 THEN 'g' || left(own, 31) ELSE own END AS token FROM documents)""",
        "route_messages": routed("chat"),
        "route_messages_no_model": routed("fallback_similar"),
        "message_topics": f"""WITH {MESSAGES}
SELECT message_id, {topic(v.SIMILAR_KEYWORDS)} AS topic, {ARGUMENT} AS argument FROM msg""",
        "route_messages_stream": routed("chat"),
        "latest_per_user": NEWEST_EVENT,
        "latest_per_user_stream": NEWEST_EVENT,
        "latest_per_user_until_stream": f"""SELECT user_id, event_type AS reference, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
  AND ts + INTERVAL {EXPIRY_HOURS} HOURS > (SELECT max(ts) FROM events)""",
        "insert_if_absent": """WITH a AS (
  SELECT 'user' || c_custkey || '@example.org' AS email, c_name AS name FROM customer
  UNION ALL SELECT 'user' || (s_suppkey * 13) || '@example.org', s_name FROM supplier
) SELECT email, min(name) AS name FROM a
WHERE email NOT IN (SELECT 'user' || user_id || '@example.org' FROM events) GROUP BY email""",
        "accounts_by_bucket": """WITH a AS (
  SELECT 'user' || c_custkey || '@example.org' AS email, c_name AS name FROM customer
  UNION ALL SELECT 'user' || (s_suppkey * 13) || '@example.org', s_name FROM supplier
), k AS (SELECT DISTINCT 'user' || user_id || '@example.org' AS email FROM events)
SELECT email, 'known' AS name FROM k
UNION ALL SELECT email, min(name) FROM a WHERE email NOT IN (SELECT email FROM k) GROUP BY email""",
        "append_twice": on_tickets(
            "SELECT ticket_number, summary, 1 AS copies FROM t"
        ),
        "sheet_by_heading": f"""SELECT 'INC-' || doc_id AS ticket_number, source AS summary, NULL::VARCHAR AS project,
  lang AS severity, n_chars::VARCHAR AS room FROM documents""",
        "sheets_of_other_headings": """SELECT 'INC-' || doc_id AS ticket_number, source AS summary, lang AS project,
  CASE WHEN doc_id % 2 = 1 THEN doc_id::VARCHAR END AS room FROM documents""",
        "sheet_with_title": """SELECT 'INC-' || doc_id AS ticket_number, source AS summary, lang AS project FROM documents""",
        "sheet_load_summary": """SELECT count(*) AS read, count(*) FILTER (doc_id % 10 = 0) AS rejected,
  count(*) FILTER (doc_id % 10 <> 0) AS written, count(*) FILTER (doc_id % 10 = 0) AS rejected_stored,
  min('INC-' || doc_id || ',' || lang || ',too,many') FILTER (doc_id % 10 = 0) AS first_rejected FROM documents""",
        "date_forms": f"""SELECT doc_id, CASE
    WHEN doc_id % 14 IN (12, 13) THEN NULL
    WHEN doc_id % 14 IN (0, 1, 2, 3) THEN strftime({_MOMENT}, '%Y-%m-%d %H:%M:%S')
    ELSE strftime({_MOMENT}, '%Y-%m-%d 00:00:00') END AS moment, doc_id % 14 = 13 AS is_bad FROM documents""",
        "bad_dates": """SELECT source, count(*) FILTER (doc_id % 14 = 13) AS n_bad, count(*) FILTER (doc_id % 14 = 12) AS n_blank
FROM documents GROUP BY source""",
        "sheet_round_trip": on_tickets(
            "SELECT ticket_number, summary, project, category, severity, priority, status, task_type, "
            "ticket_owner, date_submitted, resolution_date, latest_comments FROM t"
        ),
    }
