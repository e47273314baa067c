"""DuckDB SQL that gives the rows of the corpus queries, where SQL can express them."""

from __future__ import annotations

from caseloom.llm import decontaminate as leaks
from caseloom.llm import distribution_rules as rules
from caseloom.llm.secret_ledger import RULES

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _secrets() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind,
                   string_split_regex(text, '{pattern}') AS gaps,
                   regexp_extract_all(text, '{pattern}', 0) AS whole,
                   regexp_extract_all(text, '{pattern}', {rule.group}) AS part, {rule.min_chars} AS least
            FROM docs WHERE regexp_matches(text, '{pattern}')""")
    found = " UNION ALL ".join(parts)
    base = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({found}),
    pieces AS (
        SELECT doc_id, rank, kind, least, unnest(range(1, len(whole) + 1)) AS k, gaps, whole, part FROM found),
    spans AS (
        SELECT doc_id, rank, kind, length(part[k]) >= least AS good,
               sum(length(gaps[k]) + length(whole[k])) OVER (
                   PARTITION BY doc_id, rank ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop,
               length(whole[k]) AS n
        FROM pieces),
    listed AS (
        SELECT doc_id, rank, kind, stop - n AS start, kind || ':' || (stop - n) || ':' || stop AS span
        FROM spans WHERE good),
    grouped AS (
        SELECT doc_id, {base},
               string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base_spans,
               string_agg(span, ',' ORDER BY start, rank) AS spans
        FROM listed GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN grouped USING (doc_id)"""


_LINES = f"""
    WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM docs),
    keys AS (SELECT doc_id, line, place, translate(trim(line, {_WHITE}), {_LOWER}) AS key FROM lines),
    repeated AS (
        SELECT key, max(doc_id) AS last_doc FROM keys WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
        SELECT doc_id, line, place, coalesce(last_doc <> doc_id, false) AS out FROM keys LEFT JOIN repeated USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT out), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""


_GAP = r"\x20\x09-\x0D"


def _only(chars: str) -> str:
    """How many characters of the text are of a class."""
    quoted = chars.replace("'", "''")
    return f"length(regexp_replace(text, '[^{quoted}]', '', 'g'))"


def _distance(kind: str, guard: int) -> str:
    """Distances of one kind of histogram from the counts of documents and references."""
    return f"""
        SELECT c.doc_id, round(sqrt(greatest(0, least(1, sum(
            CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))), 6) AS distance
        FROM (
            SELECT d.doc_id, coalesce(h.n, 0)::DOUBLE / t.total AS p, r.share AS q
            FROM chosen d JOIN totals t USING (doc_id) JOIN shares r ON r.ref = d.ref AND r.kind = t.kind
            LEFT JOIN counts h ON h.doc_id = d.doc_id AND h.kind = r.kind AND h.item = r.item
            WHERE t.kind = '{kind}' AND t.total >= {guard}) c
        GROUP BY c.doc_id"""


def _quality_rules() -> str:
    classes = {
        "lower": r"\p{Ll}", "upper": r"\p{Lu}", "letter": r"\p{Lt}\p{Lm}\p{Lo}\p{M}", "digit": "0-9", "white": _GAP,
        "punctuation": rules.PUNCTUATION.replace("-", r"\-"),
    }
    counted = ", ".join(f"{_only(chars)} AS {name}" for name, chars in classes.items())
    return f"""
    WITH docs AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^{_GAP}]+') AS w,
               regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS tokens,
               length(coalesce(text, '')) AS chars
        FROM documents),
    lines AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '[^{_GAP}]') GROUP BY doc_id),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs),
    windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM starts),
    repeated AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
    sized AS (SELECT doc_id, {counted} FROM docs),
    base AS (
        SELECT doc_id, lang, lower, upper, chars, len(w) AS n_words, chars - white AS word_chars, {_only("#*$%&|<>")} AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM docs JOIN sized USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
    class_counts AS (
        SELECT doc_id, 'class' AS kind, item, n FROM (
            SELECT doc_id, unnest(map_entries(map {{{", ".join(f"'{n}': {n}" for n in classes)},
                'other': chars - {" - ".join(classes)}}}), recursive := true)
            FROM docs JOIN sized USING (doc_id)) AS u(doc_id, item, n)),
    tokens AS (
        SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS token FROM docs) GROUP BY ALL),
    learned AS (
        SELECT doc_id, lang FROM base
        WHERE n_words >= {rules.MIN_WORDS} AND 100 * n_symbols <= {rules.MAX_SYMBOL_PERCENT} * chars
              AND 100 * upper <= {rules.MAX_UPPER_PERCENT} * (lower + upper)),
    lang_words AS (SELECT lang, token, sum(n) AS n FROM tokens JOIN learned USING (doc_id) GROUP BY ALL),
    langs AS (
        SELECT lang FROM lang_words WHERE lang <> '' GROUP BY lang HAVING sum(n) >= {rules.MIN_REFERENCE_WORDS}
        ORDER BY sum(n) DESC, lang LIMIT {rules.MAX_LANGUAGES}),
    ref_words AS (
        SELECT lang AS ref, token, n FROM lang_words JOIN langs USING (lang)),
    common AS (
        SELECT ref, token, n FROM ref_words WHERE length(token) <= {rules.COMMON_LETTERS}
        QUALIFY row_number() OVER (PARTITION BY ref ORDER BY n DESC, token) <= {rules.COMMON_WORDS}),
    ref_counts AS (
        SELECT ref, 'word' AS kind, 'w:' || token AS item, n FROM common
        UNION ALL
        SELECT ref, 'word', 'rest', sum(n) - (SELECT sum(n) FROM common c WHERE c.ref = r.ref) FROM ref_words r GROUP BY ref
        UNION ALL
        SELECT lang, 'class', item, sum(n) FROM class_counts JOIN learned USING (doc_id) JOIN langs USING (lang) GROUP BY ALL),
    shares AS (SELECT ref, kind, item, n::DOUBLE / sum(n) OVER (PARTITION BY ref, kind) AS share FROM ref_counts),
    chosen AS (SELECT doc_id, lang AS ref FROM docs JOIN langs USING (lang)),
    counts AS (
        SELECT doc_id, kind, item, n FROM class_counts
        UNION ALL
        SELECT doc_id, 'word', item, sum(n) FROM (
            SELECT t.doc_id, CASE WHEN c.token IS NULL THEN 'rest' ELSE 'w:' || t.token END AS item, t.n
            FROM tokens t JOIN chosen USING (doc_id) LEFT JOIN common c ON c.ref = chosen.ref AND c.token = t.token)
        GROUP BY doc_id, item),
    totals AS (SELECT doc_id, kind, sum(n) AS total FROM counts GROUP BY ALL),
    by_class AS ({_distance("class", rules.MIN_CHARS)}),
    by_word AS ({_distance("word", rules.MIN_LETTER_WORDS)})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words AS base_failed,
           NOT base_failed AND coalesce(by_class.distance, 0) <= {rules.MAX_CHAR_DISTANCE}
               AND coalesce(by_word.distance, 0) <= {rules.MAX_WORD_DISTANCE} AS kept,
           by_class.distance AS char_distance, by_word.distance AS word_distance
    FROM base LEFT JOIN by_class USING (doc_id) LEFT JOIN by_word USING (doc_id)"""


def _leaks() -> str:
    """All windows that begin with a shingle of an item, without fingerprints; items of five words up to one piece."""
    size = leaks.SHINGLE
    run = " || chr(32) || ".join(f"w[i + {k}]" for k in range(size))
    return rf"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
    items AS (
        SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
    item_shingles AS (
        SELECT item_id, {run} AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM items)),
    item_counts AS (SELECT item_id, s, count(*) AS n FROM item_shingles GROUP BY ALL),
    item_sizes AS (SELECT item_id, count(*) AS m FROM item_shingles GROUP BY ALL),
    doc_shingles AS (
        SELECT doc_id, i - 1 AS pos, {run} AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM docs)),
    begins AS (
        SELECT DISTINCT d.doc_id, d.pos, c.item_id, m
        FROM doc_shingles d JOIN item_counts c USING (s) JOIN item_sizes USING (item_id)),
    touched AS (SELECT * FROM doc_shingles WHERE doc_id IN (SELECT doc_id FROM begins)),
    windows AS (
        SELECT b.doc_id, b.pos, b.item_id, m, t.s, count(*) AS n
        FROM begins b JOIN touched t ON t.doc_id = b.doc_id AND t.pos >= b.pos AND t.pos < b.pos + m GROUP BY ALL),
    compared AS (
        SELECT w.doc_id, w.pos, w.item_id, m, sum(w.n) AS size, sum(least(w.n, coalesce(c.n, 0))) AS common
        FROM windows w LEFT JOIN item_counts c ON c.item_id = w.item_id AND c.s = w.s GROUP BY ALL)
    SELECT doc_id, item_id, round(common / (size + m - common), 6) AS similarity, pos AS start_word,
           size + {size - 1} AS n_words
    FROM compared WHERE common * {leaks.OF} >= (size + m - common) * {leaks.SHARED}
    QUALIFY row_number() OVER (
        PARTITION BY doc_id, item_id ORDER BY common / (size + m - common) DESC, pos, size DESC) = 1"""


def _linked(size: int, shared: int, of: int) -> str:
    """All pairs that share an n-gram, and everything reachable by links."""
    run = " || chr(32) || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(text, {_LOWER}), '[^{_GAP}]+') AS w FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, g FROM (
            SELECT doc_id, {run} AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM docs WHERE len(w) >= {size})
            UNION ALL SELECT doc_id, array_to_string(w, chr(32)) FROM docs WHERE len(w) BETWEEN 1 AND {size - 1})),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE {of} * common >= {shared} * (x.n + y.n - common)),
    reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other),
    parts AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id),
    counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
    FROM parts LEFT JOIN sizes USING (doc_id) LEFT JOIN counts USING (doc_id)"""


def _phrases() -> str:
    def grams(words: int) -> str:
        text = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
        return f"""SELECT lang, phrase, count(*) AS f FROM (
            SELECT lang, unnest(list_transform(range(1, len(w) - {words} + 2), lambda i: {text})) AS phrase FROM pieces)
        GROUP BY lang, phrase"""

    return f"""
    WITH docs AS (
        SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LOWER}) AS text FROM documents),
    pieces AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
        FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs)),
    one AS ({grams(1)}), two AS ({grams(2)}), three AS ({grams(3)}),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
    triples AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS w FROM three WHERE f >= 10),
    inside AS (
        SELECT lang, phrase, max(f) AS longest FROM (
            SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM triples UNION ALL
            SELECT lang, w[2] || ' ' || w[3], f FROM triples)
        GROUP BY lang, phrase),
    pairs AS (
        SELECT t.lang, t.phrase, t.f, string_split(t.phrase, ' ') AS w FROM two t LEFT JOIN inside USING (lang, phrase)
        WHERE t.f >= 10 AND (longest IS NULL OR 100 * longest < 50 * t.f)),
    cuts AS (
        SELECT lang, phrase, f AS a, 1 AS k, w[1] AS front, w[2] AS rest FROM pairs UNION ALL
        SELECT lang, phrase, f, 1, w[1], w[2] || ' ' || w[3] FROM triples UNION ALL
        SELECT lang, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM triples),
    known AS (SELECT * FROM one UNION ALL SELECT * FROM two),
    scored AS (
        SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
               ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.front
        JOIN known y ON y.lang = c.lang AND y.phrase = c.rest),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, score
    FROM best JOIN totals USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality_rules(),
        "op2_benchmark_leaks": _leaks(),
        "op3_ngram_join": _linked(4, 85, 100),
        "op4_secret_scan": _secrets(),
        "op6_line_dedup": _LINES,
        "op11_phrases": _phrases(),
    }
