"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds further spans.

The field reads islands: runs of neighbouring chunks of text that hold a digit or an @. It scores whole candidate
segments of bounded length by features of the span (form, digits, grouping, check digit, what stands around it)
and chooses boundaries and types together by dynamic programming. Its weights are learned here, by the
likelihood of the spans that the patterns find in a bounded sample of islands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import first_hashes

#: The patterns of the base kinds, in the order in which spans with the same start are listed.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # A run of digits that fails from its first digit fails from all others, so it is read once.
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = tuple(PATTERNS)

NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CHUNK = re.compile(r"\S+")
MARK = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]+")
LETTER = re.compile(r"[^\W\d_]")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z\s]")
#: Longest segment, in tokens and characters. Longer spans are left to the patterns.
MAX_TOKENS = 13
MAX_CHARS = 64
#: Most digits of a segment without an @.
MAX_DIGITS = 24
#: Signs that a segment may begin and end with.
OPENS, CLOSES = "+(_", ")_-"
#: Tokens of an island whose segments are scored at a time.
TOKENS_AT_ONCE = 512
#: Scores of segments that a task keeps.
SCORED = 100_000
#: The sample the weights are learned from: documents that hold an @ or a digit, in the order of a hash of their id.
FIT_DOCUMENTS = 1500
#: They are looked for among so many times as many documents; where fewer hold one, the sample is smaller.
FIT_SPARE = 64
FIT_ISLANDS = 3000
FIT_ISLAND_CHARS = 200
FIT_STEPS = 60
FIT_RATE = 0.5
FIT_DECAY = 1e-3

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _holds(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        digits = _digits(text)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_digits(text)) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns: leftmost matches per kind, none overlapping, those that fail their test dropped."""
    found = _emails(text)
    for kind, pattern in PATTERNS.items():
        if kind == "email" or kind == "phone" and "+" not in text:
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _holds(kind, m.group())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _emails(text: str) -> list[Span]:
    """The matches of the e-mail pattern, found from each @: what is no name holds no @, so a name is read once."""
    found: list[Span] = []
    until, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > until and text[start - 1] in NAME:
            start -= 1
        host = HOST.match(text, at) if start < at else None
        if host:
            until = host.end()
            found.append((start, until, "email"))
        at = text.find("@", max(at + 1, until))
    return found


FEATURES = (
    "bias", "tokens", "one_at", "name_then_host", "dotted_host", "dotted_quad", "small_parts", "n_digits_7_9",
    "n_digits_10_13", "n_digits_14_19", "check_digit", "groups_even", "plus", "brackets", "only_digits",
    "digits_and_breaks", "letters", "cut_left", "cut_right", "ends_in_sign",
)


def _features(span: str, before: str, after: str, tokens: int) -> list[float]:
    digits = _digits(span)
    parts = span.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    name, _, host = span.partition("@")
    groups = re.split(r"[ -]", span)
    letters = LETTER.search(span) is not None
    return [
        1.0,
        tokens / MAX_TOKENS,
        float(span.count("@") == 1),
        float(bool(name) and bool(host) and span.count("@") == 1 and " " not in span),
        float("." in host and not host.startswith(".") and not host.endswith(".")),
        float(quad),
        float(quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(7 <= len(digits) <= 9),
        float(10 <= len(digits) <= 13),
        float(14 <= len(digits) <= 19),
        float(len(digits) >= 14 and luhn(digits)),
        float(len(groups) > 1 and all(len(g) == 4 and g.isdigit() for g in groups)),
        float(span.startswith("+")),
        float(span.count("(") == 1 and span.count(")") == 1 and span.index("(") < span.index(")")),
        float(span.isdigit()),
        float(bool(digits) and not letters and not span.strip("0123456789 -().+")),
        float(letters),
        float(before.isalnum() or before in {"@", ".", "_", "+"} and before != ""),
        float(after.isalnum() or after in {"@", "_"}),
        float(not (span[-1].isalnum()) or not (span[0].isalnum() or span[0] in "+(")),
    ]


@dataclass
class _Lattice:
    """Candidate segments of an island: from token ``start`` up to, not with, ``end``, with their features."""

    tokens: list[tuple[int, int]]
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray


def lattice(island: str) -> _Lattice:
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(island)]
    found = list(_segments(island, tokens, 0, len(tokens)))
    rows = [_features(*seen) for _, _, seen in found]
    return _Lattice(
        tokens, np.array([s for s, _, _ in found], int), np.array([e for _, e, _ in found], int),
        np.array(rows, float).reshape(len(rows), len(FEATURES)),
    )


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _segments(
    island: str, tokens: list[tuple[int, int]], first: int, last: int
) -> Iterator[tuple[int, int, tuple[str, str, str, int]]]:
    """The candidates that start at the tokens from ``first`` up to ``last``: start, end, what the features look at.

    None begins with a sign but ``OPENS``, ends with one but ``CLOSES``, or is over the bounds.
    """
    for i in range(first, last):
        left = tokens[i][0]
        if not _plain(island[left]) and island[left] not in OPENS:
            continue
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            right = tokens[j][1]
            if right - left > MAX_CHARS:
                break
            if not _plain(island[right - 1]) and island[right - 1] not in CLOSES:
                continue
            span = island[left:right]
            digits = len(_digits(span))
            if "@" not in span and digits > MAX_DIGITS:
                break
            if digits or "@" in span:
                yield i, j + 1, (span, island[max(0, left - 1) : left], island[right : right + 1], j - i + 1)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(sum(np.exp(v - top) for v in values)))


@dataclass
class SpanField:
    """Weights (kind, feature). A token outside of all spans scores 0."""

    weights: np.ndarray
    scored: dict[tuple, tuple[int, float]] = field(default_factory=dict)
    """The best kind and its score of segments seen before, as many as ``SCORED``."""

    def _score(self, segments: set[tuple]) -> None:
        if len(self.scored) > SCORED:
            self.scored.clear()
        new = [s for s in segments if s not in self.scored]
        if new:
            scores = np.array([_features(*s) for s in new], float) @ self.weights.T
            self.scored.update(zip(new, zip(scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist())))

    def best(self, island: str) -> list[Span]:
        """The segmentation of the highest score; of equals the one found first, from the left."""
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(island)]
        n = len(tokens)
        value = [0.0] + [-np.inf] * n
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for first in range(0, n, TOKENS_AT_ONCE):
            until = min(n, first + TOKENS_AT_ONCE)
            found = list(_segments(island, tokens, first, until))
            self._score({seen for _, _, seen in found})
            k = 0
            # What ends at a token is known when the segments that start there come.
            for i in range(first, until):
                if value[i] >= value[i + 1]:
                    value[i + 1], last[i + 1] = value[i], None
                while k < len(found) and found[k][0] == i:
                    _, end, seen = found[k]
                    kind, top = self.scored[seen]
                    if value[i] + top > value[end]:
                        value[end], last[end] = value[i] + top, (i, kind)
                    k += 1
        spans, j = [], n
        while j > 0:
            if last[j] is None:
                j -= 1
                continue
            i, kind = last[j]
            spans.append((tokens[i][0], tokens[j - 1][1], KINDS[kind]))
            j = i
        return spans[::-1]

    def gradient(self, grid: _Lattice, gold: np.ndarray) -> np.ndarray:
        """Observed minus expected feature sums. ``gold``: (segment, kind) cells of the true segmentation."""
        scores = grid.features @ self.weights.T
        top = scores.max(axis=1, keepdims=True)
        segment = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
        n = len(grid.tokens)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(zip(grid.start, grid.end)):
            by_end[j].append(k)
            by_start[i].append(k)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[j - 1], *(ahead[grid.start[k]] + segment[k] for k in by_end[j])])
        for i in range(n - 1, -1, -1):
            behind[i] = _log_sum([behind[i + 1], *(behind[grid.end[k]] + segment[k] for k in by_start[i])])
        ahead, behind = np.array(ahead), np.array(behind)
        expected = np.exp(ahead[grid.start][:, None] + scores + behind[grid.end][:, None] - ahead[n])
        return (gold - expected).T @ grid.features


def islands(text: str) -> Iterator[tuple[int, str]]:
    """Neighbouring chunks with a digit or an @, one space between them, and where they start."""
    start = end = -1
    for chunk in CHUNK.finditer(text):
        if not MARK.search(text, chunk.start(), chunk.end()):
            continue
        if end < 0 or chunk.start() != end + 1 or text[end] != " ":
            if end >= 0:
                yield start, text[start:end]
            start = chunk.start()
        end = chunk.end()
    if end >= 0:
        yield start, text[start:end]


def learn(samples: list[tuple[str, list[Span]]]) -> SpanField:
    """The field of the largest penalised likelihood over islands with their true spans, by gradient steps."""
    field = SpanField(np.zeros((len(KINDS), len(FEATURES))))
    field.weights[:, 0] = -1.0
    prepared = []
    for island, spans in samples:
        grid = lattice(island)
        if not len(grid.start):
            continue
        gold = np.zeros((len(grid.start), len(KINDS)))
        place = {}
        for k, (i, j) in enumerate(zip(grid.start, grid.end)):
            place[grid.tokens[i][0], grid.tokens[j - 1][1]] = k
        for left, right, kind in spans:
            if (left, right) in place:
                gold[place[left, right], KINDS.index(kind)] = 1
        prepared.append((grid, gold))
    if not prepared:
        return field
    squares = np.full(field.weights.shape, 1e-8)
    for _ in range(FIT_STEPS):
        gradient = sum(field.gradient(grid, gold) for grid, gold in prepared) / len(prepared)
        gradient -= FIT_DECAY * field.weights
        squares += gradient**2
        field.weights += FIT_RATE * gradient / np.sqrt(squares)
    return field


def _without_overlaps(spans: list[Span]) -> list[Span]:
    """Of base spans that overlap, the longest: true segmentations hold each place once."""
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if all(span[1] <= k[0] or k[1] <= span[0] for k in kept):
            kept.append(span)
    return sorted(kept)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", documents: int = FIT_DOCUMENTS) -> SpanField:
    """Learn the field from a bounded sample: of each text the islands of up to ``FIT_ISLAND_CHARS`` characters."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for order, text in zip(batch.column("o").to_pylist(), batch.column("text").to_pylist()):
                found = [s for _, s in islands(text) if len(s) <= FIT_ISLAND_CHARS]
                if found:
                    rows.append((order, found[: FIT_ISLANDS // 100]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))],
                names=["o", "islands"],
            )

    text = F.col(text_col)
    order = F.xxhash64(F.col(id_col), text)
    rows = (
        docs.where(first_hashes(order, documents, docs.count(), FIT_SPARE) & text.rlike("[0-9@]"))
        .select(order.alias("o"), text.alias("text"))
        .mapInArrow(sample, "o long, islands array<string>")
        .orderBy("o", "islands").limit(documents).collect()
    )
    found = [island for row in rows for island in row["islands"]][:FIT_ISLANDS]
    return learn([(island, _without_overlaps(base_spans(island))) for island in dict.fromkeys(found)])


def spans_of(text: str, field: SpanField) -> tuple[list[Span], list[Span]]:
    """Base spans, and with them the field's spans that touch none of them."""
    if not any(c in text for c in "@0123456789"):
        return [], []
    base = base_spans(text)
    taken = np.array(sorted((s, e) for s, e, _ in base), int).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    added = []
    for offset, island in islands(text):
        for left, right, kind in field.best(island):
            start, end = offset + left, offset + right
            at = int(np.searchsorted(taken[:, 0], end)) - 1  # the last base span that starts before this one ends
            if at < 0 or reach[at] <= start:
                added.append((start, end, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``COLUMNS`` for every row: counts and hash of the base spans, and all spans as text.

    ``kind:start:end`` in code points, the end not included. Null texts are empty and have no spans. Repeated rows
    each get their row; an empty table gives an empty result, and with no island to learn from the field adds nothing.
    Other columns are not read.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    field = fit(read)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = spans_of(text or "", field)
                counts = [sum(s[2] == kind for s in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, kinds))],
                names=[c.split()[0] for c in COLUMNS.split(", ")],
            )

    return read.mapInArrow(tag, COLUMNS)
