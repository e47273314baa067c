"""Scoring query vectors against ticket vectors, and keeping the best few per query.

Scoring is a matrix product inside tasks, on Arrow batches; Spark decides which rows meet where.
Three layouts give the same result:

* few tickets, any number of queries: the ticket block goes to every task, queries stream past it.
  Each query sees all tickets at once, so there is no shuffle at all.
* few queries, any number of tickets: the query block goes to every task, tickets stream past it.
  Every task keeps its own best ``k`` per query, so the shuffle carries k rows per query and task.
* many of both: either side is written down once in blocks of bounded size, rows with the same vector sharing it, and every
  part of the queries meets every part of the tickets. Blocks are read again from where they are stored, so that
  no row is shuffled more than once; a task holds a part of the tickets, in leaves of vectors near each other, looks for the
  best ``k`` per query in the leaves that may have them, and gives every block to Python once.

No layout forms the pairs as rows. A block is only sent to the tasks after a check of its size.
Scores are rounded so that equal vectors score equal wherever they meet; ties go to the newer
ticket, then to the higher id.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.joins import SALTS, hot_keys
from caseloom.session import shared_dir, written

BLOCK_ROWS = 4096
CELL_ROWS = 8192
# Numbers of the vectors of a block that meets others, 4 MB as floats.
BLOCK_CELLS = 1 << 20
# Bytes of vectors that a task holds of the tickets it reads again and again.
HELD_BYTES = 64 << 20
SCORE_DIGITS = 9
# Queries that look for their best together, the tickets they look at first, and at most at a time.
QUERIES_AT_ONCE = 1024
FIRST_TICKETS, MOST_TICKETS = 256, 2048
# Vectors of a leaf, axes its box is laid on, and what its bound may be short of by single precision.
LEAF_ROWS, BOX_AXES, BOX_SLACK = 256, 8, 1e-5
# Queries that look for their best in a part together, the leaves they look into first, and at most at a time.
PART_QUERIES, FIRST_LEAVES, MOST_LEAVES = 2048, 2, 16
# Vectors of a part that are worked on at a time, and leaves.
STEP_ROWS, BOUND_LEAVES = 16384, 64
# Scores held at one time inside a task.
SCORES_AT_ONCE = 4_000_000

BY_SCORE = "score"
BY_RECENCY = "recency"

# The functions of this module travel to the executors with the job, which need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HIT_COLUMNS = ["query_id", "id", "ts", "score", "rank"]


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as matrix rows of length one; all-zero vectors stay zero and so score 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = len(vectors)
    if rows == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(vectors.value_lengths())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different length cannot be compared")
    return unit_matrix(flat.reshape(rows, -1))


def unit_matrix(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


def with_vector(table: pa.Table, column: str) -> pa.Table:
    """The rows that have a vector.

    Left to the tasks, as a filter of Spark's would compute a vector once more that is made on the way.
    """
    return table.filter(pc.greater(pc.list_value_length(table[column]), 0))


class Block(NamedTuple):
    """Vectors with their ids, tickets newest first."""

    ids: np.ndarray
    ts: np.ndarray | None
    matrix: np.ndarray

    @classmethod
    def of_tickets(cls, table: pa.Table) -> Block:
        newest = with_vector(table, "embedding").sort_by([("ts", "descending"), ("id", "descending")])
        return cls(_values(newest["id"]), _values(newest["ts"]), unit_rows(newest["embedding"]))

    def part(self, rows: np.ndarray | slice) -> Block:
        return Block(self.ids[rows], None if self.ts is None else self.ts[rows], self.matrix[rows])

    @classmethod
    def of_queries(cls, table: pa.Table) -> Block:
        table = with_vector(table, "query_vec")
        return cls(_values(table["query_id"]), None, unit_rows(table["query_vec"]))


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class Rule(NamedTuple):
    """Which scores count, how many per query, in which order."""

    threshold: float
    k: int
    by: str = BY_SCORE
    exclude_self: bool = False

    def order(self) -> list[Column]:
        newest = [F.desc("ts"), F.desc("id")]
        return newest if self.by == BY_RECENCY else [F.desc("score"), *newest]

    def best(self, hits: pd.DataFrame) -> pd.DataFrame:
        keys = ["ts", "id"] if self.by == BY_RECENCY else ["score", "ts", "id"]
        ordered = hits.sort_values(["query_id", *keys], ascending=[True] + [False] * len(keys))
        return ordered.groupby("query_id", sort=False).head(self.k)


def top_hits(queries: Block, tickets: Block, rule: Rule) -> pd.DataFrame:
    """The best tickets of a block for every query of a block."""
    return _as_rows(queries, tickets, _hits(queries, tickets, rule))


def _as_rows(queries: Block, tickets: Block, hits: tuple[np.ndarray, ...]) -> pd.DataFrame:
    query, ticket, score, place = hits
    if len(query) == 0:
        return pd.DataFrame(columns=_HIT_COLUMNS)
    picked = (queries.ids[query], tickets.ids[ticket], tickets.ts[ticket], score, place)
    return pd.DataFrame(dict(zip(_HIT_COLUMNS, picked)))


def _hits(
    queries: Block, tickets: Block, rule: Rule, least: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Places of queries and of their best tickets, scores and ranks. ``least``: scores below need not be found, per query."""
    found = []
    if len(queries.ids) and len(tickets.ids):
        own = pd.Index(tickets.ids).get_indexer(queries.ids) if rule.exclude_self else None
        every = slice(0, len(tickets.ids))
        if rule.by == BY_RECENCY:
            step = max(1, SCORES_AT_ONCE // len(tickets.ids))
            for start in range(0, len(queries.ids), step):
                part = slice(start, start + step)
                query, *rest = _all_scored(queries.matrix[part], tickets.matrix, _own(own, part, every), rule)
                found.append((query + start, *rest))
        else:
            rough = tickets.matrix.astype(np.float32)
            if least is None:
                least = np.full(len(queries.ids), rule.threshold)
            for start in range(0, len(queries.ids), QUERIES_AT_ONCE):
                part = slice(start, start + QUERIES_AT_ONCE)
                own_here = _own(own, part, every)
                query, *rest = _nearest(queries.matrix[part], tickets.matrix, rough, own_here, rule, least[part].copy())
                found.append((query + start, *rest))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0), np.zeros(0, np.int64))
    return tuple(np.concatenate(part) for part in zip(*found))


def _own(own: np.ndarray | None, queries: slice, tickets: slice) -> np.ndarray | None:
    """The place of each query of a part among the tickets of a part; -1 if it is not there."""
    if own is None:
        return None
    here = own[queries]
    return np.where((here >= tickets.start) & (here < tickets.stop), here - tickets.start, -1)


def _all_scored(
    x: np.ndarray, y: np.ndarray, own: np.ndarray | None, rule: Rule, allowed: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """The best of y for every row of x, all scores at hand; ``allowed``: the pairs that count."""
    scores = np.round(x @ y.T, SCORE_DIGITS)
    rank = np.where(scores >= rule.threshold, scores, -np.inf)
    if allowed is not None:
        rank = np.where(allowed, rank, -np.inf)
    if rule.by == BY_RECENCY:
        rank = np.where(np.isfinite(rank), 0.0, -np.inf)
    if own is not None:
        rank[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
    every = np.arange(len(rank))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    # argmax takes the first of equals, and tickets are newest first.
    for place in range(1, min(rule.k, rank.shape[1]) + 1):
        best = rank.argmax(axis=1)
        left = np.flatnonzero(rank[every, best] > -np.inf)
        if len(left) == 0:
            break
        found.append((left, best[left], scores[left, best[left]], np.full(len(left), place)))
        rank[every, best] = -np.inf
    return tuple(np.concatenate(part) for part in zip(*found))


def _nearest(
    x: np.ndarray, y: np.ndarray, rough: np.ndarray, own: np.ndarray | None, rule: Rule, least: np.ndarray
) -> tuple[np.ndarray, ...]:
    """The best of y for every row of x.

    Scores are first taken in single precision, and only pairs that may be among the best are scored again as
    everywhere else. ``slack`` bounds the error of single precision for unit vectors, so none is missed. Where many pairs
    may be among the best, as at first and among copies, all of them are scored.
    """
    near = x.astype(np.float32)
    slack = (x.shape[1] + 8) * 2.0**-23 + 10.0**-SCORE_DIGITS
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    begin = 0
    while begin < len(y):
        part = slice(begin, min(len(y), begin + min(max(begin, FIRST_TICKETS), MOST_TICKETS)))
        close = near @ rough[part].T >= (least - slack).astype(np.float32)[:, None]
        if np.count_nonzero(close) * 16 > close.size:
            query, ticket, score, _ = _all_scored(x, y[part], _own(own, slice(None), part), rule)
        else:
            query, ticket = np.divmod(np.flatnonzero(close), close.shape[1])
            score = np.round(np.einsum("ij,ij->i", x[query], y[part][ticket]), SCORE_DIGITS)
            good = score >= least[query]
            if own is not None:
                good &= own[query] != ticket + begin
            query, ticket, score = query[good], ticket[good], score[good]
        if len(query):
            query, ticket, score = (
                np.concatenate(pair) for pair in zip(kept, (query, ticket + begin, score))
            )
            order = np.lexsort((ticket, -score, query))
            query, ticket, score = query[order], ticket[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == rule.k - 1
            least[query[last]] = np.maximum(least[query[last]], score[last])
            kept = query[place < rule.k], ticket[place < rule.k], score[place < rule.k]
        begin = part.stop
    query = kept[0]
    return *kept, np.arange(len(query)) - np.searchsorted(query, query) + 1


class Best:
    """The best hits of a block of queries, over one block of tickets after another."""

    def __init__(self, queries: Block, rule: Rule):
        self.queries, self.rule = queries, rule
        self._parts: list[pd.DataFrame] = []
        self._rows = 0
        # Scores of the best so far: what is worse than k of them is not looked for any more.
        self._scores = np.full((len(queries.ids), rule.k), -np.inf)

    def add(self, tickets: Block) -> None:
        least = np.maximum(self._scores[:, 0], self.rule.threshold)
        hits = _hits(self.queries, tickets, self.rule, least)
        if len(hits[0]) == 0:
            return
        query, _, score, place = hits
        if self.rule.by == BY_SCORE:
            more = np.full_like(self._scores, -np.inf)
            more[query, place - 1] = score
            self._scores = np.sort(np.concatenate([self._scores, more], axis=1), axis=1)[:, self.rule.k:]
        self._parts.append(_as_rows(self.queries, tickets, hits))
        self._rows += len(query)
        if self._rows > 4 * self._scores.size:
            self._parts = [self.rows()]
            self._rows = len(self._parts[0])

    def rows(self) -> pd.DataFrame:
        if not self._parts:
            return pd.DataFrame(columns=_HIT_COLUMNS)
        return self.rule.best(pd.concat(self._parts))


class Found(NamedTuple):
    """Best hits, ``query_id, id, ts, score, rank``, and whether they are few for certain."""

    hits: DataFrame
    few: bool


def top_k(
    queries: DataFrame,
    tickets: DataFrame,
    rule: Rule,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> Found:
    """Per query the best ``rule.k`` tickets that reach the threshold, with their rank.

    ``queries`` has ``query_id, query_vec`` and ``tickets`` has ``id, ts, embedding``; ids are
    unique on either side. Rows without a vector take no part.
    """
    tickets = tickets.select("id", "ts", "embedding")
    queries = queries.select("query_id", "query_vec")
    block = bounded(queries, block_rows)
    if block is not None:
        return Found(_stream_tickets(block, queries, tickets, rule), True)
    block = bounded(tickets, block_rows)
    if block is not None:
        return Found(top_k_of_block(queries, block, tickets.schema, rule), False)
    return Found(grid(queries, tickets, rule, cell_rows), False)


def bounded(df: DataFrame, rows: int) -> pa.Table | None:
    """The rows of a table if there are no more than ``rows`` of them.

    The check reads partitions only until it has seen enough rows, and fetches none of their columns.
    """
    if len(df.select(F.lit(1)).limit(rows + 1).collect()) > rows:
        return None
    return df.toArrow()


def top_k_of_block(
    queries: DataFrame, tickets: pa.Table, ticket_schema: T.StructType, rule: Rule
) -> DataFrame:
    """Best tickets of a small ticket table per query. Map-only."""
    held = queries.sparkSession.sparkContext.broadcast(tuple(Block.of_tickets(tickets)))
    schema = hit_schema(queries.schema, ticket_schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = Block.of_queries(pa.Table.from_batches([batch]))
            yield from _to_arrow(top_hits(block, Block(*held.value), rule), schema).to_batches()

    return queries.select("query_id", "query_vec").mapInArrow(score, schema)


def top_k_or_recent_of_block(
    queries: DataFrame, tickets: pa.Table, ticket_schema: T.StructType, strict: Rule, loose: Rule, recent: int
) -> DataFrame:
    """Best tickets of a small ticket table per query by the strict rule; for a query with none, those that
    the loose rule picks among the ``recent`` newest, ranked by score. Map-only, every pair scored once."""
    held = queries.sparkSession.sparkContext.broadcast(tuple(Block.of_tickets(tickets)))
    schema = T.StructType([
        *hit_schema(queries.schema, ticket_schema).fields, T.StructField("is_fallback", T.BooleanType()),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest_first = Block(*held.value)
        for batch in batches:
            asking = Block.of_queries(pa.Table.from_batches([batch]))
            hits = top_hits(asking, newest_first, strict).assign(is_fallback=False)
            left = asking.part(~np.isin(asking.ids, hits["query_id"].to_numpy()))
            others = top_hits(left, newest_first.part(slice(0, recent)), loose).assign(is_fallback=True)
            others = others.sort_values(["query_id", "score", "rank"], ascending=[True, False, True])
            others["rank"] = others.groupby("query_id").cumcount() + 1
            for found in (hits, others):
                yield from _to_arrow(found, schema).to_batches()

    return queries.select("query_id", "query_vec").mapInArrow(score, schema)


def _stream_tickets(block: pa.Table, queries: DataFrame, tickets: DataFrame, rule: Rule) -> DataFrame:
    held = queries.sparkSession.sparkContext.broadcast(tuple(Block.of_queries(block)))
    schema = hit_schema(queries.schema, tickets.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(Block(*held.value), rule)
        for batch in batches:
            best.add(Block.of_tickets(pa.Table.from_batches([batch])))
        yield from _to_arrow(best.rows(), schema).to_batches()

    return ranked(tickets.mapInArrow(score, schema), rule)


def grid(
    queries: DataFrame, tickets: DataFrame, rule: Rule, cell_rows: int, meeting: Meeting | None = None
) -> DataFrame:
    """Every part of the queries against every part of the tickets, out of the blocks as they are stored.

    A part is as many blocks as a task can hold. With a ``meeting`` only the pairs count that it brings together.
    """
    schema = hit_schema(queries.schema, tickets.schema)
    there = blocks(tickets, ["id", "ts"], "embedding", cell_rows, rule.k + rule.exclude_self)
    here = blocks(queries, ["query_id"], "query_vec", cell_rows)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    # Few parts of tickets, as each of them has its own best for every query; parts of queries for all cores.
    down = _parts(there)
    across = max(_parts(here), math.ceil(3 * cores / down))
    there = there.coalesce(down).withColumn("place", _place_in_part())
    here = here.coalesce(across).toDF(*(f"asking_{c}" for c in here.columns)).withColumn("asking_place", _place_in_part())
    # Spark's cross join that reads the files of one side again for each part of the other; rows of it are blocks. The pairs
    # of a block of queries come one after the other: each block goes to Python once, all tickets beside the first queries.
    first_asking, first = F.col("asking_place") == 0, F.col("place") == 0
    met = here.crossJoin(there.hint("shuffle_replicate_nl")).where(first_asking | first).select(
        *(F.when(first_asking, F.col(c)).alias(c) for c in there.columns[:-1]),
        *(F.when(first, F.col(c)).alias(c) for c in here.columns[:-1]),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, part = [], [], None
        for batch in batches:
            for pair in batch.to_struct_array():
                if pair["asking_matrix"].is_valid:
                    waiting.append(Shared.of(pair, "asking_", ["query_id"]))
                if pair["matrix"].is_valid:
                    held.append(Shared.of(pair, "", ["id", "ts"]))
                    continue
                if part is None:
                    part = Part(held, rule, meeting)
                    held = None
                while waiting:
                    yield part.hits(waiting.pop(0), schema)
        if held:
            part = Part(held, rule, meeting)
        for asking in waiting:
            yield part.hits(asking, schema)

    return ranked(met.mapInArrow(score, schema), rule)


def _place_in_part() -> Column:
    return F.monotonically_increasing_id() % (1 << 33)


def _parts(stored: DataFrame) -> int:
    """How many parts hold the vectors of all blocks, none larger than a task can hold."""
    held = stored.agg(F.sum(F.length("matrix"))).first()[0] or 0
    return max(1, -(-held // HELD_BYTES))


def blocks(
    rows: DataFrame, columns: list[str], vector: str, cell_rows: int, most: int | None = None
) -> DataFrame:
    """Rows that have a vector as blocks, written down: lists of the columns, and the vectors as one ``matrix``.

    Rows are dealt by their vectors. Those with the same vector share it where they meet: ``copies`` has the rows of each. A
    row with ``ts`` is a ticket: those of a vector are newest first, and only ``most`` of them stay. Vectors near each other
    stand together. Blocks have ``cell_rows`` rows and, so that they do not become too many, more in large tables, up to
    ``BLOCK_CELLS`` numbers.
    """
    key, is_ticket = columns[0], "ts" in columns
    rows = written(rows.select(*columns, vector), "vectors")
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    first = rows.select(F.size(vector).alias("n")).where("n > 0").head()
    width = first["n"] if first else 1
    held = max(1, min(max(cell_rows, -(-n // (8 * cores))), BLOCK_CELLS // width))
    kind = np.dtype(np.float32 if rows.schema[vector].dataType.elementType == T.FloatType() else np.float64)
    # Tickets in few parts, as they are met; queries for all cores.
    parts = max(-(-n * width * kind.itemsize // HELD_BYTES), 1 if is_ticket else 3 * cores)
    parts = max(1, min(parts, -(-n // held)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            table = with_vector(pa.Table.from_batches([batch]), vector)
            if table.num_rows:
                waiting.append(table)
                count += table.num_rows
            if count * width * kind.itemsize > 2 * HELD_BYTES:
                yield from cut(pa.concat_tables(waiting))
                waiting, count = [], 0
        if count:
            yield from cut(pa.concat_tables(waiting))

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if is_ticket:
            table = table.sort_by([("ts", "descending"), (key, "descending")])
        matrix, picked, copies = _shared(table[vector].combine_chunks(), kind, most)
        table = table.select(columns).take(picked)
        # A vector that more rows share than a block has is repeated.
        pieces = -(-copies // held)
        vectors = np.repeat(np.arange(len(copies)), pieces)
        last = np.cumsum(pieces) - 1
        rest = copies - (pieces - 1) * held
        copies = np.full(len(vectors), held)
        copies[last] = rest
        ends = np.cumsum(copies)
        begin = row = 0
        while begin < len(vectors):
            end = int(np.searchsorted(ends, row + held, side="right"))
            part = table.slice(row, int(ends[end - 1]) - row)
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part[c].combine_chunks()) for c in columns
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *lists, pa.array([copies[begin:end].tolist()], pa.list_(pa.int32())),
                    pa.array([matrix[vectors[begin:end]].tobytes()], pa.binary()), pa.array([width], pa.int32()),
                ],
                names=[*columns, "copies", "matrix", "width"],
            )
            begin, row = end, int(ends[end - 1])

    schema = T.StructType([
        *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in columns),
        T.StructField("copies", T.ArrayType(T.IntegerType())),
        T.StructField("matrix", T.BinaryType()), T.StructField("width", T.IntegerType()),
    ])
    # Only vectors with very many rows go to several tasks.
    alike = rows.withColumn("_vector", F.xxhash64(vector))
    hot = F.broadcast(hot_keys(alike.select("_vector"), "_vector").withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(0)
    dealt = alike.join(hot, "_vector", "left").repartition(parts, "_vector", salt)
    shared_dir(rows.sparkSession)
    return dealt.select(*columns, vector).mapInArrow(pack, schema).checkpoint()


def _shared(vectors: pa.ListArray, kind: np.dtype, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different vectors, near ones together, the places of the rows of each, one after the other, and how many these are."""
    lengths = np.asarray(vectors.value_lengths())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different length cannot be compared")
    values = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(vectors), -1)
    whole = pa.Array.from_buffers(pa.binary(values.itemsize * values.shape[1]), len(values), [None, pa.py_buffer(values)])
    group = whole.dictionary_encode().indices.to_numpy()
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group)
    begins = np.cumsum(counts) - counts
    matrix = values[order[begins]]
    near = _together(matrix)
    copies = counts[near] if most is None else np.minimum(counts[near], most)
    return matrix[near], order[_ranges(begins[near], copies)], copies


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each beginning on, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _together(matrix: np.ndarray) -> np.ndarray:
    """An order in which vectors that point the same way stand together: halves along the axis they differ most on, again and
    again."""
    axes = _axes(sum(unit.T @ unit for unit, _ in _finite_units(matrix)))[:, :BOX_AXES]
    directions = np.concatenate([unit @ axes for unit, _ in _finite_units(matrix)])
    waiting, found = [np.arange(len(matrix))], []
    while waiting:
        some = waiting.pop()
        if len(some) <= LEAF_ROWS:
            found.append(some)
            continue
        here = directions[some]
        middle = len(some) // 2 // LEAF_ROWS * LEAF_ROWS or LEAF_ROWS
        halves = np.argpartition(here[:, here.var(axis=0).argmax()], middle)
        waiting += [some[halves[middle:]], some[halves[:middle]]]
    return np.concatenate(found)


def _finite_units(matrix: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
    """The vectors at length one, some at a time, and where these are; zeros for those with a number that is none."""
    for begin in range(0, len(matrix), STEP_ROWS):
        step = slice(begin, begin + STEP_ROWS)
        unit = unit_matrix(matrix[step].astype(np.float64))
        yield np.where(np.isfinite(unit).all(axis=1)[:, None], unit, 0.0), step


def _axes(moment: np.ndarray) -> np.ndarray:
    """Orthogonal axes as columns, those with most of the vectors' squares first."""
    return np.linalg.eigh(moment)[1][:, ::-1]


class Shared(NamedTuple):
    """A stored block: columns of its rows, how many rows each vector has, and the vectors as they came."""

    columns: list[pa.Array]
    copies: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, row: pa.StructScalar, prefix: str, columns: list[str]) -> Shared:
        copies = row[f"{prefix}copies"].values.to_numpy(zero_copy_only=False)
        buffer, width = row[f"{prefix}matrix"].as_buffer(), row[f"{prefix}width"].as_py()
        kind = np.float32 if len(buffer) == 4 * width * len(copies) else np.float64
        matrix = np.frombuffer(buffer, kind).reshape(len(copies), width)
        return cls([row[prefix + c].values for c in columns], copies, matrix)


class Meeting(Protocol):
    """Brings pairs together: the buckets of vectors, one a band, and those that queries look into, some a band."""

    def own(self, unit: np.ndarray) -> np.ndarray: ...

    def looked(self, unit: np.ndarray) -> np.ndarray: ...


class Part:
    """Tickets that a task holds, for one block of queries after another.

    Vectors stand in leaves of a few that are near each other. A leaf has a box around its vectors, on the axes that tell
    most of them, and what is beyond these axes counts by its length. How near a query comes to the box bounds its scores
    there, so that leaves are left out that cannot be among its best.
    """

    def __init__(self, held: list[Shared], rule: Rule, meeting: Meeting | None):
        self.rule, self.meeting = rule, meeting
        # Best tickets of a query, itself among them.
        self.k = rule.k + rule.exclude_self
        self.ids = pa.concat_arrays([b.columns[0] for b in held])
        self.ts = pa.concat_arrays([b.columns[1] for b in held])
        newest = pa.table({"ts": self.ts, "id": self.ids, "at": np.arange(len(self.ids))})
        newest = newest.sort_by([("ts", "descending"), ("id", "descending")])["at"].to_numpy()
        self.age = np.empty(len(newest), np.int64)
        self.age[newest] = np.arange(len(newest))
        self.copies = np.concatenate([b.copies for b in held]).astype(np.int64)
        self.first = np.cumsum(self.copies) - self.copies
        self.raw = np.concatenate([b.matrix for b in held])
        self.rough = np.zeros(self.raw.shape, np.float32)
        begins = np.concatenate([[0], np.cumsum([len(b.copies) for b in held])])
        self.begins = np.concatenate([np.arange(a, b, LEAF_ROWS) for a, b in zip(begins[:-1], begins[1:])])
        self.sizes = np.diff(self.begins, append=len(self.raw))
        # A vector with a number that is none scores nowhere, as its exact score is none either.
        moment, buckets = 0.0, []
        for unit, step in _finite_units(self.raw):
            self.rough[step] = unit
            moment = moment + unit.T @ unit
            if meeting is not None:
                buckets.append(meeting.own(unit))
        self.buckets = np.concatenate(buckets) if buckets else None
        self.axes = _axes(moment)[:, :BOX_AXES]
        on_axes = np.concatenate([self._on_axes(unit) for unit, _ in _finite_units(self.raw)]).T
        low = np.minimum.reduceat(on_axes, self.begins, axis=1)
        high = np.maximum.reduceat(on_axes, self.begins, axis=1)
        self.middle, self.reach = ((low + high) / 2).astype(np.float32), ((high - low) / 2).astype(np.float32)

    def _on_axes(self, unit: np.ndarray) -> np.ndarray:
        here = unit @ self.axes
        left = np.einsum("ij,ij->i", unit, unit) - np.einsum("ij,ij->i", here, here)
        return np.concatenate([here, np.sqrt(np.maximum(left, 0))[:, None]], axis=1)

    def hits(self, asking: Shared, schema: T.StructType) -> pa.RecordBatch:
        """The best tickets for the queries of a block."""
        unit = unit_matrix(asking.matrix.astype(np.float64))
        finite = np.flatnonzero(np.isfinite(unit).all(axis=1))
        search = self._newest if self.rule.by == BY_RECENCY else self._nearest
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for begin in range(0, len(finite), PART_QUERIES):
            some = finite[begin:begin + PART_QUERIES]
            query, vector, score = search(unit[some])
            found.append((some[query], vector, score))
        query, vector, score = (np.concatenate(part) for part in zip(*found))
        # Every ticket with the vector, then every query with the vector.
        copies = self.copies[vector]
        query, score = np.repeat(query, copies), np.repeat(score, copies)
        ticket = _ranges(self.first[vector], copies)
        by_age = self.rule.by == BY_RECENCY
        query, ticket, score, _ = _first(query, ticket, score, self.age[ticket], self.k, by_age)
        counts = np.bincount(query, minlength=len(unit))
        rows = np.repeat(np.arange(len(unit)), asking.copies)
        picked = _ranges((np.cumsum(counts) - counts)[rows], counts[rows])
        row = np.repeat(np.arange(len(rows)), counts[rows])
        ticket, score = ticket[picked], score[picked]
        names = asking.columns[0].take(pa.array(row))
        if self.rule.exclude_self and names.type == self.ids.type:
            other = np.flatnonzero(~pc.equal(names, self.ids.take(pa.array(ticket))).fill_null(False).to_numpy(zero_copy_only=False))
            row, ticket, score = row[other], ticket[other], score[other]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = np.flatnonzero(place < self.rule.k)
        row, ticket = pa.array(row[best]), pa.array(ticket[best])
        columns = [
            asking.columns[0].take(row), self.ids.take(ticket), self.ts.take(ticket), pa.array(score[best]),
            pa.array(place[best] + 1, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def _exact(self, vectors: np.ndarray) -> np.ndarray:
        return unit_matrix(self.raw[vectors].astype(np.float64))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best vectors for every row of x, as pairs with their scores.

        Scores are first taken in single precision, and only pairs that may be among the best are scored again as everywhere
        else. ``slack`` bounds the error of single precision for unit vectors, so none is missed. Where many pairs
        may be among the best, as at first, all of them are scored.
        """
        near, slack = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23 + 10.0**-SCORE_DIGITS
        least = np.full(len(x), self.rule.threshold)
        looked = None if self.meeting is None else self.meeting.looked(x)
        rule = Rule(self.rule.threshold, self.k)
        some_pairs = max(1, BLOCK_CELLS // x.shape[1])
        bound = self._bound(x)
        leaves = np.argsort(-bound.mean(axis=1), kind="stable")
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        begin, step = 0, FIRST_LEAVES
        while begin < len(leaves):
            some = leaves[begin:begin + step]
            begin, step = begin + step, min(2 * step, MOST_LEAVES)
            open_ = bound[some] >= (least - BOX_SLACK).astype(np.float32)
            floor = (least - slack).astype(np.float32)
            found, close_pairs = [], []
            for leaf, asks in zip(some[open_.any(axis=1)], open_[open_.any(axis=1)]):
                asking = np.flatnonzero(asks)
                here = slice(self.begins[leaf], self.begins[leaf] + self.sizes[leaf])
                close = near[asking] @ self.rough[here].T >= floor[asking, None]
                if np.count_nonzero(close) * 16 > close.size:
                    vectors = np.arange(here.start, here.stop)
                    vectors = vectors[np.argsort(self.age[self.first[vectors]])]
                    met = None if looked is None else _meet(looked[asking][:, None], self.buckets[vectors][None])
                    query, vector, score, _ = _all_scored(x[asking], self._exact(vectors), None, rule, met)
                    found.append((asking[query], vectors[vector], score))
                else:
                    query, vector = np.divmod(np.flatnonzero(close), close.shape[1])
                    close_pairs.append((asking[query], vector + here.start))
            if close_pairs:
                query, vector = (np.concatenate(part) for part in zip(*close_pairs))
                if looked is not None:
                    met = _meet(looked[query], self.buckets[vector])
                    query, vector = query[met], vector[met]
                score = np.zeros(len(query))
                for at in range(0, len(query), some_pairs):
                    pairs = slice(at, at + some_pairs)
                    score[pairs] = np.einsum("ij,ij->i", x[query[pairs]], self._exact(vector[pairs]))
                score = np.round(score, SCORE_DIGITS)
                good = score >= least[query]
                found.append((query[good], vector[good], score[good]))
            if any(len(query) for query, _, _ in found):
                # Only queries with something new are put in order again.
                again = np.zeros(len(x), bool)
                for query, _, _ in found:
                    again[query] = True
                again = again[kept[0]]
                others, before = [part[~again] for part in kept], [part[again] for part in kept]
                query, vector, score = (np.concatenate(part) for part in zip(before, *found))
                *best, place = _first(query, vector, score, self.age[self.first[vector]], self.k)
                last, score = best[0][place == self.k - 1], best[2][place == self.k - 1]
                least[last] = np.maximum(least[last], score)
                kept = tuple(np.concatenate(pair) for pair in zip(others, best))
        return kept

    def _bound(self, x: np.ndarray) -> np.ndarray:
        """The most that the rows of x, as columns, may score in each leaf: unit vectors d apart have the cosine 1 - d * d / 2."""
        bound = np.empty((len(self.begins), len(x)), np.float32)
        on_axes = self._on_axes(x).T.astype(np.float32)
        for begin in range(0, len(bound), BOUND_LEAVES):
            some = slice(begin, begin + BOUND_LEAVES)
            apart = np.zeros(bound[some].shape, np.float32)
            for place, middle, reach in zip(on_axes, self.middle, self.reach):
                off = place - middle[some, None]
                np.abs(off, out=off)
                off -= reach[some, None]
                np.maximum(off, 0, out=off)
                off *= off
                apart += off
            bound[some] = 1 - apart / 2
        return bound

    def _newest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The newest vectors that reach the threshold for every row of x, as pairs with their scores."""
        order = np.argsort(self.age[self.first])
        looked = None if self.meeting is None else self.meeting.looked(x)
        found, counts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], np.zeros(len(x), np.int64)
        for begin in range(0, len(order), MOST_TICKETS):
            asking = np.flatnonzero(counts < self.k)
            if len(asking) == 0:
                break
            here = order[begin:begin + MOST_TICKETS]
            scores = np.round(x[asking] @ self._exact(here).T, SCORE_DIGITS)
            good = scores >= self.rule.threshold
            if looked is not None:
                good &= _meet(looked[asking][:, None], self.buckets[here][None])
            good &= np.cumsum(good, axis=1) <= (self.k - counts[asking])[:, None]
            query, vector = np.nonzero(good)
            found.append((asking[query], here[vector], scores[query, vector]))
            counts[asking] += good.sum(axis=1)
        return tuple(np.concatenate(part) for part in zip(*found))


def _first(
    query: np.ndarray, other: np.ndarray, score: np.ndarray, age: np.ndarray, k: int, by_age: bool = False
) -> tuple[np.ndarray, ...]:
    """The first k pairs of every query, by score and then the newest, or the newest alone; and their places from 0 on."""
    order = np.lexsort((age, query) if by_age else (age, -score, query))
    query, other, score = query[order], other[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    best = place < k
    return query[best], other[best], score[best], place[best]


def _meet(looked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether any bucket of a band that is looked into is the own one; bands are the last axis but one of ``looked``."""
    found = np.zeros(np.broadcast_shapes(looked.shape[:-2], own.shape[:-1]), bool)
    for band in range(own.shape[-1]):
        for probe in range(looked.shape[-1]):
            found |= looked[..., band, probe] == own[..., band]
    return found


def score_cells(
    queries: DataFrame, tickets: DataFrame, cell: list[str], rule: Rule, schema: T.StructType
) -> DataFrame:
    """Best hits inside every cell, a cell being what shares the values of ``cell``.

    The caller deals the rows so that no cell is large.
    """

    def score(queries_here: pa.Table, tickets_here: pa.Table) -> pa.Table:
        found = top_hits(Block.of_queries(queries_here), Block.of_tickets(tickets_here), rule)
        return _to_arrow(found, schema)

    return queries.groupBy(*cell).cogroup(tickets.groupBy(*cell)).applyInArrow(score, schema)


def ranked(hits: DataFrame, rule: Rule) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(*rule.order())
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rule.k)


def hit_schema(queries: T.StructType, tickets: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries["query_id"].dataType),
        T.StructField("id", tickets["id"].dataType),
        T.StructField("ts", tickets["ts"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])


def _to_arrow(hits: pd.DataFrame, schema: T.StructType) -> pa.Table:
    # --- fixed values: Arrow types of the types in use ---
    types = {
        T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(),
    }
    fields = [pa.field(f.name, types[f.dataType]) for f in schema]
    return pa.table(
        [pa.array(hits[f.name], type=f.type, from_pandas=True) for f in fields], schema=pa.schema(fields)
    )
