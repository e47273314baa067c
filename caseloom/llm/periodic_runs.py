"""Stretches of words that repeat with a period, found by minimizers at several scales.

Inside a run of period q the words q apart are equal, so blocks of words q apart are equal as well, and the window minima
over hashes of blocks repeat at distance q. At scale W blocks have W words and windows W / 2 blocks; a run of at least four
periods, its period over W / 2 and at most W, holds two windows q apart, and as a block is as long as the period, no equal
block stands between their minima. So neighbours of equal minima at such a distance are the seeds, and comparing
words to both sides makes them whole runs. Periods up to ``DIRECT`` are too short for that and are scanned lag by lag.

Hashes only choose where to look: runs are made of comparisons of whole words. The work at a scale is linear in the
words, and its windows leave few minima, so a text of n words costs n log n whatever repeats in it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run has at least so many words, and so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Periods up to here are scanned directly; a power of two.
DIRECT = 8
#: Bytes of text that a task searches at a time, or one text if that is longer.
HELD = 2 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, text string"
)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs, text`` of every row.

    A run is a stretch of words with smallest period q, of at least ``max(6, 4 q)`` words, that no word beside it extends.
    ``runs`` holds all by start, then period; the four columns before tell the one with the most periods (of equals the
    first, then the one with the shorter period) and are null where there is none. ``text`` is the words that no run
    holds after its first q words, joined by single spaces.

    Words are cut at space and the control characters 9 to 13, of whole texts; null and empty texts have none.
    Rows are read one by one: repeated rows and null ids come back as they are. Other columns are not read. No shuffle.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids.append(doc)
                texts.append(text.split())
                held += len(text)
                if held >= HELD:
                    yield _answers(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield _answers(ids, texts)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    return rows.mapInArrow(search, _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The result with the runs and the text that is left as SHA-256."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which one in ten has its words from some place on replaced by its words of there, over and over.

    The id alone tells which documents, where and how long the loops are. Null texts and ids are left as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.expr("_h div 10"), F.size("_words")
    looped = F.array_join(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(
                F.col("_words"), F.when(i < F.col("_a"), i).otherwise(F.expr("_a") + (i - F.col("_a")) % F.col("_p"))
            ),
        ),
        " ",
    )
    return (
        docs.withColumn("_h", h)
        .withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
        .withColumn("_a", F.when(n > 0, (g % n).cast("int")))
        .withColumn("_p", F.expr("cast(1 + (size(_words) - _a) div (3 + (_h div 10) % 8) as int)"))
        .withColumn(text_col, F.when(n > 0, looped).otherwise(F.col(text_col)))
        .drop("_h", "_words", "_a", "_p")
    )


def _answers(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    rows = []
    for doc, words, runs in zip(ids, texts, runs_of(texts)):
        kept = words
        if runs:
            left = np.ones(len(words), bool)
            for run in runs:
                left[run.start + run.period:run.start + run.length] = False
            kept = [words[i] for i in np.flatnonzero(left).tolist()]
        best = None
        for run in runs:
            # Exact: length / period compared crosswise. Runs come by start, then period, so the first of equals stays.
            if best is None or run.length * best.period > best.length * run.period:
                best = run
        milli = 1000 * best.length // best.period if best else None
        rows.append((doc, len(runs), *(best or (None, None, None)), milli, runs, b" ".join(kept)))
    columns = list(zip(*rows))
    numbers = [pa.array(c, pa.int64()) for c in columns[:6]]
    offsets = np.cumsum([0, *map(len, columns[6])], dtype=np.int32)
    flat = [run for runs in columns[6] for run in runs]
    fields = [pa.array([run[i] for run in flat], pa.int64()) for i in range(3)]
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays(
        [*numbers, runs, pa.array(columns[7], pa.binary()).cast(pa.string())],
        names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"],
    )


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, by start, then period.

    The texts are searched as one sequence, longest first, each closed by a word of its own: no run goes on beyond it, and
    a scale reads only the front part that holds texts long enough for it.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    sequence: list[int] = []
    starts = []
    for place, i in enumerate(order):
        starts.append(len(sequence))
        sequence += [numbers.setdefault(word, len(numbers)) for word in texts[i]]
        sequence.append(-1 - place)
    words = np.array(sequence, np.int64)
    begins = np.array(starts, np.int64)
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    found: dict[tuple[int, int], Run] = {}

    def front(period: int) -> int:
        """How much of the sequence holds texts with room for runs of a period."""
        texts_there = int(np.searchsorted(-lengths, -max(MIN_WORDS, MIN_PERIODS * period), side="right"))
        return int(begins[texts_there - 1] + lengths[texts_there - 1] + 1) if texts_there else 0

    for period in range(1, DIRECT + 1):
        for start, length in _stretches(words[:front(period)], period):
            # A stretch that a divisor of the period made already has that smaller period.
            found.setdefault((start, length), Run(start, length, period))
    scale = 2 * DIRECT
    hashes = words.astype(np.uint64) * _MIX
    hashes ^= hashes >> np.uint64(29)
    width = 1
    while size := front(scale // 2 + 1):
        hashes = hashes[:size]
        while width < scale:
            hashes = (hashes[:-width] * _MIX ^ (hashes[:-width] >> np.uint64(31))) + hashes[width:] if len(hashes) > width else hashes[:0]
            width *= 2
        for start, length, period in _seeded(words[:size], hashes, scale):
            if length >= max(MIN_WORDS, MIN_PERIODS * period):
                found.setdefault((start, length), Run(start, length, period))
        scale *= 2
    by_text: list[list[Run]] = [[] for _ in texts]
    if found:
        runs = sorted(found.values(), key=lambda r: (r.start, r.period))
        at = np.searchsorted(begins, [r.start for r in runs], side="right") - 1
        for run, place in zip(runs, at.tolist()):
            by_text[order[place]].append(Run(run.start - starts[place], run.length, run.period))
    return by_text


def _stretches(words: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """Start and length of the longest stretches with a period ``lag`` that are long enough for a run."""
    if len(words) <= lag:
        return []
    same = np.flatnonzero(words[lag:] == words[:-lag])
    if len(same) == 0:
        return []
    cuts = np.flatnonzero(np.diff(same) > 1)
    first = np.append(0, cuts + 1)
    last = np.append(cuts, len(same) - 1)
    lengths = last - first + 1 + lag
    good = lengths >= max(MIN_WORDS, MIN_PERIODS * lag)
    return list(zip(same[first[good]].tolist(), lengths[good].tolist()))


def _seeded(words: np.ndarray, hashes: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and period of the longest stretches around seeds of a scale, each once per period."""
    minima = _minimizers(hashes, scale // 2)
    if len(minima) < 2:
        return
    minima = minima[np.lexsort((minima, hashes[minima]))]
    gaps = np.diff(minima)
    seeds = (hashes[minima[1:]] == hashes[minima[:-1]]) & (gaps > scale // 2) & (gaps <= scale)
    places, gaps = minima[:-1][seeds], gaps[seeds]
    order = np.lexsort((places, gaps))
    period, until = 0, -1
    for place, gap in zip(places[order].tolist(), gaps[order].tolist()):
        if gap == period and place < until:
            continue
        after = _equal(words, place, gap, 1)
        if after == 0:
            continue
        before = _equal(words, place - 1, gap, -1)
        period, until = gap, place + after
        yield place - before, before + after + gap, gap


def _equal(words: np.ndarray, place: int, gap: int, step: int) -> int:
    """How many words from ``place`` on, to the right or left, are equal to those ``gap`` behind them."""
    count, size = 0, 64
    while True:
        if step > 0:
            here = words[place + count:place + count + size]
            there = words[place + count + gap:place + count + gap + size]
            here = here[:len(there)]
        else:
            end = place - count + 1
            begin = max(0, end - size)
            here, there = words[begin:end][::-1], words[begin + gap:end + gap][::-1]
        same = here == there
        if len(same) == 0:
            return count
        if not same.all():
            return count + int(same.argmin())
        count += len(same)
        size *= 2


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of every ``width`` hashes in a row, of equals the first; each place once."""
    windows = len(hashes) - width + 1
    if windows < 1:
        return np.empty(0, np.int64)
    # The place in the low bits settles equal hashes and tells where the smallest one is.
    bits = np.uint64(len(hashes).bit_length())
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    filled = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    filled[:len(keys)] = keys
    blocks = filled.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(since[:windows], upto[width - 1:width - 1 + windows])
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return places[np.append(True, places[1:] != places[:-1])]
