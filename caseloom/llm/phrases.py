"""Phrase collocations per language, counted on a prefix-free parse of the texts.

Texts become sequences of words and breaks. A window of words whose hash says so ends a chunk, and the next chunk begins
with that window: where chunks end depends on the words alone, so passages that repeat give the same chunks wherever
they stand. Equal chunks are one entry of a dictionary with the number of times they were parsed. N-grams are counted
inside the entries, each weighted by that number; an n-gram belongs to the chunk that holds its last word behind the
shared window, so those in an overlap count once.

Longer n-grams are counted after the shorter ones, and only where both n-grams one word shorter are frequent. These are
known to the tasks by a bit table of fixed size: a false positive costs a row and changes no count.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_WORDS = 3
MIN_COUNT = 10
#: Percent of a phrase's occurrences that lie in one longer candidate if the phrase is left out.
COVER = 50
TOP = 2000
#: Mean number of words between the ends of chunks.
PERIOD = 16
#: Parts of a language whose first phrases are found before the first of all.
TOP_PARTS = 16
#: Bytes of text or chunks that a task holds at a time.
HELD = 8 << 20
#: Bits of the table of frequent n-grams, a power of two.
TABLE_BITS = 1 << 26
#: The break between pieces; no word holds it.
BREAK = b"."
#: A-Z to a-z, every character that ends a piece to the break, tab to space.
FOLD = bytes(
    ord(BREAK) if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256)
)
_MIX = 0x9E3779B97F4A7C15

_CHUNKS = "lang string, head boolean, chunk binary, n long"
_GRAMS = "lang string, phrase binary, n long"


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    cover: int = COVER,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to ``max_words`` words found ``min_count`` times or more (``a``), overlapping
    occurrences included. The cut into two parts with the lowest ``floor(1000000 a a / (l r))`` gives ``l``, ``r`` and
    ``score``; of equals the one with the fewest words in front. Candidates that lie in a longer one with at
    least ``cover`` percent of their occurrences are left out. ``n`` counts all words of the language.

    Null texts are empty, a null language is ``und``. Repeated rows count each time. Equal scores come by ``a``, then by
    phrase in byte order. A language without candidates has no row. Other columns are not read. Jobs run while the
    table is being made: one for the dictionary, then one or two for each number of words.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have at least two words and occur at least once")
    entries = stored(dictionary(docs, max_words, lang_col, text_col), "chunks")
    levels: list[DataFrame] = []
    tables: list[np.ndarray] = []
    for size in range(1, max_words + 1):
        counts = stored(_counted(entries, size, max_words, tables, min_count), "grams")
        levels.append(counts.where(F.col("n") >= min_count).where(F.length("phrase") > 0))
        if size == 1:
            words = counts.where(F.length("phrase") == 0).select("lang", F.col("n"))
        if size < max_words:
            tables.append(_bit_table(levels[-1]))
    texts = [x.select("lang", F.col("phrase").cast("string").alias("phrase"), "n") for x in levels]
    known = texts[0]
    for level in texts[1:]:
        known = known.unionByName(level)
    candidates = texts[1]
    for level in texts[2:]:
        candidates = candidates.unionByName(level)
    candidates = candidates.select("lang", "phrase", F.col("n").alias("a"))
    scored = _scored(_uncovered(candidates, cover), known)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = Window.partitionBy("lang").orderBy(*order)
    # The first of each part before the first of all: no task reads more than the first of so many parts.
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    firsts = (
        scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
        .withColumn("_at", F.row_number().over(part))
        .where(F.col("_at") <= top)
    )
    return (
        firsts.withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top)
        .join(words, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def dictionary(
    docs: DataFrame, max_words: int = MAX_WORDS, lang_col: str = "lang", text_col: str = "text", period: int = PERIOD
) -> DataFrame:
    """``lang, head, chunk, n``: the distinct chunks and how often each was parsed.

    A chunk is its words and breaks joined by spaces; ``head`` is true for the first of a text, which shares no window with
    a chunk before.
    """
    shared = max_words - 1

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py().translate(FOLD).replace(BREAK, b" . ")
                langs.append(lang)
                texts.append(text)
                held += len(text)
                if held >= HELD:
                    yield _parsed(langs, texts, shared, period)
                    langs, texts, held = [], [], 0
        yield _parsed(langs, texts, shared, period)

    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    return texts.mapInArrow(parse, _CHUNKS).groupBy("lang", "head", "chunk").agg(F.sum("n").alias("n"))


def _parsed(langs: list[str], texts: list[bytes], shared: int, period: int) -> pa.RecordBatch:
    """The chunks of folded texts. They end behind each window of words whose hash says so, and with the text."""
    split = pc.split_pattern(pa.array(texts, pa.binary()), b" ")
    coded = split.flatten().dictionary_encode()
    names, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    known = names.to_pylist()
    full = (np.array(known, object) != b"")[word]
    word = word[full]
    text = np.repeat(np.arange(len(texts)), np.asarray(split.value_lengths(), np.int64))[full]
    place = np.arange(len(word)) - np.searchsorted(text, text)
    each = np.fromiter(map(crc32, known), np.uint64, len(known))[word]
    window = max(1, shared)
    rolled = np.zeros(len(word), np.uint64)
    for back in range(window - 1, -1, -1):
        rolled = rolled * np.uint64(_MIX) + np.append(np.zeros(back, np.uint64), each[:len(each) - back])
    rolled = (rolled * np.uint64(_MIX)) >> np.uint64(32)
    last = np.append(text[1:] != text[:-1], np.ones(min(1, len(text)), bool))
    end = np.flatnonzero(last | ((rolled % np.uint64(period) == 0) & (place >= window - 1)))
    head = np.append(np.ones(min(1, len(end)), bool), text[end[1:]] != text[end[:-1]])
    begin = np.where(head, end - place[end], np.append(0, end[:-1])[:len(end)] + 1 - shared)
    lengths = end + 1 - begin
    offsets = np.append(0, np.cumsum(lengths))
    inside = np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])
    words = names.take(pa.array(word[inside]))
    chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), b" ")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()).take(pa.array(text[end])), pa.array(head), chunks,
            pa.array(np.ones(len(end), np.int64)),
        ],
        names=["lang", "head", "chunk", "n"],
    )


def _counted(
    entries: DataFrame, size: int, max_words: int, tables: list[np.ndarray], min_count: int
) -> DataFrame:
    """``lang, phrase, n`` of the n-grams of one size that are frequent; for single words, also the total as the empty
    phrase."""
    held = entries.sparkSession.sparkContext.broadcast(tables)
    shared = max_words - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        for batch in batches:
            block.append(batch)
            if sum(b.nbytes for b in block) >= HELD:
                yield from _block_counts(pa.Table.from_batches(block), size, shared, held.value)
                block = []
        if block:
            yield from _block_counts(pa.Table.from_batches(block), size, shared, held.value)

    grams = entries.mapInArrow(count, _GRAMS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return grams.where((F.col("n") >= min_count) | (F.length("phrase") == 0))


def _block_counts(block: pa.Table, size: int, shared: int, tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Weighted counts of the n-grams in chunks of each language, each distinct one once."""
    for lang in pc.unique(block["lang"]).to_pylist():
        rows = block.filter(pc.equal(block["lang"], lang)).combine_chunks()
        split = pc.split_pattern(rows["chunk"].chunk(0), b" ")
        lengths = np.asarray(split.value_lengths(), np.int64)
        coded = split.flatten().dictionary_encode()
        names, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(word)) - np.repeat(starts, lengths)
        weight = np.repeat(rows["n"].to_numpy(), lengths)
        known = names.to_pylist()
        hashes = np.fromiter(map(crc32, known), np.int64, len(known))[word]
        # rank: the number of the n-gram that ends here, where there is one that may be frequent.
        rank, there = word, (np.array(known, object) != BREAK)[word]
        rolled = np.full(len(word), _first(lang))
        for k in range(1, size):
            rolled = _rolled(rolled, hashes)
            there = there & _held(rolled, tables[k - 1])
            # On to the n-grams one word longer, of which both parts are there.
            there = np.append(False, there[:-1]) & there & (place >= k)
            rolled = np.append(0, rolled[:-1])
            before = np.append(0, rank[:-1])
            at = np.flatnonzero(there)
            rank = np.zeros(len(word), np.int64)
            rank[at] = before[at] * len(known) + word[at]
            if k + 1 < size:
                rank[at] = np.unique(rank[at], return_inverse=True)[1]
        heads = rows["head"].to_numpy()
        at = np.flatnonzero(there & (place >= np.repeat(np.where(heads, 0, shared), lengths)))
        if len(at) == 0:
            continue
        at = at[np.argsort(rank[at])]
        first = np.flatnonzero(np.append(True, rank[at[1:]] != rank[at[:-1]]))
        total = np.add.reduceat(weight[at], first)
        last = at[first]
        phrases = pc.binary_join_element_wise(*(names.take(pa.array(word[last - k])) for k in range(size - 1, -1, -1)), b" ")
        yield _gram_batch(lang, phrases, total)
        if size == 1:
            yield _gram_batch(lang, pa.array([b""], pa.binary()), total.sum(keepdims=True))


def _gram_batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), pa.array([lang])).dictionary_decode()
    return pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts)], names=["lang", "phrase", "n"])


# --- one hash of n-grams, here and as a column: that of the n-gram without its last word times _STEP, and the word's ---
_STEP, _MODULUS = 1_000_003, 1 << 40


def _first(lang: str) -> int:
    return crc32(lang.encode())


def _rolled(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (before * _STEP + word) % _MODULUS


def _held(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which n-grams the bit table holds, by their hashes."""
    at = hashes % TABLE_BITS
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def _bit_table(grams: DataFrame) -> np.ndarray:
    """The bit table of the n-grams of one size: made in Spark, at most ``TABLE_BITS / 64`` rows come back."""
    words = F.split(F.col("phrase").cast("string"), " ", -1)
    rolled = F.aggregate(
        words, F.crc32(F.col("lang").cast("binary")),
        lambda h, w: (h * _STEP + F.crc32(w.cast("binary"))) % F.lit(_MODULUS),
    )
    at = rolled % F.lit(TABLE_BITS)
    rows = (
        grams.select(at.alias("at"))
        .select(
            F.expr("at div 64").alias("word"),
            F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"),
        )
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(TABLE_BITS // 64, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table


def _parts(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def _uncovered(candidates: DataFrame, cover: int) -> DataFrame:
    """Candidates that no longer candidate holds with ``cover`` percent of their occurrences."""
    longer = candidates.select("lang", "a", F.split("phrase", " ", -1).alias("words")).where(F.size("words") > 2)
    inside = (
        longer.withColumn("k", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)))
        .select("lang", _parts(F.col("i"), F.col("k")).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    )
    return (
        candidates.join(inside, ["lang", "phrase"], "left")
        .where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * cover))
        .drop("longest")
    )


def _scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each candidate. Both parts of a candidate are known, as they are as frequent."""
    size = F.size("words")
    cuts = (
        candidates.withColumn("words", F.split("phrase", " ", -1))
        .withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        .select(
            "lang", "phrase", "a", "k",
            F.explode(F.array(
                F.struct(F.lit(True).alias("front"), _parts(F.lit(1), F.col("k")).alias("part")),
                F.struct(F.lit(False).alias("front"), _parts(F.col("k") + 1, size - F.col("k")).alias("part")),
            )).alias("x"),
        )
        .select("lang", "phrase", "a", "k", "x.*")
    )
    counts = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    both = (
        cuts.join(counts, ["lang", "part"])
        .groupBy("lang", "phrase", "a", "k")
        .agg(F.max(F.when(F.col("front"), F.col("f"))).alias("l"), F.max(F.when(~F.col("front"), F.col("f"))).alias("r"))
        .withColumn(
            "score",
            F.expr("(cast(a as decimal(16)) * cast(a as decimal(16)) * 1000000) div (cast(l as decimal(18)) * r)"),
        )
    )
    return (
        both.groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
        .select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    )
