"""Quality rules on whole texts: counts of words, symbols and repeats, and how far a text's histograms lie from its language.

A document's histogram of character classes and of its language's common words is compared with the
histogram of all documents of that language by Jensen-Shannon distance (base 2, 0 to 1). Texts too short for a
histogram to mean anything are not judged by it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import TEXTS_AT_ONCE, WHITE, for_python, stored

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
#: Classes of characters, in the order of the histogram.
CLASSES = ("lower", "upper", "letter", "digit", "white", "punctuation", "other")
LETTERS = re.compile(r"[^\W\d_]+")

#: A document fails the base rules below so many words, or above this share of words in repeated windows.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
#: Common words are the most frequent among words of up to so many letters.
COMMON_WORDS = 48
COMMON_LETTERS = 5
#: Languages with a reference: the largest, with so many letter words at least. Texts of others get no verdict by distance,
#: as another language's histogram says nothing of them.
MAX_LANGUAGES = 4096
MIN_REFERENCE_WORDS = 2000
#: A reference is learned from documents of at least ``MIN_WORDS`` words, with at most so many percent of symbols among
#: their characters and of capitals among their cased letters, so that shouting and markup do not define a language.
MAX_SYMBOL_PERCENT = 1
MAX_UPPER_PERCENT = 30
#: Guards: a histogram judges texts with so many characters or letter words.
MIN_CHARS = 400
MIN_LETTER_WORDS = 80
#: Largest distances that pass.
MAX_CHAR_DISTANCE = 0.19
MAX_WORD_DISTANCE = 0.45
FLUSH = 200_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    by_category = {"Ll": 0, "Lu": 1, "Lt": 2, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Me": 2}
    for point in range(0x110000):
        place = by_category.get(unicodedata.category(chr(point)))
        if place is not None:
            table[point] = place
    for chars, name in (("0123456789", "digit"), (WHITE, "white"), (PUNCTUATION, "punctuation")):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    return table


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[points], minlength=len(CLASSES))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # Hashes are compared within one text only, so those of this process serve.
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(31)))
    found = np.sort(keys)
    twice = found[1:][found[1:] == found[:-1]]
    if not len(twice):
        return 0
    at = np.isin(keys, twice)
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + n] |= at
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six white characters
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's histogram to the reference; rows without counts give 0."""
    totals = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(totals, 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(totals[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


@dataclass
class Reference:
    """Counts per character class, the common words, and counts per common word and of all other letter words."""

    classes: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(1))




def _defines(classes: np.ndarray, symbols: int) -> bool:
    lower, upper = int(classes[0]), int(classes[1])
    return 100 * symbols <= MAX_SYMBOL_PERCENT * int(classes.sum()) and 100 * upper <= MAX_UPPER_PERCENT * (lower + upper)


def _few_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``TEXTS_AT_ONCE`` at a time; empty batches go."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(start, TEXTS_AT_ONCE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, kind, item, n)``: how often each class and short word stands in the batches, and letter words in all."""
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
    words: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(lang, "class", CLASSES[i], int(n)) for lang, found in classes.items() for i, n in enumerate(found)]
        rows += [(lang, "word", word, n) for lang, found in words.items() for word, n in found.items()]
        classes.clear()
        words.clear()
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))],
            names=["lang", "kind", "item", "n"],
        )

    for batch in _few_texts(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if not text or len(text.encode("utf-8", "surrogatepass").split()) < MIN_WORDS:
                continue
            counts = class_counts(text)
            if not _defines(counts, sum(map(text.count, SYMBOLS))):
                continue
            lang = lang or ""
            classes[lang] += counts
            found = LETTERS.findall(text.lower())
            words[lang].update(w for w in found if len(w) <= COMMON_LETTERS)
            words[lang][""] += len(found)  # no word is empty: this one counts them all
        if sum(map(len, words.values())) > FLUSH:
            yield flush()
    yield flush()


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> dict[str, Reference]:
    """The reference of each language, from all its documents that may define a language.

    What reaches the driver is bounded: ``MAX_LANGUAGES``, each with the classes and the common words.
    Ties among words are settled by the word, among languages by the name.
    """
    each = stored(
        for_python(docs).select(F.col("lang").cast("string"), "text")
        .mapInArrow(_count, "lang string, kind string, item string, n long")
        .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")),
        "counts",
    )
    total = F.col("kind").eqNullSafe("word") & (F.col("item") == "")
    large = (
        each.where(total & (F.col("lang") != "") & (F.col("n") >= MIN_REFERENCE_WORDS))
        .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).select("lang")
    )
    counted = each.join(F.broadcast(large), "lang")
    # The best of each part first, so that no task holds all words of a language.
    words = counted.where((F.col("kind") == "word") & (F.col("item") != ""))
    order = [F.desc("n"), F.col("item")]
    part = F.pmod(F.xxhash64("item"), F.lit(64))
    best = words.withColumn("_part", part).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    ).where(F.col("_rank") <= common_words)
    best = best.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("_rank") <= common_words
    )
    rest = counted.where((F.col("kind") == "class") | (F.col("item") == ""))
    found: dict[str, Reference] = {}
    totals: dict[str, int] = {}
    for row in rest.collect():
        reference = found.setdefault(row["lang"], Reference(np.zeros(len(CLASSES))))
        if row["kind"] == "class":
            reference.classes[CLASSES.index(row["item"])] = row["n"]
        else:
            totals[row["lang"]] = row["n"]
    listed = defaultdict(list)
    for row in best.select("lang", "item", "n", "_rank").collect():
        listed[row["lang"]].append((row["_rank"], row["item"], row["n"]))
    for lang, reference in found.items():
        common = sorted(listed[lang])
        reference.words = {word: i for i, (_, word, _) in enumerate(common)}
        counts = [n for _, _, n in common]
        reference.counts = np.array([*counts, totals.get(lang, 0) - sum(counts)], float)
    return found


COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of ``COLUMNS`` for every row.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows. ``kept``: not failed,
    and no histogram that may judge the text lies too far from its language's. Distances are null where the text is
    too short for them, and for rows of a null language or one too rare to have a reference: there the base rules decide
    alone. Null texts have no words, so they fail. Repeated rows are judged each; an empty table gives an empty result. Other
    columns are not read.
    """
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
    )
    known = references(read)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_texts(batches):
            yield _judged(batch, known)

    return for_python(read).mapInArrow(judge, COLUMNS)


def _judged(batch: pa.RecordBatch, known: dict[str, Reference]) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    langs = batch.column("lang").to_pylist()
    base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
    char_distance, word_distance = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
    by_reference: dict[str, list[int]] = defaultdict(list)
    for i, lang in enumerate(langs):
        if lang in known:
            by_reference[lang].append(i)
    for lang, rows in by_reference.items():
        reference = known[lang]
        classes = np.array([class_counts(texts[i]) for i in rows])
        words = np.zeros((len(rows), len(reference.counts)))
        place = reference.words.get
        other = len(reference.counts) - 1
        for k, i in enumerate(rows):
            found = Counter(LETTERS.findall(texts[i].lower()))
            for word, n in found.items():
                words[k, place(word, other)] += n
        enough = classes.sum(axis=1) >= MIN_CHARS
        char_distance[rows] = np.where(enough, distances(classes, reference.classes), np.nan)
        enough = words.sum(axis=1) >= MIN_LETTER_WORDS
        word_distance[rows] = np.where(enough, distances(words, reference.counts), np.nan)
    failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED_PERCENT * base[:, 0])
    char_distance, word_distance = np.round(char_distance, 6), np.round(word_distance, 6)
    with np.errstate(invalid="ignore"):
        far = (char_distance > MAX_CHAR_DISTANCE) | (word_distance > MAX_WORD_DISTANCE)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            *(pa.array(base[:, i]) for i in range(5)),
            pa.array(failed),
            pa.array(~failed & ~far),
            pa.array(char_distance, from_pandas=True),
            pa.array(word_distance, from_pandas=True),
        ],
        names=[c.split()[0] for c in COLUMNS.split(", ")],
    )
