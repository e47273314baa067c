"""Text expressions: clean-up, tokens, n-grams, previews. All return Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns ---
# White space as Python's str.strip/str.split understand it.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: The same one by one: what is stripped is sought at both ends only, not in the whole text.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Bytes of texts whose letters are counted at a time.
COUNTED_BYTES = 1 << 18


def default_stop_words() -> list[str]:
    """Spark's own English list; any other list can be passed wherever stop words are used."""
    return StopWordsRemover.loadDefaultStopWords("english")


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def non_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def or_default(text: Column, default: str) -> Column:
    """The value, or the default where it is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def without(items: Column, dropped: Sequence[str]) -> Column:
    if not dropped:
        return items
    return F.filter(items, lambda w: ~w.isin(*dropped))


def letter_counts(text: Column, letters: str) -> Column:
    """How often each of some ASCII letters occurs, as floats; null for null. All are counted in one pass over the bytes."""
    places = np.zeros(256, np.int64)
    places[np.frombuffer(letters.encode("ascii"), np.uint8)] = np.arange(1, len(letters) + 1)
    step, width = COUNTED_BYTES, len(letters) + 1

    def count(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        counts = np.zeros((len(texts), width), np.int64)
        for begin in range(int(ends[0]), int(ends[-1]), step):
            end = min(begin + step, int(ends[-1]))
            first, last = np.searchsorted(ends, begin, side="right") - 1, np.searchsorted(ends, end)
            rows = np.repeat(np.arange(last - first), np.diff(np.clip(ends[first:last + 1], begin, end)))
            found = np.bincount(rows * width + places[data[begin:end]], minlength=(last - first) * width)
            counts[first:last] += found.reshape(-1, width)
        offsets = pa.array(np.arange(len(texts) + 1) * len(letters), pa.int32())
        values = pa.array(counts[:, 1:].ravel().astype(np.float32))
        return pa.ListArray.from_arrays(offsets, values, mask=texts.is_null())

    return F.arrow_udf(count, "array<float>")(text)


def combined_text(with_owner: bool = False) -> Column:
    """Summary, comments, task type and status in one text; the batch form adds the owner."""
    parts = [
        filled(F.col("summary")), F.lit(" "),
        filled(F.col("latest_comments")), F.lit(" Task Type: "),
        filled(F.col("task_type")), F.lit(" Status: "),
        filled(F.col("status")), F.lit(" "),
    ]
    if with_owner:
        parts += [F.lit("Owner: "), filled(F.col("ticket_owner"))]
    return strip(F.concat(*parts))


def clean_text(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower case, ASCII letters and digits only, no stop words, single spaces."""
    kept = F.regexp_replace(F.lower(filled(text)), f"[^a-z0-9{SPACE}]", "")
    return F.array_join(without(words(kept), stop_words), " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(filled(text)), F.lit(TOKEN), F.lit(0))


def one_two_grams(items: Column) -> Column:
    """The items followed by the pairs of neighbours.

    ``items`` is read several times: pass a materialised column, not an expression.
    """
    pairs = F.greatest(F.size(items) - 1, F.lit(0))
    return F.concat(
        items,
        F.zip_with(
            F.slice(items, 1, pairs), F.slice(items, 2, pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )


def with_terms(
    docs: DataFrame, text: str, stop_words: Sequence[str], out: str = "terms"
) -> DataFrame:
    """Add the 1- and 2-gram terms of a text column; row-local, no shuffle."""
    return (
        docs.withColumn("_tokens", without(tokens(F.col(text)), stop_words))
        .withColumn(out, one_two_grams(F.col("_tokens")))
        .drop("_tokens")
    )


def query_text(summary: Column, description: Column) -> Column:
    """The search text of a ticket: its summary, and its description if that says anything."""
    return F.concat_ws(" ", summary, F.when(non_blank(description), description))


def preview(text: Column, chars: int = 100) -> Column:
    cut = F.substring(text, 1, chars)
    return F.when(F.length(text) > chars, F.concat(cut, F.lit("..."))).otherwise(text)


def fixed(number: Column, digits: int) -> Column:
    """A number as text with a fixed number of decimals, halves to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", number, F.lit(pattern))


def percent(score: Column) -> Column:
    return F.concat(fixed(score * 100, 1), F.lit("%"))


def resolution(comments: Column, default: str) -> Column:
    return F.when(non_blank(comments), comments).otherwise(default)


def reflow_numbered(text: Column, upto: int = 6) -> Column:
    """Start a new line before each of ``1.`` to ``6.``, wherever it occurs."""
    return reduce(
        lambda t, i: F.replace(t, F.lit(f"{i}."), F.lit(f"\n{i}.")), range(1, upto + 1), text
    )
