"""Benchmark passages in documents, found by fingerprints of item-sized windows.

An item of n words is compared with windows of n words by the multisets of their five-word shingles. Items and
windows have 64-bit SimHash fingerprints, each shingle weighing as often as it stands there. Fingerprints are cut
into blocks: two that differ in at most ``RADIUS`` bits differ in at most ``FLIPS`` bits of some block. Items are
listed under all values within that many flips of each block, so an equality join of blocks finds every pair
within the radius. Pairs found are verified by the exact similarity of the multisets.

Windows are laid where they can matter: a window that begins with a shingle of no item can be moved on by one word
without its similarity to any item falling, so only windows beginning with a shingle of an item are fingerprinted.
Windows cut off by the end of the text count as shorter ones.

Items over ``PIECE_WORDS`` words are compared whole too, without fingerprints: each occurrence of an item's shingle
counts for a range of window starts, so sums over the ends of these ranges give the shared part of every window. Such
an item also counts as held where a document has one of its passages of ``PIECE_WORDS`` words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import stored

SHINGLE = 5
#: Similarity that counts: shared parts of the whole, as a fraction.
SHARED, OF = 8, 10
#: Longer items are compared whole and in pieces of so many words; the shingle counts of a piece fit in ``PLANES`` bits.
PIECE_WORDS = 128
PLANES = 7
#: Five blocks of at most 13 bits; 19 different bits leave at most 3 in one of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 19
FLIPS = 3
#: Pieces (for whole long items: their shingles, in pieces) whose tables may go to every task; beyond, they are joined by shuffles.
BROADCAST_PIECES = 1000
#: So many documents' places or ids may go to every task; beyond, texts are joined by shuffles.
BROADCAST_DOCUMENTS = 20_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case. Null texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def once(value: Column) -> Column:
    """The value, worked out once per row: the optimizer copies no expression that holds a row number.

    It would copy an array into filters and into functions of its elements, and so work it out for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def shingles_of(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order, from the hashes of the words."""
    last = F.size(hashes) - size
    run = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
    )
    return F.when(last >= 0, run).otherwise(F.array().cast("array<bigint>"))


def _ones(bit: Column) -> Column:
    """All bits set if the bit is."""
    return F.negative(bit.cast("long"))


def simhash(frame: DataFrame, shingles: str, out: str) -> DataFrame:
    """Adds the 64-bit SimHash of an array of hashes: a bit is set if more than half of the hashes have it.

    The 64 counters are kept side by side as ``PLANES`` numbers, one for each binary digit of all counters.
    """
    planes = [f"p{i}" for i in range(PLANES)]

    def add(counted: Column, value: Column) -> Column:
        carry, found = value, []
        for plane in planes:
            found.append(counted[plane].bitwiseXOR(carry).alias(plane))
            carry = counted[plane].bitwiseAND(carry)
        return F.struct(*found)

    start = F.struct(*[F.lit(0).cast("long").alias(p) for p in planes])
    frame = frame.withColumn("_planes", F.aggregate(shingles, start, add))
    half = F.floor(F.size(shingles) / 2).cast("int")
    more, same = F.lit(0).cast("long"), F.lit(-1).cast("long")
    for i in reversed(range(PLANES)):
        plane, limit = F.col(f"_planes.p{i}"), _ones(F.shiftright(half, i).bitwiseAND(F.lit(1)))
        more = more.bitwiseOR(same.bitwiseAND(plane).bitwiseAND(F.bitwise_not(limit)))
        same = same.bitwiseAND(F.bitwise_not(plane.bitwiseXOR(limit)))
    return frame.withColumn(out, more).drop("_planes")


def _block(value: Column, k: int) -> Column:
    start, width = BLOCKS[k]
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _flips(width: int) -> list[int]:
    return [x for x in range(1 << width) if x.bit_count() <= FLIPS]


def _hashed(items: DataFrame) -> DataFrame:
    """``(item_id, h)``: the hashes of the words of items with an id."""
    return items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h")
    )


def _pieces(items: DataFrame) -> DataFrame:
    """``(piece, item_id, at, size, shingles, n, print)``: items, long ones in pieces; ``size`` words make a shingle.

    All pieces of a long item have ``PIECE_WORDS`` words: the last one ends with the item and overlaps the one before.
    """
    hashes = _hashed(items)
    last = F.greatest(F.size("h") - PIECE_WORDS, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS)), F.array(last)))
    cut = hashes.where(F.size("h") > 0).select(
        "item_id", F.inline(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("h", i + 1, PIECE_WORDS).alias("h"))))
    )
    each = [
        cut.where((F.size("h") >= size) if size == SHINGLE else (F.size("h") == size))
        .select("item_id", "at", F.lit(size).alias("size"), shingles_of(F.col("h"), size).alias("shingles"))
        for size in range(1, SHINGLE + 1)
    ]
    found = reduce(DataFrame.unionByName, each).dropDuplicates().withColumn("n", F.size("shingles"))
    # A text under an id twice is the same piece; other texts under that id are pieces of their own.
    return simhash(found, "shingles", "print").withColumn("piece", F.xxhash64("item_id", "at", "shingles"))


def _common(left: Column, right: Column) -> Column:
    """How many elements two arrays share, each as often as it stands in both."""
    def times(x: Column, array: Column) -> Column:
        return F.size(F.filter(array, lambda y: y == x))

    plain = (F.size(F.array_distinct(left)) == F.size(left)) & (F.size(F.array_distinct(right)) == F.size(right))
    counted = F.aggregate(
        F.array_intersect(left, right), F.lit(0), lambda total, x: total + F.least(times(x, left), times(x, right))
    )
    return F.when(plain, F.size(F.array_intersect(left, right))).otherwise(counted)


def _windows(hashed: DataFrame, pieces: DataFrame, size: int, small: bool) -> DataFrame:
    """``(doc_id, _key, at, n, window, print)``: windows as long as some piece, that begin with one of its shingles.

    First the places where they begin, from narrow rows; then only the texts that have such places are read again.
    """
    pieces = pieces.where(F.col("size") == size)
    begins = pieces.select(F.explode("shingles").alias("first"), "n").distinct()
    shingled = hashed.select("doc_id", "_key", once(shingles_of(F.col("h"), size)).alias("s"))
    places = stored(
        shingled.select("doc_id", "_key", F.posexplode("s").alias("at", "first"))
        .join(F.broadcast(begins) if small else begins, "first")
        .groupBy("doc_id", "_key").agg(F.collect_set(F.struct("at", "n")).alias("places")),
        "places",
    )
    few = places.count() <= BROADCAST_DOCUMENTS
    laid = shingled.join(
        F.broadcast(places) if few else places.hint("shuffle_hash"),
        shingled["doc_id"].eqNullSafe(places["doc_id"]) & (shingled["_key"] == places["_key"]),
    ).select(
        shingled["doc_id"], shingled["_key"],
        F.inline(F.transform(
            "places", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), F.slice("s", p["at"] + 1, p["n"]).alias("window"))
        )),
    )
    windows = laid.where(F.size("window") * OF >= F.col("n") * SHARED)
    return simhash(windows, "window", "print").withColumn("size", F.lit(size))


def _whole(hashed: DataFrame, items: DataFrame) -> DataFrame | None:
    """``(doc_id, _key, item_id, hit)`` of items over ``PIECE_WORDS`` words, compared whole; None without such items.

    An occurrence at ``p`` of a shingle that the item holds ``m`` times counts in the windows that begin after the
    ``m``-th occurrence before ``p`` and hold ``p``. As above, only windows beginning with a shingle of the item matter.
    """
    texts = _hashed(items).where(F.size("h") > PIECE_WORDS).select("item_id", shingles_of(F.col("h"), SHINGLE).alias("shingles"))
    held = stored(
        texts.dropDuplicates().withColumns({"piece": F.xxhash64("item_id", "shingles"), "n": F.size("shingles")})
        .select("piece", "item_id", "n", F.explode("shingles").alias("x"))
        .groupBy("piece", "item_id", "n", "x").agg(F.count(F.lit(1)).cast("int").alias("m")),
        "long_items",
    )
    rows = held.count()
    if not rows:
        return None
    shingled = hashed.select("doc_id", "_key", once(shingles_of(F.col("h"), SHINGLE)).alias("s"))
    pair = ["doc_id", "_key", "piece", "item_id", "n", "total"]
    events = (
        shingled.select("doc_id", "_key", F.size("s").alias("total"), F.posexplode("s").alias("at", "x"))
        .join(F.broadcast(held) if rows <= BROADCAST_PIECES * PIECE_WORDS else held, "x")
        .groupBy(*pair, "x", "m").agg(F.sort_array(F.collect_set("at")).alias("places"))
        .select(*pair, F.inline(F.transform("places", lambda p, i: F.struct(
            p.alias("at"), (F.greatest(F.coalesce(F.get("places", i - F.col("m")), F.lit(-1)), p - F.col("n")) + 1).alias("from"),
        ))))
        .select(*pair, F.inline(F.array(
            F.struct(F.col("from").alias("at"), F.lit(1).alias("step"), F.lit(False).alias("begins")),
            F.struct(F.col("at"), F.lit(0).alias("step"), F.lit(True).alias("begins")),
            F.struct((F.col("at") + 1).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("begins")),
        )))
        .groupBy(*pair, "at").agg(F.sum("step").alias("step"), F.max("begins").alias("begins"))
    )
    size = F.least(F.col("n"), F.col("total") - F.col("at"))
    return (
        events.withColumn("common", F.sum("step").over(Window.partitionBy(*pair).orderBy("at"))).where("begins")
        .withColumn("all", size + F.col("n") - F.col("common"))
        .where(F.col("common") * OF >= F.col("all") * SHARED)
        .select("doc_id", "_key", "item_id", _hit(F.lit(True), size, F.lit(SHINGLE)))
    )


def _hit(whole: Column, length: Column, size: Column) -> Column:
    """What is kept of a window of ``length`` shingles; the greatest one is the best."""
    return F.struct(
        whole.alias("whole"), (F.col("common") / F.col("all")).alias("similarity"), F.negative("at").alias("back"),
        (length + size - 1).alias("n_words"),
    ).alias("hit")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words, _key``: each item a document holds, at its most similar window.

    ``items (item_id, text)``. Of windows of one similarity the first counts. Items without words or id match nothing;
    items of fewer than five words are one shingle. An item over ``PIECE_WORDS`` words is held where a window of its whole
    length is similar, or one of ``PIECE_WORDS`` words to a passage of it; the row is that of the whole window if there is one,
    else that of the passage, as ``n_words`` tells. Null and empty documents match nothing. Rows that repeat a
    doc_id give one row per distinct text, told apart by ``_key``. No items or no documents give an empty result. Other
    columns are not read.
    """
    pieces = stored(_pieces(items), "pieces")
    sizes = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    small = sum(sizes.values()) <= BROADCAST_PIECES
    text = F.col(text_col)
    hashed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"),
        once(F.transform(words_of(text), lambda w: F.xxhash64(w))).alias("h"),
    )
    # Without items one shingle length is looked for in vain, and the result is empty.
    if not sizes:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, similarity double, start_word int, n_words int, _key long"
        )
    windows = reduce(DataFrame.unionByName, [_windows(hashed, pieces, size, small) for size in sorted(sizes)])
    listed = pieces.select(
        "piece", "size", "n", F.col("print").alias("_print"),
        F.inline(F.array(*[
            F.struct(F.lit(k).alias("block"), F.lit(_flips(w)).alias("_flips"))
            for k, (_, w) in enumerate(BLOCKS)
        ])),
    )
    value = reduce(
        lambda rest, k: F.when(F.col("block") == k, _block(F.col("_print"), k)).otherwise(rest),
        range(len(BLOCKS)), F.lit(None).cast("int"),
    )
    listed = listed.withColumn("_value", value).select(
        "piece", "size", "n", "_print", "block",
        F.explode(F.transform("_flips", lambda x: F.col("_value").bitwiseXOR(x))).alias("value"),
    )
    blocks = F.array(*[
        F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(len(BLOCKS))
    ])
    cut = windows.select("doc_id", "_key", "at", "size", "n", "window", "print", F.inline(blocks))
    apart = F.col("print").bitwiseXOR(F.col("_print"))
    earlier = [
        (F.col("block") <= k) | (F.bit_count(_block(apart, k)) > FLIPS) for k in range(len(BLOCKS))
    ]
    near = (
        cut.join(F.broadcast(listed) if small else listed, ["size", "n", "block", "value"])
        .where(F.bit_count(apart) <= RADIUS)
        .where(reduce(Column.__and__, earlier))  # a pair is found by its first common block only
        .select("doc_id", "_key", "at", "size", "window", "piece")
    )
    texts = pieces.select("piece", "item_id", F.col("at").alias("_piece_at"), "shingles", "n")
    verified = (
        near.join(F.broadcast(texts) if small else texts, "piece")
        .withColumn("common", _common(F.col("window"), F.col("shingles")))
        .withColumn("all", F.size("window") + F.col("n") - F.col("common"))
        .where(F.col("common") * OF >= F.col("all") * SHARED)
        .select("doc_id", "_key", "item_id", _hit(F.lit(False), F.size("window"), F.col("size")))
    )
    whole = _whole(hashed, items)
    if whole is not None:
        verified = verified.unionByName(whole)
    return verified.groupBy("doc_id", "_key", "item_id").agg(F.max("hit").alias("hit")).select(
        "doc_id", "item_id", "hit.similarity", F.negative("hit.back").alias("start_word"), "hit.n_words", "_key"
    )


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    bad = stored(matches(docs, items).select("doc_id", "_key").distinct(), "contaminated")
    few = bad.count() <= BROADCAST_DOCUMENTS
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("_key").alias("_bad_key"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs["text"]) == F.col("_bad_key"))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")
