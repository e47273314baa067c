"""Sampling of documents towards target shares of tokens per source, language and topic.

Token counts per (source, language, topic) are raked to the three target marginals by iterative proportional
fitting: in turn the factors of sources, languages and topics are set so that their marginal is met. A document's
weight is the product of its three factors.

Its probability of staying comes from a second fit, of the tokens that are expected to stay, with the bound of 1 inside:
the product of three other factors, at most 1. Its marginals are the target shares of the wanted share of all tokens. A
value with fewer tokens than that keeps all it has, and the others make up for it in proportion to their targets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import for_python, small_frame, stored, text_lists

#: Default targets are the natural shares to this power, made to sum to 1: large sources give, small ones gain.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Share of all tokens that is expected to stay.
KEEP = 0.8
STEPS = 60
TOLERANCE = 1e-7
#: Languages and topics with a marginal of their own, besides those a target names; smaller ones share that of ``OTHER``.
MAX_VALUES = 255
OTHER = "\0other"
#: The topic of a document without a given one: a bucket of its most frequent long word.
TOPICS = 8
LONG_WORD = re.compile(r"[^\W\d_]{8,}")
#: Sources whose factors may go to every task; beyond, documents and factors are joined by source.
BROADCAST_SOURCES = 100_000
SEED = 17
#: Weights are told apart by so many steps per doubling where the scale is chosen.
SCALE_STEPS = 256

DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: str) -> str:
    """A bucket of the most frequent word of eight letters or more, ties to the smaller word; ``none`` without one."""
    counted = Counter(LONG_WORD.findall(text.lower()))
    if not counted:
        return "none"
    word = min(counted, key=lambda w: (-counted[w], w))
    return f"topic{zlib.crc32(word.encode('utf-8', 'surrogatepass')) % TOPICS}"


def _with_topic(docs: DataFrame, text: str, topic: str | None) -> DataFrame:
    """``docs`` with ``_n``, the words of the text, and ``_topic``.

    Of a row only its text, and its topic where there is one, goes to Python; the rest waits in the executor.
    """

    @F.arrow_udf("n long, topic string")
    def read(*columns: pa.Array) -> pa.Array:
        counts, topics = [], []
        for texts in text_lists(columns[0]):
            for t in texts:
                counts.append(len((t or "").encode("utf-8", "surrogatepass").split()))
                if topic is None:
                    topics.append(topic_of(t or ""))
        given = pa.array(topics, pa.string()) if topic is None else columns[1].cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), given], names=["n", "topic"])

    found = for_python(docs).withColumn("_read", read(*([text] if topic is None else [text, topic])))
    return found.withColumns({"_n": F.col("_read.n"), "_topic": F.col("_read.topic")}).drop("_read")


@dataclass
class Mix:
    """Factors per source (a table), language and topic, and the scale from weights to probabilities without a second fit.

    ``bound_langs``, ``bound_topics`` and ``bound`` of the sources are the factors of the probabilities. ``shares`` has the
    target and the expected share of kept tokens per language and topic, the sources have them as ``target`` and ``kept``.
    ``error`` tells how far the weighted marginals are off, ``bound_error`` the kept ones from what can be reached.
    """

    sources: DataFrame
    langs: dict[str, float]
    topics: dict[str, float]
    scale: float
    steps: int
    error: float
    bound_langs: dict[str, float]
    bound_topics: dict[str, float]
    shares: dict[str, dict[str, tuple[float, float]]]
    bound_error: float

    def weighted(self, docs: DataFrame, source: Column, lang: Column, topic: Column) -> DataFrame:
        """Adds ``_weight`` and ``_probability`` by the values of three columns."""
        spark = docs.sparkSession
        factors = [
            small_frame(spark, [(v, x, bound[v]) for v, x in f.items()], f"{k} string, {k}_factor double, {k}_bound double")
            for k, f, bound in (("_l", self.langs, self.bound_langs), ("_t", self.topics, self.bound_topics))
        ]
        sources = self.sources.select(F.col("source").alias("_s"), F.col("factor").alias("_s_factor"), F.col("bound").alias("_s_bound"))
        if sources.count() <= BROADCAST_SOURCES:
            sources = F.broadcast(sources)
        placed = docs.withColumns({"_s": source, "_l": _named(lang, self.langs), "_t": _named(topic, self.topics)})
        weight = F.coalesce(F.col("_s_factor") * F.col("_l_factor") * F.col("_t_factor"), F.lit(1.0))
        chance = F.coalesce(F.col("_s_bound") * F.col("_l_bound") * F.col("_t_bound"), F.lit(self.scale))
        return (
            placed.join(sources, "_s", "left").join(F.broadcast(factors[0]), "_l", "left")
            .join(F.broadcast(factors[1]), "_t", "left")
            .withColumn("_weight", F.round(weight, 9))
            .withColumn("_probability", F.least(F.lit(1.0), F.round(chance, 9)))
            .drop("_s", "_l", "_t", "_s_factor", "_l_factor", "_t_factor", "_s_bound", "_l_bound", "_t_bound")
        )


def _named(value: Column, known: dict[str, float]) -> Column:
    return F.when(value.isin(list(known)), value).otherwise(F.lit(OTHER))


def _value(column: Column) -> Column:
    """Null values are the group of the empty name."""
    return F.coalesce(column.cast("string"), F.lit(""))


def _targets(tokens: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """Target shares: the given ones, and for the other values their tempered tokens' part of what is left."""
    given = {k: v for k, v in (given or {}).items() if k in tokens}
    left = max(0.0, 1.0 - sum(given.values()))
    tempered = {k: n**power if n > 0 else 0.0 for k, n in tokens.items() if k not in given}
    total = sum(tempered.values())
    found = {**given, **{k: left * x / total if total else 0.0 for k, x in tempered.items()}}
    whole = sum(found.values())
    return {k: found[k] / whole if whole else 0.0 for k in tokens}


def rake(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, steps: int = STEPS
) -> Mix:
    """Fit factors to ``cells (source, lang, topic, n)``, one row per combination.

    ``targets`` may name shares for some values of ``source``, ``lang`` and ``topic``. The driver holds the sums
    per language and topic, a bounded table; sources stay in Spark, one row each with its bounded list of cells.
    Targets that no weights can meet are approached until the last step; ``error`` tells how far the marginals are off.
    """
    spark = cells.sparkSession
    targets = targets or {}
    cells = stored(cells, "cells")
    total = cells.agg(F.sum("n").alias("n")).first()["n"] or 0

    def small(name: str) -> dict[str, float]:
        named = list(targets.get(name) or {})
        rows = (
            cells.groupBy(name).agg(F.sum("n").alias("n")).where(F.col(name) != OTHER)
            .orderBy(F.col(name).isin(named).desc(), F.desc("n"), name).limit(MAX_VALUES + len(named)).collect()
        )
        found = {r[name]: float(r["n"]) for r in rows}
        found[OTHER] = float(total) - sum(found.values())
        return found

    langs, topics = small("lang"), small("topic")
    names = {"lang": list(langs), "topic": list(topics)}
    want_lang = np.array(list(_targets(langs, TEMPER["lang"], targets.get("lang")).values())) * total
    want_topic = np.array(list(_targets(topics, TEMPER["topic"], targets.get("topic")).values())) * total
    n_topics = len(topics)

    given = small_frame(spark, list((targets.get("source") or {}).items()), "source string, given double")
    place = {k: small_frame(spark, [(v, i) for i, v in enumerate(names[k])], f"{k} string, _{k} int") for k in names}
    by_source = (
        cells.withColumns({k: _named(F.col(k), dict.fromkeys(names[k], 0.0)) for k in names})
        .join(F.broadcast(place["lang"]), "lang").join(F.broadcast(place["topic"]), "topic")
        .groupBy("source", (F.col("_lang") * n_topics + F.col("_topic")).alias("at")).agg(F.sum("n").alias("n"))
        .groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cells"), F.sum("n").alias("n"))
        .join(F.broadcast(given), "source", "left")
        .withColumn("tempered", F.when(F.col("given").isNull() & (F.col("n") > 0), F.pow(F.col("n").cast("double"), F.lit(TEMPER["source"]))).otherwise(0.0))
    )
    by_source = stored(by_source, "sources")
    sums = by_source.agg(F.sum("given").alias("given"), F.sum("tempered").alias("tempered")).first()
    named, tempered = sums["given"] or 0.0, sums["tempered"] or 0.0
    rest = max(0.0, 1.0 - named) if tempered else 0.0
    whole = named + rest
    share = F.coalesce("given", F.col("tempered") * F.lit(rest / tempered if tempered else 0.0)) / F.lit(whole or 1.0)
    wanted = by_source.select(
        "source", (share * F.lit(float(total))).alias("want"),
        F.transform("cells", lambda x: x["at"]).alias("at"), F.transform("cells", lambda x: x["n"]).alias("n"),
    )

    b, c = np.ones(len(langs)), np.ones(n_topics)
    taken, error = 0, 0.0
    for taken in range(1, steps + 1):
        table = _source_step(wanted, b, c)
        before = table * np.outer(b, c)
        error = float(
            max(np.abs(before.sum(1) - want_lang).max(initial=0), np.abs(before.sum(0) - want_topic).max(initial=0))
            / max(total, 1)
        )
        if error <= TOLERANCE:
            break
        b = _ratio(want_lang, table @ c)
        c = _ratio(want_topic, table.T @ b)
    factors = stored(_source_factors(wanted, b, c), "factors")
    scale = _scale(factors, b, c, total, keep)
    bound, bound_b, bound_c, kept, bound_error = _bounded(wanted, b * scale, c, want_lang, want_topic, total, keep, steps)
    whole = max(float(kept.sum()), 1e-300)
    shares = {
        name: {v: (float(w) / max(total, 1), float(k) / whole) for v, w, k in zip(names[name], wants, found)}
        for name, wants, found in (("lang", want_lang, kept.sum(1)), ("topic", want_topic, kept.sum(0)))
    }
    sources = factors.select("source", "factor").join(
        bound.select(
            "source", F.col("factor").alias("bound"), (F.col("full") / max(total, 1)).alias("target"),
            (F.col("kept") / whole).alias("kept"),
        ),
        "source",
    )
    return Mix(
        stored(sources, "mix"), dict(zip(names["lang"], b.tolist())), dict(zip(names["topic"], c.tolist())),
        scale, taken, error, dict(zip(names["lang"], bound_b.tolist())), dict(zip(names["topic"], bound_c.tolist())),
        shares, bound_error,
    )


def _bounded(
    wanted: DataFrame, b: np.ndarray, c: np.ndarray, want_lang: np.ndarray, want_topic: np.ndarray, total: int, keep: float, steps: int
) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, float]:
    """Factors whose product, at most 1, lets the target shares of the kept tokens be expected, from factors near them.

    Gives the sources with their factors, those of languages and topics, the kept tokens of both, and the error. In a
    step the tokens of clipped cells are fixed, and the others are raked to what is left of their marginal.
    """
    n = F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y)
    asked = wanted.withColumn("full", F.col("want")).withColumn("tokens", n)
    weight = F.when(F.col("tokens") > 0, F.col("full") / F.col("tokens")).otherwise(0.0)
    level = _scale(asked.select(weight.alias("factor"), F.array(F.lit(0)).alias("at"), F.array("tokens").alias("n")), np.ones(1), np.ones(1), total, keep)
    asked = stored(asked.withColumn("want", F.least(F.col("tokens").cast("double"), F.col("full") * level)), "kept_sources")
    goal = asked.agg(F.sum("want").alias("want")).first()["want"] or 0.0
    rows = asked.select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).collect()
    have = np.zeros(len(b) * len(c))
    for row in rows:
        have[row["at"]] = row["n"]
    have = have.reshape(len(b), len(c))
    goal_lang, goal_topic = (_reachable(w, h, goal) for w, h in ((want_lang, have.sum(1)), (want_topic, have.sum(0))))
    fixed, free, error = np.zeros_like(have), np.zeros_like(have), 0.0
    for taken in range(1, steps + 1):
        fixed, free = _bounded_step(asked, b, c)
        kept = fixed + free * np.outer(b, c)
        error = float(max(np.abs(kept.sum(1) - goal_lang).max(), np.abs(kept.sum(0) - goal_topic).max()) / max(total, 1))
        if error <= TOLERANCE or taken == steps:
            break
        b = _newton(goal_lang, fixed.sum(1), free @ c, b)
        c = _newton(goal_topic, fixed.sum(0), free.T @ b, c)
    return stored(_bounded_factors(asked, b, c), "bounded"), b, c, fixed + free * np.outer(b, c), error


def _reachable(wants: np.ndarray, have: np.ndarray, goal: float) -> np.ndarray:
    """Tokens per value, ``goal`` in all: in proportion to ``wants``, but never more than there are."""
    weight = np.where(have > 0, wants / np.where(have > 0, have, 1), 0.0)
    some = weight > 0
    if not some.any():
        return np.zeros_like(have)
    return np.where(some, np.minimum(have, have * weight * _level(have[some], weight[some], goal)), 0.0)


def _level(n: np.ndarray, weight: np.ndarray, goal: float) -> float:
    """The scale at which ``n`` tokens of some weights, at most all of them, are ``goal`` tokens."""
    low, high = 0.0, 1.0 / weight.min()
    for _ in range(200):
        middle = (low + high) / 2
        if (n * np.minimum(1.0, middle * weight)).sum() < goal:
            low = middle
        else:
            high = middle
    return high


def _newton(goal: np.ndarray, fixed: np.ndarray, free: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Factors that bring the free tokens to what the fixed ones leave; without either, in proportion."""
    found = fixed + free * now
    apart = np.where(found > 0, now * goal / np.where(found > 0, found, 1), now)
    some = (goal > fixed) & (free > 0)
    rest = np.where(some, (goal - fixed) / np.where(free > 0, free, 1), apart)
    return np.where((free <= 0) & (goal >= fixed), now, rest)


def _source_bound(want: float, weight: np.ndarray, n: np.ndarray) -> float:
    """The factor at which the cells of a source, each clipped at 1, have ``want`` tokens."""
    some = (weight > 0) & (n > 0)
    if want <= 0 or not some.any():
        return 0.0 if want <= 0 else 1.0
    order = np.argsort(-weight[some], kind="stable")
    weight, n = weight[some][order], n[some][order].astype(float)
    if want >= n.sum() * (1 - 1e-12):
        return float(1.0 / weight[-1])
    fixed = np.concatenate(([0.0], np.cumsum(n)[:-1]))
    free = np.cumsum((weight * n)[::-1])[::-1]
    factors = (want - fixed) / free
    fits = np.flatnonzero(factors * weight <= 1.0)
    return float(factors[fits[0]]) if len(fits) else float(1.0 / weight[-1])


def _bounded_factors(asked: DataFrame, b: np.ndarray, c: np.ndarray) -> DataFrame:
    """``(source, factor, full, kept, at, n)``: each source's factor for the given ones, clipped cells counted as such."""
    cell = np.outer(b, c).ravel()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            factors, kept = [], []
            for want, at, n in zip(*(batch.column(k).to_pylist() for k in ("want", "at", "n"))):
                n = np.array(n)
                factors.append(_source_bound(want, cell[at], n))
                kept.append(float((np.minimum(1.0, factors[-1] * cell[at]) * n).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("source"), pa.array(factors, pa.float64()), batch.column("full"), pa.array(kept, pa.float64()),
                    batch.column("at"), batch.column("n"),
                ],
                names=["source", "factor", "full", "kept", "at", "n"],
            )

    return asked.select("source", "want", "full", "at", "n").mapInArrow(
        fit, "source string, factor double, full double, kept double, at array<int>, n array<bigint>"
    )


def _bounded_step(asked: DataFrame, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per language and topic, after the sources' factors are set: tokens of clipped cells, and factors times other tokens."""
    cell = small_frame(asked.sparkSession, [(i, float(x)) for i, x in enumerate(np.outer(b, c).ravel())], "at int, w double")
    clipped = F.col("factor") * F.col("w") >= 1.0
    rows = (
        _bounded_factors(asked, b, c)
        .select("factor", F.explode(F.arrays_zip("at", "n")).alias("x"))
        .select("factor", F.col("x.at").alias("at"), F.col("x.n").alias("n")).join(F.broadcast(cell), "at")
        .groupBy("at").agg(
            F.sum(F.when(clipped, F.col("n")).otherwise(0)).alias("fixed"),
            F.sum(F.when(clipped, 0.0).otherwise(F.col("factor") * F.col("n"))).alias("free"),
        ).collect()
    )
    fixed, free = np.zeros(len(b) * len(c)), np.zeros(len(b) * len(c))
    for row in rows:
        fixed[row["at"]], free[row["at"]] = row["fixed"], row["free"]
    return fixed.reshape(len(b), len(c)), free.reshape(len(b), len(c))


def _ratio(wanted: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.where(found > 0, wanted / np.where(found > 0, found, 1), 1.0)


def _source_factors(wanted: DataFrame, b: np.ndarray, c: np.ndarray) -> DataFrame:
    """``(source, factor, at, n)``: each source's factor for the given factors of languages and topics."""
    cell = np.outer(b, c).ravel()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            factors = []
            for want, at, n in zip(*(batch.column(k).to_pylist() for k in ("want", "at", "n"))):
                found = float((cell[at] * n).sum())
                factors.append(want / found if found > 0 else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("source"), pa.array(factors, pa.float64()), batch.column("at"), batch.column("n")],
                names=["source", "factor", "at", "n"],
            )

    return wanted.mapInArrow(fit, "source string, factor double, at array<int>, n array<bigint>")


def _source_step(wanted: DataFrame, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Tokens per language and topic after the sources' factors are set, before those of languages and topics."""
    rows = (
        _source_factors(wanted, b, c)
        .select("factor", F.explode(F.arrays_zip("at", "n")).alias("x"))
        .groupBy(F.col("x.at").alias("at")).agg(F.sum(F.col("factor") * F.col("x.n")).alias("n")).collect()
    )
    table = np.zeros(len(b) * len(c))
    for row in rows:
        table[row["at"]] = row["n"]
    return table.reshape(len(b), len(c))


def _scale(factors: DataFrame, b: np.ndarray, c: np.ndarray, total: int, keep: float) -> float:
    """The scale that lets the wanted share of tokens be expected, from tokens per step of weight."""
    cell = small_frame(factors.sparkSession, [(i, float(x)) for i, x in enumerate(np.outer(b, c).ravel())], "at int, w double")
    weight = F.col("factor") * F.col("w")
    rows = (
        factors.select("factor", F.explode(F.arrays_zip("at", "n")).alias("x"))
        .select("factor", F.col("x.at").alias("at"), F.col("x.n").alias("n"))
        .join(F.broadcast(cell), "at").where((weight > 0) & (F.col("n") > 0))
        .groupBy(F.floor(F.log2(weight) * SCALE_STEPS).alias("step"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * weight).alias("weighted")).collect()
    )
    if not rows:
        return keep
    n = np.array([r["n"] for r in rows], float)
    mean = np.array([r["weighted"] for r in rows]) / n
    return _level(n, mean, keep * total)


def _chance(id_col: Column, text: Column) -> Column:
    """A number from 0 up to 1 that depends on the id alone, on the text where the id is null."""
    hashed = F.xxhash64(F.lit(SEED), F.coalesce(id_col.cast("long"), F.xxhash64(text)))
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def _cells(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"))


def mixed(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float = KEEP,
    topic_col: str | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, kept`` of every row.

    Null sources, languages and topics are the group of the empty name. Null texts have no tokens; they are sampled like
    their group. Rows that repeat a doc_id of the same group share their fate. An empty table gives an empty result.
    ``topic_col`` names a column of topics; without it the topic is derived from the text. Other columns are not read.
    """
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), _value(F.col("source")).alias("source"),
        _value(F.col("lang")).alias("lang"), F.col("text").alias("text"),
        *([F.col(topic_col).alias("given_topic")] if topic_col else []),
    )
    counted = _with_topic(read, "text", "given_topic" if topic_col else None)
    narrow = stored(
        counted.select(
            "doc_id", "source", "lang", _value(F.col("_topic")).alias("topic"), F.col("_n").alias("n_tokens"),
            _chance(F.col("doc_id"), F.col("text")).alias("_chance"),
        ),
        "tokens",
    )
    mix = rake(_cells(narrow), targets, keep)
    return mix.weighted(narrow, F.col("source"), F.col("lang"), F.col("topic")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.col("_weight").alias("weight"),
        F.col("_probability").alias("probability"), (F.col("_chance") < F.col("_probability")).alias("kept"),
    )


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, decided as by ``mixed``."""
    counted = _with_topic(docs.select("source", "lang", "text"), "text", None).select(
        _value(F.col("source")).alias("source"), _value(F.col("lang")).alias("lang"),
        _value(F.col("_topic")).alias("topic"), F.col("_n").alias("n_tokens"),
    )
    mix = rake(_cells(counted), targets, keep)
    # The row travels as one value, so that no column of it can clash with those added here.
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "lang", "text")
    placed = mix.weighted(
        _with_topic(whole, "text", None), _value(F.col("source")), _value(F.col("lang")), _value(F.col("_topic"))
    )
    return placed.where(_chance(F.col("doc_id"), F.col("text")) < F.col("_probability")).select("_row.*")
