"""Phrase collocations, periodic runs and near vectors against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import periodic_runs, phrases, vector_copies
from caseloom.llm.queries import QUERIES
from caseloom.sources.sample_tables import table

EMPTY = hashlib.sha256(b"").hexdigest()

# --- 11: phrases ---


def plain_phrases(rows, max_words=3, min_count=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    result = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in held.items():
            longer = [
                b for q, b in held.items()
                if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= cover * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


def phrase_rows(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.mark.parametrize("max_words, min_count, cover, top", [(3, 10, 50, 2000), (2, 3, 50, 20), (4, 4, 80, 2000), (5, 3, 50, 40)])
def test_phrases_are_those_of_brute_force(spark, max_words, min_count, cover, top):
    picked = random.Random(max_words)
    words = ["a", "B", "the", "The", "köln", "x-y", "#1", " z", "\x1c"] + [f"w{i}" for i in range(12)]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; ", "!?"]
    rows = []
    for i in range(150):
        text = "".join(picked.choice(words) + picked.choice(gaps) for _ in range(picked.choice([0, 1, 2, 3, 40, 200])))
        rows.append((picked.choice(["en", "de", None, "und"]), text))
    rows += [("en", "one and the same text, again and again. " * 30)] * 40 + [("xx", None), ("xx", ""), ("fr", "w " * 5000)]
    docs = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n long")
    found = phrases.collocations(docs.repartition(5), max_words, min_count, cover, top)
    assert phrase_rows(found) == plain_phrases(rows, max_words, min_count, cover, top)


def test_dictionary_tells_the_texts(spark):
    """Chunks share two words, start with the text, and repeated passages are entries once."""
    text = " ".join(f"w{i * i % 331}" for i in range(2000))
    docs = spark.createDataFrame([("en", text)] * 7, "lang string, text string")
    entries = phrases.dictionary(docs).collect()
    assert {r["n"] % 7 for r in entries} == {0}
    words = sum(r["n"] * (len(r["chunk"].split(b" ")) - (0 if r["head"] else 2)) for r in entries)
    assert words == 7 * 2000 and sum(r["n"] for r in entries if r["head"]) == 7
    assert len(entries) < 400


def test_phrases_of_nothing(spark, nothing, messy):
    assert phrases.collocations(nothing).collect() == []
    found = phrases.collocations(messy, min_count=2).collect()
    assert {r["lang"] for r in found} >= {"en", "und"} and all(r["a"] >= 2 for r in found)


# --- 12: periodic runs ---


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_digest(words):
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def looped(doc_id, words):
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_are_those_of_lag_scans(spark, folder):
    """The query on a whole small table, loops included."""
    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    wanted = {
        r["doc_id"]: plain_digest(looped(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
        for r in rows if len(r["text"] or "") < 30_000
    }
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert len(found) == len(rows) and {k: found[k] for k in wanted} == wanted
    assert sum(w[0] > 0 for w in wanted.values()) > 5


def test_runs_of_random_words():
    picked = random.Random(2)
    for _ in range(60):
        texts = []
        for _ in range(5):
            n, kinds = picked.choice([0, 1, 5, 6, 7, 40, 150, 700]), picked.choice([1, 2, 3, 60, 10**6])
            words = [b"%d" % picked.randrange(kinds) for _ in range(n)]
            for _ in range(picked.randrange(3) if n > 20 else 0):
                a = picked.randrange(n)
                p = 1 + picked.randrange(max(1, (n - a) // 3))
                for i in range(a, min(n, a + picked.choice([3, 4, 5, 9]) * p + picked.randrange(3))):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        assert [[tuple(r) for r in x] for x in periodic_runs.runs_of(texts)] == [
            sorted(plain_runs(w), key=lambda r: (r[0], r[2])) for w in texts
        ]


def test_long_runs_take_time_by_the_words():
    import time

    n = 300_000
    texts = {
        "one word": [b"x"] * n, "long period": [b"%d" % (i % 5000) for i in range(n)],
        "two letters": [b"%d" % (bin(i).count("1") % 2) for i in range(n)],
        "fibonacci": [b"%d" % (int((i + 2) * 0.6180339887498949) - int((i + 1) * 0.6180339887498949)) for i in range(n)],
    }
    for words in texts.values():
        start = time.process_time()
        periodic_runs.runs_of([words])
        assert time.process_time() - start < 20
    assert periodic_runs.runs_of([texts["one word"]]) == [[(0, n, 1)]]
    assert periodic_runs.runs_of([texts["long period"]]) == [[(0, n, 5000)]]
    assert periodic_runs.runs_of([texts["two letters"]]) == [[]]  # overlap-free


def test_runs_of_odd_rows(messy, nothing):
    found = {}
    for r in periodic_runs.digest(periodic_runs.periodic_runs(messy)).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    none = (0, None, None, None, None, EMPTY, EMPTY)
    assert found[1] == found[2] == found[3] == found[10] == [none]
    assert len(found[6]) == len(found[8]) == len(found[None]) == 2
    assert periodic_runs.periodic_runs(nothing).collect() == []
    assert periodic_runs.with_loops(messy).count() == messy.count()
    assert periodic_runs.with_loops(messy).columns == messy.columns


# --- 13: near vectors ---


def plain_links(ids, vectors, threshold=0.9):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return {ids[i]: (int(near[i].sum()), ids[find(i)]) for i in range(len(ids))}


def clustered(seed, groups, each, others, dim, noise):
    picked = np.random.default_rng(seed)
    centres = picked.standard_normal((groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    near = np.repeat(centres, each, axis=0) + noise * picked.standard_normal((groups * each, dim)) / np.sqrt(dim)
    return np.concatenate([near, picked.standard_normal((others, dim))]).tolist()


@pytest.mark.parametrize("dim, noise, layout", [(64, 0.3, {}), (64, 0.45, {"bucket_rows": 16, "cell_rows": 20}), (7, 0.2, {"cell_rows": 50})])
def test_links_are_those_of_all_pairs(spark, dim, noise, layout):
    vectors = clustered(dim, 12, 25, 400, dim, noise)
    vectors += vectors[:40]  # exact copies
    ids = list(range(1, len(vectors) + 1))
    frame = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_copies.near_vectors(frame, **layout).collect()}
    wanted = plain_links(ids, vectors)
    links, right = sum(n for n, _ in wanted.values()), sum(n for n, _ in found.values())
    assert right <= links and all(found[i][0] <= wanted[i][0] for i in ids)  # none below the threshold
    assert right >= 0.97 * links
    assert sum(found[i] == wanted[i] for i in ids) >= 0.95 * len(ids)


def test_estimates_are_unbiased_and_bounded():
    picked = np.random.default_rng(3)
    layout = vector_copies.Layout.of(10**6, 0.9, 0.99)
    length, dim, t = layout.code_length(64), 64, 0.9
    x = vector_copies._units(picked.standard_normal((4000, dim)))
    across = picked.standard_normal((4000, dim))
    across = vector_copies._units(across - (across * x).sum(1, keepdims=True) * x)
    y = t * x + np.sqrt(1 - t * t) * across
    turned = x @ vector_copies._rotation(dim, length).T
    code = np.sign(turned) / np.sqrt(length)
    factor = (code * turned).sum(1)
    estimate = (code * (y @ vector_copies._rotation(dim, length).T)).sum(1) / factor
    error = np.sqrt((1 / factor**2 - 1) * (1 - t * t) / (length - 1))
    assert abs((estimate - t).mean()) < 4 * error.mean() / np.sqrt(4000)
    assert (np.abs(estimate - t) <= vector_copies.CONFIDENCE * error).mean() > 0.999


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
        (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e299]), (11, [1e-300, 0.0]), (None, [1.0, 0.0]),
        (12, [-1.0, 0.0]), (12, [-1.0, 0.0]), (13, [5.0]), (14, [7.0]),
    ]
    frame = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, n long")
    found = vector_copies.near_vectors(frame).collect()
    assert len(found) == len(rows)
    by_id = {r["vec_id"]: tuple(r)[1:] for r in found}
    near = {1, 2, 10, 11}
    assert {i: by_id[i] for i in near} == {i: (3, 1, i == 1) for i in near}
    for i in (3, 4, 5, 6, 7, 8, 9, 12):
        assert by_id[i] == (0, i, True)
    assert by_id[13] == (1, 13, True) and by_id[14] == (1, 13, False)
    assert by_id[None] == (0, None, True)
    assert vector_copies.near_vectors(frame.limit(0)).collect() == []
    floats = frame.where(F.col("vec_id") <= 2).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert {r["n_links"] for r in vector_copies.near_vectors(floats).collect()} == {1}


def test_layout_finds_what_it_promises():
    import math

    for rows, threshold in ((10**4, 0.9), (10**7, 0.9), (10**9, 0.8)):
        layout = vector_copies.Layout.of(rows, threshold, 0.99)
        met = (1 - math.acos(threshold) / math.pi) ** layout.bits
        assert 1 - (1 - met) ** layout.bands >= 0.99 and layout.bits * layout.bands <= layout.code_bits
