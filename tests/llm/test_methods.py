"""Operators against brute force, exact properties or held-out accuracy."""

import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import (
    decontaminate,
    distribution_rules,
    host_paths,
    line_runs,
    mixing,
    private_spans,
    quality_gam,
    secret_ledger,
    shards,
    trie_join,
)
from caseloom.session import run_dir
from caseloom.sources.sample_tables import table


# --- 1: quality rules ---

@pytest.mark.parametrize("seed", range(20))
def test_repeated_words_by_brute_force(seed):
    picked = random.Random(seed)
    words = [picked.choice([b"a", b"b", b"c", b"d"][: 2 + seed % 3]) for _ in range(picked.randrange(40))]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert distribution_rules.repeated_words(words) == len(covered)


def test_distance_is_a_distance():
    p = np.array([[5.0, 0, 0], [1, 1, 1], [0, 0, 9]])
    found = distribution_rules.distances(p, np.array([4.0, 0, 0]))
    assert found[0] == pytest.approx(0) and 0 < found[1] < 1 and found[2] == pytest.approx(1)


# --- 2: leaks ---

def shingles(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_leaks(docs, items, size=5):
    found = {}
    for item, text in items.items():
        wanted = re.findall(r"[^\W_]+", text.lower())
        k = min(size, len(wanted))
        m = shingles(wanted, k)
        for doc, body in docs.items():
            words = re.findall(r"[^\W_]+", body.lower())
            for start in range(len(words) - len(wanted) + 1):
                w = shingles(words[start : start + len(wanted)], k)
                common = sum((w & m).values())
                every = sum((w | m).values())
                if common * 10 >= every * 8:
                    found[doc, item] = max(found.get((doc, item), 0), common / every)
    return found


def test_leaks_by_brute_force(spark):
    picked = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    items = {i: " ".join(picked.choices(words, k=picked.choice([3, 6, 20, 45, 60]))) for i in range(25)}
    items[25] = " ".join(["again"] * 30)  # one shingle many times
    items[26] = " ".join(picked.choices(words, k=100))
    docs = {}
    for d in range(60):
        body = picked.choices(words, k=80)
        passage = items[d % 27].split()
        for _ in range(picked.choice([0, 0, 1, 2])):
            passage[picked.randrange(len(passage))] = "changed"
        at = picked.randrange(80)
        docs[d] = " ".join([*body[:at], *passage, *(body[at:] if d % 3 else [])]).capitalize() + "!"
    found = decontaminate.matches(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    ).collect()
    wanted = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert set(wanted) <= set(got)
    assert all(got[k] >= v - 1e-12 for k, v in wanted.items())
    # What is found beyond are windows cut off by the end of their text.
    assert all(docs[d].lower().rstrip("!").split()[-1] in items[i] for d, i in set(got) - set(wanted))


def test_long_items_are_compared_in_pieces(spark):
    words = [f"u{i}" for i in range(1000)]
    docs = spark.createDataFrame([(1, " ".join(words[300:500])), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    rows = decontaminate.matches(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.n_words) for r in rows] == [(1, 9, 1.0, 116)] or rows[0].doc_id == 1


def test_long_items_by_brute_force(spark):
    """No short tail of a long item is a match, and no similar window of its whole length is lost."""
    picked = random.Random(5)
    sizes = (128, 129, 130, 131, 132, 133, 137, 256, 300, 1000)
    items = {n: [f"i{n}x{picked.randrange(3 * n)}" for _ in range(n - 40)] + ["again"] * 12 for n in sizes}
    items = {n: [*words, *(f"the{k}" for k in range(n - len(words)))] for n, words in items.items()}
    docs = {}
    for n, words in items.items():
        for tail in (1, 2, 4, 5, 9, 28):
            docs[len(docs)] = ["front", *words[-tail:], "back"] * 3
        for changed in (0, 1, n // 60, n // 45, n // 40, n // 20):
            passage = list(words)
            for k in range(changed):  # evenly, so that every piece loses as much
                passage[(2 * k + 1) * n // (2 * changed)] = "changed"
            docs[len(docs)] = [*picked.choices(words[:30], k=20), *passage, *picked.choices(words, k=10)]
        docs[len(docs)] = [*words[: n // 2], *(f"new{k}" for k in range(n // 9)), *words[n // 2 :]]
    docs = {d: " ".join(words) for d, words in docs.items()}
    items = {n: " ".join(words) for n, words in items.items()}
    frame = spark.createDataFrame([*docs.items(), *docs.items()], "doc_id long, text string")
    found = decontaminate.matches(frame, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    wanted = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id): r for r in found}
    assert len(got) == len(found) and set(wanted) <= set(got)
    assert all(got[k].similarity >= v - 1e-12 for k, v in wanted.items())
    assert any(v < 0.82 for (_, n), v in wanted.items() if n >= 256)
    # What is found beyond are passages of 128 words, and windows cut off by the end of their text.
    assert all(r.n_words >= 104 for r in found)


def test_simhash_counts_bits(spark):
    picked = random.Random(2)
    rows = [[picked.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40, 124)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<bigint>")
    for r in decontaminate.simhash(frame, "h", "print").collect():
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r["h"]) > len(r["h"]))
        assert r["print"] & ((1 << 64) - 1) == bits


# --- 3: links ---

def brute_links(texts, size, shared, of):
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        k = min(size, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if of * common >= shared * len(sets[a] | sets[b]):
                    links[a].add(b)
                    links[b].add(a)
    root = {}
    for start in sorted(links):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += links[x]
    return {i: (len(sets[i]), root[i], len(links[i])) for i in sets}


@pytest.mark.parametrize("size, shared, of, block", [(5, 8, 10, 512), (4, 85, 100, 6), (2, 1, 2, 9), (3, 1, 1, 4)])
def test_links_by_brute_force(spark, monkeypatch, size, shared, of, block):
    monkeypatch.setattr(trie_join, "BLOCK_SETS", block)
    picked = random.Random(size)
    words = [f"w{i}" for i in range(300)]
    base = [picked.choices(words, k=picked.choice([3, 12, 40, 60])) for _ in range(12)]
    passage = picked.choices(words, k=30)
    texts = {}
    for i in range(160):
        body = list(base[0] if i % 3 == 0 else picked.choice(base))
        for _ in range(picked.choice([0, 0, 1, 2, 4])):
            body[picked.randrange(len(body))] = picked.choice(words)
        if i % 5 == 0:
            body += passage
        if i % 7 == 0:
            body = body[: -len(body) // 9 or None]
        texts[i] = " ".join(body).upper() if i % 11 == 0 else " ".join(body)
    texts[160] = ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    wanted = brute_links(texts, size, shared, of)
    rows = trie_join.linked_documents(docs, size, shared, of).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == wanted
    rows = trie_join.linked_documents(docs, size, shared, of, count_links=False).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: x[:2] for i, x in wanted.items()}


def test_a_large_family_is_met_by_its_pivots_alone(spark, monkeypatch):
    """Near copies of one text, and a chain that leads away from it."""
    monkeypatch.setattr(trie_join, "BLOCK_SETS", 20)
    seen = []

    def cells(members, shared, of):
        seen.append(whole(members, shared, of))
        return seen[-1]

    whole = trie_join._cells
    monkeypatch.setattr(trie_join, "_cells", cells)
    base = [f"w{i}" for i in range(160)]
    texts = {}
    for i in range(400):
        body = list(base)
        body[i % 160] = f"x{i}"
        texts[i] = " ".join(body)
    for i in range(400, 440):
        texts[i] = " ".join([*base[: 155 - (i - 400)], *(f"y{k}" for k in range(5 + i - 400))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = trie_join.linked_documents(docs, count_links=False).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: x[1] for i, x in brute_links(texts, 5, 8, 10).items()}
    few = seen[-1].count()
    trie_join.linked_documents(docs).count()
    assert few < seen[-1].count() / 3


@pytest.mark.parametrize("seed", range(8))
def test_walk_of_the_tree_by_brute_force(seed):
    picked = np.random.RandomState(seed)
    family = picked.randint(0, 2**63, 60).astype(np.uint64)
    sets = [
        np.unique(np.append(picked.choice(family, picked.randint(1, 60)), picked.randint(0, 2**63, picked.randint(0, 9))).astype(np.uint64))
        for _ in range(40)
    ]
    ids, copies, sides = np.arange(40) + 100, picked.randint(1, 4, 40), picked.randint(0, 2, 40)
    order = trie_join.GlobalOrder(picked.randint(0, 50, 1 << trie_join.COUNTER_BITS))
    for within in (True, False):
        linked, _ = trie_join.join_cell(ids, copies, sides, sets, within, order, 6, 10)
        for i in range(40):
            wanted = 0
            for j in range(40):
                if i != j and (within or sides[i] != sides[j]):
                    common = len(np.intersect1d(sets[i], sets[j]))
                    wanted += copies[j] * (10 * common >= 6 * (len(sets[i]) + len(sets[j]) - common))
            assert linked[i] == wanted


# --- 4: secrets ---

def test_ledger_scans_only_what_no_rule_version_has_read(spark):
    ledger = secret_ledger.SecretLedger(spark, run_dir(spark, "ledger"))
    schema = "path string, version int, text string"
    first = [("a", 1, "token = 'abcdefgh1'"), ("b", 1, "nothing"), ("c", 1, "token = 'abcdefgh1'")]
    rows = ledger.scan(spark.createDataFrame(first, schema)).collect()
    assert {(r.path, len(r.spans)) for r in rows} == {("a", 1), ("b", 0), ("c", 1)}
    assert ledger.rows().count() == 2
    second = [*first, ("a", 2, "AKIA" + "Z" * 16), ("d", 1, "nothing")]
    rows = ledger.scan(spark.createDataFrame(second, schema)).collect()
    assert {(r.path, r.version, len(r.spans)) for r in rows} == {
        ("a", 1, 1), ("b", 1, 0), ("c", 1, 1), ("a", 2, 1), ("d", 1, 0)
    }
    assert ledger.rows().count() == 3
    newer = tuple(
        secret_ledger.Rule("hex", 2, r"[0-9a-h]{9}") if r.kind == "hex" else r for r in secret_ledger.RULES
    )
    rows = ledger.scan(spark.createDataFrame(first, schema), newer).collect()
    assert {(r.path, tuple(s.kind for s in r.spans)) for r in rows} == {
        ("a", ("assign", "hex")), ("b", ()), ("c", ("assign", "hex"))
    }
    again = ledger.rows().where(F.array_contains("rules", "hex@2")).collect()
    assert len(again) == 2 and all(r.rules == ["hex@2"] for r in again)


def test_secret_spans_by_brute_force(spark):
    picked = random.Random(5)
    parts = ["token", "password:", "Secret =", "api_key='", "apikey", "=", ":", " ", "abc", "deadbeef", "0123456789abcdef" * 3,
             "AKIA", "AKIAABCDEFGHIJKL", "x", "é", "\U0001f600", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "'", '"']
    texts = {i: "".join(picked.choices(parts, k=picked.randrange(30))) for i in range(200)}
    ledger = secret_ledger.SecretLedger(spark, run_dir(spark, "ledger"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in secret_ledger.secret_digest(ledger.scan(docs)).collect():
        wanted = []
        for rank, rule in enumerate(secret_ledger.RULES):
            for m in re.finditer(rule.pattern.replace("((?i:", "((?i:"), texts[r.doc_id]):
                if len(m.group(rule.group)) >= rule.min_chars:
                    wanted.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
        assert r.spans == ",".join(x[2] for x in sorted(wanted))


# --- 5: shards ---

def brute_capacity(sizes, n):
    def fits(capacity):
        used, filled = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if filled + s > capacity:
                used, filled = used + 1, 0
            filled += s
        return used <= n

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed, n, intervals", [(1, 16, 1 << 16), (2, 5, 8), (3, 3, 2), (4, 7, 16)])
def test_cuts_are_the_best(spark, monkeypatch, seed, n, intervals):
    monkeypatch.setattr(shards, "FIRST_INTERVALS", intervals)
    monkeypatch.setattr(shards, "FINER_INTERVALS", 4)
    picked = random.Random(seed)
    sizes = [picked.choice([1, 1, 2, 5, 9, 40]) for _ in range(120)] + [300] * (seed % 2)
    ends = np.cumsum(sizes)
    frame = spark.createDataFrame([(int(e),) for e in ends], "end long")
    capacity, cuts = shards.minimax_cuts(frame, int(ends[-1]), max(sizes), n)
    assert capacity == brute_capacity(sizes, n)
    bounds = [0, *cuts, int(ends[-1])]
    assert all(0 <= b - a <= capacity for a, b in zip(bounds, bounds[1:]))
    assert set(cuts) <= {0, *ends.tolist()}


def test_giant_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(90)]
    found = shards.shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len({r.shard for r in found if r.doc_id % 3}) == 1
    assert len({r.shard for r in found}) == 4


# --- 6: lines ---

def test_runs_are_levelled(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for batch in range(5):
        rows = [(batch * 10 + d, k, -k) for d in range(4) for k in range(batch, batch + 3)]
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [r for level in runs.levels for run in level for r in run.collect()]
    assert sorted(r.h1 for r in held) == list(range(7))  # every hash stands in one run
    found = {r.h1: (r.n_docs, r.last_doc) for r in runs.repeated(9).collect()}
    assert found == {2: (12, 23), 3: (12, 33), 4: (12, 43)}


def test_lines_with_one_batch_and_many(spark, folder):
    docs = table(spark, folder, "documents")
    one, many = (
        {tuple(r) for r in line_runs.without_repeated_lines(docs, batches=b).collect()} for b in (1, 7)
    )
    assert one == many


# --- 7: mixing ---

def brute_rake(table, wants, steps=400):
    factors = [np.ones(n) for n in table.shape]
    for _ in range(steps):
        for axis, want in enumerate(wants):
            now = table * factors[0][:, None, None] * factors[1][None, :, None] * factors[2][None, None, :]
            sums = now.sum(tuple(a for a in range(3) if a != axis))
            factors[axis] *= np.where(sums > 0, want / np.where(sums > 0, sums, 1), 1)
    return factors


def test_raking_by_brute_force(spark):
    picked = np.random.RandomState(1)
    counts = picked.randint(1, 500, (5, 3, 4))
    names = [[f"{k}{i}" for i in range(n)] for k, n in zip("slt", counts.shape)]
    rows = [
        (names[0][i], names[1][j], names[2][k], int(counts[i, j, k])) for i in range(5) for j in range(3) for k in range(4)
    ]
    targets = {"source": {"s0": 0.5}, "lang": {"l0": 0.2, "l1": 0.3, "l2": 0.5}}
    mix = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, n long"), targets, keep=0.4)
    total = counts.sum()
    rest = counts.sum((1, 2))[1:] ** mixing.TEMPER["source"]
    topics = counts.sum((0, 1)) ** mixing.TEMPER["topic"]
    wants = [np.append(0.5, 0.5 * rest / rest.sum()) * total, np.array([0.2, 0.3, 0.5]) * total, topics / topics.sum() * total]
    f = brute_rake(counts, wants)
    wanted = f[0][:, None, None] * f[1][None, :, None] * f[2][None, None, :]
    sources = {r.source: r.factor for r in mix.sources.collect()}
    for i, s in enumerate(names[0]):
        for j, lang in enumerate(names[1]):
            for k, topic in enumerate(names[2]):
                assert sources[s] * mix.langs[lang] * mix.topics[topic] == pytest.approx(wanted[i, j, k], rel=1e-4)
    stays = np.minimum(1, mix.scale * wanted)
    assert (stays * counts).sum() / total == pytest.approx(0.4, rel=0.01)
    assert mix.error <= mixing.TOLERANCE


def test_sample_follows_its_probabilities(spark):
    rows = [(i, "word " * 10, "en" if i % 4 else "de", f"s{min(i % 10, 3)}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mixed(docs, keep=0.5).toPandas()
    kept = found.groupby(["source", "lang"]).agg(p=("probability", "mean"), k=("kept", "mean"), n=("kept", "size"))
    assert (abs(kept.p - kept.k) < 4 * np.sqrt(kept.p * (1 - kept.p) / kept.n) + 1e-9).all()
    ids = {r.doc_id for r in mixing.sampled(docs, keep=0.5).collect()}
    assert ids == set(found[found.kept].doc_id)


def test_marginals_of_the_sample_on_skewed_sources(spark):
    """A hot source and a long tail: what can reach its target share of the kept tokens does, the others keep all."""
    sources = {"hot": 1 / 3, **{f"s{i}": 2 / 3 * 0.97**i / sum(0.97**k for k in range(60)) for i in range(60)}}
    langs = {"en": 0.8, "de": 0.1, "fr": 0.06, "es": 0.03, "it": 0.01}
    rows = [
        (s, lang, f"t{t}", max(1, round(1e7 * x * y / 4))) for s, x in sources.items() for lang, y in langs.items() for t in range(4)
    ]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n long")
    asked = {"en": 0.774, "de": 0.11, "fr": 0.07, "es": 0.035, "it": 0.011}
    mix = mixing.rake(cells, {"lang": asked})
    total = sum(r[3] for r in rows)
    sure = mix.weighted(cells, F.col("source"), F.col("lang"), F.col("topic")).toPandas()
    sure["kept"] = sure.n * sure._probability
    assert sure.kept.sum() / total == pytest.approx(0.8, rel=0.002) and mix.bound_error < 1e-5
    targets = {r.source: r.target for r in mix.sources.collect()}
    for name, wants in (("source", targets), ("lang", {k: t for k, (t, _) in mix.shares["lang"].items()})):
        kept, have = sure.groupby(name).kept.sum(), sure.groupby(name).n.sum()
        full = {v for v in kept.index if kept[v] > 0.9999 * have[v]}
        raised = [kept[v] / wants[v] for v in kept.index if v not in full]
        # Those below their all share one level; those that keep all have no more to give.
        assert raised and max(raised) / min(raised) == pytest.approx(1, rel=0.001)
        assert all(have[v] <= wants[v] * max(raised) * 1.001 for v in full)
    shares = sure.groupby("lang").kept.sum() / sure.kept.sum()
    assert all(mix.shares["lang"][v][1] == pytest.approx(shares[v], abs=1e-5) for v in langs)
    assert all(shares[v] == pytest.approx(share, abs=1e-4) for v, share in asked.items())


# --- 8: quality ---

def test_held_out_accuracy(spark, folder):
    scores = quality_gam.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    judged = scores.where("held_out").join(table(spark, folder, "labels"), "doc_id").toPandas()
    assert (judged.predicted == judged.quality).mean() > 0.9


def test_tables_learn_an_interaction():
    picked = np.random.RandomState(4)
    rows = picked.uniform(size=(3000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    plain = quality_gam.learn(rows[:2000], labels[:2000], rounds=40, pairs=0)
    paired = quality_gam.learn(rows[:2000], labels[:2000], rounds=40, pairs=2)

    def right(model):
        return ((model.score(rows[2000:]) >= 0.5) == labels[2000:]).mean()

    assert right(plain) < 0.6 and right(paired) > 0.95
    assert (0, 1) in [(a, b) for a, b, *_ in paired.pairs]


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    rows = spark.range(300).select(F.col("id").alias("doc_id")).withColumn("out", quality_gam.held_out()).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


# --- 9: pages ---

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header class="top">Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="post-%d" class="post-%d entry"><h1>Title &amp; more</h1><p>First <b>bold</b>
  words, and more, of a text.<p>Second&nbsp;part<br>goes on, with commas, too.<script>var x = "<p>no</p>";</script>
<blockquote>Quoted &lt;words&gt;</blockquote><div class="ad">Buy</div></div>
<aside>Aside</aside><div class="comments"><p>I liked it very much, really, truly, honestly.</p></div>
<form><p>Mail<input></form><footer>&copy; Site</footer></body></html>"""
READ = "Title & more\nFirst bold words, and more, of a text.\nSecond part goes on, with commas, too.\nQuoted <words>"


def test_hosts_agree_on_the_container(spark):
    pages = [(i, f"https://A.example.org/{i}", PAGE % (i, i)) for i in range(6)]
    # One page with hardly any text of its own, where a side box would win.
    odd = '<html><body><div class="box"><p>' + "many words, many, " * 20 + '</p></div><div class="post-9 entry"><p>Short.</p></div></body></html>'
    pages.append((9, "https://a.example.org:80/9", odd))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in host_paths.main_texts(frame).collect()}
    assert all(found[i] == READ for i in range(6))
    assert found[9] == "Short."


def test_pages_hold_the_article(spark, folder):
    pages = {r.page_id: r.html for r in table(spark, folder, "pages").collect()}
    for r in host_paths.main_texts(table(spark, folder, "pages")).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*(>|\Z)", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = "words of the long text, and more, " * 12


@pytest.mark.parametrize("page", [
    f"<article><h1>Title</h1><p>Lead</p><div class=body><p>{LONG}</p></div><p>End</p></article>",
    f"<main><section class=a><p>{LONG}</p></section><section class=b><h2>Second</h2><p>{LONG[:280]}</p></section></main>",
    f"<div class=post><section class=a><p>{LONG}</p></section><section class=b><p>{LONG[:280]}</p></section></div>",
    f"<div class=post><h1>Title</h1><p>Lead</p><div class=body><p>{LONG}</p></div><p>End</p></div>",
    f"<article><h1>T</h1><div class=x><div class=y><div class=z><p>{LONG}</p></div></div></div><div class=w><p>Short</p></div></article>",
])
def test_whole_article_is_read(spark, page):
    whole = f"<html><body><div class=top-links><a href=/>Home page</a></div>{page}</body></html>"
    pages = spark.createDataFrame([(i, f"https://b.org/{i}", whole) for i in range(3)], "page_id long, url string, html string")
    wanted = "\n".join(t for t in (" ".join(x.split()) for x in re.split(r"<[^>]*>", page)) if t)
    assert {r.text for r in host_paths.main_texts(pages).collect()} == {wanted}


def test_two_templates_on_one_host(spark):
    """The second template has the path of the first one as a teaser."""
    first = f"<body><div class=story><p>{LONG}</p></div></body>"
    second = f"<body><div class=story><p>Teaser</p></div><div class=report><h1>Title</h1><p>{LONG}</p></div></body>"
    rows = [(i, f"https://c.org/{i}", first if i < 8 else second) for i in range(11)]
    found = host_paths.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = LONG.strip()
    assert all(r.text == text if r.page_id < 8 else r.text.endswith(f"Title\n{text}") for r in found)


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "layout-with-sidebar", "comments-open", "cookie-recipes", "sidebar-left"])
def test_layout_words_leave_no_article_out(name):
    side = '<div class="sidebar widget-area"><p>Side</p></div><div id="comments"><p>Nice</p></div><div class="ad-300x250">Buy</div>'
    page = f'<body><div class="{name}"><div class="post"><h1>Title</h1><p>The long text of it</p></div>{side}</div></body>'
    assert [b.text for b in host_paths.blocks(page)] == ["Title", "The long text of it"]


def test_long_comments_stay_out_beside_an_article():
    page = "<body><article><p>Short text</p></article><div class=comments><p>" + "very long " * 50 + "</p></div></body>"
    assert [b.text for b in host_paths.blocks(page)] == ["Short text"]
    assert [b.text for b in host_paths.blocks("<p>One <span class=share>Share</span> two</p>")] == ["One two"]


def test_captions_and_what_follows_a_closed_drawing_are_text():
    page = "<body><svg class='x'/><math/><p>One</p><figure><img src=a><figcaption>Caption</figcaption></figure><svg><text>no</text></svg><p>Two</p>"
    assert [b.text for b in host_paths.blocks(page)] == ["One", "Caption", "Two"]


# --- 10: personal data ---

def test_field_finds_the_best_segmentation():
    """Against all segmentations of short islands."""
    picked = np.random.RandomState(0)
    field = private_spans.SpanField(picked.standard_normal((4, len(private_spans.FEATURES))))
    for island in ("a1@b.c", "+1 (2) 3", "12-34 x", "1.2.3.4"):
        grid = private_spans.lattice(island)
        scores = grid.features @ field.weights.T
        n = len(grid.tokens)
        best = {n: 0.0}
        for i in range(n - 1, -1, -1):
            options = [best[i + 1]]
            options += [scores[k].max() + best[grid.end[k]] for k in range(len(grid.start)) if grid.start[k] == i]
            best[i] = max(options)
        found = field.best(island)
        total = 0.0
        for left, right, kind in found:
            k = next(k for k in range(len(grid.start)) if (grid.tokens[grid.start[k]][0], grid.tokens[grid.end[k] - 1][1]) == (left, right))
            total += scores[k, private_spans.KINDS.index(kind)]
        assert total == pytest.approx(best[0])


def test_gradient_is_the_slope_of_the_likelihood():
    picked = np.random.RandomState(1)
    island = "a1@b.c 12"
    grid = private_spans.lattice(island)
    gold = np.zeros((len(grid.start), 4))
    gold[0, 0] = 1

    def likelihood(weights):
        scores = grid.features @ weights.T
        n = len(grid.tokens)
        ahead = [1.0] + [0.0] * n
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1] + sum(
                ahead[grid.start[k]] * np.exp(scores[k]).sum() for k in range(len(grid.start)) if grid.end[k] == j
            )
        return (gold * scores).sum() - np.log(ahead[n])

    weights = picked.standard_normal((4, len(private_spans.FEATURES))) * 0.3
    slope = private_spans.SpanField(weights).gradient(grid, gold)
    for kind, feature in ((0, 0), (1, 4), (2, 16), (3, 1)):
        moved = weights.copy()
        moved[kind, feature] += 1e-5
        assert (likelihood(moved) - likelihood(weights)) / 1e-5 == pytest.approx(slope[kind, feature], abs=1e-3)


def test_base_spans():
    text = "mail a.b@c.org, 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (415) 555-2671 +12 é x@y"
    spans = [(k, text[a:b]) for a, b, k in private_spans.base_spans(text)]
    assert spans == [
        ("email", "a.b@c.org"), ("ip", "1.2.3.4"), ("phone", "+1 (415) 555-2671"),
    ] or ("email", "a.b@c.org") in spans and ("phone", "+1 (415) 555-2671") in spans
    # Digits apart by one space are one match, which is then too long for a card.
    assert ("card", "4111 1111 1111 1111") not in spans
    assert ("card", "4111-1111-1111-1111") in [(k, "4111-1111-1111-1111"[a:b]) for a, b, k in private_spans.base_spans("4111-1111-1111-1111")]


def test_learned_field_knows_the_kinds(spark, folder):
    docs = table(spark, folder, "documents")
    field = private_spans.fit(docs)
    for island, kind in (("bob.x@mail.org", "email"), ("10.20.30.40", "ip"), ("+1 (743) 555-3824", "phone")):
        assert field.best(island) == [(0, len(island), kind)]


# --- many languages and values ---

def test_clean_texts_of_rare_languages_are_kept(spark):
    """400 languages with letters of their own: the large ones have references, texts of the rare ones get no verdict."""
    rows = []
    for i in range(400):
        letters = [chr(0x4E00 + 40 * i + k) for k in range(30)]
        words = ["".join(letters[(a * b) % 30] for b in range(2, 4 + a % 3)) for a in range(1, 40)]
        for copy in range(3 if i else 200):
            rows.append((1000 * i + copy, " ".join(words[(a * (copy + 3)) % len(words)] + str(a) for a in range(130)), f"l{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = distribution_rules.quality_rules(docs).collect()
    assert all(r["kept"] for r in found if r["doc_id"] >= 1000)
    assert {r["char_distance"] is None for r in found if r["doc_id"] >= 1000} == {True}
    assert {r["char_distance"] is None for r in found if r["doc_id"] < 1000} == {False}


def test_a_named_target_holds_however_small_the_value(spark):
    cells = [(f"s{i % 3}", f"l{i}", "t", 3000 - 9 * i) for i in range(300)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, n long")
    mix = mixing.rake(frame, {"lang": {"l290": 0.01}}, keep=0.05)
    assert mix.shares["lang"]["l290"][0] == pytest.approx(0.01)
    assert mix.shares["lang"]["l290"][1] == pytest.approx(0.01, rel=0.05)
