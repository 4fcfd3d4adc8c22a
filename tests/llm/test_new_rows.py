"""Centroid clustering, line rules and ranked search against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import centroids, dual_tree, line_rules

ODD_TEXTS = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "q\nq\n q\nq", "é ü z é ü z é", "\t#*$ %&|<>\r\n", "w " * 60,
             "日本 語 日本 語 日本 語", "A b\na  b \nA b"]
DOCS = "doc_id long, text string, source string, n_words string, _row string, kept string, line string, _host string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, s, "n", "r", "k", "l", "h") for k, t, s in rows], DOCS)


def plain_clusters(vectors, k, rounds):
    """vectors: (id, integer array)."""
    start = sorted(vectors, key=lambda v: (hashlib.sha256(f"2:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1].tolist()))[:k]
    at = [v.copy() for _, v in start]

    def assign():
        return [min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(at)) for _, x in vectors]

    for _ in range(rounds):
        found = assign()
        for j in range(len(at)):
            mine = [x for (_, x), (_, c) in zip(vectors, found) if c == j]
            if mine:
                at[j] = np.sum(mine, axis=0) // len(mine)
    found = assign()
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest())
                   for (i, _), (d, c) in zip(vectors, found))


SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string"


@pytest.mark.parametrize("k", [3, 40])
def test_centroids(spark, k):
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=8) + rng.integers(0, 3)).astype(np.float32)) for i in range(120)]
    good += [(7, good[3][1]), (None, good[4][1]), (None, good[5][1]), (200, good[0][1]), (200, good[0][1])]
    bad = [(300, None), (301, [1.0] * 7), (302, [1.0] * 7 + [None]), (303, [1.0] * 7 + [float("nan")]), (304, [1.0] * 7 + [float("inf")]), (305, [])]
    rows = [(i, [float(x) for x in v], "c", "d", "v") for i, v in good] + [(i, v, "c", "d", "v") for i, v in bad]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=k, width=8)
    vectors = [(i, np.floor(256 * v.astype(float)).astype(np.int64)) for i, v in good]
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == plain_clusters(vectors, k, 5)


def test_centroids_few_and_wide(spark):
    rows = [(1, [1e30, 0.0], "c", "d", "v"), (2, [-1e30, 0.0], "c", "d", "v")]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=5, width=2).collect()
    assert sorted(r.distance for r in got) == [0, 0] and len({r.cluster for r in got}) == 2
    far = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=1, rounds=0, width=2).collect()
    assert max(r.distance for r in far) == (2 * centroids.WIDEST) ** 2
    none = centroids.cluster_vectors(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_rules(rows, least, share, depleted=50):
    space = re.compile(r"[\x20\x09-\x0D]+")
    lines = defaultdict(set)
    host_docs = defaultdict(set)
    for _, t, s in rows:
        t = t or ""
        host_docs[s].add(t)
        for x in t.split("\n"):
            if space.sub("", x):
                lines[s, space.sub(" ", x).strip(" ").lower()].add(t)
    out = []
    for k, t, s in rows:
        t = t or ""
        words = [w for w in space.split(t) if w]
        grams = Counter(zip(words, words[1:], words[2:]))
        places = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
        wordy = [x for x in t.split("\n") if space.sub("", x)]
        gone = [(i, x) for i, x in enumerate(t.split("\n")) if space.sub("", x) and len(lines[s, space.sub(" ", x).strip(" ").lower()]) > max(least, share * len(host_docs[s]))]
        removed = sum(len([w for w in space.split(x) if w]) for _, x in gone)
        failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
        out.append((k, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(wordy) - len(set(wordy)), len(places), failed,
                    not failed and 100 * removed <= depleted * len(words), tuple(i for i, _ in gone), removed))
    return Counter(out)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed", "words_removed"]


def rule_rows():
    rng = random.Random(8)
    rows = [(i, t, "h") for i, t in enumerate(ODD_TEXTS)] + [(3, "a b c", "h"), (3, "a b c", "h"), (None, "a b c", None)]
    for i in range(90):
        lines = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(3, 9))]
        lines.insert(rng.randrange(len(lines)), rng.choice(["Terms of  use apply ", "terms of use\tapply", "All rights reserved."]))
        if i % 9 == 0:
            lines = ["menu " * 3 + "a b c d e f g h i j k l m n o p q r s t u v w x y z"] * 2 + lines[:3]
        rows.append((100 + i, "\n".join(lines), ["h", "g", None][i % 3]))
    rows += [(400 + i, rows[-1][1], "h") for i in range(30)]  # copies are one document
    return rows


@pytest.mark.parametrize("least,share", [(5, 0.01), (0, 0.5), (2, 0.0)])
def test_line_rules(spark, least, share):
    rows = rule_rows()
    got = line_rules.line_rules(docs_of(spark, rows), F.col("source"), least=least, share=share)
    assert Counter(tuple(tuple(r[c]) if c == "removed" else r[c] for c in NAMES) for r in got.collect()) == plain_rules(rows, least, share)


def test_cleaned_documents(spark):
    rows = rule_rows()
    docs = docs_of(spark, rows)
    got = line_rules.cleaned_documents(docs, F.col("source"), least=2, share=0.0)
    assert got.columns == docs.columns
    want = []
    for (k, t, s), r in zip(rows, [x for row in rows for x in plain_one(rows, row)]):
        if r[7]:
            want.append((k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in r[8]), s, "n", "r", "k", "l", "h"))
    assert Counter(map(tuple, got.collect())) == Counter(want) and want
    assert line_rules.line_rules(docs_of(spark, []), F.col("source")).count() == 0
    assert line_rules.cleaned_documents(docs_of(spark, []), F.lit(None)).count() == 0


def plain_one(rows, row):
    found = [r for r in plain_rules(rows, 2, 0.0) if r[0] == row[0] and r[1] == len([w for w in re.split(r"[\x20\x09-\x0D]+", row[1] or "") if w])]
    return found[:1]


def test_line_rules_long_text(spark):
    """Some megabytes in one text, and the same line in it thousands of times."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(300_000)]
    text = "\n".join(" ".join(words[i:i + 10]) for i in range(0, len(words), 10)) + "\nsame line here" * 3000
    rows = [(1, text, "h"), (2, "a b c", "h")]
    got = line_rules.line_rules(docs_of(spark, rows), F.col("source"))
    assert Counter(tuple(tuple(r[c]) if c == "removed" else r[c] for c in NAMES) for r in got.collect()) == plain_rules(rows, 5, 0.01)


def plain_search(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(d, term.findall((t or "").translate(low))) for d, t in docs]
    n_docs, total = sum(1 for _, t in texts if t), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    out = []
    for item, t in items:
        asked = Counter(term.findall((t or "").translate(low)))
        scores = []
        for d, words in texts:
            tf = Counter(words)
            m = 75 + (25 * len(words) * n_docs) // total if total else 0
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * tf[w]) // (1000 * tf[w] + 12 * m))
                    for w, c in asked.items() if w in tf)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def random_texts(rng, n, vocabulary):
    return [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("cells,chunk", [(dual_tree.BLOCK_CELLS, 1024), (400, 40)])
def test_ranked_search(spark, monkeypatch, cells, chunk):
    """Every rank, with ties, repeated rows and blocks of a few items, equals brute force."""
    monkeypatch.setattr(dual_tree, "BLOCK_CELLS", cells)
    monkeypatch.setattr(dual_tree, "CHUNK", chunk)
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefghé日" for b in "xyz0189"]
    texts = random_texts(rng, 500, vocabulary)
    texts += [texts[3]] * 30 + [texts[5].upper().replace(" ", "--")] * 25 + [None, "", "--", "A" * 3000, " "]
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])] * 3
    items = list(enumerate(random_texts(rng, 25, vocabulary))) + [(100, texts[3]), (101, texts[3] + " " + texts[3]), (102, None), (103, "nothing known"), (None, texts[5]), (5, "ax")]
    frame = spark.createDataFrame([(d, t, "n", "i") for d, t in docs], "doc_id long, text string, n string, ids string").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = Counter(map(tuple, dual_tree.ranked_search(frame, asked).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == plain_search(docs, items)


def test_ranked_search_empty(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    for d, i in ((spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], items)), (some, spark.createDataFrame([], items)),
                 (some, spark.createDataFrame([(1, None), (2, "")], items)), (spark.createDataFrame([(1, None)], docs), spark.createDataFrame([(1, "a")], items))):
        got = dual_tree.ranked_search(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_long_text(spark):
    docs = [(i, t) for i, t in enumerate(["needle " + "hay " * 400_000, "needle needle hay", "hay " * 30, "needle", "x y z"])]
    items = [(1, "needle hay " * 50), (2, "z " * 2000)]
    got = dual_tree.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == plain_search(docs, items)


def test_trees_leave_work_out():
    """With groups of related documents most node pairs are cut, and the best are still found."""
    rng = np.random.default_rng(1)
    group = np.repeat(np.arange(32), 32)
    points = np.where(np.arange(256)[None] // 8 == group[:, None], rng.integers(100_000, 900_000, (1024, 256)), 0).astype(float)
    weights = np.where(np.arange(256)[None] // 8 == np.arange(32)[:, None], rng.integers(1, 9000, (32, 256)), 0)
    items = dual_tree.Items(weights)
    best = dual_tree.Best(items, 20, np.zeros(32))
    scored = dual_tree.search_tree(best, dual_tree.grow(points, items.axes, dual_tree.DOC_LEAF), points, list(range(1024)))
    full = weights @ points.T
    for i in range(32):
        want = sorted(((-int(s), False, d) for d, s in enumerate(full[i]) if s > 0))[:20]
        assert best.found[i] == want
    assert scored < 0.2 * full.size
