"""Duplicates, fingerprints and packing against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import exact_dedup, fingerprint, packing, quality, queries, simhash

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, n int, size string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1, "x", 2, "y", "z") for k, t in rows], COLUMNS)


ODD = [(1, "a b"), (2, "a  b"), (3, "a\n b"), (4, "a b "), (5, None), (6, ""), (7, " "), (7, " "), (8, "A B"), (None, "a b"), (None, None),
       (9, "a b"), (9, "a b"), (10, "q r"), (11, "q r"), (12, "w " * 3000), (12, "other text"), (0, "\t")]


def roots(links, nodes):
    """Smallest node reachable."""
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n
    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_exact_duplicates(spark):
    got = exact_dedup.exact_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    clean = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ODD]
    want = []
    seen = set()
    for (k, _), c in zip(ODD, clean):
        keys = [x for (x, _), d in zip(ODD, clean) if d == c]
        keep = min((x for x in keys if x is not None), default=None)
        kept = k == keep and c not in seen
        seen |= {c} if kept else set()
        want.append((k, keep, len(keys), kept, hashlib.sha256(c.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stay = exact_dedup.without_copies(frame(spark, ODD)).collect()
    assert sorted(((r.doc_id, r.text) for r in stay), key=str) == sorted(
        {(k, c): (k, t) for (k, t), c, w in reversed(list(zip(ODD, clean, want))) if w[3]}.values(), key=str) or len(stay) == len(set(clean))


def test_exact_duplicates_merge(spark):
    """Filters of many partitions, built and flushed in small parts, count as one."""
    rng = random.Random(1)
    prints = [rng.choice([rng.getrandbits(64), 5, 5 << 40, (1 << 64) - 1]) for _ in range(5000)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(13)
    got = {r.fp: r.n for r in exact_dedup.repeated_prints(df, flush=100).collect()}
    assert got == {p: signed.count(p) for p in {5, 5 << 40, -1}}
    one = exact_dedup.QuotientFilter.of(np.array(prints, dtype=np.uint64), np.ones(len(prints), dtype=np.int64), 40)
    back = exact_dedup.QuotientFilter.from_bytes(one.to_bytes(), 40)
    assert (back.prints() == np.unique(np.array(prints, dtype=np.uint64))).all() and back.counts.sum() == len(prints)


def plain_print(text, width):
    words = (text or "").encode().lower().split()
    runs = [words] if 0 < len(words) <= width else [words[i:i + width] for i in range(len(words) - width + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op7_simhash(spark, small).collect()}
    prints = {d.doc_id: plain_print(d.text, 3) for d in docs}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(links, prints)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got if r.fp == 0} == {(k, 0) for k in (None, 0, 5, 6, 7)}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in simhash.near_duplicates(frame(spark, [(None, "x")])).select("doc_id", "component_id").collect()] == [(None, None)]


@pytest.mark.parametrize("crowded", [0, 3, 64])
def test_close_pairs_lose_no_link(spark, crowded):
    """Blocks linked through one-bit neighbours give the components of all pairs."""
    rng = random.Random(2)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(12)):
            prints.add(p)
            for _ in range(rng.randrange(4)):
                p ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded=crowded)
    found = [tuple(r) for r in edges.collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in found)
    every = [(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & mask).bit_count() <= 2]
    assert roots(found, signed) == roots(every, signed)


def test_components(spark):
    from cohortloom.llm.components import components
    rng = random.Random(4)
    nodes = range(400)
    edges = [(i, i + 1) for i in range(100)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(edges, nodes)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


INNER = ("_doc", "doc", "_row", "_k", "k", "_x", "x", "fp", "stays", "n", "text_sha256", "text_sha256_", "keep_id", "same", "_text", "_host", "_path", "keep",
         "_class", "component_id", "size", "_sort", "take", "target", "node", "block", "e", "s")


def test_stages_keep_columns_of_any_name(spark, small):
    """Every filtering stage returns its rows as they came, also with columns named like its own."""
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in INNER})
    want = {r.doc_id: r.asDict() for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "exact_dedup", "near_dedup", "mix"):
        out = stages[name](spark, docs, small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r.asDict() == want[r.doc_id] for r in rows), name


def test_without_near_copies(spark, small):
    """One document of every class of fingerprints stays: that of the smallest key."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = {r.doc_id: r.component_id for r in queries.op7_simhash(spark, small).collect()}
    assert sorted(r.doc_id for r in simhash.without_near_copies(docs).collect()) == sorted(k for k, c in names.items() if k == c)


def test_without_near_copies_odd_rows(spark):
    kept = simhash.without_near_copies(frame(spark, ODD))
    assert kept.columns == frame(spark, []).columns
    prints = {}
    for k, t in ODD:
        prints.setdefault(plain_print(t, 3), []).append((k is None, k or 0, t or ""))
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2]
    classes = {}
    for p, root in roots(links, prints).items():
        classes.setdefault(root, []).extend(prints[p])
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted(min(rows)[:2] for rows in classes.values())
    assert simhash.without_near_copies(frame(spark, [])).count() == 0
    assert [r.doc_id for r in simhash.without_near_copies(frame(spark, [(None, "x")] * 3)).collect()] == [None]


def test_fingerprints(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in queries.op10_fingerprint(spark, small).collect()}

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    off, by_text = [], {}
    for i, d in enumerate(docs):
        n, after = len(d.text), docs[(i + 1) % len(docs)]
        edited = d.text[:n - n // 2] + after.text[:n // 2]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(d.text), shingles(edited), shingles(after.text)
        off += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint and got[after.doc_id].fingerprint is not None
    assert np.abs(off).mean() < 0.03 and np.abs(off).max() < 0.2
    assert abs(np.mean(off[::2])) < 0.01


def test_fingerprints_odd_rows(spark):
    got = fingerprint.edited_fingerprints(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(r.fingerprint == "" and r.near_edited == 1 for r in got if r.doc_id in (5, 6))
    assert fingerprint.edited_fingerprints(frame(spark, [])).count() == 0
    one = fingerprint.edited_fingerprints(frame(spark, [(3, "ab cd ef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab c" + b"ab c").hexdigest()
    assert one.near_next == 1


def test_likeness_is_unbiased(spark):
    """Estimates over pairs of known likeness, sparse sets included."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        n = [8, 40, 400][i % 3]
        words = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        keep = n // 2
        rows.append((i, " ".join(words), " ".join(words[:keep] + [f"w{rng.getrandbits(40)}" for _ in range(n - keep)])))
    df = spark.createDataFrame(rows, "i long, a string, b string").withColumns(
        {"p": fingerprint.fingerprint(F.col("a")), "q": fingerprint.fingerprint(F.col("b"))})
    off = {8: [], 40: [], 400: []}
    for r in df.select("i", fingerprint.likeness(F.col("p"), F.col("q")).alias("l")).collect():
        n = [8, 40, 400][r.i % 3]
        same, total = n // 2 - 4, n - 4
        off[n].append(r.l - same / (2 * total - same))
    assert abs(np.mean(off[8])) < 0.1 and abs(np.mean(off[40])) < 0.03 and abs(np.mean(off[400])) < 0.015


def check_packing(rows, docs, size=1024):
    tok = tokenizers.Tokenizer.from_file(VOCABULARY)
    want = []
    for k, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((k, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(w[3] for w in want) // size)


def test_packing(spark, small):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{small}/documents.parquet").collect()]
    used, least = check_packing(queries.op8_best_fit_packing(spark, small).collect(), docs)
    assert used <= least * 1.03 + 1


def test_packing_odd_rows(spark):
    rows = [*ODD, (20, "<|endoftext|> x  <|endoftext|>"), (21, "日本語   テ"), (22, "z" * 9000), (23, "word " * 1023), (24, "word " * 1024)]
    check_packing(packing.pack(frame(spark, rows), VOCABULARY).collect(), rows)
    assert packing.pack(frame(spark, []), VOCABULARY).count() == 0


def test_packing_plan_is_near_the_bound():
    rng = random.Random(8)
    for _ in range(5):
        histogram = {rng.randrange(1, 1025): rng.randrange(1, 3000) for _ in range(300)}
        plan = packing.make_plan(histogram, 1024)
        least = -(-sum(k * n for k, n in histogram.items()) // 1024)
        halves = sum(n for k, n in histogram.items() if k > 512)
        best = packing.best_fit(list(histogram), list(histogram.values()), 1024)
        assert max(least, halves) <= plan.sequences <= sum(best.values())
        for n, c in histogram.items():
            assert sum(int(plan.uses[p]) for length, p in zip(plan.length, plan.pattern) if length == n) >= c
    assert packing.make_plan({600: 10, 424: 10}, 1024).sequences == 10


def test_packing_plan_uses_the_linear_program(spark, small):
    """Where best fit fills badly, the program's patterns decide; on the documents most sequences are its patterns."""
    hard = {522: 600, 276: 600, 266: 600, 236: 1200}  # best fit, longest first: 1,200
    plan = packing.make_plan(hard, 1024)
    assert plan.sequences == plan.whole == 900 and abs(plan.bound - 900) < 1e-6
    assert sum(packing.best_fit(list(hard), list(hard.values()), 1024).values()) == 1200
    for folder, most in (("sf0.01", 1.005), ("sf0.1", 1.001)):
        docs = spark.read.parquet(f"{small.replace('sf0.001', folder)}/documents.parquet")
        histogram = {r["length"]: r["count"] for r in packing.pieces(docs, VOCABULARY).groupBy("length").count().collect()}
        plan = packing.make_plan(histogram, 1024)
        assert sum(k * n for k, n in histogram.items()) / 1024 <= plan.bound + 1e-6
        assert plan.bound <= plan.sequences <= most * plan.bound
        assert 2 * plan.whole > plan.sequences - histogram.get(1024, 0)
        patterns = {}
        for length, p in zip(plan.length, plan.pattern):
            patterns.setdefault(int(p), []).append(int(length))
        assert all(sum(held) <= 1024 for held in patterns.values())


def test_quality(spark, small):
    """Held-out accuracy, and posteriors that shrink with few documents."""
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, held = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    scores = quality.classify(docs, train, F.col("source"), F.col("lang"))
    wrong = scores.join(held, "doc_id").filter(F.col("keep") != (held["quality"] == 1)).count()
    assert wrong <= 0.01 * held.count()
    assert scores.count() == docs.count()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1), (None, 1), (99, None)], "doc_id long, quality int")
    scores = quality.classify(frame(spark, ODD), labels, F.col("source"), F.lit(None)).collect()
    assert len(scores) == len(ODD) and all(0 < r.quality < 1 for r in scores)
    none = labels.filter("quality = 2")
    assert {r.keep for r in quality.classify(frame(spark, ODD), none, F.col("source"), F.lit(None)).collect()} == {True}
    assert quality.classify(frame(spark, []), labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.good_documents(frame(spark, []), labels, F.col("source"), F.col("lang")).count() == 0
    kept = quality.good_documents(frame(spark, ODD), none, F.col("source"), F.col("lang"))
    assert kept.count() == len(ODD) and kept.columns == COLUMNS.replace(",", "").split()[::2]


def test_pipeline(spark, small):
    """Every stage on what its predecessor kept: right columns, only rows of its input, and effect."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in now.collect()}
        out = corpus_pipeline.materialise(stage(spark, now, small), f"test-{name}")
        if name != "pack":
            assert out.columns == docs.columns
            rows = [(r.doc_id, r.text) for r in out.collect()]
            assert set(rows) <= before
            assert name == "mix" or len(rows) == len(set(rows))
            if name == "near_dedup":  # one document of every class of fingerprints, that of the smallest key
                classes = simhash.near_duplicates(now, width=3).collect()
                assert sorted(k for k, _ in rows) == sorted(r.doc_id for r in classes if r.doc_id == r.component_id)
            counts[name] = len(rows)
            now = out
    packed = [(r.doc_id, r.text) for r in now.collect()]
    check_packing(out.collect(), packed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert counts["quality"] < docs.count() and counts["exact_dedup"] < counts["quality"] and counts["near_dedup"] <= counts["exact_dedup"]
    near = docs.limit(1).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**6), "text": F.concat("text", F.lit("  "))}))
    assert corpus_pipeline.near_stage(spark, near, small).count() == 1
    good = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, small).collect()}
    assert sum((labels[k] == 1) != (k in good) for k in labels) <= 0.02 * len(labels)


def test_pipeline_odd_rows(spark, small):
    now = frame(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, small), f"odd-{name}")
    assert now.count() > 0
    now = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, small), f"none-{name}")
    assert now.count() == 0
