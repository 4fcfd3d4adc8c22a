"""Source mixing against a plain version with sorting."""

import hashlib
import re

import pytest

from cohortloom.llm import queries, source_mix


def plain_mix(rows, weights=(5, 2, 1), most=3, seed=7):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full, left = set(), sum(size)
    while True:
        free = [s for s in sources if s not in full]
        share = (left - sum(most * total[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if most * total[s] < weight[s] * share}
        if not over:
            break
        full |= over
    target = {s: most * total[s] if s in full else weight[s] * share for s in sources}

    def hashed(key):
        return int(hashlib.md5(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:15], 16)

    copies = {}
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        room = target[s] - whole * total[s]
        by_hash = {}
        for n, (k, _, src) in zip(size, rows):
            if src == s:
                by_hash[hashed(k)] = by_hash.get(hashed(k), 0) + n
        chosen = set()
        for h in sorted(by_hash):
            if by_hash[h] <= room:
                chosen.add(h)
                room -= by_hash[h]
        copies[s] = whole, chosen
    return sorted(((k, n, total[s], target[s], n * (copies[s][0] + (hashed(k) in copies[s][1]))) for n, (k, _, s) in zip(size, rows)),
                  key=str)


def check(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    got.sort(key=lambda r: str((r[0], r[1], r[2])))
    want.sort(key=lambda r: str((r[0], r[1], r[2])))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9) and g[4] == w[4]


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op5_source_mix(spark, small).collect()
    check(got, plain_mix(rows))
    taken, target = {}, {}
    for r, (_, _, source) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows)):
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    assert all(0.88 * target[s] <= taken[s] <= target[s] for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op5_source_mix(spark, small).collect()))


@pytest.mark.parametrize("rows", [
    [(1, "a b c", "x"), (2, "a", "y"), (3, None, None), (4, "", "z"), (5, "q " * 50, None)],
    [(i, "w " * (i % 7), ["big", "b", None, "é"][0 if i % 3 else i % 4]) for i in range(300)],
    [(1, "same row", "s")] * 5 + [(None, "a b", "s"), (None, None, "t")],
    [(1, "", "s"), (2, None, None)],
])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, target long")
    check(source_mix.mix_sources(docs).collect(), plain_mix(rows))
    taken = {}
    for k, n, _, _, t in plain_mix(rows):
        if n:
            taken[k] = taken.get(k, 0) + t // n
    got = {}
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if r.text and r.text.split():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in taken.items() if n}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mix.mix_sources(docs).count() == 0 and source_mix.mixed_documents(docs).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_key_are_split(spark, key):
    """Rows that share a key (or have none) are taken by content, so a target is missed by one of them at most."""
    rows = [(key, f"w{i} " * 10, "a") for i in range(200)] + [(i, f"v{i} " * 10, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix_sources(docs, weights=(1, 1)).collect()
    taken = sum(r.taken for r in got if r.doc_id == key and r.size == 10 and r.source_size == 2000)
    target = next(r.target for r in got if r.source_size == 2000)
    assert 0 < target < 2000 and target - 10 <= taken <= target
    mixed = sorted(tuple(r) for r in source_mix.mixed_documents(docs, weights=(1, 1)).select("text", "source").collect())
    assert sum(s == "a" for _, s in mixed) * 10 == taken
    again = source_mix.mixed_documents(docs.repartition(5), weights=(1, 1)).select("text", "source").collect()
    assert sorted(map(tuple, again)) == mixed
