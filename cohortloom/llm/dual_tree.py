"""Ranked lexical search by dual trees: bounds between groups of items and groups of documents, exact scores for the rest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import arrow_pass, keyed_text
from cohortloom.session import drop_written, materialise

K = 20
ITEM_LEAF = 4          # items of a leaf of their tree
DOC_LEAF = 16          # documents of a leaf
CHUNK = 1024           # documents of one tree
AXES = 8               # directions that the trees split along
BLOCK_CELLS = 4 << 20  # items x terms of a block of items, and documents x terms of a tree
TRIAL = 32             # one document of so many gives the first thresholds

_SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])).encode()
_TO_TERMS = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, with A-Z lower-cased."""
    return text.translate(_TO_TERMS).split()


@dataclass
class Tree:
    """A binary tree: children's numbers (-1: none), rows as a range of ``order``, coordinate maxima."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    top: np.ndarray   # nodes x terms


def grow(points: np.ndarray, axes: np.ndarray, leaf: int) -> Tree:
    """Split the rows of ``points`` at the median along the axis on which they spread most, down to ``leaf`` rows."""
    at, order = points @ axes, np.arange(len(points))
    first, last, left, right = [0], [len(points)], [-1], [-1]
    me = 0
    while me < len(first):  # nodes are numbered as they are made, children after their parent
        a, b = first[me], last[me]
        if b - a > leaf:
            here = at[order[a:b]]
            axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
            order[a:b] = order[a:b][np.argsort(here[:, axis], kind="stable")]
            middle = (a + b) // 2
            left[me], right[me] = len(first), len(first) + 1
            first += [a, middle]
            last += [middle, b]
            left += [-1, -1]
            right += [-1, -1]
        me += 1
    top = np.zeros((len(first), points.shape[1]), dtype=points.dtype)
    for me in reversed(range(len(first))):
        top[me] = points[order[first[me]:last[me]]].max(axis=0) if left[me] < 0 else np.maximum(top[left[me]], top[right[me]])
    return Tree(order, np.array(first), np.array(last), np.array(left), np.array(right), top)


def directions(points: np.ndarray) -> np.ndarray:
    """terms x axes: the main directions of the rows brought to length one."""
    norm = np.sqrt(np.square(points.astype(float)).sum(axis=1, keepdims=True))
    unit = points / np.where(norm > 0, norm, 1.0)
    u, s, v = np.linalg.svd(unit @ unit.T, hermitian=True)
    k = min(AXES, len(points))
    return unit.T @ (u[:, :k] / np.sqrt(np.where(s[:k] > 1e-9, s[:k], 1.0)))


class Items:
    """A block of items as weights by term, with their tree; shipped to the tasks."""

    def __init__(self, weights: np.ndarray):
        # sums of products below 2^53 are exact in doubles, whatever their order
        exact = weights.sum(axis=1, dtype=float).max(initial=0.0) * 1e6 < 2 ** 53
        self.weights = weights.astype(np.float64 if exact else np.int64)
        self.axes = directions(weights)
        self.tree = grow(self.weights, self.axes, ITEM_LEAF)
        t = self.tree
        self.rows = [t.order[a:b] for a, b in zip(t.first, t.last)]

    def weakest(self, kth: np.ndarray) -> np.ndarray:
        """The smallest k-th score among the items of every node."""
        return np.array([kth[r].min() for r in self.rows])


class Best:
    """The k best (score, key) of every item; equal scores by key, null keys last."""

    def __init__(self, items: Items, k: int, floor: np.ndarray):
        self.items, self.k, self.floor = items, k, floor
        self.found: list[list[tuple]] = [[] for _ in floor]   # (-score, key is null, key), ascending
        self.kth = floor.astype(np.int64).copy()
        self.weakest = items.weakest(self.kth)

    def add(self, item: int, scores: np.ndarray, keys: list) -> bool:
        """Take in candidates of one item; True if its k-th score rose."""
        now = sorted([*self.found[item], *((-int(s), key is None, key or 0) for s, key in zip(scores, keys))])[:self.k]
        self.found[item] = now
        if len(now) == self.k and -now[-1][0] > self.kth[item]:
            self.kth[item] = -now[-1][0]
            return True
        return False


def search_tree(best: Best, docs: Tree, points: np.ndarray, keys: list) -> int:
    """Walk both trees from their roots; returns the number of (item, document) scores computed.

    A pair of nodes whose bound, the product of their coordinate maxima, is below the weakest k-th score of the node's
    items cannot hold a result, nor can anything below it.  Equal bounds go on, because a smaller key wins a tie.
    """
    items, scored = best.items, 0
    tops, tree, weights = items.tree.top, items.tree, items.weights

    def alive(nodes: np.ndarray, top: np.ndarray) -> np.ndarray:
        bound = tops[nodes] @ top
        return nodes[(bound >= best.weakest[nodes]) & (bound > 0)]

    def below(nodes: np.ndarray) -> np.ndarray:
        inner = tree.left[nodes] >= 0
        return np.concatenate([nodes[~inner], tree.left[nodes[inner]], tree.right[nodes[inner]]])

    open_pairs = [(0, np.zeros(1, dtype=np.int64))]
    while open_pairs:
        node, nodes = open_pairs.pop()
        top = docs.top[node]
        nodes = alive(nodes, top)
        if not len(nodes):
            continue
        if docs.left[node] >= 0:
            sides = sorted((docs.left[node], docs.right[node]), key=lambda d: float(tops[0] @ docs.top[d]))
            open_pairs += [(side, below(nodes)) for side in sides]  # the side of the larger bound is next
            continue
        while len(nodes) and (tree.left[nodes] >= 0).any():
            nodes = alive(below(nodes), top)
        if not len(nodes):
            continue
        rows = docs.order[docs.first[node]:docs.last[node]]
        asked = np.concatenate([items.rows[n] for n in nodes])
        scores = weights[asked] @ points[rows].T
        scored += scores.size
        rose = False
        good = (scores > 0) & (scores >= best.kth[asked, None])
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            take = np.flatnonzero(good[i])
            rose |= best.add(int(asked[i]), scores[i, take], [keys[r] for r in rows[take]])
        if rose:
            best.weakest = items.weakest(best.kth)
    return scored


def document_terms(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, ids, counts) of every document with a term: all its terms, and those of ``vocabulary`` with their counts."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, n, ids, counts = [], [], [], []
        for i, t in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
            terms = terms_of(t)
            if terms:
                have = {vocabulary[w]: c for w, c in Counter(terms).items() if w in vocabulary}
                rows.append(i)
                n.append(len(terms))
                ids.append(list(have))
                counts.append(list(have.values()))
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                                           pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=[key, "n", "ids", "counts"])

    return arrow_pass(keyed_text(docs, key, text), run, f"{key} long, n long, ids array<int>, counts array<long>")


def corpus_counts(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and documents by vocabulary term: one small array of sums per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, dtype=np.int64)
        for batch in batches:
            total[size] += batch.num_rows
            total[size + 1] += int(batch.column("n").to_numpy().sum()) if batch.num_rows else 0
            total[:size] += np.bincount(batch.column("ids").flatten().to_numpy(zero_copy_only=False), minlength=size)[:size].astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "c"])

    out = np.zeros(size + 2, dtype=np.int64)
    for r in found.select("n", "ids").mapInArrow(run, "term int, c long").groupBy("term").agg(F.sum("c").alias("c")).collect():
        out[r["term"]] = r["c"]
    return int(out[size]), int(out[size + 1]), out[:size]


def impacts(n: np.ndarray, counts: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's share of a score per unit of weight, from the length of its document and its count there, in integers."""
    m = 100 - 25 + (25 * n * documents) // terms
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def best_of_tasks(found: DataFrame, items: Items, size: int, documents: int, terms: int, k: int, floor: np.ndarray, key: str) -> DataFrame:
    """(item, key, score): the k best of every task and item, none below ``floor``."""
    chunk = max(DOC_LEAF, min(CHUNK, BLOCK_CELLS // max(size, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k, floor)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                lengths = part.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), lengths)
                if not len(row):
                    continue
                n, counts = part.column("n").to_numpy(), part.column("counts").flatten().to_numpy(zero_copy_only=False)
                points = np.zeros((part.num_rows, size), dtype=items.weights.dtype)
                points[row, part.column("ids").flatten().to_numpy(zero_copy_only=False)] = impacts(n[row], counts, documents, terms)
                search_tree(best, grow(points, items.axes, DOC_LEAF), points, part.column(key).to_pylist())
        out = [(i, None if null else doc, -score) for i, rows in enumerate(best.found) for score, null, doc in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()),
                                          pa.array([r[2] for r in out], pa.int64())], names=["item", key, "score"])

    return found.mapInArrow(run, f"item int, {key} long, score long")


def item_blocks(items: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[Counter], dict[bytes, int]]]:
    """Items in blocks of a bounded number of cells (items x different terms), one partition at a time on the driver."""
    ids, counts, vocabulary = [], [], {}
    for r in items.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        c = Counter(terms_of(r["t"].encode()))
        new = [w for w in c if w not in vocabulary]
        if ids and (len(ids) + 1) * (len(vocabulary) + len(new)) > BLOCK_CELLS:
            yield ids, counts, vocabulary
            ids, counts, vocabulary, new = [], [], {}, list(c)
        for w in new:
            vocabulary[w] = len(vocabulary)
        ids.append(r["i"])
        counts.append(c)
    if ids:
        yield ids, counts, vocabulary


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k documents of highest score above zero for every item.

    Terms are runs of digits, letters and characters beyond ASCII.  A score sums, over an item's terms with repeats, a
    whole weight by how few documents hold the term times the term's whole impact in the document; all sums are exact.
    Equal scores go by ascending key, null keys last.

    Items are read in blocks of bounded size (:data:`BLOCK_CELLS`); a block is one pass over the texts, which writes each
    document's counts of the block's terms, and two passes over those.  A task puts its documents into trees of at most
    1,024, a block's items are a tree too, and both are walked together: pairs of nodes bounded below the items'
    weakest k-th score are left out with all below them.  Thresholds come from one document in 32 before all are
    searched; they only save work.  A task returns at most k rows an item, and Spark ranks those.

    Null and empty texts have no terms and no rank, items without terms no rows; repeated items and documents count
    each on its own; empty tables give no rows.
    """
    out = None
    for ids, counts, vocabulary in item_blocks(items, item, item_text):
        size = len(vocabulary)
        found = materialise(document_terms(docs, vocabulary, key, text), "search-terms")
        documents, terms, df = corpus_counts(found, size)
        if not size or not documents:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        table = np.zeros((len(ids), size), dtype=np.int64)
        for i, c in enumerate(counts):
            for w, times in c.items():
                table[i, vocabulary[w]] = times * weight[vocabulary[w]]
        block = Items(table)
        having = found.filter(F.size("ids") > 0)
        trial = best_of_tasks(having.filter(F.pmod(F.xxhash64(key, "n"), F.lit(TRIAL)) == 0), block, size, documents, terms, k,
                              np.zeros(len(ids)), key)
        by_score = Window.partitionBy("item").orderBy(F.desc("score"))
        floor = np.zeros(len(ids), dtype=np.int64)
        for r in trial.withColumn("_at", F.row_number().over(by_score)).filter(F.col("_at") <= k).groupBy("item").agg(
                F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).collect():
            floor[r["item"]] = r["s"]
        best = best_of_tasks(having, block, size, documents, terms, k, floor, key)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(key))
        names = F.array(*[F.lit(i).cast("long") for i in ids])
        ranked = best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
            F.get(names, "item").alias(item), "rank", key, "score")
        ranked = materialise(ranked, "search-ranks")
        drop_written(found)
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{item} long, rank int, {key} long, score long")
    return out
