"""Sparse and hybrid search of a query set against all rows, by blocks.

Rows (id, tokens, embedding; either may be missing) are packed into blocks: postings of hashed terms, and vectors.  A block of
queries meets a block of rows in numpy: terms that many rows of both have are one matrix product, the postings of the others are
multiplied and summed, cosines are added, and of all blocks that a task meets the ``k`` best go on.  So the plan moves blocks
and ``k`` rows for each query and task, never a row for each pair that has a word in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.knn import Best, distances, smallest

_BLOCK = "ids array<long>, terms binary, numbers binary, places binary, counts binary, dim int, data binary"
#: Share of the pairs of two blocks from which on a term goes into the matrix product: below, single products cost less.
_DENSE = 0.004


def packed(rows: DataFrame, per_block: int) -> DataFrame:
    """Blocks of up to ``per_block`` rows (id, terms as longs, embedding): the distinct ``terms`` with the ``numbers`` of their
    postings, whose ``places`` are rows and whose ``counts`` say how often the term stands there."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for k in range(0, whole.num_rows, per_block):
                some = whole.slice(k, per_block)
                sizes = pc.fill_null(pc.list_value_length(some.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                term = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.repeat(np.arange(some.num_rows), sizes)
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
                first = np.flatnonzero(new)
                counts, places = np.diff(np.append(first, len(term))), place[first]
                terms, numbers = np.unique(term[first], return_counts=True)
                vectors = [None if v is None else np.asarray(v, "<f8") for v in some.column(2).to_numpy(zero_copy_only=False)]
                dim = max((len(v) for v in vectors if v is not None), default=0)
                data = np.stack([np.full(dim, np.nan) if v is None else v for v in vectors]) if dim else np.zeros((len(vectors), 0))
                made = [terms.astype("<i8"), numbers.astype("<i4"), places.astype("<i4"), counts.astype("<i4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some.column(0).to_numpy()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in made], pa.array([dim], pa.int32()), pa.array([data.astype("<f8").tobytes()], pa.binary())],
                    names=_NAMES,
                )

    plain = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("terms"), "embedding")
    return plain.mapInArrow(run, _BLOCK)


_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


class Block:
    """An unpacked block; the weight of a term in a row is its count by the length of the row's vector."""

    def __init__(self, ids, terms: bytes, numbers: bytes, places: bytes, counts: bytes, dim: int, data: bytes):
        self.ids = np.asarray(ids, np.int64)
        self.terms, self.numbers = np.frombuffer(terms, "<i8"), np.frombuffer(numbers, "<i4").astype(np.int64)
        self.start = np.cumsum(self.numbers) - self.numbers
        self.row, n = np.frombuffer(places, "<i4").astype(np.int64), np.frombuffer(counts, "<i4").astype(np.int64)
        self.weight = n / np.sqrt(np.bincount(self.row, n * n, len(self.ids)))[self.row]
        self.vectors = np.frombuffer(data, "<f8").reshape(len(self.ids), dim)

    def postings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``at``, posting) of the terms at ``at``."""
        n = self.numbers[at]
        which = np.repeat(np.arange(len(at)), n)
        return which, np.arange(len(which)) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)

    def matrix(self, at: np.ndarray) -> np.ndarray:
        """Weights of the terms at ``at``, a line for each row."""
        out = np.zeros((len(self.ids), len(at)))
        which, posting = self.postings(at)
        out[self.row[posting], which] = self.weight[posting]
        return out


def sparse_products(a: Block, b: Block, most: int = 2_000_000, wide: int = 1024) -> np.ndarray:
    """Sums of products over common terms, for all rows of both blocks; 0 where there is none."""
    width = len(b.ids)
    out = np.zeros(len(a.ids) * width)
    _, of_a, of_b = np.intersect1d(a.terms, b.terms, assume_unique=True, return_indices=True)
    pairs = a.numbers[of_a] * b.numbers[of_b]
    dense = pairs > _DENSE * len(out)
    # few rows have many terms in common with a few others: rows are matched one product at a time
    at_a, at_b, pairs = of_a[~dense], of_b[~dense], pairs[~dense]
    ends = np.cumsum(pairs)
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, most)).tolist() + [len(ends)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        which, of_row = b.postings(at_b[low:high])
        n, first = a.numbers[at_a[low:high]][which], a.start[at_a[low:high]][which]
        entry = np.repeat(of_row, n)
        other = np.arange(len(entry)) + np.repeat(first - (np.cumsum(n) - n), n)
        out += np.bincount(a.row[other] * width + b.row[entry], weights=a.weight[other] * b.weight[entry], minlength=len(out))
    out = out.reshape(len(a.ids), width)
    at_a, at_b = of_a[dense], of_b[dense]
    for k in range(0, len(at_a), wide):
        out += a.matrix(at_a[k : k + wide]) @ b.matrix(at_b[k : k + wide]).T
    return out


def search(queries: DataFrame, corpus: DataFrame, k: int, dense_weight: float = 0.7, sparse_weight: float = 0.3, queries_per_block: int = 256, rows_per_block: int = 2048) -> DataFrame:
    """(qid, did, score, rank): the ``k`` best others of each query by the weighted sum of cosine and sparse product, both rounded as
    a whole; a missing score counts 0, a row that has neither with a query is no hit.  Weights are normalised.

    The queries' blocks are gathered in as few partitions as their size allows: each partition of the rows is made once for each of these.
    """
    total = dense_weight + sparse_weight
    asked = packed(queries.hint("rebalance"), queries_per_block).hint("rebalance")
    pairs = packed(corpus, rows_per_block).crossJoin(asked.select(*[F.col(n).alias(f"q_{n}") for n in _NAMES]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k)
        for p in parts:
            for row in p.itertuples(index=False):
                b, a = Block(*row[: len(_NAMES)]), Block(*row[len(_NAMES) :])
                sparse = sparse_products(a, b) if sparse_weight else np.zeros((len(a.ids), len(b.ids)))
                score, found = sparse_weight / total * sparse, sparse > 0
                if dense_weight and a.vectors.shape[1] and a.vectors.shape[1] == b.vectors.shape[1]:
                    near = 1 - np.round(distances("angular", a.vectors, b.vectors), 6)
                    both = ~np.isnan(near)
                    score, found = score + np.where(both, dense_weight / total * near, 0.0), found | both
                found &= a.ids[:, None] != b.ids[None, :]
                d = np.where(found, -np.round(score, 6) + 0.0, np.inf)
                i, j = smallest(d, b.ids, k)
                best.add(a.ids[i], b.ids[j], d[i, j])
        for qid, did, distance in best.rows():
            yield pd.DataFrame({"qid": qid, "did": did, "score": 0.0 - distance})

    near = pairs.mapInPandas(run, "qid long, did long, score double")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "did")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
