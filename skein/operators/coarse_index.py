"""A vector index: coarse lists and product codes, fitted on a bounded sample; every row is indexed.

A search scores the codes of the nearest lists (a byte for each stretch of the vector) by table lookups, and only the
`refine` times k best of each query are read as whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.vector import _best, _unit_rows, maxsim_pairs, query_blocks
from skein.session import materialize

#: Vectors that lists and codes are fitted on at most, those of smallest hash; lists hold eight of them at least.
FIT_ROWS = 100_000
#: Bytes of a product code, values of a byte, part of the lists searched, whole vectors read for each result.
CODE_BYTES, VALUES, PROBED, REFINE = 16, 256, 0.5, 8


def _kmeans(x: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly chosen rows; an empty centre stays where it is."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
        if unit:
            c = _unit_rows(c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class VectorIndex:
    """Centres of the lists and of each stretch's code values."""

    def __init__(self, sample: np.ndarray, n_rows: int, lists: int | None = None, code_bytes: int = CODE_BYTES, rounds: int = 12):
        x = _unit_rows(sample)
        self.dim = x.shape[1]
        # Four times the root of the rows, as far as the sample can tell them apart.
        lists = lists or max(1, min(int(4 * n_rows**0.5), len(x) // 8))
        self.centres = _kmeans(x, lists, rounds, True)
        self.parts = np.array_split(np.arange(self.dim), min(code_bytes, self.dim))
        self.books = [_kmeans(x[:, p], VALUES, rounds, False) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List number and code of each row."""
        x = _unit_rows(x)
        return np.argmax(x @ self.centres.T, axis=1), np.stack([_nearest(x[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def lookup(self, q: np.ndarray) -> np.ndarray:
        """(query, stretch, value) products of unit queries with the code values."""
        out = np.zeros((len(q), len(self.parts), VALUES))
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, k, : len(b)] = q[:, p] @ b.T
        return out


def fit(rows: DataFrame, limit: int = FIT_ROWS, **settings) -> VectorIndex | None:
    """The index of rows(id, vector), fitted on at most `limit` vectors; None without any."""
    held = rows.where(F.col("vector").isNotNull())
    sample = held.orderBy(F.xxhash64("id"), "id").limit(limit).select("vector").collect()
    return VectorIndex(np.array([r["vector"] for r in sample], np.float64), held.count(), **settings) if sample else None


def encode(rows: DataFrame, index: VectorIndex) -> DataFrame:
    """(id, list_no, code) of every row with a vector."""
    packed = rows.sparkSession.sparkContext.broadcast(index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                at, codes = packed.value.encode(np.stack(pdf["vector"].to_list()).astype(np.float64))
                yield pd.DataFrame({"id": pdf["id"], "list_no": at, "code": [c.tobytes() for c in codes]})

    return rows.where(F.col("vector").isNotNull()).select("id", "vector").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, list_no bigint, code binary")


def search(rows: DataFrame, codes: DataFrame, index: VectorIndex, queries: DataFrame, k: int, probed: float = PROBED, refine: int = REFINE, block_bytes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of rows(id, vector) to each of queries(query_id, vector), by cosine.

    codes(id, list_no, code) are read once a block of queries; a task keeps the refine * k best codes of each query. A prefilter
    is a filter on `codes`. Vectors further off by their code are missed; `maxsim_top` is exact.
    """
    from pyspark.sql import Window

    n_probes = max(1, round(probed * len(index.centres)))
    queries = queries.where(F.col("vector").isNotNull()).select("query_id", F.array("vector").alias("matrix"))
    kinds = queries.schema["query_id"].dataType.simpleString(), codes.schema["id"].dataType.simpleString()
    schema, near, depth = f"query_id {kinds[0]}, id {kinds[1]}, score double", None, refine * k
    for block in query_blocks(queries, block_bytes):
        packed = rows.sparkSession.sparkContext.broadcast((index, block))

        def run(frames: Iterator[pd.DataFrame], packed=packed) -> Iterator[pd.DataFrame]:
            index, block = packed.value
            table = index.lookup(block.rows)
            order = np.argsort(-(block.rows @ index.centres.T), axis=1, kind="stable")[:, :n_probes]
            wants = np.zeros((len(block.ids), len(index.centres)), bool)
            np.put_along_axis(wants, order, True, axis=1)
            kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0))] * len(block.ids)
            stretches = np.arange(len(index.parts))
            for pdf in frames:
                if not len(pdf):
                    continue
                names, at = pdf["id"].to_numpy(object), pdf["list_no"].to_numpy()
                code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
                for q in range(len(block.ids)):
                    mine = np.flatnonzero(wants[q, at])
                    if not len(mine):
                        continue
                    score = table[q][stretches, code[mine]].sum(axis=1)
                    old = kept[q]
                    if len(old[1]) == depth:
                        up = score >= old[1].min()
                        mine, score = mine[up], score[up]
                    both = np.concatenate([old[0], names[mine]]), np.concatenate([old[1], score])
                    best = _best(*both, depth)
                    kept[q] = both[0][best], both[1][best]
            for q, (names, scores) in enumerate(kept):
                if len(names):
                    yield pd.DataFrame({"query_id": block.ids[q], "id": names.tolist(), "score": scores})

        found = codes.select("id", "list_no", "code").mapInPandas(run, schema)
        near = found if near is None else near.unionByName(found)
    if near is None:
        return rows.sparkSession.createDataFrame([], f"{schema}, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    pool = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("query_id", "id")
    pairs = pool.join(rows.select("id", F.array("vector").alias("matrix")), "id")
    exact = maxsim_pairs(pairs, queries).withColumn("score", F.round("score", 5))
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build(rows: DataFrame, **settings) -> tuple[VectorIndex | None, DataFrame | None]:
    """The fitted index and the table of its codes, sorted by list so that a reader can skip."""
    index = fit(rows, **settings)
    return (index, materialize(encode(rows, index).sortWithinPartitions("list_no"), "codes")) if index else (None, None)
