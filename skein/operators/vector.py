"""Dense retrieval: unit means, cosine, late interaction in one and two stages, pooling and a coarse index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12
#: Two-stage search rescores limit * OVERSAMPLE * WIDEN chunks a query, CANDIDATES_MIN at least.
OVERSAMPLE, WIDEN, CANDIDATES_MIN = 8, 4, 200
#: Query matrices sent to every task at a time; a larger set of queries goes in blocks, each a pass over the rows.
MAX_QUERY_BYTES = 64 << 20
#: Products held at a time in a task.
CELLS = 8 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length one; one without length comes back as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def unit_mean(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, proxy): the mean of each key's vectors, scaled to length one."""
    parts = rows.select(key, F.posexplode(vector).alias("_at", "_x"))
    means = parts.groupBy(key, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda s: s["_m"]).alias("proxy"))
    return whole.withColumn("proxy", unit(F.col("proxy")))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_FLOOR)


class QueryBlock:
    """Some of the queries: their unit rows end to end, and where each begins."""

    def __init__(self, rows):
        held = [(r["query_id"], np.array(r["matrix"], np.float64)) for r in rows if r["matrix"]]
        self.ids = [k for k, _ in held]
        self.rows = _unit_rows(np.concatenate([m for _, m in held])) if held else np.zeros((0, 0))
        self.starts = np.cumsum([0, *(len(m) for _, m in held)])[:-1]
        self.ends = [*self.starts[1:].tolist(), len(self.rows)]

    def scores(self, mats: list[np.ndarray]) -> np.ndarray:
        """Late interaction of each query with each matrix: the best product of each query row, added up."""
        starts = np.cumsum([0, *(len(m) for m in mats)])[:-1]
        best = np.maximum.reduceat(self.rows @ np.concatenate(mats).T, starts, axis=1)
        return np.add.reduceat(best, self.starts, axis=0)


def query_blocks(queries: DataFrame, block_bytes: int | None = None) -> Iterator[QueryBlock]:
    """queries(query_id, matrix) in blocks of bounded size, by a hash of the query; more queries make more blocks."""
    limit = MAX_QUERY_BYTES if block_bytes is None else block_bytes
    size = queries.agg(F.sum(F.size("matrix") * F.size(F.element_at("matrix", 1)) * 8)).first()[0] or 0
    parts = max(1, -(-size // limit))
    for k in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).select("query_id", "matrix").collect()
        block = QueryBlock(rows)
        if block.ids:
            yield block


def _matrices(pdf: pd.DataFrame) -> tuple[list, list[np.ndarray]]:
    held = [(i, _unit_rows(np.stack(m).astype(np.float64))) for i, m in zip(pdf["id"], pdf["matrix"]) if m is not None and len(m)]
    return [i for i, _ in held], [m for _, m in held]


def _slices(mats: list[np.ndarray], width: int) -> Iterator[tuple[int, int]]:
    """Stretches of `mats` whose products with `width` query rows stay under CELLS."""
    at = 0
    while at < len(mats):
        end, rows = at, 0
        while end < len(mats) and (end == at or (rows + len(mats[end])) * width <= CELLS):
            rows += len(mats[end])
            end += 1
        yield at, end
        at = end


def _each_block(chunks: DataFrame, queries: DataFrame, make, block_bytes: int | None) -> DataFrame:
    kinds = queries.schema["query_id"].dataType.simpleString(), chunks.schema["id"].dataType.simpleString()
    schema, out = f"query_id {kinds[0]}, id {kinds[1]}, score double", None
    for block in query_blocks(queries, block_bytes):
        found = chunks.select("id", "matrix").mapInPandas(make(chunks.sparkSession.sparkContext.broadcast(block)), schema)
        out = found if out is None else out.unionByName(found)
    return chunks.sparkSession.createDataFrame([], schema) if out is None else out


def maxsim(chunks: DataFrame, queries: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """(query_id, id, score) of chunks(id, matrix) and queries(query_id, matrix), a stated set, all pairs.

    Rows are scaled to length one; each query row counts its best product with a row of the chunk. The queries go to
    every task in blocks of bounded size, each a pass over the chunks; nothing is shuffled. Chunks and queries without rows
    give none. `maxsim_top` keeps the best of each query only.
    """

    def make(packed):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = packed.value
            for pdf in frames:
                ids, mats = _matrices(pdf)
                for a, b in _slices(mats, len(block.rows)):
                    scores = block.scores(mats[a:b])
                    yield pd.DataFrame({"query_id": np.repeat(np.array(block.ids, object), b - a), "id": ids[a:b] * len(block.ids), "score": scores.ravel()})

        return run

    return _each_block(chunks, queries, make, block_bytes)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, of equal ones those of smaller id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    at = np.flatnonzero(scores >= least)
    order = sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))
    return np.array(order[:k])


def maxsim_top(chunks: DataFrame, queries: DataFrame, k: int, digits: int = 9, block_bytes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best chunks of each query by the score rounded to `digits`, then id.

    A task keeps the k best of each query over all its rows, so k rows a task and query are shuffled, not every pair.
    """

    def make(packed):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = packed.value
            kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0))] * len(block.ids)
            for pdf in frames:
                ids, mats = _matrices(pdf)
                for a, b in _slices(mats, len(block.rows)):
                    names = np.array(ids[a:b], object)
                    for q, row in enumerate(np.round(block.scores(mats[a:b]), digits)):
                        old = kept[q]
                        at = np.flatnonzero(row >= old[1].min()) if len(old[1]) == k else np.arange(len(row))
                        if len(at):
                            both = np.concatenate([old[0], names[at]]), np.concatenate([old[1], row[at]])
                            best = _best(*both, k)
                            kept[q] = both[0][best], both[1][best]
            for q, (names, scores) in enumerate(kept):
                if len(names):
                    yield pd.DataFrame({"query_id": block.ids[q], "id": names.tolist(), "score": scores})

        return run

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    near = _each_block(chunks, queries, make, block_bytes)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def maxsim_pairs(pairs: DataFrame, queries: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """(query_id, id, score) of pairs(query_id, id, matrix) alone."""
    kinds = pairs.schema["query_id"].dataType.simpleString(), pairs.schema["id"].dataType.simpleString()
    schema, out = f"query_id {kinds[0]}, id {kinds[1]}, score double", None
    for block in query_blocks(queries, block_bytes):
        packed = pairs.sparkSession.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], packed=packed) -> Iterator[pd.DataFrame]:
            block = packed.value
            place = {k: i for i, k in enumerate(block.ids)}
            for pdf in frames:
                for q, mine in pdf.groupby("query_id", sort=False):
                    if q not in place:
                        continue
                    i = place[q]
                    rows = block.rows[block.starts[i] : block.ends[i]]
                    ids, mats = _matrices(mine)
                    if mats:
                        starts = np.cumsum([0, *(len(m) for m in mats)])[:-1]
                        score = np.maximum.reduceat(rows @ np.concatenate(mats).T, starts, axis=1).sum(axis=0)
                        yield pd.DataFrame({"query_id": q, "id": ids, "score": score})

        found = pairs.select("query_id", "id", "matrix").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return pairs.sparkSession.createDataFrame([], schema) if out is None else out


def candidate_depth(k: int) -> int:
    return max(CANDIDATES_MIN, k * OVERSAMPLE * WIDEN)


def two_stage(chunks: DataFrame, proxies: DataFrame, queries: DataFrame, query_proxies: DataFrame, k: int, candidates: int | None = None) -> DataFrame:
    """The k best chunks of each query: by late interaction over the `candidates` (candidate_depth(k) unless given) nearest by
    proxy vector. A chunk further off by proxy is missed; `maxsim` is exact."""
    candidates = candidate_depth(k) if candidates is None else candidates
    pool = maxsim_top(proxies.select("id", F.array("proxy").alias("matrix")), query_proxies.select("query_id", F.array("proxy").alias("matrix")), candidates)
    pairs = pool.select("query_id", "id").join(chunks.select("id", "matrix"), "id")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 5).desc(), "id")
    return maxsim_pairs(pairs, queries).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pooled(matrix: np.ndarray, factor: int, protected: int = 1) -> np.ndarray:
    """Rows merged to max(n // factor, 1) clusters by Ward linkage on cosine distance; the first `protected` stay."""
    head, rest = matrix[:protected], matrix[protected:]
    if factor <= 1 or len(rest) < 2:
        return matrix
    want = max(len(rest) // factor, 1)
    unit_rows = _unit_rows(rest.astype(np.float64))
    distance = np.clip(1 - unit_rows @ unit_rows.T, 0, None)
    np.fill_diagonal(distance, np.inf)
    size = np.ones(len(rest))
    members = [[i] for i in range(len(rest))]
    alive = np.ones(len(rest), bool)
    while alive.sum() > want:
        i, j = divmod(int(distance.argmin()), len(rest))
        i, j = min(i, j), max(i, j)
        total = size[i] + size[j] + size
        joint = np.sqrt(np.maximum(((size[i] + size) * distance[i] ** 2 + (size[j] + size) * distance[j] ** 2 - size * distance[i, j] ** 2) / total, 0))
        joint[~alive] = np.inf
        joint[[i, j]] = np.inf
        distance[i], distance[:, i] = joint, joint
        distance[j], distance[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        members[i] += members[j]
    return np.concatenate([head, np.stack([rest[sorted(members[i])].mean(axis=0) for i in np.flatnonzero(alive)])])


def pool_rows(chunks: DataFrame, factor: int) -> DataFrame:
    """chunks(id, matrix) with pooled matrices."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "matrix": [pooled(np.array([list(v) for v in m], np.float64), factor).tolist() for m in pdf["matrix"]]})

    return chunks.select("id", "matrix").mapInPandas(run, f"id {chunks.schema['id'].dataType.simpleString()}, matrix array<array<double>>")
