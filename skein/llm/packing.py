"""Documents into sequences of fixed length by linear grouping, over a histogram of lengths.

The plan needs only how many pieces there are of each length (at most `capacity` numbers), so it is made on the driver
whatever the size of the corpus: large lengths are rounded up within groups of equal cardinality, the fractional optimum
over configurations of these few sizes is found by column generation and rounded down, the actual pieces take the slots, and what
is left, large or small, goes best-fit, longest first. The plan is a table of ranges (length, ranks, sequences); each
piece finds its sequence by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.grouped_split import ranked_within
from skein.session import materialize

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that parts a text before byte-pair merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUPS, SMALL_SHARE = 32, 0.125

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of documents(doc_id, text): whole texts, no shuffle; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_to_numpy
        for batch in batches:
            counts = [len(encode(t, disallowed_special=())) if t else 0 for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    for c in range(int(sizes.min()), capacity + 1):
        fit = sizes <= c
        worth = np.where(fit, values + best[c - np.minimum(sizes, c)], -1.0)
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = worth[k], k
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, number of sequences), the fractional optimum rounded down: a revised simplex whose columns
    come from a knapsack over the dual prices."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(columns)
    inverse = np.diag(1 / np.diag(columns))
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, column = _knapsack(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x -= step * direction
        x[out] = step
        columns[:, out] = column
        if np.linalg.cond(columns) > 1e12:
            break
        inverse = np.linalg.inv(columns)
        x = np.maximum(inverse @ demand, 0)
    return [(columns[:, k].astype(np.int64), int(np.floor(x[k] + 1e-9))) for k in range(m) if x[k] >= 1 - 1e-9]


class Plan:
    """Ranges (length, from, to, sequence, each, slot): piece number r of that length, from <= r < to, goes to sequence
    + (r - from) // each."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = GROUPS, small_share: float = SMALL_SHARE):
        self.capacity, self.ranges, self.n_sequences = capacity, [], 0
        self.taken = dict.fromkeys(histogram, 0)
        self.count = dict(histogram)
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences
        self.rooms: list[int] = []
        self._large(sorted((s for s in histogram if s > small_share * capacity), reverse=True), groups)
        for length in sorted(histogram, reverse=True):
            self._best_fit(length)

    def _free(self, room: int, start: int, end: int) -> None:
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append((start, end))

    def _put(self, length: int, n: int, start: int, each: int) -> None:
        at = self.taken[length]
        self.ranges.append((length, at, at + n, start, each))
        self.taken[length] = at + n

    def _large(self, lengths: list[int], groups: int) -> None:
        total = sum(self.count[s] for s in lengths)
        if not total:
            return
        parts: dict[int, list[int]] = {}
        seen = 0
        for s in lengths:
            parts.setdefault(seen * groups // total, []).append(s)
            seen += self.count[s]
        members = list(parts.values())
        sizes = np.array([p[0] for p in members], np.int64)
        demand = np.array([sum(self.count[s] for s in p) for p in members], np.int64)
        left = demand.copy()
        for copies, times in configurations(sizes, demand.astype(float), self.capacity):
            times = min([times, *(int(left[g] // c) for g, c in enumerate(copies) if c)])
            if times <= 0:
                continue
            left -= copies * times
            start = self.n_sequences
            self.n_sequences += times
            # Slots take the actual pieces in falling length; the room left is constant between the borders met.
            used = {0: 0, times: 0}
            steps: list[tuple[int, int, int]] = []
            for g, c in enumerate(copies):
                for _ in range(int(c)):
                    at = 0
                    for s in members[g]:
                        n = min(self.count[s] - self.taken[s], times - at)
                        if n > 0:
                            self._put(s, n, start + at, 1)
                            steps.append((at, at + n, s))
                            at += n
                        if at == times:
                            break
            borders = sorted({*used, *(a for a, _, _ in steps), *(b for _, b, _ in steps)})
            load = np.zeros(len(borders), np.int64)
            place = {b: i for i, b in enumerate(borders)}
            for a, b, s in steps:
                load[place[a] : place[b]] += s
            for i in range(len(borders) - 1):
                self._free(self.capacity - int(load[i]), start + borders[i], start + borders[i + 1])

    def _best_fit(self, length: int) -> None:
        n = self.count[length] - self.taken[length]
        if length == 0:
            if n:
                self.n_sequences = max(self.n_sequences, 1)
                self._put(0, n, 0, n)
            return
        while n > 0:
            k = bisect_left(self.rooms, length)
            if k < len(self.rooms):
                room = self.rooms[k]
                runs = self.open[room]
                start, end = runs.pop()
                if not runs:
                    del self.open[room]
                    self.rooms.pop(k)
            else:
                room = self.capacity
                start, end = self.n_sequences, self.n_sequences + -(-n // (self.capacity // length))
                self.n_sequences = end
            each = room // length
            full = min(end - start, n // each)
            if full:
                self._put(length, full * each, start, each)
                self._free(room - each * length, start, start + full)
                n -= full * each
                start += full
            if start < end and 0 < n < each:
                self._put(length, n, start, n)
                self._free(room - n * length, start, start + 1)
                n, start = 0, start + 1
            if start < end:
                self._free(room, start, end)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Columns length, from, sequence, each, sorted by (length, from)."""
        rows = np.array(sorted((a, b, d, e) for a, b, _, d, e in self.ranges), np.int64).reshape(-1, 4)
        return tuple(rows.T.copy())


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens): documents within the capacity whole, longer ones in full sequences and a
    rest."""
    n = F.col("n_tokens")
    last = F.greatest(F.call_function("div", n - 1, F.lit(capacity)), F.lit(0))
    parts = counts.select("doc_id", n.alias("_all"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return parts.select("doc_id", "piece_no", start.alias("start_token"), F.least(F.col("_all") - start, F.lit(capacity)).alias("n_tokens"))


def pack(counts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, sequence_id) of counts(doc_id, n_tokens).

    Every piece gets exactly one sequence and no sequence holds more than `capacity` tokens. Documents without tokens
    take no room and are spread over all sequences in turn; a repeated doc_id is a document of its own. An empty table gives an empty result.
    The broadcast plan is bounded by the capacity, not by the documents.
    """
    parts = materialize(pieces(counts, capacity), "pieces")
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, capacity, groups, small_share)
    spark = counts.sparkSession
    packed = spark.sparkContext.broadcast((*plan.arrays(), max(1, plan.n_sequences)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, each, n_sequences = packed.value
        key = length << 40 | first
        for batch in batches:
            n, r = batch.column("n_tokens").to_numpy(), batch.column("rank_no").to_numpy()
            at = np.searchsorted(key, n << 40 | r, side="right") - 1
            bins = np.where(n == 0, r % n_sequences, sequence[at] + (r - first[at]) // np.maximum(each[at], 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece_no", "start_token", "n_tokens")), pa.array(bins)], ["doc_id", "piece_no", "start_token", "n_tokens", "sequence_id"])

    keyed = parts.withColumn("_key", F.concat_ws(":", "doc_id", "piece_no"))
    ranked = ranked_within(keyed, "n_tokens", "_key").drop("_key")
    return ranked.mapInArrow(run, "doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint, sequence_id bigint")
