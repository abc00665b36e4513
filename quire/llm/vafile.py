"""Exact top-k search by vector-approximation files.

Vectors become integers floor(scale * x) and are stored twice: whole, and as a file of quantised cells
(each component's equal-width interval of its block, one byte). For a bounded batch of queries

1. the cells alone are scanned, where they lie: a block's cells bound each candidate's inner product
   from both sides (one matrix product), and what can't reach the task's k-th lower bound is
   dropped. A task hands on some k candidates a query, whatever its number of rows;
2. the k-th lower bound of all tasks drops more, and the rest is put in order of the upper bounds;
3. exact vectors are read by id, first the best few of each query; then, of the others, only those whose
   bound reaches the k-th result so far, after which it is certain.

Neither vectors nor cells are shuffled to meet queries, and no pair is formed but of a query and a candidate
that its bounds leave. The stated queries are taken in batches of ``batch_bytes``, so the driver and a
task hold one batch, one block of cells and k candidates a query.

Of equal vectors of a block only the k + 1 smallest ids can be results, so no others are kept: a very common
vector is no hot group. Ties go to the smaller id.

Cases: null ids, and vectors that are null or hold null or non-finite components, take no part; vectors
meet only those of their own length. Repeated ids count as rows of their own, except that a
query's own id is never its candidate. Fewer than k candidates give fewer rows, an empty
table none. Sums beyond 2 ** 53 are made with Python's integers and cut to a long's range.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Stored

LEVELS = 256
AT_ONCE = 512  # queries that meet a block in one product
HELD = 1_000_000  # candidates that a task keeps back
LONG = float(1 << 63)
VECTOR = "vec_id long, h long, m int, v binary"
CELLS = "dim int, ids binary, hs binary, low binary, width binary, codes binary"
Asked = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: vectors, ids, numbers in the batch


def packed(v: np.ndarray) -> bytes:
    """Integers held as doubles, in as few bytes as they need."""
    for kind in ("<i2", "<i4"):
        if not len(v) or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return kind[-1:].encode() + v.astype(kind).tobytes()
    return b"8" + v.astype("<f8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {50: "<i2", 52: "<i4", 56: "<f8"}[raw[0]], offset=1).astype(np.float64)


class Cells:
    """The approximation of a block of integer vectors."""

    def __init__(self, low: np.ndarray, width: np.ndarray, codes: np.ndarray):
        self.low, self.width, self.codes = low, width, codes
        # beyond the doubles' integers a cell's last value isn't known
        self.reach = np.where(np.abs(low) + LEVELS * width < 2.0**50, width - 1, width)

    @classmethod
    def of(cls, vectors: np.ndarray) -> Cells:
        low = vectors.min(axis=0)
        width = np.maximum(1.0, np.ceil((vectors.max(axis=0) - low + 1) / LEVELS))
        return cls(low, width, np.clip((vectors - low) // width, 0, LEVELS - 1).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the inner products (vectors x queries), and how far the lower ones lie below
        them, by query."""
        slack = 2.0**-40 * (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.low + LEVELS * self.width)))
        base = queries @ self.low + np.maximum(queries, 0) @ self.reach + slack
        return self.codes.astype(np.float64) @ (queries * self.width).T + base, np.abs(queries) @ self.reach + 2 * slack


def scan(blocks: Iterator[tuple[np.ndarray, np.ndarray, Cells]], asked: Asked, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query number, id, hash, upper, lower) of the candidates that the blocks' cells leave. blocks: ids, hashes, cells."""
    best = {d: np.full((len(own), k), -np.inf) for d, (_, own, _) in asked.items()}  # lower bounds
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def left() -> list[tuple[np.ndarray, ...]]:
        out = []
        for d, at, *rest in held:
            keep = rest[2] >= best[d][at].min(axis=1)
            out.append((d, at[keep], *(x[keep] for x in rest)))
        return out

    def handed(d: int, at: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
        return asked[d][2][at], *rest

    for ids, hs, cells in blocks:
        d = len(cells.low)
        if d not in asked:
            continue
        queries, own, _ = asked[d]
        for a in range(0, len(own), AT_ONCE):
            upper, gap = cells.bounds(queries[a : a + AT_ONCE])
            upper = np.minimum(upper, LONG)
            upper[ids[:, None] == own[None, a : a + AT_ONCE]] = -np.inf
            lower = np.maximum(upper - gap, np.where(np.isfinite(upper), -LONG, -np.inf))
            top = lower if len(lower) <= k else np.partition(lower, len(lower) - k, axis=0)[-k:]
            mine = np.concatenate((best[d][a : a + AT_ONCE], top.T), axis=1)
            best[d][a : a + AT_ONCE] = np.partition(mine, mine.shape[1] - k, axis=1)[:, -k:]
            row, col = np.nonzero((upper >= best[d][a : a + AT_ONCE].min(axis=1)) & np.isfinite(upper))
            held.append((d, a + col, ids[row], hs[row], upper[row, col], lower[row, col]))
            size += len(row)
            if size > HELD:
                held = left()
                size = sum(len(h[1]) for h in held)
                if size > HELD // 2:
                    yield from (handed(*h) for h in held)
                    held, size = [], 0
    yield from (handed(*h) for h in left())


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and the whole vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    fine = F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return vectors.where(
        F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine
    ).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def distinct(rows: DataFrame, ids: int | None, most: int) -> DataFrame:
    """VECTOR: for each vector of a batch of rows its ``ids`` smallest ids (all, if None), with how often
    (``most`` at most) and a hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[bytes, dict[int, int]] = {}
            for own, v in zip(pdf["vec_id"].tolist(), pdf["v"]):
                times = found.setdefault(packed(np.asarray(v, np.float64)), {})
                times[own] = times.get(own, 0) + 1
            out = [
                (own, xxhash.xxh3_64_intdigest(raw) - (1 << 63), min(times[own], most), raw) for raw, times in found.items() for own in sorted(times)[:ids]
            ]
            yield pd.DataFrame(out, columns=["vec_id", "h", "m", "v"])

    return rows.mapInPandas(run, VECTOR)


def cells_of(vectors: DataFrame) -> DataFrame:
    """CELLS: the approximation file, a row for each batch of vectors of one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole, rows = [unpacked(raw) for raw in pdf["v"]], []
            sizes = np.array([len(v) for v in whole])
            for d in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == d)
                cells = Cells.of(np.array([whole[i] for i in some]).reshape(len(some), d))
                rows.append(
                    (
                        d, *(pdf[c].to_numpy(np.int64)[some].tobytes() for c in ("vec_id", "h")), cells.low.tobytes(),
                        cells.width.tobytes(), cells.codes.tobytes()
                    )
                )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return vectors.select("vec_id", "h", "v").mapInPandas(run, CELLS)


def candidates(cells: DataFrame, asked: Asked, k: int) -> DataFrame:
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, Cells]]:
        for pdf in batches:
            for d, ids, hs, low, width, codes in zip(*(pdf[c] for c in pdf.columns)):
                ids, hs = np.frombuffer(ids, np.int64), np.frombuffer(hs, np.int64)
                yield ids, hs, Cells(
                    np.frombuffer(low), np.frombuffer(width), np.frombuffer(codes, np.uint8).reshape(len(ids), d)
                )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in scan(blocks(batches), asked, k):
            yield pd.DataFrame(dict(zip(("query", "vec_id", "h", "upper", "lower"), found)))

    return cells.mapInPandas(run, "query int, vec_id long, h long, upper double, lower double")


def exact(wanted: DataFrame, vectors: DataFrame, asked: list[np.ndarray], k: int) -> DataFrame:
    """query, vec_id, score, m of the wanted (query, vec_id, h), from whole vectors."""
    needed = wanted.select("vec_id", "h").distinct()
    whole = vectors.join(needed, ["vec_id", "h"], "left_semi").groupBy("vec_id", "h").agg(
        F.least(F.lit(k), F.sum("m")).cast("int").alias("m"), F.first("v").alias("v")
    )

    def product(q: np.ndarray, v: np.ndarray) -> int:
        if np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * max(1, len(q)) < 2.0**53:
            return int(q @ v)
        return max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(q, v))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = [product(asked[q], unpacked(v)) for q, v in zip(pdf["query"], pdf["v"])]
            yield pd.DataFrame(
                {"query": pdf["query"], "vec_id": pdf["vec_id"], "score": np.array(score, np.int64), "m": pdf["m"]}
            )

    return wanted.join(whole, ["vec_id", "h"]).select("query", "vec_id", "v", "m").mapInPandas(
        run, "query int, vec_id long, score long, m int"
    )


def answered(asked: list, vectors: DataFrame, cells: DataFrame, k: int, first: int) -> Stored:
    """query_id, vec_id, score, and copies for the (id, times, vector) of one batch of queries."""
    spark, whole = vectors.sparkSession, [unpacked(bytes(r["v"])) for r in asked]
    sizes, own = np.array([len(v) for v in whole]), np.array([r["vec_id"] for r in asked], np.int64)
    groups = {d: np.flatnonzero(sizes == d) for d in np.unique(sizes).tolist()}
    seen = Stored(
        candidates(
            cells,
            {d: (np.array([whole[i] for i in at]).reshape(len(at), d), own[at], at.astype(np.int32)) for d, at in groups.items()},
            k
        ),
        "candidates"
    )
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    floors = seen.df.select(
        "query", "lower", F.row_number().over(best).alias("n")
    ).where(F.col("n") == k).select("query", F.col("lower").alias("floor"))
    able = seen.df.join(floors, "query", "left").where(
        "floor is null or upper >= floor"
    ).groupBy("query", "vec_id", "h").agg(F.max("upper").alias("upper"))
    ordered = Stored(
        able.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "vec_id"))), "ordered"
    )
    read = Stored(exact(ordered.df.where(F.col("place") <= k + first), vectors, whole, k), "read")
    # the k-th result so far: what can't reach it is never read
    so_far = F.sum("m").over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    kth = read.df.select(
        "query", "score", so_far.alias("n")
    ).where(F.col("n") >= k).groupBy("query").agg(F.max("score").alias("kth"))
    rest = ordered.df.where(F.col("place") > k + first).join(kth, "query", "left").where("kth is null or upper >= kth")
    found = read.df.unionAll(exact(rest, vectors, whole, k))
    numbered = spark.createDataFrame(
        [(i, r["vec_id"], r["m"]) for i, r in enumerate(asked)], "query int, query_id long, times int"
    )
    copies = F.least(F.lit(k), F.col("m") * F.col("times"))
    result = Stored(
        found.join(F.broadcast(numbered), "query").select("query_id", "vec_id", "score", copies.alias("copies")), "answers"
    )  # one batch
    for old in (seen, ordered, read):
        old.drop()
    return result


def top_k(
    vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100,
    scale: float = 1024.0, first: int = 10, batch_bytes: int = 1 << 24
) -> DataFrame:
    """query_id, rank, vec_id, score of each row whose id is divisible by ``every``. ``first`` more than k exact
    vectors are read before the first look at what is certain."""
    rows = _integers(vectors, id_col, vector_col, scale)
    whole = Stored(distinct(rows, k + 1, k), "vectors")
    cells = Stored(cells_of(whole.df), "cells")
    alike = distinct(rows.where(F.col("vec_id") % every == 0), None, k)
    asked = Stored(
        alike.groupBy("vec_id", "h").agg(F.least(F.lit(k), F.sum("m")).cast("int").alias("m"), F.first("v").alias("v")), "asked"
    )
    size = asked.df.agg(F.sum(4 * F.octet_length("v") + 64)).first()[0] or 0  # as doubles, at most
    batches = -(-size // batch_bytes)
    results = []
    for n in range(batches):
        some = asked.df.where(F.pmod(F.xxhash64("vec_id", "h"), F.lit(batches)) == n).collect()  # about batch_bytes
        if some:
            results.append(answered(some, whole.df, cells.df, k, first))
    for old in (whole, cells, asked):
        old.drop()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, copies int")
    found = reduce(DataFrame.unionAll, [r.df for r in results]) if results else empty
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
