"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes that cover its whole text. Each passage
is encoded from its byte distribution, its length and its share of distinct words by
a learned tanh layer; gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the
passages, and a logistic layer scores the weighted sum. All layers are learned together
from document labels alone.

Training takes a bounded hash sample of labelled ids (``max_labelled``), and of these, in the order
of a hash, as many as have ``max_passages`` passages together: each with all of its passages.
Scoring covers every passage of every text, in bounded pieces, without a shuffle. The
fitted arrays are some 50 kB.

Cases: a null or empty text is one empty passage and gets a score. Without any training
row of both labels, all score the share of label 1 (0.5 if there is none). Null ids are
never in training. Of several texts of an id one trains, of several labels the larger. Repeated
rows are scored alike. An empty table gives an empty result. Other columns are ignored, and
a carried column named like a result is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc_fold, materialise, sampled, with_clear_names

PASSAGE = 1024
CHUNK = 2048  # passages handled at once
N_FEATURES = 256 + 4


def _features(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of consecutive passages of the given sizes."""
    n = len(sizes)
    at = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount((at << 8) | data, minlength=n << 8).reshape(n, 256).astype(np.float32)
    x = np.zeros((n, N_FEATURES), np.float32)
    total = np.maximum(sizes, 1)[:, None]
    x[:, :256] = np.sqrt(counts / total)
    if len(data):
        space = data <= 32
        begins = np.concatenate(([True], at[1:] != at[:-1]))  # a passage sees nothing of its neighbours
        first = np.flatnonzero(~space & (begins | np.concatenate(([True], space[:-1]))))
        wide = np.concatenate((data, np.zeros(6, np.uint8))).astype(np.uint64)
        owner = np.concatenate((at, np.full(6, -1, at.dtype)))
        key = sum(
            (np.where(owner[first + i] == at[first], wide[first + i], np.uint64(0)) << np.uint64(8 * i) for i in range(1, 5)),
            wide[first]
        )
        order = np.sort((at[first].astype(np.uint64) << np.uint64(40)) | key)
        words = np.bincount(at[first], minlength=n)
        new = np.concatenate(([True], order[1:] != order[:-1])) if len(order) else np.empty(0, bool)
        distinct = np.bincount((order[new] >> np.uint64(40)).astype(np.int64), minlength=n)
        x[:, 256] = distinct / np.maximum(words, 1)
        x[:, 257] = np.minimum(total[:, 0] / np.maximum(words, 1) / 10, 3)
    x[:, 258] = np.log1p(sizes) / 7
    x[:, 259] = sizes == 0
    return x


def passages(text: str | None) -> tuple[bytes, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // PASSAGE))
    sizes = np.full(n, PASSAGE, np.int64)
    sizes[-1] = len(raw) - PASSAGE * (n - 1)
    return raw, sizes


def encoded(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number of each passage, features), in pieces of at most about CHUNK passages."""
    raws: list[bytes] = []
    sizes: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(docs), _features(np.frombuffer(b"".join(raws), np.uint8), np.concatenate(sizes))

    for i, text in enumerate(texts):
        raw, own = passages(text)
        for a in range(0, len(own), CHUNK):
            part = own[a : a + CHUNK]
            raws.append(raw[a * PASSAGE : (a + CHUNK) * PASSAGE])
            sizes.append(part)
            docs.append(np.full(len(part), i))
            held += len(part)
            if held >= CHUNK:
                yield flush()
                raws, sizes, docs, held = [], [], [], 0
    if held:
        yield flush()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMIL:
    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "W": rng.normal(0, 0.15, (N_FEATURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)),
            "U": rng.normal(0, 0.3, (hidden, gate)), "w": np.zeros(gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)
        }
        self.mean, self.scale, self.share = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _forward(self, x: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    def fit(
        self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 4e-3,
        decay: float = 1e-4
    ) -> AttentionMIL:
        """x: passages, sorted by doc (0 to len(y) - 1)."""
        self.share = float(y.mean()) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return self
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
        self.share = None
        x = (x - self.mean) * self.scale
        edges = np.searchsorted(doc, np.arange(len(y) + 1))
        rng, p = np.random.default_rng(3), self.p
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                some = order[a : a + batch]
                n = edges[some + 1] - edges[some]
                at = np.repeat(np.arange(len(some)), n)
                begins = np.concatenate(([0], np.cumsum(n)[:-1]))
                xs = x[np.repeat(edges[some] - begins, n) + np.arange(n.sum())]
                h, t, s, e = self._forward(xs)
                e = np.exp(e - np.maximum.reduceat(e, begins)[at])
                alpha = e / np.add.reduceat(e, begins)[at]
                z = np.add.reduceat(alpha[:, None] * h, begins)
                g = (_sigmoid(z @ p["c"] + p["d"]) - y[some]) / len(some)
                dz = g[:, None] * p["c"]
                da = (dz[at] * h).sum(axis=1)
                de = alpha * (da - np.add.reduceat(alpha * da, begins)[at])
                gate = de[:, None] * p["w"]
                dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
                dh = (alpha[:, None] * dz[at] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                grad = {
                    "W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g,
                    "d": g.sum(keepdims=True)
                }
                step += 1
                lr = rate * (1 - epoch / epochs) + rate / 20
                for k, q in p.items():
                    m[k] += 0.1 * (grad[k] - m[k])
                    v[k] += 0.001 * (grad[k] ** 2 - v[k])
                    q -= lr * (
                        m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + (decay * q if k != "d" else 0)
                    )
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Of each whole text; a document's passages may come in several pieces, whose
        softmax sums are merged."""
        if self.share is not None:
            return np.full(len(texts), self.share)
        k = len(self.p["c"])
        top, low, z = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), k))
        for doc, x in encoded(texts):
            h, _, _, e = self._forward((x - self.mean) * self.scale)
            begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            own, at = doc[begins], np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(doc))))
            new = np.maximum(top[own], np.maximum.reduceat(e, begins))
            old = np.exp(top[own] - new)
            e = np.exp(e - new[at])
            low[own] = low[own] * old + np.add.reduceat(e, begins)
            z[own] = z[own] * old[:, None] + np.add.reduceat(e[:, None] * h, begins)
            top[own] = new
        return _sigmoid((z / np.maximum(low, 1e-300)[:, None]) @ self.p["c"] + self.p["d"])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int,
    max_labelled: int = 3000, max_passages: int = 40_000
) -> AttentionMIL:
    """From labelled rows outside the held-out fold."""
    open_rows = labels.where(
        F.col(label_col).isNotNull() & (crc_fold(F.col(id_col), folds) != held)
    ).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = sampled(open_rows, id_col, max_labelled)  # at most some max_labelled rows, so the broadcast is bounded
    texts = with_clear_names(docs, id_col, text_col).join(F.broadcast(chosen), id_col)
    train = texts.groupBy(id_col).agg(
        F.first("_y").alias("_y"), F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))).alias("x")
    ).select(F.col(id_col).cast("string").alias("id"), "_y", "x.t", "x.h")
    train = materialise(train, "mil-train")
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("t"), F.lit(0)) / PASSAGE))
    taken, total = [], 0
    for own, n in train.select("id", size.alias("n")).orderBy(F.xxhash64("id", F.lit("mil")), "id").collect():  # at most some max_labelled rows
        if total + n <= max_passages:
            taken.append(own)
            total += n

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (key, y, np.concatenate([x for _, x in encoded([text])]).tobytes()) for key, text, y in zip(pdf["id"], pdf["t"], pdf["_y"])
            ]
            yield pd.DataFrame(rows, columns=["id", "y", "x"])

    rows = train.where(F.col("id").isin(taken)).mapInPandas(features, "id string, y int, x binary").collect()  # at most max_passages passages
    rows = sorted((r["id"], r["y"], bytes(r["x"])) for r in rows)
    if not rows:
        return AttentionMIL().fit(np.empty((0, N_FEATURES)), np.empty(0, int), np.empty(0))
    xs = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return AttentionMIL().fit(
        np.concatenate(xs).astype(np.float64), np.repeat(np.arange(len(xs)), [len(x) for x in xs]),
        np.array([float(r[1]) for r in rows])
    )


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held: int = 0, threshold: float = 0.3, max_labelled: int = 3000, carry: list[str] | None = None
) -> DataFrame:
    """id, held_out, score, predicted; and the columns to carry, which may include id and text."""
    if clash := {"held_out", "score", "predicted"} & set(carry or []):
        raise ValueError(f"can't carry {sorted(clash)}: results have these names")
    model = fit(docs, labels, id_col, text_col, label_col, folds, held, max_labelled)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    held_out = F.coalesce(crc_fold(F.col(id_col), folds) == held, F.lit(False))
    names = list(dict.fromkeys([id_col, *(carry or [])]))
    out = docs.select(*[F.col(f"`{n}`") for n in names], held_out.alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
