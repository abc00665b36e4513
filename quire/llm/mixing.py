"""Mixing sources to target weights (native): soft-membership mixing.

1. A logistic classifier over the words that a text holds (hashed to ``BUCKETS``), fitted on a bounded
   sample of the labelled table, gives every document posteriors p over the domains. Of a labelled
   text only its distinct buckets reach the driver, at most ``BUCKETS`` numbers.
2. Projected-gradient least squares finds the document rates r nearest to 1, from 0 to ``MOST``, such
   that the expected domain token totals, sum of r * n_tokens * p, match the targets. By duality
   r = 1 - p . g, projected onto the limits, with a multiplier for each domain. Gradient steps, each
   preconditioned by the sums of n_tokens * p_i * p_j, find g until every domain is within a
   ten-thousandth of its own target. Each is one aggregation (or a few, where a step is halved) of the
   stored (n_tokens, p) table into some numbers for each pair of domains; nothing else reaches the
   driver. Targets that aren't met are told by a warning.

Words are exploded and summed within the task that reads a document, so no text or
word is shuffled, only a row a document.

Cases: a null or empty text has 0 tokens, the prior as posterior and the rate of its
posterior. Unlabelled domains (no sample) get posterior 0 and their target is spread over
the others; without any label all domains are alike. Null ids stay (repeats of an id with equal
text are one input row each, of equal rate and copies). An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, sampled, with_clear_names

TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}
BUCKETS = 1 << 14
MOST = 16.0  # copies of a document


def label_domain() -> Column:
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b")]


def buckets_of(words: Column) -> Column:
    """The distinct buckets of a text's words."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def logistic(
    rows: list[tuple[int, list[int]]], k: int, steps: int = 120, rate: float = 0.1, decay: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS x k) and biases of (domain, buckets) rows, by Adam on the whole sample. Domains
    without a row have a bias that leaves them nothing."""
    own = np.array([d for d, _ in rows], np.int64)
    sizes = np.bincount(own, minlength=k)
    w, b = np.zeros((BUCKETS, k)), np.where(sizes > 0, np.log(np.maximum(sizes, 1) / max(1, len(rows))), -1e6)
    live = sizes > 0
    if live.sum() < 2:
        return w, b if len(rows) else np.zeros(k)
    at = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    bucket = np.array([x for _, xs in rows for x in xs], np.int64)
    goal = np.eye(k)[own]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(at, weights=w[bucket, j], minlength=len(rows)) for j in range(k)], axis=1) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - goal) / len(rows)
        for x, g, first, second in (
            (
                w, np.stack([np.bincount(bucket, weights=off[at, j], minlength=BUCKETS) for j in range(k)], axis=1) + decay * w,
                m, v
            ),
            (b, off.sum(axis=0) * live, mb, vb)
        ):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            x -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w * live, b


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], max_labelled: int) -> tuple[list[float], DataFrame]:
    """Biases by domain, and a table of bucket and its weights w0, w1, ...: at most BUCKETS rows. docs: doc_id, text.
    Of several texts of an id one counts, of several domains the first by name."""
    known = labels.where(
        F.col("doc_id").isNotNull() & F.col("domain").isin(domains)
    ).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = sampled(known, "doc_id", max_labelled)
    train = docs.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "domain",
        F.struct(F.xxhash64("text").alias("h"), F.sort_array(buckets_of(words_of(F.col("text")))).alias("b")).alias("x")
    )  # about max_labelled ids
    rows = train.groupBy("doc_id").agg(F.first("domain").alias("domain"), F.min("x").alias("x")).select("domain", "x.b").collect()
    w, bias = logistic(sorted((domains.index(r["domain"]), list(r["b"])) for r in rows), len(domains))
    some = np.flatnonzero(np.abs(w).max(axis=1) > 1e-4)
    flat = ";".join(",".join([str(i), *(f"{x:.5g}" for x in w[i])]) for i in some.tolist())
    parts = docs.sparkSession.range(1).select(
        F.explode(F.split(F.lit(flat), ";")).alias("x")
    ).where("x <> ''").select(F.split("x", ",").alias("x"))
    return bias.tolist(), parts.select(
        F.col("x")[0].cast("int").alias("bucket"), *[F.col("x")[i + 1].cast("double").alias(f"w{i}") for i in range(len(domains))]
    )


def posteriors(docs: DataFrame, id_col: str, text_col: str, bias: list[float], weights: DataFrame) -> DataFrame:
    """id, hashes of the text, n_tokens and p, the posterior array."""
    k = len(bias)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col), *hashes(F.col(text_col)),
        words_of(F.col(text_col)).alias("_words")
    )
    # an outer explode keeps documents without words; the aggregation is by the reading task's own row id
    words = rows.select(
        "_row", id_col, "_a", "_b", F.size("_words").cast("long").alias("n_tokens"),
        F.explode_outer(buckets_of(F.col("_words"))).alias("bucket")
    )
    seen = words.join(F.broadcast(weights), "bucket", "left")  # at most BUCKETS rows
    got = seen.groupBy("_row").agg(
        F.first(id_col).alias(id_col), F.first("_a").alias("_a"), F.first("_b").alias("_b"),
        F.first("n_tokens").alias("n_tokens"), *[F.sum(f"w{i}").alias(f"l{i}") for i in range(k)]
    )
    score = [F.coalesce(F.col(f"l{i}"), F.lit(0.0)) + F.lit(bias[i]) for i in range(k)]
    top = F.greatest(*score) if k > 1 else score[0]
    got = got.select(id_col, "_a", "_b", "n_tokens", F.array(*[F.exp(s - top) for s in score]).alias("e"))
    return got.select(
        id_col, "_a", "_b", "n_tokens",
        F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p")
    )


def rate_of(p: Column, g: list[float]) -> Column:
    """The rate of least change from 1 for the multipliers: 1 - p . g, between 0 and MOST."""
    return F.least(F.lit(MOST), F.greatest(F.lit(0.0), 1.0 - reduce(lambda x, y: x + y, [p[i] * x for i, x in enumerate(g)])))


def against_main(p: Column, ratios: list[float], main: int) -> Column:
    """For each domain its posterior less its ratio to the main domain's: totals of 0 are the ratios met. 0 for the main
    domain, which nothing holds."""
    return F.array(*[F.lit(0.0) if i == main else p[i] - p[main] * r for i, r in enumerate(ratios)])


def solve(
    soft: DataFrame, shares: list[float], iterations: int = 40, within: float = 1e-4
) -> tuple[list[float], list[float], list[float]]:
    """Multipliers, targets and reached totals, each within a share of its own target unless
    that can't be had. ``soft`` has n_tokens and p. The sum of targets is the largest for which
    no domain must be repeated."""
    mass = masses(soft, len(shares))
    live = [i for i in range(len(shares)) if mass[i] > 0 and shares[i] > 0]
    scale = sum(shares[i] for i in live)
    budget = min((mass[i] * scale / shares[i] for i in live), default=0.0)
    targets = np.array([budget * shares[i] / scale if i in live else 0.0 for i in range(len(shares))])
    g, reached = descend(soft, mass, targets, targets, iterations, within)
    return g, targets.tolist(), reached


def masses(soft: DataFrame, k: int) -> np.ndarray:
    return np.array([x or 0.0 for x in soft.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i]) for i in range(k)]).first()])


def descend(
    soft: DataFrame, mass: np.ndarray, targets: np.ndarray, sizes: np.ndarray, iterations: int, within: float
) -> tuple[list[float], list[float]]:
    """Multipliers and the totals that they reach: each within a share of its size from its target, if that can be."""
    k = len(targets)
    n, p, pairs = F.col("n_tokens"), F.col("p"), [(i, j) for i in range(k) for j in range(i, k)]

    def at(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Reached totals, the sums of n * p_i * p_j over rates between the limits, and the dual value."""
        rate = rate_of(p, g.tolist())
        inside = (rate > 0) & (rate < MOST)
        sums = [
            x or 0.0 for x in soft.agg(
                *[F.sum(rate * n * p[i]) for i in range(k)], *[F.sum(F.when(inside, n * p[i] * p[j])) for i, j in pairs],
                F.sum(n * (rate - 1) * (rate - 1))
            ).first()
        ]
        both = np.zeros((k, k))
        for (i, j), x in zip(pairs, sums[k:-1]):
            both[i, j] = both[j, i] = x
        return np.array(sums[:k]), both, sums[-1] / 2 + float(g @ (sums[:k] - targets))

    g = np.zeros(k)
    reached, both, value = at(g)
    for _ in range(iterations):
        if missed(targets, reached, sizes) <= within:
            break
        step = np.linalg.solve(both + np.diag(1e-9 * np.abs(mass) + 1e-9), reached - targets)
        size = 1.0
        while size > 1e-4:  # the dual value is concave in g: a step that is too long is halved
            new = at(g + size * step)
            if new[2] >= value + 1e-4 * size * float(step @ (reached - targets)) or missed(targets, new[0], sizes) <= within:
                break
            size /= 2
        else:
            break
        g, (reached, both, value) = g + size * step, new
    return g.tolist(), reached.tolist()


def missed(targets, reached, sizes=None) -> float:
    """The largest distance from a target, as a share of its size (of all, where that is 0)."""
    sizes = targets if sizes is None else sizes
    return max((abs(r - t) / (z or max(sum(sizes), 1.0)) for t, r, z in zip(targets, reached, sizes)), default=0.0)


def told(domains: list[str], targets, reached, sizes=None) -> None:
    if missed(targets, reached, sizes) > 1e-4:
        warnings.warn(
            "mixing doesn't meet its targets: " + ", ".join(
                f"{d} {r:.0f} of {t:.0f} tokens" for d, t, r in zip(domains, targets, reached)
            ),
            stacklevel=3
        )


def rates(soft: DataFrame, domains: list[str], shares: list[float], iterations: int, repeat: float | None) -> Column:
    """The rate of a row of ``soft``. With ``repeat`` the domain of the largest share sets the size: a document wholly
    of it has rate 1, and the others follow it by their shares, up to ``repeat`` times what they have."""
    if repeat is None:
        g, targets, reached = solve(soft, shares, iterations)
        told(domains, targets, reached)
        return rate_of(F.col("p"), g)
    mass = masses(soft, len(shares))
    live = [i for i in range(len(shares)) if mass[i] > 0 and shares[i] > 0]
    if not live:
        return F.lit(1.0)
    main = max(live, key=lambda i: shares[i])
    ratios = [
        0.0 if i == main or i not in live else min(
            shares[i] / shares[main], repeat * mass[i] / mass[main]
        ) for i in range(len(shares))
    ]
    turned, sizes = soft.withColumn("p", against_main(F.col("p"), ratios, main)), np.array(ratios) * mass[main]
    g, reached = descend(turned, mass, np.zeros(len(shares)), sizes, iterations, 1e-4)
    told([f"{d} beyond its share" for d in domains], [0.0] * len(shares), reached, sizes)
    whole = 1 + sum(r * x for r, x in zip(ratios, g))  # the rate of p = 1 for the main domain
    return rate_of(against_main(F.col("p"), ratios, main), g) / (whole if whole > 0 else 1.0)


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = 4000, iterations: int = 40, repeat: float | None = None, carry: list[str] | None = None
) -> DataFrame:
    """id, n_tokens, p_<domain>, rate, and copies: the rate rounded down or up by a hash of
    the id, so that the expected number of copies is the rate. labels: doc_id, domain. For
    ``repeat`` see ``rates``. With ``carry`` (which may include id and text) the result is these
    columns, a row for each copy."""
    targets = targets or TARGETS
    domains = list(targets)
    every = docs
    docs = with_clear_names(docs, id_col, text_col)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bias, weights = fit(known, labels.select("doc_id", "domain"), domains, max_labelled)
    soft = materialise(posteriors(docs, id_col, text_col, bias, weights), "mix")
    out = soft.withColumn("rate", rates(soft, domains, [targets[d] for d in domains], iterations, repeat))
    own = F.when(F.col(id_col).isNull(), F.col("_a"))  # null ids are told apart by their texts
    unit = F.pmod(F.xxhash64(F.col(id_col), own, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    out = out.withColumn("copies", F.floor(F.col("rate") + unit).cast("int"))
    if carry is None:
        return out.select(id_col, "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")
    # equal rows have equal copies, so rows are found again by id and text
    taken = out.where("copies > 0").groupBy(
        F.col(id_col).alias("_id"), "_a", "_b"
    ).agg(F.max("copies").alias("_copies")).withColumnsRenamed({"_a": "_a2", "_b": "_b2"})
    rows = every.select(*[F.col(f"`{c}`") for c in carry], F.col(id_col).alias("_own"), *hashes(F.col(text_col)))
    several = rows.join(
        taken, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_a") == F.col("_a2")) & (F.col("_b") == F.col("_b2"))
    )
    return several.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    ).select(*[F.col(f"`{c}`") for c in carry])
