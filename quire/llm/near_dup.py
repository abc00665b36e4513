"""Near-duplicate groups by BagMinHash.

A document is the bag of its five-word shingles (words split at white space; a shorter
text is one shingle). The weighted Jaccard similarity of two bags is the sum of smaller
over the sum of larger counts.

Signature: every (shingle, dyadic block of counts) drives a Poisson process whose rate is
the block's width: blocks [0,1), [1,2), [2,4), ... A point carries a time, a register
and a level of its block; it exists for a document if the level lies under the shingle's count.
A register keeps the earliest time. As levels under both counts share their points, registers
agree with a probability of the weighted Jaccard similarity. Points are made in order of
time up to a horizon at which all registers are filled (else it is doubled), so a document costs
about m log m points however long or heavy it is, and the result doesn't depend on the horizon.

Candidates share one of ``bands`` bands of ``rows`` registers; 32 x 5 miss a pair at 0.8 three
times in a million. Equal texts are one node. Links are verified with exact bags, in four steps.

1. Each member of a bucket meets the bucket's least member; links are contracted to components.
2. Where a bucket still holds several components, one member of its largest meets all of the others.
3. Of what is still apart, each text gets the weight of its shingles that others there have too.
   Below the threshold's share of its own weight it can have no link (exact, not a guess).
4. Pairs of different components of a bucket meet where both weights and the parities of their shingles'
   counts in 1024 buckets allow the threshold (exact bounds both), each in the first band that they share; members of the bucket's largest component never meet each other.

No candidate is capped. Step 4 can grow faster than a bucket where many texts lie just under the threshold.

Cases: texts without words (null, empty, blank) form no links, but equal ones share a class.
Repeated rows share a class. Null ids are allowed; a class is named by its least id. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stored, join_counted, with_clear_names

U = np.uint64
WIDTH = 5
_SHINGLE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)
_MASK = U((1 << 48) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _salt(n: int, by: int) -> np.uint64:
    return U(n * int(_SHINGLE[by]) & (1 << 64) - 1)


class _Words(dict):
    """64-bit hashes of words, in a bounded cache."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The hashes of all shingles of a text, with repeats."""
    words = (text or "").split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    if len(h) < WIDTH:
        return mixed((h * _SHINGLE[: len(h)]).sum(keepdims=True) + U(len(h)))
    n = len(h) - WIDTH + 1
    s = h[:n] * _SHINGLE[0]
    for j in range(1, WIDTH):
        s += h[j : j + n] * _SHINGLE[j]
    return mixed(s)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted shingles, counts)."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both / (total - both)


def signatures(bags: list[np.ndarray], m: int) -> np.ndarray:
    """The m registers of each bag (shingle hashes with repeats); empty bags stay infinite."""
    sig = np.full((len(bags), m), np.inf)
    sizes = np.array([len(b) for b in bags])
    if not sizes.sum():
        return sig
    key = np.sort((np.repeat(np.arange(len(bags), dtype=U), sizes) << U(48)) | (np.concatenate(bags) >> U(16)))
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(edges, len(key))).astype(np.float64)
    x, doc = mixed(key[edges] & _MASK), (key[edges] >> U(48)).astype(np.int64)
    parts, low = [], 0.0
    for block in range(64):
        width = max(1.0, low)
        some = np.flatnonzero(count > low)
        if not len(some):
            break
        parts.append((mixed(x[some] + _salt(block, 1)), doc[some], np.full(len(some), width), count[some] - low))
        low += width
    seed, doc, rate, limit = (np.concatenate(p) for p in zip(*parts))
    horizon = m * (np.log(m) + 4) / np.maximum(sizes, 1)
    todo = sizes > 0
    flat = sig.reshape(-1)
    while todo.any():
        on = np.flatnonzero(todo[doc])
        s, d, q, top, t = seed[on], doc[on], rate[on], limit[on], np.zeros(len(on))
        step = 0
        while len(s):
            step += 1
            e = mixed(s + _salt(2 * step, 2))
            t = t - np.log(((e >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / q
            live = t <= horizon[d]
            s, d, q, top, t = s[live], d[live], q[live], top[live], t[live]
            e = mixed(s + _salt(2 * step + 1, 2))
            at = d * m + ((e >> U(40)) % U(m)).astype(np.int64)
            own = (e & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * q < top
            np.minimum.at(flat, at[own], t[own])
        todo &= np.isinf(sig).any(axis=1)
        horizon = np.where(todo, horizon * 2, horizon)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band."""
    bits = sig.view(U).reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), U) + np.arange(bands, dtype=U) * _SHINGLE[3]
    for r in range(rows):
        key = mixed(key * _SHINGLE[4] + bits[:, :, r])
    return key.view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, node (the text's 128-bit hash) and bands; no bands without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> pd.DataFrame:
            keys = band_keys(signatures(bags, bands * rows), bands, rows)
            return pd.DataFrame(
                {id_col: ids, "node": nodes, "bands": [k if len(b) else np.empty(0, np.int64) for k, b in zip(keys, bags)]}
            )

        for pdf in batches:
            ids, nodes, bags, held = [], [], [], 0
            for key, node, text in zip(pdf[id_col], pdf["node"], pdf[text_col]):
                bags.append(shingles(text))
                ids.append(key)
                nodes.append(node)
                held += len(bags[-1])
                if held > 300_000 or len(bags) >= 4096:
                    yield done()
                    ids, nodes, bags, held = [], [], [], 0
            if bags:
                yield done()

    return keyed(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, node binary, bands array<long>")


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_clear_names(docs, id_col, text_col).withColumn("node", node_of(F.col(text_col)))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, per_block: int = 512) -> Stored:
    """Those of the pairs (u, v) whose exact similarity reaches the threshold. Nodes are dealt
    into blocks of about ``per_block``, pairs into pairs of blocks: a task holds the texts of two
    blocks at most, and a text moves once for each pair of blocks that needs it."""
    blocks = max(1, texts.count() // per_block)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = Stored(pairs.select("u", "v", block("u").alias("bu"), block("v").alias("bv")), "pairs")
    needed = dealt.df.select(
        F.col("bu").alias("nu"), F.col("bv").alias("nv"), F.explode(F.array("u", "v")).alias("node")
    ).distinct().join(texts, "node")

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        text = dict(zip(map(bytes, theirs["node"]), theirs["text"]))
        bags: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def bag(node: bytes) -> tuple[np.ndarray, np.ndarray]:
            if node not in bags:
                bags[node] = np.unique(shingles(text[node]), return_counts=True)
            return bags[node]

        keep = [similarity(bag(bytes(u)), bag(bytes(v))) >= threshold for u, v in zip(ours["u"], ours["v"])]
        return ours.loc[keep, ["u", "v"]]

    found = Stored(
        dealt.df.groupBy("bu", "bv").cogroup(needed.groupBy("nu", "nv")).applyInPandas(run, "u binary, v binary"), "links"
    )
    dealt.drop()
    return found


def weights(texts: DataFrame) -> DataFrame:
    """node, size (of its bag) and shared: how much of it lies in shingles that another of
    these texts has too, a bound on what it can have in common with any of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, text in zip(pdf["node"], pdf["text"]):
                bag = shingles(text)
                h, n = np.unique(bag, return_counts=True)
                yield pd.DataFrame({"node": [node] * len(h), "h": h.view(np.int64), "n": n, "size": len(bag)})

    each = texts.select("node", "text").mapInPandas(run, "node binary, h long, n long, size long")
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    return each.join(common, "h").groupBy("node").agg(F.first("size").alias("size"), F.sum("n").alias("shared"))


def parities(texts: DataFrame, longs: int = 16) -> DataFrame:
    """node and, for each of 64 * ``longs`` buckets of shingles, the parity of the bag's count.
    Each bucket with unequal parities holds a difference of two bags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            odd = [
                np.bincount(
                    (shingles(t) % U(64 * longs)).astype(np.int64), minlength=64 * longs
                ).astype(np.uint8) & 1 for t in pdf["text"]
            ]
            yield pd.DataFrame({"node": pdf["node"], "odd": [np.packbits(b).view(np.int64) for b in odd]})

    return texts.select("node", "text").mapInPandas(run, "node binary, odd array<long>")


def components(links: DataFrame) -> Stored:
    """(node, comp) of every node with a link. Each turn moves every node to the least of
    itself and its neighbours and contracts the links, until none is left."""
    edges = Stored(
        links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    comp = Stored(
        edges.df.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("comp", F.col("node")), "comp"
    )
    while not edges.df.isEmpty():
        ways = edges.df.unionAll(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = Stored(
            ways.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("at"), F.least("u", "w").alias("to")), "step"
        )
        moved = edges.df.join(
            step.df.select(F.col("at").alias("u"), F.col("to").alias("a")), "u"
        ).join(step.df.select(F.col("at").alias("v"), F.col("to").alias("b")), "v")
        edges2 = Stored(
            moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges"
        )
        comp2 = Stored(
            comp.df.join(
                step.df.withColumnRenamed("at", "comp"), "comp", "left"
            ).select("node", F.coalesce("to", "comp").alias("comp")),
            "comp"
        )
        for old in (edges, comp, step):
            old.drop()
        edges, comp = edges2, comp2
    return comp


def placed(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> DataFrame:
    """id, node and comp (the class), a row for every input row."""
    sig = Stored(sign(docs, id_col, text_col, bands, rows), "bags")
    nodes = sig.df.where(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    centers = keys.groupBy("key").agg(F.min("node").alias("c"), F.max("node").alias("z")).where("c <> z").select("key", "c")
    members = Stored(keys.join(centers, "key").select("key", "band", "node", "c"), "buckets")  # only buckets of two or more
    stars = members.df.where("node <> c").select(F.col("c").alias("u"), F.col("node").alias("v")).distinct()

    reps = sig.df.join(members.df.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(id_col).alias("_rep"))
    rows_ = keyed(docs, id_col, text_col).select("node", F.col(id_col).alias("_rep"), F.col(text_col).alias("text"))
    texts = rows_.join(reps, (rows_["node"] == reps["node"]) & rows_["_rep"].eqNullSafe(reps["_rep"]), "left_semi")
    texts = Stored(texts.groupBy(rows_["node"]).agg(F.first("text").alias("text")), "texts")  # repeated rows have equal texts
    links = [verified(stars, texts.df, threshold)]
    comp = components(links[0].df)

    def opened() -> Stored:
        """Members of buckets with several components, and whether theirs is the bucket's largest."""
        placed = members.df.select("key", "band", "node").join(comp.df, "node", "left").select(
            "key", "band", "node", F.coalesce("comp", "node").alias("comp")
        )
        parts = placed.groupBy("key", "comp").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("c")
        )
        tops = parts.groupBy("key").agg(
            F.max(F.struct("n", "comp", "c")).alias("top"), F.count(F.lit(1)).alias("parts")
        ).where("parts > 1")
        return Stored(
            placed.join(tops.select("key", "top"), "key").select(
                "key", "band", "node", "comp", F.col("top.c").alias("c"), (F.col("comp") == F.col("top.comp")).alias("main")
            ),
            "open"
        )

    def more(pairs: DataFrame) -> None:
        nonlocal comp
        links.append(verified(pairs, texts.df, threshold))
        if not links[-1].df.isEmpty():
            comp.drop()
            comp = components(reduce(DataFrame.unionAll, [x.df for x in links]))

    # a second star, from the largest component of each bucket to all others
    open_ = opened()
    more(open_.df.where("not main").select(F.least("c", "node").alias("u"), F.greatest("c", "node").alias("v")).distinct())
    open_.drop()
    # what is still apart: all pairs of a bucket that the bounds allow, each in the first band that it shares
    open_ = opened()
    alone = open_.df.select("node").distinct().join(texts.df, "node")
    known = Stored(
        weights(alone).where(
            F.col("shared") >= threshold * F.col("size") - 1e-6
        ).join(nodes, "node").join(parities(alone), "node"),
        "weights"
    )
    able = open_.df.drop("c").join(known.df, "node")  # few rows are left, with 8 bytes a band
    u, v = (
        able.select(
            "key", "band", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "main", "size", "shared", "bands", "odd")]
        ) for side in "uv"
    )
    apart = "comp_u <> comp_v and (main_v or comp_u < comp_v)"
    near = F.least("shared_u", "shared_v") >= threshold / (1 + threshold) * (F.col("size_u") + F.col("size_v")) - 1e-6
    # a bound on the difference of two bags: that of a pair at the threshold is (1 - t) / (1 + t) of their sizes at most
    unlike = reduce(
        lambda x, y: x + y, [F.bit_count(F.get("odd_u", F.lit(i)).bitwiseXOR(F.get("odd_v", F.lit(i)))) for i in range(16)]
    )
    like = unlike <= (1 - threshold) / (1 + threshold) * (F.col("size_u") + F.col("size_v")) + 1e-6
    first = F.expr("not exists(slice(zip_with(bands_u, bands_v, (x, y) -> x = y), 1, band), e -> e)")
    pairs = u.where("not main_u").join(v.drop("band"), "key").where(apart).where(near).where(like).where(first)
    more(pairs.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct())
    for old in (members, texts, open_, known, *links):
        old.drop()

    return sig.df.select(id_col, "node").join(comp.df, "node", "left").select(
        id_col, "node", F.coalesce("comp", "node").alias("comp")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 32, rows: int = 5
) -> DataFrame:
    """id, class_id (the least id of the class) and class_size, a row for every input row."""
    own = Stored(placed(docs, id_col, text_col, threshold, bands, rows), "placed")
    classes = Stored(
        own.df.groupBy("comp").agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes"
    )
    return join_counted(own.df, classes.df, ["comp"], "class_size").select(id_col, "class_id", "class_size")


def one_of_each(
    docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 32,
    rows: int = 5
) -> DataFrame:
    """The columns (among them id and text) of one row of each class: of the least id, null ids last, and of
    rows equal in id and text the least."""
    first = F.min(
        F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("_id"), F.col("node").alias("_node"))
    ).alias("x")
    kept = placed(docs, id_col, text_col, threshold, bands, rows).groupBy("comp").agg(first).select("x._id", "x._node")
    own = with_clear_names(docs, *columns).withColumn("node", node_of(F.col(text_col)))
    own = own.join(kept, (F.col("node") == F.col("_node")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    return own.groupBy("node").agg(F.min(F.struct(*columns)).alias("x")).select("x.*")
