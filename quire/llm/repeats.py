"""Removal of repeated passages, by interval expansion on a Burrows-Wheeler transform.

Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else in
the corpus; matches never cross documents.

1. Anchors. Every window of ``length`` bytes has a minimizer, its least ``GRAM``-byte string by
   a hash. Equal windows have equal minimizers at the same place, so only windows with
   the same minimizer need be compared. Consecutive windows with one minimizer are one
   occurrence: (minimizer hash, hash of all bytes that its windows span). Names are counted
   first; occurrences of a name seen once are dropped where they are made. Occurrences
   equal in both hashes (128 bits) repeat as a whole; this settles nearly everything by counting.
2. Edges. Minimizers seen with several spans leave a small pool, one text per distinct
   span. Those that share too few bytes around the minimizer are left out. Pools are concatenated, in batches that keep a minimizer's spans together, and
   their common prefixes derived by a threshold-bounded breadth-first expansion: the
   boundaries between suffixes that differ within l + 1 bytes follow from those that differ
   within l by one backward extension on the transform. Expansion stops at ``length``: suffixes
   not parted by then share a prefix of ``length`` bytes.
3. A minimizer with more than ``batch_spans`` spans (a very common line) isn't gathered: its
   windows are counted by their 128-bit hashes, which is exact and has no group in one task.

All counts are aggregations with map-side combination. In the joins back, keys that hold over
a thousandth of the rows (fewer than a thousand keys) are dealt over parts or meet a
broadcast, so a passage in a third of all documents is in no one task. Texts move twice, keyed
by document.

Cases: a null text is empty. Texts under ``length`` bytes stay. Repeated rows are documents of
their own and so repeat each other. Null ids are allowed. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stored, hot_keys, join_counted
from quire.llm.near_dup import mixed

U = np.uint64
GRAM = 40
BATCH = 1 << 20  # bytes of one transform
PARTS = 64  # of a hot name
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each string of ``gram`` bytes."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    lanes = mixed(eight * _LANES[0] + _LANES[1])
    g = len(data) - gram + 1
    h = lanes[:g] * _LANES[0]
    for j in range(1, gram // 8):
        h += lanes[8 * j : 8 * j + g] * _LANES[j]
    return mixed(h)


def anchors(raw: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first and last window start, minimizer position and minimizer hash of each occurrence.
    Of equal hashes in a window the leftmost is the minimizer."""
    n = len(raw)
    if n < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U),)
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    first, last, place, names = [], [], [], []
    w, piece = length - gram + 1, 1 << 23
    for a in range(0, n - length + 1, piece):  # the position fits in 24 bits
        part = h[a : a + piece + w - 1]
        part = (part & ~U((1 << 24) - 1)) | np.arange(len(part), dtype=U)
        at = (_sliding_min(part, w) & U((1 << 24) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        first.append(begin + a)
        last.append(np.append(begin[1:], len(at)) - 1 + a)
        place.append(at[begin] + a)
        names.append(h[at[begin] + a])
    return np.concatenate(first), np.concatenate(last), np.concatenate(place), np.concatenate(names)


def seed_of(depth: int) -> int:
    """The prefix at which the expansion begins: the largest power of two up to ``depth``."""
    return 1 << (depth.bit_length() - 1)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` by their first ``depth`` bytes at least, by doubling, which
    sorts only what isn't parted yet; and their ranks by half a seed."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(U)
    key = np.zeros(n, U)
    for j in range(8):
        key = (key << U(8)) | padded[j : j + n]
    order = np.argsort(key)
    ranked = key[order]
    begins = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.zeros(n, np.int64)
    span, half, seed = 8, rank, seed_of(depth)
    while True:
        starts = np.flatnonzero(begins)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        if span == seed // 2:
            half = rank
        if span >= depth:
            return order, half
        alone = begins & np.append(begins[1:], True)
        slots = np.flatnonzero(~alone)
        some = order[slots]
        after = np.minimum(some + span, n - 1)
        key = (rank[some] << 32) | np.where(some + span < n, rank[after] + 1, 0)
        by = np.argsort(key)
        order[slots], key = some[by], key[by]
        begins[slots] = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else False
        span *= 2


def parted(text: np.ndarray, order: np.ndarray, half: np.ndarray, depth: int) -> np.ndarray:
    """Where suffixes neighbouring in ``order`` differ within ``depth`` bytes, by increasing
    common prefix. It begins with the intervals of a seed; a queue holds the boundaries
    with prefix l, and each is extended backward by the bytes of the transform in all
    parts of its interval but the largest."""
    n, seed = len(text), seed_of(depth)
    transform = text[order - 1].astype(np.int64)  # order - 1 is -1, the last byte, for the whole text
    key = transform * n + np.arange(n)
    key.sort()
    starts = np.searchsorted(key, np.arange(257) * n)
    ranks = np.concatenate((half, -1 - np.arange(seed)))  # past the end nothing is equal
    same = [ranks[order[1:] + k] == ranks[order[:-1] + k] for k in (0, seed // 2 - 1, seed // 2)]
    cut = np.ones(n + 1, bool)
    cut[1:n] = ~(same[0] & same[2])
    queue = np.flatnonzero(same[0] & same[1] & ~same[2]) + 1
    # only what shares a seed, and the boundaries beside it, is looked at from here on
    live = np.flatnonzero(~(cut[:-1] & cut[1:]) | np.isin(np.arange(n), np.concatenate((queue, queue - 1))))
    flags = np.append(cut[live], True)
    place_of = np.zeros(n, np.int64)
    place_of[live] = np.arange(len(live))
    queue = place_of[queue]
    fresh = np.zeros(len(live) + 1, bool)
    for _ in range(depth - seed):
        if not len(queue):
            break
        fresh[queue] = True
        ends = np.flatnonzero(flags)
        at = np.searchsorted(ends, queue)
        piece = _distinct(np.concatenate((at - 1, at)))  # the intervals that the queue's boundaries part
        begin, size = ends[piece], ends[piece + 1] - ends[piece]
        whole = np.cumsum(~fresh[begin])  # what they were before
        fresh[queue] = False
        largest = np.lexsort((-size, whole))
        largest = largest[np.concatenate(([True], np.diff(whole[largest]) > 0))]
        rest = np.delete(np.arange(len(piece)), largest)  # a byte on two sides of a boundary is in one of these
        begin, size = live[begin[rest]], size[rest]
        owner = np.repeat(np.arange(len(rest)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
        pairs = _distinct(owner * 256 + transform[place])
        owner, byte = pairs >> 8, pairs & 255
        edge = np.concatenate((begin[owner], begin[owner] + size[owner]))
        ask = _distinct(np.concatenate((byte, byte)) * n + edge)
        byte = ask // n
        new = np.searchsorted(key, ask)  # suffixes that begin with the byte, then come before the edge
        new = new[(new > starts[byte]) & (new < starts[byte + 1])]
        new = _distinct(new[~cut[new]])
        cut[new] = True
        queue = place_of[new]
        flags[queue] = True
    return cut[:n]


def able(spans: list[bytes], names: np.ndarray, length: int, gram: int = GRAM, step: int = 20) -> np.ndarray:
    """Which spans can share a window with another of the same minimizer. The minimizer is the
    leftmost string of its hash in a span, and equal windows have it at the same place: with
    a bytes before it, rounded down to ``step``, they share the length - step bytes from there."""
    sizes = np.array([len(s) for s in spans])
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = gram_hashes(np.frombuffer(b"".join([*spans, bytes(gram)]), np.uint8), gram)
    owner = np.repeat(np.arange(len(spans)), sizes)
    hit = np.flatnonzero(h[: len(owner)] == names[owner])
    place = hit[np.unique(owner[hit], return_index=True)[1]]
    size, found = length - step, np.zeros(len(spans), bool)
    for before in range(0, length - gram, step):
        begin = place - before
        some = np.flatnonzero((begin >= offsets) & (begin + size <= offsets + sizes))
        key = np.zeros(len(some), U)
        for at in (*range(0, size - gram, gram), size - gram):
            key = mixed(key * _LANES[3] + h[begin[some] + at])
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        found[some[times[which] > 1]] = True
    return found


def shared_windows(spans: list[bytes], many: np.ndarray, length: int) -> list[np.ndarray]:
    """For each span, which of its windows also starts elsewhere among the spans; ``many``
    marks spans that themselves occur more than once."""
    text = np.frombuffer(b"\xff".join([*spans, b""]), np.uint8)  # 0xff is in no UTF-8 text
    sizes = np.array([len(s) for s in spans])
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order, half = suffix_order(text, length)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(parted(text, order, half, length)) - 1
    starts = np.concatenate([np.arange(o, o + s - length + 1) for o, s in zip(offsets, sizes)])
    owner = np.repeat(np.arange(len(spans)), sizes - length + 1)
    weight = np.bincount(group[starts], weights=1 + many[owner], minlength=len(text))
    return np.split(weight[group[starts]] > 1, np.cumsum(sizes - length + 1)[:-1])


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


def keyed(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """id, text and row, a hash of both: what is found of a row holds for its equals."""
    return docs.select(
        *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry], F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("row")
    )


def _numbered(rows: DataFrame, length: int, make, schema: str) -> DataFrame:
    """What ``make`` gives for the occurrences of each text, in frames of some 100,000."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for key, row, text in zip(pdf["id"], pdf["row"], pdf["text"]):
                raw = _bytes(text)
                found = anchors(raw, length)
                if len(found[0]):
                    out.append(make(key, row, raw, *found))
                    held += len(found[0])
                if held > 100_000:
                    yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})
                    out, held = [], 0
            if out:
                yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    return rows.select("id", "row", "text").mapInPandas(run, schema)


def names_of(rows: DataFrame, length: int) -> DataFrame:
    """name, the minimizer's hash, of each occurrence."""
    return _numbered(rows, length, lambda key, row, raw, first, last, place, name: {"name": name.view(np.int64)}, "name long")


def occurrences(rows: DataFrame, length: int, hot: list[int]) -> DataFrame:
    """id, row, name, span, at (first window start, and how many more in the lower half) and part: 0,
    or one of ``PARTS`` in turn for the names of ``hot``."""
    kind, often = rows.schema["id"].dataType.simpleString(), np.array(sorted(hot), np.int64)
    digest = xxhash.xxh3_64_intdigest

    def make(key, row, raw, first, last, place, name):
        n, name = len(first), name.view(np.int64)
        span = np.fromiter(
            (digest(raw[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())), U, n
        )
        part = np.where(np.isin(name, often), (np.arange(n) + row) % PARTS, 0).astype(np.int32)
        return {
            "id": np.repeat([key], n), "row": np.full(n, row, np.int64), "name": name, "span": span.view(np.int64),
            "at": first << 32 | (last - first), "part": part
        }

    return _numbered(rows, length, make, f"id {kind}, row long, name long, span long, at long, part int")


def first_of(at: Column) -> Column:
    return F.call_function("shiftright", at, F.lit(32)).cast("int")


def more_of(at: Column) -> Column:
    return at.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, length: int, batch_spans: int) -> tuple[DataFrame, list[Stored]]:
    """(id, row, first, last): starts of windows that also start elsewhere."""
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    # a minimizer seen once settles itself: only names move for it, and nothing is written
    names = Stored(names_of(rows, length).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "names")
    hot = hot_keys(names.df, "n")
    parts = F.when(F.col("name").isin(hot), PARTS).otherwise(1) if hot else F.lit(1)
    known = names.df.select("name", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    found = Stored(occurrences(rows, length, hot).join(known, ["name", "part"], "left_semi").drop("part"), "anchors")
    # one occurrence of each span stands for it
    spans = Stored(
        found.df.groupBy("name", "span").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("id", "row", "at")]),
        "spans"
    )
    several = Stored(spans.df.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "several")
    pool = join_counted(spans.df.drop("span"), several.df, ["name"], "k")
    spot = F.struct("name", first_of(F.col("at")).alias("first"), more_of(F.col("at")).alias("more"), "n", "k")
    listed = pool.groupBy("id", "row").agg(F.collect_list(spot).alias("spans"))  # at most a few per 100 bytes of one text
    texts = rows.select("id", "row", "text").join(
        listed.withColumnsRenamed({"id": "_id", "row": "_row"}),
        (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))
    ).select("id", "row", "text", "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, seen = [], set()
            for key, row, text, spans in zip(pdf["id"], pdf["row"], pdf["text"], pdf["spans"]):
                if (key, row) in seen:  # an equal row, read just before
                    continue
                seen.add((key, row))
                raw = _bytes(text)
                for s in spans:
                    out.append(
                        (key, row, s["first"], s["name"], s["n"], s["k"], raw[s["first"] : s["first"] + s["more"] + length])
                    )
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    columns = ["id", "row", "first", "name", "n", "k", "span"]
    edges = Stored(texts.mapInPandas(cut, f"id {kind}, row long, first int, name long, n long, k long, span binary"), "edges")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def done(held: list[tuple]) -> pd.DataFrame:
            keep = able([bytes(h[4]) for h in held], np.array([h[5] for h in held]).view(U), length)
            held = [h for h, k in zip(held, keep) if k]
            if not held:
                return pd.DataFrame({"id": [], "row": [], "first": [], "last": []})
            flags = shared_windows([bytes(h[4]) for h in held], np.array([h[3] > 1 for h in held]), length)
            rows = [
                (h[0], h[1], h[2] + a, h[2] + b) for h, f in zip(held, flags) if h[3] == 1 for a, b in zip(*(x.tolist() for x in _ranges(f)))
            ]
            return pd.DataFrame(rows, columns=["id", "row", "first", "last"])

        name = None
        for pdf in batches:
            for key, row, first, own, n, span in zip(pdf["id"], pdf["row"], pdf["first"], pdf["name"], pdf["n"], pdf["span"]):
                if own != name and size > BATCH:
                    yield done(held)
                    held, size = [], 0
                name = own
                held.append((key, row, first, n, span, own))
                size += len(span) + 1
        if held:
            yield done(held)

    schema = f"id {kind}, row long, first int, last int"
    few = edges.df.where(F.col("k") <= batch_spans).repartition("name").sortWithinPartitions("name").select(
        "id", "row", "first", "name", "n", "span"
    ).mapInPandas(expand, schema)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for key, row, first, n, span in zip(pdf["id"], pdf["row"], pdf["first"], pdf["n"], pdf["span"]):
                h = [xxhash.xxh3_128_digest(span[i : i + length]) for i in range(len(span) - length + 1)]
                out.append(
                    (
                        np.repeat([key], len(h)), np.full(len(h), row), np.arange(first, first + len(h), dtype=np.int32),
                        np.full(len(h), n), h
                    )
                )
                held += len(h)
                if held > 100_000:
                    yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("id", "row", "first", "n", "h"), zip(*out))})
                    out, held = [], 0
            if out:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("id", "row", "first", "n", "h"), zip(*out))})

    each = Stored(
        edges.df.where(F.col("k") > batch_spans).select("id", "row", "first", "n", "span").mapInPandas(
            windows, f"id {kind}, row long, first int, n long, h binary"
        ),
        "windows"
    )
    twice = Stored(each.df.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("c")).where("all > 1"), "twice")
    common = join_counted(each.df.where("n = 1"), twice.df, ["h"], "c").select("id", "row", "first", F.col("first").alias("last"))
    again = spans.df.where("n > 1").select("name", "span", "n")
    settled = join_counted(found.df, again, ["name", "span"], "n").select(
        "id", "row", first_of(F.col("at")).alias("first"), (first_of(F.col("at")) + more_of(F.col("at"))).alias("last")
    )
    # what has been found of equal rows is found once a row: the same range each time
    return settled.unionAll(few).unionAll(common), [names, found, spans, several, edges, each, twice]


def covered(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes [a, b) that the windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batch_spans: int = 4096,
    with_text: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and on request the remaining text, where
    characters cut in two are dropped, and other columns to carry) of every row."""
    carry = carry or []
    rows = keyed(docs, id_col, text_col, *carry)
    kind = rows.schema["id"].dataType.simpleString()
    ranges, stored = repeated_ranges(docs, id_col, text_col, length, batch_spans)
    ranges = Stored(ranges.groupBy("id", "row").agg(F.collect_set(F.struct("first", "last")).alias("cuts")), "cuts")  # of one text
    for old in stored:
        old.drop()
    joined = rows.join(
        ranges.df.withColumnsRenamed({"id": "_id", "row": "_row"}),
        (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")), "left"
    ).select("id", "text", "cuts", *[f"c_{c}" for c in carry])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, cuts in zip(pdf["id"], pdf["text"], pdf["cuts"]):
                raw = _bytes(text)
                runs = covered([c["first"] for c in cuts], [c["last"] for c in cuts], length) if cuts is not None else []
                edges = [0, *[x for r in runs for x in r], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else raw
                out.append(
                    (
                        key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                        *([kept.decode("utf-8", "ignore")] if with_text else [])
                    )
                )
            yield pd.DataFrame(out, columns=names).assign(**{c: pdf[f"c_{c}"] for c in carry})

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *([text_col] if with_text else [])]
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + f", `{text_col}` string" * with_text + "".join(
        f", `{c}` {rows.schema[f'c_{c}'].dataType.simpleString()}" for c in carry
    )
    return joined.mapInPandas(apply, schema)
