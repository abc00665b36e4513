"""Best-fit packing with bound-certified repacking.

Texts are tokenised once, in the task that reads them, and cut into pieces of at most
``capacity`` ids. Pieces of full length are sequences by themselves. The others are
dealt by a hash to partitions of bounded size, each packed by best-fit decreasing. Dual
feasible functions give a lower bound of each partition's bins. A partition that
meets its bound is certified and keeps its bins but the emptiest; one with a gap gives
up all bins that aren't full. What is given up is dealt anew over fewer partitions and packed
again, until the bins meet the bound of the whole, one partition holds all, or ``rounds`` are over.

Only counts by length (at most ``capacity``) ever meet in one place.

Cases: a null or empty text is one piece of the end id. Repeated rows are packed each. A
document longer than the capacity has a shorter first piece unless it divides evenly.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stored, with_clear_names

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's pre-tokens


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as
    the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers: the vocabulary of a
    byte-level tokenizers file, whose ids are its merge order, run by tiktoken, which takes a
    fifth of the time for the same ids (tests compare them). With ``added``, added tokens in a text
    get their own ids; without, they are split like any other text."""

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        byte_of, tokenizer = _byte_of(), Tokenizer.from_file(path)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all", disallowed_special=()), "<u4").tobytes()


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False, added: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, on request) of each piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer, added)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                raw = encoder.ids(text or "") + end
                n = len(raw) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = raw[4 * a : 4 * b]
                    rows.append(
                        (key, i, a, b - a, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else []))
                    )
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return with_clear_names(docs, id_col, text_col).mapInPandas(cut, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Of the bins for counts[length] pieces, by dual feasible functions: the total over the
    capacity, and for each threshold k the function that rounds lengths over capacity - k up
    to a whole bin and drops those under k."""
    lengths = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * lengths).sum()) // capacity)
    many, mass = np.append(np.cumsum(counts[::-1])[::-1], 0), np.append(np.cumsum((counts * lengths)[::-1])[::-1], 0)
    for k in range(1, capacity // 2 + 1):
        top = capacity - k + 1
        best = max(best, int(many[top]) + -(-int(mass[k] - mass[top]) // capacity))
    for parts in range(2, 8):  # lengths over 1 / parts of a bin, in steps of that share
        whole = lengths * parts
        value = np.where(whole % capacity == 0, whole / capacity / parts, np.floor(whole / capacity) / (parts - 1))
        best = max(best, int(np.ceil(float((value * counts).sum()) - 1e-6)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each piece."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    free = 0  # bit r: a bin with free room r exists
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            own, left, n = n, capacity, n + 1
        bins[i], offsets[i] = own, capacity - left
        left -= size
        if left:
            room[left].append(own)
            free |= 1 << left
    return bins, offsets


def _packer(turn: int, capacity: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(fill) > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        gives = fill < capacity if gap else np.arange(len(fill)) == int(fill.argmin())
        number = (turn << 58) + (int(pdf["_part"].iloc[0]) << 25) + 2 * bins  # even; by round, partition and bin
        return pdf.drop(columns="_part").assign(
            sequence_id=number, offset=offsets, fill=fill[bins], gives=gives[bins] & (fill[bins] < capacity)
        )

    return one


def pack(items: DataFrame, capacity: int = 1024, per_partition: int = 50_000, rounds: int = 4) -> DataFrame:
    """The rows of ``items`` (with a length) with sequence_id and offset."""
    columns = items.columns
    stored = Stored(items.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    keyed = stored.df
    whole = keyed.where(F.col("length") >= capacity).select(
        *columns, (F.col("_item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    pool = keyed.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pool.groupBy("length").count().collect():  # at most capacity rows
        counts[size] = n
    bound, done, settled = lower_bound(counts, capacity), [], 0
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema
    ) + ", sequence_id long, offset long, fill long, gives boolean"

    for turn in range(rounds):
        n = int(counts.sum()) if turn == 0 else pool.count()
        if not n:
            break
        parts = max(1, -(-n // per_partition))
        dealt = pool.withColumn("_part", F.pmod(F.xxhash64("_item", F.lit(turn)), F.lit(parts)))
        packed = Stored(dealt.groupBy("_part").applyInPandas(_packer(turn, capacity), schema), f"packed{turn}").df
        facts = packed.agg(
            F.count_distinct("sequence_id").alias("bins"),
            F.count_distinct(F.when(F.col("gives"), F.col("sequence_id"))).alias("given")
        ).first()
        last = parts == 1 or turn == rounds - 1 or settled + facts["bins"] <= bound
        done.append(packed if last else packed.where(~F.col("gives")))
        if last:
            break
        settled += facts["bins"] - facts["given"]
        pool = packed.where("gives").drop("sequence_id", "offset", "fill", "gives")
    out = whole
    for part in done:
        out = out.unionByName(part.select(*columns, "sequence_id", "offset"))
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False, added: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset (and ids, on request)."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, added), capacity)
