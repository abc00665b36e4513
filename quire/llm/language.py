"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (n = 1 to 3 code points of lower-cased
words, with a mark at both word ends), most frequent first, ties by n-gram code. A
document goes to the language whose profile has the least out-of-place distance: the sum
over the document's n-grams of the difference in rank, the profile's length for one
that the language lacks.

Profiles are fitted on a bounded hash sample of the labelled rows; counts are summed on
the cluster and only the top ranks (``size`` a language) reach the driver. Documents are
scored whole, an Arrow batch at a time, without a shuffle.

Cases: a null text, or one without any letter, is ``und`` with score 0. Rows without a
language don't train. With no training rows all are ``und``. Equal distances go to the
first language by name. Repeated rows are scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc_fold, with_clear_names

SIZE = 300
_LETTER = np.zeros(0x110000, dtype=bool)


def letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str | None) -> np.ndarray:
    """The codes of all n-grams of a text; empty without letters. A code holds up to three
    code points of 21 bits; 0 is the mark between words, which runs of other characters become."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = letters()[points]
    if not keep.any():
        return np.empty(0, np.int64)
    c = np.zeros(len(points) + 2, np.int64)
    c[1:-1] = np.where(keep, points, 0)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    one, two, three = c, (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.concatenate((one[one != 0], two | (1 << 63 - 1), three[c[1:-1] != 0]))


def profile(text: str | None, size: int = SIZE) -> np.ndarray:
    """The most frequent n-gram codes, in order of rank."""
    codes = ngrams(text)
    if not len(codes):
        return codes
    codes.sort()
    edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(edges, len(codes)))
    if len(edges) > size:  # only those that can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        edges, counts = edges[some], counts[some]
    return codes[edges[np.argsort(-counts, kind="stable")[:size]]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], size: int = SIZE):
        self.names = sorted(ranked)
        self.size = size
        codes = np.unique(
            np.concatenate([np.asarray(ranked[n], np.int64) for n in self.names])
        ) if ranked else np.empty(0, np.int64)
        self.codes = codes
        self.ranks = np.full((len(self.names), len(codes) + 1), -1, np.int32)
        for i, n in enumerate(self.names):
            self.ranks[i, np.searchsorted(codes, np.asarray(ranked[n], np.int64))] = np.arange(len(ranked[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text, self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = len(self.codes)
        known = np.append(self.codes, -1)[at] == own
        ranks = self.ranks[:, np.where(known, at, len(self.codes))]
        places = np.abs(ranks - np.arange(len(own), dtype=np.int32))
        distance = np.where(ranks < 0, self.size, np.minimum(places, self.size)).sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(own)))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, size: int = SIZE, per_language: int = 400) -> Profiles:
    """Profiles from about ``per_language`` rows of each language, by a hash of the id."""
    keys = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(lang_col).alias("l"))
    counts = {r[0]: r[1] for r in keys.groupBy("l").count().collect()}  # as many rows as languages
    if not counts:
        return Profiles({}, size)
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit("profile")), F.lit(1 << 40))
    share = F.element_at(
        F.create_map(*[x for n, c in counts.items() for x in (F.lit(n), F.lit(min(1 << 40, int(per_language / c * (1 << 40)))))]),
        F.col(lang_col)
    )
    train = docs.where(F.col(lang_col).isNotNull()).where(unit < share).select(
        F.col(lang_col).alias("l"), F.col(text_col).alias("t")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("l")["t"]:
                codes, n = np.unique(np.concatenate([ngrams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"l": lang, "code": codes, "n": n})

    grams = train.mapInPandas(count, "l string, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n"))
    # of each language's bounded table the first ranks: a bounded array, merged map-side
    top = grams.groupBy("l").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, size).alias("top")
    )
    return Profiles({r["l"]: [x["code"] for x in r["top"]] for r in top.collect()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [profiles.predict(t) for t in pdf[text_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return with_clear_names(docs, id_col, text_col).mapInPandas(score, f"`{id_col}` {kind}, lang_pred string, score double")


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1,
    per_language: int = 400
) -> DataFrame:
    """id, held_out, lang_pred, score; rows whose crc32(id) % folds = held never train."""
    held_out = crc_fold(F.col(id_col), folds) == held
    profiles = fit(
        with_clear_names(docs, id_col, text_col, lang_col).where(F.coalesce(~held_out, F.lit(False))), id_col, text_col, lang_col,
        per_language=per_language
    )
    return identify(docs, profiles, id_col, text_col).select(
        id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
