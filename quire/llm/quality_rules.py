"""Quality rules by weak supervision (native).

Rules look at counts of one text and vote good (+1), bad (-1) or abstain (0): symbols, repeats, capitals,
length of words, repeated lines, ends of lines, letters, short words and words without letters.
Expectation-maximisation over the vote patterns estimates the rules' accuracies and the share
of good texts; the posterior probability of "good" decides, not an all-must-pass filter. It
stands beside the base rule (length and repeats), which it neither contains nor follows.

Everything per document is a chain of array expressions in one scan: no shuffle of
texts or words. Only vote-pattern counts (at most 3 ** number of rules rows) reach
the driver, whatever the corpus' size.

Cases: a null or empty text has no words, fails the base rule and isn't kept.
Repeated rows are judged alike, each returned. An empty table gives an empty result.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import doubles, materialise, with_clear_names

SYMBOLS = "[#*$%&|<>]"
_SPACE = " \\t-\\r"


def add_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_end_lines, n_upper, n_letters,
    n_short_words, n_real_words (with a letter or digit) and n_repeat_words. Equal windows are found by sorting 64-bit hashes within the row."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    # without signs: words of nothing else vanish, the others stay apart
    df = df.withColumn("_s", F.regexp_replace("_t", f"[^\\p{{L}}\\p{{M}}\\p{{N}}{_SPACE}]+", ""))
    df = df.withColumn("_w", F.array_remove(F.split("_t", "[ \\t-\\r]+"), ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    df = df.withColumn(
        "_h",
        F.transform(
            F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    )
    # position in the low bits, hash in the others: one sort of longs brings equal windows together
    df = df.withColumn(
        "_m",
        F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(F.size("_h"), F.lit(2)))).cast("int")) - 1
    )
    df = df.withColumn(
        "_p", F.sort_array(F.transform("_h", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("_m"))).bitwiseOR(i.cast("long"))))
    )

    def prefix(at: Column) -> Column:
        return F.get("_p", at).bitwiseAND(F.bitwise_not(F.col("_m")))

    def window(at: Column) -> Column:
        return F.get("_h", F.get("_c", at).bitwiseAND(F.col("_m")).cast("int"))

    df = df.withColumn("_c", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.array().cast("array<long>")).otherwise(
        F.filter("_p", lambda v, k: (prefix(k - 1) == prefix(k)) | (prefix(k + 1) == prefix(k)))))
    df = df.withColumn("_d", F.filter("_c", lambda v, k: (window(k - 1) == window(k)) | (window(k + 1) == window(k))))
    df = df.withColumn("_q", F.sort_array(F.transform("_d", lambda v: v.bitwiseAND(F.col("_m")))))
    repeat = F.aggregate(
        F.transform("_q", lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_q", k + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return df.select(
        *[c for c in df.columns if not c.startswith("_") and c != text],
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike("[.!?:;\"»”][ \\t-\\r]*$"))).cast("long").alias("n_end_lines"),
        (F.length("_s") - F.length(F.regexp_replace("_s", "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_s", "[^\\p{L}\\p{M}]+", "")).cast("long").alias("n_letters"),
        (F.col("n_words") - F.regexp_count("_t", F.lit(f"[^{_SPACE}]{{4,}}+"))).cast("long").alias("n_short_words"),
        F.regexp_count("_s", F.lit(f"[^{_SPACE}]++")).cast("long").alias("n_real_words"),
        repeat.alias("n_repeat_words"),
    )


def _vote(good: Column, bad: Column) -> Column:
    """0 bad, 1 abstains, 2 good."""
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    n, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    symbols, repeats, length, short, real = (
        F.col(c) / n for c in ("n_symbols", "n_repeat_words", "word_chars", "n_short_words", "n_real_words")
    )
    upper, letters = (F.col(c) / chars for c in ("n_upper", "n_letters"))
    dup, ends = (F.col(c) / lines for c in ("n_dup_lines", "n_end_lines"))
    return {
        "few_symbols": _vote(symbols <= 0.03, symbols > 0.1),
        "few_repeats": _vote(repeats <= 0.1, repeats > 0.3),
        "few_capitals": _vote(upper <= 0.1, upper > 0.3),
        "word_length": _vote(length.between(3.5, 8.0), ~length.between(2.5, 10.0)),
        "few_dup_lines": _vote(dup <= 0.1, dup > 0.3),
        "lines_end": _vote(ends >= 0.8, ends < 0.5),
        "letters": _vote(letters >= 0.9, letters < 0.75),
        "short_words": _vote(short.between(0.2, 0.5), (short < 0.1) | (short > 0.6)),
        "real_words": _vote(real >= 0.95, real < 0.8),
    }


Tables = list[list[list[float]]]


def log_odds(theta: Tables, prior: float) -> tuple[float, list[list[float]]]:
    """What the share of good texts and each vote of each rule say, to be added up."""
    return math.log(prior) - math.log(1 - prior), [[math.log(good) - math.log(bad) for bad, good in zip(*t)] for t in theta]


def fit_em(patterns: list[tuple[int, int]], m: int, rounds: int = 60, prior: float = 0.8) -> tuple[Tables, float]:
    """Dawid-Skene EM over (pattern code, count): the vote tables [rule][class][vote] and the share
    of good documents. Smoothing by pseudo-documents (a hundredth of all, at least one) whose
    votes point the right way keeps the classes from changing places."""
    seen = [([code // 3**j % 3 for j in range(m)], count) for code, count in patterns]
    start = [[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]
    theta = [[r[:] for r in start] for _ in range(m)]
    total = sum(c for _, c in seen) or 1
    strength = max(1.0, 0.01 * total)
    for _ in range(rounds):
        acc = [[[strength * x for x in start[c]] for c in (0, 1)] for _ in range(m)]
        good, (begin, says) = 0.0, log_odds(theta, prior)
        for votes, count in seen:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, begin + sum(says[j][v] for j, v in enumerate(votes))))))
            good += p * count
            for j, v in enumerate(votes):
                acc[j][1][v] += p * count
                acc[j][0][v] += (1 - p) * count
        theta = [[[x / sum(row) for x in row] for row in t] for t in acc]
        prior = min(0.99, max(0.01, (good + 1) / (total + 2)))
    return theta, prior


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and the posterior ``quality_prob``."""
    votes = rules()
    stats = add_counts(with_clear_names(docs, id_col, text_col), text_col)
    code = sum((v * F.lit(3**j) for j, v in enumerate(votes.values())), F.lit(0))
    stats = materialise(stats.withColumn("pattern", code.cast("int")), "rules")
    seen = [(r[0], r[1]) for r in stats.groupBy("pattern").count().collect()]  # at most 3 ** 9 rows
    begin, says = log_odds(*fit_em(sorted(seen), len(votes)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    vote = lambda j: F.floor(F.col("pattern") / 3**j).cast("int") % 3
    odds = sum((F.element_at(doubles(x), vote(j) + 1) for j, x in enumerate(says)), F.lit(begin))
    prob = 1 / (1 + F.exp(-odds))
    return stats.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (prob >= keep_at)).alias("kept"), prob.alias("quality_prob"),
    )
