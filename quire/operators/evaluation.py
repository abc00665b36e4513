"""Scores: extraction, evidence, OCR, retrieval, answers, latency and layout, by case and by run.

Null is a value: null against null matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import collapse, error_rate, exact_match, nfc, with_token_f1, word_errors

NO_KEY = "<all>"


def correctness(correct: Column, predicted: Column, expected: Column) -> Column:
    """Nothing predicted is right only where nothing was expected."""
    return F.when(predicted > 0, correct / predicted).when(expected == 0, 1.0).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


# pairing of gold and predicted records


def unique(df: DataFrame, key: str) -> bool:
    """Whether the key is never null and never repeated."""
    r = df.agg(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
    return r[0] == r[1] == r[2]


def pair_records(gold: DataFrame, predicted: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """By id where ids are whole and unique on both sides, else by position, which counts from 0 on
    both sides. ``surplus`` has the predictions that no gold record meets."""
    on = key if unique(gold, key) and unique(predicted, key) else order
    g = gold.select(F.col(key).alias("id"), F.col(on).alias("_on"), F.struct("*").alias("gold"))
    p = predicted.select(F.col(on).alias("_on"), F.struct("*").alias("predicted"))
    return g.join(p, "_on", "left").select("id", "gold", "predicted")


def surplus(gold: DataFrame, predicted: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """The predictions that ``pair_records`` pairs with nothing."""
    on = key if unique(gold, key) and unique(predicted, key) else order
    return predicted.join(gold.select(on), on, "left_anti")


def unexpected(gold: DataFrame, predicted: DataFrame, key: str = "id") -> DataFrame:
    """Ids predicted but not in gold, sorted."""
    return predicted.select(key).join(gold.select(key), key, "left_anti").distinct().orderBy(key)


# extraction


def field_scores(gold: DataFrame, predicted: DataFrame, exact: bool = True) -> DataFrame:
    """J4, SC3, SC4: case_id, field, exact_match, token_f1 over the union of fields. Values are
    strings already normalised for numbers and lists."""
    both = gold.select("case_id", "field", F.col("value").alias("gold")).join(
        predicted.select("case_id", "field", F.col("value").alias("predicted")), ["case_id", "field"], "full"
    )
    both = both.withColumn("exact_match", exact_match(F.col("gold"), F.col("predicted"), exact))
    return with_token_f1(both, "gold", "predicted", exact=exact).select("case_id", "field", "exact_match", "token_f1")


def extraction_by_case(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Macro means by case, 1.0 without fields."""
    got = scores.groupBy("case_id").agg(
        F.avg("exact_match").alias("exact_match"), F.avg("token_f1").alias("token_f1"), F.count(F.lit(1)).alias("fields")
    )
    return cases.select("case_id").join(got, "case_id", "left").select(
        "case_id", F.coalesce("exact_match", F.lit(1.0)).alias("exact_match"),
        F.coalesce("token_f1", F.lit(1.0)).alias("token_f1"), F.coalesce("fields", F.lit(0)).alias("fields")
    )


def two_levels(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """A row for each key and one for all (A9, A15). The total is an aggregation of its own, as
    grouping sets give no row over nothing."""
    total = df.agg(*aggs).select(F.lit(NO_KEY).alias(key), "*")
    return df.groupBy(key).agg(*aggs).unionByName(total)


def extraction_summary(scores: DataFrame) -> DataFrame:
    return two_levels(
        scores, "field", F.avg("exact_match").alias("exact_match"), F.avg("token_f1").alias("token_f1"),
        F.count(F.lit(1)).alias("n")
    )


# evidence


def evidence_by_field(gold: DataFrame, predicted: DataFrame, values: DataFrame) -> DataFrame:
    """By case and field the predicted items, those on a right page and block (gold is a
    set, repeats of a prediction count), the gold items, and whether a value is there (P9)."""
    place, keys = ["document_id", "page", "block_id"], ["case_id", "field"]
    g = gold.select(*keys, *place).distinct()
    gp = g.select(*keys, "document_id", "page").distinct().withColumn("on_page", F.lit(1))
    p = predicted.select(*keys, *place).join(gp, [*keys, "document_id", "page"], "left").join(
        g.withColumn("on_block", F.lit(1)), [*keys, *place], "left"
    )
    a = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("predicted"), F.count("on_page").alias("page_correct"), F.count("on_block").alias("block_correct")
    )
    b = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    v = values.select(*keys, F.coalesce(F.trim("value") != "", F.lit(False)).alias("has_value"))
    out = reduce(lambda x, y: x.join(y, keys, "full"), [a, b, v])
    return out.select(
        *keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("predicted", "page_correct", "block_correct", "expected")],
        F.coalesce("has_value", F.lit(False)).alias("has_value")
    )


def evidence_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Pooled sums, then ratios."""
    s = rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("predicted", "expected", "page_correct", "block_correct")],
        F.count_if("has_value").alias("values"),
        F.count_if(F.col("has_value") & (F.col("block_correct") == 0)).alias("unsupported")
    )
    rate = F.when(F.col("values") > 0, F.col("unsupported") / F.col("values")).otherwise(0.0)
    return s.select(
        "*", correctness(F.col("page_correct"), F.col("predicted"), F.col("expected")).alias("page_correctness"),
        correctness(F.col("block_correct"), F.col("predicted"), F.col("expected")).alias("block_correctness"),
        rate.alias("unsupported_value_rate")
    )


# OCR


def ocr_by_case(pairs: DataFrame) -> DataFrame:
    """SC9, SC10: character and word errors of NFC texts."""
    t = pairs.select("case_id", *[nfc(F.col(c)).alias(c) for c in ("reference_text", "predicted_text")])
    words = lambda c: F.when(collapse(F.col(c)) == "", 0).otherwise(F.size(F.split(collapse(F.col(c)), " ")))
    t = t.select(
        "case_id", F.length("reference_text").alias("reference_characters"),
        F.length("predicted_text").alias("predicted_characters"),
        F.levenshtein("reference_text", "predicted_text").alias("character_errors"),
        words("reference_text").alias("reference_words"), words("predicted_text").alias("predicted_words"),
        word_errors(collapse(F.col("reference_text")), collapse(F.col("predicted_text"))).alias("word_errors")
    )
    return t.select(
        "*", error_rate(F.col("character_errors"), F.col("reference_characters")).alias("cer"),
        error_rate(F.col("word_errors"), F.col("reference_words")).alias("wer")
    )


def ocr_summary(rows: DataFrame) -> DataFrame:
    """A12."""
    s = rows.agg(*[F.sum(c).alias(c) for c in ("character_errors", "reference_characters", "word_errors", "reference_words")])
    return s.select(
        "*", error_rate(F.col("character_errors"), F.col("reference_characters")).alias("cer"),
        error_rate(F.col("word_errors"), F.col("reference_words")).alias("wer")
    )


# retrieval


def retrieval_by_case(relevant: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at each k by declared rank, and the reciprocal rank; null without relevant ids."""
    if not ks or any(not isinstance(k, int) or isinstance(k, bool) or k <= 0 for k in ks):
        raise ValueError("k must be a positive integer")
    r = relevant.select("case_id", "item_id").distinct()
    best = retrieved.groupBy("case_id", "item_id").agg(F.min("rank").alias("rank"))
    hit = r.join(best, ["case_id", "item_id"], "left")
    got = hit.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_relevant"),
        *[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_at_{k}") for k in sorted(set(ks))],
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr")
    )
    cases = r.select("case_id").unionAll(retrieved.select("case_id")).distinct()
    return cases.join(got, "case_id", "left").withColumn("evaluable", F.col("n_relevant").isNotNull()).withColumn(
        "n_relevant", F.coalesce("n_relevant", F.lit(0))
    )


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """Means over the evaluable queries."""
    scores = [c for c in rows.columns if c.startswith("recall_at_") or c == "mrr"]
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("evaluable").alias("evaluable_queries"),
        *[F.avg(c).alias(c) for c in scores]
    )


# answers


def answers_by_case(cases: DataFrame, counts: bool = False) -> DataFrame:
    """R10, J13, A14. cases: case_id, gold and predicted citations (arrays of source_id, document_id,
    page, block_ids, is_bare), expected and predicted abstention. With ``counts`` also the numbers behind."""
    unique = lambda c: F.array_distinct(
        F.transform(
            c,
            lambda x: F.struct(
                x["source_id"].alias("source_id"), x["document_id"].alias("document_id"), x["page"].alias("page"),
                F.sort_array(x["block_ids"]).alias("block_ids"), x["is_bare"].alias("is_bare")
            )
        )
    )

    def match(a: Column, b: Column) -> Column:
        source = (F.coalesce(a["source_id"], F.lit("")) != "") & (a["source_id"] == b["source_id"])
        place = (
            F.coalesce(a["document_id"], F.lit("")) != ""
        ) & (a["document_id"] == b["document_id"]) & a["page"].eqNullSafe(b["page"])
        empty = (F.size(a["block_ids"]) == 0) & (F.size(b["block_ids"]) == 0)
        return F.coalesce(
            source | (~a["is_bare"] & ~b["is_bare"] & place & (empty | F.arrays_overlap(a["block_ids"], b["block_ids"]))),
            F.lit(False)
        )

    t = cases.withColumn("g", unique(F.col("gold"))).withColumn("p", unique(F.col("predicted")))
    t = t.withColumn(
        "correct", F.size(F.filter("p", lambda x: F.exists("g", lambda y: match(x, y))))
    ).withColumn("covered", F.size(F.filter("g", lambda y: F.exists("p", lambda x: match(x, y)))))
    p, r = correctness(F.col("correct"), F.size("p"), F.size("g")), F.when(
        F.size("g") > 0, F.col("covered") / F.size("g")
    ).otherwise(1.0)
    behind = [
        F.size("g").alias("reference_citation_count"), F.size("p").alias("predicted_citation_count"),
        F.col("correct").alias("correct_citation_count"), F.col("covered").alias("covered_reference_citation_count"),
        "expected_abstention", "predicted_abstention"
    ]
    return t.select(
        "case_id", *(behind if counts else []), p.alias("citation_precision"), r.alias("citation_completeness"),
        f1(p, r).alias("citation_f1"),
        (F.col("expected_abstention") == F.col("predicted_abstention")).cast("double").alias("abstention_accuracy")
    )


def answers_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        *[F.avg(c).alias(c) for c in ("citation_precision", "citation_completeness", "citation_f1", "abstention_accuracy")]
    )


# latency


def checked_ms(ms: Column) -> Column:
    """A negative, infinite or NaN sample is an error."""
    return F.when(
        ms.isNull() | F.isnan(ms) | (ms < 0) | (ms == float("inf")),
        F.raise_error("latency samples must be finite and nonnegative")
    ).otherwise(ms)


RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def ranked_values(counted: DataFrame, keys: list[str], ranks: Column) -> DataFrame:
    """(keys, name, value): the value at each of ``ranks``, an array of (name, rank) with ranks from 1 that
    may use ``_total``. counted: keys, ms, n. Values meet in coarse buckets first (a sixty-fourth
    of an octave), whose running sums are few rows a key; only the buckets that hold a rank are
    then summed value by value, so no key's values are in one task."""
    rows = counted.where("ms is not null").withColumn("_bucket", F.floor(F.log2(F.col("ms") + 1) * 64).cast("int"))
    buckets = rows.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n"))
    key = Window.partitionBy(*keys)
    buckets = buckets.withColumn("_upto", F.sum("_n").over(key.orderBy("_bucket"))).withColumn("_total", F.sum("_n").over(key))
    before = F.col("_upto") - F.col("_n")
    asked = buckets.select(
        *keys, "_bucket", F.explode(F.filter(ranks, lambda r: (r["rank"] > before) & (r["rank"] <= F.col("_upto")))).alias("_r"),
        before.alias("_before")
    )
    asked = asked.select(*keys, "_bucket", F.col("_r.name").alias("name"), (F.col("_r.rank") - F.col("_before")).alias("_rank"))
    near = rows.join(asked, [*keys, "_bucket"])
    running = F.sum("n").over(Window.partitionBy(*keys, "_bucket", "name").orderBy("ms"))
    return near.withColumn("_upto", running).where("_upto >= _rank").groupBy(*keys, "name").agg(F.min("ms").alias("value"))


def latency_summary(samples: DataFrame, key: str = "stage", *by: str) -> DataFrame:
    """By stage and over all (within each of ``by``): count, total, min, mean, median, p50, p95, p99,
    max. p50, p95 and p99 are nearest ranks, the median interpolates. One scan: samples are
    counted by value first."""
    counted = samples.groupBy(*by, key, "ms").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy(*by, "ms").agg(F.sum("n").alias("n")).withColumn(key, F.lit(NO_KEY))
    counted = counted.unionByName(whole)
    keys = [*by, key]
    n = F.coalesce(F.sum(F.when(F.col("ms").isNotNull(), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum(F.col("ms") * F.col("n")), F.lit(0.0))
    facts = counted.groupBy(*keys).agg(
        n.alias("count"), total.alias("total"), F.min("ms").alias("min"), F.when(n > 0, total / n).alias("mean"),
        F.max("ms").alias("max")
    )
    rank = lambda name, r: F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank"))
    nearest = [rank(name, F.greatest(F.lit(1), F.ceil(F.col("_total") * q))) for name, q in RANKS.items()]
    middle = [rank("low", F.floor((F.col("_total") + 1) / 2)), rank("high", F.floor((F.col("_total") + 2) / 2))]
    found = ranked_values(counted, keys, F.array(*nearest, *middle))
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = found.groupBy(*keys).agg(((at("low") + at("high")) / 2).alias("median"), *[at(name).alias(name) for name in RANKS])
    out = facts.join(wide, keys, "left").select(*keys, "count", "total", "min", "mean", "median", *RANKS, "max")
    if by:
        return out
    # without any sample there still is a row for all
    none = samples.sparkSession.createDataFrame([(NO_KEY,)], f"{key} string")
    none = none.join(out.select(key), key, "left_anti").select(
        key, F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("total"),
        *[F.lit(None).cast("double").alias(c) for c in ("min", "mean", "median", *RANKS, "max")]
    )
    return out.unionByName(none)


# layout


def layout_scores(
    cells: DataFrame, predicted_cells: DataFrame, stamps: DataFrame, predicted_stamps: DataFrame, order: DataFrame,
    predicted_order: DataFrame, cases: DataFrame | None = None
) -> DataFrame:
    """A23, J20-J22, texts normalised before: table cells (case_id, page, row, col, cell) by position, stamp texts
    (case_id, text) as sets, headings (case_id, pos, text) by pairs in order, averaged over the
    cases. ``cases`` are those whose predicted stamps count; else those with a gold stamp."""
    place = ["case_id", "page", "row", "col"]
    ratio = lambda a, b, none=None: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(none).cast("double"))
    c = cells.join(predicted_cells.withColumnRenamed("cell", "_got"), place, "left").agg(
        F.count(F.lit(1)).alias("table_cell_count"), F.count_if(F.col("cell") == F.col("_got")).alias("_right")
    )
    scope = (stamps if cases is None else cases).select("case_id").distinct()
    s, p = stamps.select("case_id", "text").distinct(), predicted_stamps.join(
        scope, "case_id", "left_semi"
    ).select("case_id", "text").distinct()
    both = s.withColumn("_e", F.lit(1)).join(p.withColumn("_p", F.lit(1)), ["case_id", "text"], "full")
    t = both.agg(
        F.count("_e").alias("_expected"), F.count("_p").alias("_predicted"),
        F.count_if(F.col("_e").isNotNull() & F.col("_p").isNotNull()).alias("_both")
    )
    o = order.join(predicted_order.withColumnRenamed("pos", "_got"), ["case_id", "text"], "left").select("case_id", "pos", "_got")
    pairs = o.join(o.withColumnsRenamed({"pos": "_pos2", "_got": "_got2"}), "case_id").where("pos < _pos2")
    by_case = order.select("case_id").distinct().join(
        pairs.groupBy("case_id").agg(
            F.avg(F.coalesce(F.col("_got") < F.col("_got2"), F.lit(False)).cast("double")).alias("_share")
        ),
        "case_id", "left"
    )
    h = by_case.agg(F.avg(F.coalesce("_share", F.lit(1.0))).alias("two_column_order_accuracy"))
    out = c.crossJoin(t).crossJoin(h)  # three rows of totals
    precision, recall = ratio("_both", "_predicted", 1.0), ratio("_both", "_expected", 1.0)
    return out.select(
        "table_cell_count", ratio("_right", "table_cell_count").alias("table_cell_accuracy"),
        precision.alias("stamp_text_precision"), recall.alias("stamp_text_recall"), f1(precision, recall).alias("stamp_text_f1"),
        "two_column_order_accuracy"
    )
