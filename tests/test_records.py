"""Loose evaluation records to reports."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, DoubleType, LongType, MapType, StringType

from quire.functions import text as T
from quire.operators import evaluation, records
from quire.sources import files

AT = {"document_id": "d", "page": 1, "block_id": "b"}


def test_shapes_of_records():
    one = {"case_id": "a", "ocr_text": "x"}
    assert records.coerce(one) == [("a", one)] and records.coerce([one, {}]) == [("a", one), (None, {})]
    assert records.coerce({"records": [one]}) == [("a", one)] and records.coerce(
        {"k": {"ocr_text": "x"}}
    ) == [("k", {"ocr_text": "x"})]
    bare = {"party": {"value": 1}, "fee": {"status": "missing"}}
    assert records.coerce(bare) == [(None, bare)]
    assert records.record_id({"case_id": "", "id": 0, "question": "q"}) == "0"
    for bad in (3, {"records": "x"}, "text"):
        with pytest.raises(TypeError):
            records.coerce(bad)


def test_sections_by_alias():
    s = records.sections(
        {
            "contract_extraction": {"a": 1}, "reference_text": "r", "relevant_chunk_ids": ["c"],
            "cited_answer": {"citations": []}, "latency": 3
        },
        True
    )
    assert s == {"extraction": {"a": 1}, "ocr_text": "r", "relevant_ids": ["c"], "answer": {"citations": []}}
    s = records.sections({"predicted_text": "p", "search_hits": ["c"], "answer": {"citations": []}, "latency": 3}, False)
    assert s == {"ocr_text": "p", "retrieved": ["c"], "answer": {"citations": []}, "latency": 3}
    assert records.sections({"answer": "words", "fee": 3}, True) == {"extraction": {"fields": {"answer": "words", "fee": 3}}}
    parsed = {
        "parser": "p",
        "pages": [
            {"page": 2, "blocks": [{"text": "c", "reading_order": 0}]},
            {"page": 1, "blocks": [{"text": "b", "reading_order": 1}, {"text": " "}, {"text": "a", "reading_order": 0}]}
        ]
    }
    assert records.sections(parsed, True) == {"ocr_text": "a\nb\nc"}


def test_latency_shapes():
    assert records.latency_samples(3) == {"end_to_end": [3.0]} and records.latency_samples([1, 2]) == {"end_to_end": [1.0, 2.0]}
    assert records.latency_samples({"scan": 1, "model": [2, 3]}) == {"scan": [1.0], "model": [2.0, 3.0]}
    for bad in (True, [True], {"a": "x"}, "x", {"a": {"b": 1}}):
        with pytest.raises(TypeError):
            records.latency_samples(bad)
    for bad in (-1, math.nan, math.inf):
        with pytest.raises(ValueError):
            records.latency_samples(bad)


def test_typed_values():
    got = [
        records.normal_value(x) for x in (
            None, True, 1200, 1200.0, 1e21, 1e-7, -0.0, {"B": 1, "a": None}, ["b", "A", ""], "Straße, ﬁ!"
        )
    ]
    assert got == ["", "true", "1200", "1200", "1" + "0" * 21, "0.0000001", "0", "a  | b 1", "a | b", "strasse fi"]
    assert [
        records.substantive(x) for x in (None, " ", [], {}, 0, False, "x", [0])
    ] == [False, False, False, False, True, True, True, True]


def test_typed_columns(spark):
    rows = [
        (1200.0, 7, True, ["b", "A"], {"K": 1.5}, "1.230"), (1e300, -3, False, [], {}, "0.000"),
        (-1.5e-10, 0, None, None, None, None)
    ]
    df = spark.createDataFrame(
        [(a, b, c, d, e, s) for a, b, c, d, e, s in rows],
        "a double, b long, c boolean, d array<string>, e map<string,double>, s string"
    ).withColumn("s", F.col("s").cast(DecimalType(38, 3)))
    kinds = {
        "a": DoubleType(), "b": LongType(), "c": BooleanType(), "d": ArrayType(StringType()),
        "e": MapType(StringType(), DoubleType()), "s": DecimalType(38, 3)
    }
    got = df.select(*[T.normalize_typed(F.col(c), k).alias(c) for c, k in kinds.items()]).collect()
    assert tuple(got[0]) == ("1200", "7", "true", "a | b", "k 1.5", "1.23")
    assert tuple(got[1]) == (
        "1" + "0" * 300, "-3", "false", "", "", "0"
    ) and tuple(got[2]) == ("-0.00000000015", "0", "", "", "", "")
    got = df.select(*[T.substantive(F.col(c), k).alias(c) for c, k in kinds.items()]).collect()
    assert [tuple(r) for r in got] == [
        (True,) * 6, (True, True, True, False, False, True), (True, True, False, False, False, False)
    ]


GOLD = {
    "a": {
        "extraction": {"fields": {"party": {"value": "Fern & Co., Ltd.", "evidence": [AT]}, "fee": 1200}}, "ocr_text": "green river",
        "relevant_ids": ["c2"], "answer": {"citations": [{"source_id": "s1", **AT, "block_ids": ["b"]}], "abstained": False}
    },
    "b": {"extraction": {"fields": {"fee": {"value": "100"}, "none": {"value": None}}}},
}
PREDICTED = {
    "x": {"ocr_text": "unused"},
    "a": {
        "extraction": {
            "fields": {"party": {"value": "fern & co ltd", "evidence": [AT, {**AT, "block_id": "z"}]}, "fee": 1200.0, "extra": ["v"]}
        },
        "ocr_text": "groen river", "retrieved_ids": ["c1", {"rank": 2, "chunk": {"chunk_id": "c2"}}],
        "answer": {"citations": ["s1"], "abstained": False}, "latency_ms": {"scan": 7, "model": [31, 43], "none": []}
    },
}


def test_report_by_id(spark):
    r = records.evaluate_records(spark, GOLD, PREDICTED, (1, 2))
    assert [c["case_id"] for c in r["cases"]] == ["a", "b"] and r["unexpected_prediction_ids"] == ["x"]
    s = r["summary"]
    assert (s["case_count"], s["missing_prediction_count"]) == (2, 1)
    assert s["retrieval"] == {"query_count": 1, "evaluable_query_count": 1, "recall_at_k": {"1": 0.0, "2": 1.0}, "mrr": 0.5}
    assert s["latency"]["by_stage"]["model"]["p95_ms"] == 43.0 and s["latency"]["overall"]["median_ms"] == 31.0 and s["latency"]["by_stage"]["none"]["count"] == 0
    assert s["extraction"]["field_instance_count"] == 5 and s["extraction"]["per_field"]["fee"] == {
        "count": 2, "exact_match": 0.5, "token_f1": 0.5
    }
    assert s["extraction"]["per_field"]["extra"]["exact_match"] == 0.0 and s["extraction"]["per_field"]["none"]["exact_match"] == 1.0
    assert s["evidence"] == {
        "predicted_evidence_count": 2, "reference_evidence_count": 1, "page_correctness": 1.0, "block_correctness": 0.5,
        "predicted_value_count": 3, "unsupported_value_rate": 2 / 3
    }
    assert s["ocr"]["character_errors"] == 1 and s["ocr"]["wer"] == 0.5 and s["answer"]["citation_f1"] == 1.0
    a, b = (c["metrics"] for c in r["cases"])
    assert a["evidence"]["per_field"]["party"]["value_supported"] and a["evidence"]["per_field"]["extra"]["value_supported"] is False
    assert a["answer"]["covered_reference_citation_count"] == 1 and a["retrieval"]["first_relevant_rank"] == 2
    assert set(b) == {"extraction", "evidence"} and b["extraction"]["exact_match"] == 0.5 and r["cases"][1]["prediction_missing"]
    json.dumps(r, allow_nan=False)


def test_report_by_position_and_raw_fields(spark):
    gold = [{"party": "A", "n": None}, {"id": "k", "ocr_text": "t"}]
    r = records.evaluate_records(spark, gold, [{"party": "a"}, {"id": "k", "ocr_text": "t"}, {"id": "k"}, {"fields": {}}])
    assert [c["case_id"] for c in r["cases"]] == ["case-1", "k"] and r["unexpected_prediction_ids"] == ["k", "case-4"]
    assert r["summary"]["extraction"]["exact_match"] == 1.0 and r["summary"]["ocr"]["cer"] == 0.0 and "latency" not in r["summary"]


def test_one_case_and_empty_run(spark):
    c = records.evaluate_case(spark, {"relevant_ids": []}, None, "mine")
    assert c["case_id"] == "mine" and c["metrics"]["retrieval"] == {
        "evaluable": False, "relevant_count": 0, "retrieved_count": 0, "recall_at_k": {"1": None, "3": None, "5": None},
        "mrr": None, "first_relevant_rank": None
    }
    empty = records.evaluate_records(spark, [], [])
    assert empty["cases"] == [] and empty["summary"] == {"case_count": 0, "missing_prediction_count": 0}


def test_files_and_reports(spark, tmp_path):
    for name, value in (("g", [{"id": "k9", "ocr_text": "alike"}]), ("p", [{"id": "k9", "ocr_text": "alike", "latency_ms": 31}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    r = records.evaluate_json_files(spark, str(tmp_path / "g.json"), str(tmp_path / "p.json"))
    files.write_json_report(r, str(tmp_path / "out/r.json"))
    files.write_html_report(r, str(tmp_path / "out/r.html"), "Scores <i onload=x>")
    shown = (tmp_path / "out/r.html").read_text()
    assert json.loads(
        (tmp_path / "out/r.json").read_text()
    ) == r and "&lt;i onload=x&gt;" in shown and "<i onload" not in shown and "p95" in shown
    assert "ocr cer" in files.console_summary(r) and "0.0%" in files.console_summary(r)
    with pytest.raises(ValueError):
        files.write_json_report({"x": math.nan}, str(tmp_path / "bad.json"))


def test_gold_phrases_take_unused_blocks(spark):
    blocks = spark.createDataFrame(
        [("d", 1, f"b{i}", i, t, (0.0, 0.0, 1.0, 1.0)) for i, t in enumerate(["Fee  USD 5", "fee usd 5 again", "other"])],
        "document_id string, page int, block_id string, reading_order int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    )
    phrases = spark.createDataFrame(
        [("d", "fees", i, p) for i, p in enumerate(["USD 5", "usd 5", "USD 5", "absent"])] + [("d", "law", 0, "USD 5")],
        "document_id string, field string, pos int, phrase string"
    )
    got = sorted((r["field"], r["pos"], r["block_id"]) for r in records.gold_evidence(phrases, blocks).collect())
    assert got == [("fees", 0, "b0"), ("fees", 1, "b1"), ("law", 0, "b0")]


def test_strict_lookup(spark):
    gold = spark.createDataFrame([("a", 1)], "case_id string, v int")
    cases = spark.createDataFrame([("a",)], "case_id string")
    assert [r["v"] for r in records.strict(cases, gold).collect()] == [1]
    with pytest.raises(Exception, match="no gold for case z"):
        records.strict(cases.unionAll(spark.createDataFrame([("z",)], "case_id string")), gold).collect()


def test_positions_pair_and_surplus(spark):
    gold = spark.createDataFrame([("a", 0), ("a", 1)], "id string, pos int")
    pred = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "id string, pos int")
    assert sorted(r["predicted"]["id"] for r in evaluation.pair_records(gold, pred).collect()) == ["x", "y"]
    assert [r["id"] for r in evaluation.surplus(gold, pred).collect()] == ["z"]


def test_ranks_match_sorting(spark):
    import random

    rng = random.Random(5)
    rows = [("s" if i % 3 else "t", round(rng.expovariate(0.01), 1)) for i in range(1000)] + [("u", 4.0)] * 7 + [("v", None)]
    got = {r["stage"]: r for r in evaluation.latency_summary(spark.createDataFrame(rows, "stage string, ms double")).collect()}
    for stage, pick in [(k, lambda r, k=k: r[0] == k) for k in "stu"] + [(evaluation.NO_KEY, lambda r: True)]:
        v = sorted(r[1] for r in rows if pick(r) and r[1] is not None)
        rank = lambda q, v=v: v[max(1, math.ceil(q * len(v))) - 1]
        r = got[stage]
        assert (
            r["count"], r["min"], r["max"], r["p50"], r["p95"], r["p99"]
        ) == (len(v), v[0], v[-1], rank(0.5), rank(0.95), rank(0.99))
        assert r["median"] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 and abs(r["mean"] - sum(v) / len(v)) < 1e-9
    assert got["v"]["count"] == 0 and got["v"]["p95"] is None


def test_layout_scores(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    cell, stamp, head = "case_id string, page int, row int, col int, cell string", "case_id string, text string", "case_id string, pos int, text string"
    got = evaluation.layout_scores(
        make(
            [("a", 1, 0, 0, "x"), ("a", 1, 0, 1, "y")], cell
        ), make([("a", 1, 0, 0, "x")], cell), make([("a", "s")], stamp), make([("a", "s"), ("a", "t"), ("b", "u")], stamp),
        make([("a", 0, "p"), ("a", 1, "q"), ("a", 2, "r"), ("c", 0, "z")], head), make([("a", 5, "p"), ("a", 3, "q")], head),
    ).first()
    assert got.asDict() == {
        "table_cell_count": 2, "table_cell_accuracy": 0.5, "stamp_text_precision": 0.5, "stamp_text_recall": 1.0,
        "stamp_text_f1": 2 / 3, "two_column_order_accuracy": 0.5
    }
    none = evaluation.layout_scores(
        make([], cell), make([], cell), make([], stamp), make([], stamp), make([], head), make([], head)
    ).first()
    assert (none["table_cell_accuracy"], none["stamp_text_precision"], none["two_column_order_accuracy"]) == (None, 1.0, None)
