"""Operators of the engine on small inputs of known result."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking, evaluation, extraction, layout, retrieval

BOX = (0.0, 0.0, 10.0, 10.0)
BLOCK = "document_id string, file_name string, page int, block_id string, kind string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, reading_order int"


def blocks(spark, *rows, doc="d"):
    return spark.createDataFrame([(doc, f"{doc}.pdf", p, f"b{i}", k, t, BOX, i) for i, (p, k, t) in enumerate(rows)], BLOCK)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected", [("a B, c!", "a b c"), ("...", ""), (None, ""), ("£5 | x", "£5 | x"), ("Straße ﬁ", "strasse fi")]
)
def test_normalize_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(T.normalize_text(F.col("t")).alias("x"))
    assert df.first()["x"] == expected


def test_canonical_number(spark):
    got = [one(spark, T.canonical_number(F.col("n")), n=n) for n in (1200, 1200.0, 0.5, -0.0, 100)]
    assert got == ["1200", "1200", "0.5", "0", "100"]


def test_tokenize_stems_after_stop_words(spark):
    df = spark.createDataFrame([("The renewal of PARTIES is terminating; fees, boxes a don't",)], "t string")
    assert df.select(T.tokenize(F.col("t")).alias("x")).first()["x"] == ["renew", "party", "terminate", "fee", "box", "don't"]


def test_token_f1_counts_repeats(spark):
    df = spark.createDataFrame([("a b b", "b b c"), ("", ""), ("a", "")], "g string, p string")
    assert [round(r[0], 4) for r in T.with_token_f1(df, "g", "p").select("token_f1").collect()] == [0.6667, 1.0, 0.0]


def test_ocr_errors(spark):
    df = spark.createDataFrame(
        [("1", "the cat sat", "the hat sat on"), ("2", "", ""), ("3", "", "x"), ("4", unicodedata.normalize("NFD", "é"), "é")],
        "case_id string, reference_text string, predicted_text string"
    )
    got = {
        r["case_id"]: (r["character_errors"], r["word_errors"], r["cer"], r["wer"]) for r in evaluation.ocr_by_case(df).collect()
    }
    assert got == {"1": (4, 2, 4 / 11, 2 / 3), "2": (0, 0, 0.0, 0.0), "3": (1, 1, 1.0, 1.0), "4": (0, 0, 0.0, 0.0)}


def test_retrieval_rank_gaps_and_guard(spark):
    rel = spark.createDataFrame([("a", "x"), ("a", "y")], "case_id string, item_id string")
    got = spark.createDataFrame([("a", "y", 4), ("a", "z", 1), ("b", "x", 1)], "case_id string, item_id string, rank int")
    rows = {r["case_id"]: r for r in evaluation.retrieval_by_case(rel, got).collect()}
    assert (rows["a"]["recall_at_3"], rows["a"]["recall_at_5"], rows["a"]["mrr"]) == (0.0, 0.5, 0.25)
    assert rows["b"]["mrr"] is None and not rows["b"]["evaluable"]
    with pytest.raises(ValueError):
        evaluation.retrieval_by_case(rel, got, (0,))


def test_latency_empty_and_bad(spark):
    empty = evaluation.latency_summary(spark.createDataFrame([], "stage string, ms double"))
    row = empty.first()
    assert (row["count"], row["total"], row["p50"]) == (0, 0.0, None)
    bad = spark.createDataFrame([("s", -1.0)], "stage string, ms double").withColumn("ms", evaluation.checked_ms(F.col("ms")))
    with pytest.raises(Exception, match="latency"):
        evaluation.latency_summary(bad).collect()


def test_answers_match_bare_and_full(spark):
    c = "array<struct<source_id:string,document_id:string,page:int,block_ids:array<string>,is_bare:boolean>>"
    rows = [
        ("a", [("s1", None, None, [], True)], [("s1", "d", 1, ["b"], False), ("s2", "e", 1, ["c"], False)], False, False),
        ("b", [], [], True, False), ("c", [("", "d", 1, ["b", "c"], False)], [("q", "d", 1, ["c"], False)], False, False)
    ]
    df = spark.createDataFrame(
        rows, f"case_id string, gold {c}, predicted {c}, expected_abstention boolean, predicted_abstention boolean"
    )
    got = {
        r["case_id"]: (
            r["citation_precision"], r["citation_completeness"], r["abstention_accuracy"]
        ) for r in evaluation.answers_by_case(df).collect()
    }
    assert got == {"a": (0.5, 1.0, 1.0), "b": (1.0, 1.0, 0.0), "c": (1.0, 1.0, 1.0)}


def test_chunks_keep_tables_and_headings(spark):
    rows = blocks(
        spark, (1, "heading", "FEES"), (1, "paragraph", "x " * 30), (1, "paragraph", "y " * 30), (1, "table", "a | b"),
        (2, "paragraph", "z")
    )
    got = [(r["chunk_id"], r["block_ids"]) for r in chunking.chunk(rows, 80).orderBy("ord").collect()]
    assert got == [("d:p1:c001", ["b0", "b1"]), ("d:p1:c002", ["b0", "b2", "b3"]), ("d:p2:c003", ["b4"])]
    with pytest.raises(ValueError):
        chunking.chunk(rows, 79)


def test_split_text():
    assert chunking.split_text("aaaa bbbb cccc", 9) == ["aaaa bbbb", "cccc"]
    assert chunking.split_text("a" * 10, 4) == ["aaaa", "aaaa", "aa"]


def test_search_ties_and_stop_words(spark):
    rows = [(f"c{i}", "d", "d.pdf", [1], ["b"], t, i) for i, t in enumerate(["renewal notice", "renewal notice", "other words"])]
    chunks = spark.createDataFrame(
        rows,
        "chunk_id string, document_id string, file_name string, pages array<int>, block_ids array<string>, text string, ord int"
    )
    index = retrieval.BM25Index(chunks)
    q = spark.createDataFrame([("q", "renewal"), ("s", "the of")], "query_id string, question string")
    assert [(r["chunk_id"], r["rank"]) for r in index.search(q).orderBy("rank").collect()] == [("c0", 1), ("c1", 2)]
    assert index.search(q, 0).count() == 0


def test_answers_cite_or_abstain(spark):
    rows = [
        ("c0", "d1", "acme.pdf", [2], ["b"], "The fee is USD 10 per month. It rains.", 0),
        ("c1", "d2", "bolt.pdf", [1], ["b"], "The fee is USD 20 per month.", 1)
    ]
    chunks = spark.createDataFrame(
        rows,
        "chunk_id string, document_id string, file_name string, pages array<int>, block_ids array<string>, text string, ord int"
    )
    q = spark.createDataFrame(
        [
            ("1", "What is the monthly fee?"), ("2", "Compare the fee of acme and bolt"), ("3", "Who invented penicillin?"),
            ("4", " ")
        ],
        "query_id string, question string"
    )
    got = {r["query_id"]: r for r in retrieval.answer(q, retrieval.BM25Index(chunks)).collect()}
    assert got["1"]["citations"][0]["quote"].startswith("The fee is USD")
    assert {c["document_id"] for c in got["2"]["citations"]} == {"d1", "d2"}
    assert got["3"]["abstained"] and got["4"]["abstained"] and got["3"]["answer"] == retrieval.ABSTAIN


def contract(spark):
    return blocks(
        spark, (1, "title", "SERVICES AGREEMENT"), (
            1, "paragraph",
            "This Agreement is made as of 3 March 2024 between Acme Works Ltd and Bolt Labs Inc., a Delaware corporation."
        ),
        (1, "paragraph", "The initial term is for a period of"), (
            1, "paragraph", "twelve months. It renews for successive terms of one year."
        ), (1, "paragraph", "Termination requires 30 days written notice."),
        (1, "heading", "FEES"), (
            1, "paragraph", "Monthly: $100.00 and 5%. Invoices are due within 30 days."
        ), (1, "paragraph", "Governed by the laws of England, with courts there."), (1, "signature", "For Acme: A. Smith"), (1, "stamp", ""),
    )


def test_extraction(spark):
    b = contract(spark)
    got = {r["field"]: r for r in extraction.validate(extraction.extract(b), b).collect()}
    assert len(got) == 10
    # the entity form may run over "and"; the plain pair then adds both names
    assert got["parties"]["list_value"] == ["Acme Works Ltd and Bolt Labs Inc", "Acme Works Ltd", "Bolt Labs Inc"]
    assert got["effective_date"]["text_value"] == "3 March 2024" and got["initial_term"]["text_value"] == "twelve months"
    assert [e["block_id"] for e in got["initial_term"]["evidence"]] == ["b3"]
    assert got["fees"]["list_value"] == ["$100.00", "5%"] and got["governing_law"]["text_value"] == "England"
    assert got[
        "signatures_present"
    ]["flag_value"] and got["stamps_present"]["status"] == "needs_review" and got["stamps_present"]["confidence"] == 0.45
    assert got["termination_notice"]["text_value"] == "30 days written notice"


def test_held_documents_are_not_dealt_out_again(spark):
    held = extraction.hold(contract(spark)).withColumn("file_name", F.lit("d.pdf")).localCheckpoint()
    for made in (extraction.clause_fields, extraction.text_windows, chunking.chunk):
        plan = made(held)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan, made


def test_validation_rejects(spark):
    b = contract(spark)
    fields = extraction.extract(b).where("field = 'governing_law'").withColumn(
        "evidence", F.transform("evidence", lambda e: e.withField("quote", F.lit("not there")))
    )
    r = extraction.validate(fields, b).first()
    assert r["text_value"] is None and r["status"] == "needs_review" and r["confidence"] == 0.2 and "exact substring" in r["reason"]


def test_reading_order_two_columns(spark):
    s = "document_id string, page int, width double, height double, pos int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, kind string, source string, confidence double"
    at = [
        (0, 40, 20, 560, 50, "title"), (1, 320, 100, 560, 140, "paragraph"), (2, 40, 100, 280, 140, "paragraph"),
        (3, 40, 200, 280, 240, "paragraph"), (4, 40, 780, 560, 795, "footer")
    ]
    df = spark.createDataFrame(
        [("d", 1, 600.0, 800.0, p, "t", tuple(map(float, b)), 10.0, k, "native", 1.0) for p, *b, k in at], s
    )
    assert [r["pos"] for r in layout.reading_order(df).orderBy("reading_order").collect()] == [0, 2, 3, 1, 4]


def test_kinds(spark):
    s = "document_id string, page int, width double, height double, pos int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, kind string, source string, confidence double"
    rows = [
        ("Sales agreement", 20, 20), ("Plain words go here, at length", 100, 10), ("a | b | c", 200, 10),
        ("Page 3 of 4", 790, 10), ("Authorised signatory", 300, 10), ("OFFICIAL SEAL", 400, 10), ("1. Scope", 500, 10)
    ]
    df = spark.createDataFrame(
        [
            ("d", 1, 600.0, 800.0, i, t, (50.0, float(y), 300.0, float(y) + 10), float(f), "unknown", "native", 1.0) for i, (t, y, f) in enumerate(rows)
        ],
        s
    )
    assert [r["kind"] for r in layout.classify(df).orderBy("pos").collect()] == [
        "title", "paragraph", "table", "footer", "signature", "stamp", "heading"
    ]


def test_pairing_falls_back_to_position(spark):
    gold = spark.createDataFrame([("a", 0), ("a", 1)], "id string, pos int")
    pred = spark.createDataFrame([("x", 0)], "id string, pos int")
    rows = evaluation.pair_records(gold, pred).collect()
    assert sorted(r["predicted"] is None for r in rows) == [False, True]


def test_a_saved_index_answers_like_a_new_one(spark, tmp_path):
    rows = [(f"c{i}", "d", "d.pdf", [1], ["b"], t, i) for i, t in enumerate(["renewal notice", "notice of fees and fees", "", "other words", "the of"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, file_name string, pages array<int>, block_ids array<string>, text string, ord int")
    q = spark.createDataFrame([("q", "renewal fees"), ("r", "notice"), ("s", "the of")], "query_id string, question string")
    new = retrieval.BM25Index(chunks)
    want = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in new.search(q).collect())
    new.save(str(tmp_path / "index"), buckets=4)
    new.release()
    for given in ({}, {"max_terms": 0}):
        again = retrieval.BM25Index.load(spark, str(tmp_path / "index"), **given)
        assert sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in again.search(q).collect()) == want
    many = retrieval.BM25Index(chunks, max_terms=1)  # more terms than are broadcast
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in many.search(q).collect()) == want


def test_passages_lose_all_heading_lines(spark):
    text = "1. FEES\n\nPayment Terms\nA\nB C\nD E\nF\nThe fee is due.  It is 5.\nTOTAL"
    got = spark.createDataFrame([(text,)], "t string").select(T.passages(F.col("t")).alias("p")).first()["p"]
    assert got == ["1.", "The fee is due.", "It is 5.", "TOTAL"]


def test_the_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40; import quire.api, quire.cli"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
