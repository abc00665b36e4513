"""Pages: recognition output, pixels, tables, and the parse from a decoder to blocks."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import layout
from quire.sources import files, fixtures, ocr, pages, raster

QUAD = [[0, 0], [4, 0], [4, 2], [0, 2]]
WANT = [("hi", (0.0, 0.0, 4.0, 2.0), 0.9)]


@pytest.mark.parametrize("boxes", ocr.BOXES)
@pytest.mark.parametrize("texts", ocr.TEXTS)
@pytest.mark.parametrize("scores", ocr.SCORES)
def test_parallel_names(boxes, texts, scores):
    assert ocr.lines({boxes: [QUAD, QUAD], texts: ["hi", " "], scores: [0.9]}) == WANT
    assert ocr.lines(SimpleNamespace(**{boxes: np.array([QUAD]), texts: ("hi",), scores: [90]})) == WANT


@pytest.mark.parametrize("box", ocr.ITEM_BOX)
@pytest.mark.parametrize("text", ocr.ITEM_TEXT)
@pytest.mark.parametrize("score", ocr.ITEM_SCORE)
def test_item_names(box, text, score):
    item = {box: {"left": 0, "top": 0, "right": 4, "bottom": 2}, text: "hi", score: "0.9"}
    assert ocr.lines(item) == WANT and ocr.lines([item, {text: "no box"}]) == WANT
    assert [ocr.lines({w: [item]}) for w in ocr.WRAPPERS] == [WANT] * 4


def test_rows_and_timings():
    row = [QUAD, "hi", 90]
    assert [
        ocr.lines(x) for x in (row, [row], [[row]], ([row], 0.3), ([row], [0.1, None]), ([row], {"t": 1}), [[row], [0.1, 0.2]])
    ] == [WANT] * 7
    assert ocr.lines((row, row)) == WANT * 2 and ocr.lines([QUAD, "hi"])[0][2] == 0.0
    assert [ocr.lines(x) for x in (None, [], {}, "x", 3, [1, 2], {"boxes": None, "txts": None})] == [[]] * 7


def test_boxes_and_scores():
    assert ocr.box([0, 0, 4, 2]) == ocr.box([4, 2, 0, 0]) == ocr.box([0, 0, 4, 0, 4, 2, 0, 2]) == ocr.box(QUAD) == ocr.box(
        {"x0": 0, "y0": 0, "x1": 4, "y1": 2}
    ) == (0.0, 0.0, 4.0, 2.0)
    assert [
        ocr.box(x) for x in (None, [1, 2, 3], [0] * 5, [0] * 6, [[0, 0]] * 3, [0, 0, float("inf"), 1], {"x0": 1}, "abcd")
    ] == [None] * 8
    assert [
        ocr.confidence(x) for x in (0.5, 50, "0.5", 101, -1, None, "x", float("nan"), float("inf"))
    ] == [0.5, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_red_stamp():
    image = np.full((200, 100, 3), 255, np.uint8)
    assert raster.red_stamp(image, 50.0, 100.0) is None
    image[20:40, 10:30] = (200, 10, 10)
    found = raster.red_stamp(image, 50.0, 100.0)
    assert found["bbox"] == {
        "x0": 5.0, "y0": 10.0, "x1": 15.0, "y1": 20.0
    } and found["density"] == 1.0 and found["confidence"] == 0.98
    image[20:40, 10:80] = (200, 10, 10)
    assert raster.red_stamp(image, 50.0, 100.0) is None  # too wide


def test_stamps_by_rows_of_pixels(spark):
    """The gate over pixel rows finds what the one over arrays finds."""
    rng = np.random.default_rng(9)
    images = []
    for side, share in ((3, 1.0), (8, 1.0), (12, 0.5), (30, 1.0), (9, 0.02), (20, 0.1)):
        image = np.full((50, 60, 3), 255, np.uint8)
        image[5 : 5 + side, 7 : 7 + side][rng.random((side, side)) < share] = (180, 40, 60)
        images.append(image)
    rows = [("d", n, x, y, *map(int, image[y, x]), 60, 50) for n, image in enumerate(images) for y in range(50) for x in range(60)]
    names = ("x", "y", "r", "g", "b", "width", "height")
    pixels = spark.createDataFrame(rows, "document_id string, page int, " + ", ".join(f"{c} int" for c in names))
    got = {r["page"]: (tuple(r["bbox"]), round(r["confidence"], 9)) for r in layout.stamp_gate(pixels).collect()}
    want = {n: raster.red_stamp(image, 60.0, 50.0) for n, image in enumerate(images)}
    assert got == {n: (tuple(w["bbox"].values()), round(w["confidence"], 9)) for n, w in want.items() if w} and 0 < len(got) < 6


def brute_boxes(mask):
    """8-connected components that a path outside all of them, in 4 directions, reaches."""
    h, w = mask.shape
    free, todo = set(), [(-1, -1)]
    while todo:
        y, x = todo.pop()
        if (y, x) in free or not (-1 <= y <= h and -1 <= x <= w) or (0 <= y < h and 0 <= x < w and mask[y, x]):
            continue
        free.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    seen, out = set(), []
    for start in zip(*map(np.ndarray.tolist, np.nonzero(mask))):
        if start in seen:
            continue
        part, todo = set(), [start]
        while todo:
            y, x = todo.pop()
            if (y, x) not in part and 0 <= y < h and 0 <= x < w and mask[y, x]:
                part.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen |= part
        if any((y + a, x + b) in free for y, x in part for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))):
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(out)


def test_components_match_brute_force():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.4, 0.6):
        for _ in range(10):
            mask = rng.random((14, 17)) < share
            assert sorted(raster.outer_boxes(mask)) == brute_boxes(mask)
    ring = np.zeros((20, 20), bool)
    ring[2:18, 2:18] = True
    ring[4:16, 4:16] = False
    ring[8:10, 8:10] = True
    assert raster.outer_boxes(ring) == [(2, 2, 18, 18)]


def test_long_runs_open():
    row = np.zeros((1, 60), bool)
    row[0, 10:35], row[0, 40:50] = True, True
    got = np.flatnonzero(raster.long_runs(row, 21)[0])
    assert (got[0], got[-1]) == (10, 34)
    assert not raster.long_runs(row[:, 36:], 21).any()


def test_ruled_table():
    image = np.full((900, 600, 3), 255, np.uint8)
    for y in (200, 260, 320):
        image[y : y + 3, 100:500] = 0
    for x in (100, 300, 497):
        image[200:323, x : x + 3] = 0
    image[600:603, 100:140] = 0  # a short rule
    (found,) = raster.table_regions(image, 300.0, 450.0)
    assert abs(found["x0"] - 50) <= 1 and abs(found["y0"] - 100) <= 1 and abs(found["x1"] - 250) <= 1 and abs(
        found["y1"] - 161.5
    ) <= 1


CELL = "document_id string, page int, width double, height double, pos int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, kind string, source string, confidence double"


def cells(spark, *rows):
    return spark.createDataFrame(
        [("d", 1, 600.0, 800.0, i, t, tuple(map(float, b)), 10.0, "unknown", "native", c) for i, (t, b, c) in enumerate(rows)],
        CELL
    )


def brute_rows(boxes):
    """The rows of cells (x0, y0, x1, y1, text), by greedy clustering with a moving centre."""
    boxes = sorted(boxes, key=lambda b: (b[1], b[0]))
    tolerance = max(3.0, sorted(b[3] - b[1] for b in boxes)[len(boxes) // 2] * 0.75)
    rows = []
    for b in boxes:
        middle = (b[1] + b[3]) / 2
        for r in rows:
            if abs(middle - sum((x[1] + x[3]) / 2 for x in r) / len(r)) <= tolerance:
                r.append(b)
                break
        else:
            rows.append([b])
    rows.sort(key=lambda r: sum((x[1] + x[3]) / 2 for x in r) / len(r))
    return "\n".join(" | ".join(x[4] for x in sorted(r)) for r in rows)


def test_table_rows_match_brute_force(spark):
    rng = np.random.default_rng(6)
    at = [
        (float(x), float(y), float(x) + 20, float(y) + h, f"t{i}") for i, (x, y, h) in enumerate(zip(rng.integers(0, 500, 40), rng.integers(0, 700, 40), rng.integers(8, 30, 40)))
    ]
    regions = spark.createDataFrame(
        [("d", 1, 1, (0.0, 0.0, 600.0, 800.0)), ("d", 1, 2, (0.0, 0.0, 600.0, 800.0)), ("d", 2, 1, (0.0, 0.0, 9.0, 9.0))],
        f"document_id string, page int, region_no int, bbox {files.BOX}"
    )
    (got,) = layout.merge_tables(cells(spark, *[(t, (a, b, c, e), 0.5) for a, b, c, e, t in at]), regions).collect()
    assert got["text"] == brute_rows(at) and (
        got["kind"], got["cell_count"], got["confidence"], got["table_id"]
    ) == ("table", 40, 0.5, 1)


def test_tables_merge_or_relabel(spark):
    rows = cells(
        spark, ("a", (10, 10, 50, 20), 1.0), ("b", (60, 11, 90, 21), 0.5), ("c", (10, 40, 50, 50), 0.6),
        ("alone", (10, 300, 50, 310), 0.7), ("text", (10, 500, 50, 510), 0.8)
    )
    regions = spark.createDataFrame(
        [("d", 1, 1, (0.0, 0.0, 100.0, 60.0)), ("d", 1, 2, (0.0, 290.0, 100.0, 320.0)), ("d", 1, 3, (0.0, 700.0, 100.0, 720.0))],
        f"document_id string, page int, region_no int, bbox {files.BOX}"
    )
    got = [
        (
            r["text"], r["kind"], r["table_id"], r["row_count"], r["column_count"], r["cell_count"]
        ) for r in layout.merge_tables(rows, regions).orderBy("pos").collect()
    ]
    assert got == [
        ("text", "unknown", None, None, None, None), ("a | b\nc", "table", 1, 2, 2, 3), ("alone", "table", 2, None, None, None)
    ]
    none = layout.merge_tables(rows.limit(0), regions)
    assert none.count() == 0


def test_parse_end_to_end(spark):
    found = pages.page_blocks(
        pages.read_pages(fixtures.documents(spark), fixtures.decoder, fixtures.engine)
    ).orderBy("document_id", "page", "reading_order").collect()
    larch = [r for r in found if r["document_id"] == "doc_larch"]
    assert [
        r["text"] for r in larch if r["kind"] == "heading" and r["page"] == 1
    ] == ["1. PARTIES", "2. TERM", "3. TERMINATION", "4. GOVERNING LAW"]
    table = next(r for r in larch if r["kind"] == "table")
    assert table["text"] == "Item | Amount\nSetup | USD 900.00\nMonthly | USD 75.50" and table["metadata"]["format"] == "pipe-delimited" and table["metadata"]["row_count"] == "3"
    scan = [r for r in found if r["document_id"] == "doc_cedar"]
    assert {r["source"] for r in scan} == {"rapidocr"} and scan[0]["metadata"]["ocr_dpi"] == "200"
    stamp = next(r for r in scan if r["kind"] == "stamp")
    assert stamp["text"] == "Official stamp" and stamp["metadata"]["stamp_detector"] == "rgb-red-region"
    assert abs(next(r for r in scan if r["text"] == "SUPPLY CONTRACT")["bbox"]["x1"] - 400) < 0.6
    assert all(r["block_id"].startswith(f"p{r['page']:04d}-b{r['reading_order']:04d}-") for r in found)


def test_unread_documents_tell_why(spark):
    docs = fixtures.documents(spark)
    read = lambda d, decoder, engine=None: pages.read_pages(d, decoder, engine).collect()
    with pytest.raises(Exception, match="no engine was given"):
        read(docs, fixtures.decoder)
    with pytest.raises(Exception, match="is empty"):
        read(docs.withColumn("content", F.lit(b"")), fixtures.decoder)

    def locked():
        def decode(content):
            raise ValueError("encrypted")

        return decode

    with pytest.raises(Exception, match="can't be opened: encrypted"):
        read(docs, locked)
    with pytest.raises(files.DocumentParseError):
        pages.documents_of(spark, b"")
    assert pages.documents_of(spark, b"x").first()["file_name"] == "document.pdf"
    import io

    stream = io.BytesIO(b"x")
    stream.name = "/a/b.pdf"
    assert pages.documents_of(spark, stream).first()["file_name"] == "b.pdf"
    for bad in (io.StringIO("x"), 3):
        with pytest.raises(TypeError):
            pages.documents_of(spark, bad)
    for bad in ({"native_text_threshold": -1}, {"ocr_dpi": 71}):
        with pytest.raises(ValueError):
            pages.read_pages(docs, fixtures.decoder, **bad)


def test_failing_tables_are_none():
    def broken():
        raise RuntimeError("no tables today")

    assert pages.table_boxes(SimpleNamespace(width=10.0, height=10.0, tables=broken)) == []
    assert pages.table_boxes(
        SimpleNamespace(width=10.0, height=10.0, tables=[[-5, 0, 50, 5]])
    ) == [{"x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 5.0}]


def test_benchmark_over_fixtures(spark):
    r = fixtures.demo(spark)
    s = r["summary"]
    assert s["case_count"] == 6 and s["missing_prediction_count"] == 0
    assert s["layout"] == {
        "table_cell_count": 6, "table_cell_accuracy": 1.0, "stamp_text_precision": 1.0, "stamp_text_recall": 1.0,
        "stamp_text_f1": 1.0, "two_column_order_accuracy": 1.0
    }
    assert s["extraction"]["exact_match"] > 0.7 and s["answer"]["abstention_accuracy"] == 1.0 and s["retrieval"]["mrr"] > 0.5
    assert set(s["latency"]["by_stage"]) == {"parse", "extract", "chunk", "retrieve_and_answer"}


def test_model_answers_are_validated(spark):
    blocks = pages.page_blocks(pages.read_pages(fixtures.documents(spark).where("document_id = 'doc_rowan'"), fixtures.decoder))

    def client():
        import json

        def ask(payload):
            first = json.loads(payload)[0]
            good = {
                "document_id": "doc_rowan", "page": 1, "block_id": first["block_id"], "quote": first["text"],
                "bbox": first["bbox"]
            }
            return json.dumps(
                {
                    "document_id": "other",
                    "fields": [
                        {"field": "parties", "text_value": "LEASE", "status": "extracted", "confidence": 0.9, "evidence": [good]},
                        {"field": "fees", "text_value": "5", "status": "extracted", "confidence": 0.9, "evidence": []}
                    ]
                }
            )

        return ask

    got = {r["field"]: r for r in files.extract_validated(blocks, client).collect()}
    assert got["parties"]["text_value"] == "LEASE" and "the caller's id was kept" in got["parties"]["warning"]
    assert got["fees"]["text_value"] is None and got["fees"]["status"] == "needs_review"


def written(tmp_path, names):
    import json

    for name in names:
        (tmp_path / f"{name}.pdf").write_text(json.dumps(fixtures.CONTRACTS[name]))


def test_files_as_they_arrive(spark, tmp_path):
    from quire.streaming.parse import watch_blocks

    (tmp_path / "in").mkdir()
    run = lambda: watch_blocks(spark, str(tmp_path / "in"), str(tmp_path / "mark"), str(tmp_path / "out"), fixtures.decoder, fixtures.engine).awaitTermination(120)
    written(tmp_path / "in", ["larch", "rowan"])
    assert run()
    assert {r["file_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"larch.pdf", "rowan.pdf"}
    written(tmp_path / "in", ["cedar"])
    assert run()
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("file_name", "batch").count().collect()
    assert sorted((r["file_name"], r["batch"]) for r in rows) == [("cedar.pdf", 1), ("larch.pdf", 0), ("rowan.pdf", 0)]


def test_folders_texts_and_manifests(spark, tmp_path):
    import hashlib

    written(tmp_path, ["larch", "rowan"])
    (tmp_path / "notes.txt").write_text("a  b\n c")
    docs = files.read_documents(spark, str(tmp_path)).orderBy("file_name").collect()
    sha = hashlib.sha256((tmp_path / "larch.pdf").read_bytes()).hexdigest()
    assert [d["file_name"] for d in docs] == ["larch.pdf", "rowan.pdf"] and docs[0]["sha256"] == sha and docs[0]["document_id"] == f"doc_{sha[:16]}"
    assert [tuple(r) for r in files.read_gold_text(spark, str(tmp_path / "*.txt")).collect()] == [("notes", "a b c")]
    m = files.manifest(spark, str(tmp_path))
    assert m["files"][0] == {"file_name": "larch.pdf", "sha256": sha} and m["versions"]["pyspark"] and files.installed("no such package") is None
    value = files.read_json(spark, str(tmp_path / "rowan.pdf"), "array<struct<text:array<struct<type:int>>>>").first()["value"]
    assert len(value) == 1
    found = pages.parse(spark, str(tmp_path / "*.pdf"), fixtures.decoder, fixtures.engine)
    assert {r["file_name"] for r in found.collect()} == {"larch.pdf", "rowan.pdf"}
    payload = files.source_payload(found.where("file_name = 'rowan.pdf'")).first()["payload"]
    import json

    assert [b["reading_order"] for b in json.loads(payload)] == list(range(7))


def test_command_line(spark, tmp_path, capsys):
    from quire import cli

    written(tmp_path, ["rowan"])
    at = ["--decoder", "quire.sources.fixtures:decoder"]
    cli.main(["parse", str(tmp_path / "*.pdf"), *at, "-o", str(tmp_path / "blocks")])
    assert spark.read.json(str(tmp_path / "blocks")).count() == 7
    cli.main(["extract", str(tmp_path / "*.pdf"), *at])
    assert "effective_date" in capsys.readouterr().out
    (tmp_path / "m.json").write_text('{"summary": {"case_count": 3}}')
    cli.main(["show-metrics", str(tmp_path / "m.json")])
    assert '"case_count": 3' in capsys.readouterr().out


def test_public_names():
    from quire import api

    names = "parse_pdf normalize_ocr_output DocumentParseError OCRUnavailableError OCRLine CONTRACT_FIELDS extract_contract validate_extraction AdapterError ABSTENTION_MESSAGE BM25Index answer_question chunk_document tokenize evaluate_records evaluate_json_files evaluate_case load_json_records render_html_report write_html_report write_json_report normalize_text normalized_exact_match token_f1 evaluate_extraction evaluate_evidence evaluate_ocr evaluate_retrieval evaluate_answer aggregate_latencies"
    assert all(hasattr(api, n) for n in names.split())
