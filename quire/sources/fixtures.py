"""Three invented contracts with gold annotations, and the benchmark over them (S22, entry point "demo").

A file is JSON: pages with native text, or a scan whose lines the engine below reads back. Decoder and engine
are what an application injects for real files.
"""

from __future__ import annotations

import json
import time
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunking, evaluation, extraction, records, retrieval
from quire.sources import pages

A4 = (595.0, 842.0)


def _text(x0, y0, x1, y1, *lines, size=10.0) -> dict:
    return {"type": 0, "bbox": [x0, y0, x1, y1], "lines": [{"spans": [{"text": t, "size": size}]} for t in lines]}


LARCH = [
    {
        "text": [
            _text(60, 40, 535, 64, "CONSULTING AGREEMENT", size=18.0),
            _text(60, 90, 280, 130, "1. PARTIES"), _text(
                60, 135, 280, 200, "This Agreement is entered into as of May 4, 2025 between",
                "Larch Analytics LLC and Pine Harbor Inc."
            ),
            _text(60, 230, 280, 250, "2. TERM"), _text(
                60, 255, 280, 320, "The initial term is for a period of 18 months.", "It renews for successive terms of one year."
            ),
            _text(315, 90, 535, 130, "3. TERMINATION"), _text(
                315, 135, 535, 200, "Either party may end it; termination requires 45 days written notice."
            ),
            _text(315, 230, 535, 250, "4. GOVERNING LAW"), _text(
                315, 255, 535, 320, "This Agreement is governed by the laws of Oregon, without exception."
            ),
        ],
    },
    {
        "text": [
            _text(60, 60, 200, 80, "5. FEES"),
            _text(70, 100, 200, 115, "Item"), _text(250, 100, 380, 115, "Amount"), _text(70, 125, 200, 140, "Setup"), _text(
                250, 125, 380, 140, "USD 900.00"
            ), _text(70, 150, 200, 165, "Monthly"), _text(250, 150, 380, 165, "USD 75.50"),
            _text(60, 200, 535, 225, "Invoices are due within 30 days."), _text(
                60, 600, 300, 640, "Signed by the parties", "For Larch Analytics: R. Vale"
            ), _text(250, 800, 340, 815, "Page 2 of 2"),
        ],
        "tables": [[60, 90, 400, 175]],
    },
]
CEDAR = [
    {
        "scan": [
            ("SUPPLY CONTRACT", (60, 40, 400, 70), 0.99), (
                "Dated as of 12 January 2024 between Cedar Tools Ltd and Elm Works GmbH.", (60, 100, 540, 130), 0.97
            ),
            (
                "The buyer shall pay a price of EUR 1,250.00 for each lot.", (60, 160, 540, 190), 96
            ), ("Payment is due upon receipt.", (60, 220, 540, 250), 0.95),
            ("Official stamp", (410, 710, 490, 735), 0.9),
        ],
        "stamp": (400, 700, 500, 760),
    },
]
ROWAN = [
    {
        "text": [
            _text(60, 40, 535, 64, "LEASE AGREEMENT", size=16.0), _text(60, 90, 535, 120, "Tenant: Rowan Books Ltd"), _text(
                60, 125, 535, 150, "Landlord: Ash Estates PLC"
            ),
            _text(60, 160, 535, 190, "The effective date is 2023-11-01."), _text(
                60, 200, 535, 230, "The rent of GBP 2,400.00 is payable monthly."
            ), _text(60, 240, 535, 270, "The laws of England shall govern this lease."),
            _text(60, 700, 300, 720, "Signature: ____"),
        ],
    },
]
CONTRACTS = {"larch": LARCH, "cedar": CEDAR, "rowan": ROWAN}
GOLD = {
    "larch": {
        "parties": ["Larch Analytics LLC", "Pine Harbor Inc"], "effective_date": "May 4, 2025", "initial_term": "18 months",
        "termination_notice": "45 days written notice", "governing_law": "Oregon", "fees": ["USD 900.00", "USD 75.50"],
        "signatures_present": True, "stamps_present": None
    },
    "cedar": {"effective_date": "12 January 2024", "fees": ["EUR 1,250.00"], "stamps_present": True, "governing_law": None},
    "rowan": {
        "parties": ["Rowan Books Ltd", "Ash Estates PLC"], "effective_date": "2023-11-01", "fees": ["GBP 2,400.00"],
        "governing_law": "England", "signatures_present": True
    },
}
PHRASES = [
    ("larch", "effective_date", "May 4, 2025"), ("larch", "governing_law", "laws of Oregon"), ("larch", "fees", "USD 900.00"),
    ("larch", "fees", "USD 75.50"), ("cedar", "fees", "EUR 1,250.00"), ("rowan", "governing_law", "laws of England")
]
CELLS = [
    ("larch", 2, "Item"), ("larch", 2, "Amount"), ("larch", 2, "Setup"), ("larch", 2, "USD 900.00"), ("larch", 2, "Monthly"),
    ("larch", 2, "USD 75.50")
]
STAMPS = [("cedar", "Official stamp")]
HEADINGS = [("larch", i, t) for i, t in enumerate(["1. PARTIES", "2. TERM", "3. TERMINATION", "4. GOVERNING LAW"])]
QUESTIONS = [
    ("law", "Which laws of Oregon govern the Larch agreement?", ["larch"], ["laws of Oregon"]),
    ("rent", "What rent must Rowan pay?", ["rowan"], ["rent of GBP"]), ("moon", "Who walked on the moon?", [], [])
]
_SCANS = [page["scan"] for contract in CONTRACTS.values() for page in contract if "scan" in page]


def decoder():
    """JSON bytes to pages. A scan is drawn blank, with its number in a corner and its stamp in red."""

    def render(page: dict, dpi: int) -> np.ndarray:
        scale = dpi / 72
        image = np.full((round(A4[1] * scale), round(A4[0] * scale), 3), 255, np.uint8)
        if "scan" in page:
            image[0, 0] = [tuple(map(tuple, _flat(s))) for s in _SCANS].index(tuple(map(tuple, _flat(page["scan"]))))
        if "stamp" in page:
            x0, y0, x1, y1 = (round(v * scale) for v in page["stamp"])
            image[y0:y1, x0:x1] = (200, 20, 30)
        return image

    def decode(content: bytes) -> list:
        return [
            SimpleNamespace(
                width=A4[0], height=A4[1], text={"blocks": p.get("text", [])}, tables=p.get("tables", []), render=lambda dpi,
                p=p: render(p, dpi)
            ) for p in json.loads(content)
        ]

    return decode


def _flat(scan) -> list:
    return [(t, *b, c) for t, b, c in scan]


def engine():
    """Reads the lines of the scan whose number is in the corner, in pixels."""

    def read(image: np.ndarray) -> dict:
        scan, scale = _SCANS[int(image[0, 0, 0])], image.shape[1] / A4[0]
        return {
            "rec_boxes": [[v * scale for v in b] for _, b, _ in scan], "rec_texts": [t for t, _, _ in scan],
            "rec_scores": [c for _, _, c in scan]
        }

    return read


def documents(spark: SparkSession) -> DataFrame:
    rows = [(f"doc_{name}", f"{name}.pdf", name, bytearray(json.dumps(p).encode())) for name, p in CONTRACTS.items()]
    return spark.createDataFrame(rows, "document_id string, file_name string, sha256 string, content binary")


def demo(spark: SparkSession) -> dict:
    """The whole benchmark: parse, extract, chunk, answer, score. Returns the report."""
    took: dict[str, float] = {}

    def timed(stage: str, df: DataFrame) -> DataFrame:
        began, held = time.perf_counter(), df.persist()
        held.count()
        took[stage] = (time.perf_counter() - began) * 1000
        return held

    case = F.regexp_replace("document_id", "^doc_", "")
    found = timed("parse", pages.page_blocks(pages.read_pages(documents(spark), decoder, engine)))
    blocks = found.select("document_id", "page", "block_id", "kind", "text", "bbox", "reading_order")
    fields = timed("extract", extraction.validate(extraction.extract(blocks), blocks))
    chunks = timed(
        "chunk", chunking.chunk(found.select("document_id", "file_name", "page", "block_id", "kind", "text", "reading_order"))
    )
    asked = spark.createDataFrame(
        [(q, t, d, p) for q, t, d, p in QUESTIONS],
        "query_id string, question string, relevant_documents array<string>, relevant_phrases array<string>"
    )
    index = retrieval.BM25Index(chunks)
    hits = index.search(asked)
    answers = timed("retrieve_and_answer", retrieval.answer(asked, index))

    phrases = spark.createDataFrame(
        [(f"doc_{c}", f, i, p) for i, (c, f, p) in enumerate(PHRASES)], "document_id string, field string, pos int, phrase string"
    )
    located: dict[tuple, list] = {}
    for r in records.gold_evidence(phrases, blocks).collect():
        located.setdefault((r["document_id"], r["field"]), []).append(
            {"document_id": r["document_id"], "page": r["page"], "block_id": r["block_id"]}
        )
    gold = [
        {
            "case_id": c,
            "extraction": {"fields": {f: {"value": v, "evidence": located.get((f"doc_{c}", f), [])} for f, v in values.items()}}
        } for c, values in GOLD.items()
    ]
    predicted: dict[str, dict] = {}
    for r in fields.withColumn("case", case).collect():
        if r["field"] in GOLD[r["case"]]:
            value = next((r[c] for c in ("text_value", "list_value", "flag_value") if r[c] is not None), None)
            evidence = [
                {"document_id": e["document_id"], "page": e["page"], "block_id": e["block_id"]} for e in r["evidence"] or []
            ]
            predicted.setdefault(r["case"], {})[r["field"]] = {"value": value, "status": r["status"], "evidence": evidence}
    relevant: dict[str, list] = {}
    for r in retrieval.relevant_chunks(asked, chunks).collect():
        relevant.setdefault(r["query_id"], []).append(r["chunk_id"])
    got: dict[str, list] = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append({"rank": r["rank"], "chunk_id": r["chunk_id"]})
    said = {r["query_id"]: r.asDict(recursive=True) for r in answers.collect()}
    gold += [
        {
            "case_id": q, "relevant_ids": relevant.get(q, []),
            "answer": {"citations": sorted(relevant.get(q, []))[:1], "abstained": not d}
        } for q, _, d, _ in QUESTIONS
    ]
    guesses = [{"case_id": c, "extraction": {"fields": f}} for c, f in predicted.items()]
    guesses += [
        {
            "case_id": q, "retrieved_ids": got.get(q, []),
            "answer": {"citations": a["citations"] or [], "abstained": a["abstained"]}
        } for q, a in said.items()
    ]
    guesses[0]["latency_ms"] = took
    report = records.evaluate_records(spark, gold, guesses)
    report["summary"]["layout"] = layout_summary(spark, blocks.withColumn("case_id", case))
    for held in (found, fields, chunks, answers):
        held.unpersist()
    return report


def layout_summary(spark: SparkSession, blocks: DataFrame) -> dict:
    """A23 over the fixtures' annotations."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))
    numbered = lambda df, cell: df.select("case_id", "page", F.lit(0).alias("row"), "col", flat(cell).alias("cell"))
    cells = spark.createDataFrame(
        [(c, p, i, t) for i, (c, p, t) in enumerate(CELLS)], "case_id string, page int, col int, cell string"
    )
    rows = blocks.where("kind = 'table'").select(
        "case_id", "page",
        F.posexplode(F.flatten(F.transform(F.split("text", "\\n"), lambda x: F.split(x, "\\|")))).alias("col", "cell")
    )
    stamps = spark.createDataFrame(STAMPS, "case_id string, text string").select("case_id", flat(F.col("text")).alias("text"))
    order = spark.createDataFrame(HEADINGS, "case_id string, pos int, text string").select(
        "case_id", "pos", flat(F.col("text")).alias("text")
    )
    placed = blocks.where("kind = 'heading'").groupBy(
        "case_id", flat(F.col("text")).alias("text")
    ).agg(F.max("reading_order").alias("pos"))
    found = evaluation.layout_scores(
        numbered(cells, F.col("cell")), numbered(rows, F.col("cell")), stamps,
        blocks.where("kind = 'stamp'").select("case_id", flat(F.col("text")).alias("text")), order, placed,
        blocks.select("case_id")
    )
    return found.first().asDict()
