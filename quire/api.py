"""The engine's names in one place, by area. All take and return DataFrames unless their docstrings say
otherwise."""

from __future__ import annotations

# ingest
from quire.sources.files import AdapterError, DocumentParseError, OCRUnavailableError  # noqa: F401
from quire.sources.ocr import Line as OCRLine  # noqa: F401
from quire.sources.ocr import lines as normalize_ocr_output  # noqa: F401
from quire.sources.pages import page_blocks, read_pages  # noqa: F401
from quire.sources.pages import parse as parse_pdf  # noqa: F401

# extraction
from quire.operators.extraction import FIELDS as CONTRACT_FIELDS  # noqa: F401
from quire.operators.extraction import extract as extract_contract  # noqa: F401
from quire.operators.extraction import validate as validate_extraction  # noqa: F401
from quire.sources.files import extract_validated  # noqa: F401

# retrieval
from quire.functions.text import tokenize  # noqa: F401
from quire.operators.chunking import chunk as chunk_document  # noqa: F401
from quire.operators.retrieval import ABSTAIN as ABSTENTION_MESSAGE  # noqa: F401
from quire.operators.retrieval import BM25Index  # noqa: F401
from quire.operators.retrieval import answer as answer_question  # noqa: F401

# evaluation
from quire.functions.text import exact_match as normalized_exact_match  # noqa: F401
from quire.functions.text import normalize_text, tokens_f1  # noqa: F401
from quire.functions.text import with_token_f1 as token_f1  # noqa: F401
from quire.operators.evaluation import answers_by_case as answer_metrics  # noqa: F401
from quire.operators.evaluation import evidence_by_field as evidence_metrics  # noqa: F401
from quire.operators.evaluation import field_scores as extraction_metrics  # noqa: F401
from quire.operators.evaluation import latency_summary as latency_metrics  # noqa: F401
from quire.operators.evaluation import ocr_by_case as ocr_metrics  # noqa: F401
from quire.operators.evaluation import retrieval_by_case as retrieval_metrics  # noqa: F401
from quire.operators.records import evaluate_case, evaluate_json_files, evaluate_records, load_json_records  # noqa: F401
from quire.sources.files import render_html_report, write_html_report, write_json_report  # noqa: F401

evaluate_extraction, evaluate_evidence, evaluate_ocr = extraction_metrics, evidence_metrics, ocr_metrics
evaluate_retrieval, evaluate_answer, aggregate_latencies = retrieval_metrics, answer_metrics, latency_metrics
