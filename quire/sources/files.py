"""Files in and out: binary documents, JSON, text, model clients, reports."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import extraction


class DocumentParseError(Exception):
    """A document can't be read."""


class OCRUnavailableError(DocumentParseError):
    """A page needs OCR and there is no engine."""


class AdapterError(Exception):
    """The model adapter failed."""


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def documents_in(files: DataFrame) -> DataFrame:
    """document_id, file_name, sha256, content of binary files (path, content)."""
    sha = F.sha2("content", 256)
    return files.select(
        F.concat(F.lit("doc_"), F.left(sha, F.lit(16))).alias("document_id"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"), sha.alias("sha256"), "content"
    )


def read_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """The documents of a folder."""
    return documents_in(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def stem(name):
    return F.regexp_replace(name, "\\.[^.]*$", "")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One value a file, with an explicit schema."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("value"))


def read_gold_text(spark: SparkSession, path: str) -> DataFrame:
    """case_id and the text, white space collapsed."""
    text = F.trim(F.regexp_replace("value", "(?U)\\s+", " "))
    return spark.read.text(path, wholetext=True).select(
        stem(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("case_id"), text.alias("text")
    )


def source_payload(blocks: DataFrame) -> DataFrame:
    """A JSON array of each document's blocks, in order, for a model client."""
    b = F.struct("page", "reading_order", "block_id", "kind", "text", "bbox", "confidence")
    return blocks.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(b))).alias("payload"))


def extract_with_client(payloads: DataFrame, make_client: Callable[[], Callable[[str], str]], schema: str) -> DataFrame:
    """A model's JSON answer by document: document_id, answer, warning. The caller's document_id
    holds; an answer that names another one is told of. ``extract_validated`` goes on to check it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_client()
        for pdf in batches:
            try:
                yield pd.DataFrame({"document_id": pdf["document_id"], "answer": [ask(p) for p in pdf["payload"]]})
            except Exception as error:
                raise AdapterError(str(error)) from error

    found = payloads.mapInPandas(run, "document_id string, answer string")
    named = F.get_json_object("answer", "$.document_id")
    warning = F.when(
        named.isNotNull() & (named != F.col("document_id")),
        F.concat(F.lit("the model named document "), named, F.lit("; the caller's id was kept"))
    )
    return found.select("document_id", F.from_json("answer", schema).alias("answer"), warning.alias("warning"))


_EVIDENCE = f"document_id:string,page:int,block_id:string,quote:string,bbox:{BOX}"
ANSWER = f"document_id string, fields array<struct<field:string,text_value:string,list_value:array<string>,flag_value:boolean,status:string,confidence:double,evidence:array<struct<{_EVIDENCE}>>,reason:string>>"


def extract_validated(blocks: DataFrame, make_client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """A model's fields (ANSWER) over the documents' sources, held against them like any others."""
    answers = extract_with_client(source_payload(blocks), make_client, ANSWER)
    fields = answers.select("document_id", F.inline("answer.fields"))
    checked = extraction.validate(fields, blocks)
    told = answers.where("warning is not null").select("document_id", F.col("warning").alias("_told"))
    return checked.join(told, "document_id", "left").withColumn(
        "warning", F.nullif(F.concat_ws("; ", "_told", "warning"), F.lit(""))
    ).drop("_told")


def manifest(spark: SparkSession, path: str, glob: str = "*.pdf") -> dict:
    """The files' hashes and the versions that read them."""
    rows = read_documents(spark, path, glob).select("file_name", "sha256").orderBy("file_name").collect()
    return {
        "files": [r.asDict() for r in rows],
        "versions": {name: installed(name) for name in ("pyspark", "pyarrow", "pandas", "numpy")}
    }


def installed(package: str) -> str | None:
    try:
        return version(package)
    except PackageNotFoundError:
        return None


def to_report(sections: dict[str, DataFrame]) -> dict:
    """Small summary frames as one report."""
    return {"schema_version": "1.0", **{k: [r.asDict(recursive=True) for r in df.collect()] for k, df in sections.items()}}


def write_json_report(report: dict, path: str) -> None:
    """Sorted keys, indented; NaN is an error."""
    _write(path, json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False, default=str) + "\n")


def _write(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


# what is shown as a share
RATES = ("accuracy", "precision", "completeness", "correctness", "recall", "rate", "f1", "exact_match", "mrr", "cer", "wer")
CARDS = {
    "Extraction": ("extraction", "exact_match"), "Token F1": ("extraction", "token_f1"), "Character errors": ("ocr", "cer"),
    "Retrieval MRR": ("retrieval", "mrr"), "Citations": ("answer", "citation_precision"),
    "p95, ms": ("latency", "overall", "p95_ms")
}
STYLE = "body{font:15px/1.5 system-ui,sans-serif;max-width:70rem;margin:2rem auto;padding:0 1rem}.cards{display:flex;flex-wrap:wrap;gap:1rem}.card{border:1px solid #bbb;border-radius:6px;padding:.6rem 1rem}.card b{display:block;font-size:1.4rem}table{border-collapse:collapse;margin:.5rem 0}td,th{border-bottom:1px solid #ddd;padding:.25rem .8rem;text-align:right}th:first-child{text-align:left}pre{overflow:auto;background:#f4f4f4;padding:.6rem}"


def shown(value, name: str = "") -> str:
    """A value for people: shares as percent, nothing as a dash."""
    if value is None:
        return "–"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float) and any(r in name for r in RATES):
        return f"{value:.1%}"
    return f"{value:,.2f}" if isinstance(value, float) else str(value)


def _at(report: dict, *names: str):
    for n in names:
        report = report.get(n) if isinstance(report, dict) else None
    return report


def _table(heads: list[str], rows: list[list[str]]) -> str:
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in row) + "</tr>"
    return "<table>" + cells("th", heads) + "".join(cells("td", r) for r in rows) + "</table>"


def render_html_report(report: dict, title: str = "Document evaluation") -> str:
    """One page without scripts or links: cards, a panel for each section of the summary, tables by field and
    by stage, and each case. Everything is escaped."""
    summary = report.get("summary", {})
    if not isinstance(summary, dict):
        raise TypeError("the summary must be a mapping")
    parts = [
        f"<!doctype html><html lang=en><meta charset=utf-8><title>{html.escape(title)}</title><style>{STYLE}</style><h1>{html.escape(title)}</h1>"
    ]
    cards = "".join(
        f"<div class=card>{html.escape(k)}<b>{html.escape(shown(_at(summary, *at), at[-1]))}</b></div>" for k, at in CARDS.items()
    )
    parts.append(f"<section class=cards>{cards}</section>")
    flat = {k: v for k, v in summary.items() if not isinstance(v, (dict, list))}
    for name, section in [("run", flat), *[(k, v) for k, v in summary.items() if isinstance(v, dict) and k != "latency"]]:
        values = {**section, **{f"recall_at_{k}": v for k, v in section.get("recall_at_k", {}).items()}}
        rows = [[k.replace("_", " "), shown(v, k)] for k, v in values.items() if not isinstance(v, (dict, list))]
        parts.append(f"<h2>{html.escape(name)}</h2>" + _table(["", "value"], rows))
    fields, stages = _at(summary, "extraction", "per_field"), _at(summary, "latency", "by_stage")
    if fields:
        parts.append(
            "<h2>fields</h2>" + _table(
                ["field", "n", "exact", "token F1"],
                [[k, str(v["count"]), shown(v["exact_match"], "rate"), shown(v["token_f1"], "rate")] for k, v in fields.items()]
            )
        )
    if stages:
        parts.append(
            "<h2>latency, ms</h2>" + _table(
                ["stage", "n", "mean", "p95", "max"],
                [[k, str(v["count"]), *(shown(v[c]) for c in ("mean_ms", "p95_ms", "max_ms"))] for k, v in stages.items()]
            )
        )
    for name, rows in report.items():  # frames of ``to_report``
        if isinstance(rows, list) and rows and name != "cases" and isinstance(rows[0], dict):
            parts.append(
                f"<h2>{html.escape(name)}</h2>" + _table(list(rows[0]), [[shown(v, k) for k, v in r.items()] for r in rows])
            )
    for case in report.get("cases", []):
        body = json.dumps(case, indent=2, sort_keys=True, ensure_ascii=False, default=str)
        parts.append(
            f"<details><summary>{html.escape(str(case.get('case_id', 'case')))}</summary><pre>{html.escape(body)}</pre></details>"
        )
    return "\n".join([*parts, "</html>\n"])


def write_html_report(report: dict, path: str, title: str = "Document evaluation") -> None:
    _write(path, render_html_report(report, title))


def console_summary(report: dict) -> str:
    """The summary's figures, a line each."""
    lines = []
    for name, section in report.get("summary", {}).items():
        for k, v in section.items() if isinstance(section, dict) else [("", section)]:
            if not isinstance(v, (dict, list)):
                lines.append(f"{(name + ' ' + k).strip().replace('_', ' '):<44}{shown(v, k or name)}")
    return "\n".join(lines)
