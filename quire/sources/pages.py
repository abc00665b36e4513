"""Pages end to end: a decoder's pages to canonical blocks.

Decoding and recognition stay at the edge, in one pass of Python workers with an injected decoder and
engine, each made once a worker. What follows is DataFrame operators, all keyed by page.

A decoder is called with a file's bytes and gives pages: objects with ``width`` and ``height`` (points) and
where there are any
  text    {"blocks": [{"type": 0, "bbox": [...], "lines": [{"spans": [{"text", "size"}]}]}]}, native text
  tables  boxes of native tables, or a function that gives them
  render  a function from dpi to an array of rows x columns x (red, green, blue)
An engine is called with an array of rows x columns x (blue, green, red) and gives any output that ``ocr.lines``
reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os import PathLike
from pathlib import Path
from typing import Any, BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout
from quire.sources import ocr, raster
from quire.sources.files import BOX, DocumentParseError, OCRUnavailableError, read_documents

_BLOCK = f"pos:int,text:string,bbox:{BOX},font_size:double,kind:string,source:string,confidence:double,line_count:int,ocr_dpi:int"
_STAMP = f"bbox:{BOX},confidence:double,density:double,source:string"
PAGES = f"document_id string, file_name string, sha256 string, page int, width double, height double, blocks array<struct<{_BLOCK}>>, tables array<{BOX}>, stamp struct<{_STAMP}>"
CORNERS = ("x0", "y0", "x1", "y1")


def documents_of(spark: SparkSession, source: str | PathLike | bytes | BinaryIO, file_name: str | None = None) -> DataFrame:
    """A path or pattern, bytes, or a binary stream as (document_id, file_name, sha256, content)."""
    if isinstance(source, (str, PathLike)):
        return read_documents(spark, str(source), "*")
    if hasattr(source, "read"):
        file_name = file_name or Path(str(getattr(source, "name", "") or "document.pdf")).name
        try:
            source = source.read()
        except OSError as error:
            raise DocumentParseError(f"the stream can't be read: {error}") from error
    if not isinstance(source, (bytes, bytearray)):
        raise TypeError("a source is a path, bytes, or a stream opened in binary mode")
    if not source:
        raise DocumentParseError("the source is empty")
    sha = hashlib.sha256(source).hexdigest()
    row = (f"doc_{sha[:16]}", file_name or "document.pdf", sha, bytearray(source))
    return spark.createDataFrame([row], "document_id string, file_name string, sha256 string, content binary")


def clipped(raw, width: float, height: float) -> dict[str, float] | None:
    """Within the page; nothing without area."""
    x0, y0, x1, y1 = (float(v) for v in list(raw)[:4])
    x0, y0, x1, y1 = max(0.0, x0), max(0.0, y0), min(width, x1), min(height, y1)
    return dict(zip(CORNERS, (x0, y0, x1, y1))) if x1 > x0 and y1 > y0 else None


def native_blocks(page: Any) -> list[dict]:
    """The text blocks of a page, lines joined, with their largest font."""
    out = []
    for raw in (getattr(page, "text", None) or {}).get("blocks", []):
        if raw.get("type", 0) != 0 or len(raw.get("bbox") or ()) < 4:
            continue
        spans = [line.get("spans", []) for line in raw.get("lines", [])]
        lines = [t for t in ("".join(str(s.get("text", "")) for s in line).strip() for line in spans) if t]
        bbox = clipped(raw["bbox"], page.width, page.height)
        if lines and bbox:
            sizes = [float(s.get("size", 0.0)) for line in spans for s in line if str(s.get("text", "")).strip()]
            out.append(
                {
                    "text": "\n".join(lines), "bbox": bbox, "font_size": max(sizes, default=0.0), "source": "native",
                    "confidence": 1.0, "line_count": len(lines), "ocr_dpi": None
                }
            )
    return out


def ocr_blocks(page: Any, image: np.ndarray, engine: Callable, dpi: int, number: int) -> list[dict]:
    """The engine's lines, scaled from pixels to points and clipped."""
    try:
        found = ocr.lines(engine(np.ascontiguousarray(image[..., ::-1])))
    except Exception as error:
        raise DocumentParseError(f"OCR failed on page {number}: {error}") from error
    scale = np.array([page.width / image.shape[1], page.height / image.shape[0]] * 2)
    placed = [(text, clipped(np.array(b) * scale, page.width, page.height), c) for text, b, c in found]
    return [
        {
            "text": text, "bbox": b, "font_size": 0.0, "source": "rapidocr", "confidence": c, "line_count": None, "ocr_dpi": dpi
        } for text, b, c in placed if b
    ]


def table_boxes(page: Any) -> list[dict]:
    """Native tables; a detector that fails finds none."""
    try:
        tables = page.tables() if callable(getattr(page, "tables", None)) else getattr(page, "tables", None) or []
        return [b for b in (clipped(t, page.width, page.height) for t in tables) if b]
    except Exception:  # noqa: BLE001  tables are an addition
        return []


def read_pages(
    documents: DataFrame, make_decoder: Callable[[], Callable[[bytes], list]], make_engine: Callable[[], Callable] | None = None,
    native_text_threshold: int = 40, ocr_dpi: int = 200, detect_stamps: bool = True, stamp_dpi: int = 96
) -> DataFrame:
    """A row for each page, with block candidates, table regions and the stamp. Pages with too little
    native text are recognised; the engine is made at the first of them (S6)."""
    if native_text_threshold < 0 or ocr_dpi < 72:
        raise ValueError("native_text_threshold can't be negative, ocr_dpi must be at least 72")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode, engines = make_decoder(), []

        def engine() -> Callable:
            if make_engine is None:
                raise OCRUnavailableError("a page needs OCR and no engine was given")
            if not engines:
                try:
                    engines.append(make_engine())
                except Exception as error:
                    raise OCRUnavailableError(f"the OCR engine can't be made: {error}") from error
            return engines[0]

        def page_row(page: Any, number: int) -> tuple:
            blocks, image, width, height = native_blocks(page), None, float(page.width), float(page.height)
            if not blocks or sum(c.isalnum() for b in blocks for c in b["text"]) < native_text_threshold:
                image = np.asarray(page.render(ocr_dpi), dtype=np.uint8)[..., :3]
                blocks = ocr_blocks(page, image, engine(), ocr_dpi, number)
            tables, stamp = table_boxes(page), None
            if image is not None:
                tables += raster.table_regions(image, width, height)
            if detect_stamps and (image is not None or callable(getattr(page, "render", None))):
                view = image if image is not None else np.asarray(page.render(stamp_dpi), dtype=np.uint8)[..., :3]
                stamp = raster.red_stamp(view, width, height)
                if stamp:
                    stamp["source"] = "native" if image is None else "rapidocr"
            return number, width, height, [{"pos": i, "kind": "unknown", **b} for i, b in enumerate(blocks)], tables, stamp

        for pdf in batches:
            rows = []
            for key, name, sha, content in zip(pdf["document_id"], pdf["file_name"], pdf["sha256"], pdf["content"]):
                if not content:
                    raise DocumentParseError(f"{name} is empty")
                try:
                    pages = list(decode(bytes(content)))
                except DocumentParseError:
                    raise
                except Exception as error:
                    raise DocumentParseError(f"{name} can't be opened: {error}") from error
                rows += [(key, name, sha, *page_row(page, i)) for i, page in enumerate(pages, 1)]
            yield pd.DataFrame(
                rows, columns=["document_id", "file_name", "sha256", "page", "width", "height", "blocks", "tables", "stamp"]
            )

    return documents.select("document_id", "file_name", "sha256", "content").mapInPandas(run, PAGES)


def page_blocks(pages: DataFrame) -> DataFrame:
    """S3: stamps, tables, kinds, order and ids of the pages' candidates: the canonical blocks."""
    pages = pages.repartition(*layout.PAGE)  # every operator from here on is keyed by page
    blocks = pages.select(*layout.PAGE, "width", "height", F.inline("blocks"))
    regions = pages.select(*layout.PAGE, F.posexplode("tables").alias("n", "bbox")).select(
        *layout.PAGE, (F.col("n") + 1).alias("region_no"), "bbox"
    )
    stamps = pages.where("stamp is not null").select(*layout.PAGE, "stamp.*")
    sizes = pages.select(*layout.PAGE, F.col("width").alias("_w"), F.col("height").alias("_h"), "file_name", "sha256")
    rows = layout.mark_stamps(blocks, stamps).join(sizes, layout.PAGE).withColumns(
        {"width": F.coalesce("width", "_w"), "height": F.coalesce("height", "_h")}
    ).drop("_w", "_h")
    rows = layout.reading_order(layout.classify(layout.merge_tables(rows, regions), regions))
    rows = layout.block_ids(rows, F.col("sha256"))
    text = lambda c: F.col(c).cast("string")
    several = F.col("cell_count").isNotNull()
    known = {
        "line_count": F.when(~several, text("line_count")), "ocr_dpi": F.when(~several, text("ocr_dpi")),
        "stamp_detector": F.when(
            F.col("stamp_density").isNotNull(), "rgb-red-region"
        ), "red_pixel_density": F.round("stamp_density", 4).cast("string"), "visual_only": text("visual_only"),
        "table_id": text("table_id"), "row_count": text("row_count"), "column_count": text("column_count"), "cell_count": text("cell_count"), "format": F.when(
            several, "pipe-delimited"
        ),
    }
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in known.items()]), lambda e: e["v"].isNotNull()
    )
    return rows.select(
        "document_id", "file_name", "sha256", "page", "width", "height", "block_id", "kind", "text", "bbox", "confidence",
        "source", "reading_order", F.map_from_entries(pairs).alias("metadata")
    )


def parse(
    spark: SparkSession, source, make_decoder: Callable, make_engine: Callable | None = None, file_name: str | None = None,
    **options
) -> DataFrame:
    """Canonical blocks of a path, bytes or stream. Options as in ``read_pages``."""
    return page_blocks(read_pages(documents_of(spark, source, file_name), make_decoder, make_engine, **options))
