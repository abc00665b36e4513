"""Layout of one page's block candidates: kinds, reading order, block ids, region joins.

candidates: document_id, page, width, height (page), pos, text, bbox, font_size, kind, source, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["document_id", "page"]


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def overlap(a: Column, b: Column) -> Column:
    """The common area of two boxes."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def clip(a: Column, width: Column, height: Column) -> Column:
    """The box within its page; null without area."""
    x0, x1 = F.greatest(F.lit(0.0), a["x0"]), F.least(width, a["x1"])
    y0, y1 = F.greatest(F.lit(0.0), a["y0"]), F.least(height, a["y1"])
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def valid_box(a: Column) -> Column:
    return (a["x1"] >= a["x0"]) & (a["y1"] >= a["y0"])


def native_pages(blocks: DataFrame, threshold: int = 40) -> DataFrame:
    """Pages with enough letters and digits to need no OCR."""
    n = F.sum(F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}]", "")))
    return blocks.groupBy(*PAGE).agg((n >= threshold).alias("native"))


def in_region(blocks: DataFrame, regions: DataFrame, share: float = 0.35) -> DataFrame:
    """Blocks of which ``share`` of the area lies in a region of their page."""
    hit = overlap(F.col("bbox"), F.col("region")) / F.greatest(F.lit(1.0), area(F.col("bbox"))) >= share
    return blocks.join(regions.select(*PAGE, F.col("bbox").alias("region")), PAGE).where(hit).select(*blocks.columns).distinct()


def claimed(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Each block whose centre is in a region, with the first such region's number."""
    x, y = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    r = regions.select(*PAGE, "region_no", F.col("bbox").alias("region"))
    inside = x.between(F.col("region.x0"), F.col("region.x1")) & y.between(F.col("region.y0"), F.col("region.y1"))
    return blocks.join(r, PAGE).where(inside).groupBy(*PAGE, "pos").agg(F.min("region_no").alias("region_no"))


def mark_stamps(blocks: DataFrame, stamps: DataFrame, share: float = 0.2) -> DataFrame:
    """Blocks that overlap a stamp by ``share`` of the smaller area become stamps; a stamp
    that meets none becomes a block of its own. stamps may carry ``density`` and ``source``."""
    given = lambda c: F.col(c) if c in stamps.columns else F.lit(None)
    s = stamps.select(
        *PAGE, F.col("bbox").alias("stamp"), F.col("confidence").alias("stamp_confidence"),
        given("density").cast("double").alias("stamp_density"), given("source").cast("string").alias("stamp_source")
    )
    least = F.greatest(F.lit(1e-9), F.least(area(F.col("bbox")), area(F.col("stamp"))))
    pairs = blocks.join(s, PAGE).where(overlap(F.col("bbox"), F.col("stamp")) / least >= share)
    hit = pairs.select(
        *PAGE, "pos", F.lit(True).alias("stamped"), "stamp_confidence", "stamp_density"
    ).dropDuplicates([*PAGE, "pos"])
    out = blocks.join(hit, [*PAGE, "pos"], "left").withColumn(
        "kind", F.when(F.col("stamped"), "stamp").otherwise(F.col("kind"))
    ).drop("stamped")
    alone = s.join(pairs.select(*PAGE, "stamp").distinct(), [*PAGE, "stamp"], "left_anti")
    size = blocks.groupBy(*PAGE).agg(
        F.first("width").alias("width"), F.first("height").alias("height"), (F.max("pos") + 1).alias("pos")
    )
    extra = alone.join(size, PAGE, "left").select(
        *PAGE, F.lit("[red stamp]").alias("text"), F.col("stamp").alias("bbox"), F.lit("stamp").alias("kind"), F.lit(0.0).alias("font_size"), F.col("stamp_confidence").alias("confidence"),
        "stamp_confidence", "stamp_density", "width", "height", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce(
            "stamp_source", F.lit("native")
        ).alias("source"), F.lit(True).alias("visual_only"),
    )
    return out.unionByName(extra, allowMissingColumns=True)


_ROWS = "array<struct<total:double,n:int,cells:array<struct<x0:double,y0:double,pos:int,text:string>>>>"


def table_rows(cells: Column, tolerance: Column) -> Column:
    """Cells (y0, x0, pos, y1, text), in order, to rows: each joins the first row whose centre, the
    mean of its cells' so far, is within the tolerance, else begins a row."""

    def place(rows: Column, cell: Column) -> Column:
        middle = (cell["y0"] + cell["y1"]) / 2
        own = F.array(
            F.struct(cell["x0"].alias("x0"), cell["y0"].alias("y0"), cell["pos"].alias("pos"), cell["text"].alias("text"))
        )
        near = F.array_position(F.transform(rows, lambda r: F.abs(middle - r["total"] / r["n"]) <= tolerance), True)
        grown = F.transform(
            rows, lambda r,
            i: F.when(
                i + 1 == near,
                F.struct((r["total"] + middle).alias("total"), (r["n"] + 1).alias("n"), F.concat(r["cells"], own).alias("cells"))
            ).otherwise(r)
        )
        begun = F.concat(rows, F.array(F.struct(middle.alias("total"), F.lit(1).alias("n"), own.alias("cells"))))
        return F.when(near > 0, grown).otherwise(begun).cast(_ROWS)

    rows = F.aggregate(cells, F.array().cast(_ROWS), place)
    return F.array_sort(
        F.transform(rows, lambda r: F.struct((r["total"] / r["n"]).alias("centre"), F.array_sort(r["cells"]).alias("cells")))
    )


def merge_tables(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """The blocks of each table region (numbered from 1 on a page) become one block with a line
    for each row, cells parted by bars; a single block only becomes a table. Regions without
    blocks give none. Tables follow the other blocks, in their regions' order. Adds table_id,
    row_count, column_count and cell_count, null for what is no table."""
    page = Window.partitionBy(*PAGE)
    rows = blocks.withColumn("_top", F.max("pos").over(page)).join(claimed(blocks, regions), [*PAGE, "pos"], "left")
    cell = F.struct(
        F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), "pos", F.col("bbox.y1").alias("y1"), "text", "confidence",
        F.struct(*blocks.columns).alias("row")
    )
    found = rows.where("region_no is not null").groupBy(*PAGE, "region_no", "_top").agg(
        F.array_sort(F.collect_list(cell)).alias("cells")
    )  # of one region
    found = found.join(regions.select(*PAGE, "region_no", F.col("bbox").alias("region")), [*PAGE, "region_no"])
    n = F.size("cells")
    heights = F.array_sort(F.transform("cells", lambda c: c["y1"] - c["y0"]))
    found = found.withColumn("_tolerance", F.greatest(F.lit(3.0), F.get(heights, F.floor(n / 2).cast("int")) * 0.75))
    found = found.withColumn("_rows", table_rows(F.col("cells"), F.col("_tolerance")))
    text = F.array_join(F.transform("_rows", lambda r: F.array_join(F.transform(r["cells"], lambda c: c["text"]), " | ")), "\n")
    mean = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["confidence"]) / n
    whole = {"text": text, "bbox": F.col("region"), "confidence": mean, "font_size": F.lit(0.0)}
    one = F.get("cells", F.lit(0))["row"]
    values = [
        F.when(n == 1, one[c]).otherwise(
            whole[c] if c in whole else one[c]
        ).alias(c) for c in blocks.columns if c not in ("kind", "pos", *PAGE)
    ]
    several = lambda x: F.when(n > 1, x.cast("int"))
    tables = found.select(
        *PAGE, *values, F.lit("table").alias("kind"), (
            F.col("_top") + F.col("region_no")
        ).cast("int").alias("pos"), F.col("region_no").cast("int").alias("table_id"),
        several(F.size("_rows")).alias("row_count"), several(
            F.array_max(F.transform("_rows", lambda r: F.size(r["cells"])))
        ).alias("column_count"), several(n).alias("cell_count"),
    )
    return rows.where("region_no is null").select(*blocks.columns).unionByName(tables, allowMissingColumns=True)


def stamp_gate(pixels: DataFrame) -> DataFrame:
    """One box a page over its red pixels (document_id, page, x, y, r, g, b, width, height in
    pixels), unless too few, too large or too sparse."""
    red = pixels.where("r >= 145 and r - g >= 45 and r - b >= 40")
    box = red.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            f(c).alias(a) for f, c, a in (
                (F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"), (F.first, "width", "width"),
                (F.first, "height", "height")
            )
        ]
    )
    w, h, page = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1, F.col("width") * F.col("height")
    density = F.col("n") / (w * h)
    fine = (
        F.col("n") >= F.greatest(F.lit(35), F.floor(page * 0.00004))
    ) & (w >= 7) & (h >= 7) & (w <= F.col("width") * 0.48) & (h <= F.col("height") * 0.48) & (w * h <= page * 0.18) & (density >= 0.035)
    return box.where(fine).select(
        *PAGE,
        F.struct(
            F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), (F.col("x1") + 1.0).alias("x1"),
            (F.col("y1") + 1.0).alias("y1")
        ).alias("bbox"),
        F.least(F.lit(0.98), 0.65 + density * 0.5).alias("confidence")
    )


def looks_like_table(text: Column) -> Column:
    """L3b."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda v: F.trim(v)), lambda x: x != "")
    piped = F.exists(
        lines,
        lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) | (
            F.length(x) - F.length(F.replace(x, F.lit("\t"), F.lit(""))) >= 2
        )
    )
    spaced = F.size(F.filter(lines, lambda x: F.size(F.split(x, "\\s{2,}")) >= 3)) >= 2
    numeric = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit("[$£€]?\\d[\\d,.]*%?")) >= 3)) >= 2
    return piped | spaced | numeric


def classify(candidates: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """A kind for each unknown block, by the first rule that holds."""
    page = Window.partitionBy(*PAGE)
    rows = candidates
    if regions is not None:
        hit = in_region(candidates, regions).select(*PAGE, "pos", F.lit(True).alias("_region"))
        rows = rows.join(hit, [*PAGE, "pos"], "left")
    else:
        rows = rows.withColumn("_region", F.lit(False))
    first = F.min(F.when(F.trim("text") != "", F.struct("bbox.y0", "bbox.x0", "pos"))).over(page)
    rows = rows.withColumn(
        "_body", F.coalesce(F.percentile(F.when(F.col("font_size") > 0, F.col("font_size")), F.lit(0.5)).over(page), F.lit(0.0))
    ).withColumn("_first", first["pos"])
    text, font, body = _squeezed(F.col("text")), F.col("font_size"), F.col("_body")
    n, lines = F.length(text), F.size(F.split("text", "\n"))
    low = F.col("bbox.y0") >= F.col("height") * 0.86
    cue = text.rlike(
        "(?i)\\b(signature|signed by|authori[sz]ed signatory|witness|sign here)\\b"
    ) | (low & text.rlike("(?i)^(?:by|name|title|date):?\\s*(?:_{2,})?$"))
    footer = text.rlike(
        "(?i)^(?:page\\s*)?\\d+(?:\\s*(?:of|/)\\s*\\d+)?$"
    ) | text.rlike("(?i)\\b(confidential|all rights reserved)\\b") | (n <= 120)
    short = (n > 0) & (n <= 180) & (lines <= 3)
    big = lambda k: (body > 0) & (font >= body * k)
    title = short & (F.col("bbox.y0") <= F.col("height") * 0.3) & (
        big(1.65) | (
            (F.col("pos") == F.col("_first")) & (
                big(1.28) | text.rlike("(?i)\\b(agreement|contract|report|statement|proposal)\\b")
            )
        )
    )
    heading = short & (
        big(1.12) | text.rlike("^(?:\\d+(?:\\.\\d+)*|[A-Z]|[IVX]+)[.)]?\\s+\\S") | (
            (n >= 4) & (F.upper(text) == text) & text.rlike("\\p{L}")
        ) | (text.endswith(":") & (F.size(F.split(text, " ")) <= 10))
    )
    kind = (
        F.when(F.col("kind") != "unknown", F.col("kind"))
        .when(text.rlike("(?i)\\b(stamp|official seal|approved|certified)\\b") & (n <= 100), "stamp")
        .when(F.coalesce("_region", F.lit(False)) | looks_like_table(F.col("text")), "table")
        .when(cue, "signature").when(low & footer, "footer").when(title, "title").when(heading, "heading").otherwise("paragraph")
    )
    return rows.withColumn("char_count", n).withColumn("kind", kind).drop("_region", "_body", "_first")


def reading_order(blocks: DataFrame) -> DataFrame:
    """reading_order from 0 on each page: full-width anchors part the page into bands;
    a band with two clear columns is read left, middle, right; footers come last."""
    page = Window.partitionBy(*PAGE)
    box, width = F.col("bbox"), F.col("width")
    x, y = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    anchor = (F.col("kind") != "footer") & (
        ((box["x0"] <= width * 0.46) & (box["x1"] >= width * 0.54)) | (box["x1"] - box["x0"] >= width * 0.7)
    )
    rows = blocks.withColumn("_anchor", anchor).withColumn("_x", x).withColumn("_y", y)
    rows = rows.withColumn(
        "_cuts",
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("_anchor"),
                    F.struct(
                        F.col("bbox.y0").alias("a"), F.col("bbox.x0").alias("b"), F.col("pos").alias("p"), F.col("_y").alias("y")
                    )
                )
            ).over(page)
        )
    )
    no = F.sequence(F.lit(0), F.size("_cuts"))
    inside = F.filter(
        no,
        lambda i: (i == F.size("_cuts")) | (
            ((i == 0) | (F.get("_cuts", i - 1)["y"] <= F.col("_y"))) & (F.col("_y") < F.get("_cuts", i)["y"])
        )
    )
    own = F.array_position(F.transform("_cuts", lambda c: c["p"]), F.col("pos")) - 1
    rows = rows.withColumn("_band", F.when(F.col("_anchor"), own.cast("int")).otherwise(F.get(inside, F.lit(0))))
    flow = (F.col("kind") != "footer") & ~F.col("_anchor")
    band = Window.partitionBy(*PAGE, "_band")
    side = F.when(F.col("_x") < width * 0.47, 0).when(F.col("_x") > width * 0.53, 2).otherwise(1)
    rows = rows.withColumn("_side", side).withColumn("_flow", flow)
    mid = lambda s: F.percentile(F.when(F.col("_flow") & (F.col("_side") == s), F.col("_x")), F.lit(0.5)).over(band)
    columns = mid(2) - mid(0) >= width * 0.2
    rows = rows.withColumn("_side", F.when(F.col("_flow") & F.coalesce(columns, F.lit(False)), F.col("_side")).otherwise(0))
    foot = F.col("kind") == "footer"
    # footers go by x alone, in input order on ties
    order = [
        foot, F.when(foot, 0).otherwise(F.col("_band")), F.when(foot, False).otherwise(F.col("_anchor")), "_side",
        F.when(foot, 0.0).otherwise(F.col("bbox.y0")), "bbox.x0", "pos"
    ]
    return rows.withColumn(
        "reading_order", F.row_number().over(page.orderBy(*order)) - 1
    ).drop("_anchor", "_x", "_y", "_cuts", "_band", "_side", "_flow")


def block_ids(blocks: DataFrame, digest: Column) -> DataFrame:
    """The id is a hash of digest, page, order, source, box and text."""
    box = F.concat_ws(",", *[F.format_string("%.3f", F.col(f"bbox.{c}")) for c in ("x0", "y0", "x1", "y1")])
    seed = F.concat_ws("|", digest, F.col("page").cast("string"), F.col("reading_order").cast("string"), "source", box, "text")
    return blocks.withColumn(
        "block_id", F.format_string("p%04d-b%04d-%s", "page", "reading_order", F.left(F.sha2(seed, 256), F.lit(12)))
    )


def document_text(blocks: DataFrame) -> DataFrame:
    """The text of a document's blocks that aren't blank, in order."""
    rows = blocks.where(F.trim("text") != "").groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "reading_order", "text"))).alias("x")
    )
    return rows.select("document_id", F.array_join(F.transform("x", lambda b: b["text"]), "\n").alias("text"))
