"""Text a person cannot see in extracted files: tables of glyphs, runs and text boxes in, marked text out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.operators.skew import first_per_group

# Fixed values ---------------------------------------------------------------------------------
TINY_PT = 2.0
NEAR_WHITE = 0.95
CELL = 100.0  # grid cell of the containment join, in points (ours)
LINE_TOLERANCE = 0.6
COLUMN_SPREAD = 120
PAGE_ORDER = ["pdf_white_text", "pdf_tiny_text", "pdf_off_page_text"]
# End of fixed values --------------------------------------------------------------------------


def is_white(color: Column) -> Column:
    """Grey or RGB at least 95% light, or CMYK with at most 5% ink."""
    n = F.size(color)
    return F.coalesce(F.when(n.isin(1, 3), F.array_min(color) >= NEAR_WHITE).when(n == 4, F.array_max(color) <= 1 - NEAR_WHITE), F.lit(False))


def glyph_hidden_kind(glyphs: DataFrame, pages: DataFrame, rects: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Adds ``kind``: off the page, tiny, or white with no dark backdrop behind it; null when visible.

    Containment is an equi-join on grid cells: a backdrop is listed in each cell it covers, a glyph only in
    its own, so a page with many of both meets cell by cell, and a semi-join stops at the first backdrop.
    """
    dark = rects.filter(F.col("filled") & ~is_white(F.col("color"))).select("doc", "page", "x0", "x1", "top", "bottom")
    if images is not None:
        dark = dark.unionByName(images.select("doc", "page", "x0", "x1", "top", "bottom"))

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / CELL)

    covered = dark.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("top"), cell("bottom"))))
    b = covered.select("doc", "page", "cx", "cy", *[F.col(c).alias("b_" + c) for c in ("x0", "x1", "top", "bottom")])
    g = glyphs.join(pages, ["doc", "page"]).withColumn("cx", cell("x0")).withColumn("cy", cell("top"))
    off = (F.col("x1") <= F.col("left")) | (F.col("x0") >= F.col("right")) | (F.col("bottom") <= F.col("upper")) | (F.col("top") >= F.col("lower"))
    kind = F.when(off, "pdf_off_page_text").when(F.col("size") < TINY_PT, "pdf_tiny_text").when(is_white(F.col("color")), "pdf_white_text")
    g = g.withColumn("kind", kind)
    white = g.filter("kind = 'pdf_white_text'")
    inside = (F.col("b_x0") <= F.col("x0")) & (F.col("x1") <= F.col("b_x1")) & (F.col("b_top") <= F.col("top")) & (F.col("bottom") <= F.col("b_bottom"))
    on = (white["doc"] == b["doc"]) & (white["page"] == b["page"]) & (white["cx"] == b["cx"]) & (white["cy"] == b["cy"]) & inside
    shown = white.join(b, on, "left_semi").withColumn("kind", F.lit(None).cast("string"))
    unseen = white.join(b, on, "left_anti")
    rest = g.filter("kind IS NULL OR kind <> 'pdf_white_text'")
    return rest.unionByName(shown).unionByName(unseen).select(*glyphs.columns, "kind")


def page_text(glyphs: DataFrame) -> DataFrame:
    """Visible text of each page, then each hidden kind as its own block with its range. One page is one text."""
    lines = glyphs.groupBy("doc", "page", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("seq", "char"))), lambda x: x["char"]), "").alias("t"))
    w = Window.partitionBy("doc", "page").orderBy("rank")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PAGE_ORDER]), F.col("kind")), F.lit(0))
    solid = lines.withColumn("t", F.trim("t")).filter("t <> ''").withColumn("rank", rank)
    gap = F.when(F.row_number().over(w) > 1, F.lit("\n\n")).otherwise(F.lit(""))
    placed = solid.withColumn("piece", F.concat(gap, "t"))
    end = F.sum(F.char_length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("doc", "page", "kind", (end - F.char_length("t")).alias("start"), end.alias("end"), F.col("t").alias("text"))


def run_hidden_kind(hidden: Column, style_hidden: Column, size: Column, style_size: Column, rgb: Column) -> Column:
    size = F.coalesce(F.nullif(size, F.lit(0.0)), style_size)
    return F.when(F.coalesce(hidden, F.lit(False)) | F.coalesce(style_hidden, F.lit(False)), "docx_hidden_text") \
        .when(size < TINY_PT, "docx_tiny_text").when(F.array_min(rgb) >= round(255 * NEAR_WHITE), "docx_white_text")


def merge_adjacent_runs(runs: DataFrame) -> DataFrame:
    """Hidden ranges of a document's text; neighbours of one kind become one range."""
    w = Window.partitionBy("doc").orderBy("seq")
    end = F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = runs.filter("text <> ''").withColumn("end", end).withColumn("start", F.col("end") - F.char_length("text"))
    fresh = ~F.col("kind").eqNullSafe(F.lag("kind").over(w)) | (F.row_number().over(w) == 1)
    grouped = placed.withColumn("island", F.sum(fresh.cast("int")).over(w))
    return grouped.filter("kind IS NOT NULL").groupBy("doc", "island", "kind").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def ocr_reading_order(boxes: DataFrame) -> DataFrame:
    """Text lines of a page from its boxes: grouped by height on the page, then left to right.

    The running line centre depends on every box before it, so each page is folded in order by a small helper; a page is one
    image, and its boxes are few and make one row. Pages go to Python in batches, not one call each.
    """
    def lines(boxes: list[dict]) -> list[str]:
        out: list[list[dict]] = []
        centre = height = 0.0
        for b in boxes:
            for c in ("min_x", "max_x", "min_y", "max_y"):
                b[c] = math.nan if b[c] is None else b[c]
        for b in sorted(boxes, key=lambda b: (math.isnan(b["min_y"]), 0 if math.isnan(b["min_y"]) else b["min_y"], b["seq"])):
            mid, tall = (b["min_y"] + b["max_y"]) / 2, max(b["max_y"] - b["min_y"], 1)
            if out and abs(mid - centre) <= LINE_TOLERANCE * max(height, tall):
                out[-1].append(b)
            else:
                out.append([b])
            line = out[-1]
            centre = sum((x["min_y"] + x["max_y"]) / 2 for x in line) / len(line)
            height = max(max(x["max_y"] - x["min_y"], 1) for x in line)
        said = []
        for line in out:
            line.sort(key=lambda x: x["min_x"])
            words = [x["text"].strip() for x in line]
            wide = len(line) > 1 and line[-1]["min_x"] - line[0]["min_x"] > COLUMN_SPREAD
            said.append("| " + " | ".join(words) + " |" if wide else " ".join(words))
        return said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lines(b.as_py()) for b in batch.column(1)], pa.list_(pa.string()))], names=["page", "lines"])

    kept = boxes.filter(F.trim("text") != "").select(F.col("page").cast("long"), "seq", "text", "min_x", "max_x", "min_y", "max_y")
    pages = kept.groupBy("page").agg(F.collect_list(F.struct("seq", "text", "min_x", "max_x", "min_y", "max_y")).alias("boxes"))
    return pages.mapInArrow(run, "page long, lines array<string>").select("page", F.posexplode("lines").alias("line_no", "line"))


def distinct_headers(parts: DataFrame) -> DataFrame:
    """Each distinct header or footer text of a document once, at its first place."""
    tidy = parts.withColumn("text", F.trim("text")).filter("text <> ''")
    return first_per_group(tidy.select("doc", "text", "seq"), ["doc", "text"], ["seq"])
