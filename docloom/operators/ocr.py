"""Box tables of recognised pages: boxes, text assembly, tiles, variants, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import trimmed


def boxes_to_bbox(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``polygon`` (array of x, y points) replaced by whole ``x0, y0, x1, y1``; confidence to 4 places."""

    def edge(at: int, ends) -> Column:
        return ends(F.transform("polygon", lambda p: F.element_at(p, at))).cast("int")

    return boxes.select(
        *[c for c in boxes.columns if c not in ("polygon", "confidence")],
        edge(1, F.array_min).alias("x0"),
        edge(2, F.array_min).alias("y0"),
        edge(1, F.array_max).alias("x1"),
        edge(2, F.array_max).alias("y1"),
        F.bround("confidence", 4).alias("confidence"),
    )


def assemble_text(docs: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(doc_id, text, confidence, total_boxes)``: box texts by page and line, mean confidence to 4 places; none: '', 0, 0."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    made = boxes.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"),
        F.bround(F.avg("confidence"), 4).alias("confidence"),
        F.count("*").alias("total_boxes"),
    )
    joined = docs.select("doc_id").join(made, "doc_id", "left")
    return joined.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("total_boxes", F.lit(0).cast("long")).alias("total_boxes")
    )


def tile_windows(dims: DataFrame, tiles: int = 3, overlap: float = 0.05, least: int = 16) -> DataFrame:
    """``(doc_id, tile, lo, hi, vertical)``: strips along the long side, overlapping by a share of a strip."""
    side = F.greatest("height", "width")
    step = F.floor(side / tiles)
    pad = F.floor(step * overlap)
    rows = dims.select("doc_id", (F.col("height") >= F.col("width")).alias("vertical"), side.alias("side"), step.alias("step"), pad.alias("pad"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    lo = F.greatest(F.col("tile") * F.col("step") - F.col("pad"), F.lit(0))
    hi = F.when(F.col("tile") == tiles - 1, F.col("side")).otherwise(F.least((F.col("tile") + 1) * F.col("step") + F.col("pad"), F.col("side")))
    return rows.select("doc_id", "tile", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), "vertical").where(F.col("hi") - F.col("lo") >= least)


def merge_tiles(boxes: DataFrame, windows: DataFrame) -> DataFrame:
    """Tile boxes shifted by their strip's start; overlaps keep both."""
    shifted = boxes.join(windows.select("doc_id", "tile", "lo", "vertical"), ["doc_id", "tile"])
    x, y = F.when(F.col("vertical"), 0).otherwise(F.col("lo")), F.when(F.col("vertical"), F.col("lo")).otherwise(0)
    return shifted.select(
        "doc_id", "tile", "line_no", "text", "confidence", (F.col("x0") + x).alias("x0"), (F.col("y0") + y).alias("y0"), (F.col("x1") + x).alias("x1"), (F.col("y1") + y).alias("y1")
    )


def long_page_flag(height: Column, width: Column, ratio: float = 2.2, side: int = 2600) -> Column:
    big, small = F.greatest(height, width), F.greatest(F.least(height, width), F.lit(1))
    return (big / small >= ratio) | (big > side)


def weak_text_flag(text: Column, confidence: Column | None = None, total_boxes: Column | None = None) -> Column:
    weak = F.length(trimmed(F.coalesce(text, F.lit("")))) < 25
    if confidence is not None:
        weak = weak | F.coalesce(confidence < 0.35, F.lit(False))
    if total_boxes is not None:
        weak = weak | F.coalesce(total_boxes <= 4, F.lit(False))
    return weak


def pick_best_variant(variants: DataFrame) -> DataFrame:
    """Of each document's variants, in order, the last that beat the one before it: longer by a tenth, more boxes, or surer by 0.05."""
    ordered = F.array_sort(F.collect_list(F.struct("variant", "text", "confidence", "total_boxes")))
    grouped = variants.groupBy("doc_id").agg(ordered.alias("all"))

    def better(old: Column, new: Column) -> Column:
        longer = F.length(trimmed(new["text"])) > F.length(trimmed(old["text"])) * 1.1
        wins = longer | (new["total_boxes"] > old["total_boxes"]) | (new["confidence"] > old["confidence"] + 0.05)
        return F.when((trimmed(new["text"]) != "") & wins, new).otherwise(old)

    best = F.aggregate(F.slice("all", 2, F.size("all")), F.element_at("all", 1), better)
    return grouped.select("doc_id", best.alias("b")).select("doc_id", "b.*")


def strip_html(html: Column) -> Column:
    """Tags to spaces, runs of white space to one, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s{2,}", " "))


def fallback_text(docs: DataFrame, boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """``docs`` whose missing text is the plain table, else box texts and stripped tables; ``rejected`` where none is left."""
    lines = boxes.select("doc_id", F.lit(0).alias("kind"), "line_no", "text").unionByName(
        tables.select("doc_id", F.lit(1).alias("kind"), F.col("table_no").alias("line_no"), strip_html(F.col("html")).alias("text"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("kind", "line_no", "text")))
    joined = lines.where("text <> ''").groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("pieces"))
    out = docs.join(joined, "doc_id", "left")
    text = F.coalesce(F.nullif("text", F.lit("")), F.nullif("table_plain", F.lit("")), F.nullif("pieces", F.lit("")))
    return out.select("doc_id", text.alias("text"), text.isNull().alias("rejected"))
