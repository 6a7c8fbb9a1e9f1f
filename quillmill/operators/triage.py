"""Page selection, routing and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_CHARS, EVERY_PAGE, MIN_FIGURE, MIN_EDGE, MIN_PICTURE = 120, 10**9, 60.0, 2.0, 48


def parse_pages(specs: DataFrame) -> DataFrame:
    """Rows of (key, spec, total) to (key, page), 1-based: `1,5,9-12`; no spec means all pages,
    what lies outside is dropped, a reversed range is empty, and other text is an error."""
    chunk = F.explode(F.split(F.when(F.trim(F.coalesce("spec", F.lit(""))) == "", F.concat(F.lit("1-"), F.col("total").cast("string"))).otherwise(F.col("spec")), ","))
    parts = specs.select("key", "total", chunk.alias("chunk")).withColumn("chunk", F.trim("chunk")).filter("chunk != ''")
    first = F.trim(F.element_at(F.split("chunk", "-", 2), 1)).cast("int")
    last = F.trim(F.element_at(F.split("chunk", "-", 2), -1)).cast("int")
    low, high = F.greatest(first, F.lit(1)), F.least(last, F.col("total"))
    pages = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return parts.select("key", F.explode(pages).alias("page")).distinct()


def small_images(images: DataFrame, keys: list[str], min_pt: float = MIN_FIGURE) -> DataFrame:
    """keys and n_small: images too small for figures, such as equations."""
    edge = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return images.filter((edge >= MIN_EDGE) & (edge < min_pt)).groupBy(*keys).agg(F.count("*").alias("n_small"))


def figures(images: DataFrame, keys: list[str], min_pt: float = MIN_FIGURE) -> DataFrame:
    """keys and n_figures: distinct images of at least min_pt in both directions."""
    big = (F.col("x1") - F.col("x0") >= min_pt) & (F.col("y1") - F.col("y0") >= min_pt)
    return images.filter(big).select(*keys, "xref").distinct().groupBy(*keys).agg(F.count("*").alias("n_figures"))


def figure_regions(images: DataFrame, keys: list[str], min_pt: float = MIN_FIGURE) -> DataFrame:
    """keys, xref, rectangle and figure (its number in reading order) of each figure. Every place of an
    image counts; a cluster of drawings (xref null) counts if it meets no image and no cluster above it
    that counts. The figures of one page, which a page bounds, are folded in the row."""
    box = F.struct("y0", "x0", "y1", "x1", "xref")
    big = images.filter((F.col("x1") - F.col("x0") >= min_pt) & (F.col("y1") - F.col("y0") >= min_pt))
    pages = big.groupBy(*keys).agg(F.collect_set(F.when(F.col("xref").isNotNull(), box)).alias("_p"), F.array_sort(F.collect_set(F.when(F.col("xref").isNull(), box))).alias("_c"))
    meets = lambda a, b: (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    grown = F.aggregate("_c", F.col("_p"), lambda have, c: F.when(F.exists(have, lambda h: meets(h, c)), have).otherwise(F.concat(have, F.array(c))))
    placed = F.array_sort(F.transform(grown, lambda r: F.struct(F.bround(r["y0"], 1).alias("top"), F.bround(r["x0"], 1).alias("left"), r.alias("r"))))
    rows = pages.select(*keys, F.posexplode(placed).alias("at", "f"))
    return rows.select(*keys, *(F.col(f"f.r.{c}") for c in ("xref", "x0", "y0", "x1", "y1")), (F.col("at") + 1).alias("figure"))


def holds_large_image(images: DataFrame, keys: list[str], min_pt: float = MIN_FIGURE) -> DataFrame:
    """keys and image: whether any image of a page is large enough to be a figure."""
    return images.groupBy(*keys).agg(F.bool_or((F.col("x1") - F.col("x0") >= min_pt) & (F.col("y1") - F.col("y0") >= min_pt)).alias("image"))


def picture_worth_asking(width: Column, height: Column, least: int = MIN_PICTURE) -> Column:
    """Whether an Office picture is sent to the model; a smaller one is kept as it is."""
    return F.least(width, height) >= least


def text_above(blocks: Column, y: Column) -> Column:
    """Whether a paragraph among a page's blocks (bottom, text) ends above y, a heading's place; true
    where the place is unknown."""
    return y.isNull() | F.exists(blocks, lambda b: (b["bottom"] <= y - 2) & (F.length(F.trim(b["text"])) >= 40))


def page_class(solid: Column, n_small: Column, min_chars: int = MIN_CHARS) -> Column:
    return F.when(solid < min_chars, "scanned").when(F.coalesce(n_small, F.lit(0)) > 0, "equations").otherwise("text")


def route(page_class: Column, n_figures: Column, vision: bool = True, ignore_small: bool = False) -> Column:
    """How a page is read: as a whole page, as text with its figures, or as text."""
    whole = (page_class == "scanned") | (page_class == "equations") & F.lit(not ignore_small)
    return F.when(whole & F.lit(vision), "whole page").when((F.coalesce(n_figures, F.lit(0)) > 0) & F.lit(vision), "text and figures").otherwise("text")


def inspect(pages: DataFrame, key: str) -> DataFrame:
    """Totals of a document from rows of (key, page_no, page_class, n_figures)."""
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col("page_class") == c, F.col("page_no"))))
    on_text = F.sum(F.when(F.col("page_class") == "text", F.coalesce("n_figures", F.lit(0))).otherwise(0))
    return pages.groupBy(key).agg(F.count("*").alias("pages"), listed("scanned").alias("scanned"), listed("equations").alias("equations"), on_text.alias("figures"))


def request_estimate(pages: Column, whole: Column, figures: Column, chosen_whole: Column, chosen_text: Column) -> Column:
    """Requests that the chosen pages need: one per whole page, and their share of the figures."""
    share = figures * chosen_text / F.greatest(F.lit(1), pages - whole)
    return chosen_whole + F.bround(share, 0).cast("long")


def outline_ranges(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, title, first and last page of each section; outline: doc_id, ord, level, title,
    start, text_above; pages: doc_id, n_pages. A section ends where the next of its level or above
    begins: on that page if text stands above its heading, on the one before otherwise."""
    later = outline.select(F.col("doc_id").alias("d"), F.col("ord").alias("o"), F.col("level").alias("l"), F.col("start").alias("s"), F.col("text_above").alias("t"))
    j = outline.join(later, (F.col("doc_id") == F.col("d")) & (F.col("o") > F.col("ord")) & (F.col("l") <= F.col("level")), "left")
    nxt = j.groupBy("doc_id", "ord", "level", "title", "start").agg(F.min(F.struct("o", "s", "t")).alias("n"))
    end = F.when(F.col("n.o").isNull(), F.col("n_pages")).when(F.col("n.t"), F.col("n.s")).otherwise(F.col("n.s") - 1)
    return nxt.join(pages, "doc_id").select("doc_id", "ord", "level", "title", F.col("start").alias("first"), F.greatest("start", end).alias("last"))
