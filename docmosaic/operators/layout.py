"""Page layout: lines to paragraphs, headings, tables, reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.shapes import area
from ..functions.text import digit_swapped
from .ranking import similar


def end_pages(sections: DataFrame, last_page: str = "total_pages") -> DataFrame:
    """A section ends on the page before the next one starts, on its own at least; the last one with the document."""
    nxt = F.lead("page_start").over(W.partitionBy("doc_id").orderBy("ord"))
    return sections.withColumn("page_end", F.when(nxt.isNull(), F.col(last_page)).otherwise(F.greatest(F.col("page_start"), nxt - 1)))


def heading_stack(blocks: DataFrame, by: list[str], order: list[str], level: str, label: str, depth: int = 3) -> DataFrame:
    """Path of the last heading of each level above a block; a heading resets the deeper levels.

    One sort and running frames: a deeper heading counts only if it came after the last shallower one.
    """
    w = W.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    b = blocks.withColumn("__i", F.row_number().over(w))
    seats = [F.last(F.when(F.col(level) == k, F.struct(F.col("__i").alias("i"), F.col(label).alias("t"))), ignorenulls=True).over(run) for k in range(1, depth + 1)]
    b = b.select(*b.columns, *(s.alias(f"__h{k}") for k, s in enumerate(seats, 1)))
    parts, floor = [], F.lit(0)
    for k in range(1, depth + 1):
        s = F.col(f"__h{k}")
        parts.append(F.when(s["i"] > floor, s["t"]))
        floor = F.greatest(floor, F.coalesce(s["i"], F.lit(0)))
    return b.withColumn("section_path", F.filter(F.array(*parts), lambda x: x.isNotNull())).drop("__i", *(f"__h{k}" for k in range(1, depth + 1)))


def grouped_by_gap(rows: DataFrame, by: list[str], order: list[str], new_group: Column) -> DataFrame:
    """W12, ST6: running group numbers from 0; new_group may look at lag columns over the same order (see previous)."""
    w = W.partitionBy(*by).orderBy(*order)
    flagged = rows.withColumn("__new", F.coalesce(new_group, F.lit(False)).cast("int"))
    return flagged.withColumn("group_no", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def previous(c: str, by: list[str], order: list[str]) -> Column:
    return F.lag(c).over(W.partitionBy(*by).orderBy(*order))


def paragraphs(lines: DataFrame, gap: float = 1.2) -> DataFrame:
    """Lines (page, y0, y1, x0) with paragraph numbers; a gap of 1.2 times the mean height of two lines starts a new one."""
    by, order = ["page"], ["y0", "x0"]
    h = (F.col("y1") - F.col("y0") + previous("y1", by, order) - previous("y0", by, order)) / 2
    return grouped_by_gap(lines, by, order, F.col("y0") - previous("y1", by, order) >= gap * h)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ids by page, rounded y, rounded x."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no", F.round("y0", 3), F.round("x0", 3)))
    return blocks.withColumn("ord", n).withColumn("block_id", F.format_string("%s:b%04d", F.col("doc_id").cast("string"), F.col("ord")))


def level_thresholds(heights: DataFrame, by: str, h: str, spread: float = 0.15, levels: int = 3) -> DataFrame:
    """Per group the heading sizes: heights descending, each within 15 % of the first of its cluster, three clusters at most.

    Only distinct rounded heights of a group meet in its task; a later height depends on the clusters before it.
    """
    d = heights.select(by, F.round(h, 4).alias("h")).distinct().groupBy(by).agg(F.sort_array(F.collect_list("h"), False).alias("hs"))
    start = F.array().cast("array<double>")
    return d.select(by, F.slice(F.aggregate("hs", start, lambda acc, x: F.when((F.size(acc) == 0) | (x < F.element_at(acc, -1) * (1 - spread)), F.concat(acc, F.array(x))).otherwise(acc)), 1, levels).alias("thresholds"))


def level_of(h: Column, thresholds: Column, spread: float = 0.15) -> Column:
    """The first level whose height is reached within 15 %; the last one below that."""
    at = F.array_position(F.transform(thresholds, lambda t: h >= t * (1 - spread)), True)
    return F.when(at > 0, at).otherwise(F.size(thresholds)).cast("int")


def grid(cells: DataFrame, table: str) -> DataFrame:
    """Cells (table, row_index, column_index, text) as rows of texts; texts of one cell joined, empty ones filled."""
    one = cells.groupBy(table, "row_index", "column_index").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    g = one.groupBy(table).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "row_index", "column_index").alias("k"), F.col("text").alias("v")))).alias("m"), F.max("row_index").alias("r"), F.max("column_index").alias("c"))
    at = lambda i, j: F.coalesce(F.element_at("m", F.concat_ws(",", i, j)), F.lit(""))
    return g.select(table, F.transform(F.sequence(F.lit(0), F.col("r")), lambda i: F.transform(F.sequence(F.lit(0), F.col("c")), lambda j: at(i, j))).alias("rows"))


def recovered_rows(lines: DataFrame, table: str, gap: float = 0.6) -> DataFrame:
    """Lines of a table (y, x, h, text) in rows by a running mean of y, columns by greedy centres of x; one table per task, its lines in memory."""
    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        rows, mean, n = [], None, 0
        tall = float(pdf["h"].median())
        row = -1
        for y in pdf["y"]:
            if mean is None or abs(y - mean) > gap * tall:
                row, mean, n = row + 1, y, 1
            else:
                mean, n = (mean * n + y) / (n + 1), n + 1
            rows.append(row)
        pdf["row_index"] = rows
        centres: list[float] = []
        for x in sorted(pdf["x"]):
            if not centres or x - centres[-1] > gap * tall:
                centres.append(x)
        pdf["column_index"] = [min(range(len(centres)), key=lambda k: (abs(centres[k] - x), k)) for x in pdf["x"]]
        return pdf

    schema = lines.withColumn("row_index", F.lit(0).cast("long")).withColumn("column_index", F.lit(0).cast("long")).schema
    return lines.groupBy(table).applyInPandas(cluster, schema)


def outside(paragraph: DataFrame, boxes: DataFrame) -> DataFrame:
    """Paragraphs whose centre lies in no table box of their page. Equi-join on the page."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    b = boxes.select(F.col("page").alias("b_page"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    return paragraph.join(b, (F.col("page") == F.col("b_page")) & (x >= F.col("b_x0")) & (x <= F.col("b_x1")) & (y >= F.col("b_y0")) & (y <= F.col("b_y1")), "left_anti")


def line_kinds(lines: DataFrame, ratio: float = 1.4, longest: int = 120) -> DataFrame:
    """G7, AG26: headings are short and at least 1.4 times the page's median height."""
    m = lines.groupBy("page").agg(F.median(F.col("y1") - F.col("y0")).alias("median"))
    return lines.join(m, "page").withColumn("kind", F.when((F.col("y1") - F.col("y0") >= ratio * F.col("median")) & (F.length("text") <= longest), "heading").otherwise("paragraph")).drop("median")


def confident(lines: DataFrame, least: float = 0.30) -> DataFrame:
    """Lines read with some confidence that aren't empty."""
    return lines.where((F.col("score") >= least) & (F.trim("text") != ""))


def corrected(lines: DataFrame, corrections: DataFrame, missed: DataFrame) -> DataFrame:
    """Lines (line_id, text, x0..y1) with corrections (line_id, fixed) and missed lines (after_id, text) between; a missed one that is a near duplicate of a neighbour (F23) is dropped, its box is the gap."""
    a = lines.join(corrections, "line_id", "left").select("page", F.col("line_id").cast("double").alias("ord"), F.coalesce("fixed", "text").alias("text"), "x0", "y0", "x1", "y1", F.lit(False).alias("added"))
    m = missed.select("page", (F.col("after_id") + 0.5).alias("ord"), "text", *(F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(True).alias("added"))
    w = W.partitionBy("page").orderBy("ord")
    u = a.unionByName(m)
    gaps = {"x0": F.least(F.lag("x0").over(w), F.lead("x0").over(w)), "y0": F.lag("y1").over(w), "x1": F.greatest(F.lag("x1").over(w), F.lead("x1").over(w)), "y1": F.lead("y0").over(w)}
    u = u.select("page", "ord", "text", "added", F.lag("text").over(w).alias("__before"), F.lead("text").over(w).alias("__after"), *(F.coalesce(F.col(c), g).alias(c) for c, g in gaps.items()))
    own, more = u.where(~F.col("added")), u.where("added")
    repeats = near_duplicate(F.col("text"), F.col("__before")) | near_duplicate(F.col("text"), F.col("__after"))
    return own.unionByName(more.where(~repeats)).drop("__before", "__after")


def letters(c: Column) -> Column:
    """Lower-cased letters and digits of a text."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def runs_kept(a: str, b: str) -> int:
    """Letters of a in runs of two and more that b has too, in order: the longest common run (the first of several), then the same left and right of it."""
    kept, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        size, at, to, ends = 0, 0, 0, {}
        places: dict[str, list[int]] = {}
        for j in range(b0, b1):
            places.setdefault(b[j], []).append(j)
        for i in range(a0, a1):
            now = {}
            for j in places.get(a[i], ()):
                n = now[j] = ends.get(j - 1, 0) + 1
                if n > size:
                    size, at, to = n, i - n + 1, j - n + 1
            ends = now
        if size > 1:
            kept += size
            todo += [(a0, at, b0, to), (at + size, a1, to + size, b1)]
    return kept


def content_preserved(raw: Column, proposed: Column) -> Column:
    """share of the raw letters and digits that stay as runs of two and more in the proposal, in order; 1 for none."""

    @F.pandas_udf("double")
    def share(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([runs_kept(x, y) / len(x) if x else 1.0 for x, y in zip(p, q, strict=True)], dtype=float)

    return share(letters(raw), letters(proposed))


def near_duplicate(a: Column, b: Column, least: float = 0.85) -> Column:
    """two lines of about the same letters and digits."""

    @F.pandas_udf("double")
    def likeness(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) if x and y else 0.0 for x, y in zip(p, q, strict=True)], dtype=float)

    return likeness(letters(a), letters(b)) >= least


def judged_corrections(lines: DataFrame, guard: float = 0.90, longest_free: int = 5, preserved: float = 0.50) -> DataFrame:
    """lines (raw, proposed, score) with rejected: a digit swapped in a line read with confidence (guard), or a line of longest_free and more letters that keeps less than preserved of them."""

    swap = (F.col("score") >= guard) & digit_swapped(F.col("raw"), F.col("proposed"))
    lost = (F.length(letters(F.col("raw"))) >= longest_free) & (content_preserved(F.col("raw"), F.col("proposed")) < preserved)
    return lines.withColumn("rejected", swap | lost)


def assembled(lines: DataFrame, claims: DataFrame, fallback: str = "paragraph") -> DataFrame:
    """Block texts: the first block that claims a line (block, kind, line_id) gets it, lines without a block make their own."""
    first = claims.groupBy("line_id").agg(F.min(F.struct("block", "kind")).alias("c"))
    j = lines.join(first, "line_id", "left").withColumn("block", F.coalesce(F.col("c.block"), -F.col("line_id") - 1)).withColumn("kind", F.coalesce("c.kind", F.lit(fallback)))
    return j.groupBy("block", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), " ").alias("text"))


def page_assets(blocks: DataFrame, least: float = 0.25) -> DataFrame:
    """Pages that figures fill to a quarter, titled by their first heading, else caption, else a default. blocks: doc_id, page_no, kind, text, bbox, ord."""
    g = blocks.groupBy("doc_id", "page_no").agg(
        F.sum(F.when(F.col("kind") == "figure", area(F.col("bbox"))).otherwise(0.0)).alias("share"),
        F.min_by("text", F.when(F.col("kind") == "heading", F.col("ord"))).alias("head"),
        F.min_by("text", F.when(F.col("kind") == "caption", F.col("ord"))).alias("caption"),
    )
    return g.where(F.col("share") >= least).select("doc_id", "page_no", F.coalesce("head", "caption", F.concat(F.lit("Figure page "), F.col("page_no"))).alias("title"))


def reanchored(old: DataFrame, new: DataFrame, keys: list[str], c: str) -> DataFrame:
    """How many anchors changed and how many were dropped by a new reading."""
    j = old.select(*keys, F.col(c).alias("a")).join(new.select(*keys, F.col(c).alias("b"), F.lit(True).alias("here")), keys, "left")
    return j.agg(F.count_if(F.col("here") & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if(F.col("here").isNull()).alias("dropped"))


def page_slices(docs: DataFrame) -> DataFrame:
    """Page text by (offset, length) spans of a document's markdown. docs: doc_id, markdown, pages (page_no, spans)."""
    e = docs.select("doc_id", "markdown", F.explode("pages").alias("p"))
    cut = F.array_join(F.transform("p.spans", lambda s: F.substring(F.col("markdown"), s["offset"] + 1, s["length"])), "")
    return e.select("doc_id", F.col("p.page_no").alias("page_no"), cut.alias("text"))
