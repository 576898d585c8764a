"""Arrays, JSON, grids and page geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECTS = "array<struct<page_no:int,bbox:array<double>>>"


def parse_rects(c: Column) -> Column:
    """A1, A2: rectangles of a JSON text that have a box; null where there is none or the text is broken."""
    r = F.filter(F.from_json(c, RECTS), lambda x: x["bbox"].isNotNull())
    return F.when(F.size(r) > 0, r)


def rect_key(r: Column) -> Column:
    """A3: page and box at 4 decimals."""
    return F.concat_ws(":", r["page_no"].cast("string"), F.array_join(F.transform(r["bbox"], lambda x: F.format_string("%.4f", x)), ","))


def has_rects(c: Column) -> Column:
    """PF16: a highlight payload that isn't empty."""
    return F.coalesce(~F.trim(c).isin("", "[]", "null", "{}"), F.lit(False))


def added_values(added: Column) -> Column:
    """A4: reviewer-added values in the shape of extracted ones."""
    return F.transform(F.filter(added, lambda a: F.trim(a["value"]) != ""), lambda a: F.struct(F.trim(a["value"]).alias("value"), a["snippet"].alias("snippet"), a["page"].alias("page"), F.lit(True).alias("has_evidence")))


def states_a_value(values: Column) -> Column:
    """PF17, PF18: an array that holds a value other than empty and "Not Stated"."""
    return F.coalesce(F.exists(values, lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "not stated")), F.lit(False))


def regions(rects: Column, page: Column, bbox: Column) -> Column:
    """A5: rectangles, or the envelope where there are none."""
    return F.coalesce(F.when(F.size(rects) > 0, rects), F.when(bbox.isNotNull(), F.array(F.struct(page.cast("int").alias("page_no"), bbox.alias("bbox")))))


def render_row(cells: Column) -> Column:
    """One row of a pipe table."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def render_grid(rows: Column) -> Column:
    """A grid (array of rows, the first one the header) as a pipe table; short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    full = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(full, render_row)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def flat_grid(rows: Column) -> Column:
    """A8: "header: value; ..." over all body rows."""
    head = F.element_at(rows, 1)
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.array_join(F.flatten(F.transform(body, lambda r: F.filter(F.zip_with(head, r, lambda h, v: F.concat_ws(": ", h, v)), lambda s: s.isNotNull()))), "; ")


def grid_needs_repair(rows: Column, gate: float = 0.5) -> Column:
    """PF24: no grid, or at least gate of its cells empty."""
    cells = F.flatten(rows)
    return F.coalesce((F.size(cells) <= 0) | (F.size(F.filter(cells, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")) >= gate * F.size(cells)), F.lit(True))


def bbox_of(polygon: Column) -> Column:
    """G1: [x0, y0, x1, y1] around a polygon of [x, y] points."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def scaled_bbox(b: Column, w: Column, h: Column, clamp: bool = False) -> Column:
    """Pixels to page shares; G3 with clamp: held in 0..1, and zeros for a page without size."""
    sides = [b[0] / F.nullif(w, F.lit(0.0)), b[1] / F.nullif(h, F.lit(0.0)), b[2] / F.nullif(w, F.lit(0.0)), b[3] / F.nullif(h, F.lit(0.0))]
    return F.array(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(s, F.lit(0.0)))) if clamp else s for s in sides))


def source_regions(c: Column) -> Column:
    """(page, points) of every well-formed D(page,x,y,...) in a source text."""
    part = r"D\((\d+(?:,-?\d+(?:\.\d+)?){2,})\)"
    lists = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(part), F.lit(1)), lambda s: F.transform(F.split(s, ","), lambda x: x.cast("double")))
    made = F.transform(F.filter(lists, lambda a: F.size(a) % 2 == 1), lambda a: F.struct(a[0].cast("int").alias("page_no"), F.transform(F.sequence(F.lit(1), F.size(a) - 1, F.lit(2)), lambda i: F.array(F.get(a, i), F.get(a, i + 1))).alias("polygon")))
    return made


def center_in(b: Column, boxes: Column) -> Column:
    """Whether a box's centre lies in any of boxes."""
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return F.exists(boxes, lambda k: (x >= k[0]) & (x <= k[2]) & (y >= k[1]) & (y <= k[3]))


def margin_number(c: Column, b: Column) -> Column:
    """PF23: a bare number of up to three digits in the top or bottom 7 % of a page."""
    return F.trim(c).rlike(r"^\d{1,3}$") & ((b[3] <= 0.07) | (b[1] >= 0.93))


def embeddable(kind: Column, c: Column) -> Column:
    """PF14: neither header nor footer, at least 20 characters and 4 words."""
    t = F.trim(c)
    return ~kind.isin("header", "footer") & (F.length(t) >= 20) & (F.size(F.split(t, r"\s+")) >= 4)


def substantive(c: Column) -> Column:
    """PF15: a digit or at least 15 characters."""
    return c.rlike("[0-9]") | (F.length(F.trim(c)) >= 15)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def bbox_or_null(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box whose edges are all known."""
    return F.when(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull(), F.array(x0, y0, x1, y1))
