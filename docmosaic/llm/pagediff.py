"""HTML main text by nearest-URL page differencing.

A page's markup becomes text blocks. Elements that declare themselves as page furniture (by tag, role, class or id) are left out.
The pages of a host are sorted by URL path and each is laid beside its nearest neighbour: a longest common subsequence aligns the
lines of both, and lines that both share are deleted. A check follows: blocks inside article or main elements are the page's own by
declaration, so a passage that two articles hold stays in both. Pages without such an element that are copies of each other (more
than half of the text of both is shared) keep everything.

Pages are range-partitioned by host and path, so that a large host spreads over many tasks; the neighbours of a page are sought
inside its range. One pass over each sorted range parses each page once and holds three of them; copies that follow each other count
as one page, whose neighbours are the nearest other pages of the host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .url_rules import host_of, path_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:[^<>"']|"[^"]*"|'[^']*')*>|<[a-zA-Z/!?][^<>]*(?:>|\Z|(?=<))|[^<]+|<""", re.S | re.I)
NAME = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9:-]*)")
MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
# Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr br".split())
FURNITURE = frozenset("head nav header footer aside form button select menu dialog object canvas title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments respond disqus "
    "share sharing social related recommended newsletter subscribe signup cookie cookies consent gdpr notice notices disclaimer popup modal overlay login search copyright pagination pager toolbar skip".split()
)
OWN = frozenset(["article", "main"])
Line = tuple[str, bool]


def furniture(tag: str, token: str, by_class: bool) -> bool:
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "article", "main") or "=" not in token and "hidden" not in token:
        return False
    for name, a, b, c in MARKS.findall(token):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "hidden" and value != "false":
            return True
        if by_class and name in ("class", "id") and not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def lines(page: str | None, by_class: bool = True) -> list[Line]:
    """Text blocks in page order, each with whether an article or main element holds it. Unclosed elements end with their parents, a paragraph also with the next block."""
    out: list[Line] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    # Where the open elements of each tag, and those that aren't inline, stand in the stack: no tag ever scans it.
    opened: dict[str, list[int]] = {}
    blocks: list[int] = []
    begun = False

    def close(at: int) -> None:
        while len(stack) > at:
            opened[stack.pop()[0]].pop()
        while blocks and blocks[-1] >= at:
            blocks.pop()

    def push(x: tuple[str, bool, bool]) -> None:
        opened.setdefault(x[0], []).append(len(stack))
        if x[0] not in INLINE:
            blocks.append(len(stack))
        stack.append(x)

    def flush() -> None:
        if text:
            if s := " ".join("".join(text).split()):
                out.append((s, stack[-1][2]))
            text.clear()

    for m in TOKEN.finditer(page or ""):
        t = m.group()
        if t[0] != "<" or len(t) == 1:
            if not stack[-1][1]:
                text.append(html.unescape(t))
            continue
        if m.group(1) or t.startswith(("<!", "<?")) or not (n := NAME.match(t)):
            continue
        tag = n.group(2).lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if n.group(1):
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag == "body" and not begun:
            begun = True
            kept = [x for x in stack[1:] if x[0] != "head"]
            close(1)
            for x, skip, own in [(x, False, o) for x, _, o in kept] if kept and kept[0][0] == "html" else kept:
                push((x, skip, own))
        if tag in VOID or t.endswith("/>") and tag not in OWN:
            continue
        if tag not in INLINE:
            if blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
        push((tag, stack[-1][1] or furniture(tag, t, by_class), stack[-1][2] or tag in OWN))
    flush()
    return out


def page_lines(page: str | None) -> list[Line]:
    """lines(); where class names left nothing of a page, they don't count."""
    got = lines(page)
    if not got or not any(own for _, own in got) and re.search(r"<(?:article|main)\b", page or "", re.I):
        return lines(page, False) or got
    return got


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indexes of the lines of a in a longest common subsequence with b; rows of the table are bit sets, of lines that stand in both."""
    common = set(a) & set(b)
    at, b = [i for i, x in enumerate(a) if x in common], [x for x in b if x in common]
    a = [a[i] for i in at]
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # A zero bit j of a row: the length grows at column j. Walk back from the end.
    out, j = set(), len(b)
    for i in range(len(a) - 1, -1, -1):
        now = (j - (rows[i] & ((1 << j) - 1)).bit_count())
        before = (j - (rows[i - 1] & ((1 << j) - 1)).bit_count()) if i else 0
        if now > before:
            out.add(at[i])
            while j and (j - 1 - (rows[i] & ((1 << (j - 1)) - 1)).bit_count()) == now:
                j -= 1
            j -= 1
    return out


def main_text(own: list[Line], near: list[Line] | None) -> str:
    """The lines of a page that its neighbour doesn't share, and those that an article or main element declares as its own."""
    a, b = [s for s, _ in own], [s for s, _ in near or ()]
    gone = shared(a, b)
    if any(o for _, o in own):
        gone = {i for i in gone if not own[i][1]}
    else:
        both = sum(len(a[i]) for i in gone)
        if 2 * both > sum(map(len, a)) and 2 * both > sum(map(len, b)):
            gone = set()
    return "\n\n".join(s for i, s in enumerate(a) if i not in gone)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html).

    A null page counts as empty and has the empty text, like one that is all furniture. Pages without a host (null or strange URLs) make
    a host of their own. Repeated rows give equal rows, as copies share no furniture. Other columns are ignored.
    """
    kind, ids = dict(pages.dtypes)["page_id"], to_arrow_type(pages.schema["page_id"].dataType)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages_of() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    yield (b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py(), page_lines(b.column(4)[i].as_py()))

        def give(out: list[tuple]) -> pa.RecordBatch:
            p, u, t = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, ids), pa.array(u, pa.string()), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], ["page_id", "url", "text", "n_chars"])

        def text(before: tuple | None, page: tuple, after: tuple | None) -> str:
            near = [x for x in (before, after) if x and x[2] == page[2]]
            return main_text(page[4], max(near, key=lambda x: len(commonprefix([x[3], page[3]])))[4] if near else None)

        before = first = None  # the page before a run of copies, and the first of the run
        run: list[tuple] = []
        out: list[tuple] = []
        held = 0

        def close(after: tuple | None) -> None:
            nonlocal held
            got = text(before, first, after)
            out.extend((p, u, got) for p, u in run)
            held += len(got) * len(run)

        for page in pages_of():
            if first is not None and page[2] == first[2] and page[4] == first[4]:
                run.append(page[:2])
                continue
            if first is not None:
                close(page)
            if held > 1 << 23:
                yield give(out)
                out, held = [], 0
            before, first, run = first, page, [page[:2]]
        if first is not None:
            close(None)
        if out:
            yield give(out)

    ranges = rows.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return ranges.mapInArrow(difference, f"page_id {kind}, url string, text string, n_chars long")
