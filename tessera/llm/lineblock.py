"""HTML main-text extraction by line-block distribution.

Markup is stripped into lines, one for each block of the page.  Each line has a text
length; lines of boilerplate containers (menus, forms, adverts, comments ...) and lines
that are mostly links count as 0 and are left out.  The lengths of the others are summed
over a sliding window of ``window`` lines.  A stretch of text begins at a surge point,
where the sums rise over a share of their peak, and ends at a dive point, where they
fall below it.  The heaviest stretch chooses the element that holds the main text, on
pages with article and main elements too, and that element's lines are kept whole: a
short heading or lead before the surge point, and what follows an advert within the text.

So the surge and dive points choose among the elements of a page and, where the text
lies in no element of its own, its ends; both are returned with the text.

One narrow pass over the rows; a page needs memory for its own lines only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map, steps

WINDOW = 3
SURGE = 0.05  # share of the peak at which a stretch counts as text
HOLDS = 0.9  # share of the stretch that its container holds

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe|object|title)\b[^>]*(?:\"[^\"]*\"[^>]*)*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_MAIN = ("article", "main")
_CONTAINER = frozenset("html body article main section div td center".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NOISE_TAG = frozenset("nav header footer aside form button menu head fieldset dialog label option".split())
_NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|header|footer|foot|sidebar\w*|side|widget\w*|comments?|comment\w*|disqus|respond|reply|replies|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|tags|toolbar|copyright|legal|disclaimer|form|search|skip)(?:$|[\s_-])",
    re.I,
)
_OWN_HEADER = re.compile(r"post|article|entry|content|story", re.I)
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: The end of each of these is implied by the next of the set it names.
_CLOSES = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _is_noise(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in _NOISE_TAG and not (tag == "header" and inside_main):
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id") and (found := _NOISE_NAME.search(value)):
                if found[0].strip(" _-").lower() != "header" or not (inside_main or _OWN_HEADER.search(value)):
                    return True
            if key == "role" and value.lower() in _NOISE_ROLE or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, int, tuple]]:
    """The page's lines in order: text, its length (0 for boilerplate), the containers around it (number, tag)."""
    out: list[tuple[str, int, tuple]] = []
    stack: list[tuple[str, bool, bool, tuple]] = []  # tag, noise within, main within, containers
    parts: list[str] = []
    linked = in_link = opened = 0
    noise = main = False
    around: tuple = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                weight = 0 if noise or (linked >= 0.8 * len(text) and not main) else len(text)
                out.append((text, weight, around))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)

    def shut(index: int) -> None:
        nonlocal noise, main, around
        del stack[index:]
        noise, main, around = stack[-1][1:] if stack else (False, False, ())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1] and m[1].lower() in ("textarea", "select", "iframe"):
                add(" ")
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "br":
            add("\n")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif closing:
            if tag in _BLOCK or tag in _NOISE_TAG:
                flush()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0:
                shut(k)
        elif tag in _VOID:
            if tag == "hr":
                flush()
        elif not m[4].endswith("/") or tag in _BLOCK:
            block = tag in _BLOCK
            noisy = noise or _is_noise(tag, m[4], main)
            if block or noisy != noise:
                flush()
            if block:
                in_link = 0
                k = len(stack) - 1
                while k >= 0 and (stack[k][0] not in _BLOCK or tag in _CLOSES.get(stack[k][0], ())):
                    if tag in _CLOSES.get(stack[k][0], ()):
                        shut(k)
                        break
                    k -= 1
                noisy = noise or _is_noise(tag, m[4], main)
            if block or noisy != noise or tag in ("b", "span", "button", "label"):
                opened += 1
                stack.append((tag, noisy, main or tag in _MAIN, (*around, (opened, tag)) if tag in _CONTAINER else around))
                noise, main, around = stack[-1][1:]
    add(page[at:])
    flush()
    return out


def stretch_of(lengths: list[int], window: int = WINDOW, surge: float = SURGE) -> tuple[int, int]:
    """[surge point, dive point) of the heaviest stretch of lines; of equal ones the first."""
    sums = [sum(lengths[k : k + window]) for k in range(len(lengths))]
    level, best, found, k = surge * max(sums, default=0), 0, (0, len(lengths)), 0
    while k < len(lengths):
        first = k
        while k < len(lengths) and sums[k] > level:
            k += 1
        if (mass := sum(lengths[first:k])) > best:
            best, found = mass, (first, k)
        k = max(k, first + 1)
    return found


def main_lines(lines: list[tuple[str, int, tuple]], window: int = WINDOW, surge: float = SURGE) -> tuple[list[str], int, int]:
    """The lines of the heaviest stretch, from its surge to its dive point, and of its
    container; zeroed ones are left out.  Also the numbers of the surge and the dive line (-1: none).

    The container is the innermost article or main element that holds over half of the
    stretch, else the innermost element that holds ``HOLDS`` of it; the text has the
    container's ends then.  Of the page's body only the lines that lie in no other
    container are added to the stretch.
    """
    at = [i for i, line in enumerate(lines) if line[1]]
    if not at:
        return [], -1, -1
    first, last = stretch_of([lines[i][1] for i in at], window, surge)
    stretch = at[first:last]
    best = sum(lines[i][1] for i in stretch)
    held: dict[tuple, list[int]] = {}
    for i in stretch:
        for element in lines[i][2]:
            held.setdefault(element, []).append(lines[i][1])
    marked = [e for e, n in held.items() if e[1] in _MAIN and 2 * sum(n) > best]
    others = [e for e, n in held.items() if len(n) > 1 and sum(n) >= HOLDS * best]
    container = max(marked or others, default=None)
    if container and container[1] not in ("html", "body"):
        kept = [lines[i][0] for i in at if container in lines[i][2]]
    else:
        within = set(stretch)
        kept = [lines[i][0] for i in at if i in within or lines[i][2][-1:] == ((container,) if container else ())]
    return kept, stretch[0], stretch[-1]


def extract_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    return "\n\n".join(main_lines(lines_of(page), window, surge)[0]) if page else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """The main text of every page: ``id_col``, ``url_col``, text, n_chars (code points),
    and surge_line, dive_line: the page's lines where the heaviest stretch begins and ends.

    Null, empty and text-free html gives an empty text, 0 and lines -1.  Very long pages
    are read whole; of equally heavy stretches the first counts.  Repeated rows give
    repeated results, an empty table none; other columns, whatever their names, are not read.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                found = [main_lines(lines_of(x or ""), window, surge) for x in part.column("html").to_pylist()]
                texts = ["\n\n".join(x[0]) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), *(pa.array([x[k] for x in found], pa.int32()) for k in (1, 2))], names=["id", "url", "text", "n_chars", "surge", "dive"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    out = arrow_map(rows, run, f"id {types[id_col]}, url {types[url_col]}, text string, n_chars long, surge int, dive int")
    return out.toDF(id_col, url_col, "text", "n_chars", "surge_line", "dive_line")
