"""Main text of web pages: what the markup tells, and differencing against the nearest page where it tells nothing.

A page is read as a sequence of marks. Block elements cut it into lines; a line belongs to the article if it
is inside ``article`` or ``main``, to the surroundings if it is inside a menu, header, footer, sidebar, notice,
advert, form or comments (by element, role, class or id), and is open otherwise.

Every page is differenced: it is paired with the page of the same host whose url shares the most leading path segments
with it (of these, the first or, for that page, the last in the order of paths), pages that mark an article with each other
and pages that mark none with each other. The lines of both are aligned by a longest common subsequence, and the shared
ones, the template, go; the others stay, inside an article or open. An exact check by the marks follows: lines inside an
article stay even if they are shared.

Null and empty pages give an empty text. A page without a partner keeps its open lines, or those of its article if it marks one. Very long pages are read
whole. Repeated pages are partners of each other only if nothing else is near, and only if their urls differ.
Partners are one row for each directory, so a large host is no large group.
Further columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html as _html
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardtable.llm.common import col, map_rows, map_text, saved
from wardtable.llm.urls import host_of, path_of

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object head title select button textarea canvas".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
AROUND = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: Words that mark surroundings: a token of a class or id counts if it has one of them and else only words that say
#: where or of which part ("site-footer", "comment-12"; not "social-history").
CHROME = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos banner nav navbar "
    "navigation menu menus menubar submenu breadcrumb breadcrumbs sidebar widget widgets footer header masthead cookie consent "
    "notice popup modal newsletter subscribe share sharing social related recommended comments comment disqus replies respond "
    "login signup pagination pager".split()
)
PARTS = frozenset(
    "site page main global top bottom left right side bar primary secondary box list item items link links block container "
    "wrapper wrap inner outer area slot unit button buttons icon icons form body text post posts article articles stories thread "
    "mobile desktop".split()
)
#: What also heads a section of an article: as an id inside one it is an anchor.
TOPICS = frozenset("banner cookie consent notice share sharing social related recommended promo sponsors advertising advertisement".split())
WORDS = re.compile(r"[_-]+")
MARK = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
OPEN, INSIDE, OUTSIDE = 0, 1, 2


def _marked(name: str, found: dict[str, str], around: int) -> bool:
    """Whether a class or id names surroundings. Headings' ids are anchors; a "header" in an article is the article's own."""
    for kind in ("class", "id"):
        if kind == "id" and name in HEADINGS:
            continue
        for token in found.get(kind, "").lower().split():
            words = [w for w in WORDS.split(token.replace("side-bar", "sidebar")) if w]
            said = CHROME.intersection(words)
            if around == INSIDE:
                said -= {"header"}
                if kind == "id" and len(words) == 1:
                    said -= TOPICS
            if said and all(w in CHROME or w in PARTS or w.isdigit() for w in words):
                return True
    return False


def _place(name: str, attributes: str, around: int) -> int:
    """Where an element's content belongs, given where the element is."""
    if around == OUTSIDE or name in UNSEEN:
        return OUTSIDE
    if name in AROUND and not (name == "header" and around == INSIDE):
        return OUTSIDE
    if attributes:
        found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
            return OUTSIDE
        if name not in ("body", "html") and _marked(name, found, around):
            return OUTSIDE
        if found.get("role", "").lower() in ("main", "article"):
            return INSIDE
    return INSIDE if name in ARTICLE else around


def lines_of(page: str) -> list[tuple[int, str]]:
    """The page's lines in order, with their place; white space is one space, references are decoded."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    place, at = OPEN, 0

    def close() -> None:
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                out.append((place, line))
            text.clear()

    while True:
        mark = MARK.search(page, at)
        if mark is None:
            if place != OUTSIDE:
                text.append(page[at:])
            close()
            return out
        if mark.start() > at and place != OUTSIDE:
            text.append(page[at : mark.start()])
        at = mark.end()
        name = (mark[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
        elif mark[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and _may_close(stack, depth):
                if name in BLOCKS or stack[depth][1] != place:
                    close()
                del stack[depth:]
                place = stack[-1][1] if stack else OPEN
        else:
            if name in BLOCKS:
                close()
                if stack and name in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                    _end_open(stack, name)
                    place = stack[-1][1] if stack else OPEN
            if name in VOID or mark[3].endswith("/"):
                continue
            inner = _place(name, mark[3], place)
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(page, at)
                if inner != OUTSIDE:
                    text.append(page[at : end.start() if end else len(page)])
                at = end.start() if end else len(page)
            if inner != place:
                close()
            stack.append((name, inner))
            place = inner


def _may_close(stack: list, depth: int) -> bool:
    """An end mark of an inline element doesn't reach out of the block around it."""
    return stack[depth][0] in BLOCKS or not any(n in BLOCKS for n, _ in stack[depth + 1 :])


def _end_open(stack: list, name: str) -> None:
    """Paragraphs, items and cells end where the next one begins; inline elements left open end with them."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if stack[i][0] in BLOCKS:
            return


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Numbers of the lines of ``mine`` in a longest common subsequence with ``other``.

    Matches are walked by the lines of ``mine``, each line's places in ``other`` from the last to the first, and the
    longest increasing run of places is kept: the time follows the number of matches, not of pairs.
    """
    places: dict[str, list[int]] = {}
    for j, line in enumerate(other):
        places.setdefault(line, []).append(j)
    tops: list[int] = []
    last: list[tuple] = []
    for i, line in enumerate(mine):
        for j in reversed(places.get(line, ())):
            k = bisect.bisect_left(tops, j)
            link = (i, last[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                last.append(link)
            else:
                tops[k], last[k] = j, link
    found, link = set(), last[-1] if last else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def main_text(page: str) -> str:
    """Lines of the article, of a page that marks one."""
    return "\n".join(line for where, line in lines_of(page) if where == INSIDE)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text``, ``n_shared`` and ``n_kept`` for every page.

    Every page is differenced against the nearest one. ``n_shared`` counts its lines, surroundings left out, that the other page has too,
    ``n_kept`` those of them that stay because the marks put them inside an article.
    """
    schema = "_marked boolean, _filled boolean, _head string, _packed binary"
    lines = saved(map_text(pages, html, schema, lambda: _read_pages, [key, url]), "lines")
    return by_difference(lines, key, url)


def _read_pages(pages: list[str]) -> list[tuple[bool, bool, str, bytes]]:
    """Whether a page has a line of an article, and any line; the start of its lines, and all that are not outside, packed.

    A line is headed by 1 inside an article and 0 elsewhere. Packed lines take less than half the room in the shuffle.
    """
    out = []
    for page in pages:
        found = [(where == INSIDE, line) for where, line in lines_of(page) if where != OUTSIDE]
        joined = "\n".join(f"{inside:d}{line}" for inside, line in found)
        packed = zlib.compress(joined.encode("utf-8", "surrogatepass"))
        out.append((any(inside for inside, _ in found), bool(found), joined[:64], packed))
    return out


def _unpacked(packed: bytes | None) -> list[str]:
    text = zlib.decompress(packed).decode("utf-8", "surrogatepass") if packed else ""
    return text.split("\n") if text else []


def without_template(inside: list[bool], mine: list[str], other: list[str] | None) -> tuple[str, int, int]:
    """The text of a page, given its nearest one, with the numbers of shared lines and of those the marks keep.

    The shared lines are the template and go, all others are the page's own and stay. The marks check what went: a line inside
    an article stays though it is shared. Where nothing is near to a page with an article, its marks alone tell what is its own.
    """
    template = shared_lines(mine, other or [])
    own = [i not in template for i in range(len(mine))] if other is not None or not any(inside) else inside
    kept = [own[i] or inside[i] for i in range(len(mine))]
    return "\n".join(line for i, line in enumerate(mine) if kept[i]), len(template), sum(kept[i] for i in template)


def by_difference(lines: DataFrame, key: str, url: str) -> DataFrame:
    """Texts from ``key``, ``url`` and the packed lines of pages. The nearest page is one that marks an article if the page does, else one that doesn't."""
    lines = lines.withColumns({"_host": host_of(col(url)), "_path": path_of(col(url))})
    # Directories of a page from its host down; each has a first and a last page.
    steps = F.split("_path", "/")
    directories = F.transform(
        F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n + 1), "/")
    )
    place = ["_marked", "_host", "_directory"]
    filled = lines.filter("_filled")
    held = filled.select("_marked", "_host", F.explode(directories).alias("_directory"), F.struct("_path", col(url).alias("_url")).alias("_page"))
    ends = held.groupBy(*place).agg(F.min("_page").alias("_first"), F.max("_page").alias("_last"))
    ends = saved(ends.filter(F.col("_first._url") != F.col("_last._url")), "nearest")
    # The deepest directory that has another page; its length orders directories of one path.
    own = lines.select(col(key).alias("_id"), col(url).alias("_url"), "_marked", "_host", F.explode(directories).alias("_directory"))
    deepest = own.join(ends.select(*place), place).groupBy("_id", "_url", "_marked", "_host").agg(
        F.max_by("_directory", F.length("_directory")).alias("_directory")
    )
    first = F.col("_first._url") == F.col("_url")
    paired = deepest.join(ends, place).select(
        F.col("_id").alias("_id2"), F.col("_url").alias("_url2"), F.col("_marked").alias("_marked2"),
        F.when(first, F.col("_last._url")).otherwise(F.col("_first._url")).alias("_near"), first.alias("_late"),
    )
    # Lines of the pages at the ends, the only ones that are near to any; of pages with one url the least or, at the last end, the greatest.
    named = ends.select("_marked", F.explode(F.array("_first._url", "_last._url")).alias("_near")).distinct()
    page = F.struct("_head", "_packed").alias("_page")
    other = filled.select("_marked", col(url).alias("_near"), page).join(named, ["_marked", "_near"], "left_semi")
    other = other.groupBy("_marked", "_near").agg(F.min("_page")["_packed"].alias("_least"), F.max("_page")["_packed"].alias("_most"))
    paired = paired.join(other.withColumnRenamed("_marked", "_marked2"), ["_marked2", "_near"]).select(
        "_id2", "_url2", "_marked2", F.when(F.col("_late"), F.col("_most")).otherwise(F.col("_least")).alias("_other")
    )
    same = col(key).eqNullSafe(F.col("_id2")) & col(url).eqNullSafe(F.col("_url2")) & (F.col("_marked") == F.col("_marked2"))
    joined = lines.select(col(key), col(url), "_marked", "_packed").join(paired, same, "left")

    def work(mine: list[bytes], other: list[bytes | None]) -> list[tuple[str, int, int]]:
        out = []
        for m, o in zip(mine, other, strict=True):
            own = _unpacked(m)
            near = None if o is None else [v[1:] for v in _unpacked(o)]
            out.append(without_template([v[0] == "1" for v in own], [v[1:] for v in own], near))
        return out

    out = "text string, n_shared bigint, n_kept bigint"
    return map_rows(joined, [F.col("_packed"), F.col("_other")], out, lambda: work, [key, url])


def extraction_report(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` for every page, and its numbers of shared and kept lines."""
    found = extract(pages, key, url, html).withColumn("n_chars", F.length("text").cast("bigint"))
    return found.select(col(key), col(url), "text", "n_chars", "n_shared", "n_kept")
