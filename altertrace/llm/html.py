"""Main text of web pages by line-block distribution.

Markup is stripped into lines (blocks of the page). A line counts with the length of its text; navigation, forms, adverts
and the like (told by tag, class, id and role) count nothing, nor do lines that are mostly links, or in an article links only.
Sums over sliding windows of lines rise at a surge point, where text begins, and end at a dive point, where nothing more
follows within the window; the lines of text between the points are kept. An element that marks an article widens this: with a
surge point in it, all its lines of text are kept. What lies outside of it is judged by the windows as on any page.

Defined results: a null, empty or text-free page has an empty text; ids and urls may be null and repeat; rows are worked
on one by one, so ties do not arise; other columns are ignored; texts are neither cut nor capped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altertrace.llm.text import lean, small_batches

#: Fixed sets of element names: those left out with all they hold, without a line; those of them that end where a block begins;
#: those whose lines are not running text; those that end a line; those without an end tag.
SILENT = "noscript template svg math iframe object canvas select option textarea button".split()
BROKEN = "svg math select option".split()
ASIDE = "head nav header footer aside form menu dialog".split()
BLOCKS = (
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul br aside menu dialog"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words in class, id or role that mark what is not the article: wherever they stand in a name, and in names that say nothing else.
MARKS = set(
    "advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promos cookie cookies consent gdpr popup modal "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead sidebar related recommended comment comments commentlist disqus newsletter "
    "subscribe widget widgets pagination complementary contentinfo".split()
)
WEAK = set("ad ads alert header notice side aside share sharing social respond reply replies signup login search pager".split())
#: Words that say nothing about what a name marks, and words that make a name one of something around it.
PLACES = set(
    "area article bar block body bottom box button buttons card cell center col column container content entry field fixed float footer form global "
    "group head holder home icon icons inner item items label layer left line link links list main message module outer overlay page panel post primary right row "
    "secondary section site slot small space spot sticky strip tab tabs text title tools top unit wrap wrapper zone".split()
)
AROUND = set("has with without no not is hide show".split())
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTED = re.compile(r"[>\"']")
PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "iframe")}
ENDS = re.compile(rf"</({'|'.join(SILENT)})\b", re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start and end of each piece of markup, with name, whether it is an end tag, and attributes.

    Comments, declarations, scripts and styles have no name; textareas and frames with an end have the name ``-``. One pass: what is
    looked for in vain once is not looked for again. From a tag that never ends on, only tags without quotes around ``>`` count.
    """
    at, missing, plain = 0, set(), False

    def found(pattern: re.Pattern, key: str, start: int) -> int:
        """End of the next match, or -1."""
        if key in missing:
            return -1
        m = pattern.search(page, start)
        if m is None:
            missing.add(key)
            return -1
        return m.end()

    while (start := page.find("<", at)) >= 0:
        at = start + 1
        head = page[start : start + 9]
        if head.startswith("<!--") or head == "<![CDATA[":
            close = "-->" if head[2] == "-" else "]]>"
            end = page.find(close, start + (4 if head[2] == "-" else 9))
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if head[1:2] in ("!", "?"):
            if (end := page.find(">", start)) >= 0:
                at = end + 1
                yield start, at, "", False, ""
                continue
            return
        m = PLAIN.match(page, start) if plain else OPEN.match(page, start)
        if m is None:
            continue
        name, ended = m[2].lower(), m[1] == "/"
        if plain:
            end, rest = m.end(), m[3]
        else:
            end = m.end()
            while (q := QUOTED.search(page, end)) and q[0] != ">":
                end = page.find(q[0], q.end()) + 1
                if not end:
                    break
            if q is None or not end:
                plain, at = True, start  # it never ends
                continue
            end, rest = q.end(), page[m.end() : q.start()]
        at = end
        if name in RAW and not ended:
            close = found(RAW[name], name, end)
            if name in ("script", "style"):
                at = len(page) if close < 0 else close
                yield start, at, "", False, ""
                continue
            if close >= 0:
                at = close
                yield start, at, "-", False, ""
                continue
        yield start, at, name, ended, rest


def marked(names: str) -> bool:
    """Whether class, id or role say that an element is not the article. Every name counts as a whole."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[_\W\d]+", name) if w]
        if not words or AROUND & set(words):
            continue
        if MARKS & set(words) or (WEAK & set(words) and all(w in WEAK or w in PLACES for w in words)):
            return True
    return False


WINDOW = 3
#: Levels of marked elements that may hold a whole page.
LIFTS = 4
#: Characters that a window must hold where running text begins.
SURGE = 60


def lines(page: str, lifted: int = 0) -> list[tuple[str, bool, int, int, bool]]:
    """The lines of a page: text, whether it is outside of the running text, the number of its outermost article (0: none), characters in links,
    whether there are words outside of links.

    The outermost ``lifted`` levels of elements that names mark do not count as marked.
    """
    out: list[tuple[str, bool, int, int, bool]] = []
    text: list[str] = []
    bare = False
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # open elements: name, opened something silent, opened an article, marked by name, block within a broken one
    broken: list[int] = []  # places of open elements that end where a block begins
    within = 0  # blocks open inside the first of them
    silent = hushed = article = articles = titles = links = linked = named = at = 0
    ends = Counter(m[1].lower() for m in ENDS.finditer(page))  # the end tags that are still to come
    held: Counter[str] = Counter()  # open elements by name

    def close() -> None:
        nonlocal linked, bare
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((line, silent > 0, articles if article else 0, linked, bare))
            text.clear()
        linked, bare = 0, False

    def pop(n: int) -> None:
        nonlocal silent, hushed, article, titles, links, named, within
        while len(stack) > n:
            name, quiet, main, by_name, inner = stack.pop()
            held[name] -= 1
            within -= inner
            if name in BROKEN:
                broken.pop()
            silent -= quiet
            hushed -= name in SILENT
            article -= main
            named -= by_name
            titles -= name == "h1"
            links -= name == "a"

    def say(part: str) -> None:
        nonlocal linked, bare
        if part and not hushed:
            text.append(part)
            if links and not (article and titles):  # an article's title may link to itself
                linked += len(part.strip())
            else:
                bare = bare or any(map(str.isalnum, part))

    def depth_of(name: str) -> int | None:
        """The innermost open element of that name; for an inline one, if no block lies within."""
        if held[name] > 0:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    return i
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    return None
        return None

    for start, stop, name, ended, rest in tokens(page):
        say(page[at:start])
        at = stop
        if not name or name == "-":
            if name:
                text.append(" ")
            continue
        if name in BLOCKS:
            close()
        if ended:
            ends[name] -= name in SILENT
            if (depth := depth_of(name)) is not None:
                pop(depth)
            continue
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        if name == "body":
            pop(0)
        if name in BLOCKS and name != "title" and broken and not within:
            pop(broken[0])
        if name in SILENT:
            text.append(" ")
            # without an end tag of its own it holds nothing; options, select and the like end with what is around them
            if name not in BROKEN and ends[name] <= held[name]:
                continue
        marks = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(rest)) if rest else ""
        by_name = bool(marks) and name not in ("html", "body", "article", "main") and marked(marks)
        quiet = name in ASIDE or (by_name and named >= lifted) or name == "title" or bool(rest and HIDDEN.search(rest))
        main = name in ("article", "main") or "main" in marks.split()
        inner = bool(broken) and (name in BLOCKS or name == "foreignobject")
        if name in BROKEN:
            broken.append(len(stack))
        stack.append((name, quiet, main, by_name, inner))
        held[name] += 1
        within += inner
        silent += quiet
        hushed += name in SILENT
        articles += main and not article
        article += main
        named += by_name
        titles += name == "h1"
        links += name == "a"
    say(page[at:])
    close()
    return out


def window_sums(weights: np.ndarray, window: int) -> np.ndarray:
    """``sums[i]`` adds the lengths of lines i to i + window - 1."""
    n = weights.size
    total = np.concatenate([[0], np.cumsum(weights), np.full(window, weights.sum())])
    return total[window : window + n] - total[:n]


def surges(weights: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines are surge points: lines with text whose window sum reaches ``surge``."""
    return (window_sums(weights, window) >= surge) & (weights > 0)


def kept(weights: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge point and the next dive point.

    The dive point after a surge is the first line whose window sum is 0, so that no text follows within a whole window. The next
    lines of text, up to another dive point, are kept too: between them and the surge lie only lines that count nothing.
    """
    points = np.where(surges(weights, window, surge), 1, np.where(window_sums(weights, window) == 0, -1, 0))
    keep = np.zeros(weights.size, dtype=bool)
    inside = after = False
    for i, (point, weight) in enumerate(zip(points.tolist(), weights.tolist())):
        if point > 0:
            inside, after = True, False
        elif point < 0 and inside:
            inside, after = False, not after
        elif weight and after:
            inside = True
        keep[i] = inside and weight > 0
    return keep


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of one page.

    An article that holds a surge point is kept with all its lines, however short. Where nothing on a page reaches ``surge``,
    its short lines are the text. Names that mark an element decide only where text is left outside of such elements: where they hold all of
    a page, its outermost ones do not count.
    """
    for lifted in range(LIFTS):
        found = lines(page or "", lifted)
        weights = np.array([0 if quiet or (not bare if article and linked else 2 * linked > len(text)) else len(text) for text, quiet, article, linked, bare in found], dtype=np.int64)
        if weights.any() or not any(line[1] for line in found):
            break
    if not found:
        return ""
    keep = kept(weights, window, surge)
    article = np.array([line[2] for line in found])
    whole = np.unique(article[(article > 0) & surges(weights, window, surge)])
    keep |= np.isin(article, whole) & (weights > 0)
    if not keep.any():
        keep = weights > 0
    return " ".join(line[0] for line, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page; no shuffle."""
    rows = small_batches(pages).select(F.col(id_col), F.col(url_col), F.col(html_col))
    kind = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            text = [main_text(p, window, surge) for p in b.column(2).to_pylist()]
            n = pa.array([len(t) for t in text], type=pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, type=pa.string()), n], names=["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(lean(run), f"id {kind[id_col]}, url {kind[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
