"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line counts with the length of its text, or with
nothing when it stands in a menu, header, footer, sidebar, notice, advert, form or among reader comments, or, outside
an article element, is mostly links. A part known by its class or id alone, or a form, must not hold most of the page's
text or its largest article. The lengths are summed over sliding windows of lines. Text surges where a
window's sum leaves zero and dives where it comes back to zero; the counting lines of a region between a surge and a
dive are kept when its sums reach the threshold. Regions in article or main elements are compared with those beside
them: while the highest window in them, times a weight, is not exceeded outside, they are the text, whole and whatever
their height. Otherwise the threshold holds for all regions alike. The weight is low if there are several such elements,
since these may be teasers.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

from cohortlens.llm.common import map_columns

WINDOW = 3
MIN_SURGE = 80
#: How much more a window counts in the only article of a page, and in one of several.
ARTICLE_WEIGHT = 16
ARTICLES_WEIGHT = 2

# Element names of HTML by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe svg math object select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside button menu dialog header".split())
FORMS = frozenset("form fieldset label".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
                   "th thead tr ul".split())
CLOSED_BY_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("html body article main section div table td th ul ol dl aside nav footer header form blockquote figure details dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WORDS = (r"(?:ads?|advert[a-z]*|adsense|banner|sponsor[a-z]*|promo[a-z]*|side-?bar|aside|nav|navbar|navigation|menu|menubar|breadcrumbs?|"
         r"footer|masthead|notices?|alerts?|cookies?|consent|gdpr|popup|modal|newsletter|subscri[a-z]+|signup|login|share|sharing|"
         r"social|related|recommend[a-z]*|comments?|commentlist|disqus|respond|replies|feedback|pagination|pager|toolbar|topbar|widgets?|skip)")
PLACES = (r"(?:site|page|post|entry|main|global|top|bottom|left|right|primary|secondary|area|section|list|box|container|wrapper|wrap|block|"
          r"bar|links?|buttons?|icons?|items?|inner|group|panel|slot|thread|message|[0-9]+)")
#: A whole class or id of such words: "has-sidebar" or "post-with-comments" name a layout, not a part.
PARTS = re.compile(rf"(?:{PLACES}[_-])*{WORDS}(?:[_-](?:{WORDS}|{PLACES}))*", re.I)
#: Parts that may well be longer than the text they belong to, or hold article elements of their own.
LISTS = re.compile(r"comment|disqus|respond|replies|feedback|related|recommend", re.I)
PAGE_HEADERS = re.compile(r"(?:^|\s)(?:(?:site|top|global)[_-]?)?header(?=$|\s)", re.I)

TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|"
                   r"<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


SURE, LIKELY, LIST = 3, 2, 1


def boilerplate(name: str, attrs: str, inside: bool) -> int:
    """SURE if an element holds no main text, LIKELY or LIST if its name says so, else 0; an article's own header does hold text."""
    if name in BOILERPLATE and not (name == "header" and inside):
        return SURE
    found = LIKELY if name in FORMS else 0
    for key, a, b, c in ATTRIBUTE.findall(attrs) if attrs and not attrs.isspace() else ():
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURE
        if key == "role" and value.lower() == "form":
            found = found or LIKELY
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            hits = [x for x in value.split() if PARTS.fullmatch(x)]
            if any(LISTS.search(x) for x in hits):
                found = found or LIST
            elif hits or not inside and PAGE_HEADERS.search(value):
                found = found or LIKELY
    return found


def in_parts(lines: list[tuple[str, int, bool, int, int]], marks: list[tuple[int, int]], homes: list[int]) -> list[bool]:
    """Whether the text of each likely part counts as boilerplate, by what the part holds.

    A part that holds most of the page's text or its largest article is none, unless it is a list (comments, related
    pages) beside which enough text stands and whose article is not most of the page's. ``marks`` has (part around, kind)
    of each part and ``homes`` the part around each article; both are numbered from 1.
    """
    held, articles, total = [0] * (len(marks) + 1), [0] * (len(homes) + 1), 0
    for text, linked, sure, mark, article in lines:
        if not sure:
            own = max(0, len(text) - linked)
            total += own
            held[mark] += own
            articles[article] += own
    articles[0] = -1
    best = max(range(len(articles)), key=articles.__getitem__)
    for i in range(len(marks), 0, -1):
        held[marks[i - 1][0]] += held[i]
    holds, at = set(), homes[best - 1] if best else 0
    while at:
        holds.add(at)
        at = marks[at - 1][0]
    counts = [False]
    for i, (around, kind) in enumerate(marks, 1):
        whole = (2 * held[i] > total or i in holds) and (
            kind != LIST or total - held[i] < MIN_SURGE or i in holds and 2 * articles[best] > total)
        counts.append(counts[around] or not whole)
    if all(sure or counts[mark] for _, _, sure, mark, _ in lines):
        return [False] * len(counts)  # names alone do not empty a page
    return counts


def spaced(raw: str) -> str:
    return " ".join(unescape(raw).split())


def page_lines(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, in boilerplate, number of its article or 0) of each line of the page that has text.

    Text keeps the marks of all elements around it, so that a button, a hidden span or an advert's link inside a
    paragraph is left out of the paragraph's line.
    """
    lines: list[list[tuple[str, int, tuple[bool, int, int]]]] = []  # runs of text, with (surely boilerplate, likely part, article)
    runs: list[tuple[str, int, tuple[bool, int, int]]] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, surely boilerplate, likely part, article
    marks: list[tuple[int, int]] = []
    homes: list[int] = []
    opened: Counter = Counter()  # how often a name stands in the stack
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page

    def say(text: str) -> None:
        runs.append((text, len(text.strip()) if opened["a"] else 0, stack[-1][1:] if stack else (False, 0, 0)))

    def flush() -> None:
        if any(not text.isspace() for text, _, _ in runs):
            lines.append(runs.copy())
        runs.clear()

    def close(at: int) -> None:
        if any(x[0] in BLOCKS for x in stack[at:]):
            flush()
        opened.subtract(x[0] for x in stack[at:])
        del stack[at:]

    at, last = 0, html.rfind(">") + 1
    while at < len(html):
        if at >= last:  # no tag can end any more
            say(html[at:].partition("<!--")[0])
            break
        m = TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            say(m["text"])
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if stack[i][0] == name:
                        close(i)
                        break
                    if name not in SCOPES and stack[i][0] in SCOPES:
                        break  # a stray end tag does not close what stands around it
                else:
                    if name in BLOCKS:
                        flush()
                continue
            if name in ("svg", "math") and m["attrs"].endswith("/"):
                continue
            if name in RAW:
                # Raw elements end at their own end tag, or with the head or page.
                end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if not end:
                    endless.add(name)
                at = end.end() if end else (len(html) if name != "head" else at)
                say(" ")
                continue
            if name in BLOCKS:
                ends = {"p"} | CLOSED_BY_SELF.get(name, set())  # an open paragraph or item ends where the next block begins
                for i in range(len(stack) - 1, -1, -1) if any(opened[x] for x in ends) else ():
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in SCOPES:
                        break
                flush()
            elif name == "br":
                say(" ")
            if name not in VOID and not m["attrs"].endswith("/"):
                _, sure, part, article = stack[-1] if stack else ("", False, 0, 0)
                if not article and (name in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?(main|article)\b", m["attrs"], re.I)):
                    homes.append(part)
                    article = len(homes)
                kind = 0 if sure else boilerplate(name, m["attrs"], bool(article))
                if kind in (LIKELY, LIST):
                    marks.append((part, kind))
                    part = len(marks)
                stack.append((name, sure or kind == SURE, part, article))
                opened[name] += 1
    flush()
    held = []
    for line in lines:
        by_state: dict[tuple[bool, int, int], list] = {}
        for text, linked, state in line:
            by_state.setdefault(state, []).append((text, linked))
        for state, parts in by_state.items():
            if text := spaced("".join(t for t, _ in parts)):
                held.append((text, sum(n for _, n in parts), *state))
    counts = in_parts(held, marks, homes)
    out = []
    for line in lines:
        kept = [not sure and not counts[part] for _, _, (sure, part, _) in line]
        text = spaced("".join(t if k else " " for (t, _, _), k in zip(line, kept)))
        if not text:  # all of it is boilerplate
            kept, text = [True] * len(line), spaced("".join(t for t, _, _ in line))
            sure = True
        else:
            sure = False
        if text:
            first = next(state for (t, _, state), k in zip(line, kept) if k and spaced(t))
            out.append((text, sum(n for (_, n, _), k in zip(line, kept) if k), sure, first[2]))
    return out


def regions(size: list[int], window: int) -> list[tuple[int, list[int]]]:
    """(largest window sum, counting lines) of each stretch from a surge to a dive."""
    sums = [sum(size[i:i + window]) for i in range(len(size))]
    found: list[tuple[int, list[int]]] = []
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        surge = i
        while i < len(sums) and sums[i]:
            i += 1
        found.append((max(sums[surge:i]), [j for j in range(surge, i) if size[j]]))
    return found


def main_lines(lines: list[tuple[str, int, bool, int]], window: int = WINDOW, min_surge: int = MIN_SURGE,
               weight: int = ARTICLE_WEIGHT, list_weight: int = ARTICLES_WEIGHT) -> list[str]:
    """The lines between surges and dives of the page's text, in and outside its articles."""
    articles = {article for _, _, boiler, article in lines if article and not boiler}
    full = [0 if boiler else len(text) for text, _, boiler, _ in lines]
    plain = [0 if 2 * linked > len(text) else n for n, (text, linked, _, _) in zip(full, lines)]
    # The links of a single article belong to it; those of several may be headings of teasers.
    inner = [n if lines[j][3] else 0 for j, n in enumerate(full if len(articles) == 1 else plain)]
    outer = [0 if lines[j][3] else n for j, n in enumerate(plain)]
    within, beside = regions(inner, window), regions(outer, window)
    height = max((h for h, _ in within), default=0) * (weight if len(articles) == 1 else list_weight)
    top = max((h for h, _ in beside), default=0)
    if articles and top <= height:
        return [lines[j][0] for j, n in enumerate(full) if n and lines[j][3]]
    # No article, or one that the text beside it exceeds: both by the same floor.
    found = within + beside
    floor = min(min_surge, max((h for h, _ in found), default=0))
    return [lines[j][0] for j in sorted(j for h, at in found if h >= floor for j in at)]


def extract_text(html: str | None) -> str:
    return "\n\n".join(main_lines(page_lines(html))) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``.

    Blocks are joined by an empty line; white space inside a block becomes one space; character references are decoded.
    A null or empty page has an empty text. Repeated rows each get a row; other columns are ignored.
    """

    def step(rows):
        texts = [extract_text(h) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(pages.select("page_id", "url", "html"), step, "page_id long, url string, text string, n_chars long")
