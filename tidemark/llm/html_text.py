"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores +1, less what labelled pages say of the elements that hold it: the
more often words under a class, id or role name (or in a `nav`, `aside`, ...) stand outside the article, the lower. A tag
costs by the same rule. One scan finds the contiguous part with the largest sum. An element whose words score below
zero is never worth having: where it lies within the best part, the scan pays for its tags and the text is without it.
Inside an open `article` or `main` tags cost nothing. Elements end where their parent does if their own end tag is
missing.

Labelled pages are pages that mark their article with an element of that name. The weights are fitted on a bounded
sample (`SAMPLE_PAGES`, the first by a hash of the id); the scan covers whole pages. Names that the sample may lack start
from prior odds (`PRIOR_TAGS`, `PRIOR_NAMES`). Labels tell nothing of adverts inside an article, so there only names with
prior odds count, and the sample weakens those by `AGAINST` at most. Without any weight no element is left out but those
that hold no text.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_PAGES = 400
#: Cost of a tag in words per unit of log odds, its bounds, and the cost of a block tag that no labelled page has.
SCALE, LEAST, MOST, UNKNOWN = 4.0, 0.05, 40.0, 3.0

START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
#: Elements whose content is no markup, and those of them that no page closes late: their parent's end ends them too.
RAW = {"script", "style", "textarea", "title", "iframe"}
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
BRIEF = {"title"}
#: Elements with markup that is not shown, or is no text; they are left out, and their tags do not count.
HIDDEN = {"noscript", "template", "svg", "select", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What an opened element ends when it is open right above it.
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"},
}
#: Elements that hold the article or the page, whatever their class is called.
HOLDERS = {"html", "body", "main", "article"}
#: Odds (natural logarithm) that a word under a name stands outside the article: before any page is seen, for tags of
#: form controls whatever is seen, and how far the words of labelled pages can move them down or up.
PRIOR, CONTROL, AGAINST, FOR = 4.0, 6.0, 2.0, 6.0
CONTROLS = {"form", "menu", "button", "dialog", "label"}
#: Tags and whole class, id and role names with prior odds.
PRIOR_TAGS = {"nav", "aside", "footer", "header"}
PRIOR_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "sponsor", "sponsored", "promo", "promos", "banner",
    "banners", "nav", "navbar", "navigation", "menu", "menus", "sidebar", "sidebars", "footer", "footers", "comment", "comments",
    "reply", "replies", "respond", "disqus", "cookie", "cookies", "consent", "notice", "notices", "alert", "alerts", "popup",
    "popups", "modal", "modals", "overlay", "overlays", "newsletter", "newsletters", "subscribe", "signup", "share", "sharing",
    "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "widget", "widgets",
    "masthead", "complementary", "contentinfo",
}
#: Prior odds by region: `<tag` or `.name`.
ODDS = (
    {f"<{t}": PRIOR for t in sorted(PRIOR_TAGS)} | {f".{n}": PRIOR for n in sorted(PRIOR_NAMES)} | {f"<{t}": CONTROL for t in sorted(CONTROLS)}
)


def key_of(name: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    """(name of the tag with its first class or id, regions that its element opens: `<tag` and `.name` of every class, id and role)."""
    names = []
    for attribute, a, b, c in ATTRIBUTE.findall(attributes) if attributes else []:
        if attribute.lower() in ("class", "id", "role"):
            names += (a or b or c).split()
    words = [w for n in names for w in re.split(r"[_-]+", n) if w]
    regions = [f"<{name}"] if f"<{name}" in ODDS else []
    regions += [f".{n.lower()}" for n in names]
    return (f"{name}.{words[0].lower()}" if words else name), () if name in HOLDERS else tuple(regions)


def raw_end(page: str, name: str, at: int, parent: str, known: dict[str, tuple[int, int]]) -> int:
    """Where the content that begins at `at` ends: behind its end tag, or before that of its parent if it has none.

    `known` holds the next end tag by name (behind the page if there is none), so that no part is searched twice.
    """
    if name not in known or known[name][0] < at:
        end = RAW_END[name].search(page, at)
        known[name] = end.span() if end else (len(page) + 1, len(page))
    first, last = known[name]
    if first <= len(page) and name not in BRIEF:
        return last
    above = re.compile(rf"</{re.escape(parent)}\s*>", re.I).search(page, at, min(first, len(page))) if parent else None
    return above.start() if above else last


class Markup:
    """Finds comments and tags of a page from left to right, in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.first = (-1, -1)  # where the last search for a mark began, and the mark it found
        self.dead: set[int] = set()  # quotes outside of quotes from which no tag ends

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose attributes begin at `at`, -1 if nowhere; a quoted part hides what it holds."""
        page, passed = self.page, []
        if at > self.last[">"]:
            return -1
        if not self.first[0] <= at <= self.first[1]:
            self.first = (at, MARK.search(page, at).start())
        mark = self.first[1]
        while True:
            sign = page[mark]
            if sign == ">":
                return mark + 1
            passed.append(mark)
            if mark in self.dead or mark >= self.last[sign]:
                break
            found = MARK.search(page, page.index(sign, mark + 1) + 1)
            if found is None:
                break
            mark = found.start()
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str | None, str, str, str] | None:
        """(begin, end, text of a CDATA section, slash of an end tag, name, attributes) of the next markup."""
        page = self.page
        while True:
            found = START.search(page, at)
            if found is None:
                return None
            begin, at = found.span()
            comment, section, other, slash, name = found.groups()
            if comment or section:
                sign = "-->" if comment else "]]>"
                stop = page.find(sign, at)
                end = len(page) if stop < 0 else stop + 3
                return begin, end, page[at : len(page) if stop < 0 else stop] if section else None, "", "", ""
            if other:
                end = page.find(">", at) + 1 if at <= self.last[">"] else 0
                if end > 0:
                    return begin, end, None, "", "", ""
            else:
                end = self.tag_end(at)
                if end > 0:
                    return begin, end, None, slash, name, page[at : end - 1]
            at = begin + 1


def tokens(page: str) -> list[list]:
    """['text', string], ['open', name, key, regions, end, explicit] and ['close', name] in order; raw elements and comments
    left out.

    `end` is the index of the token that ends the element, `explicit` whether that is its own end tag.
    """
    out: list[list] = []
    stack: list[list] = []  # open elements
    opened: dict[str, int] = {}  # how many of a name are open
    known: dict[str, tuple[int, int]] = {}

    def drop(explicit=False):
        top = stack.pop()
        opened[top[1]] -= 1
        top[4], top[5] = len(out), explicit

    at, n, markup = 0, len(page), Markup(page)
    while at < n:
        found = markup.next(at)
        if found is None:
            out.append(["text", page[at:]])
            break
        begin, end, section, slash, name, attributes = found
        if begin > at:
            out.append(["text", page[at:begin]])
        at = end
        if section is not None:
            out.append(["text", section])
            continue
        if not name:
            continue
        name = name.lower()
        closed = attributes.endswith("/")
        if slash:
            if opened.get(name):
                deep = len(stack) - 1
                while stack[deep][1] != name:
                    deep -= 1
                inline = name not in BLOCKS and name not in HIDDEN
                if inline and any(t[1] in BLOCKS for t in stack[deep + 1 :]):
                    # An end tag of an inline element ends no block.
                    stack.append(stack.pop(deep))
                else:
                    while len(stack) > deep + 1:
                        drop()
                drop(True)
            out.append(["close", name])
        elif name in RAW:
            if not closed:
                at = raw_end(page, name, at, stack[-1][1] if stack else "", known)
        else:
            if name in BLOCKS or name in ENDS:
                ends = ENDS.get(name, {"p"})
                deep = len(stack) - 1
                while deep >= 0 and stack[deep][1] not in BLOCKS and stack[deep][1] not in HIDDEN:
                    deep -= 1
                while deep >= 0 and stack[deep][1] in ends:
                    while len(stack) > deep:
                        drop()
                    deep -= 1
            key, regions = key_of(name, attributes)
            token = ["open", name, key, regions, len(out) + 1, False]
            out.append(token)
            if name not in VOID and not (closed and name in HIDDEN):
                stack.append(token)
                opened[name] = opened.get(name, 0) + 1
    while stack:
        drop()
    return out


def words_before(found: list[list]) -> list[int]:
    """Number of words before every token, and of all; text in elements that hold none (`HIDDEN`) does not count."""
    out, total, shown = [0], 0, 0
    for at, token in enumerate(found):
        if token[0] == "open" and token[1] in HIDDEN:
            shown = max(shown, token[4] + token[5])
        elif token[0] == "text" and at >= shown:
            total += len(token[1].split())
        out.append(total)
    return out


def fit_weights(pages: list[str]) -> dict[str, float]:
    """Cost of every tag key, and score that words lose in every region (both negative), from pages that mark their article.

    An element that holds an article is no evidence against its names; a name of an element with words on either side of the
    article's border counts both.
    """
    tags: dict[str, list[int]] = {}  # [outside, inside], in tags
    words: dict[str, list[int]] = {}  # the same in words
    for page in pages:
        found = tokens(page)
        before = words_before(found)
        articles = [k for k, t in enumerate(found) if t[0] == "open" and t[1] == "article"]
        at = border = 0
        while at < len(found):
            token, here = found[at], at
            at += 1
            if token[0] != "open":
                continue
            _, name, key, regions, end, explicit = token
            if name in HIDDEN:
                at = end + explicit
            elif name == "article":
                border = max(border, end)
            else:
                inside = here < border
                tags.setdefault(key, [0, 0])[inside] += 1
                next_one = bisect.bisect_right(articles, here)
                if inside or next_one == len(articles) or articles[next_one] >= end:
                    for region in regions:
                        words.setdefault(region, [0, 0])[inside] += before[end] - before[here]
                else:
                    for region in regions:
                        words.setdefault(region, [0, 0])[1] += before[end] - before[here]
    out = {}
    for key, (outside, inside) in tags.items():
        out[key] = -min(MOST, max(LEAST, SCALE * math.log((outside + 1) / (inside + 1))))
    for region in {*words, *ODDS}:
        outside, inside = words.get(region, (0, 0))
        seen = 0.0 if region[1:] in CONTROLS and region[0] == "<" else math.log((outside + 1) / (inside + 1))
        out[region] = -max(0.0, ODDS.get(region, 0.0) + min(FOR, max(-AGAINST, seen)))
    return out


def best_part(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last + 1 of the blocks with the largest sum, in one pass; each is (its score, score of what parts it from the
    one before). Of equal sums the part that ends first, of those the shortest; (0, 0) if no sum is above zero."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for k, (own, parting) in enumerate(scores):
        if k == begin or total + parting <= 0:
            total, begin = 0.0, k
        else:
            total += parting
        total += own
        if total > best:
            best, best_at = total, (begin, k + 1)
    return best_at


def extract(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best part, in order, one per line; white space inside a block is one blank.

    `weights` as `fit_weights` returns them; without any (an empty dict) words score +1 wherever they stand.
    """
    blocks: list[tuple[float, str]] = []  # (score of the tags since the block before, text)
    words: list[str] = []
    cost = 0.0
    inside: list[int] = []  # ends of the open article and main elements
    free = 0  # how many of them do not reach to the page's end for want of an end tag

    def cost_of(key: str, name: str) -> float:
        return weights.get(key, weights.get(name, -UNKNOWN if name in BLOCKS else -LEAST))

    def close_block():
        nonlocal cost
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            blocks.append((cost, text))
            cost = 0.0
        words.clear()

    def score_of(regions: tuple[str, ...]) -> float:
        """Score of a word in an element with these regions."""
        known = [r for r in regions if not inside or (r in ODDS and r != "<header")]
        return 1.0 + min((weights.get(r, 0.0) for r in known), default=0.0)

    found = tokens(page)
    marks = [k for k, t in enumerate(found) if t[0] == "open" and t[1] in ("article", "main")]
    at = 0
    last = len(found)
    while last and (found[last - 1] in (["close", "body"], ["close", "html"]) or found[last - 1][0] == "text" and not found[last - 1][1].strip()):
        last -= 1
    while at < len(found):
        token = found[at]
        at += 1
        while inside and inside[-1] < at:
            free -= inside.pop() < last
        was_free = free
        if token[0] == "text":
            words.append(token[1])
            continue
        name = token[1]
        if token[0] == "open":
            _, _, key, regions, end, explicit = token
            if name in HIDDEN:
                words.append(" ")
                at = end + explicit
                continue
            if name in BLOCKS:
                close_block()
            elif name == "br":
                words.append(" ")
            if name in ("article", "main"):
                inside.append(end)
                free += end < last
            skip = bool(regions) and name not in VOID and score_of(regions) < 0
            if skip and not inside:
                # An element with the article or the page's main part in it is kept; one that was left open ends there.
                mark = bisect.bisect_left(marks, at)
                if mark < len(marks) and marks[mark] < end:
                    skip, end, explicit = not explicit, marks[mark], False
            # What is in an article or left out of it does not part it.
            if skip:
                close_block()
                if not was_free and not inside:
                    cost += cost_of(key, name) + (cost_of(name, name) if explicit else 0.0)
                at = end + explicit
            elif not was_free:
                cost += cost_of(key, name)
        else:
            if name in BLOCKS:
                close_block()
            if not free:
                cost += cost_of(name, name) / 2
    close_block()
    begin, end = best_part([(float(len(text.split())), tags) for tags, text in blocks])
    return "\n".join(text for _, text in blocks[begin:end])


def labelled_pages(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """At most `most` pages with an article element; only their hashes are compared, then only they are fetched."""
    marked = pages.where(F.lower("html").contains("<article")).select("html", F.xxhash64("page_id", F.lit(5)).alias("h"))
    last = marked.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    # Rows that share an id share a hash; the limit below keeps the sample bounded all the same.
    chosen = marked.where(F.col("h") <= last).orderBy("h", F.xxhash64("html"))
    return [r.html for r in chosen.limit(most).collect()]


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A NULL or empty html, or one without words, gives an empty text with 0 characters. Of equal sums the part that ends
    first is taken. Without labelled pages every tag costs UNKNOWN and only prior odds tell regions. Repeated rows are
    answered alike.
    """
    import pyarrow as pa

    weights = fit_weights(labelled_pages(pages)) if weights is None else weights

    def run(batches):
        for batch, texts in runs(batches, "html"):
            found = [extract(t.decode("utf-8", "replace"), weights) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
