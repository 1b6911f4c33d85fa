"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams its events; every block element begins a new line, and a line knows its text, its tags, the
text inside links, the containers around it, and whether it stands in an element that is never article text (fixed values below).
The ratio of text to tags per line (nothing for such elements, text outside links only) is smoothed by a Gaussian, and a
threshold that parts the smoothed ratios into two clusters marks content lines, by their smoothed or their own ratio. They select the region: if an article or main element
holds one, all article and main elements, else the smallest container of several lines that has all content lines. All lines of the region are kept, short ones too, but for
those in excluded elements and, where no article or main element marks the region, low lines that are mostly links.

Some elements are excluded by what they are (scripts, hidden ones), others by a guess: their kind (navigation, forms), role, class or id. A guess gives way
where the element holds an article or main element; a form, a role or a name also where it is a wrapper of blocks with most of the text, that of the marked elements if
there is any; reader comments stay out however long. A word behind a denial or a mere mention (no-sidebar, has-sidebar) names nothing.
All this is settled on the finished tree, in sums over elements in document order: time and memory are linear in the page, however deep it nests.

Some elements are excluded by what they are (scripts, hidden ones), others by a guess: their kind (navigation, forms), role, class or id. A guess gives way
where the element holds an article or main element; a form, a role or a name also where it is a wrapper of blocks with most of the text, that of the marked elements if
there is any; reader comments stay out however long. A word behind a denial or a mere mention (no-sidebar, has-sidebar) names nothing.
All this is settled on the finished tree, in sums over elements in document order: time and memory are linear in the page, however deep it nests.

Defined results: null or empty html, and pages without text, give the empty text; text without any tags is kept; broken markup is
read as far as it goes (an end tag closes what is open inside its element, or is ignored); character references are
decoded; white space, no-break space too, becomes one space. Repeated rows are repeated; columns other than the three are not read.
"""
from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, pick, whole_text

# Element names of HTML, and words by which pages name what is not their article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = set("head title script style noscript template button select option textarea svg canvas iframe object audio video datalist".split())
NEVER_KINDS = set("nav header footer aside dialog menu".split())
NEVER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_NAMES = set(("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead "
                   "footer sidebar aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search "
                   "share sharing social related recommended recommendations comment comments commentlist discussion disqus respond reply replies pagination pager toolbar copyright disclaimer").split())
COMMENT_NAMES = set("comment comments commentlist discussion disqus reply replies respond".split())
DENIALS = set("no not non has have with without hide hidden show is".split())
DENIALS = set("no not non has have with without hide hidden show is".split())
#: Elements whose names say something about the page as a whole, or about their own heading.
NAMES_IGNORED = set("html body main article h1 h2 h3 h4 h5 h6".split())
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A search for what an element of this kind ends does not look beyond these.
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ENDS_PARAGRAPH = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MARKED = {"article", "main"}
#: Containers that may be the region, if there are blocks in them and more than one line has text.
REGIONS = {"html", "body", "div", "section", "td"}

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.5
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Why an element is excluded, in falling certainty.
CERTAIN, COMMENT, KIND, GUESS = range(4)
#: Why an element is excluded, in falling certainty.
CERTAIN, COMMENT, KIND, GUESS = range(4)


def names_any(value: str | None, words: set[str]) -> bool:
    """Whether a class or id holds one of the words, not behind a denial."""
    for name in (value or "").split():
        parts = [w.lower() for w in NAME.findall(name)]
        if any(w in words and not (i and parts[i - 1] in DENIALS) for i, w in enumerate(parts)):
            return True
    return False


def names_any(value: str | None, words: set[str]) -> bool:
    """Whether a class or id holds one of the words, not behind a denial."""
    for name in (value or "").split():
        parts = [w.lower() for w in NAME.findall(name)]
        if any(w in words and not (i and parts[i - 1] in DENIALS) for i, w in enumerate(parts)):
            return True
    return False


class Line:
    __slots__ = ("parts", "tags", "linked", "block", "marked", "reason", "out", "text")

    def __init__(self, reason):
        self.parts, self.tags, self.linked, self.block, self.marked, self.reason, self.out = [], 0, 0, 0, False, reason, False


class Lines(HTMLParser):
    """Lines of a page and the tree of its elements: numbers in document order, with 0 for the page itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []                          # (tag, number)
        self.places = {}                        # where elements of a tag are open, innermost last
        self.tags, self.parents, self.lasts, self.sizes, self.marked_sizes = ["html"], [0], [0], [0], [0]
        self.reasons = [(0, None, 0, False)]    # (reason around it, why, element, certain): elements that are excluded
        self.reason = [0]                       # per open element, the innermost reason
        self.blocks = [0]
        self.links = self.marked = 0
        self.lines, self.line = [], Line(0)

    def _new_line(self):
        if self.line.parts or self.line.tags:
            self.lines.append(self.line)
        self.line = Line(self.reason[-1])

    def _excluded(self, tag, attrs):
        if tag in NEVER:
            return CERTAIN
        named = dict(attrs)
        if "hidden" in named or re.search(r"display\s*:\s*none", named.get("style") or ""):
            return CERTAIN
        if tag not in NAMES_IGNORED or tag == "article":
            values = named.get("class"), named.get("id")
            if any(names_any(v, COMMENT_NAMES) for v in values):
                return COMMENT
            if tag in NEVER_KINDS:
                return KIND
            if tag == "form" or (tag != "article" and any(names_any(v, NEVER_NAMES) for v in values)):
                return GUESS
        return GUESS if (named.get("role") or "").strip().lower() in NEVER_ROLES else None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.line.parts.append("\n")
            return
        if tag in VOID:
            if tag not in INLINE:
                self._new_line()
            self.line.tags += 1
            return
        if tag in ENDS_PARAGRAPH and self.places.get("p"):
            self._close({"p"}, {"table", "button", "object"})
        if tag in ENDS_ITSELF and tag != "p":
            self._close(ENDS_ITSELF[tag], FENCES[tag])
        number, why = len(self.tags), self._excluded(tag, attrs)
        for column, value in ((self.tags, tag), (self.parents, self.open[-1][1] if self.open else 0), (self.lasts, number), (self.sizes, 0), (self.marked_sizes, 0)):
            column.append(value)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number))
        self.reason.append(self.reason[-1])
        if why is not None:
            self.reasons.append((self.reason[-1], why, number, why <= COMMENT or self.reasons[self.reason[-1]][3]))
            self.reason[-1] = len(self.reasons) - 1
        self.links += tag == "a"
        self.marked += tag in MARKED
        if tag not in INLINE:
            self.blocks.append(number)
            self._new_line()
        elif self.reason[-1] != self.line.reason:
            self._new_line()
        self.line.tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _innermost(self, tags):
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags, fences):
        """Ends the innermost open element of these kinds and all inside it, unless a fence stands between."""
        at = self._innermost(tags)
        if at > self._innermost(fences):
            self._cut(at)

    def _cut(self, at):
        block = False
        for tag, number in self.open[at:]:
            self.places[tag].pop()
            self.lasts[number] = len(self.tags) - 1
            self.links -= tag == "a"
            self.marked -= tag in MARKED
            if tag not in INLINE:
                self.blocks.pop()
                block = True
        del self.open[at:], self.reason[at + 1:]
        if block or self.line.reason != self.reason[-1]:
            self._new_line()

    def handle_endtag(self, tag):
        if tag == "br":
            self.line.parts.append("\n")
            return
        self.line.tags += 1
        self._close({tag}, ())

    def handle_data(self, data):
        line = self.line
        if not line.block:
            line.block, line.marked = self.blocks[-1], self.marked > 0
        line.parts.append(data)
        size = len(data.strip())
        if self.links:
            line.linked += size
        elif not self.reasons[self.reason[-1]][3]:
            number = self.open[-1][1] if self.open else 0
            self.sizes[number] += size
            if self.marked:
                self.marked_sizes[number] += size

    def close(self):
        super().close()
        self._cut(0)
        self._new_line()

    def summed(self, values):
        """Sums over all that each element holds."""
        values = list(values)
        for number in range(len(values) - 1, 0, -1):
            values[self.parents[number]] += values[number]
        return values

    def settle(self):
        """Which lines are out."""
        certain = {number: sure for _, _, number, sure in self.reasons[1:]}
        sure, holds = [False] * len(self.tags), [0] * len(self.tags)
        for number in range(1, len(self.tags)):
            sure[number] = certain.get(number, False) or sure[self.parents[number]]
            holds[number] = int(self.tags[number] in MARKED and not sure[number])
        inside, sizes, marked = self.summed(holds), self.summed(self.sizes), self.summed(self.marked_sizes)
        text, blocks = marked if marked[0] else sizes, [0] * len(self.tags)
        for line in self.lines:
            blocks[line.block] += not "".join(line.parts).isspace()
        nested = self.summed(blocks)
        out = [False]
        for around, why, number, _ in self.reasons[1:]:
            gives_way = why != CERTAIN and (inside[number] > holds[number] or (why == GUESS and 2 * text[number] > text[0] and nested[number] - blocks[number] > 1))
            out.append(out[around] or not gives_way)
        for line in self.lines:
            line.out = out[line.reason]


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach:high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Half way between the means of the two clusters that it makes."""
    at = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2 if low and high else at
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.settle()
    lines = parser.lines
    for line in lines:
        line.text = " ".join("".join(line.parts).split())
    if not any(line.text and not line.out for line in lines):
        return ""
    own = [0.0 if line.out else max(0, len(line.text) - line.linked) / max(1, line.tags) for line in lines]
    ratios = smoothed(own)
    least = threshold(ratios)
    usable = [(line, ratio) for line, ratio in zip(lines, ratios) if line.text and not line.out]
    # Smoothing lowers the first and last lines of a stretch: what reaches the threshold by itself counts too.
    content = [line for line, ratio, alone in zip(lines, ratios, own) if line.text and not line.out and max(ratio, alone) >= least] or [line for line, _ in usable]
    if any(line.marked for line in content):
        return " ".join(line.text for line, _ in usable if line.marked)

    def held(chosen):
        counts = [0] * len(parser.tags)
        for line in chosen:
            counts[line.block] += 1
        return counts, parser.summed(counts)

    (own_lines, all_lines), (_, contents), (_, texts) = held(lines), held(content), held(line for line, _ in usable)
    region = max((n for n in range(1, len(parser.tags)) if contents[n] == len(content) and parser.tags[n] in REGIONS and all_lines[n] > own_lines[n] and texts[n] > 1), default=None)
    within = lambda line: region is None or region <= line.block <= parser.lasts[region]
    return " ".join(line.text for line, ratio in usable if within(line) and not (ratio < least and line.linked * 2 > len(line.text)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(rows):
        return {"page_id": rows["page_id"], "url": rows["url"], "text": [main_text(h) for h in rows["html"]]}

    source = pick(pages, "page_id", "url", "html").select("page_id", "url", whole_text("html").alias("html"))
    kinds = source.schema
    found = map_batches(source, run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string", rows=64)
    return found.withColumn("n_chars", F.length("text").cast("long"))
