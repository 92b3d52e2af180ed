"""Main text of web pages by a tree-structured graphical model (operator 5).

A page is parsed into its DOM tree. Every element has a label, content or not.
Parts that name themselves something else (NOT_CONTENT by tag, or by the head
word of a class, id or role) are observed, with all inside them; other labels
are hidden. An element's features (tag, amount and kind of its own text) give
it evidence, and potentials by its kind tie it to its parent's label.
Sum-product messages from the leaves to the root and back give each element's
exact marginal, and the text blocks of elements that are more likely content
than not are the main text. Pages are trees: one pass up and one down suffice.

Training pages are those that mark their article themselves (an article or main
element): what lies inside it, but not in a part of another kind, is content. Counts of features and of parent-child labels over
at most TRAINING_PAGES such pages (those with the smallest hash) and a few
prior counts give the potentials.
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

from tabprep.llm.words import slices

#: Different pages that train the potentials, at most.
TRAINING_PAGES = 4000
#: Prior counts of a named part being content or not.
PRIOR = 200.0
#: Most evidence (log odds) that a feature other than an article's own mark gives.
MOST = 0.5

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
                   "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
# Elements whose start closes an open p; and what closes an open element of its own kind.
CLOSES_P = BLOCKS - frozenset("body caption dd dt frameset head html legend li optgroup option tbody td tfoot th thead title tr".split()) | {"li", "dd", "dt"}
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
            "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tfoot tr td th", ("table",))}
# Parts that are never article text, as elements, roles and words of class and id.
NOT_CONTENT = frozenset("nav header footer aside menu form button select textarea dialog search fieldset head title script style noscript template iframe svg canvas object math audio video".split())
NOT_CONTENT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead "
                              "footer foot sidebar aside side related recommended share sharing social comment comments reply replies respond disqus discussion cookie cookies consent notice notices "
                              "alert popup modal overlay subscribe newsletter signup login search form pagination pager toolbar widget copyright complementary contentinfo tags skip".split())
CONTENT = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content main story entry post body text".split())
# The text of these elements is no text of the page at all.
SILENT = frozenset("head title script style noscript template iframe textarea select option svg canvas object math audio video".split()) | RAW

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_RELATION = frozenset("with has no without not".split())


class Page:
    """Elements in page order: tag, parent, class words; and pieces of text with the element that holds each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.pieces = ["#page"], [-1], []
        self.other, self.article = [False], [False]  # observed as another part; marked as article
        stack, at = [0], 0
        self._open: Counter = Counter()  # elements on the stack by tag
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self.pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(stack, name)
                continue
            self._make_room(stack, name)
            self.tag.append(name)
            self.parent.append(stack[-1])
            other, article = self._named(m[3]) if m[3] else (False, False)
            other = (other and name not in ("html", "body", *CONTENT)) or name in NOT_CONTENT
            self.other.append(self.other[stack[-1]] or other)
            self.article.append(name in CONTENT or (article and not other))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif name not in VOID and not (m[3] or "").endswith("/"):
                stack.append(len(self.tag) - 1)
                self._open[name] += 1
            elif name in ("br", "hr"):
                self.pieces.append((stack[-1], " "))
        if at < len(source):
            self.pieces.append((stack[-1], source[at:]))

    def _named(self, attributes: str) -> tuple[bool, bool]:
        """Whether a class, id or role says another part (its first or last word: ad-slot, site-header), or else article."""
        other = article = False
        for m in _ATTRIBUTE.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                words = _WORD.findall(name)
                if words and not _RELATION & set(words):
                    not_content = words[0] in NOT_CONTENT_WORDS or words[-1] in NOT_CONTENT_WORDS
                    other |= not_content
                    article |= words[-1] in CONTENT_WORDS and not not_content
        return other, article

    def _drop(self, stack: list[int], i: int) -> None:
        for e in stack[i:]:
            self._open[self.tag[e]] -= 1
        del stack[i:]

    def _close(self, stack: list[int], name: str) -> None:
        if not self._open[name]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                self._drop(stack, i)
                return
            if name not in BLOCKS and self.tag[stack[i]] in BLOCKS:
                return

    def _make_room(self, stack: list[int], name: str) -> None:
        if name in CLOSES_P:
            self._until(stack, ("p",), ("article", "section", "div", "body", "table", "td", "blockquote", "main"))
        if name in SIBLINGS:
            ends, within = SIBLINGS[name]
            self._until(stack, ends.split(), within)

    def _until(self, stack: list[int], ends, within) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if not any(self._open[e] for e in ends):
                return
            tag = self.tag[stack[i]]
            if tag in ends:
                self._drop(stack, i)
                if tag == "p" or len(ends) == 1:
                    return
            elif tag in within:
                return

    def features(self) -> list[list[str]]:
        """Of every element. Text counts as the element's own up to the next block."""
        n = len(self.tag)
        size, linked = [0] * n, [0] * n
        block, link = list(range(n)), [False] * n  # the block that holds an element's text, and whether a link lies between
        for i in range(1, n):
            if self.tag[i] not in BLOCKS:
                block[i] = block[self.parent[i]]
                link[i] = link[self.parent[i]] or self.tag[i] == "a"
        for e, text in self.pieces:
            length = len(text.strip())
            size[block[e]] += length
            linked[block[e]] += length * link[e]
        out = []
        for i in range(n):
            own = []
            if size[i]:  # an element that only holds others says nothing by itself
                own = ["tag=" + self.tag[i], f"size={min(size[i], 4000).bit_length() // 2}", f"links={4 * linked[i] // size[i]}"]
            if self.article[i]:
                own.append("mark=article")
            out.append(own)
        return out

    def marked(self) -> list[bool] | None:
        """Labels that the page gives itself; None if it marks no article."""
        if not any(self.article):
            return None
        out: list[bool] = []
        for i in range(len(self.tag)):
            out.append(not self.other[i] and (self.article[i] or (i > 0 and out[self.parent[i]])))
        return out


class Potentials:
    """Log evidence of features and parent-child potentials by the child's kind, from counts."""

    def __init__(self, counts: dict):
        c = Counter(counts)
        c["1 mark=article"] += PRIOR
        for kind, parent, child, n in (("plain", 0, 0, 10), ("plain", 1, 1, 10), ("article", 0, 1, 1), ("article", 1, 1, 1)):
            c[f"{kind} {parent}{child}"] += n * PRIOR
        total = {y: sum(v for k, v in c.items() if k.startswith(f"{y} tag=")) + 1.0 for y in "01"}
        names = {k[2:] for k in c if k[0] in "01"}
        kinds = Counter(n.split("=")[0] for n in names)
        self.evidence = {}
        for n in names:
            p = [(c[f"{y} {n}"] + 0.5) / (total[y] + 0.5 * (kinds[n.split("=")[0]] + 1)) for y in "01"]
            told = float(np.log(p[1] / p[0]))
            # where an element stands says most of this already, through its parent
            self.evidence[n] = max(told, 0.0) if n == "mark=article" else float(np.clip(told, -MOST, MOST))
        self.edge = {}
        for kind in ("plain", "article"):
            edge = np.array([[c[f"{kind} {a}{b}"] + 1.0 for b in "01"] for a in "01"])
            self.edge[kind] = (edge / edge.sum(axis=1, keepdims=True)).ravel().tolist()

    def marginals(self, page: Page) -> list[float]:
        """Probability of every element's being content: messages up, then down. All are kept as ratios content : other."""
        n = len(page.tag)
        least, most = 1e-200, 1e200
        up = [0.0 if other else float(np.exp(sum(self.evidence.get(f, 0.0) for f in own))) for own, other in zip(page.features(), page.other, strict=True)]
        edge = [self.edge["article" if a else "plain"] for a in page.article]
        sent = [1.0] * n
        for i in range(n - 1, 0, -1):
            if page.other[i]:  # menus and adverts stand in any element: they say nothing of their parent
                continue
            e00, e01, e10, e11 = edge[i]
            sent[i] = (e10 + e11 * up[i]) / (e00 + e01 * up[i])
            p = page.parent[i]
            up[p] = min(max(up[p] * sent[i], least), most)
        out = [up[0]] + [0.0] * (n - 1)
        for i in range(1, n):
            if page.other[i]:
                continue
            e00, e01, e10, e11 = edge[i]
            rest = min(max(out[page.parent[i]] / sent[i], least), most)
            out[i] = min(max(up[i] * (e01 + e11 * rest) / (e00 + e10 * rest), least), most)
        return [r / (1 + r) for r in out]


def main_text(source: str, model: Potentials) -> tuple[str, float]:
    """Blocks of the elements that are likelier content than not, in page order; the least sure block's marginal."""
    page = Page(source)
    chance = model.marginals(page)
    blocks: list[list] = []
    sure = 1.0
    silent = [False] * len(page.tag)
    block = list(range(len(page.tag)))
    for i in range(1, len(page.tag)):
        silent[i] = silent[page.parent[i]] or page.tag[i] in SILENT
        block[i] = i if page.tag[i] in BLOCKS else block[page.parent[i]]
    for e, text in page.pieces:
        if silent[e]:
            continue
        kept = chance[e] > 0.5 and chance[block[e]] > 0.5
        sure = min(sure, max(chance[e], 1 - chance[e]))
        if not blocks or blocks[-1][0] != block[e]:
            blocks.append([block[e], ""])
        if kept:
            blocks[-1][1] += text
    texts = (" ".join(entities.unescape(b).split()) for _, b in blocks)
    return "\n".join(t for t in texts if t), sure


def train(pages: DataFrame, html_col: str = "html") -> Potentials:
    """Potentials from pages that mark their article."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            for source in batch.column("html").to_pylist():
                page = Page(source)
                labels = page.marked()
                if labels is None:
                    continue
                for i, own in enumerate(page.features()):
                    if page.other[i]:
                        continue
                    c.update(f"{int(labels[i])} {f}" for f in own)
                    if i:
                        c[f"{'article' if page.article[i] else 'plain'} {int(labels[page.parent[i]])}{int(labels[i])}"] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([float(v) for v in c.values()], pa.float64())], names=["name", "n"])

    source = F.col(html_col).cast("string")
    some = pages.select(source.alias("html")).where("html rlike '(?i)<(article|main)[ >]'")
    # hashes alone are ordered; their pages are fetched by a join
    some = some.select(F.xxhash64("html").alias("h"), "html")
    chosen = some.select("h").distinct().orderBy("h").limit(TRAINING_PAGES)
    some = some.join(F.broadcast(chosen), "h", "left_semi").select("html")
    rows = some.mapInArrow(run, "name string, n double").groupBy("name").agg(F.sum("n").alias("n"))
    # names are tags and a few buckets; a page can make up tags, so only those seen more than once count
    return Potentials(Counter({r.name: r.n for r in rows.where("n > 1").orderBy(F.desc("n")).limit(20_000).collect()}))


def extract(pages: DataFrame, html_col: str = "html", model: Potentials | None = None) -> DataFrame:
    """``pages`` without its other columns of the names text, n_chars and sure, and with these: text, n_chars (code
    points), sure (the least certain element's probability).

    Null and empty pages give an empty text and sure = 1. Whole pages are read; a page that ends inside a tag ends
    there. Rows are judged each alone, repeated ones alike; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages, html_col))
    keep = [c for c in pages.columns if c not in ("text", "n_chars", "sure")]
    whole = "_".join(["html", *keep])  # no other column's name
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, whole):
            done = [main_text(x or "", shared.value) for x in batch.column(whole).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()), pa.array([s for _, s in done], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "text", "n_chars", "sure"])

    schema = pages.select(*[F.col(f"`{c}`") for c in keep]).schema.add("text", "string").add("n_chars", "long").add("sure", "double")
    return rows.mapInArrow(run, schema)
