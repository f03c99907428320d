"""HTML extraction by consensus of a host's pages.

A page is cut into blocks of text, each under a container (an element that can hold an article). A
container is named by its generalised path: tags and classes from the root, digits left out. In a
first pass each page scores its containers and votes for the path of its main one; Spark sums the
votes of a host. In a second pass every page is read again by the winning paths of its host: the one
with most votes under which the page has all that its own main container has, but for noise. A page with
none of them is read by its own vote.

The main container is found from the root down, for as long as what stands beside the next container is
noise: dropped as below, or mostly links and without a heading.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never
count as text. Most are known by tag or role. The names in class and id only raise a suspicion: a block element
with such a name goes if it has no article, main part or top heading, and either stands outside of a page's
article or has less than half of the page's text; reader comments go whatever their size.

The winners are written to the shared folder and joined by host, so they are broadcast only where
their measured size is below the session's threshold. At most ``1 / MIN_SHARE`` paths of a host win.

Results for edge cases: a null or empty page, or one without text of its own, gives the empty text
and 0 characters. A null or unreadable address has the host ''; such pages vote together. Pages are
read whole; unclosed tags, comments and quotes end with their parent or the page. Ties between votes
go to the path first in order. Repeated rows give repeated results.
"""

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.session import scratch_path

MIN_SHARE = 0.05

# The names of HTML elements by what they are here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp textarea title svg object canvas annotation annotation-xml".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre address figure figcaption hr header footer nav aside form fieldset details summary dialog center".split()
)
CONTAINERS = frozenset("html body main article section div td center details".split())
CLOSED_BY_BLOCK = frozenset(["p"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav footer aside button select option dialog menu label".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names that mark what is not the article. A name is one of them or ends with one;
ENDING = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar "
    "toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe signup "
    "share sharing related recommended recommendations comment comments disqus reply replies respond pagination pager widget "
    "widgets copyright disclaimer".split()
)
# these it must be as a whole;
WHOLE = frozenset("header search skip hidden social rail subscription login".split())
# and with these it may begin.
BEGINNING = frozenset(
    "ad ads advert sidebar nav menu cookie cookies comment comments footer related share sharing newsletter promo sponsored "
    "breadcrumb breadcrumbs widget disqus pagination".split()
)
READERS = frozenset("comment comments disqus replies respond".split())
# Elements that stay whatever their class says.
KEPT_TAGS = frozenset("html body main article".split())
# What a suspected element must not have.
KEEPING = frozenset("main article h1".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
MARKS = frozenset("class id role hidden aria-hidden style".split())
NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def marks(attributes: str) -> dict:
    """The attributes that matter, each by its own name; of repeated ones the first counts."""
    out = {}
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            if name in MARKS:
                out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def is_dropped(tag: str, mark: dict, in_article: bool) -> bool:
    if tag in KEPT_TAGS:
        return False
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not mark:
        return False
    if "hidden" in mark or mark.get("aria-hidden") == "true" or mark.get("role", "").lower() in DROPPED_ROLES:
        return True
    return "style" in mark and bool(re.search(r"display\s*:\s*none", mark["style"], re.I))


def suspicion(tag: str, mark: dict, in_article: bool) -> int:
    """0 for an element whose names say nothing, 1 for one that may go, 2 for reader comments."""
    if tag in KEPT_TAGS:
        return 0
    found = int(tag in ("form", "fieldset"))
    for name in f"{mark.get('class', '')} {mark.get('id', '')}".split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        if not words:
            continue
        whole = "".join(words)
        # The header of an article is its own.
        if whole in WHOLE and not (whole == "header" and in_article) or words[-1] in ENDING or words[0] in BEGINNING:
            found = 2 if {words[0], words[-1]} & READERS else max(found, 1)
    return found


def is_block(tag: str) -> bool:
    """Elements of a page's own making are blocks."""
    return tag in BLOCK or "-" in tag


def path_part(tag: str, mark: dict) -> str:
    """A tag and its classes, digits left out and in order."""
    names = sorted({c for c in re.sub(r"\d+", "#", mark.get("class", "")).split()})
    return ".".join([tag, *names])


class Page:
    """The blocks of a page in order: ``(text, container, is heading)``; whether each is mostly links;
    containers as ``(path, parent)``, by number."""

    def __init__(self, source: str):
        self.blocks, self.linked, self.containers = [], [], [("", -1)]
        # (tag, container, dropped, in article, in heading, in link, suspect)
        self.stack = []
        # (suspect around it, suspicion, in article), and what each has: tags that keep it.
        self.suspects, self.has, self.of = [], [], []
        self.parts, self.said, self.said_in_links = [], 0, 0
        self.read(source)
        self.leave_out()

    def top(self):
        return self.stack[-1] if self.stack else ("", 0, False, False, False, False, -1)

    def end_block(self):
        if self.parts:
            text = " ".join(references.unescape("".join(self.parts)).split())
            linked = 2 * self.said_in_links > self.said
            self.parts, self.said, self.said_in_links = [], 0, 0
            if text:
                _, container, _, in_article, heading, _, suspect = self.top()
                self.blocks.append((text, container, heading))
                self.linked.append(linked)
                self.of.append((suspect, in_article))

    def say(self, text: str):
        _, _, dropped, _, _, link, _ = self.top()
        if text and not dropped:
            self.parts.append(text)
            size = len(text.strip())
            self.said += size
            if link:
                self.said_in_links += size

    def leave_out(self):
        """Blocks of suspected elements go, but for elements that the article may be in."""
        if not self.suspects:
            return
        size, total, articles = [0] * len(self.suspects), 0, 0
        inside = [0] * len(self.suspects)
        for (text, _, _), (suspect, in_article) in zip(self.blocks, self.of):
            total += len(text)
            articles += len(text) * in_article
            if suspect >= 0:
                size[suspect] += len(text)
                inside[suspect] += len(text) * in_article
        for i in range(len(size) - 1, -1, -1):
            around = self.suspects[i][0]
            if around >= 0:
                size[around] += size[i]
                inside[around] += inside[i]
                self.has[around] |= self.has[i]
        gone = []
        for i, (around, kind, in_article) in enumerate(self.suspects):
            if around >= 0 and gone[around]:
                gone.append(True)
            elif kind == 2:
                gone.append(not self.has[i] & {"main", "h1"} and size[i] < total)
            elif self.has[i]:
                gone.append(False)
            else:
                gone.append(2 * size[i] < total or not in_article and articles > inside[i])
        stay = [suspect < 0 or not gone[suspect] for suspect, _ in self.of]
        self.blocks = [x for x, s in zip(self.blocks, stay) if s]
        self.linked = [x for x, s in zip(self.linked, stay) if s]

    def read(self, source: str):
        at, size = 0, len(source)
        last = source.rfind(">")
        while at < size:
            mark = source.find("<", at)
            if mark < 0 or (mark > last and not source.startswith("<!--", mark)):
                # Nothing closes any more.
                self.say(source[at:])
                break
            if mark > at:
                self.say(source[at:mark])
            m = TOKEN.match(source, mark)
            if m is None:
                self.say("<")
                at = mark + 1
                continue
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            elif tag in RAW and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                else:
                    # Without an end of its own it ends with what it stands in.
                    _, container, _, in_article, *rest = self.top()
                    self.stack.append((tag, container, True, in_article, *rest))
            else:
                self.open(tag, m[3] or m[6] or "")
        self.end_block()

    def open(self, tag: str, attributes: str):
        block = is_block(tag)
        if block:
            self.end_block()
            self.close_implied(tag)
        elif tag == "br":
            self.say(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        _, container, dropped, in_article, heading, link, suspect = self.top()
        if not dropped:
            mark = marks(attributes)
            dropped = is_dropped(tag, mark, in_article)
            kind = 0 if dropped else suspicion(tag, mark, in_article)
            if kind and block:
                self.suspects.append((suspect, kind, in_article))
                self.has.append(set())
                suspect = len(self.suspects) - 1
            elif kind:
                dropped = True
            if suspect >= 0 and tag in KEEPING:
                self.has[suspect].add(tag)
            if tag in CONTAINERS and not dropped:
                self.containers.append((f"{self.containers[container][0]}/{path_part(tag, mark)}", container))
                container = len(self.containers) - 1
        in_article = in_article or tag in ("article", "main")
        self.stack.append((tag, container, dropped, in_article, heading or tag in HEADINGS, link or tag == "a", suspect))

    def close_implied(self, tag: str):
        """A block ends an open paragraph; an item, cell or row ends the one before it."""
        ends = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
        until = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
        closing, stops = ends.get(tag, CLOSED_BY_BLOCK), until.get(tag, BLOCK)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in closing:
                del self.stack[i:]
                return
            if self.stack[i][0] in stops:
                return

    def close(self, tag: str):
        block = is_block(tag)
        if block:
            self.end_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            # An inline end tag does not reach over a block.
            if not block and is_block(self.stack[i][0]):
                return

    def sizes(self) -> list[int]:
        """Characters of text under each container, at any depth."""
        out = [0] * len(self.containers)
        for text, container, _ in self.blocks:
            out[container] += len(text)
        for i in range(len(out) - 1, 0, -1):
            out[self.containers[i][1]] += out[i]
        return out

    def main_container(self) -> int:
        """From the root down while one container holds most of the text and only noise is left out.

        What stands in an article is not noise.
        """
        size = self.sizes()
        children, kept, noise = {}, [0] * len(size), [0] * len(size)
        for i, (_, parent) in enumerate(self.containers):
            children.setdefault(parent, []).append(i)
        # Under each container, at any depth: blocks that may not be left out, and characters of the others.
        for (text, container, heading), linked in zip(self.blocks, self.linked):
            if heading or not linked:
                kept[container] += 1
            else:
                noise[container] += len(text)
        for i in range(len(size) - 1, 0, -1):
            kept[self.containers[i][1]] += kept[i]
            noise[self.containers[i][1]] += noise[i]
        at = 0
        while children.get(at) and not self.containers[at][0].rpartition("/")[2].split(".")[0] == "article":
            best = max(children[at], key=lambda i: (kept[i], size[i], -i))
            if size[best] == 0 or kept[best] < kept[at] or noise[best] < noise[at] and kept[best] == 0:
                break
            at = best
        return at

    def blocks_under(self, path: str) -> list[int]:
        """The numbers of the blocks under all containers of a path."""
        under = []
        for own, parent in self.containers:
            under.append(own == path or (parent >= 0 and under[parent]))
        return [i for i, (_, container, _) in enumerate(self.blocks) if under[container]]

    def best_path(self, winning) -> str:
        """The first winning path that has all of the page's main container but noise, or that one's own."""
        own = self.containers[self.main_container()][0]
        mine = {i for i in self.blocks_under(own) if self.blocks[i][2] or not self.linked[i]}
        for path in winning:
            has = self.blocks_under(path)
            if has and mine.issubset(has):
                return path
        return own

    def text_under(self, path: str) -> str:
        return "\n\n".join(self.blocks[i][0] for i in self.blocks_under(path))


def votes(pages: DataFrame, key="page_id", url="url", html="html") -> DataFrame:
    """One row for each page with text: ``host, path, weight``."""

    def run(batches):
        for batch in batches:
            paths, weights = [], []
            for source in batch.column(1).to_pylist():
                page = Page(source)
                at = page.main_container()
                paths.append(page.containers[at][0])
                weights.append(page.sizes()[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(weights, pa.int64())], ["host", "path", "weight"])

    rows = pages.select(host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "host string, path string, weight long").where("weight > 0")


def host_of(url) -> F.Column:
    found = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def winning_paths(voted: DataFrame) -> DataFrame:
    """Per host the paths with at least ``MIN_SHARE`` of its votes, most first: ``host, paths``."""
    by_path = voted.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    total = by_path.groupBy("host").agg(F.sum("weight").alias("total"))
    won = by_path.join(total, "host").where(F.col("weight") >= MIN_SHARE * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda r: r["path"]).alias("paths"))


def extract(pages: DataFrame, key="page_id", url="url", html="html") -> DataFrame:
    """``page_id, url, text, n_chars, path`` of every page."""
    spark = pages.sparkSession
    where = scratch_path(spark, "host-paths")
    winning_paths(votes(pages, key, url, html)).write.parquet(where)
    winners = spark.read.parquet(where)
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(url).alias("host")
    )
    rows = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, path string"

    def run(batches):
        for batch in batches:
            texts, paths = [], []
            for source, winning in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(source)
                paths.append(page.best_path(winning or ()))
                texts.append(page.text_under(paths[-1]))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(paths, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return rows.mapInArrow(run, schema)
