"""Operator 3: main text of web pages by union-free wrappers.

Pages of a host share a template. A page is read as a stream of elements and texts; the streams of a host are aligned
one after the other, element by element under their parents, into one wrapper, an expression without unions: an element that
stands twice or more beside itself becomes a repeated group, one that only some pages have becomes optional, and a
text that differs becomes a slot; texts that all pages with their element have stay as constants, and those that all but
few have as optional constants: a page without its notice does not make the notice text.
Alignment has no order: tasks align what they read, counting texts by element, and what they found is summed up by host,
element and text, so no host is one row or one task. Elements are named by a hash of their path, whatever its depth.

Every page's text is then taken by its host's wrapper: constants that pages of differing text agree in are the
template's, what varies is text. Menus, headers, footers, sidebars, notices, adverts, forms and comments, whose
text varies too, are known by element, role and class name; an ``article`` or ``main`` limits the text to itself.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, checkpointed, read

#: Wrapper elements and texts that a task holds before it hands them on.
HELD_NODES = 200_000
#: Pages of differing text that must agree in a text for it to be a constant.
CONSTANT_FROM = 3
#: A constant may be missing on one in so many of the pages that have its element: it is optional then.
MISSING_ONE_IN = 10
#: Inside an article, copies of one article agree too: there constants are short, and a small part of the text (one in so many words).
CONTENT_WORDS, CONTENT_SHARE = 50, 5

# HTML elements by the part they play.
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NEVER_IN_P = _BLOCKS - {"html", "body"}
_LISTS = {"ul", "ol", "dl", "menu", "table", "tbody", "thead", "tfoot"}
_DROPPED = {"nav", "aside", "footer", "form", "dialog", "menu", "search", "fieldset"}
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
_STRONG = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored nav navbar navigation menu sidebar footer comment comments commentlist respond"
    " disqus cookie cookies consent gdpr popup modal newsletter subscribe signup breadcrumb breadcrumbs pagination pager masthead".split()
)
_WEAK = set("header banner promo promotion notice notices alert share sharing social related recommended widget topbar toolbar login search side".split())
_CONTENT = set("article post entry content story main body title headline text".split())
#: Words that say where or how an element stands, not what it is.
_PLACE = set(
    "page site global block box bar wrap wrapper container section area list item items inner outer left right top bottom middle unit slot links link buttons button icons icon"
    " panel row col column group holder region zone primary secondary fixed sticky mobile desktop large small the js".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^>]*>",
    re.S | re.I,
)
#: Elements whose content is no markup. Unclosed ones of the second kind hold nothing; script and style hold the rest.
_RAW, _RAW_IF_CLOSED = {"script", "style"}, {"noscript", "textarea", "iframe", "title"}
#: Elements without main text that may hold others: skipped only as far as they are really closed.
_SKIPPED = {"template", "svg", "select", "math", "canvas", "object", "button"}
_FOREIGN = {"svg", "math"}
_SKIPS = re.compile(rf"<(?:{'|'.join(sorted(_SKIPPED))})\b", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Words of a class that make even a part of a line an advert.
_ADS = set("ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOLDS = re.compile(r"(has|have|with|without|no|is|not)[-_A-Z]")


def _attributes(written: str) -> dict[str, str]:
    """Names in lower case and values; of repeated names the first counts. Only whole names are names."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(written):
        found.setdefault(name.lower(), a or b or c)
    return found


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()


def _judge(tag: str, found: dict[str, str], in_content: bool, by_name: bool) -> tuple[bool, bool, str]:
    """Whether an element is boilerplate, whether it is even if it holds the main element, and its key in the wrapper.

    Without ``by_name`` its class, and a form, say nothing.
    """
    drop = (tag in _DROPPED and (by_name or tag != "form")) or (tag == "header" and not in_content) or found.get("role", "").lower() in _DROPPED_ROLES
    hidden = _hidden(found)
    drop = drop or hidden
    hard = drop and (tag != "form" or found.get("role", "").lower() in _DROPPED_ROLES or hidden)
    if by_name and tag not in ("body", "html") and not drop:
        drop = _named_boilerplate(f"{found.get('class', '')} {found.get('id', '')}".split())
    return drop, hard, f"{tag}.{'.'.join(sorted(found['class'].split()))}" if found.get("class") else tag


def _named_boilerplate(names: list[str]) -> bool:
    """Whether class names say that an element is boilerplate.

    What a name says is its last word that is no mere place: "post-comments" are comments, "share-price-table" is a table.
    The weaker words count only in names, and beside names, that speak of nothing else. Names like "has-sidebar" tell what an element holds.
    """
    weak = False
    foreign: set[str] = set()
    for name in names:
        if _HOLDS.match(name):
            continue
        words = [w.lower() for w in _NAME.findall(name)]
        foreign.update(w for w in words if w not in _WEAK and w not in _PLACE)
        while len(words) > 1 and words[-1] in _PLACE:
            words.pop()
        if words and words[-1] in _STRONG:
            return True
        weak = weak or bool(words) and words[-1] in _WEAK
    return weak and not foreign


class Block:
    """One block of text: its element, its mark (text and element in one) and whether it may be main text."""

    __slots__ = ("node", "mark", "text", "content", "dropped")

    def __init__(self, node: int, text: str, content: bool, dropped: bool):
        self.node, self.text, self.content, self.dropped = node, text, content, dropped
        self.mark = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), node)


class Page:
    """Blocks of text in order, and the elements that are no boilerplate: ``node: [parent, key, repeated]``."""

    __slots__ = ("blocks", "nodes")

    def __init__(self):
        # The page itself is element 0.
        self.blocks, self.nodes = [], {0: [None, "", False]}


class _Skips:
    """Where elements that are skipped start and end, if they are really closed: found in one pass over a page.

    An element is not if a block that began before it ends in it, or if an HTML block stands in svg or math (which
    it ends) without an element that may hold HTML. ``<svg/>`` and ``<math/>`` are empty.
    """

    def __init__(self, page: str, last: int):
        self.ends: dict[int, int] = {}
        opened: dict[str, list[list]] = {}
        whole: list[list] = []
        blocks: dict[str, list[int]] = {}
        seen, holder = 0, -1
        for token, tag, closing in _tags(page, last):
            start = token.start()
            if tag in ("foreignobject", "annotation-xml"):
                holder = start
            elif tag in _BLOCKS:
                seen += 1
                if tag == "p":
                    continue
                if not closing:
                    blocks.setdefault(tag, []).append(start)
                    continue
                began = blocks[tag].pop() if blocks.get(tag) else -1
                while whole and whole[-1][0] > began:
                    whole.pop()[2] = False
            elif tag in _SKIPPED:
                if not closing:
                    if tag in _FOREIGN and (token[3] or "").endswith("/"):
                        self.ends[start] = token.end()
                        continue
                    one = [start, seen, True]
                    opened.setdefault(tag, []).append(one)
                    whole.append(one)
                elif opened.get(tag):
                    one = opened[tag].pop()
                    # Once a skipped element is closed, those in it that are still open never matter again.
                    if one[2]:
                        while whole and whole[-1][0] >= one[0]:
                            whole.pop()
                        if tag not in _FOREIGN or one[1] == seen or holder > one[0]:
                            self.ends[one[0]] = token.end()


def _tags(page: str, last: int):
    """Tags of a page with name and whether they close; comments and raw elements are stepped over."""
    at = 0
    closers: dict[str, tuple] = {}
    while token := _TOKEN.search(page, at, last):
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            yield token, "", False
            continue
        closing = bool(token[1] or token[4])
        if not closing and (tag in _RAW or tag in _RAW_IF_CLOSED):
            if tag not in closers:
                final = None
                for final in re.finditer(rf"</{tag}\s*>", page, re.I):
                    pass
                closers[tag] = (re.compile(rf"</{tag}\s*>", re.I), -1 if final is None else final.start())
            pattern, final = closers[tag]
            if final >= at:
                at = pattern.search(page, at).end()
            elif tag in _RAW:
                body = re.compile(r"<body\b", re.I).search(page, at)
                at = body.start() if body else len(page)
            yield token, "", at
            continue
        yield token, tag, closing


def read_page(html: str | None) -> Page:
    """A page's blocks and elements; inline elements do not end a block, ``br`` is white space.

    A class or a form does not drop the ``main`` in it, nor the ``article`` where no other text is in either. Where
    names and forms would leave nothing at all, they say nothing.
    """
    found, buried = _read(html, False, True)
    if buried and not any(b.content and not b.dropped for b in found.blocks):
        found, _ = _read(html, True, True)
    if found.blocks and all(b.dropped for b in found.blocks):
        plain, _ = _read(html, True, False)
        found = plain if any(not b.dropped for b in plain.blocks) else found
    return found


class _Stack:
    """Open elements, and where in the stack each kind of them stands, so that nothing is searched for."""

    def __init__(self):
        # tag, node, in article or main, dropped, dropped whatever it holds, nodes of its children
        self.rows: list[tuple] = [("", 0, False, False, False, set())]
        self.at: dict[str, list[int]] = {}
        self.lists, self.solid = [0], [0]

    def push(self, row: tuple) -> None:
        k, tag = len(self.rows), row[0]
        self.rows.append(row)
        self.at.setdefault(tag, []).append(k)
        if tag in _LISTS:
            self.lists.append(k)
        if tag != "p" and tag not in _HEADINGS:
            self.solid.append(k)

    def cut(self, k: int) -> None:
        """Elements from place ``k`` on are closed."""
        while len(self.rows) > k:
            gone, place = self.rows.pop()[0], len(self.rows)
            self.at[gone].pop()
            if self.lists[-1] == place:
                self.lists.pop()
            if self.solid[-1] == place:
                self.solid.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0


def _read(html: str | None, free_articles: bool, by_name: bool) -> tuple[Page, bool]:
    out = Page()
    nodes, stack = out.nodes, _Stack()
    buried = False
    held: list[str] = []
    #: Inline elements that are open in one that is hidden or an advert; its text goes.
    muted: list[str] = []

    def flush():
        muted.clear()
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack.rows[-1]
                out.blocks.append(Block(top[1], text, top[2], top[3]))

    page, at = html or "", 0
    last = page.rfind(">") + 1 if "<!--" not in page else len(page)
    skips = _Skips(page, last).ends if _SKIPS.search(page) else {}
    for token, tag, closing in _tags(page, last):
        if token.start() < at:
            continue
        if token.start() > at and not muted:
            held.append(page[at : token.start()])
        at = token.end()
        if not tag:
            at = max(at, closing)
            continue
        if tag in _SKIPPED and not closing:
            at = max(at, skips.get(token.start(), at))
            continue
        written = token[3] or ""
        if tag not in _BLOCKS:
            if tag in ("br", "wbr"):
                held.append(" " if tag == "br" else "")
            elif muted:
                if closing and tag in muted:
                    while muted.pop() != tag:
                        pass
                elif not closing and not written.endswith("/"):
                    muted.append(tag)
            elif not closing and by_name and written.strip() and tag not in ("img", "input", "source", "embed", "meta", "link", "param", "track", "area", "col", "base"):
                found = _attributes(written)
                if _hidden(found) or any(w in _ADS for name in f"{found.get('class', '')} {found.get('id', '')}".split() if not _HOLDS.match(name) for w in _NAME.findall(name.lower())[-1:]):
                    muted.append(tag)
            continue
        flush()
        if closing:
            if k := stack.last(tag):
                stack.cut(k)
            continue
        if tag in _SELF_CLOSING:
            k = max(map(stack.last, _SELF_CLOSING[tag]))
            if k > (stack.solid[-1] if tag == "p" else stack.lists[-1]):
                stack.cut(k)
        if tag in _NEVER_IN_P and stack.rows[-1][0] == "p":
            stack.cut(len(stack.rows) - 1)
        if tag == "hr":
            continue
        _, parent, content, dropped, hard, beside = stack.rows[-1]
        found = _attributes(written) if written.strip() else {}
        drop, firm, key = _judge(tag, found, content, by_name)
        main = tag == "main" or found.get("role", "").lower() == "main"
        if dropped and not hard and not content:
            buried = buried or tag == "article"
            dropped = not (main or (free_articles and tag == "article"))
        node = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), parent)
        if not (dropped or drop):
            known = nodes.setdefault(node, [parent, key, False])
            known[2] = known[2] or node in beside
            beside.add(node)
        stack.push((tag, node, content or main or tag == "article", dropped or drop, hard or firm, set()))
    if at < len(page) and not muted:
        held.append(page[at:])
    flush()
    return out, buried


def align(wrapper: dict, page: Page) -> int:
    """``wrapper`` (``node: [parent, key, pages, seen, repeated, texts]``, texts ``mark: [pages, seen]``) widened to fit one more page.

    ``seen`` has a bit for each page text, of 64: as many bits, at least so many differing texts. Returns by how many
    elements and texts the wrapper grew.
    """
    texts: dict[int, set] = {}
    for block in page.blocks:
        if not block.dropped:
            texts.setdefault(block.node, set()).add(block.mark)
    whole = b"".join(block.mark.to_bytes(8, "little") for block in page.blocks if not block.dropped)
    seen = 1 << xxhash.xxh64_intdigest(whole) % 64
    grown = 0
    for node, (parent, key, repeated) in page.nodes.items():
        known = wrapper.get(node)
        if known is None:
            known = wrapper[node] = [parent, key, 0, 0, False, {}]
            grown += 1
        known[2] += 1
        known[3] |= seen
        known[4] = known[4] or repeated
        for mark in texts.get(node, ()):
            one = known[5].get(mark)
            if one is None:
                known[5][mark] = [1, seen]
                grown += 1
            else:
                one[0] += 1
                one[1] |= seen
    return grown


def agreed(wrapper: dict, least_texts: int = CONSTANT_FROM) -> frozenset:
    """Marks (signed) of a wrapper's constants, optional ones too, in which ``least_texts`` pages of differing text agree."""
    return frozenset(_signed(mark) for _, _, pages, _, _, texts in wrapper.values() for mark, (n, seen) in texts.items() if (pages - n) * MISSING_ONE_IN <= pages and seen.bit_count() >= least_texts)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def infer_wrappers(pages: DataFrame, least_texts: int = 1) -> DataFrame:
    """``(host, node, parent, key, pages, texts, optional, repeated, constants, optional_constants)``: the wrappers of ``pages(host, html)``, a row an element.

    Aligned in the tasks first, then summed up by host and element, and by text. ``texts``: how many pages of differing text, at least.
    ``constants``: texts of all pages with the element, ``optional_constants``: of all but one in ``MISSING_ONE_IN``; either only if pages of
    ``least_texts`` differing texts have them, which also leaves most texts out before they are joined with their element.
    """
    names = ["host", "node", "mark", "parent", "key", "pages", "seen", "repeated"]

    def local(batches):
        held: dict = {}
        size = 0

        def out():
            rows = []
            for host, wrapper in held.items():
                for node, (parent, key, n, seen, again, texts) in wrapper.items():
                    node = _signed(node)
                    rows.append((host, node, None, None if parent is None else _signed(parent), key, n, _signed(seen), again))
                    rows.extend((host, node, _signed(mark), None, None, m, _signed(bits), None) for mark, (m, bits) in texts.items())
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                size += align(held.setdefault(host, {}), read_page(html.as_py()))
                if size > HELD_NODES:
                    yield out()
                    held.clear()
                    size = 0
        if size:
            yield out()

    schema = "host string, node long, mark long, parent long, key string, pages long, seen long, repeated boolean"
    parts = checkpointed(pages.select("host", "html").mapInArrow(local, schema))
    whole = parts.where("mark IS NULL").groupBy("host", "node").agg(
        F.min("parent").alias("parent"), F.min("key").alias("key"), F.sum("pages").alias("pages"), F.bit_count(F.bit_or("seen")).alias("texts"), F.bool_or("repeated").alias("repeated")
    )
    marks = parts.where("mark IS NOT NULL").groupBy("host", "node", "mark").agg(F.sum("pages").alias("with_mark"), F.bit_count(F.bit_or("seen")).alias("mark_texts"))
    shared = marks.where(F.col("mark_texts") >= least_texts).join(whole.select("host", "node", "pages"), ["host", "node"])
    shared = shared.withColumn("missing", F.col("pages") - F.col("with_mark")).where(F.col("missing") * MISSING_ONE_IN <= F.col("pages"))
    # At most a page's worth and a tenth an element: nine in ten of its pages have each.
    shared = shared.groupBy("host", "node").agg(
        F.sort_array(F.collect_list(F.when(F.col("missing") == 0, F.col("mark")))).alias("constants"), F.sort_array(F.collect_list(F.when(F.col("missing") > 0, F.col("mark")))).alias("optional_constants")
    )
    above = whole.select("host", F.col("node").alias("parent"), F.col("pages").alias("parent_pages"))
    joined = whole.join(above, ["host", "parent"], "left").join(shared, ["host", "node"], "left")
    optional = F.coalesce(F.col("pages") < F.col("parent_pages"), F.lit(False)).alias("optional")
    none = F.array().cast("array<long>")
    return joined.select("host", "node", "parent", "key", "pages", "texts", optional, "repeated", *[F.coalesce(c, none).alias(c) for c in ("constants", "optional_constants")])


def expression(rows) -> str:
    """One host's wrapper rows as a union-free expression: ``(x)?`` optional, ``(x)+`` repeated, ``=`` a constant, ``#`` a text slot."""
    under: dict = {}
    for row in rows:
        under.setdefault(row["parent"], []).append(row)

    def show(row) -> str:
        inner = f"{'<' + row['key'] + '>' if row['key'] else ''}{'=' * len(row['constants'])}{'(=)?' * len(row['optional_constants'])}#{''.join(show(r) for r in sorted(under.get(row['node'], []), key=lambda r: r['key']))}"
        mark = ("+" if row["repeated"] else "") + ("?" if row["optional"] else "")
        return f"({inner}){mark}" if mark else inner

    known = {row["node"] for row in rows}
    return "".join(show(r) for r in sorted(rows, key=lambda r: r["key"]) if r["parent"] not in known)


def main_text(html: str | None, constants=frozenset()) -> str:
    """The text of a page whose host's wrapper has ``constants`` (signed marks)."""
    kept = [b for b in read_page(html).blocks if not b.dropped]
    inside = [b for b in kept if b.content]
    chosen = inside or kept
    fixed = [b for b in chosen if _signed(b.mark) in constants] if constants else []
    if inside and fixed:
        sizes = {id(b): b.text.count(" ") + 1 for b in inside}
        fixed = [b for b in fixed if sizes[id(b)] <= CONTENT_WORDS]
        if CONTENT_SHARE * sum(sizes[id(b)] for b in fixed) > sum(sizes.values()):
            fixed = []
    if fixed and len(fixed) < len(chosen):
        gone = set(map(id, fixed))
        chosen = [b for b in chosen if id(b) not in gone]
    return "\n\n".join(b.text for b in chosen)


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each row of ``pages(page_id, url, html)``.

    Null or empty html: an empty text. Null url: such pages share a wrapper of their own. Repeated rows get
    equal texts. Empty table: empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    base = pages.select("page_id", "url", "html", host.alias("host"))
    fixed = F.concat("constants", "optional_constants")
    wrappers = infer_wrappers(base.select("host", "html"), CONSTANT_FROM).where(F.size(fixed) > 0)
    constants = checkpointed(wrappers.groupBy("host").agg(F.flatten(F.collect_list(fixed)).alias("constants")))
    marks = constants.select(F.col("host").alias("__host"), "constants")
    joined = base.join(bounded(marks), F.col("host") == F.col("__host"), "left")

    def run(batches):
        last, known = None, frozenset()
        for batch in batches:
            texts = []
            for html, marks in zip(batch.column(2), batch.column(3).to_pylist()):
                if marks != last:
                    last, known = marks, frozenset(marks or ())
                texts.append(main_text(html.as_py(), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "constants").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
