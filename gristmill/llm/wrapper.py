"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching. Nodes whose text is the same on all of them are the host's
template; slots whose text varies are candidates for content, and the part of the tree with most varying text that
isn't marked as anything else is the article. Pages are folded into a template one by one and templates into each
other, so any split of a host's pages over tasks can be merged.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, kept, prepare

#: Elements whose content isn't shown as text of the article.
SKIPPED = frozenset("script style noscript template head title meta link nav header footer aside form button select option textarea input iframe object svg canvas menu dialog label fieldset datalist math".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that come in rows: sisters of one label are one slot, as are so many of any other element (with a class).
REPEATED, MANY = frozenset("p li tr td th dt dd option blockquote pre h2 h3 h4 h5 h6 figure img hr".split()), 4
#: What an open element is closed by.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: Words in class, id or role that mark what isn't the article.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|login|social|share|sharing|related|recommend\w*|widget|pagination|pager|toolbar|search|complementary|contentinfo|skip-link)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=$|[\s/"'])""", re.I)


@dataclass
class Node:
    """label: tag, and what of class, id and role has no digits (numbers tell pages apart, not their parts)."""

    tag: str
    label: str
    skip: bool
    parts: list = field(default_factory=list)  # text and nodes in order


def parse(page: str) -> Node:
    """A tolerant reader: unclosed elements end with their parent, stray end tags are ignored, attributes may hold '>'."""
    root = Node("#root", "#root", False)
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            stack[-1].parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            if m[0] == "<":
                stack[-1].parts.append("<")
            continue
        tag = tag.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        while len(stack) > 1:
            i = len(stack) - 1
            while i > 0 and stack[i].tag in INLINE:
                i -= 1
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                del stack[i:]
            else:
                break
        skip, label = tag in SKIPPED, tag
        if attributes:
            found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)} if re.search("class|id|role", attributes, re.I) else {}
            names = " ".join(v for k, v in found.items() if k in ("class", "id", "role") and v)
            skip = skip or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or tag not in ("html", "body", "article", "main") and bool(MARKED.search(names))
            label = f"{tag}.{names}" if names and not re.search(r"\d", names) else tag
        node = Node(tag, label, skip)
        stack[-1].parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag in ("path", "use"):
            continue
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = closed.end() if closed else end
            continue
        stack.append(node)
        if len(stack) > 400:  # deeper nesting is read on as siblings
            stack.pop()
    return root


@dataclass
class Slot:
    """A node of a template: text is the same on all pages so far, or None once it varied; chars are of all its pages."""

    label: str
    skip: bool
    text: str | None = ""
    chars: int = 0
    pages: int = 1
    below: list[Slot] = field(default_factory=list)
    loose: int = 0  # characters of slots below that too few of its pages had

    def shape(self) -> str:
        return f"{self.label}({','.join(x.shape() for x in self.below)})" if self.below else self.label


def block_children(node: Node) -> Iterator[Node]:
    """The nodes below that aren't inline; those within inline ones count as the node's own."""
    for p in node.parts:
        if isinstance(p, Node):
            if p.tag in INLINE:
                yield from block_children(p)
            else:
                yield p


def own_text(node: Node) -> str:
    """Text of the node and of the inline elements in it."""
    return "".join(p if isinstance(p, str) else " " if p.tag == "br" else "" if p.skip else own_text(p) if p.tag in INLINE else " " for p in node.parts)


def tidy(text: str) -> str:
    return " ".join(text.split())


def slots(node: Node, where: dict[int, int] | None = None, order: list[Slot] | None = None) -> Slot:
    """The page as a template of one page; sisters in a row may share a slot. where: slot number by node."""
    return run_of([node], where, order)


def run_of(nodes: list[Node], where: dict[int, int] | None, order: list[Slot] | None) -> Slot:
    texts = [tidy(own_text(n)) for n in nodes]
    joined = "\0".join(texts) if len(texts) > 1 else texts[0]
    out = Slot(nodes[0].label, nodes[0].skip, blake2b(joined.encode("utf-8", "replace"), digest_size=8).hexdigest() if joined else "", sum(map(len, texts)))
    if order is not None:
        for n in nodes:
            where[id(n)] = len(order)
        order.append(out)
    if not nodes[0].skip:
        for _, group in groupby((c for x in nodes for c in block_children(x)), key=lambda n: n.label):
            group = list(group)
            if group[0].tag in REPEATED or len(group) >= (MANY if "." in group[0].label else 10 * MANY):
                out.below.append(run_of(group, where, order))
            else:
                out.below += [run_of([n], where, order) for n in group]
    return out


def numbered(slot: Slot, out: list[Slot]) -> list[Slot]:
    out.append(slot)
    for x in slot.below:
        numbered(x, out)
    return out


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest number of nodes, roots included, that agree in order, and which children pair up.

    Equal subtrees at both ends of the children pair up at once, so the table is only as large as what lies between.
    """
    if a.label != b.label:
        return 0, []
    same = lambda x, y: x is y or x.label == y.label and len(x.below) == len(y.below) and all(map(same, x.below, y.below))
    size = lambda x: 1 + sum(map(size, x.below))
    first, least = 0, min(len(a.below), len(b.below))
    while first < least and same(a.below[first], b.below[first]):
        first += 1
    last = 0
    while last < least - first and same(a.below[-1 - last], b.below[-1 - last]):
        last += 1
    if first + last:
        total = sum(map(size, a.below[:first])) + sum(map(size, a.below[len(a.below) - last :]))
        count, inner = match(Slot(a.label, a.skip, below=a.below[first : len(a.below) - last]), Slot(b.label, b.skip, below=b.below[first : len(b.below) - last]))
        ends = [(len(a.below) - last + k, len(b.below) - last + k) for k in range(last)]
        return count + total, [(k, k) for k in range(first)] + [(i + first, j + first) for i, j in inner] + ends
    n, m = len(a.below), len(b.below)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    took = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            w = best[i - 1][j - 1] + (match(a.below[i - 1], b.below[j - 1])[0] if a.below[i - 1].label == b.below[j - 1].label else 0)
            best[i][j], took[i][j] = max((w, 1), (best[i - 1][j], 2), (best[i][j - 1], 3), key=lambda x: (x[0], -x[1]))
    pairs, i, j = [], n, m
    while i and j:
        if took[i][j] == 1:
            if a.below[i - 1].label == b.below[j - 1].label:
                pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif took[i][j] == 2:
            i -= 1
        else:
            j -= 1
    return best[n][m] + 1, pairs[::-1]


class Aligner:
    """Aligns and merges templates; alignments of shapes met before are remembered (a bounded number)."""

    def __init__(self, most: int = 5000):
        self.most, self.known = most, {}

    def pairs(self, a: Slot, b: Slot) -> list[tuple[int, int]]:
        """Numbers, in depth-first order, of the nodes of a and b that agree."""
        key = (a.shape(), b.shape())
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            ia, ib = {id(s): i for i, s in enumerate(numbered(a, []))}, {id(s): i for i, s in enumerate(numbered(b, []))}
            out: list[tuple[int, int]] = []

            def walk(x: Slot, y: Slot) -> None:
                out.append((ia[id(x)], ib[id(y)]))
                for i, j in match(x, y)[1]:
                    walk(x.below[i], y.below[j])

            if a.label == b.label:
                walk(a, b)
            self.known[key] = out
        return self.known[key]

    def merge(self, a: Slot, b: Slot) -> Slot:
        """Fold b into a: agreeing nodes are joined; what only b has is put in where it stands."""
        same_shape = a.shape() == b.shape()
        na, nb = numbered(a, []), numbered(b, [])
        found = [(i, i) for i in range(len(na))] if same_shape else self.pairs(a, b)
        partner = {j: i for i, j in found}
        for i, j in found:
            x, y = na[i], nb[j]
            x.text = x.text if x.text == y.text else None
            x.chars, x.pages, x.skip, x.loose = x.chars + y.chars, x.pages + y.pages, x.skip or y.skip, x.loose + y.loose
        if not same_shape:
            number = {id(s): j for j, s in enumerate(nb)}
            for i, j in found:
                below, at = na[i].below, 0
                for y in nb[j].below:
                    k = partner.get(number[id(y)])
                    if k is None:
                        below.insert(at, y)
                        at += 1
                    else:
                        at = next(p for p, s in enumerate(below) if s is na[k]) + 1
        return a


def pack(slot: Slot) -> list:
    return [slot.label, int(slot.skip), slot.text, slot.chars, slot.pages, [pack(x) for x in slot.below], slot.loose]


def unpack(x: list) -> Slot:
    return Slot(x[0], bool(x[1]), x[2], x[3], x[4], [unpack(y) for y in x[5]], x[6])


#: Templates are broadcast up to so many bytes in all.
BROADCAST_BYTES = 32 << 20
#: Of the slots below one, those stay that one in so many of its pages has: a template is at most so many times as large as a page.
RARE = 16


def pruned(slot: Slot) -> Slot:
    """Without slots that few pages have, which can't be template; their text counts as varying text of what they are in."""
    stay = []
    for x in slot.below:
        if x.pages * RARE < slot.pages:
            slot.loose += written(x)
        else:
            stay.append(pruned(x))
    slot.below = stay
    return slot


def varying(slot: Slot) -> int:
    """Characters of text that differs between pages, in all unmarked slots below."""
    return 0 if slot.skip else slot.loose + (slot.chars if slot.text is None else 0) + sum(map(varying, slot.below))


def written(slot: Slot) -> int:
    return 0 if slot.skip else slot.loose + slot.chars + sum(map(written, slot.below))


def verdict(root: Slot) -> tuple[Slot, set[int]]:
    """The slot that holds the article, and the slots within it that are template (by id).

    With two or more pages that differ, measured by varying text, else by all text. An article or main element that
    has half of it is the article; else it is the deepest node that has most of it. A constant slot in it is template
    if three pages or more and most of those that have the article have it, and most of the article's text varies;
    headings are the page's own.
    """
    measure = varying if varying(root) else written
    total = measure(root)
    body = root
    best = None
    for s in numbered(root, []):
        if s.label.split(".")[0] in ("article", "main") and not s.skip and 2 * measure(s) >= total > 0 and (best is None or measure(s) >= measure(best)):
            best = s
    if best is None:
        best = body
        while True:
            step = max(best.below, key=measure, default=None)
            if step is None or step.skip or 10 * measure(step) < 7 * total or step.label.split(".")[0] in ("p", "li", "td", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol", "table", "tbody", "tr"):
                break
            best = step
    fixed: set[int] = set()
    if 2 * varying(best) > written(best):
        fixed = {id(s) for s in numbered(best, []) if s is not best and s.text and s.pages >= 3 and 2 * s.pages > best.pages and s.label.split(".")[0] not in ("h1", "h2", "h3", "h4", "h5", "h6") and not varying(s)}
    return best, fixed


def blocks(node: Node, drop: set[int], out: list[str], line: list[str]) -> None:
    """Append the text of each block below node to out; line gathers the block that is open."""
    for p in node.parts:
        if isinstance(p, str):
            line.append(p)
        elif p.skip or id(p) in drop:
            continue
        elif p.tag == "br":
            line.append(" ")
        elif p.tag in INLINE:
            blocks(p, drop, out, line)
        else:
            flush(out, line)
            blocks(p, drop, out, line)
            flush(out, line)


def flush(out: list[str], line: list[str]) -> None:
    text = tidy("".join(line))
    line.clear()
    if text:
        out.append(text)


def article(page: str | None, template: Slot | None, aligner: Aligner) -> str:
    """The page's article, in blocks joined by empty lines; a page that doesn't fit its template is judged by itself."""
    if not page:
        return ""
    root = parse(page)
    where: dict[int, int] = {}
    order: list[Slot] = []
    own = slots(root, where, order)
    chosen, drop_slots = None, set()
    if template is not None and template.pages > 1:
        own_order = {id(s): i for i, s in enumerate(numbered(own, []))}
        best, fixed = verdict(template)
        nt, n_own = numbered(template, []), numbered(own, [])
        for i, j in aligner.pairs(template, own):
            if nt[i] is best and written(n_own[j]):
                chosen = n_own[j]
            if id(nt[i]) in fixed and n_own[j].text == nt[i].text:
                drop_slots.add(own_order[id(n_own[j])])
        drop_slots = {id(n_own[j]) for j in drop_slots}
    if chosen is None:
        chosen, drop_slots = verdict(own)[0], set()
    index = {id(s): i for i, s in enumerate(order)}
    mine = index[id(chosen)]
    dropped = {index[i] for i in drop_slots}
    out: list[str] = []
    drop = {n for n, i in where.items() if i in dropped}
    nodes = [n for n in walk_nodes(root) if where.get(id(n)) == mine]
    for n in nodes:
        line: list[str] = []
        blocks(n, drop, out, line)
        flush(out, line)
    return "\n\n".join(out)


def walk_nodes(node: Node) -> Iterator[Node]:
    yield node
    for p in node.parts:
        if isinstance(p, Node):
            yield from walk_nodes(p)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def fold(rows: Iterable[tuple[str, str]], aligner: Aligner) -> dict[str, Slot]:
    """Templates by host of (host, page)."""
    out: dict[str, Slot] = {}
    for host, page in rows:
        if page:
            own = slots(parse(page))
            out[host] = pruned(aligner.merge(out[host], own)) if host in out else own
    return out


def once_each(rows: DataFrame) -> DataFrame:
    """rows(host, html) without repeats. Only rows whose hash occurs again in their host are exchanged whole."""
    hashed = rows.withColumn("__hash", F.xxhash64("html"))
    again = kept(hashed.groupBy("host", "__hash").agg(F.count("*").alias("__n")).filter("__n > 1").select("host", "__hash"), "repeats")
    again = broadcast_if_small(again, again.count(), 100_000)
    alone = hashed.join(again, ["host", "__hash"], "left_anti").select("host", "html")
    return alone.union(hashed.join(again, ["host", "__hash"], "left_semi").select("host", "html").distinct())


def induce(pages: DataFrame, url: str = "url", html: str = "html", salts: int = 16) -> DataFrame:
    """(host, template) of all pages, copies within a host counted once. Each task folds the pages of its batches, then salted groups, then hosts are merged."""
    prepare(pages.sparkSession)
    rows = once_each(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for b in batches:
            found = fold(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), aligner)
            yield pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "template": pa.array([json.dumps(pack(t)) for t in found.values()], pa.string())})

    def merged(group: pa.Table) -> pa.Table:
        aligner, out = Aligner(), None
        for t in sorted(group.column("template").to_pylist()):
            t = unpack(json.loads(t))
            out = t if out is None else pruned(aligner.merge(out, t))
        return pa.table({"host": pa.array([group.column("host")[0].as_py()], pa.string()), "template": pa.array([json.dumps(pack(out))], pa.string())})

    first = kept(rows.mapInArrow(partial, "host string, template string"), "part-templates")
    most = first.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    salts = max(salts, math.isqrt(most) + 1)  # a task folds no more than about the root of a host's part templates
    salted = first.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(salts))).groupBy("host", "salt").applyInArrow(merged, "host string, template string")
    return salted.groupBy("host").applyInArrow(merged, "host string, template string")


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text (the main text; '' for null, empty or textless pages) and n_chars of every page.

    A host's pages are read three times or four: to find copies, to induce its template, to extract. Templates are no larger than some
    pages and joined by host; a page without a host has the host ''. Repeated rows are extracted again but
    count once as pages of their host; a host of one page, or of copies of one, has no varying slots and is judged by its marks.
    """
    templates = kept(induce(pages, url, html), "templates")
    size = templates.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    templates = (F.broadcast(templates) if size <= BROADCAST_BYTES else templates).withColumnsRenamed({"host": "__host", "template": "__template"})
    rows = pages.select(*keep, F.col(html).alias("__html"), host_of(F.col(url)).alias("__h"))
    rows = rows.join(templates, F.col("__h") == F.col("__host"), "left").drop("__host", "__h")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]) + ", text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = Aligner(), {}
        for b in batches:
            texts = []
            for page, template in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                if template not in known:
                    if len(known) > 500:
                        known.clear()
                    known[template] = unpack(json.loads(template)) if template else None
                texts.append(article(page, known[template], aligner))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
