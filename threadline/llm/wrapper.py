"""HTML extraction by wrapper induction: trees of pages of one host are aligned by simple tree matching.

Every page is parsed where it lies and summarised as its block tree: block
elements with their classes, runs of like siblings folded to one node, and a
hash of each node's text. Per host the most common tree gives the exemplar (its
smallest page); every other tree of the host is aligned with it by simple tree
matching. A node whose text is that of the exemplar on most aligned pages with
another main text is constant and becomes template; slots that vary are content.
Counts are summed in the tasks before they are shuffled, so a host with a third
of all pages sends a few rows per task. Pages themselves never move unless the
exemplars are too large to be broadcast.

The text of a page is then read from its whole document: its ``article``
elements, else ``main``, else the body, without template nodes, without menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments (by tag, role, and the words of class and id), character references
decoded, white space of a block turned into one space, blocks joined by one.

An element that holds the article is never taken for one of those, whatever its
class says. Headings, paragraphs and list items of an article are never template,
so an article that is repeated on many pages of a host stays.

Defined results: null html is empty and gives an empty text; a null or odd url
has the empty host. Repeated pages are pages of their own. Elements nested more
than 512 deep are siblings. Other columns pass through unless their names are
those of the result.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.frames import fits_broadcast
from threadline.runtime import new_run_dir, stage

#: Pages with another main text that have to hold a node before it can be template.
MIN_PAGES = 3
#: Share of them on which its text is that of the exemplar.
CONSTANT = 0.5
#: Depth of the tree that is aligned; what lies deeper counts to its ancestor there.
ALIGN_DEPTH = 48
#: Bytes of exemplars or templates that tasks may hold.
BROADCAST_BYTES = 16_000_000
_DEEPEST = 512

# Element names and words of the web.
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("html base link meta title noscript noframes style script template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DEAD = frozenset("head script style template svg math object canvas audio video map select button datalist input label fieldset optgroup option".split())
CHROME = frozenset("nav footer aside form dialog menu search".split())
PROTECTED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre td th caption figcaption article main".split())
CHROME_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets related "
    "share sharing social footer toolbar search form".split()
)
#: Only outside of an article.
HEADER_WORDS = frozenset("header masthead banner topbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)"
    rf"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes|noscript)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<open>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})>"
    rf"|</(?P<close>[a-z][^\s/>]*)[^>]*>"
    rf"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_WORD = re.compile(r"[a-z]+")
#: An opening tag ends an open one of these, unless an element of the second set lies between.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
}


class Page:
    """The elements of a page in order (tag, parent, nearest block, name with classes) and its text pieces.

    ``pieces`` are (element, text), or None where a block begins or ends.
    """

    def __init__(self, text: str):
        self.tags, self.parent, self.block, self.names, self.words = ["html"], [-1], [0], ["html"], [frozenset()]
        self.roles, self.pieces = [""], []
        self._parse(text)
        self._mark()

    def _open(self, tag: str, attrs: str, stack: list, opened: dict) -> int:
        words, role, name = frozenset(), "", tag
        if attrs:
            found = {}
            for key, value in _ATTR.findall(attrs):
                found.setdefault(key.lower(), value.strip("\"'"))
            if found:
                plain = _HUMP.sub(r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()
                words, role = frozenset(_WORD.findall(plain)), found.get("role", "").strip().lower()
                if "articlebody" in found.get("itemprop", "").lower():
                    role = "main"
                name = " ".join([tag, *sorted(words)])
        me, up = len(self.tags), stack[-1]
        self.tags.append(tag)
        self.parent.append(up)
        self.block.append(me if tag in BLOCKS else self.block[up])
        self.names.append(name)
        self.words.append(words)
        self.roles.append(role)
        if tag not in VOID and len(stack) < _DEEPEST:
            stack.append(me)
            opened[tag] = opened.get(tag, 0) + 1
        return me

    def _pop_to(self, at: int, stack: list, opened: dict) -> None:
        while len(stack) > at:
            opened[self.tags[stack.pop()]] -= 1

    def _end_implied(self, tag: str, stack: list, opened: dict) -> None:
        if opened.get("head") and tag not in HEAD:
            self._pop_to(next(at for at, i in enumerate(stack) if self.tags[i] == "head"), stack, opened)
        if tag in BLOCKS and opened.get("p"):
            for at in range(len(stack) - 1, 0, -1):
                inner = self.tags[stack[at]]
                if inner == "p":
                    self._pop_to(at, stack, opened)
                    break
                if inner in BLOCKS:
                    break
        if tag in _ENDS:
            ends, between = _ENDS[tag]
            for at in range(len(stack) - 1, 0, -1):
                inner = self.tags[stack[at]]
                if inner in ends:
                    self._pop_to(at, stack, opened)
                    break
                if inner in between:
                    break

    def _close(self, tag: str, stack: list, opened: dict) -> None:
        if not opened.get(tag):
            return
        inline = tag not in BLOCKS
        for at in range(len(stack) - 1, 0, -1):
            inner = self.tags[stack[at]]
            if inner == tag:
                self._pop_to(at, stack, opened)
                return
            if inline and inner in BLOCKS:
                return

    def _parse(self, text: str) -> None:
        stack, opened, pieces, end = [0], {}, self.pieces, 0
        for m in _TOKEN.finditer(text):
            if m.start() > end:
                pieces.append((stack[-1], text[end : m.start()]))
            end = m.end()
            kind = m.lastgroup
            if kind == "attrs":
                tag = m["open"].lower()
                self._end_implied(tag, stack, opened)
                if tag in ("html", "body"):
                    # The root stands for both, whether they are written or not.
                    pieces.append(None)
                elif tag == "br":
                    pieces.append((stack[-1], " "))
                elif tag in BLOCKS:
                    pieces.append(None)
                    self._open(tag, m["attrs"], stack, opened)
                else:
                    self._open(tag, m["attrs"], stack, opened)
            elif kind == "close":
                tag = m["close"].lower()
                if tag in BLOCKS:
                    pieces.append(None)
                self._close(tag, stack, opened)
        if end < len(text):
            pieces.append((stack[-1], text[end:]))

    def _mark(self) -> None:
        """What is no main text (``gone``) and where the main text is (``root``, ``inside``)."""
        n = len(self.tags)
        comment = [bool(w & COMMENT_WORDS) if w else False for w in self.words]
        is_article = [t == "article" and not c for t, c in zip(self.tags, comment, strict=True)]
        is_main = [t == "main" or r == "main" for t, r in zip(self.tags, self.roles, strict=True)]
        holds, heading = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if holds[i] or is_article[i] or is_main[i]:
                holds[up] = True
            if heading[i] or self.tags[i] == "h1":
                heading[up] = True
        gone, within = [False] * n, [False] * n
        for i in range(1, n):
            up, tag, words = self.parent[i], self.tags[i], self.words[i]
            within[i] = within[up] or is_article[i] or is_main[i]
            if gone[up]:
                gone[i] = True
            elif tag in DEAD:
                gone[i] = True
            elif holds[i] or is_article[i] or is_main[i]:
                gone[i] = comment[i] and tag == "article"
            elif tag == "form":
                gone[i] = not heading[i]
            elif tag in CHROME or self.roles[i] in CHROME_ROLES or comment[i] or (words and words & CHROME_WORDS):
                gone[i] = True
            elif not within[up] and (tag == "header" or self.roles[i] == "banner" or (words and words & HEADER_WORDS)):
                gone[i] = True
        live_article = any(a and not g for a, g in zip(is_article, gone, strict=True))
        live_main = any(a and not g for a, g in zip(is_main, gone, strict=True))
        roots = is_article if live_article else is_main if live_main else None
        inside = [roots is None] * n
        if roots is not None:
            for i in range(1, n):
                inside[i] = inside[self.parent[i]] or roots[i]
        self.gone, self.inside, self.rooted = gone, inside, roots is not None

    def text(self, template: frozenset = frozenset()) -> str:
        """The main text; ``template``: block elements whose own text is left out."""
        blocks, now = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if now:
                    blocks.append(" ".join(references.unescape("".join(now)).split()))
                    now = []
            elif self.inside[piece[0]] and not self.gone[piece[0]] and self.block[piece[0]] not in template:
                now.append(piece[1])
        return " ".join(b for b in blocks if b)

    def tree(self) -> tuple[list, list[list[int]]]:
        """The folded block tree and the elements behind each of its nodes, in preorder.

        A node is [name, hash of its own text or "", may be template, children].
        Neighbouring siblings with equal names are one node.
        """
        kids: list[list[int]] = [[] for _ in self.tags]
        own: dict[int, list[str]] = {}
        for i in range(1, len(self.tags)):
            if self.tags[i] in BLOCKS and not self.gone[i]:
                kids[self.block[self.parent[i]]].append(i)
        for piece in self.pieces:
            if piece is not None and not self.gone[piece[0]]:
                own.setdefault(self.block[piece[0]], []).append(piece[1])
        behind: list[list[int]] = []

        def fold(group: list[int], depth: int) -> list:
            behind.append(list(group))
            below = [k for i in group for k in kids[i]]
            deep: list[int] = []
            if depth >= ALIGN_DEPTH:
                deep, at = list(below), 0
                while at < len(deep):
                    deep.extend(kids[deep[at]])
                    at += 1
                behind[-1].extend(deep)
                below = []
            said = " ".join(" ".join(own.get(i, ())) for i in (*group, *deep)).split()
            mark = hashlib.blake2b(" ".join(said).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if said else ""
            first = group[0]
            may = not (self.rooted and self.inside[first] and self.tags[first] in PROTECTED)
            runs: list[list[int]] = []
            for k in below:
                if runs and self.names[runs[-1][-1]] == self.names[k]:
                    runs[-1].append(k)
                else:
                    runs.append([k])
            return [self.names[first], mark, int(may), [fold(r, depth + 1) for r in runs]]

        return fold([0], 0), behind

    def main_hash(self) -> str:
        return hashlib.blake2b(self.text().encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def preorder(tree: list) -> list[list]:
    """The nodes of a tree; parents stand before their children."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node[3]))
    return out


def skeleton(tree: list) -> str:
    """A hash of the names and their nesting."""
    out, todo = [], [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {node[0]}")
        todo.extend((k, depth + 1) for k in reversed(node[3]))
    return hashlib.blake2b("\n".join(out).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching: the largest set of matched nodes (preorder numbers) that keeps names, order and levels.

    Roots have to match; children are aligned by a DP over both child lists,
    weighted by the size of the best matching below each pair.
    """
    number: dict[int, int] = {}
    for tree in (a, b):
        number.update({id(n): k for k, n in enumerate(preorder(tree))})

    def matched(x: list, y: list) -> tuple[int, list]:
        if x[0] != y[0]:
            return 0, []
        m, n = len(x[3]), len(y[3])
        size = [[0] * (n + 1) for _ in range(m + 1)]
        pairs: dict[tuple[int, int], tuple[int, list]] = {}
        for i in range(1, m + 1):
            row, above = size[i], size[i - 1]
            for j in range(1, n + 1):
                row[j] = max(row[j - 1], above[j])
                if x[3][i - 1][0] == y[3][j - 1][0]:
                    pairs[i, j] = found = matched(x[3][i - 1], y[3][j - 1])
                    row[j] = max(row[j], above[j - 1] + found[0])
        found, i, j = [(number[id(x)], number[id(y)])], m, n
        while i and j:
            if (i, j) in pairs and size[i][j] == size[i - 1][j - 1] + pairs[i, j][0]:
                found += pairs[i, j][1]
                i, j = i - 1, j - 1
            elif size[i][j] == size[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return 1 + size[m][n], found

    return matched(a, b)[1]


def _aligned(exemplar: list, tree: list, same: bool) -> list[tuple[int, int]]:
    """Trees with one skeleton match node by node."""
    return [(k, k) for k in range(len(preorder(tree)))] if same else align(exemplar, tree)


_TREES = pa.schema([("host", pa.string()), ("mark", pa.int64()), ("skeleton", pa.string()), ("main", pa.string()), ("tree", pa.string())])


def _summaries(batches):
    for batch in batches:
        out = []
        for host, mark, text in zip(*(batch.column(c).to_pylist() for c in ("host", "mark", "html")), strict=True):
            page = Page(text)
            tree, _ = page.tree()
            out.append((host, mark, skeleton(tree), page.main_hash(), json.dumps(tree, separators=(",", ":"))))
        yield pa.RecordBatch.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(_TREES)}, schema=_TREES)


_COUNTS = pa.schema([("host", pa.string()), ("node", pa.int32()), ("pages", pa.int64()), ("equal", pa.int64())])


def _evidence(batches):
    """Per host and exemplar node: pages with another main text that have it, and those with the same text there."""
    read: dict[str, tuple[list, list]] = {}
    for batch in batches:
        counts: dict[tuple[str, int], list[int]] = {}
        rows = zip(*(batch.column(c).to_pylist() for c in ("host", "skeleton", "main", "tree", "best_skeleton", "best_main", "best_tree")), strict=True)
        for host, shape, main, tree, best_shape, best_main, best_tree in rows:
            if main == best_main:
                continue
            if best_tree not in read:
                if len(read) > 256:
                    read.clear()
                whole = json.loads(best_tree)
                read[best_tree] = whole, preorder(whole)
            exemplar, nodes = read[best_tree]
            own = json.loads(tree)
            mine = preorder(own)
            for a, b in _aligned(exemplar, own, shape == best_shape):
                if nodes[a][1]:
                    both = counts.setdefault((host, a), [0, 0])
                    both[0] += 1
                    both[1] += nodes[a][1] == mine[b][1]
        keys = list(counts)
        columns = {"host": [k[0] for k in keys], "node": [k[1] for k in keys], "pages": [counts[k][0] for k in keys], "equal": [counts[k][1] for k in keys]}
        yield pa.RecordBatch.from_pydict(columns, schema=_COUNTS)


def _texts(pages: list[str], exemplars: list[str | None], constants: list[list[int] | None], read: dict) -> list[str]:
    """The main texts of pages; ``read`` keeps parsed exemplars."""
    texts = []
    for text, best, constant in zip(pages, exemplars, constants, strict=True):
        page = Page(text)
        template: set[int] = set()
        if constant:
            if best not in read:
                if len(read) > 256:
                    read.clear()
                whole = json.loads(best)
                read[best] = whole, preorder(whole), skeleton(whole)
            exemplar, nodes, shape = read[best]
            tree, behind = page.tree()
            mine, of = preorder(tree), set(constant)
            for a, b in _aligned(exemplar, tree, skeleton(tree) == shape):
                if a in of and nodes[a][1] == mine[b][1] and mine[b][2]:
                    template.update(behind[b])
        texts.append(page.text(frozenset(template)))
    return texts


def _extract(batches):
    read: dict[str, tuple[list, list, str]] = {}
    for batch in batches:
        texts = _texts(*(batch.column(c).to_pylist() for c in ("html", "best_tree", "constant")), read)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def host(url: Column) -> Column:
    """The host of an address in lower case, without user and port; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def _small(df: DataFrame, text: str) -> bool:
    return fits_broadcast(df, BROADCAST_BYTES // 100) and (df.agg(F.sum(F.length(text))).first()[0] or 0) <= BROADCAST_BYTES


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: (host, tree, constant): its exemplar tree as JSON, and the template nodes' preorder numbers.

    ``constant`` lists all template nodes; of an article's own headings,
    paragraphs and items none is left out at extraction (the tree's third field).
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(host(F.col("url")).alias("host"), F.xxhash64("url", "html").alias("mark"), text.alias("html"))
    trees = stage(rows.mapInArrow(_summaries, "host string, mark bigint, skeleton string, main string, tree string"), new_run_dir(spark, "wrapper-trees"))
    shapes = trees.groupBy("host", "skeleton").agg(F.count("*").alias("n"), F.min(F.struct("mark", "main", "tree")).alias("first"))
    best = shapes.groupBy("host").agg(F.max(F.struct("n", "skeleton", F.col("first.main"), F.col("first.tree"))).alias("b"))
    best = best.select("host", F.col("b.skeleton").alias("best_skeleton"), F.col("b.main").alias("best_main"), F.col("b.tree").alias("best_tree"))
    best = stage(best, new_run_dir(spark, "wrapper-best"))
    joined = trees.join(F.broadcast(best) if _small(best, "best_tree") else best, "host")
    counts = joined.select(*[f for f in joined.columns if f != "mark"]).mapInArrow(_evidence, "host string, node int, pages bigint, equal bigint")
    counts = counts.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal"))
    constant = counts.where((F.col("pages") >= MIN_PAGES) & (F.col("equal") >= CONSTANT * F.col("pages")))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("constant"))
    return best.select("host", F.col("best_tree").alias("tree")).join(constant, "host", "left").withColumn("constant", F.coalesce("constant", F.array().cast("array<int>")))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, ...) with ``text``, the main text, and without ``html``."""
    spark = pages.sparkSession
    known = stage(wrappers(pages).where("size(constant) > 0"), new_run_dir(spark, "wrapper"))
    kept = [c for c in pages.columns if c not in ("html", "text")]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html")
    )
    hosts = known.select("host", F.col("tree").alias("best_tree"), "constant")
    joined = rows.join(F.broadcast(hosts) if _small(hosts, "best_tree") else hosts, "host", "left")
    read = joined.select("row", "html", "best_tree", "constant")
    fields = read.schema["row"].dataType.simpleString()
    return read.mapInArrow(_extract, f"row {fields}, text string").select("row.*", "text")
