"""HTML extraction by wrapper induction.

Pages of a host share a template. Every page's DOM tree is folded (siblings of the same label become one node), which
leaves few distinct trees a host; these are merged into the host's template by simple tree matching (Yang 1991): equal
roots match, and their children are aligned in order for the greatest number of matched nodes. Every folded node of
every page then falls on a template node, a slot. A block that has the same text in the same slot on nearly all of the
host's distinct pages is template, also between siblings that vary; blocks that vary are content.

Not all that varies is the article: menus, adverts and footers vary too. Elements made for these, by tag, by role, or as
blocks whose class or id says nothing else (`ad-slot`, but neither `search-term` nor a phrase in a sentence), are left
out. If a page has a main element only its inside counts, and of that its articles if it has any; without main, the
page's articles. What is left is given as blocks in page order.

At scale: pages are read twice and never shuffled whole. The first reading gives one short row a page (folded tree,
hashes of the slots' texts); trees are counted before they are merged, in salted parts of a host first, and a part's
state is one template. The second reading meets a table with one short row a host.

Edge cases: a null, empty or tagless text is a page without blocks or with one; unclosed, crossed and unknown tags are
repaired as browsers do in the simple cases; a null url is a host of its own; pages of a host whose
content is the same, whatever stands around it, count once for the template and have a row each; hosts with fewer than
`FEWEST` pages of different content have no constant blocks, as agreement of two says nothing; an article's headings
stay; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import staged
from turnstile.llm.url_filter import host_of

#: Distinct pages a host needs for constant blocks, and the share of them that must agree.
FEWEST, SHARE = 3, 0.9
#: Elements nested deeper are taken as siblings.
DEEPEST = 150
#: Parts of a host's trees that are merged apart before they are merged with each other.
SALTS = 16

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select title noembed noframes object".split())
FOREIGN = frozenset(("svg", "math"))  # the only ones of these that "/>" closes
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that close an open element of the given kinds, and where the search for it ends.
CLOSES = {t: ("p",) for t in BLOCKS} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "body": ("html",)}
# Elements that are not part of an article, by tag, role, and words of class or id.
NOT_TEXT = frozenset("nav aside footer form button dialog menu script style noscript template iframe svg math textarea select title head".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies disqus related recommended recommendations pagination pager toolbar widget widgets search skip".split()
)
# Words that say nothing of an element's purpose next to one of these.
PLAIN_WORDS = frozenset("area bar block body bottom box btn button buttons card container content footer form global group header icons inner item items left link links list main middle outer page panel post reader right section site slot text thread title top unit user wrap wrapper".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element: label (tag and the words of its class), children; whether it is boilerplate (`skip`), or a block that
    its class or id names so (`named`). `kids` holds text too."""

    __slots__ = ("tag", "label", "kids", "skip", "named")

    def __init__(self, tag: str, label: str, skip: bool, named: bool = False):
        self.tag, self.label, self.skip, self.named = tag, label, skip, named
        self.kids: list[Node | str] = []


def _purpose(token: str) -> bool:
    """Whether a class or id names boilerplate and nothing else."""
    words = [w.lower() for w in _WORDS.findall(token)]
    return not NOT_WORDS.isdisjoint(words) and all(w in NOT_WORDS or w in PLAIN_WORDS for w in words)


def _made(tag: str, attributes: str) -> Node:
    if not attributes.strip():
        return Node(tag, tag, tag in NOT_TEXT)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    tokens = found.get("class", "").split() + found.get("id", "").split()
    skip = tag in NOT_TEXT or found.get("role", "").lower() in NOT_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    named = False
    if tag not in ("html", "body", "main"):
        skip = skip or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        named = tag in BLOCKS and any(map(_purpose, tokens))
    return Node(tag, ".".join([tag, *sorted({w.lower() for t in tokens for w in _WORDS.findall(t)})]), skip, named)


def parse(source: str) -> Node:
    """DOM tree of a page."""
    root = Node("#", "#", False)
    stack, at = [root], 0

    def text(to: int) -> None:
        if to > at:
            stack[-1].kids.append(source[at:to])

    while (m := _TAG.search(source, at)) is not None:
        text(m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # A block that is open inside stays; an end tag of a phrase does not close it.
            if depth and (tag in BLOCKS or not any(n.tag in BLOCKS for n in stack[depth + 1 :])):
                del stack[depth:]
            continue
        ends = CLOSES.get(tag)
        if ends:
            scope = SCOPES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in scope or stack[i].tag in BLOCKS and "p" not in ends and tag not in SCOPES:
                    break
            if stack[-1].tag == "p":
                stack.pop()
        attributes = m[3] if m[2] else m[6]
        node = _made(tag, attributes or "")
        stack[-1].kids.append(node)
        closed = (attributes or "").rstrip().endswith("/")
        if tag in FOREIGN and closed:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not closed and len(stack) < DEEPEST:
            stack.append(node)
    text(len(source))
    return root


# --- folded trees -----------------------------------------------------------------------------------------------

#: A folded node: [label, children]; a template node: [label, children, slot number].


def folded(root: Node) -> tuple[list, dict[int, int]]:
    """(folded tree, number in preorder of the folded node that each element, by id(), belongs to)."""
    number: dict[int, int] = {}
    seen = 0

    def fold(nodes: list[Node]) -> list:
        nonlocal seen
        number.update((id(n), seen) for n in nodes)
        seen += 1
        groups: dict[str, list[Node]] = {}
        for n in nodes:
            for k in n.kids:
                if isinstance(k, Node):
                    groups.setdefault(k.label, []).append(k)
        return [nodes[0].label, [fold(same) for same in groups.values()]]

    return fold([root]), number


def _topmost(node: Node, tag: str, left_out: Callable[[Node], bool]) -> Iterator[Node]:
    for k in node.kids:
        if isinstance(k, Node) and not left_out(k):
            if k.tag == tag:
                yield k
            else:
                yield from _topmost(k, tag, left_out)


def regions(root: Node) -> list[Node]:
    """The elements that hold the main text: the articles of main, main, or the articles of the page; none: the page.

    Teasers and comments can be articles too: those named so, or in an element that is left out, count if no other does.
    """
    mains = list(_topmost(root, "main", lambda n: False))
    for left_out in (lambda n: n.skip or n.named, lambda n: n.skip):
        articles = [a for m in mains or [root] for a in _topmost(m, "article", left_out)]
        if articles:
            return articles
    return mains


def pieces(root: Node, number: dict[int, int]) -> list[tuple[int, str, bool]]:
    """(folded node, text, whether a heading of the article) of the blocks of a page outside boilerplate, in page order."""
    out: list[tuple[int, str, bool]] = []
    parts: list[str] = []

    def flush(owner: Node, inside: bool) -> None:
        text = " ".join(html_lib.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((number[id(owner)], text, inside and owner.tag in HEADINGS))

    def walk(node: Node, owner: Node, inside: bool) -> None:
        block = node.tag in BLOCKS
        if block:
            flush(owner, inside)
        if node.skip or node.named or node.tag == "header" and not inside:
            return
        mine = node if block else owner
        for k in node.kids:
            if isinstance(k, str):
                parts.append(k)
            elif k.tag == "br":
                parts.append(" ")
            else:
                walk(k, mine, inside)
        if block:
            flush(node, inside)

    found = regions(root)
    for node in found or [root]:
        node.skip = node.named = False
        walk(node, node, bool(found))
        flush(node, bool(found))
    return out


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: greatest number of matched nodes below two nodes of one label, and the pairs of children."""
    m, n = len(a[1]), len(b[1])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    gain = [[0] * n for _ in range(m)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            gain[i][j] = 1 + matching(x, y)[0] if x[0] == y[0] else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n], pairs[::-1]


def merged(template: list | None, tree: list) -> list:
    """The template with the nodes of a tree that it lacks, each after the one before it."""
    if template is None:
        return [tree[0], [merged(None, c) for c in tree[1]]]
    partner = {j: i for i, j in matching(template, tree)[1]}
    out, i = [], 0
    for j, child in enumerate(tree[1]):
        if j in partner:
            out += template[1][i : partner[j]]
            out.append(merged(template[1][partner[j]], child))
            i = partner[j] + 1
        else:
            out.append(merged(None, child))
    return [template[0], out + template[1][i:]]


def slots(template: list, tree: list) -> list[int]:
    """The slot (preorder number in the template) of each node of a tree in preorder; -1: none."""

    def sizes(node: list) -> int:
        return 1 + sum(map(sizes, node[1]))

    def walk(t: list | None, number: int, node: list) -> Iterator[int]:
        yield number if t is not None else -1
        partner = {j: i for i, j in matching(t, node)[1]} if t is not None else {}
        starts, at = [], number + 1
        for c in t[1] if t is not None else ():
            starts.append(at)
            at += sizes(c)
        for j, child in enumerate(node[1]):
            i = partner.get(j)
            yield from walk(t[1][i], starts[i], child) if i is not None else walk(None, -1, child)

    return list(walk(template, 0, tree))


# --- Spark jobs -------------------------------------------------------------------------------------------------


_NODES = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.int64())]))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _first_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents, trees, nodes = [], [], []
        for source in batch.column("html").to_pylist():
            root = parse(source or "")
            tree, number = folded(root)
            found = pieces(root, number)
            contents.append(_hash("\n".join(t for _, t, _ in found)))
            trees.append(json.dumps(tree, separators=(",", ":"), ensure_ascii=False))
            nodes.append([{"place": i, "text": h} for i, h in sorted({(i, _hash(t)) for i, t, heading in found if not heading})])
        columns = [batch.column("host"), pa.array(contents, pa.int64()), pa.array(trees, pa.string()), pa.array(nodes, _NODES)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "content", "tree", "nodes"])


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, salt, tree) sorted by host and salt: one template for each of these."""
    key, template = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([json.dumps(template, separators=(",", ":"), ensure_ascii=False)])], ["host", "tree"])

    for batch in batches:
        for host, salt, tree in zip(batch.column("host").to_pylist(), batch.column("salt").to_pylist(), batch.column("tree").to_pylist(), strict=True):
            if key != (host, salt):
                if key is not None:
                    yield row()
                key, template = (host, salt), None
            template = merged(template, json.loads(tree))
    if key is not None:
        yield row()


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [slots(json.loads(t), json.loads(s)) for t, s in zip(batch.column("template").to_pylist(), batch.column("tree").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("tree"), pa.array(found, pa.list_(pa.int32()))], ["host", "tree", "slots"])


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON), constant (slot and hash of its constant blocks) of the hosts that have such; pages: host, html."""
    first = staged(pages.mapInArrow(_first_reading, "host string, content long, tree string, nodes array<struct<place:int,text:bigint>>"), "wrapper-pages")
    # Copies of an article say nothing about the template, whatever stands around them: one of each.
    distinct = staged(first.groupBy("host", "content").agg(F.min(F.struct("tree", "nodes")).alias("one")).select("host", "one.*"), "wrapper-distinct")
    trees = staged(distinct.groupBy("host", "tree").agg(F.count("*").alias("pages")), "wrapper-trees")

    def merge(rows: DataFrame, salt) -> DataFrame:
        keyed = rows.select("host", salt.cast("int").alias("salt"), "tree")
        return keyed.repartition("host", "salt").sortWithinPartitions("host", "salt", "tree").mapInArrow(_merging, "host string, tree string")

    parts = merge(trees, F.pmod(F.xxhash64("tree"), F.lit(SALTS)))
    template = staged(merge(parts, F.lit(0)).withColumnRenamed("tree", "template"), "wrapper-templates")
    placed = trees.join(template, trees["host"].eqNullSafe(template["host"])).select(trees["host"], "tree", "template")
    placed = staged(placed.mapInArrow(_slotted, "host string, tree string, slots array<int>"), "wrapper-slots")

    # The blocks of a slot, counted over distinct pages: (host, tree, place, text) first, then by slot.
    own = distinct.select("host", "tree", F.inline("nodes"))
    counted = own.groupBy("host", "tree", "place", "text").agg(F.count("*").alias("c"))
    by_place = placed.select("host", "tree", F.posexplode("slots").alias("place", "slot"))
    joined = counted.join(by_place, counted["host"].eqNullSafe(by_place["host"]) & (counted["tree"] == by_place["tree"]) & (counted["place"] == by_place["place"]))
    blocks = joined.where("slot >= 0").select(counted["host"], "slot", "text", "c").groupBy("host", "slot", "text").agg(F.sum("c").alias("c"))
    whole = trees.groupBy("host").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= FEWEST)
    constant = blocks.join(whole.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("c") >= SHARE * F.col("pages"))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("slot", "text"))).alias("constant"))
    return template.withColumnRenamed("host", "of").join(constant, F.col("of").eqNullSafe(F.col("host"))).select("host", "template", "constant")


def _second_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        texts = []
        for source, template, constant in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), batch.column("constant").to_pylist(), strict=True):
            root = parse(source or "")
            tree, number = folded(root)
            found = pieces(root, number)
            if template is not None:
                key = (template, json.dumps(tree))
                if key not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    known[key] = slots(json.loads(template), tree)
                same = {(c["slot"], c["text"]) for c in constant}
                found = [p for p in found if p[2] or (known[key][p[0]], _hash(p[1])) not in same]
            texts.append("\n".join(text for _, text, _ in found))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def extracted(pages: DataFrame, carry: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """row (the columns `carry`), text: the main text of every page."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    wrapper = staged(templates(rows.select("host", "html")), "wrapper-constants")
    met = rows.join(wrapper, "host", "left").select("row", "html", "template", "constant")
    schema = T.StructType([rows.schema["row"]]).add("text", "string")
    return met.mapInArrow(_second_reading, schema)
