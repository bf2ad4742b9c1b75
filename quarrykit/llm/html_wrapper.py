"""Main text of web pages by wrapper induction over the pages of a host.

*Induction.*  ``REPS`` pages of a host, those with the least hash, are folded into a
skeleton: their DOM trees are aligned by simple tree matching (order-preserving pairs
of children of greatest total match, from the root down; nodes match if tag and class
words are equal, those of equal text attract each other), and what does not match is
added.  Then *every* page of the host is aligned with the skeleton in the same way,
and the texts met in each of its slots are counted.  The counts are sums, so they are
the same however the pages are dealt; a host of any size costs a task its partial
sums.  A text that is in a slot on ``ENOUGH`` pages or more and on ``SHARE`` of those
that have the slot is constant; so is one that moves among a slot's children of one
sign, by the pages that have that slot.  The skeleton's few pages decide where slots
are, not what is counted: a container that matches no slot, on whatever page, counts
by the slot of the nearest node above it that matches one and the signs from there
down (its *way*).  A text that ``ENOUGH`` different pages or more have at the end of a
way, and ``SHARE`` of those that have the way, is constant too; copies of a page are
one page there, so that they make no template of what only they have.

*Extraction.*  A page is aligned once more.  Nodes in a slot with its constant text
are template and go, whatever they are called; varying slots and nodes that match no
slot and no constant way are content.  Navigation, headers, footers, asides, forms, notices, adverts and
comments often vary from page to page, where no count can tell them from content:
these go by their element, role or class.  A class name counts if all of its words
are names of furniture or say where it stands ("main-nav", but not "header-story").
The text comes from the page's article (or main) elements where it has any, else from
the body; inside an article only constant containers go, never paragraphs, headings,
lists or tables, and if a whole page or article is constant (copies of one page)
nothing there is taken for template.

Text: character references are decoded, white space in a block becomes one
space, blocks are trimmed and joined by two line feeds, in page order; a ``<br>``
is white space; table cells of a row share its block.

Cases: a null or empty page gives ''; a null url belongs to the host ''; unclosed
and stray tags are repaired as browsers do for paragraphs and list items; a quote
without its partner ends with its tag; elements may nest at any depth; a host of under
``ENOUGH`` pages has no evidence of what is constant; repeated rows give the same
text; no page is cut or sampled.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.url_reputation import host_and_path
from quarrykit.storage import saved

ENOUGH, SHARE, HOSTS, SUMS, REPS, LOOK, SAME = 3, 0.8, 4000, 200_000, 6, 2, 64

# Element names of the HTML standard by role, and class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu head header".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCK - {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p ul ol li blockquote pre dl dd dt table tbody td th tr figure figcaption".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead footer header topbar toolbar comment comments "
    "commentlist respond reply replies response responses disqus related recommended recommendations share sharing social subscribe subscription newsletter login signup search pagination pager "
    "skip hidden".split()
)
PLACES = frozenset("site main top bottom left right page global user reader readers wrapper container inner outer block box list section area region primary secondary bar group first last item links js fixed sticky mobile desktop has".split())
# Elements that may be constant only if the page is a copy.
WHOLE = frozenset("# html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# A quote opens a value only after "=" and only if it is closed; possessive, so that nothing is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(\bhidden\b)""")


class Node:
    __slots__ = ("bad", "items", "sign", "tag", "text")

    def __init__(self, tag: str, sign: str, bad: bool):
        self.tag, self.sign, self.bad = tag, sign, bad
        self.items: list = []  # nodes and text pieces, in order
        self.text: str | None = None  # plain text, once asked for


def _furniture(tag: str, key: str, value: str) -> bool:
    """Whether a class or an id names furniture: by whole names, and on prose by a class alone."""
    if tag in ("html", "body", "main") or tag in PROSE and key == "id":
        return False
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
        if tag == "article" and not {"comment", "related"}.intersection(words) or tag in PROSE and len(words) > 1:
            continue
        if any(w in WORDS for w in words) and all(w in WORDS or w in PLACES for w in words):
            return True
    return False


def _node(tag: str, attrs: str) -> Node:
    if not attrs or attrs.isspace():
        return Node(tag, tag, tag in FURNITURE)
    names, bad = "", tag in FURNITURE
    for key, value, hidden in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            bad |= _furniture(tag, key, value)
            if key == "class":
                names = ".".join(sorted(w for w in re.split(r"[^a-z0-9]+", value) if w and not w.isdigit()))
        bad |= key == "role" and value in ROLES and tag not in ("html", "body") or hidden == "hidden" or key == "aria-hidden" and value == "true"
    return Node(tag, f"{tag}.{names}" if names else tag, bad)


def parse(page: str) -> Node:
    """DOM of a page; scripts, styles, comments and the like are left out."""
    root = Node("#", "#", False)
    stack, at, skip = [root], 0, None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and skip is None:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and skip is None:
                stack[-1].items.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if skip is not None:
            if m[1] and tag == skip:
                skip = None
            continue
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    # A stray inline end tag does not close blocks around it.
                    if tag in BLOCK or not any(n.tag in BLOCK for n in stack[depth + 1 :]):
                        del stack[depth:]
                    break
            continue
        closed = m[3].endswith("/")
        if tag in RAW:
            if not closed:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P:
            _close(stack, "p", BLOCK - {"p"})
        if tag == "li":
            _close(stack, "li", frozenset(("ul", "ol", "menu")))
        elif tag in ("tr", "td", "th", "dt", "dd"):
            _close(stack, tag, frozenset(("table", "dl", "tr") if tag in ("td", "th") else ("table", "dl")))
        node = _node(tag, m[3])
        stack[-1].items.append(node)
        if tag not in VOID and not closed:
            stack.append(node)
    if at < len(page) and skip is None:
        stack[-1].items.append(page[at:])
    return root


def _close(stack: list[Node], tag: str, walls: frozenset) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            del stack[depth:]
            return
        if stack[depth].tag in walls:
            return


def plain(node: Node) -> str:
    """Text of a node, from the leaves up."""
    todo = [node]
    while todo:
        n = todo[-1]
        if n.text is None and (below := [i for i in n.items if isinstance(i, Node) and i.text is None]):
            todo += below
            continue
        if n.text is None:
            n.text = " ".join(" ".join(i.text if isinstance(i, Node) else html.unescape(i) for i in n.items).split())
        todo.pop()
    return node.text


def _print(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16] if text else ""


# A tree for alignment is a list: sign, prints of its texts, children, and the page's node (None in a skeleton).


def tree(root: Node) -> list:
    """Elements of a page that can be aligned: all but prose in articles, and what is inside prose."""
    out = [root.sign, [_print(plain(root))], [], root]
    todo = [(out, False)]
    while todo:
        top, inside = todo.pop()
        inside = inside or top[3].tag in ("article", "main")
        if top[3].tag in PROSE:
            continue
        for i in top[3].items:
            if isinstance(i, Node) and i.tag not in VOID and not (inside and (i.tag in PROSE or i.tag not in BLOCK)):
                top[2].append([i.sign, [_print(plain(i))], [], i])
                todo.append((top[2][-1], inside))
    return out


def size(a: list, b: list, look: int = LOOK) -> int:
    """Nodes that match between two trees, look levels down, equal texts SAME times; 0 if the roots differ."""
    if a[0] != b[0]:
        return 0
    own = SAME if any(p and p in a[1] for p in b[1]) else 1
    return own + (sum(size(a[2][i], b[2][j], look - 1) for i, j in matching(a[2], b[2], look)) if look and a[2] and b[2] else 0)


def matching(a: list[list], b: list[list], look: int = LOOK) -> list[tuple[int, int]]:
    """Simple tree matching: the order-preserving pairs of children of greatest total match."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i) for i in range(len(a))]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    own = [[size(x, y, look - 1) if look else int(x[0] == y[0]) for y in b] for x in a]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + own[i][j] if own[i][j] else 0)
    out, i, j = [], n, m
    while i and j:
        if own[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + own[i - 1][j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def aligned(a: list, b: list):
    """Pairs of nodes of two trees, from the roots down."""
    todo = [(a, b)] if a[0] == b[0] else []
    while todo:
        x, y = todo.pop()
        yield x, y
        todo += [(x[2][i], y[2][j]) for i, j in matching(x[2], y[2])]


def _bare(t: list) -> list:
    """A copy of a tree without the page's nodes."""
    out = [t[0], t[1], []]
    todo = [(t, out)]
    while todo:
        x, y = todo.pop()
        for c in x[2]:
            y[2].append([c[0], c[1], []])
            todo.append((c, y[2][-1]))
    return out


def folded(trees: list[list]) -> list:
    """The skeleton of some pages: their trees, aligned one after another."""
    out = _bare(trees[0])
    for t in map(_bare, trees[1:]):
        for x, y in list(aligned(out, t)):
            x[1] = sorted({*x[1], *y[1]})
            pairs = matching(x[2], y[2])
            kids, i, j = [], 0, 0
            for p, q in [*pairs, (len(x[2]), len(y[2]))]:  # what stands between two pairs, of either
                kids += x[2][i:p] + y[2][j:q]
                if p < len(x[2]):
                    kids.append(x[2][p])
                i, j = p + 1, q + 1
            x[2] = kids
    return out


def numbered(skeleton: list) -> dict[int, int]:
    """Slot of each node of a skeleton, by identity."""
    out: dict[int, int] = {}
    todo = [skeleton]
    while todo:
        node = todo.pop()
        out[id(node)] = len(out)
        todo += reversed(node[2])
    return out


def _flat(skeleton: list) -> str:
    """A skeleton as JSON: depth, sign and prints of each node in order (lists don't nest, so pages may)."""
    out, todo = [], [(skeleton, 0)]
    while todo:
        node, depth = todo.pop()
        out.append([depth, node[0], node[1]])
        todo += [(c, depth + 1) for c in reversed(node[2])]
    return json.dumps(out, separators=(",", ":"))


def _unflat(flat: str) -> list:
    way: list[list] = []
    for depth, sign, prints in json.loads(flat):
        node = [sign, prints, []]
        del way[depth:]
        if way:
            way[-1][2].append(node)
        way.append(node)
    return way[0]


def _fact(slot: int, sign: str, text: str) -> str:
    return _print(f"{slot} {text} {sign}")


ANY = "*"


def _way(above: str, sign: str) -> str:
    """A way one step down; long ones as a print, so that depth costs nothing."""
    way = f"{above}/{sign}"
    return way if len(way) < 200 else "/" + _print(way)


class Wrapper:
    """Skeleton of a host, and the facts that are constant: a text in a slot, or in a slot's children of one sign."""

    def __init__(self, flat: str, constant: frozenset[str] = frozenset()):
        self.skeleton = _unflat(flat)
        self.slot = numbered(self.skeleton)
        self.constant = constant

    def slots(self, page: Node):
        """(slot, sign, print of the text, node): nodes that match a slot (sign ''), the children of such nodes, and containers that match none (sign: their way)."""
        whole = tree(page)
        todo = [(self.skeleton, whole)] if self.skeleton[0] == whole[0] else []
        while todo:
            x, y = todo.pop()
            slot = self.slot[id(x)]
            yield slot, "", y[1][0], y[3]
            for child in y[2]:
                if child[1][0]:
                    yield slot, child[0], child[1][0], child[3]
            pairs = matching(x[2], y[2])
            todo += [(x[2][i], y[2][j]) for i, j in pairs]
            met = {j for _, j in pairs}
            rest = [(c, "") for j, c in enumerate(y[2]) if j not in met]
            while rest:
                c, way = rest.pop()
                if c[3].tag not in PROSE:
                    way = _way(way, c[0])
                    yield slot, way, c[1][0], c[3]
                    rest += [(k, way) for k in c[2]]

    def facts(self, page: Node) -> set[tuple[int, str, str]]:
        """What a page counts for at slots."""
        return {fact[:3] for fact in self.slots(page) if not fact[1].startswith("/")}

    def counted(self, page: Node) -> tuple[set[tuple[int, str, str]], set[tuple[int, str, str]]]:
        """What a page counts for at slots, and off them: ways, each also with the text ANY."""
        some = [fact[:3] for fact in self.slots(page)]
        return {f for f in some if not f[1].startswith("/")}, {(*f[:2], t) for f in some if f[1].startswith("/") for t in (f[2], ANY)}

    def template(self, page: Node) -> set[int]:
        """Nodes (by identity) whose text is constant where they are."""
        hit = {id(node): node for slot, sign, text, node in self.slots(page) if text and _fact(slot, sign, text) in self.constant} if self.constant else {}
        for whole in [n for n in hit.values() if n.tag in WHOLE]:  # a copy: no evidence inside
            below = [whole]
            while below:
                n = below.pop()
                hit.pop(id(n), None)
                below += [i for i in n.items if isinstance(i, Node)]
        return set(hit)


def induce(pages: list[str]) -> Wrapper:
    """The wrapper of some pages of one host, all at once."""
    roots = [parse(p) for p in pages]
    out = Wrapper(_flat(folded([tree(r) for r in roots[:REPS]])))
    seen = {_print(plain(r)): out.counted(r) for r in roots}
    counts = Counter(fact for r in roots for fact in out.facts(r))
    off = Counter(fact for _, ways in seen.values() for fact in ways)
    have: Counter = Counter()
    for (slot, sign, _), n in counts.items():
        have[slot] += 0 if sign else n
    known = {f: n for f, n in counts.items() if n >= SHARE * have[f[0]]} | {f: n for f, n in off.items() if f[2] != ANY and n >= SHARE * off[(*f[:2], ANY)]}
    out.constant = frozenset(_fact(*f) for f, n in known.items() if f[2] and n >= ENOUGH)
    return out


def extract(page: str, wrapper: Wrapper | None) -> str:
    root = parse(page)
    constant = wrapper.template(root) if wrapper is not None else set()
    roots = _roots(root, "article") or _roots(root, "main")
    blocks: list[str] = []
    for r in roots or [root]:
        _collect(r, blocks, constant, bool(roots))
    return "\n\n".join(blocks)


def _roots(root: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag outside furniture, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            out.append(node)
        else:
            todo += [i for i in reversed(node.items) if isinstance(i, Node) and not i.bad]
    return out


def _collect(root: Node, blocks: list[str], constant: set[int], article: bool) -> None:
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    todo = [(iter(root.items), False, False)]  # what is left of a node, whether only headings count, whether it is a block
    while todo:
        rest, hide, block = todo[-1]
        for item in rest:
            if not isinstance(item, Node):
                if not hide:
                    line.append(html.unescape(item))
                continue
            if item.tag in VOID:
                line.append(" ")
                if item.tag == "hr":
                    flush()
                continue
            if item.tag in BLOCK:
                flush()
            elif item.tag in ("td", "th"):
                line.append(" ")
            own = article and item.tag == "header" and item.sign == "header"  # an article's own header: its headings only
            if id(item) in constant or item.bad and not own:
                continue
            todo.append((iter(item.items), own and item.bad or hide and item.tag not in HEADINGS, item.tag in BLOCK))
            break
        else:
            todo.pop()
            if block:
                flush()
    flush()


def _hosted(pages: DataFrame) -> DataFrame:
    host, _ = host_and_path(F.col("url").cast("string"))
    return pages.select(host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def skeletons(pages: DataFrame) -> DataFrame:
    """host and the skeleton of its REPS pages with the least hash (found in each partition before they are shuffled)."""
    rows = _hosted(pages)
    order = F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("host", "html"), "html"))
    few = rows.where("html <> ''").withColumn("n", order).where(F.col("n") <= REPS)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "skeleton": [_flat(folded([tree(parse(p)) for p in pdf["html"]]))]}, dtype=object)

    return few.groupBy("host").applyInPandas(fold, "host string, skeleton string")


def templates(pages: DataFrame, by_host: DataFrame | None = None) -> DataFrame:
    """host, skeleton and its constant facts (prints, in order), counted over all pages."""
    by_host = skeletons(pages) if by_host is None else by_host
    rows = _hosted(pages).join(by_host, "host")

    def per_task(parts):
        sums: Counter = Counter()
        known: dict[str, Wrapper] = {}
        for pdf in parts:
            for host_, page, flat in zip(pdf["host"], pdf["html"], pdf["skeleton"]):
                root = parse(page)
                facts, ways = _wrapper(known, flat).counted(root)
                sums.update((host_, *fact, "") for fact in facts)
                if ways:
                    text = _print(plain(root))
                    sums.update((host_, *way, text) for way in ways)
                if len(sums) > SUMS:
                    yield _frame(sums)
                    sums.clear()
        yield _frame(sums)

    counted = rows.select("host", "html", "skeleton").mapInPandas(per_task, "host string, slot int, sign string, text string, page string, n long")
    # At a slot pages are counted, at the end of a way different ones.
    each = counted.groupBy("host", "slot", "sign", "text", "page").agg(F.sum("n").alias("n"))
    seen = saved(each.groupBy("host", "slot", "sign", "text").agg(F.sum(F.when(F.startswith("sign", F.lit("/")), 1).otherwise(F.col("n"))).alias("n")), "facts")
    way = F.when(F.startswith("sign", F.lit("/")), F.col("sign")).otherwise("").alias("way")
    had = seen.where((F.col("sign") == "") | F.startswith("sign", F.lit("/")) & (F.col("text") == ANY)).groupBy("host", "slot", way).agg(F.sum("n").alias("pages"))
    constant = seen.where(~F.col("text").isin("", ANY) & (F.col("n") >= ENOUGH)).withColumn("way", way).join(had, ["host", "slot", "way"]).where(F.col("n") >= SHARE * F.col("pages"))
    fact = F.substring(F.md5(F.concat_ws(" ", F.col("slot").cast("string"), "text", "sign").cast("binary")), 1, 16)
    listed = constant.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set(fact)), ",").alias("constant"))
    return by_host.join(listed, "host", "left")


def _wrapper(known: dict, flat: str, constant: str | None = None) -> Wrapper:
    """Wrappers of a task, as many as HOSTS at once."""
    key = flat, constant
    if key not in known:
        if len(known) > HOSTS:
            known.clear()
        known[key] = Wrapper(flat, frozenset((constant or "").split(",")))
    return known[key]


def _frame(sums: Counter) -> pd.DataFrame:
    return pd.DataFrame({name: [k[i] for k in sums] for i, name in enumerate(("host", "slot", "sign", "text", "page"))} | {"n": list(sums.values())}, dtype=object).astype({"n": "int64", "slot": "int32"})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    by_host = saved(templates(pages, saved(skeletons(pages), "skeletons")), "templates")
    host, _ = host_and_path(F.col("url").cast("string"))
    # Extraction aligns only where there is a constant slot.
    with_constant = by_host.where("constant is not null")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host")).join(with_constant, "host", "left").select("page_id", "url", "html", "skeleton", "constant")

    def run(parts):
        known: dict = {}
        for pdf in parts:
            texts = [extract(page, _wrapper(known, flat, constant) if isinstance(flat, str) else None) if page else "" for page, flat, constant in zip(pdf["html"], pdf["skeleton"], pdf["constant"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": pd.Series(texts, index=pdf.index, dtype=object)})

    out = rows.mapInPandas(run, pages.select("page_id").schema.add("url", "string").add("text", "string"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
