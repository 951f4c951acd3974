"""Main text of web pages by wrappers inferred from pages of one host.

A page is a stream of tags and texts. All pages of a host are aligned into one union-free regular
expression, each task's into a partial one and these into the host's: elements of one kind that repeat
next to each other fold into a repeated group, elements that only some pages have become optional,
texts that differ become slots, texts that all pages share stay constants. The regular expression tells
which region holds the host's changing text (its main region): the article or main element with
most of it or, on a host of ``KINDS`` pages or more without such elements, the element that one
reaches from the page's top as long as one container holds over half of the slots' text and no
changing heading, paragraph, list or bare text stands beside it. Every page is matched against the
expression along the way to that region: at each level its elements are aligned with the expression's,
and those that match the region's node, repeats and sibling articles included, are read. A page that
does not match, or whose host has no wrapper, is read by tags and names alone.

Furniture (menus, notices) goes by tags and names. A name counts as a whole: a class or id of a
container with one of the words of ``NAMES`` and none of ``QUALIFIERS``, so that "has-sidebar" or
"category-social" deletes nothing; and not if the element holds an article or main element or, on a
page without these and but for readers' comments, over half of the page's text (``MUCH`` characters at least). Paragraphs, headings and the like never go by name.

A line of the main region, unless it is a heading, belongs to the template if at least ``SHARE`` of the host's different
texts have it, ``KINDS`` texts at least, counted over all pages. Near copies count once: texts that
share one of their ``TOP`` longest lines, and all texts that are mostly made of lines that half of
the host's texts have. A host whose pages all are such keeps all lines, as nothing tells a template
from an article there.

Defined results: a null or empty html gives an empty text; a page without a host shares the
wrapper of such pages; markup that is never closed ends with the page; whole pages are read,
whatever their length. Elements below ``DEEPEST``
levels are no nodes of the tree: their texts, still cut into blocks, belong to the element above
them, and those that are furniture go. Sibling streams of more than ``EXACT_CELLS`` pairs are
aligned greedily instead of by the longest common subsequence; an alignment of more than ``WIDEST``
siblings keeps those that most pages have.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import cut, ship
from weft.llm.components import components

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Tags that end one block of text and begin another.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Regions that never are main text, by tag and by the words of class, id and role.
FURNITURE = frozenset("nav footer aside form header button dialog menu head".split())
NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words with which a class speaks about the page, not about what the element is.
QUALIFIERS = frozenset("category format has hide is layout no not post show status tag type with without".split())
REPLIES = frozenset("comment comments disqus replies reply".split())
#: Elements that a name can make furniture.
NAMED = frozenset("aside center details dialog div dl fieldset figure ol section table ul".split())
HEADINGS = frozenset("caption dt figcaption h1 h2 h3 h4 h5 h6 legend summary th".split())
ROLES = frozenset("banner complementary contentinfo dialog form menu navigation search".split())
_CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


DEEPEST = 200
EXACT_CELLS = 1 << 20
_AHEAD = 256  # how far the greedy alignment looks for a match
WIDEST = 1 << 14
_LONG = 200  # characters from which a wrapper keeps a text as its beginning and hash
SHARE, KINDS, TOP = 0.8, 4, 3
MUCH = 200
_CONTAINERS = frozenset("#page html body center div section table tbody td tr".split())
_HOSTS = 512  # partial wrappers that a task holds at once


@dataclass
class Element:
    tag: str
    key: str  # tag and names: what alignment compares
    furniture: bool = False
    inside: bool = False  # an article or main, or within one
    children: list = field(default_factory=list)  # elements and texts, in page order
    named: bool = False  # furniture by a name, which its content may refute


def _names(attrs: str) -> tuple[list[str], set[str], set[str]]:
    """Words of class and id, those that tell what the element is, and roles."""
    words, kinds, roles = [], set(), set()
    for m in _NAME.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            roles.add(value.strip().lower())
            continue
        for name in value.split():
            of = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            words += of
            if not QUALIFIERS.intersection(of):
                kinds.update(of)
    return words, kinds, roles


def parse(page: str | None) -> Element:
    """The blocks of a page as a tree; inline tags vanish, ``br`` is white space."""
    root = Element("#page", "#page")
    stack = [root]
    open_tags: Counter[str] = Counter()
    suspects: list[tuple[Element, bool]] = []
    articles = 0
    text = page or ""
    at = 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            stack[-1].children.append(_html.unescape(text[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in ("br", "wbr"):
            stack[-1].children.append(" ")
        if tag not in BLOCKS and tag not in ("head", "button", "main"):
            continue
        if m["close"]:
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    open_tags.subtract(e.tag for e in stack[i:])
                    del stack[i:]
                    break
                if tag == "p" or (stack[i].tag in ("td", "th", "table", "article", "body") and tag in ("li", "dd", "dt")):
                    break
            else:
                continue
            stack[-1].children.append(_BREAK)
            continue
        while len(stack) > 1 and tag in _CLOSED_BY.get(stack[-1].tag, ()):
            open_tags[stack.pop().tag] -= 1
        words, kinds, roles = _names(m["attrs"] or "") if m["attrs"] else ([], (), ())
        # classes of articles and pages tell their subject, which varies: they are no part of the key
        new = Element(tag, tag if tag in ("article", "main", "body", "html") else " ".join([tag, *words]))
        above = stack[-1]
        new.inside = above.inside or tag in ("article", "main")
        new.furniture = (tag in FURNITURE and not (tag == "header" and above.inside)) or (tag not in ("article", "main", "body", "html") and bool(ROLES.intersection(roles)))
        if not new.furniture and tag in NAMED and NAMES.intersection(kinds):
            new.furniture = new.named = True
            suspects.append((new, bool(REPLIES.intersection(kinds))))
        articles += tag in ("article", "main")
        if tag in ("article", "main"):  # what holds an article is no furniture by name
            for e in stack:
                if e.named and e.furniture and not any(x.furniture and not x.named for x in stack):
                    e.furniture = False
        if len(stack) <= DEEPEST:
            above.children.append(new)
        else:
            above.children.append(_BREAK)
            if not new.furniture:
                new.children = above.children
        if tag not in VOID:
            stack.append(new)
            open_tags[tag] += 1
    if at < len(text):
        stack[-1].children.append(_html.unescape(text[at:]))
    held = [] if articles else [(e, _size(e)) for e, replies in suspects if e.furniture and not replies]
    if held:
        rest = _size(root)  # outside all furniture
        total = rest + sum(n for e, n in held)
        for e, n in held:
            if 2 * n > total and n >= MUCH:
                e.furniture = False
    return root


def _size(e: Element) -> int:
    """Characters of text below, without furniture."""
    n, stack = 0, [e]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                n += len(c)
            elif not c.furniture:
                stack.append(c)
    return n


class _Break(str):
    """Where a block ends."""


_BREAK = _Break("")


def blocks(e: Element, path: tuple[str, ...] = (), all_: bool = False) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, text) of each block below ``e`` that is not furniture."""
    run: list[str] = []

    def flush() -> Iterator[tuple[tuple[str, ...], str]]:
        line = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if line:
            yield path, line

    for c in e.children:
        if c is _BREAK:
            yield from flush()
        elif isinstance(c, str):
            run.append(c)
        else:
            yield from flush()
            if all_ or not c.furniture:
                yield from blocks(c, (*path, c.key), all_)
    yield from flush()


# -- inference ------------------------------------------------------------------------------------


@dataclass
class Node:
    """Part of a wrapper: an element, or a text (key ``#``)."""

    key: str
    optional: bool = False
    repeated: bool = False
    furniture: bool = False
    seen: int = 1  # pages
    texts: list = field(default_factory=list)  # of a text: those met, until it is a slot
    slot: bool = False
    mass: int = 0  # of a text: characters on all pages
    children: list = field(default_factory=list)


def _of_page(e: Element) -> Node:
    out = Node(e.key, furniture=e.furniture)
    run: list[str] = []

    def flush() -> None:
        line = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if line:
            out.children.append(Node("#", texts=[line if len(line) <= _LONG else f"{line[:64]}... {xxhash.xxh3_64_hexdigest(line.encode('utf-8', 'surrogatepass'))}"], mass=len(line)))

    for c in e.children:
        if c is _BREAK:
            flush()
        elif isinstance(c, str):
            run.append(c)
        else:
            flush()
            out.children.append(_of_page(c))
    flush()
    out.children = _fold(out.children)
    return out


def _fold(nodes: list[Node]) -> list[Node]:
    """Neighbours that match each other become one repeated group."""
    out: list[Node] = []
    for n in nodes:
        if out and out[-1].key == n.key and _alike({c.key for c in out[-1].children}, {c.key for c in n.children}):
            last = out.pop()
            seen = max(last.seen, n.seen)
            last = _merge(last, n)
            last.repeated, last.seen = True, seen
            out.append(last)
        else:
            out.append(n)
    return out


def _alike(a: set[str], b: set[str]) -> bool:
    """Whether elements with these children can be repeats of one group."""
    return 2 * len(a & b) >= min(len(a), len(b))


def _kind(n: Node) -> tuple[str, set[str]]:
    return n.key, {c.key for c in n.children}


def _same(x: tuple[str, set[str]], y: tuple[str, set[str]]) -> bool:
    """Whether two siblings match: by tag and names, and by what they hold."""
    return x[0] == y[0] and (x[1] == y[1] or _alike(x[1], y[1]))


def _merge(a: Node, b: Node) -> Node:
    """One node for two that match."""
    out = Node(a.key, a.optional or b.optional, a.repeated or b.repeated, a.furniture or b.furniture, a.seen + b.seen)
    if a.key == "#":
        out.mass = a.mass + b.mass
        out.slot = a.slot or b.slot or a.texts != b.texts
        out.texts = [] if out.slot else a.texts
        return out
    out.children = align(a.children, b.children)
    return out


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Two sibling streams as one: matches merge, the rest become optional."""
    x, y = [_kind(n) for n in a], [_kind(n) for n in b]
    out, i, j = [], 0, 0
    same = next((k for k, (m, n) in enumerate(zip(x, y)) if not _same(m, n)), min(len(x), len(y)))
    p, q = x[same:], y[same:]
    rest = _longest(p, q) if len(p) * len(q) <= EXACT_CELLS else _greedy(p, q)
    for to_i, to_j in [*((k, k) for k in range(same)), *((same + k, same + m) for k, m in rest), (len(x), len(y))]:
        for n in (*a[i:to_i], *b[j:to_j]):
            n.optional = True
            out.append(n)
        if to_i < len(x):
            out.append(_merge(a[to_i], b[to_j]))
        i, j = to_i + 1, to_j + 1
    if len(out) > WIDEST:
        most = sorted(range(len(out)), key=lambda k: (-out[k].seen, k))[:WIDEST]
        out = [out[k] for k in sorted(most)]
    return _fold(out)


def _longest(x: list[tuple[str, set[str]]], y: list[tuple[str, set[str]]]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    n, m = len(x), len(y)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = max(common[i + 1][j], common[i][j + 1], common[i + 1][j + 1] + 1 if _same(x[i], y[j]) else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if common[i][j] == common[i + 1][j + 1] + 1 and _same(x[i], y[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif common[i + 1][j] >= common[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _greedy(x: list[tuple[str, set[str]]], y: list[tuple[str, set[str]]]) -> list[tuple[int, int]]:
    """Positions of a common subsequence, each the next one near by; linear in the streams."""
    out, j = [], 0
    for i, kind in enumerate(x):
        at = next((k for k in range(j, min(len(y), j + _AHEAD)) if _same(kind, y[k])), None)
        if at is not None:
            out.append((i, at))
            j = at + 1
    return out


def expression(n: Node) -> str:
    """The wrapper as text: ``(...)+`` repeats, ``(...)?`` is optional, ``#`` is a slot."""
    inner = "#" if n.slot else json.dumps(n.texts[0]) if n.key == "#" else f"<{n.key}>{''.join(map(expression, n.children))}</>"
    return f"({inner})+" if n.repeated and not n.optional else f"({inner})*" if n.repeated else f"({inner})?" if n.optional else inner


def _pack(n: Node) -> list:
    return [n.key, n.optional, n.repeated, n.furniture, n.seen, n.texts, n.slot, n.mass, [_pack(c) for c in n.children]]


def _unpack(x: list) -> Node:
    return Node(*x[:8], [_unpack(c) for c in x[8]])


def main_region(wrapper: Node) -> list[list]:
    """The way to the region with the host's changing text: at each level the expression's siblings
    (key, keys of their children) and the place of the right one; empty for the whole page."""
    weights: dict[int, tuple[float, int]] = {}
    best: list = [0.0, []]

    def weigh(n: Node, way: list) -> tuple[float, int]:
        """Characters below, without furniture, constants weigh less; and of slots alone."""
        if n.furniture:
            return 0.0, 0
        if n.key == "#":
            mass, slots = n.mass * (1 if n.slot or wrapper.seen == 1 else 0.2), n.mass * n.slot
        else:
            below = [weigh(c, [*way, (n, i)]) for i, c in enumerate(n.children)]
            mass, slots = sum(x for x, _ in below), sum(x for _, x in below)
            if n.key in ("article", "main") and (mass > best[0] or (mass == best[0] and len(way) < len(best[1]))):
                best[:] = [mass, way]
        weights[id(n)] = mass, slots
        return mass, slots

    def steps(way: list) -> list[list]:
        return [[[[k, sorted(below)] for k, below in map(_kind, n.children)], i] for n, i in way]

    weigh(wrapper, [])
    if best[0] > 0:
        return steps(best[1])
    if wrapper.seen < KINDS:
        return []
    at, way = wrapper, []
    while True:
        changing = [(i, c) for i, c in enumerate(at.children) if weights.get(id(c), (0, 0))[1] > 0]
        if not changing or not all(c.key.split(" ")[0] in _CONTAINERS for _, c in changing):
            break
        i, most = min(changing, key=lambda x: (-weights[id(x[1])][1], x[0]))
        if 2 * weights[id(most)][1] <= weights[id(at)][1]:
            break
        at, way = most, [*way, (at, i)]
    return steps(way)


def template_lines(texts: list[list[str]]) -> list[str]:
    """The template of a host whose pages have these lines; what ``templates`` finds by Spark."""
    kinds = {frozenset(x) for x in texts if x}
    shared = Counter(x for s in kinds for x in s)
    often = {x for x, k in shared.items() if k > 1 and 2 * k >= len(kinds)}
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s in kinds:
        own = s - often
        if 4 * sum(map(len, own)) < sum(map(len, s)):
            root[find(s)] = find("mostly shared")
        else:
            for x in sorted(own, key=lambda x: (-len(x), x))[:TOP]:
                root[find(s)] = find(("line", x))
    groups = {find(s) for s in kinds}
    have = Counter(x for x, _ in {(x, find(s)) for s in kinds for x in s & often})
    return sorted(x for x, k in have.items() if len(groups) >= KINDS and k >= SHARE * len(groups))


def infer(pages: list[str | None]) -> dict:
    """The wrapper of a host: its expression, main region (path of keys) and template texts."""
    trees = [parse(p) for p in pages]
    wrapper = None
    for t in trees:
        node = _of_page(t)
        wrapper = node if wrapper is None else _merge(wrapper, node)
    steps = main_region(wrapper) if wrapper else []
    template = template_lines([[x for x, heading in _lines(t, steps) if not heading] for t in trees])
    return {"expression": expression(wrapper) if wrapper else "", "main": [siblings[i][0] for siblings, i in steps], "steps": steps, "template": template}


def _match(e: Element, steps: list[list]) -> list[Element]:
    """The elements of a page that match the region's node of the expression."""
    level = [e]
    for siblings, at in steps:
        wanted = [(k, set(below)) for k, below in siblings]
        found: list[Element] = []
        for x in level:
            # the page's siblings as the expression has them: texts and repeats are one each
            groups: list[list] = []
            kinds: list[set[str]] = []
            text = False
            for c in x.children:
                if isinstance(c, str):
                    if c is _BREAK:
                        text = False
                    elif not text and c.strip():
                        groups.append([None])
                        kinds.append(set())
                        text = True
                    continue
                text = False
                inside = {y.key for y in c.children if not isinstance(y, str)} | ({"#"} if any(isinstance(y, str) and y.strip() for y in c.children) else set())
                if groups and groups[-1][0] is not None and groups[-1][0].key == c.key and _alike(kinds[-1], inside):
                    groups[-1].append(c)
                    kinds[-1] |= inside
                else:
                    groups.append([c])
                    kinds.append(inside)
            mine = [("#" if g[0] is None else g[0].key, inside) for g, inside in zip(groups, kinds)]
            tag = wanted[at][0].split(" ")[0]
            if tag in ("article", "main"):
                found += [c for g in groups for c in g if c is not None and c.tag == tag and not c.furniture]
                continue
            pairs = _longest(mine, wanted) if len(mine) * len(wanted) <= EXACT_CELLS else _greedy(mine, wanted)
            found += [c for i, j in pairs if j == at for c in groups[i] if not c.furniture]
        level = found
    return level


def _region(e: Element) -> list[Element]:
    """The article or main element with most text, anywhere outside furniture, and those beside it."""
    found, most = [], -1
    stack = [(e, e)]
    while stack:
        x, above = stack.pop()
        if x.furniture:
            continue
        if x.tag in ("article", "main"):
            size = sum(len(t) for _, t in blocks(x))
            if size > most:
                found, most = [c for c in above.children if isinstance(c, Element) and c.tag == x.tag and not c.furniture], size
            continue
        stack += [(c, x) for c in x.children if isinstance(c, Element)]
    return found


def _lines(tree: Element, steps: list[list]) -> list[tuple[str, bool]]:
    """The main region's lines, and whether each is a heading."""
    regions = (_match(tree, steps) if steps else []) or _region(tree) or [tree]
    return [(t, (path[-1] if path else e.key).split(" ")[0] in HEADINGS) for e in regions for path, t in blocks(e)]


def apply(page: str | None, wrapper: dict | None) -> str:
    template = set(wrapper["template"]) if wrapper else ()
    return "\n".join(t for t, heading in _lines(parse(page), wrapper["steps"] if wrapper else []) if heading or t not in template)


# -- Spark ----------------------------------------------------------------------------------------


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def learn(pages: DataFrame) -> DataFrame:
    """_host, _wrapper (packed): all pages of each host, aligned."""
    ship(pages.sparkSession)
    schema = "_host string, _part int, _wrapper string"

    def align_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Node] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"_host": list(held), "_wrapper": [json.dumps(_pack(n)) for n in held.values()]}, dtype=object)
            held.clear()
            return out

        for batch in batches:
            for of, page in zip(batch["_host"], batch["html"]):
                node = _of_page(parse(page if isinstance(page, str) else None))
                held[of] = _merge(held[of], node) if of in held else node
                if len(held) >= _HOSTS:
                    yield flush()
        yield flush()

    def add(g: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for x in sorted(g["_wrapper"]):
            node = _unpack(json.loads(x))
            wrapper = node if wrapper is None else _merge(wrapper, node)
        return pd.DataFrame({"_host": [g["_host"].iloc[0]], "_part": [-1], "_wrapper": [json.dumps(_pack(wrapper))]})

    parts = pages.select(host(F.col("url")).alias("_host"), "html").mapInPandas(align_rows, "_host string, _wrapper string").select("_host", (F.spark_partition_id() % 64).alias("_part"), "_wrapper")
    # two levels, so that no task gets the partial wrappers of all tasks
    level = parts.groupBy("_host", "_part").applyInPandas(add, schema)
    return cut(level.groupBy("_host").applyInPandas(add, schema).select("_host", "_wrapper"))


def read_along(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, _host, _lines (text, heading): of every page the lines of its main region."""

    @F.pandas_udf("string")
    def region(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: json.dumps(main_region(_unpack(json.loads(x)))))

    known = cut(wrappers.select(F.col("_host").alias("_of"), region("_wrapper").alias("_main")))
    size = known.agg(F.coalesce(F.sum(F.length("_of") + F.length("_main") + 100), F.lit(0))).first()[0]

    @F.pandas_udf("t array<string>, h array<boolean>")
    def lines(page: pd.Series, main: pd.Series) -> pd.DataFrame:
        steps = {m: json.loads(m) for m in set(main) if isinstance(m, str)}
        found = [_lines(parse(p if isinstance(p, str) else None), steps.get(m, [])) for p, m in zip(page, main)]
        return pd.DataFrame({"t": pd.Series([[t for t, _ in x] for x in found], dtype=object), "h": pd.Series([[h for _, h in x] for x in found], dtype=object)})

    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host"))
    joined = keyed.join(F.broadcast(known) if size < 24e6 else known, F.col("_host") == F.col("_of"), "left")
    return joined.select("page_id", "url", "_host", lines("html", "_main").alias("_read")).select("page_id", "url", "_host", F.col("_read.t").alias("_lines"), F.col("_read.h").alias("_headings"))


def templates(read: DataFrame) -> DataFrame:
    """_of, _template (hashes of lines) of the hosts that have one. read: _host, _lines, _headings."""
    read = read.withColumn("_lines", F.filter("_lines", lambda x, i: ~F.get(F.col("_headings"), i)))
    line = F.transform(F.array_distinct("_lines"), lambda x: F.struct(F.char_length(x).alias("n"), F.xxhash64(x).alias("h")))
    kinds = read.filter(F.size("_lines") > 0).select("_host", F.array_sort(line).alias("_set")).distinct()
    kinds = cut(kinds.select("_host", F.xxhash64("_host", "_set").alias("_kind"), "_set"))
    total = kinds.groupBy(F.col("_host").alias("_of")).agg(F.count("*").alias("_all"))
    counts = kinds.select("_host", F.explode("_set.h").alias("_h")).groupBy("_host", "_h").agg(F.count("*").alias("_k")).filter("_k > 1")
    # of each host at most twice the lines of its mean page
    often = cut(counts.join(total, F.col("_host") == F.col("_of")).filter("2 * _k >= _all").groupBy("_of").agg(F.collect_list("_h").alias("_often")))
    few = often.agg(F.coalesce(F.sum(F.size("_often") * 8 + 100), F.lit(0))).first()[0] < 24e6

    def weight(x):
        return F.aggregate(x, F.lit(0).cast("long"), lambda t, y: t + y["n"])

    at = kinds.join(F.broadcast(often) if few else often, F.col("_host") == F.col("_of"), "left").withColumn("_often", F.coalesce("_often", F.array().cast("array<bigint>")))
    at = at.withColumn("_own", F.filter("_set", lambda x: ~F.array_contains("_often", x["h"]))).withColumn("_mostly", 4 * weight("_own") < weight("_set"))
    at = cut(at.select("_host", "_kind", "_mostly", F.array_intersect("_set.h", "_often").alias("_has"), F.slice(F.reverse("_own"), 1, TOP)["h"].alias("_top")))
    # texts that share one of their longest lines hang together
    tops = at.filter("not _mostly").select("_kind", F.explode("_top").alias("_h"), "_host").select("_kind", F.xxhash64("_host", "_h").alias("_l"))
    first = tops.groupBy(F.col("_l").alias("_x")).agg(F.min("_kind").alias("a"), F.max("_kind").alias("_z")).filter("a < _z")
    links = tops.join(first, F.col("_l") == F.col("_x")).filter("a <> _kind").select("a", F.col("_kind").alias("b"))
    roots = components(links)
    group = F.when(F.col("_mostly"), F.lit(0).cast("long")).otherwise(F.coalesce("root", "_kind")).alias("_group")
    grouped = cut(at.join(roots, F.col("_kind") == F.col("v"), "left").select("_host", group, "_has"))
    groups = grouped.select("_host", "_group").distinct().groupBy(F.col("_host").alias("_o")).agg(F.count("*").alias("_groups"))
    have = grouped.select("_host", "_group", F.explode("_has").alias("_h")).distinct().groupBy("_host", "_h").agg(F.count("*").alias("_k"))
    found = have.join(groups, F.col("_host") == F.col("_o")).filter((F.col("_groups") >= KINDS) & (F.col("_k") >= SHARE * F.col("_groups")))
    return cut(found.groupBy(F.col("_host").alias("_of")).agg(F.collect_list("_h").alias("_template")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    read = cut(read_along(pages, learn(pages)))
    known = templates(read.select("_host", "_lines", "_headings"))
    few = known.agg(F.coalesce(F.sum(F.size("_template") * 8 + 100), F.lit(0))).first()[0] < 24e6
    joined = read.join(F.broadcast(known) if few else known, F.col("_host") == F.col("_of"), "left").withColumn("_template", F.coalesce("_template", F.array().cast("array<bigint>")))
    kept = F.filter("_lines", lambda x, i: F.get(F.col("_headings"), i) | ~F.array_contains("_template", F.xxhash64(x)))
    out = joined.select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
