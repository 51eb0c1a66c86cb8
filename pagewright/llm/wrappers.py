"""HTML extraction by wrapper induction.

Pages are parsed once, in Arrow batches, into a skeleton (the DOM tree of element names and classes, each sibling a
node of its own) and the text pieces of its slots, numbered in order. A host's distinct skeletons are folded into
the host's wrapper by simple tree matching: the ordered alignment of two trees that pairs the most nodes; what
has no partner becomes an optional node. Each slot of a skeleton is thereby a slot of the wrapper.

A piece belongs to the template if its own text stands in its wrapper slot on at least ``SHARE`` of the host's pages,
counted exactly; all else is content, also in a slot that holds template pieces on other pages. Counting is plain
aggregation, so a host may have any number of pages; its skeletons are folded some hundred at a time, and the wrappers
that they make in turn.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import small, written
from .urls import host

DEPTH, SHARE = 100, 0.5
#: Cells of an alignment's table that may be held; skeletons of a host that meet in one call.
CELLS, MEET = 1 << 22, 512
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>", re.S)
_CLASS = re.compile(r"""(?:class|id)\s*=\s*["']?\s*([A-Za-z_][\w-]*)""", re.I)
_VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style head noscript template svg".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in _BLOCK}


class Node:
    __slots__ = ("label", "children", "text")

    def __init__(self, label: str, text: str | None = None):
        self.label, self.children, self.text = label, [], text


def parse(html: str) -> tuple[Node, list[Node]]:
    """The body's tree and its text nodes in order; hidden elements are left out.

    What is nested beyond DEPTH hangs on its ancestor at that depth; such elements are open and end like others.
    """
    root = Node("")
    stack, tags, open_, texts, at, hidden = [root], [""], Counter(), [], 0, 0

    def say(piece: str) -> None:
        piece = entities.unescape(piece) if "&" in piece else piece
        piece = " ".join(piece.split())
        if piece and not hidden:
            last = stack[-1].children[-1] if stack[-1].children else None
            if last is not None and last.text is not None:
                last.text += " " + piece
            else:
                node = Node("#", piece)
                stack[-1].children.append(node)
                texts.append(node)

    def cut(i: int) -> None:
        """End the elements from the i-th open one."""
        open_.subtract(tags[i:])
        del stack[i:], tags[i:]

    depth_of_hidden = []
    pos, end = 0, len(html)
    while True:
        m = _TAG.search(html, pos)
        if m is None:
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = pos = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in _HIDDEN:
                if depth_of_hidden and depth_of_hidden[-1] == name:
                    depth_of_hidden.pop()
                    hidden = len(depth_of_hidden)
            elif not hidden and open_[name] > 0:
                cut(max(i for i in range(len(tags)) if tags[i] == name) if tags[-1] != name else len(tags) - 1)
            continue
        if name == "body":
            depth_of_hidden, hidden = [], 0  # an unclosed head ends here
        if name in _RAW:
            close = _RAW[name].search(html, at)
            at = pos = close.end() if close else end
            continue
        if name in _HIDDEN:
            if not m.group(3).endswith("/"):
                depth_of_hidden.append(name)
                hidden = len(depth_of_hidden)
            continue
        if hidden or name == "br" or name in _VOID:
            continue
        close = _CLOSES.get(name)
        if close:
            for i in range(len(stack) - 1, 0, -1):
                tag = tags[i]
                if tag in close:
                    cut(i)
                    break
                if tag in _BLOCK and tag != "p" or tag in ("li", "td", "th"):
                    break
        attributes = m.group(3)
        found = _CLASS.search(attributes) if attributes else None
        if attributes.endswith("/"):
            continue
        if len(stack) > DEPTH:
            stack.append(stack[-1])
        else:
            stack.append(Node(f"{name}.{found.group(1)}" if found else name))
            stack[-2].children.append(stack[-1])
        tags.append(name)
        open_[name] += 1
    if at < end:
        say(html[at:])
    return root, texts


def spelt(root: Node | Tree) -> str:
    """A tree as text, which ``read`` reads."""
    out: list[str] = []

    def say(node) -> None:
        out.append(node.label)
        for i, c in enumerate(node.children):
            out.append("," if i else "(")
            say(c)
        if node.children:
            out.append(")")

    say(root)
    return "".join(out)


def skeleton(html: str) -> tuple[str, list[int], list[str]]:
    """The tree, the slots of its text nodes and their texts, in order."""
    root, texts = parse(html)
    return spelt(root), list(range(len(texts))), [t.text for t in texts]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for x in batch.column(2):
            value = x.as_py()
            if value is None:
                rows.append((None, None, None))
            else:
                rows.append(skeleton(value))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
            names=["h", "key", "tree", "texts"],
        )


# --- simple tree matching -------------------------------------------------------------------------------------


class Tree:
    """A skeleton or wrapper node; ``slots`` names what maps to a text node: wrapper slot numbers."""

    __slots__ = ("label", "children", "size", "slot", "shape")

    def __init__(self, label: str, children: list[Tree], slot: int = -1):
        self.label, self.children, self.slot = label, children, slot
        self.size = 1 + sum(c.size for c in children)
        self.shape = hash((label, tuple(c.shape for c in children)))


def read(text: str) -> Tree:
    """The tree of a skeleton, its slots numbered in order."""
    count = 0
    stack: list[list[Tree]] = [[]]
    names: list[str] = []
    for token in re.findall(r"[(),]|[^(),]+", text if text[:1] not in ("(", "") else "^" + text):
        if token == "(":
            names.append(stack[-1].pop().label)
            stack.append([])
        elif token == ")":
            children = stack.pop()
            stack[-1].append(Tree(names.pop(), children))
        elif token != ",":
            stack[-1].append(Tree(token, [], count if token == "#" else -1))
            count += token == "#"
    return stack[0][0]


def _weights(a: list[Tree], b: list[Tree], memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, x, y): child i of a and child j of b make w[x[i], y[j]] pairs; a row and a column for each distinct shape."""
    kinds, at = [], []
    for side in (a, b):
        seen: dict[int, int] = {}
        at.append(np.array([seen.setdefault(c.shape, len(seen)) for c in side], np.int64))
        kinds.append(list({c.shape: c for c in side}.values()))
    w = np.array([[matched(x, y, memo) for y in kinds[1]] for x in kinds[0]], np.int64)
    return w, *at


def _rows(w: np.ndarray, x: np.ndarray, y: np.ndarray, kept: bool) -> np.ndarray:
    """The last row, or all, of m[i, j]: the most pairs between the first i children and the first j."""
    m = np.zeros((len(x) + 1 if kept else 2, len(y) + 1), np.int64)
    wide = w[:, y]
    for i, k in enumerate(x.tolist(), 1):
        above, row = (m[i - 1], m[i]) if kept else (m[(i - 1) & 1], m[i & 1])
        row[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + wide[k]))
    return m if kept else m[len(x) & 1]


def _ends(a: list[Tree], b: list[Tree]) -> tuple[int, int]:
    """How many first and then last children are alike in shape: the best alignment pairs them."""
    least, i, j = min(len(a), len(b)), 0, 0
    while i < least and a[i].shape == b[i].shape:
        i += 1
    while j < least - i and a[-1 - j].shape == b[-1 - j].shape:
        j += 1
    return i, j


def _aligned(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a best alignment, in order; large ones are halved, so that memory stays in proportion."""
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        ahead, behind = _rows(w, x[:half], y, False), _rows(w, x[half:][::-1], y[::-1], False)[::-1]
        cut = int((ahead + behind).argmax())
        return _aligned(w, x[:half], y[:cut]) + [(i + half, j + cut) for i, j in _aligned(w, x[half:], y[cut:])]
    m, i, j, out = _rows(w, x, y, True), len(x), len(y), []
    while i and j:
        one = w[x[i - 1], y[j - 1]]
        if one and m[i, j] == m[i - 1, j - 1] + one:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif m[i, j] == m[i, j - 1]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def matched(a: Tree, b: Tree, memo: dict) -> int:
    """The number of node pairs of the best alignment of two trees with like roots."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    key = (a.shape, b.shape)
    if key not in memo:
        i, j = _ends(a.children, b.children)
        x, y = a.children[i : len(a.children) - j], b.children[i : len(b.children) - j]
        same = sum(c.size for c in a.children[:i]) + sum(c.size for c in a.children[len(a.children) - j :])
        memo[key] = 1 + same + (int(_rows(*_weights(x, y, memo), False)[-1]) if x and y else 0)
    return memo[key]


def merge(wrapper: Tree, page: Tree, memo: dict, free: list[int], to: dict[int, int]) -> Tree:
    """The wrapper with what the page has besides; ``to`` gets the wrapper's slot of each page slot."""
    if wrapper.label == "#":
        to[page.slot] = wrapper.slot
        return wrapper
    a, b = wrapper.children, page.children
    i, j = _ends(a, b)
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    pairs = [(k, k) for k in range(i)]
    pairs += [(i + p, i + q) for p, q in _aligned(*_weights(x, y, memo))] if x and y else []
    pairs += [(len(a) - k, len(b) - k) for k in range(j, 0, -1)]
    out: list[Tree] = []
    i = j = 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += a[i:p]
        out += [_added(c, free, to) for c in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], memo, free, to))
        i, j = p + 1, q + 1
    return Tree(wrapper.label, out, wrapper.slot)


def _added(page: Tree, free: list[int], to: dict[int, int]) -> Tree:
    if page.label == "#":
        to[page.slot] = free[0]
        free[0] += 1
        return Tree("#", [], to[page.slot])
    return Tree(page.label, [_added(c, free, to) for c in page.children])


def induce(trees: list[str]) -> list[dict[int, int]]:
    """For each skeleton of a host, its slots' slots in the wrapper that the skeletons make, in the order given."""
    return _folded(trees)[1]


def _folded(trees: list[str]) -> tuple[Tree, list[dict[int, int]]]:
    wrapper, free, memo, out = None, [0], {}, []
    for text in trees:
        page, to = read(text), {}
        wrapper = _added(page, free, to) if wrapper is None else merge(wrapper, page, memo, free, to)
        out.append(to)
    return wrapper, out


def _slots(tree: Tree) -> Iterator[int]:
    if tree.label == "#":
        yield tree.slot
    for c in tree.children:
        yield from _slots(c)


def _induced(trees: pd.DataFrame) -> pd.DataFrame:
    """A wrapper of some skeletons or wrappers of a host, and for each of them its slots' slots, numbered in order."""
    order = trees.sort_values(["pages", "tree"], ascending=[False, True])
    wrapper, maps = _folded(order["tree"].tolist())
    place = {s: i for i, s in enumerate(_slots(wrapper))}
    whole = lambda v: pd.array(v, "Int64")
    made = pd.DataFrame({"_h": order["h"], "_s": order["name"], "to": [[place[m[k]] for k in range(len(m))] for m in maps], "up": whole(order["part"]), "pages": whole([None] * len(order)), "tree": None})
    head = pd.DataFrame({"_h": order["h"].iloc[:1], "_s": order["part"].iloc[:1], "to": [None], "up": whole([None]), "pages": whole([order["pages"].sum()]), "tree": [spelt(wrapper)]})
    return pd.concat((made, head))


def _wrapped(skeletons: DataFrame) -> DataFrame:
    """(_h, _s, to), written: the slots of each host's skeletons (h, skeleton, tree, pages) in the host's wrapper.

    At most some ``MEET`` skeletons meet in a call. A host of more has them spread over several, whose wrappers are
    folded in turn, until there is one.
    """
    now = skeletons.select("h", F.col("skeleton").alias("name"), "tree", "pages")
    levels = []
    while True:
        number = now.groupBy(F.col("h").alias("_h")).agg(F.ceil(F.count("*") / F.lit(MEET)).alias("parts"))
        parted = now.join(number, F.col("h") == F.col("_h")).select("h", "name", "tree", "pages", F.pmod(F.xxhash64("name", F.lit(len(levels))), F.col("parts")).alias("part"))
        made = written(parted.groupBy("h", "part").applyInPandas(_induced, "_h string, _s long, to array<int>, up long, pages long, tree string"), "wrapper-folds")
        levels.append(made.where("up is not null").select("_h", "_s", "to", "up"))
        heads = made.where("up is null").select(F.col("_h").alias("h"), F.col("_s").alias("name"), "tree", "pages")
        if heads.groupBy("h").count().where("count > 1").isEmpty():
            break
        now = heads  # hosts of one wrapper already are folded again into themselves
    out = levels[0]
    for above in levels[1:]:
        above = above.select(F.col("_h").alias("_ah"), F.col("_s").alias("_as"), F.col("to").alias("_at"), F.col("up").alias("_up"))
        out = out.join(above, (F.col("_h") == F.col("_ah")) & (F.col("up") == F.col("_as")))
        out = out.select("_h", "_s", F.expr("transform(to, i -> _at[i])").alias("to"), F.col("_up").alias("up"))
    return written(out.select("_h", "_s", "to"), "wrapper-slots")


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE) -> DataFrame:
    """page_id, url, ``content``, ``content_chars``, ``template_chars``: the text of each page but its template pieces.

    Pieces are joined by line feeds in page order. The pages of a URL's host, lower-cased, make one wrapper; those
    without one, null URLs among them, are together a host of their own. A piece is template if at least ``share`` of
    the host's pages that hold text, and two of them, have it in the same slot; the count is exact, and just that share
    is enough. Where two alignments pair as many nodes, the one that pairs later siblings is taken. A host's only page
    has no template: all of it is content. Null HTML gives null content and no counts; empty HTML gives an empty
    content. Malformed HTML is read as far as it goes, whole, and pages of any length and nesting are. Repeated pages are pages: what recurs by them
    counts as recurring. An empty df gives an empty result; other columns are not read.
    """
    keyed = pages.select(F.coalesce(host(url), F.lit("")).alias("h"), F.struct(F.col(id_column).alias("page_id"), F.col(url).alias("url")).alias("key"), F.col(html).cast(StringType()).alias("html"))
    kinds = keyed.schema["key"].dataType.simpleString()
    parsed = keyed.mapInArrow(_parsed, f"h string, key {kinds}, tree string, texts array<string>")
    parsed = written(parsed.withColumn("skeleton", F.xxhash64("tree")), "wrapper-pages")
    seen = parsed.where(F.size("texts") > 0)
    skeletons = written(seen.groupBy("h", "skeleton").agg(F.min("tree").alias("tree"), F.count("*").alias("pages")), "wrapper-skeletons")
    slots = small(_wrapped(skeletons))
    placed = lambda df: df.join(slots, (F.col("h") == F.col("_h")) & (F.col("skeleton") == F.col("_s")), "left").drop("_h", "_s")
    marked = F.zip_with(F.coalesce("to", F.array().cast("array<int>")), "texts", lambda w, t: F.struct(F.xxhash64(w, t).alias("mark"), t.alias("text")))
    pages = skeletons.groupBy("h").agg(F.sum("pages").alias("pages"))
    marks = placed(seen).select("h", F.explode(F.array_distinct(F.transform(marked, lambda p: p["mark"]))).alias("mark")).groupBy("h", "mark").agg(F.count("*").alias("n")).where("n > 1")
    template = marks.join(pages, "h").where(F.col("n") >= F.lit(share) * F.col("pages")).groupBy(F.col("h").alias("_h")).agg(F.collect_list("mark").alias("template"))
    out = placed(parsed).join(small(written(template, "wrapper-template")), F.col("h") == F.col("_h"), "left")
    mine = F.filter(marked, lambda p: ~F.array_contains(F.coalesce("template", F.array().cast("array<bigint>")), p["mark"]))
    out = out.withColumn("_mine", F.transform(mine, lambda p: p["text"]))
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda n, t: n + F.length(t))
    return out.select("key.page_id", "key.url", F.array_join("_mine", "\n").alias("content"), chars(F.col("_mine")).alias("content_chars"), (chars(F.col("texts")) - chars(F.col("_mine"))).alias("template_chars"))
