"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes a sequence of text blocks. Each block has a score: the log-odds
that it is content, from a naive Bayes classifier over features of its text
(length, links, punctuation, tag), plus what the elements around it mark
(navigation, form, advert, article and so on; nothing on many pages). Both have
bounds of like size. A positive score is the capacity from the source, a negative
one that to the sink. Blocks next to each other, and next children of one parent,
are joined by edges on the scale of the scores, whose capacity falls with their
distance in the element tree and is small across a border of marks. The minimum
cut, found by maximum flow, labels the source's side content. So marks that are
certain (an advert within an article) hold against text and neighbours, while
unmarked and weakly marked blocks go with their text and their neighbours.

The classifier is trained here: blocks inside marked elements are its labels, and
the markers aren't among its features. It learns from a bounded sample of pages,
drawn by a hash of the page's id.

Defined results: null html counts as empty and gives the empty text, as do pages
without content. A page of any length and depth of nesting is read whole, in time
that grows with its length. Rows are kept as they come,
also repeated ones; columns other than page_id, url and html play no part. White
space in a block, also a line break element or a no-break space, is one space.
Equal flows either way (a score of exactly what the cut edges cost) label content.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, unit_hash

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML element names by what they hold, and words of class and id attributes by what they mark.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
                   "tr ul".split())
UNREAD = frozenset("script style noscript template svg iframe object canvas audio video map head title textarea select button datalist".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption".split())
SIBLINGS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies "
                      "consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall share sharing social "
                      "sidebar widget widgets related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs "
                      "pagination pager footer masthead topbar toolbar comment comments disqus reply replies respond login signup search "
                      "skip toc tags outbrain taboola copyright legal disclaimer".split())
GOOD_WORDS = frozenset("article post entry story content main body text prose".split())
STRONG = frozenset("article post entry story main".split())
LISTS = ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "menu")

#: Log-odds at most of the marks around a block and of its text. An edge between blocks under different marks is
#: ``smooth / ACROSS``; a block has at most four edges.
MARK, TEXT, ACROSS = 4.0, 3.0, 20


def parse(page: str) -> tuple[list[dict], list[dict]]:
    """Text blocks in page order, and the elements: parent, tag, mark (-1 clutter, 1 article, 0 neither), holds (an article).

    Time grows with the page, however deep its elements nest: ``open_at`` knows the open places of each tag."""
    elements = [{"parent": -1, "tag": "", "mark": 0, "tagged": False, "holds": False, "depth": 0}]
    stack = [0]
    open_at: dict[str, list[int]] = {}  # tag -> its places on the stack
    open_blocks = [0]                   # places of block elements, and the root
    endless: set[str] = set()           # tags that have no end tag any more
    blocks: list[dict] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append({"text": text, "element": stack[open_blocks[-1]], "linked": min(1.0, linked / len(text))})
            parts.clear()
        linked = 0

    def last(tag: str) -> int:
        return open_at[tag][-1] if open_at.get(tag) else 0

    def close(depth):
        for e in stack[depth:]:
            open_at[elements[e]["tag"]].pop()
        while open_blocks[-1] >= depth:
            open_blocks.pop()
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        raw = page[at:m.start() if m else size]
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if last("a"):
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if last(tag):
                close(last(tag))
            continue
        if tag in UNREAD:
            if not m[3].rstrip().endswith("/") and tag not in endless:
                if tag == "head":  # its end tag may be missing
                    end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                else:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = size
                else:
                    endless.add(tag)
            parts.append(" " if tag in ("button", "select", "textarea") else "")
            continue
        if tag in BLOCKS:
            flush()
        if tag == "br":
            parts.append(" ")
        if tag in EMPTY:
            continue
        if tag in CLOSES_P and elements[stack[open_blocks[-1]]]["tag"] == "p":
            close(open_blocks[-1])
        if tag in SIBLINGS:
            before = max(last(tag), last(SIBLINGS[tag]))
            if before > max(map(last, LISTS)):
                close(before)
        inside = bool(last("article") or last("main"))
        mark, tagged = _mark(tag, m[3], inside)
        if mark > 0 and (tagged or words_of(m[3]) & STRONG) or tag == "h1":
            for e in reversed(stack):
                if elements[e]["holds"]:
                    break  # so do all around it
                elements[e]["holds"] = True
        elements.append({"parent": stack[-1], "tag": tag, "mark": mark, "tagged": tagged, "holds": False, "depth": len(stack)})
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append(len(elements) - 1)
    flush()
    return blocks, elements


def words_of(attributes: str) -> set[str]:
    return {w.lower() for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for w in WORD.findall(a or b or c)}


def _mark(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """What an element marks, and whether its tag or role says so rather than its class; ``inside``: within an article."""
    words: set[str] = set()
    role = ""
    if attributes and tag not in ("html", "body"):
        words = words_of(attributes)
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return -1, True
            if name == "role":
                role = value.strip().lower()
    if tag in BAD_TAGS or role in BAD_ROLES:
        return -1, True
    if tag == "header" and not inside:
        return -1, True
    if words & BAD_WORDS:
        return -1, tag == "article"
    if "header" in words and not words & GOOD_WORDS and not inside:
        return -1, False
    if tag in ("article", "main") or role in ("main", "article"):
        return 1, True
    return (1, False) if words & GOOD_WORDS else (0, False)


def surroundings(elements: list[dict]) -> list[float]:
    """Per element, the log-odds from what is around its text. Clutter holds all within it, unless only its class says
    so and it holds an article."""
    scores = [0.0]
    for e in elements[1:]:  # parents come first
        score = scores[e["parent"]]
        if score > -MARK:
            if e["mark"] < 0:
                score = -MARK if not e["holds"] or e["tagged"] and e["tag"] != "form" else max(score - 0.5, 0.5 - MARK)
            elif e["mark"] > 0:
                score = max(score, MARK if e["tagged"] else 1.5)
        scores.append(score)
    return scores


def features(block: dict, tag: str) -> list[str]:
    text = block["text"]
    stops = sum(text.count(c) for c in ".!?。！？")
    kind = "h" if re.fullmatch("h[1-6]", tag) else tag if tag in ("p", "li", "td", "div", "pre", "blockquote") else "other"
    return [f"length {min(12, len(text).bit_length())}", f"links {math.ceil(block['linked'] * 4)}", f"stops {min(4, stops)}",
            f"commas {min(3, text.count(','))}", f"tag {kind}",
            f"rights {'©' in text or 'all rights reserved' in text.lower()}"]


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (the largest such side)."""
    n = len(scores)
    net = [round(s * 1000) for s in scores]
    near: list[list[list]] = [[] for _ in range(n)]
    for i, j, w in edges:
        w = round(w * 1000)
        if w > 0:
            near[i].append([j, w])
            near[j].append([i, w])
    # a node whose score outweighs all its edges to undecided nodes is decided; its edges then add to its neighbours' scores
    side: list[int] = [0] * n
    free = [sum(w for _, w in x) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i]:
            continue
        if net[i] >= free[i]:
            side[i] = 1
        elif -net[i] > free[i]:
            side[i] = -1
        else:
            continue
        for j, w in near[i]:
            if not side[j]:
                net[j] += w * side[i]
                free[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if not side[i]]
    if rest:
        for i in _flow(rest, net, near, side):
            side[i] = 1
    return [s > 0 for s in side]


def _flow(rest, net, near, side) -> list[int]:
    """Maximum flow over the undecided nodes; those that can't reach the sink in the residual graph."""
    number = {i: k + 2 for k, i in enumerate(rest)}  # 0 is the source, 1 the sink
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def arc(u, v, c, back):
        out[u].append(len(to))
        to.append(v)
        room.append(c)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i in rest:
        if net[i] > 0:
            arc(0, number[i], net[i], 0)
        elif net[i] < 0:
            arc(number[i], 1, -net[i], 0)
        for j, w in near[i]:
            if j > i and not side[j]:
                arc(number[i], number[j], w, w)
    while True:
        level = [-1] * len(out)
        level[0] = 0
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for a in out[u]:
                if room[a] and level[to[a]] < 0:
                    level[to[a]] = level[u] + 1
                    queue.append(to[a])
        if level[1] < 0:
            break
        turn = [0] * len(out)
        path: list[int] = []
        u = 0
        while True:
            if u == 1:
                least = min(room[a] for a in path)
                for a in path:
                    room[a] -= least
                    room[a ^ 1] += least
                full = next(k for k, a in enumerate(path) if not room[a])
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[u] < len(out[u]):
                a = out[u][turn[u]]
                if room[a] and level[to[a]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break
    reach = [False] * len(out)  # what reaches the sink
    reach[1] = True
    queue = deque([1])
    while queue:
        v = queue.popleft()
        for a in out[v]:
            if room[a ^ 1] and not reach[to[a]]:
                reach[to[a]] = True
                queue.append(to[a])
    return [i for i in rest if not reach[number[i]]]


def distance(a: int, b: int, elements: list[dict]) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a != b:
        if elements[a]["depth"] >= elements[b]["depth"]:
            a = elements[a]["parent"]
        else:
            b = elements[b]["parent"]
        steps += 1
    return steps


def extract(page: str, weights: dict[str, float], smooth: float = 4.0) -> tuple[str, int]:
    """The main text of a page, and its number of blocks."""
    blocks, elements = parse(page)
    if not blocks:
        return "", 0
    around = surroundings(elements)
    scores, edges = [], []
    last_of: dict[int, int] = {}  # parent -> its last block so far

    def join(i, j, steps):
        a, b = around[blocks[i]["element"]], around[blocks[j]["element"]]
        edges.append((i, j, smooth / (1 + steps) if a == b else smooth / ACROSS))

    for i, b in enumerate(blocks):
        e = b["element"]
        odds = sum(weights.get(f, 0.0) for f in features(b, elements[e]["tag"]))
        scores.append(around[e] + max(-TEXT, min(TEXT, weights.get("", 0.0) + odds)))
        if i:
            join(i - 1, i, distance(blocks[i - 1]["element"], e, elements))
        parent = elements[e]["parent"]
        before = last_of.get(parent)
        if before is not None and before < i - 1:
            join(before, i, 2)
        last_of[parent] = i
    keep = cut(scores, edges)
    return "\n".join(b["text"] for b, k in zip(blocks, keep) if k), len(blocks)


def _labelled(batches):
    for batch in batches:
        found: Counter = Counter()
        for page in batch.column("html").to_pylist():
            blocks, elements = parse(page or "")
            around = surroundings(elements)
            for b in blocks:
                s = around[b["element"]]
                if abs(s) >= MARK:
                    for f in ["", *features(b, elements[b["element"]]["tag"])]:
                        found[f, s > 0] += 1
        yield pa.RecordBatch.from_pylist([{"feature": f, "content": c, "n": n} for (f, c), n in found.items()],
                                         schema=pa.schema([("feature", pa.string()), ("content", pa.bool_()), ("n", pa.int64())]))


def train(pages: DataFrame, train_pages: int = 2000) -> dict[str, float]:
    """Log-odds per feature, from about ``train_pages`` pages (the documented bound), and of content itself under ""."""
    prepare(pages.sparkSession)
    total = pages.count()
    if not total:
        return {}
    sample = pages.where(unit_hash(F.col("page_id"), 5) < min(1.0, train_pages / total)).select("html")
    counts = {(r["feature"], r["content"]): r["n"] for r in  # a few dozen features
              sample.mapInArrow(_labelled, "feature string, content boolean, n bigint").groupBy("feature", "content").agg(F.sum("n").alias("n")).collect()}
    good, bad = counts.get(("", True), 0), counts.get(("", False), 0)
    weights = {"": 0.0}  # no prior: how many blocks of a kind a page has says nothing about one block
    for f in {f for f, _ in counts} - {""}:
        odds = math.log((counts.get((f, True), 0) + 1) / (good + 10)) - math.log((counts.get((f, False), 0) + 1) / (bad + 10))
        weights[f] = max(-1.0, min(1.0, odds))  # features go together, so none may outweigh the others
    return weights


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select("page_id", "url", "html")
    shared = spark.sparkContext.broadcast(train(rows) if weights is None else weights)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = [extract(p or "", shared.value) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([t for t, _ in made], pa.string()),
                     pa.array([len(t) for t, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks bigint")
