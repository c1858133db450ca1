"""HTML extraction by minimum-cut labelling.

A page is a list of blocks (dom.py).  What it costs to call a block boilerplate, or content, comes from the part that the
page gives it (in an article, in a menu, ...) and from a naive Bayes classifier over its form: these are the capacities of
its edges from the source and to the sink.  Blocks that follow each other, and blocks with a common container, are joined
by edges whose capacity is what it costs to label them differently.  The minimum cut, found by maximum flow, is the
cheapest labelling of the page; of several, the one with the most content.

The classifier is trained on the pages themselves: blocks of declared parts are its examples, their form alone its
features.  Its counts are sums over all pages, so there is no sample, and the driver gets a row for each value of a feature.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.dom import ARTICLE, HEADINGS, OTHER, PLACE, Block, blocks
from ridgeline.llm.frames import map_arrow

#: Capacities are whole numbers of UNIT parts.
UNIT = 1000
#: What the page says counts so much, the classifier FORM_MOST at most, and a value of one feature VALUE_MOST.
DECLARED = {ARTICLE: 8.0, PLACE: 3.0, OTHER: -8.0}
FORM_MOST, VALUE_MOST = 3.0, 2.5
#: Blocks that follow each other; blocks that follow each other in a container, and in the container of that.
NEXT, BESIDE, AROUND = 0.4, 0.8, 0.4
#: What is known of content and of boilerplate before any page is seen: blocks of EXAMPLES for each value of a feature.
EXAMPLES = 20.0
PRIOR = {
    "tag": {"p": (0.7, 0.15), "heading": (0.12, 0.08), "li": (0.06, 0.4), "cell": (0.03, 0.07), "box": (0.04, 0.25), "else": (0.05, 0.05)},
    "words": {"0": (0.03, 0.2), "1": (0.07, 0.4), "2": (0.15, 0.22), "3": (0.35, 0.12), "4": (0.25, 0.04), "5": (0.15, 0.02)},
    "links": {"0": (0.85, 0.4), "1": (0.11, 0.08), "2": (0.03, 0.07), "3": (0.01, 0.45)},
    "end": {"y": (0.8, 0.3), "n": (0.2, 0.7)},
    "marks": {"y": (0.01, 0.15), "n": (0.99, 0.85)},
}
_TAGS = {"p": "p", "li": "li", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "div": "box", "section": "box", "body": "box", "#page": "box"} | dict.fromkeys(HEADINGS, "heading")
_MARKS = ("©", "(c)", "®", "copyright", "all rights reserved", "cookie")


def features(block: Block) -> dict[str, str]:
    """The form of a block."""
    words = block.text.count(" ") + 1
    share = block.linked / max(1, len(block.text) - words + 1)
    low = block.text.lower()
    return {
        "tag": _TAGS.get(block.tag, "else"),
        "words": str(sum(words > most for most in (1, 4, 9, 24, 59))),
        "links": "0" if not block.linked else str(1 + (share > 1 / 3) + (share > 2 / 3)),
        "end": "y" if block.text.rstrip("\"'»”’)")[-1:] in (".", "!", "?", "…", ":", "。", "！", "？") else "n",
        "marks": "y" if any(m in low for m in _MARKS) else "n",
    }


def weights(counts: dict[tuple[str, str, bool], int] | None = None) -> dict[tuple[str, str], float]:
    """Log odds of content of each value of a feature, from the blocks counted by (feature, value, is content) and PRIOR."""
    counts = counts or {}
    out = {}
    for feature, values in PRIOR.items():
        every = [EXAMPLES + sum(counts.get((feature, v, c), 0) for v in values) for c in (True, False)]
        for v, prior in values.items():
            content, other = ((EXAMPLES * prior[k] + counts.get((feature, v, not k), 0)) / every[k] for k in (0, 1))
            out[feature, v] = max(-VALUE_MOST, min(VALUE_MOST, math.log(content / other)))
    return out


def evidence(block: Block, model: dict[tuple[str, str], float]) -> int:
    """What speaks for content, in parts of UNIT; below 0 what speaks against it."""
    form = sum(model[x] for x in features(block).items())
    return round(UNIT * (DECLARED.get(block.part, 0.0) + max(-FORM_MOST, min(FORM_MOST, form))))


def neighbours(page: list[Block]) -> dict[tuple[int, int], int]:
    """Capacities of edges (i, j), i < j: three a block at most."""
    out: Counter[tuple[int, int]] = Counter()
    beside: dict[int, int] = {}
    around: dict[int, int] = {}
    for j, b in enumerate(page):
        if j:
            out[j - 1, j] += round(UNIT * NEXT)
        for last, key, most in ((beside, b.element if _TAGS.get(b.tag) == "box" else b.parent, BESIDE), (around, b.parent, AROUND)):
            if key in last:
                out[last[key], j] += round(UNIT * most)
            last[key] = j
    return out


def minimum_cut(terminal: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut, of all such cuts the largest side.

    terminal[i] > 0: capacity from the source; < 0: to the sink.  Edges have their capacity both ways.  Nodes whose own
    capacity outweighs all their edges are labelled first, and their edges added to their neighbours' capacities; what is
    left is cut by maximum flow, each connected part by itself."""
    n = len(terminal)
    own = list(terminal)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    around = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or -around[i] <= own[i] < around[i]:
            continue
        label[i] = own[i] >= 0
        for j, c in near[i].items():
            if label[j] is None:
                own[j] += c if label[i] else -c
                around[j] -= c
                del near[j][i]
                queue.append(j)
    for first in range(n):
        if label[first] is None:
            part, seen = [first], {first}
            for i in part:
                for j in near[i]:
                    if j not in seen:
                        seen.add(j)
                        part.append(j)
            for i, side in zip(part, _max_flow(part, own, near), strict=True):
                label[i] = side
    return label  # type: ignore[return-value]


def _max_flow(part: list[int], own: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Sides of the nodes of a connected part, by flow along shortest paths in the order of levels from the sink."""
    place = {i: k for k, i in enumerate(part)}
    n = len(part)
    residual = [{place[j]: c for j, c in near[i].items()} for i in part]
    supply = [max(0, own[i]) for i in part]
    demand = [max(0, -own[i]) for i in part]
    while True:
        # steps to the nearest node with demand left
        level = [-1] * n
        queue = deque(k for k in range(n) if demand[k])
        for k in queue:
            level[k] = 0
        while queue:
            k = queue.popleft()
            for j in residual[k]:
                if level[j] < 0 and residual[j][k] > 0:
                    level[j] = level[k] + 1
                    queue.append(j)
        sources = [k for k in range(n) if supply[k] and level[k] >= 0]
        if not sources:
            return [x < 0 for x in level]
        left = [list(r) for r in residual]
        for s in sources:
            path = [s]
            while supply[s] and path:
                k = path[-1]
                if level[k] == 0 and demand[k]:
                    flow = min(supply[s], demand[k], *(residual[a][b] for a, b in zip(path, path[1:], strict=False)))
                    supply[s] -= flow
                    demand[k] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        residual[a][b] -= flow
                        residual[b][a] += flow
                    path = [s]
                    continue
                while left[k] and not (level[left[k][-1]] == level[k] - 1 and residual[k][left[k][-1]] > 0):
                    left[k].pop()
                if left[k]:
                    path.append(left[k][-1])
                else:
                    path.pop()
                    if path:
                        left[path[-1]].pop()


def main_text(html: str | None, model: dict[tuple[str, str], float]) -> str:
    """The content blocks of a page, a line each."""
    page = blocks(html)
    keep = minimum_cut([evidence(b, model) for b in page], neighbours(page))
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def fit_form(pages: DataFrame, html_col: str = "html") -> dict[tuple[str, str], float]:
    """weights() from the blocks of all pages that declare their part; tasks hand on their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, bool]] = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                for b in blocks(html):
                    if b.part in (ARTICLE, OTHER):
                        seen.update((f, v, b.part == ARTICLE) for f, v in features(b).items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array([k[2] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["feature", "v", "content", "n"])

    counts = map_arrow(pages.select(F.col(html_col).cast("string").alias("html")), run, "feature string, v string, content boolean, n long")
    return weights({(r.feature, r.v, r.content): r.n for r in counts.groupBy("feature", "v", "content").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, model: dict[tuple[str, str], float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text, its blocks a line each, and its code points.

    Without a model, one is fitted to the pages.  Null and empty pages, and pages without content, have the text ''.
    Repeated rows and null ids stay; other columns are left out; an empty table gives no rows."""
    model = fit_form(pages, html_col) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long")


def op13_html_extraction(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract(pages)
