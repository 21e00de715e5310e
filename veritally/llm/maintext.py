"""The main text of pages: boosted trees score the nodes, a decoding over the tree chooses them.

Each node of a page has features of its subtree's text, links and density, of the tokens in its
and its ancestors' attributes, of depth and of its siblings. Gradient-boosted trees give the odds
that the node belongs to the article. The choice is then made for the whole tree: a node is
outside, inside, or cut; below an inside node are inside and cut ones, below a cut node only cut
ones, so no text is kept under a node that was cut and none inside is skipped between. Of all such
choices the one with the largest sum of log-odds is taken, in one pass up and one down the tree.

The trees are fitted here, on layouts written from the paragraphs of at most `TRAIN_PAGES` pages
of the table (those with the smallest ids), because tables do not say where their articles are. Every page is
extracted whole, inside its task; nothing is shuffled.

Null and empty pages, and pages without an article, have an empty text. Repeated rows give equal
rows. Markup that is cut off or contradicts itself is read as far as it goes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.layouts import Writer
from veritally.llm.pagetree import Page, features
from veritally.llm.trees import Boosted

TRAIN_PAGES = 200
#: Of a longer page this many characters lend paragraphs, so the sample is bounded in bytes too.
MOST_TRAIN_CHARS = 50_000
LAYOUTS = 900
SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_nodes bigint, n_inside bigint"


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are inside the article."""
    n = len(page.tags)
    parents, odds = page.parents, odds.tolist()
    kept, cut, out = odds[:], [-o for o in odds], [-o for o in odds]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        kept[p] += max(kept[i], cut[i])
        cut[p] += cut[i]
        out[p] += max(kept[i], out[i])
    inside, cuts = np.zeros(n, bool), np.zeros(n, bool)
    inside[0] = kept[0] > out[0]
    for i in range(1, n):
        p = parents[i]
        if cuts[p]:
            cuts[i] = True
        elif inside[p]:
            inside[i] = kept[i] >= cut[i]
            cuts[i] = not inside[i]
        else:
            inside[i] = kept[i] > out[i]
    return inside


def text_of(page: Page, inside: np.ndarray) -> str:
    """The kept blocks in page order, white space inside each folded."""
    blocks: list[list[str]] = []
    last = None
    for node, block, _, text in page.pieces:
        if inside[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    folded = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in folded if b)


def truth_of(page: Page) -> np.ndarray:
    """Which nodes of a written page are inside: the nearest mark above a node decides."""
    inside = np.zeros(len(page.tags), bool)
    for i in range(1, len(inside)):
        mark = page.marks[i]
        inside[i] = inside[page.parents[i]] if mark is None else mark == "1"
    return inside


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, layouts: int = LAYOUTS, html_col: str = "html", id_col: str = "page_id") -> Boosted:
    """Trees fitted on layouts of the paragraphs of a bounded number of pages."""
    usable = pages.filter(F.length(html_col) > 0)
    # Only ids are ordered; the pages of the ids that were drawn, a fixed number, are all that is collected.
    drawn = usable.select(F.col(id_col).alias("_id")).orderBy("_id").limit(train_pages).distinct()
    rows = usable.join(F.broadcast(drawn), F.col(id_col) == F.col("_id")).select(id_col, F.substring(html_col, 1, MOST_TRAIN_CHARS).alias("html")).limit(2 * train_pages).collect()
    rows.sort(key=lambda r: (r[0], r["html"]))
    paragraphs = []
    for r in rows:
        for _, _, linked, text in Page(r["html"]).pieces:
            if not linked and len(text.split()) >= 5:
                paragraphs.append(text)
    return fitted(paragraphs or ["a page without any words of its own"], layouts)


def fitted(paragraphs: list[str], layouts: int = LAYOUTS, seed: int = 3) -> Boosted:
    writer = Writer(paragraphs, random.Random(seed))
    pages = [Page(writer.page()) for _ in range(layouts)]
    truth = np.concatenate([truth_of(p) for p in pages])
    weight = np.concatenate([np.full(len(p.tags), 20 / (20 + len(p.tags))) for p in pages])
    return Boosted(features(pages), truth, weight)


def extract(pages: DataFrame, model: Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_nodes, n_inside) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                read = [Page(h or "") for h in part.column(2).to_pylist()]
                odds = model.logits(features(read))
                texts, sizes, first = [], [], 0
                for page in read:
                    inside = decode(page, odds[first : first + len(page.tags)])
                    first += len(page.tags)
                    texts.append(text_of(page, inside))
                    sizes.append(int(inside.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p.tags) for p in read], pa.int64()), pa.array(sizes, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_nodes", "n_inside"],
                )

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
