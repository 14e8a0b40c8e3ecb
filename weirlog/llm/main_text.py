"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from weirlog.llm import labeller, texts
from weirlog.llm.html_blocks import blocks

PAGES_AT_ONCE = 512


def main_text(
    pages: DataFrame,
    model: labeller.Labeller | None = None,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    The blocks that the labeller takes for main text are joined by line ends, in page order. A page
    that is null, empty, or has no such block gets an empty text. One row per row of ``pages``; ids
    may be null or repeat. Extra columns are ignored whatever their names. An empty table gives an
    empty result. Without ``model`` one is trained first, which takes the driver some seconds.
    """
    pages = texts.pick(pages, id_column, url_column, html_column).toDF("page_id", "url", "html")
    # a fixed number of weights, under a megabyte
    weights = pages.sparkSession.sparkContext.broadcast((model or labeller.train()).w)

    def run(batches):
        judge = labeller.Labeller(weights.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(lo, PAGES_AT_ONCE)
                found = [blocks(x) for x in part.column("html").to_pylist()]
                text = [
                    "\n".join([b[1] for b, keep in zip(page, kept.tolist(), strict=True) if keep])
                    for page, kept in zip(found, judge.label(found), strict=True)
                ]
                yield pa.record_batch(
                    {
                        "page_id": part.column("page_id").cast(pa.int64()),
                        "url": part.column("url").cast(pa.string()),
                        "text": pa.array(text, pa.string()),
                        "n_chars": pa.array([len(t) for t in text], pa.int64()),
                    }
                )

    return pages.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
