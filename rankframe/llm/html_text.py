"""Main text of pages by a tree-structured graphical model (``page_model``),
trained here on labelled pages (``page_labels``).

The labels come from a bounded sample of the table: ``SAMPLE`` pages of at most
``SAMPLE_CHARS`` characters, the smallest by a hash of their id. A page with one
article element is labelled by it, and its article is laid out anew ``LAYOUTS``
times among the parts other sites have; where no page has one, the long paragraphs
of the pages are laid out instead. Every page is read whole.

Defined results: a null or empty page, or one without text, gives an empty text;
what is left open at a page's end ends there; repeated pages give repeated rows;
a null id or address is carried along; an empty table gives no rows; where no
page has an article element or a long paragraph, all text of a page counts as its
main text; further columns are left alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.page_labels import training_set
from rankframe.llm.page_model import SIZE, Model, fitted

SAMPLE, SAMPLE_CHARS, LAYOUTS, SEED, SPARE = 200, 50_000, 4, 7, 5


def trained(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, layouts: int = LAYOUTS, seed: int = SEED) -> Model:
    html, whole = F.col(html_col), 1 << 40
    hashed = pages.select(html.alias("html"), F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(whole)).alias("h"))
    # Only a few times the sample is left to order, however many tasks read the pages.
    low = whole * min(1.0, SPARE * sample / max(1, pages.count()))
    near = hashed.where((F.col("h") < int(low)) & (F.char_length("html") <= SAMPLE_CHARS))
    rows = near.orderBy("h", "html").limit(sample).collect()
    trees, labels = training_set([r["html"] for r in rows], layouts, seed)
    if not trees:
        all_text = np.zeros(SIZE)
        all_text[-1] = 1.0
        return Model(all_text, [[1.0, 1.0], [1.0, 1.0]])
    return fitted(trees, labels)


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, address, ``text`` and ``n_chars``."""
    known = trained(pages, id_col, html_col) if model is None else model
    weights, edge = known.weights, known.edge

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, edge)
        for batch in batches:
            texts = [own.text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", text string, n_chars long"
    return pages.select(id_col, url_col, html_col).mapInArrow(read, schema)
