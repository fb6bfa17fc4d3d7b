"""Quality of whole texts from a byte-level convolutional network trained on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import words as W
from eventlens.llm.convnet import Net, cut_chunks

#: Filters of each width.
WIDTHS = {2: 4, 3: 4, 5: 8}
REACH = max(WIDTHS) - 1


def held_out(id_col: str) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled_chunks(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, chunks: int) -> pa.Table:
    """``label, chunks`` of the documents named in ``sample`` (``id, label``, of a bounded size)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [cut_chunks((t or "").encode(), chunks, REACH) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], names=["label", "chunks"])

    kind = sample.schema["label"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    return rows.select("label", "text").mapInArrow(cut, f"label {kind}, chunks array<binary>").toArrow()


def in_order(found: pa.Table) -> tuple[list, list[list[bytes]]]:
    """Labels and chunks in an order that doesn't depend on how the rows came."""
    rows = sorted(zip(found["label"].to_pylist(), found["chunks"].to_pylist(), strict=True))
    return [r[0] for r in rows], [r[1] for r in rows]


def trained(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_rows: int = 3000, chunks: int = 4,
) -> Net | None:
    """A network fitted to at most ``sample_rows`` labelled rows that are not held out.

    The rows are those with the smallest hash of their id; up to ``chunks`` chunks spread over
    each text are used. Rows without a label or an id teach nothing. None without any rows.
    """
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)").where(~held_out("id")).distinct()
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    )
    truth, texts = in_order(sampled_chunks(docs, sample, id_col, text_col, chunks))
    if not truth:
        return None
    return Net.trained(texts, np.array(truth), 2, WIDTHS, pool="document", repeats=True)


def probabilities(net: Net | None, texts: pa.Array) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.5)
    found = [net.scores(data, offsets)[:, 1] for _, data, offsets in W.runs(texts)]
    return np.concatenate([np.zeros(0), *found]).astype(np.float64)


def scored(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: the probability that a whole text is good.

    Null and empty texts are scored as a text without bytes. Every row gives one row, repeated
    and null ids too. Without a network (nothing was labelled) every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(probabilities(shared.value, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double")


def accepted(docs: DataFrame, net: Net | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    column = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(shared.value, batch.column(column)) >= least))

    return docs.mapInArrow(choose, docs.schema)
