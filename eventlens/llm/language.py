"""Language of whole texts from a multi-width byte convolutional network with softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm import words as W
from eventlens.llm.convnet import Net
from eventlens.llm.quality import held_out, in_order, sampled_chunks

#: Filters of each width.
WIDTHS = {2: 4, 3: 10, 4: 10, 5: 8}
UNKNOWN = "und"


def trained(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = 1200, languages: int = 200, chunks: int = 3,
) -> tuple[Net, list[str]] | None:
    """A network and its languages, from rows that are not held out and name a language.

    Of each language the ``rows_per_language`` rows with the smallest hash of their id are
    used, with up to ``chunks`` windows spread over each text, for at most ``languages``
    languages (the most frequent, then by name). None without any such rows.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label")).where(
        "id is not null and label is not null"
    ).where(~held_out("id"))
    names = [
        r["label"]
        for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages).collect()
    ]
    if not names:
        return None
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    sample = (
        known.where(F.col("label").isin(names)).distinct().withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rows_per_language).drop("rank")
    )
    truth, texts = in_order(sampled_chunks(docs, sample, id_col, text_col, chunks))
    names = sorted(set(truth))
    numbers = {name: i for i, name in enumerate(names)}
    labels = np.array([numbers[t] for t in truth])
    return Net.trained(texts, labels, len(names), WIDTHS, pool="chunk", repeats=False), names


def predicted(
    docs: DataFrame, model: tuple[Net, list[str]] | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, lang_pred, score``: the likeliest language of a whole text, over all its windows.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
    could be learned. Ties go to the first name. Every row gives one row, repeated and null ids
    too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            if model is not None:
                net, names = model
                for _, data, offsets in W.runs(batch.column(1)):
                    p = net.scores(data, offsets)
                    best = p.argmax(axis=1)
                    langs += [names[i] for i in best.tolist()]
                    scores += p[np.arange(len(p)), best].tolist()
            else:
                langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            lettered = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x if ok else UNKNOWN for x, ok in zip(langs, lettered, strict=True)], pa.string()),
                    pa.array([x if ok else 0.0 for x, ok in zip(scores, lettered, strict=True)], pa.float64()),
                ],
                names=[id_col, "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select(id_col, text_col, lettered).mapInArrow(
        predict, f"`{id_col}` {kind}, lang_pred string, score double"
    )
