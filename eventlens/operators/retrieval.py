"""Vector retrieval and text enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventlens.functions import expressions as X
from eventlens.functions import text as txt
from eventlens.operators.dedup import dedup_docs_across_topics, keep_best

MAX_DISTANCE = 0.9
DIMENSIONS = 384
MAX_CONTEXT_CHARS = 4000
# Queries whose vectors a task holds; more are dealt into blocks, and then the rows into parts.
BLOCK, PART = 4096, 32768
# Queries of such a block.
WIDE = 16384
# Queries scored at a time, so that a block of distances stays small.
TILE = 64
# Vectors of which only the nearest is compared at first, and the room that single precision takes for each dimension:
# two sums of products of unit vectors.
GROUP, ROUNDING = 32, 2.5e-7
# Pairs whose exact distances are summed at a time.
CANDIDATES = 4096
# Up to so many rows for each query, Spark limits them before the shuffle.
LIMITED = 1000
# ---- fixed values: the briefing topics ------------------------------------------------
TOPICS = [
    "military conflict and armed confrontation",
    "diplomatic negotiations and peace talks",
    "economic sanctions and trade disputes",
    "energy markets oil gas supply disruption",
    "political instability elections regime change",
]


# ---- nearest neighbours -------------------------------------------------------------------
def query_rows(spark, vectors: dict[str, list[float]]) -> DataFrame:
    """``query_id, vector, topic_no`` of a handful of named vectors, in their order."""
    rows = [(n, [float(x) for x in v], i) for i, (n, v) in enumerate(vectors.items())]
    return spark.createDataFrame(rows, "query_id string, vector array<double>, topic_no int")


def _equal_rows(x: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of distinct vectors, and for each where in the list of rows its ``k`` first ones by place
    begin and how many they are; at last this list."""
    _, one, of = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by_vector = np.lexsort((place, of))
    count = np.bincount(of, minlength=len(one))
    return one, np.cumsum(count) - count, np.minimum(count, k), by_vector


def _first_of_each(owner: np.ndarray, n: int) -> np.ndarray:
    """Which entries are among the first ``n`` of their owner; ``owner`` is sorted."""
    return np.arange(len(owner)) - np.searchsorted(owner, owner) < n


def _near_pairs(tile: np.ndarray, unit: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, vectors and exact distances of all pairs that may be among a query's k nearest, by query.

    Products in single precision name the candidates, with room for their rounding; the distances of
    these are then summed row by row, so that equal vectors score equally wherever they sit.
    """
    like = tile.astype(np.float32) @ rough.T
    groups = like.shape[1] // GROUP
    if groups > k:
        # k groups have a member as near as the k-th best of the groups' best.
        best = like[:, : groups * GROUP].reshape(len(tile), groups, GROUP).max(axis=2)
        least = np.partition(best, groups - k, axis=1)[:, groups - k] - ROUNDING * (unit.shape[1] + 4)
        q, v = np.nonzero(like >= least[:, None])
    else:
        q, v = np.nonzero(~np.isnan(like))
    exact = np.empty(len(q))
    for at in range(0, len(q), CANDIDATES):
        some = slice(at, at + CANDIDATES)
        exact[some] = np.round(1 - np.einsum("nd,nd->n", unit[v[some]], tile[q[some]]), 12)
    return q, v, exact


def _best_of(
    names: pa.Array, matrix: np.ndarray, ids: pa.Array, x: np.ndarray, k: int
) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Names, ids and distances of the k nearest rows ``x`` of each unit vector in ``matrix``.

    Rows with equal vectors are scored once, and only the k first of them by id can be among the nearest.
    """
    size = np.linalg.norm(x, axis=1)
    ok = np.flatnonzero((size > 0) & np.isfinite(size))
    if len(ok) == 0:
        return
    ids, x, size = ids.take(pa.array(ok)), x[ok], size[ok]
    place = pc.rank(ids, tiebreaker="dense").to_numpy()
    # A query without a direction is as far from all.
    blank, lowest = np.flatnonzero(~matrix.any(axis=1)), np.argsort(place)[:k]
    if len(blank):
        yield names.take(pa.array(np.repeat(blank, len(lowest)))), ids.take(pa.array(np.tile(lowest, len(blank)))), np.ones(len(blank) * len(lowest))
        asked = np.flatnonzero(matrix.any(axis=1))
        names, matrix = names.take(pa.array(asked)), matrix[asked]
    one, start, count, rows = _equal_rows(x, place, k)
    unit = x[one] / size[one, None]
    rough = unit.astype(np.float32)
    for first in range(0, len(names), TILE):
        q, v, exact = _near_pairs(matrix[first : first + TILE], unit, rough, k)
        if len(q) == 0:
            continue
        # Vectors no farther than the k-th of their query.
        order = np.lexsort((exact, q))
        q, v, exact = q[order], v[order], exact[order]
        begins, held = np.unique(q, return_index=True, return_counts=True)[1:]
        near = exact <= np.repeat(exact[begins + np.minimum(held, k) - 1], held)
        q, v, exact = q[near], v[near], exact[near]
        # Each vector stands for its rows; ties go to the smaller id.
        n = count[v]
        own = rows[np.repeat(start[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        q, exact = np.repeat(q, n), np.repeat(exact, n)
        order = np.lexsort((place[own], exact, q))
        order = order[_first_of_each(q[order], k)]
        yield names.take(pa.array(first + q[order])), ids.take(pa.array(own[order])), exact[order]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _nearest(names: list[str], matrix: np.ndarray, k: int, id_column: str) -> Callable:
    """Of each Arrow batch (id, vector), the k nearest rows of each query."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for found in _best_of(pa.array(names, pa.string()), matrix, batch.column(0), _vectors(batch.column(1)), k):
                yield pa.record_batch([*found[:2], pa.array(found[2])], names=["query_id", id_column, "distance"])

    return nearest


def _distinct_first(rows: DataFrame, id_column: str, vector: str, k: int) -> DataFrame:
    """Of the rows with one and the same vector, the k with the least ids; others can't be among the k nearest.

    Vectors are told apart by 128 bits. A vector that many rows have sends k of them per task.
    """
    marked = rows.withColumns({"_h": F.xxhash64(vector), "_g": F.xxhash64(F.lit(1), vector)})
    return keep_best(marked, ["_h", "_g"], [F.col(id_column)], n=k)


def _nearest_in_cells(rows: DataFrame, wanted: DataFrame, asked: int, k: int, id_column: str) -> DataFrame:
    """Candidates of queries that are too many for one task.

    Rows are dealt into parts of at most about ``PART``, all rows of a vector into one, and queries into blocks of about
    ``WIDE``; each part meets each block in a group of its own, so a group stays bounded and nothing
    passes through the driver. It is a plan like any other, which runs once it is read.
    """
    id_type = rows.schema[id_column].dataType
    schema = f"query_id string, `{id_column}` {id_type.simpleString()}, distance double"
    out = pa.schema([("query_id", pa.string()), (id_column, to_arrow_type(id_type)), ("distance", pa.float64())])

    def nearest(part: pa.Table, block: pa.Table) -> pa.Table:
        part, block = part.combine_chunks(), block.combine_chunks()
        found = []
        if part.num_rows and block.num_rows:
            names, matrix = block["query_id"].combine_chunks(), _units(_vectors(block["vector"].combine_chunks()))
            found = list(_best_of(names, matrix, part[id_column].combine_chunks(), _vectors(part["_vector"].combine_chunks()), k))
        if not found:
            return out.empty_table()
        return pa.Table.from_arrays(
            [
                pa.chunked_array([f[0] for f in found]).cast(pa.string()),
                pa.chunked_array([f[1] for f in found]).cast(out.field(1).type),
                pa.array(np.concatenate([f[2] for f in found])),
            ],
            schema=out,
        )

    parts = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART)).cast("int")).scalar()
    # As many tasks as the session has, however small the vectors are: the work is in their products.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Blocks are smaller where there are fewer cells than tasks.
    blocks = F.greatest(F.lit(-(-asked // WIDE)), F.least(F.lit(-(-asked // TILE)), F.ceil(F.lit(tasks) / parts))).cast("int")
    vector = [c for c in rows.columns if c != id_column][0]
    dealt = _distinct_first(rows, id_column, vector, k).select(
        id_column, F.col(vector).alias("_vector"), F.pmod("_h", parts).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"),
    )
    placed = wanted.select(
        "query_id", "vector", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"),
        F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("_block"),
    )
    key = ["_part", "_block"]
    return (
        dealt.repartition(tasks, *key).groupBy(*key).cogroup(placed.repartition(tasks, *key).groupBy(*key)).applyInArrow(nearest, schema)
    )


def cosine_topk(
    corpus: DataFrame,
    queries: DataFrame | dict[str, list[float]],
    k: int = 10,
    id_column: str = "id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of each query vector, exactly.

    Queries are rows (``query_id, vector``), or a handful of named vectors. Up to ``BLOCK`` of them
    go to the tasks, each Arrow batch is scored against them and only its own k best leave the
    task, so the shuffle carries k rows per query and batch whatever the corpus size. More
    are dealt into blocks, the corpus into parts, and each part meets each block
    (``_nearest_in_cells``): one plan over all of them, which runs when it is read. Rows and
    queries with a null or zero vector are skipped, or empty; ties go to the smaller id.
    """
    spark = corpus.sparkSession
    if isinstance(queries, dict):
        queries = query_rows(spark, queries)
    wanted = queries.where("vector IS NOT NULL").select("query_id", "vector")
    if wanted.schema["vector"].dataType != T.ArrayType(T.FloatType()):
        wanted = wanted.withColumn("vector", F.col("vector").cast("array<double>"))
    asked = wanted.count()
    id_type = corpus.schema[id_column].dataType.simpleString()
    rows = corpus.filter(F.col(vector_column).isNotNull()).select(id_column, vector_column)
    w = Window.partitionBy("query_id").orderBy("distance", id_column)
    order = [F.col("distance"), F.col(id_column)]
    if asked > BLOCK:
        part = _nearest_in_cells(rows, wanted, asked, k, id_column)
    else:
        held = wanted.orderBy("query_id").collect()
        names = [r["query_id"] for r in held]
        matrix = _units(np.array([r["vector"] for r in held], dtype=np.float64).reshape(len(names), -1 if names else 0))
        part = rows.mapInArrow(_nearest(names, matrix, k, id_column), f"query_id string, `{id_column}` {id_type}, distance double")
    if k > LIMITED:
        part = keep_best(part.withColumn("_salt", F.pmod(F.xxhash64(id_column), F.lit(32))), ["query_id", "_salt"], order, n=k).drop("_salt")
    return keep_best(part, ["query_id"], order, n=k).withColumn("rank", F.row_number().over(w))


def _documents(corpus: DataFrame, near: DataFrame, id_column: str) -> DataFrame:
    # k rows for each query: Spark sees the size when it picks the join.
    return corpus.join(near, id_column)


def search_headlines(
    headlines: DataFrame,
    queries: DataFrame | dict[str, list[float]],
    limit: int = 10,
    start=None,
    end=None,
    source: str | None = None,
    max_distance: float = MAX_DISTANCE,
) -> DataFrame:
    """Nearest headlines; the distance cut applies after the limit."""
    h = headlines.filter(X.timestamp_in_days("published_at", start, end))
    if source is not None:
        h = h.filter(F.col("source") == source)
    near = cosine_topk(h, queries, limit).filter(F.col("distance") <= max_distance)
    return _documents(h, near, "id").select(
        "query_id",
        F.lit("headline").alias("source_type"),
        F.col("id").alias("doc_id"),
        F.col("headline").alias("content"),
        "distance",
        F.date_format("published_at", "yyyy-MM-dd").alias("day"),
        "source",
        "sentiment_score",
        F.lit(None).cast("double").alias("goldstein_scale"),
        F.lit(None).cast("int").alias("num_mentions"),
    )


def search_events(
    events: DataFrame,
    queries: DataFrame | dict[str, list[float]],
    limit: int = 10,
    start=None,
    end=None,
    country: str | None = None,
    max_distance: float = MAX_DISTANCE,
    geo: str = "country_code",
) -> DataFrame:
    e = events.filter(X.between_dates("event_date", start, end))
    if country is not None:
        e = e.filter(F.col(geo) == country.upper())
    near = cosine_topk(e, queries, limit).filter(F.col("distance") <= max_distance)
    return _documents(e, near, "id").select(
        "query_id",
        F.lit("event").alias("source_type"),
        F.col("id").alias("doc_id"),
        txt.doc_event_summary().alias("content"),
        "distance",
        F.date_format("event_date", "yyyy-MM-dd").alias("day"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("double").alias("sentiment_score"),
        "goldstein_scale",
        F.col("num_mentions").cast("int").alias("num_mentions"),
    )


def merge_ranked_docs(headlines: DataFrame, events: DataFrame, limit: int = 15) -> DataFrame:
    """Both lists by distance, cut at ``limit`` per query."""
    order = [F.col("distance"), F.col("source_type").desc(), F.col("doc_id")]
    return keep_best(headlines.unionByName(events), ["query_id"], order, n=limit)


def search_all(
    headlines: DataFrame,
    events: DataFrame,
    queries: DataFrame | dict[str, list[float]],
    limit: int = 15,
    start=None,
    end=None,
    **options,
) -> DataFrame:
    """Half the limit (at least 5) from each side, merged by distance."""
    half = max(limit // 2, 5)
    return merge_ranked_docs(
        search_headlines(headlines, queries, half, start, end, **options),
        search_events(events, queries, half, start, end, **options),
        limit,
    )


# ---- context blocks -----------------------------------------------------------------------
def format_context(
    docs: DataFrame, titles: DataFrame | dict[str, str] | None = None, max_chars: int = MAX_CONTEXT_CHARS
) -> DataFrame:
    """One text block per query: headlines, then events, each by distance.

    ``titles`` are rows (``query_id, title``) or a handful of named ones; a query without is told by its id.

    A query has at most its retrieval limit of documents, so the lists stay short.
    """
    score, g, n = F.col("sentiment_score"), F.col("goldstein_scale"), F.col("num_mentions")
    mood = F.when(score.isNotNull(), F.format_string(", sentiment: %+.2f", score)).otherwise("")
    tone = F.when(g.isNotNull(), F.concat(F.lit(", Goldstein: "), g.cast("string"))).otherwise("")
    cover = F.when(n > 0, F.concat(F.lit(", mentions: "), n.cast("string"))).otherwise("")
    headline = F.format_string("  [%s] (%s%s) %s", "day", F.coalesce("source", F.lit("unknown")), mood, "content")
    event = F.format_string("  [%s] %s (%s%s)", "day", "content", tone, cover)
    is_headline = F.col("source_type") == "headline"
    row = F.struct("distance", "doc_id", F.when(is_headline, headline).otherwise(event).alias("line"))

    def section(kind: str, name: str):
        lines = F.transform(F.array_sort(f"_{kind}"), lambda e: e["line"])
        head = F.concat(F.lit(f"{name} ("), F.size(lines).cast("string"), F.lit(" results):"))
        return F.when(
            F.size(lines) > 0, F.concat(F.lit("\n"), head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
        ).otherwise("")

    if isinstance(titles, dict):
        titles = docs.sparkSession.createDataFrame(list(titles.items()), "query_id string, title string")
    whole = F.concat(
        F.lit("=== RELEVANT INTELLIGENCE (query: "),
        F.coalesce("title", "query_id"),
        F.lit(") ===\n"),
        section("headlines", "HEADLINES"),
        section("events", "EVENTS"),
    )
    grouped = docs.groupBy("query_id").agg(
        F.collect_list(F.when(is_headline, row)).alias("_headlines"),
        F.collect_list(F.when(~is_headline, row)).alias("_events"),
    )
    titled = (
        grouped.withColumn("title", F.lit(None).cast("string")) if titles is None
        else grouped.join(titles.select("query_id", "title"), "query_id", "left")
    )
    return (
        titled.select("query_id", whole.alias("context"))
        .withColumn(
            "context",
            F.when(
                F.length("context") > max_chars,
                F.concat(F.substring("context", 1, max_chars), F.lit("\n... (truncated)")),
            ).otherwise(F.col("context")),
        )
    )


def build_context(
    headlines: DataFrame,
    events: DataFrame,
    queries: dict[str, str],
    encode: Callable[[list[str]], np.ndarray],
    limit: int = 15,
    start=None,
    end=None,
) -> DataFrame:
    """Text queries -> formatted context per query; ``encode`` embeds the query texts."""
    vectors = dict(zip(queries, np.asarray(encode(list(queries.values()))).tolist(), strict=True))
    return format_context(search_all(headlines, events, vectors, limit, start, end), queries)


def briefing_docs(
    headlines: DataFrame,
    events: DataFrame,
    topics: DataFrame | dict[str, list[float]],
    limit_per_topic: int = 5,
    start=None,
    end=None,
) -> DataFrame:
    """Documents of all topics in one job; content seen under an earlier topic (``topic_no``) drops."""
    if isinstance(topics, dict):
        topics = query_rows(headlines.sparkSession, topics)
    docs = search_all(headlines, events, topics, limit_per_topic, start, end)
    return dedup_docs_across_topics(docs.join(topics.select("query_id", "topic_no"), "query_id"))


def briefing_context(
    headlines: DataFrame,
    events: DataFrame,
    encode: Callable[[list[str]], np.ndarray],
    as_of,
    topics: list[str] | None = None,
    days_back: int = 3,
    limit_per_topic: int = 5,
) -> DataFrame:
    """One block over the default topics for the days up to ``as_of``."""
    topics = topics or TOPICS
    vectors = dict(zip(topics, np.asarray(encode(topics)).tolist(), strict=True))
    start = (pd.Timestamp(as_of) - pd.Timedelta(days=days_back)).date()
    docs = briefing_docs(headlines, events, vectors, limit_per_topic, start, as_of)
    return format_context(
        docs.withColumn("query_id", F.lit("briefing")),
        {"briefing": "situational awareness briefing"},
    )


# ---- enrichment ---------------------------------------------------------------------------
def pending_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows still without ``column``."""
    return df.filter(F.col(column).isNull())


def score_sentiment(
    df: DataFrame,
    column: str = "headline",
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]] | None = None,
) -> DataFrame:
    """Add sentiment_score and sentiment_label.

    ``load`` returns a scorer (texts -> [(label, confidence)]) and runs once per task. The
    default counts lexicon words inside the JVM.
    """
    if load is None:
        label, confidence = txt.lexicon_sentiment(column)
        scored = df.withColumns({"_label": label, "_confidence": confidence})
    else:

        @F.pandas_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scorer = load()
            for texts in batches:
                yield pd.DataFrame(scorer(texts.tolist()), columns=["label", "confidence"])

        scored = df.withColumn("_s", run(column)).withColumns(
            {"_label": F.col("_s.label"), "_confidence": F.col("_s.confidence")}
        ).drop("_s")
    score = X.sentiment_score(F.col("_label"), F.col("_confidence"))
    return (
        scored.withColumn("sentiment_score", score)
        .withColumn("sentiment_label", X.mood(F.col("sentiment_score")))
        .drop("_label", "_confidence")
    )


def embed_text(
    df: DataFrame,
    column: str,
    load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """Add ``embedding``: a unit vector per text.

    ``load`` returns an encoder and runs once per task; the default hashes words into
    ``dimensions`` counts with MLlib.
    """
    if load is None:
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(
            df.withColumn("_words", txt.words(F.coalesce(column, F.lit(""))))
        )
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
            "_words", "_tf", "_unit"
        )

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            x = np.asarray(encoder(texts.tolist()), dtype=np.float32)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.Series(list(x / np.where(size == 0, 1, size)))

    return df.withColumn("embedding", run(column))


def default_encoder(spark, dimensions: int = DIMENSIONS) -> Callable[[list[str]], np.ndarray]:
    """Encoder for a handful of query texts, by the same job as ``embed_text``."""

    def encode(texts: list[str]) -> np.ndarray:
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        got = embed_text(rows, "text", dimensions=dimensions).orderBy("i").collect()
        return np.array([r["embedding"] for r in got])

    return encode
