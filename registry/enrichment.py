"""Retrieval, text enrichment and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.functions import text as txt
from eventlens.operators import dedup, events, quality, retrieval
from eventlens.plans import gold
from registry import query
from registry.sql import big, codes, cte, query as q, r

# ---- SQL: nearest neighbours --------------------------------------------------------------------
cte("queries", "SELECT 'q' || vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0")
cte(
    "head_corpus",
    """SELECT h.*, CAST(v.embedding AS DOUBLE[]) AS embedding FROM b_news_headlines h
       LEFT JOIN embeddings v ON v.vec_id = h.id""",
    "b_news_headlines",
)
cte(
    "event_corpus",
    """SELECT e.*, CAST(v.embedding AS DOUBLE[]) AS embedding
       FROM (SELECT * FROM be QUALIFY row_number() OVER (PARTITION BY global_event_id
               ORDER BY num_mentions DESC, num_sources DESC, id DESC, source_url DESC) = 1) e
       LEFT JOIN embeddings v ON v.vec_id * 8 + 1 = e.id""",
    "be",
)


def _near(name: str, corpus: str, id_column: str, k: int) -> None:
    cte(
        name,
        f"""SELECT * FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, {id_column}) AS rank
              FROM (SELECT query_id, c.*, round(list_cosine_distance(c.embedding, qv), 12) AS distance
                    FROM {corpus} c, queries WHERE c.embedding IS NOT NULL))
            WHERE rank <= {k}""",
        ("queries " + (corpus if corpus != "embeddings_d" else "embeddings_d")),
    )


cte("embeddings_d", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
_near("near_all", "embeddings_d", "vec_id", 10)
_near("near_heads", "head_corpus", "id", 7)
_near("near_events", "event_corpus", "id", 7)
cte(
    "found_heads",
    """SELECT query_id, 'headline' AS source_type, id AS doc_id, headline AS content, distance,
              strftime(published_at, '%Y-%m-%d') AS day, source, sentiment_score,
              NULL::DOUBLE AS goldstein_scale, NULL::INT AS num_mentions
       FROM near_heads WHERE distance <= 0.9""",
    "near_heads",
)
_NAME = "coalesce(nullif(actor{0}_name, ''), nullif(actor{0}_code, ''), 'Unknown')"
_PLACE = "coalesce(nullif(action_geo_name, ''), nullif(action_geo_country_code, ''), 'Unknown')"
cte(
    "found_events",
    f"""SELECT query_id, 'event' AS source_type, id AS doc_id,
               {_NAME.format(1)} || ' → ' || {_NAME.format(2)} || ' in ' || {_PLACE} AS content, distance,
               strftime(event_date, '%Y-%m-%d') AS day, NULL AS source, NULL::DOUBLE AS sentiment_score,
               goldstein_scale, num_mentions
        FROM near_events WHERE distance <= 0.9""",
    "near_events",
)
cte(
    "found",
    """SELECT * FROM (SELECT * FROM found_heads UNION ALL SELECT * FROM found_events)
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, source_type DESC, doc_id) <= 15""",
    "found_heads found_events",
)
DOC = "query_id, source_type, doc_id, content, day, source, " + big("num_mentions") + ", " + r(
    "distance", "sentiment_score", "goldstein_scale"
)


@query(
    "cosine_topk",
    q("SELECT query_id, vec_id, rank, " + r("distance") + " FROM near_all", "near_all"),
)
def _(f):
    return retrieval.cosine_topk(f.tables.raw("embeddings"), f.query_vectors, 10, "vec_id")


@query("search_headlines", q(f"SELECT {DOC} FROM found_heads", "found_heads"))
def _(f):
    return retrieval.search_headlines(f.headline_corpus, f.query_vectors, 7)


@query("search_events", q(f"SELECT {DOC} FROM found_events", "found_events"))
def _(f):
    return retrieval.search_events(f.event_corpus, f.query_vectors, 7)


@query("merge_ranked_docs", q(f"SELECT {DOC} FROM found", "found"))
def _(f):
    return retrieval.search_all(f.headline_corpus, f.event_corpus, f.query_vectors, 15)


cte(
    "blocks",
    """SELECT query_id,
              count(*) FILTER (source_type = 'headline') AS nh, count(*) FILTER (source_type = 'event') AS ne,
              string_agg('  [' || day || '] (' || coalesce(source, 'unknown') ||
                         coalesce(printf(', sentiment: %+.2f', sentiment_score), '') || ') ' || content, chr(10)
                         ORDER BY distance, doc_id) FILTER (source_type = 'headline') AS hs,
              string_agg('  [' || day || '] ' || content || ' (' ||
                         coalesce(', Goldstein: ' || CAST(goldstein_scale AS VARCHAR), '') ||
                         CASE WHEN num_mentions > 0 THEN ', mentions: ' || num_mentions ELSE '' END || ')', chr(10)
                         ORDER BY distance, doc_id) FILTER (source_type = 'event') AS es
       FROM found GROUP BY query_id""",
    "found",
)


@query(
    "format_context",
    q("""SELECT query_id, CASE WHEN length(t) > 4000 THEN substr(t, 1, 4000) || chr(10) || '... (truncated)' ELSE t END AS context
         FROM (SELECT query_id, '=== RELEVANT INTELLIGENCE (query: ' || query_id || ') ===' || chr(10) ||
                 CASE WHEN nh > 0 THEN chr(10) || 'HEADLINES (' || nh || ' results):' || chr(10) || hs || chr(10) ELSE '' END ||
                 CASE WHEN ne > 0 THEN chr(10) || 'EVENTS (' || ne || ' results):' || chr(10) || es || chr(10) ELSE '' END AS t
               FROM blocks)""", "blocks"),
)
def _(f):
    return retrieval.format_context(retrieval.search_all(f.headline_corpus, f.event_corpus, f.query_vectors, 15))


@query("build_context")
def _(f):
    """Text queries against headlines and events embedded by the default encoder."""
    dims = 64
    heads = retrieval.embed_text(f.bronze_headlines, "headline", dimensions=dims)
    evts = retrieval.embed_text(
        dedup.dedup_events(f.events).withColumn("_text", txt.event_text()), "_text", dimensions=dims
    )
    return retrieval.build_context(
        heads, evts, {"a": "action against ACTOR RUS", "b": "economic sanctions and trade disputes"},
        retrieval.default_encoder(f.spark, dims),
    )


@query("briefing_context")
def _(f):
    dims = 64
    heads = retrieval.embed_text(f.bronze_headlines, "headline", dimensions=dims)
    evts = retrieval.embed_text(
        dedup.dedup_events(f.events).withColumn("_text", txt.event_text()), "_text", dimensions=dims
    )
    return retrieval.briefing_context(
        heads, evts, retrieval.default_encoder(f.spark, dims), as_of="1995-12-31", days_back=365
    )


cte(
    "topic_docs",
    """SELECT * FROM (SELECT *, CAST(substr(query_id, 2) AS INT) AS topic_no FROM found)
       QUALIFY row_number() OVER (PARTITION BY content ORDER BY topic_no, distance, doc_id) = 1""",
    "found",
)


@query(
    "dedup_docs_across_topics",
    q("SELECT query_id, source_type, doc_id, content, " + r("distance") + " FROM topic_docs", "topic_docs"),
)
def _(f):
    return retrieval.briefing_docs(f.headline_corpus, f.event_corpus, f.query_vectors, 15).select(
        "query_id", "source_type", "doc_id", "content", "distance"
    )


# ---- text -----------------------------------------------------------------------------------------
_TEXT = (
    f"concat_ws('. ', {_NAME.format(1)} || ' action against ' || {_NAME.format(2)}, "
    "'in ' || coalesce(nullif(action_geo_name, ''), nullif(action_geo_country_code, '')), "
    "CASE WHEN goldstein_scale IS NOT NULL THEN printf('(%s, Goldstein: %.1f)', CASE WHEN goldstein_scale > 2 THEN "
    "'cooperative' WHEN goldstein_scale < -2 THEN 'conflictual' ELSE 'neutral' END, goldstein_scale) END, "
    "CASE WHEN num_mentions > 10 THEN 'Mentions: ' || num_mentions END)"
)


@query("event_text", q(f"SELECT id, source_url, {_TEXT} AS text FROM b_events", "b_events"))
def _(f):
    return f.bronze_events.select("id", "source_url", txt.event_text().alias("text"))


@query(
    "doc_event_summary",
    q(f"SELECT id, source_url, {_NAME.format(1)} || ' → ' || {_NAME.format(2)} || ' in ' || {_PLACE} AS content FROM b_events",
      "b_events"),
)
def _(f):
    return f.bronze_events.select("id", "source_url", txt.doc_event_summary().alias("content"))


cte(
    "words_map",
    "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{c}')" for w, c in ref.COUNTRY_WORDS.items()) + ") v(word, code)",
)
cte(
    "turn_countries",
    """SELECT c.conv_id, c.turn, list_sort(list_distinct(coalesce(list(w.code) FILTER (w.code IS NOT NULL), []))) AS cs
       FROM conversations c LEFT JOIN words_map w ON contains(lower(c.text), w.word) GROUP BY c.conv_id, c.turn""",
    "words_map",
)


@query(
    "query_countries",
    q("SELECT conv_id, turn, array_to_string(cs, ',') AS countries FROM turn_countries", "turn_countries"),
)
def _(f):
    c = txt.query_countries("text")
    return f.tables.raw("conversations").select("conv_id", "turn", F.array_join(c, ",").alias("countries"))


@query(
    "query_symbols",
    q("""SELECT t.conv_id, t.turn, string_agg(DISTINCT s.symbol, ',' ORDER BY s.symbol) AS symbols
         FROM turn_countries t JOIN (SELECT country_code, symbol FROM asset_map UNION ALL
           SELECT NULL, unnest(['SPY', 'GC=F', 'CL=F', '^VIX'])) s
           ON s.country_code IS NULL OR list_contains(t.cs, s.country_code) GROUP BY t.conv_id, t.turn""",
      "turn_countries asset_map"),
)
def _(f):
    s = txt.query_symbols(txt.query_countries("text"))
    return f.tables.raw("conversations").select("conv_id", "turn", F.array_join(s, ",").alias("symbols"))


@query(
    "pending_rows",
    q("SELECT id, published_at FROM b_news_headlines WHERE sentiment_score IS NULL",
      "b_news_headlines"),
)
def _(f):
    return retrieval.pending_rows(f.bronze_headlines, "sentiment_score").select(
        "id", "published_at"
    )


def _count_words(names) -> str:
    return f"len(list_filter(w, lambda x: x IN {codes(names)}))"


cte(
    "lexicon",
    f"""SELECT id, g, b, CASE WHEN g > b THEN (g - b) / (g + b) WHEN b > g THEN -(b - g) / (g + b) ELSE 0 END AS score
        FROM (SELECT id, {_count_words(txt.POSITIVE_WORDS)} AS g, {_count_words(txt.NEGATIVE_WORDS)} AS b
              FROM (SELECT id, regexp_split_to_array(lower(headline), '[^a-z]+') AS w FROM b_news_headlines))""",
    "b_news_headlines",
)


@query(
    "score_sentiment",
    q("SELECT id, " + r("score AS sentiment_score", d=4)
      + ", CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM lexicon",
      "lexicon"),
)
def _(f):
    return retrieval.score_sentiment(f.bronze_headlines.select("id", "headline")).drop("headline")


@query(
    "sentiment_label",
    q("SELECT sentiment_label AS label, CASE WHEN abs(sentiment_score) <= 0.1 THEN 'neutral' WHEN sentiment_score > 0 THEN "
      "'positive' ELSE 'negative' END AS by_score, count(*) AS n FROM b_news_headlines WHERE sentiment_score IS NOT NULL GROUP BY ALL",
      "b_news_headlines"),
)
def _(f):
    h = f.bronze_headlines.filter("sentiment_score IS NOT NULL")
    return h.groupBy(
        F.col("sentiment_label").alias("label"), X.mood(F.col("sentiment_score")).alias("by_score")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("embed_text")
def _(f):
    e = retrieval.embed_text(f.bronze_headlines.select("id", "headline"), "headline")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return e.select("id", F.size("embedding").alias("dims"), norm.alias("squared_norm"))


# ---- dossier: every turn is a question, about the days up to DAY -------------------------------------
DAY = "1998-06-30"
_LAST = f"BETWEEN DATE '{DAY}' - {{}} AND DATE '{DAY}'"
cte(
    "turn_symbols",
    """SELECT t.conv_id, t.turn, CASE WHEN len(t.cs) = 0 THEN """ + repr(ref.GLOBAL_SYMBOLS) + """
         ELSE list_sort(list(DISTINCT s.symbol)) END AS symbols
       FROM turn_countries t JOIN (SELECT country_code, symbol FROM asset_map UNION ALL
         SELECT NULL, unnest(['SPY', 'GC=F', 'CL=F', '^VIX'])) s
         ON s.country_code IS NULL OR list_contains(t.cs, s.country_code) GROUP BY t.conv_id, t.turn, t.cs""",
    "turn_countries asset_map",
)


def _dossier(f):
    from eventlens.plans import dossier

    turns = f.tables.raw("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query")
    )
    return dossier.query_dossier(turns, f.silver_market, f.events, f.bronze_headlines, DAY, "1995-01-01")


@query("query_dossier")
def _(f):
    """Rows per section for every conversation turn taken as a question."""
    from functools import reduce

    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("section"), "n_rows")
        for n, df in _dossier(f).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "dossier_scope",
    q("""SELECT conv_id || '-' || turn AS query_id, array_to_string(cs, ',') AS countries, array_to_string(symbols, ',') AS symbols
         FROM turn_countries JOIN turn_symbols USING (conv_id, turn)""", "turn_countries turn_symbols"),
)
def _(f):
    s = _dossier(f)["scope"]
    return s.select("query_id", F.array_join("countries", ",").alias("countries"), F.array_join("symbols", ",").alias("symbols"))


_BRIEF_SQL = ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c == "num_mentions" else c for c in events.BRIEF if c not in ("goldstein_scale", "avg_tone")
) + ", " + r("goldstein_scale", "avg_tone")


@query(
    "dossier_events",
    q(f"""SELECT country, {_BRIEF_SQL}
          FROM (SELECT *, unnest(list_distinct([actor1_country_code, actor2_country_code, country_code])) AS country FROM be
                WHERE event_date {_LAST.format(30)} AND num_mentions >= 200)
          WHERE country IN (SELECT unnest(cs) FROM turn_countries)""", "be turn_countries"),
)
def _(f):
    return _dossier(f)["events"].withColumn("num_mentions", F.col("num_mentions").cast("long"))


@query(
    "dossier_event_summary",
    q(f"""SELECT action_geo_country_code AS country_code, count(*) AS count FROM be
          WHERE action_geo_country_code <> '' AND event_date {_LAST.format(30)} GROUP BY 1""", "be"),
)
def _(f):
    return _dossier(f)["event_summary"]


@query(
    "dossier_market",
    q("SELECT symbol, date, " + big("volume") + ", " + r("open", "high", "low", "close", "daily_return")
      + f" FROM silver_market WHERE date {_LAST.format(7)} AND symbol IN (SELECT unnest(symbols) FROM turn_symbols)",
      "silver_market turn_symbols"),
)
def _(f):
    return _dossier(f)["market"]


# ---- data quality ------------------------------------------------------------------------------------
def _tables(f):
    return {
        "silver_events": f.silver_events,
        "silver_market": f.silver_market,
        "silver_headlines": f.silver_headlines,
        "silver_event_market": f.silver_event_market,
        "gold_geopolitical_daily": f.gold_geo,
        "gold_market_daily": f.gold_market,
        "gold_sentiment_daily": f.gold_sentiment,
        "gold_economic_snapshot": gold.gold_economic_snapshot(f.indicators),
        "gold_daily_summary": f.gold_summary,
    }


_CTE_OF = {
    "gold_geopolitical_daily": "gold_geo", "gold_market_daily": "gold_market", "gold_sentiment_daily": "gold_sentiment",
    "gold_economic_snapshot": "gold_econ", "gold_daily_summary": "gold_summary",
}


def _src(t: str) -> str:
    return _CTE_OF.get(t, t)


_NOT_NULL = [
    f"SELECT 'not_null' AS \"check\", '{t}' AS \"table\", '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS failures FROM {_src(t)}"
    for t, cs in quality.NOT_NULL.items() for c in cs
]
_UNIQUE = [
    f"SELECT 'unique' AS \"check\", '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS failures FROM "
    f"(SELECT {c} FROM {_src(t)} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"
    for t, c in quality.UNIQUE.items()
]
_ACCEPTED = [
    f"SELECT 'accepted_values' AS \"check\", '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS failures FROM {_src(t)} "
    f"WHERE {c} NOT IN {codes(v)}"
    for t, c, v in quality.ACCEPTED
]
_DATES = ("SELECT 'no_null_dates' AS \"check\", 'gold_daily_summary' AS \"table\", 'summary_date' AS \"column\", "
          "count(*) FILTER (summary_date IS NULL) AS failures FROM gold_summary")
_MENTIONS = ("SELECT 'non_negative_mentions' AS \"check\", 'gold_geopolitical_daily' AS \"table\", 'total_mentions' AS \"column\", "
             "count(*) FILTER (total_mentions < 0) AS failures FROM gold_geo")
_RISK = ("SELECT 'valid_risk' AS \"check\", 'gold_daily_summary' AS \"table\", 'risk_level' AS \"column\", "
         "count(*) FILTER (risk_level NOT IN ('low', 'elevated', 'high')) AS failures FROM gold_summary")
_EVERY = "silver_events silver_market silver_headlines silver_event_market gold_geo gold_market gold_sentiment gold_econ gold_summary"


@query("dq_not_null", q(" UNION ALL ".join(_NOT_NULL), _EVERY))
def _(f):
    parts = [quality.dq_not_null(_tables(f)[t], t, cs) for t, cs in quality.NOT_NULL.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_unique", q(" UNION ALL ".join(_UNIQUE), "silver_events silver_headlines gold_summary"))
def _(f):
    t = _tables(f)
    parts = [quality.dq_unique(t[n], n, c) for n, c in quality.UNIQUE.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dq_accepted_values", q(" UNION ALL ".join(_ACCEPTED), _EVERY))
def _(f):
    t = _tables(f)
    parts = [quality.dq_accepted_values(t[n], n, c, v) for n, c, v in quality.ACCEPTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_no_null_dates", q(_DATES, "gold_summary"))
def _(f):
    return quality.dq_no_null_dates(f.gold_summary)


@query("dq_non_negative_mentions", q(_MENTIONS, "gold_geo"))
def _(f):
    return quality.dq_non_negative_mentions(f.gold_geo)


@query("dq_valid_risk", q(_RISK, "gold_summary"))
def _(f):
    return quality.dq_valid_risk(f.gold_summary)


@query(
    "dq_report",
    q("SELECT *, failures = 0 AS passed FROM (" + " UNION ALL ".join([*_NOT_NULL, *_UNIQUE, *_ACCEPTED, _DATES, _RISK, _MENTIONS]) + ")",
      _EVERY),
)
def _(f):
    return quality.dq_report(_tables(f))
