"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four fixed kinds of identifiers are found by expression and checked. They are the seeds: the
words around them make lexical patterns, and Spark scores the graph of patterns and instances
in rounds. A pattern counts for a kind by the share of its distinct fillers that are known to
be of that kind; a pattern of enough support and share lends its kind to fillers which look
like it but were not known (a number with a digit too few, an address with a blank). Those
become known, add support to further patterns, and so on until a round finds nothing.

Texts are scanned once, for the spans and for the few stretches that could be identifiers: each
run of neighbouring words, known spans cut out, that looks like a kind. The rounds work on that
table and never on texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm import storage

#: The kinds in their order, and the expression of each. Written so that Java's
#: matcher needs linear time and no recursion: a run is entered at its start only, and nothing
#: that was taken is given back where giving back can't help.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(EXPRESSIONS)
#: What a text must hold for an expression to be tried.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A word that holds a digit or an at-sign; group 1 is that word and the words with digits behind
#: it. No kind has more than 19 digits, so no run has more words than that.
WORD = r"(?<!\S)(?=([^\s0-9@]*+[0-9@]\S*+(?: {1,2}[^\s0-9]*+[0-9]\S*+){0,18}))\S++"
#: A word before " at "; group 1 is the whole.
AT = r"(?<!\S)(?=(\S++ at \S++))\S++"
#: How a filler of each kind must look, besides standing where that kind stands.
LOOKS = {
    "email": r"^\S+(?:@| at )\S+$",
    "ip": r"^[0-9a-fA-F]+(?:[.:][0-9a-fA-F]*){3,7}$",
    "card": r"^(?:[0-9][ .-]?){12,19}$",
    "phone": r"^[(+]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}$",
}
SUPPORT, SHARE = 3, 0.8


def located(text: str, expression: str, group: int = 0) -> Column:
    """``start, stop, value`` of each match, by code points: gaps and matches laid end to end.
    ``value`` is the group asked for, the places are those of the whole match."""
    lit = expression.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{lit}', 0)"
    if group:
        found = f"arrays_zip({found}, regexp_extract_all({text}, '{lit}', {group}))"
        m, value = "m.`0`", "m.`1`"
    else:
        m = value = "m"
    return F.expr(
        f"aggregate(zip_with({found}, split({text}, '{lit}', -1), (m, g) -> named_struct('m', {m}, 'v', {value}, 'g', length(g))), "
        "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,stop:int,value:string>>)), "
        "(acc, x) -> if(x.m is null, acc, named_struct('at', acc.at + x.g + length(x.m), 'out', concat(acc.out, array("
        "named_struct('start', acc.at + x.g, 'stop', acc.at + x.g + length(x.m), 'value', x.v))))), "
        "acc -> acc.out)"
    )


def holds(kind: str, value: Column) -> Column:
    """The checks after the expression."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


NO_SPANS = "cast(array() as array<struct<start:int,stop:int,value:string>>)"


def base_spans(text: str) -> Column:
    """``start, no, stop, value`` of the checked matches of all kinds, by start, then kind."""
    return F.array_sort(F.concat(*(spans_of(text, no, kind) for no, kind in enumerate(KINDS))))


def spans_of(text: str, no: int, kind: str) -> Column:
    gate = F.col(text).contains(GATES[kind]) if GATES[kind] else F.col(text).rlike(r"[0-9](?:[ -]?[0-9]){13}")
    found = F.filter(located(text, EXPRESSIONS[kind]), lambda s: holds(kind, s.value))
    return F.transform(
        F.when(gate, found).otherwise(F.expr(NO_SPANS)),
        lambda s: F.struct(s.start.alias("start"), F.lit(no).alias("no"), s.stop.alias("stop"), s.value.alias("value")),
    )


def merged(spans: str) -> Column:
    """``start, no, stop`` of sorted spans, overlapping ones as one under the first one's kind."""
    return F.expr(
        f"aggregate({spans}, cast(array() as array<struct<start:int,no:int,stop:int>>), (acc, s) -> "
        "if(size(acc) > 0 and element_at(acc, -1).stop > s.start, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'no', "
        "element_at(acc, -1).no, 'stop', greatest(element_at(acc, -1).stop, s.stop)))), "
        "concat(acc, array(named_struct('start', s.start, 'no', s.no, 'stop', s.stop)))))"
    )


def replaced(text: str, spans: str, by: str) -> Column:
    """``text`` with each of the merged spans replaced by the SQL expression ``by`` of ``s``."""
    return F.expr(
        f"concat(array_join(transform({spans}, (s, i) -> concat(substring({text}, "
        f"if(i = 0, 0, get({spans}, i - 1).stop) + 1, s.start - if(i = 0, 0, get({spans}, i - 1).stop)), "
        f"{by})), ''), substring({text}, element_at({spans}, -1).stop + 1))"
    )


def with_context(spans: Column, text: str) -> Column:
    """Adds the word before and the word after each span, in small letters."""
    def around(s: Column) -> Column:
        before = F.substring(F.col(text), F.greatest(F.lit(1), s.start - 39), F.least(F.lit(40), s.start))
        after = F.substring(F.col(text), s.stop + 1, F.lit(40))
        return F.struct(
            s.start.alias("start"), s.no.alias("no"), s.stop.alias("stop"), s.value.alias("value"),
            s.place.alias("place"), s.blank.alias("blank"),
            F.lower(F.regexp_extract(before, r"(\S+)\s*$", 1)).alias("before"),
            F.lower(F.regexp_extract(after, r"^\s*(\S+)", 1)).alias("after"),
        )
    return F.transform(spans, around)


def bare(start: Column, value: Column) -> Column:
    """``start, stop, value`` without the marks around it."""
    lead = F.length(F.regexp_extract(value, r"""^[\s"'\[<{,;:/|]+""", 0))
    core = F.regexp_replace(F.regexp_replace(value, r"""^[\s"'\[<{,;:/|]+""", ""), r"""[.,;:!?"'\]>}]+$""", "")
    return F.struct(
        (start + lead).alias("start"), (start + lead + F.length(core)).alias("stop"), core.alias("value")
    )


def candidates(text: str) -> Column:
    """Stretches that could be identifiers; ``no`` is null.

    From each word with a digit or an at-sign every run that looks like a kind, all with the
    longest as ``place``, as a place counts once in what a pattern holds; without any, all words
    of digits from there on. Then what stands around `` at ``, marked ``blank``.
    """
    def struct(c: Column, place: Column, blank: bool) -> Column:
        return F.struct(
            c.start.alias("start"), F.lit(None).cast("int").alias("no"), c.stop.alias("stop"), c.value.alias("value"),
            place.alias("place"), F.lit(blank).alias("blank"),
        )

    def runs(s: Column) -> Column:
        # Only what starts like a number goes on behind a blank.
        ends = F.when(s.value.rlike(r"""^[\["'<{,;:/|]*[(+]?[0-9][^ ]* """), True)
        parts = F.array(F.split(s.value, r"(?<=\S)(?= )|(?<= )(?=\S)"))
        each = F.flatten(F.transform(parts, lambda p: F.transform(
            F.sequence(F.lit(1), F.when(ends, F.size(p)).otherwise(1), F.lit(2)),
            lambda n: bare(s.start, F.array_join(F.slice(p, F.lit(1), n), "")),
        )))
        return F.struct(
            F.filter(each, lambda c: c.value.rlike("|".join(LOOKS.values()))).alias("fit"),
            bare(s.start, s.value).alias("whole"),
        )

    def listed_runs(w: Column) -> Column:
        none = F.filter(F.array(struct(w.whole, w.whole.value, False)), lambda c: F.length(c.value) >= 6)
        return F.when(
            F.size(w.fit) > 0, F.transform(w.fit, lambda c: struct(c, F.element_at(w.fit, -1).value, False))
        ).otherwise(none)

    holding = F.when(F.col(text).rlike("[0-9@]"), located(text, WORD, 1)).otherwise(F.expr(NO_SPANS))
    blank = F.when(F.col(text).contains(" at "), located(text, AT, 1)).otherwise(F.expr(NO_SPANS))
    blank = F.filter(F.transform(blank, lambda s: bare(s.start, s.value)), lambda c: c.value.rlike(LOOKS["email"]))
    return F.concat(
        F.flatten(F.transform(F.transform(holding, runs), listed_runs)),
        F.transform(blank, lambda c: struct(c, c.value, True)),
    )


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, base, seeds, others``: one pass over the texts."""
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    seeds = F.transform("base", lambda s: s.withField("place", s.value).withField("blank", F.lit(False)))
    rows = rows.withColumn("base", base_spans("text")).withColumn("seeds", with_context(seeds, "text"))
    # Line ends, which no run crosses, stand for the known spans; places stay as they are.
    rows = rows.withColumn("apart", merged("base"))
    cut = replaced("text", "apart", "repeat('\n', s.stop - s.start)")
    rows = rows.withColumn("cut", F.when(F.size("apart") > 0, cut).otherwise(F.col("text")))
    return rows.select("row", "id", "base", "seeds", with_context(candidates("cut"), "text").alias("others"))


def patterns(occurrences: DataFrame) -> DataFrame:
    """Each occurrence once for each lexical pattern: the word before, and both neighbours."""
    before = F.concat(F.lit("<"), "before")
    both = F.concat(F.lit("<"), "before", F.lit(" _ "), "after")
    found = F.explode(F.array(before, both)).alias("pattern")
    return occurrences.where("before <> ''").select("value", "no", "place", "blank", found).distinct()


def discovered(occurrences: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``value, no``: fillers that high-confidence patterns show to be of a kind, in rounds until
    one finds nothing.

    Words around `` at `` are mostly plain text: they count among a pattern's fillers only when
    it is to lend its kind to such words.
    """
    spark = occurrences.sparkSession
    graph, graph_at = storage.written(patterns(occurrences), "patterns")
    fillers = graph.select("pattern", "value", "place", "blank").distinct()
    total = fillers.select("pattern", "place", "blank").distinct().groupBy("pattern").agg(
        F.count("*").alias("total"), F.count_if(~F.col("blank")).alias("plain_total")
    )
    looks = F.array(*(F.when(F.col("value").rlike(LOOKS[k]), F.lit(i)) for i, k in enumerate(KINDS)))
    unknown = graph.where("no is null").withColumn("no", F.explode(F.array_compact(looks)))
    unknown = unknown.select("pattern", "value", "no", "blank").distinct()
    known, known_at = storage.written(
        graph.where("no is not null").select("value", "no", F.lit(False).alias("found")).distinct(), "known"
    )
    while True:
        held = (
            fillers.join(known, "value").select("pattern", "no", "place", "blank").distinct().groupBy("pattern", "no")
            .agg(F.count("*").alias("held"), F.count_if(~F.col("blank")).alias("plain_held")).join(total, "pattern")
        )
        strong = held.select("pattern", "no", F.inline(F.array(
            F.struct(F.lit(False).alias("blank"), F.col("plain_held").alias("held"), F.col("plain_total").alias("total")),
            F.struct(F.lit(True).alias("blank"), F.col("held").alias("held"), F.col("total").alias("total")),
        )))
        strong = (
            strong.where(F.col("held") >= support).where(F.col("held") >= share * F.col("total"))
            .select("pattern", "no", "blank", (F.col("held") / (F.col("total") + 1)).alias("score"))
        )
        fresh = (
            unknown.join(strong, ["pattern", "no", "blank"]).groupBy("value", "no")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
            .where(F.col("score") >= share * support / (support + 1))
            .groupBy("value").agg(F.max_by("no", F.struct("score", -F.col("no"))).alias("no"))
            .join(known, ["value"], "left_anti")
        )
        fresh, at = storage.written(fresh.withColumn("found", F.lit(True)), "found")
        if fresh.isEmpty():
            break
        more, more_at = storage.written(known.union(fresh), "known")
        storage.drop(spark, known_at, at)
        known, known_at = more, more_at
    found, _ = storage.written(known.where("found").select("value", "no"), "found")
    storage.drop(spark, graph_at, known_at, at)
    return found


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row, base, spans``: personal data of each text.

    ``base`` are the fixed kinds' spans, ``spans`` those and what the patterns discovered, each
    ``start, no, stop, value`` with code point places, the end exclusive, ``no`` counting
    ``KINDS``. A number and the longer run it begins may both be discovered. ``row`` is a hash of id and text by which spans meet their text again. Null texts
    are empty; every row gives one row, repeated and null ids too; equal rows have equal spans.
    """
    scan, _ = storage.written(scanned(docs, id_col, text_col), "scanned")
    seen = scan.select("row", F.explode(F.concat("seeds", "others")).alias("s")).select("row", "s.*")
    found = discovered(seen.select("value", "no", "place", "blank", "before", "after"))
    more = (
        seen.where("no is null").drop("no").join(found, "value")
        .groupBy("row").agg(F.collect_set(F.struct("start", "no", "stop", "value")).alias("more"))
    )
    return scan.join(more, "row", "left").select(
        F.col("id").alias(id_col), "row", "base",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.no), s.start.cast("string"), s.stop.cast("string"))), ","
    )


def masked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the first one's kind. Columns and rows stay as
    they are; texts without personal data, null and empty ones don't change.
    """
    spans = private_spans(docs, id_col, text_col).where("size(spans) > 0").select(
        F.col("row").alias("__row"), F.col("spans").alias("__spans")
    ).dropDuplicates(["__row"])
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    pieces = replaced(f"`{text_col}`", "__spans", f"get({names}, s.no)")
    rows = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col))).join(spans, "__row", "left")
    rows = rows.withColumn("__spans", F.when(F.col("__spans").isNotNull(), merged("__spans")))
    return rows.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(pieces)).select(*docs.columns)
