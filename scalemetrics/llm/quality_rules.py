"""Quality rules with thresholds learnt from the corpus itself, per language and source.

Every measure is an integer. A sketch counts documents per value rounded down to seven significant bits,
so sketches of parts add up to the sketch of the whole, hold at most a few hundred counters and return
quantiles within 1/64 of their value. The fences q25 - 3 * spread and q75 + 3 * spread replace fixed cutoffs:
a measure that is ordinary for its language and source never fails.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scalemetrics.llm.common import source_key, table, words
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

# The symbols that count, and the capitals of the Latin letters.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
WHITE = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Parts per million, except mean_word (thousandths of a character); the least spread that a fence allows for.
SPREADS = {"symbol_share": 10_000, "capital_share": 30_000, "shout_share": 10_000, "dup_line_share": 50_000, "repeat_share": 40_000, "mean_word": 600}
LOW_FENCE = ("mean_word",)
FACTOR = 3
#: Groups with fewer documents use the sketch of their language, and languages that of all documents.
LEAST_DOCS = 30


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    Windows are compared by a 64-bit hash; they are sorted only in texts that repeat one, so a text of n words
    costs n log n at most. The array is bound first: wherever Spark puts this expression, the text is split once
    and not once per word.
    """
    return bind(w, repeated_in).cast("long")


def repeated_in(w: Column) -> Column:
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    hashes = F.when(n >= 4, hashes).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            again = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def width(s: Column) -> Column:
            gaps = F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return bind(bind(placed, starts), width)

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_stats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Add a column ``__q`` with the counts of the text, its measures and ``base_failed``; null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumn("__w", words(t))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    counts = with_words.withColumn(
        "__c",
        F.struct(
            F.size("__w").cast("long").alias("n_words"),
            without(t, WHITE).alias("word_chars"),
            (F.length(t) - without(t, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.length(t) - without(t, CAPITALS)).cast("long").alias("n_capitals"),
            (F.length(t) - without(t, "!")).cast("long").alias("n_shouts"),
            bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeated_words(F.col("__w")).alias("n_repeat_words"),
        ),
    ).drop("__w")
    c = F.col("__c")

    def share(count: Column, of: Column, unit: int = 1_000_000) -> Column:
        return F.call_function("div", count * unit, F.greatest(of, F.lit(1)).cast("long"))

    failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
    q = F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        share(c["n_symbols"], c["word_chars"]).alias("symbol_share"), share(c["n_capitals"], c["word_chars"]).alias("capital_share"),
        share(c["n_shouts"], c["word_chars"]).alias("shout_share"), share(c["lines"]["dup"], c["lines"]["all"]).alias("dup_line_share"),
        share(c["n_repeat_words"], c["n_words"]).alias("repeat_share"), share(c["word_chars"], c["n_words"], 1000).alias("mean_word"),
    )
    return counts.withColumn("__q", q).drop("__c")


def rounded(value: Column) -> Column:
    """A non-negative integer rounded down to seven significant bits: the counter of the sketch that it belongs to."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(stats: DataFrame, measures: Mapping[str, int], lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketch per (lang, source, measure): one row per counter with its number of documents."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"__q.{m}").alias("value")) for m in measures]))
    long = stats.select(source_key(F.col(lang)).alias("lang_key"), source_key(F.col(source)).alias("source_key"), values.alias("m"))
    return long.groupBy("lang_key", "source_key", F.col("m.measure").alias("measure"), rounded(F.col("m.value")).alias("counter")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, measures: Mapping[str, int], factor: int = FACTOR, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Lower and upper fence of each measure, one row per (lang_key, source_key).

    Sketches of sources add up to that of their language and these to that of all documents; groups with fewer than
    ``least_docs`` documents take the fences of the next larger one.
    """

    def quartiles(s: DataFrame, *keys: str) -> DataFrame:
        whole = W.partitionBy(*keys, "measure")
        ranked = s.groupBy(*keys, "measure", "counter").agg(F.sum("n").alias("n"))
        ranked = ranked.withColumn("upto", F.sum("n").over(whole.orderBy("counter"))).withColumn("docs", F.sum("n").over(whole))
        q = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("counter")))
        return ranked.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), q(1).alias("q1"), q(3).alias("q3"))

    own = quartiles(sketch, "lang_key", "source_key")
    by_lang = quartiles(sketch, "lang_key").select("lang_key", "measure", F.struct("docs", "q1", "q3").alias("l"))
    every = quartiles(sketch).select("measure", F.struct("q1", "q3").alias("e"))
    joined = own.join(by_lang, ["lang_key", "measure"]).join(every, "measure")
    used = F.when(F.col("docs") >= least_docs, F.struct("q1", "q3")).when(F.col("l.docs") >= least_docs, F.struct("l.q1", "l.q3")).otherwise(F.col("e"))
    least = F.create_map(*[F.lit(x) for pair in measures.items() for x in pair])
    spread = F.greatest(F.col("u.q3") - F.col("u.q1"), least[F.col("measure")].cast("long"))
    each = joined.withColumn("u", used).select(
        "lang_key", "source_key", "measure", (F.col("u.q1") - factor * spread).alias("low"), (F.col("u.q3") + factor * spread).alias("high")
    )
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return each.groupBy("lang_key", "source_key").agg(*[pick(m, c).alias(f"__{c}_{m}") for m in measures for c in ("low", "high")])


def judge(stats: DataFrame, limits: DataFrame, measures: Mapping[str, int], lang: str = "lang", source: str = "source") -> DataFrame:
    """Join the fences and add ``__kept``: within every fence, and not failed by the base rules."""
    limits = limits.withColumnsRenamed({"lang_key": "__lang", "source_key": "__source"})
    joined = stats.join(limits, (source_key(F.col(lang)) == F.col("__lang")) & (source_key(F.col(source)) == F.col("__source")), "left")
    inside = F.lit(True)
    for m in measures:
        inside = inside & F.coalesce(F.col(f"__q.{m}") <= F.col(f"__high_{m}"), F.lit(True))
        if m in LOW_FENCE:
            inside = inside & F.coalesce(F.col(f"__q.{m}") >= F.col(f"__low_{m}"), F.lit(True))
    # one expression over both sides of the join: as a conjunct of its own, base_failed would be moved below the
    # projection of the counts, and these be computed twice
    kept = F.when(F.col("__q.base_failed"), F.lit(False)).otherwise(inside)
    return joined.withColumn("__kept", kept).drop(*limits.columns)


def quality_rules(docs: DataFrame, measures: Mapping[str, int] = SPREADS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: all columns but the text, ``q`` (counts, measures, ``base_failed``) and ``kept``;
    columns of these two names are replaced.

    Null texts have no words and fail the base rules. Null languages and sources are groups of their own. Repeated
    rows are judged each. The statistics are written once, since the thresholds and the filter both need them.
    """
    stats = settle(text_stats(docs, text).drop(text))
    limits = settle(fences(sketches(stats, measures, lang, source), measures))
    judged = judge(stats, limits, measures, lang, source)
    return judged.select(*[c for c in stats.columns if c not in ("q", "kept", "__q")], F.col("__q").alias("q"), F.col("__kept").alias("kept"))


def filter_documents(docs: DataFrame, measures: Mapping[str, int] = SPREADS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, whole and with their own columns.

    Counts the texts twice, once for the thresholds and once for the filter, instead of writing them a second time.
    """
    stats = text_stats(docs, text)
    slim = stats.select(lang, source, "__q")
    limits = settle(fences(sketches(slim, measures, lang, source), measures))
    return judge(stats, limits, measures, lang, source).filter("__kept").select(docs.columns)


CAP_CLASS = f"[{CAPITALS}]"
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '{CAP_CLASS}', '', 'g')) AS n_capitals,
         length(t) - length(replace(t, '!', '')) AS n_shouts,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
s AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         n_symbols * 1000000 // greatest(word_chars, 1) AS symbol_share, n_capitals * 1000000 // greatest(word_chars, 1) AS capital_share,
         n_shouts * 1000000 // greatest(word_chars, 1) AS shout_share, n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_line_share,
         n_repeat_words * 1000000 // greatest(n_words, 1) AS repeat_share, word_chars * 1000 // greatest(n_words, 1) AS mean_word
  FROM c),
long AS (UNPIVOT s ON symbol_share, capital_share, shout_share, dup_line_share, repeat_share, mean_word INTO NAME measure VALUE value),
counters AS (
  SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) AS counter FROM long),
own AS (
  SELECT lang, source, measure, count(*) AS docs, quantile_disc(counter, 0.25) AS q1, quantile_disc(counter, 0.75) AS q3 FROM counters GROUP BY ALL),
bylang AS (SELECT lang, measure, count(*) AS docs, quantile_disc(counter, 0.25) AS q1, quantile_disc(counter, 0.75) AS q3 FROM counters GROUP BY ALL),
every AS (SELECT measure, quantile_disc(counter, 0.25) AS q1, quantile_disc(counter, 0.75) AS q3 FROM counters GROUP BY ALL),
used AS (
  SELECT own.lang, own.source, own.measure,
         CASE WHEN own.docs >= {LEAST_DOCS} THEN own.q1 WHEN bylang.docs >= {LEAST_DOCS} THEN bylang.q1 ELSE every.q1 END AS q1,
         CASE WHEN own.docs >= {LEAST_DOCS} THEN own.q3 WHEN bylang.docs >= {LEAST_DOCS} THEN bylang.q3 ELSE every.q3 END AS q3,
         CASE own.measure {" ".join(f"WHEN '{m}' THEN {v}" for m, v in SPREADS.items())} END AS least
  FROM own JOIN bylang USING (lang, measure) JOIN every USING (measure)),
limits AS (
  SELECT lang, source, measure, q3 + {FACTOR} * greatest(q3 - q1, least) AS high,
         CASE WHEN measure IN ('{"', '".join(LOW_FENCE)}') THEN q1 - {FACTOR} * greatest(q3 - q1, least) ELSE -1 END AS low
  FROM used),
verdict AS (
  SELECT doc_id, bool_and(value <= high AND value >= low) AS inside FROM long JOIN limits USING (lang, source, measure) GROUP BY doc_id)
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, NOT s.base_failed AND inside AS kept
FROM s JOIN verdict USING (doc_id)
"""


@query("op10_quality_rules", ORACLE)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "kept")
