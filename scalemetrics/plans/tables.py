"""Tables the registered queries start from, derived by Spark from the given ones.

The given tables hold no questionnaire, so answers are computed from ``orders``:
integer arithmetic on MD5 prefixes of the order key, the same in every SQL engine.
Each derived table is written once per application in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scalemetrics.functions.draws import DRAWS_PER_DIGEST, decimals, draw_of_word, md5_words
from scalemetrics.operators import cleaning, items, norms as norm_ops, predict, scoring, selection, strata, sweep
from scalemetrics.operators.sessions import PoolItem
from scalemetrics.plans.sqlparts import SPREAD
from scalemetrics.spec import FIVE_DOMAIN as SPEC
from scalemetrics.workspace import written

SEED = 42
KEYS_AT_ONCE = 8192  # respondents hashed by one array operation


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _h(key: Column) -> Column:
    digest = F.md5(F.concat(key, F.lit("|"), F.col("o_orderkey").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def counted_origins(orders: DataFrame) -> DataFrame:
    """Respondents with their origin and its number of respondents: two narrow columns meet, not the answers.

    Keys are dealt out before they are hashed: a file of few row groups is read by few tasks.
    """
    orders = orders.select("o_orderkey", "o_custkey").repartition(orders.sparkSession.sparkContext.defaultParallelism, "o_orderkey")
    origin = F.when(_h(F.lit("ip")) % 10 < 6, F.col("o_orderkey")).otherwise(F.lit(10**12) + F.col("o_custkey"))
    keyed = orders.select("o_orderkey", origin.alias("origin"))
    return keyed.join(keyed.groupBy("origin").agg(F.count(F.lit(1)).cast("int").alias("origin_count")), "origin")


def derive_answers(respondents: DataFrame) -> DataFrame:
    """Answers of each respondent. A key has a hash per item and domain, so whole batches are hashed at once."""
    reverse = np.array([i in SPEC.reversed_items for i in SPEC.items])
    home = np.array([SPEC.domain_no[SPEC.domain_of[i]] - 1 for i in SPEC.items])

    def values(keys: np.ndarray) -> np.ndarray:
        """Items x rows."""
        names = (*SPEC.items, *SPEC.domains, "g", "bad")
        h = np.empty((len(names), len(keys)), np.int32)
        for rows, digits in decimals(keys):
            for n, name in enumerate(names):
                h[n, rows] = md5_words(f"{name}|".encode(), digits)[0] % (100 if name == "bad" else 1000)
        item, domain, g, bad = h[: len(home)], h[len(home) : -2], h[-2], h[-1] < 3
        raw = 1 + (5 * domain[home] + g + 4 * item) // 10 // 200
        raw[reverse] = SPEC.lo + SPEC.hi - raw[reverse]
        raw[SPEC.item_no["ext1"] - 1, bad] = 0
        return raw

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEYS_AT_ONCE):
                part = batch.slice(at, KEYS_AT_ONCE)
                key = part.column("respondent_id")
                unknown = key.is_null().to_numpy(zero_copy_only=False)  # no key, no answers
                cells = [pa.array(row, pa.int32(), mask=unknown) for row in values(key.fill_null(0).to_numpy())]
                yield pa.RecordBatch.from_arrays([part.column("origin"), key, *cells, part.column("origin_count")], names=columns)

    source = respondents.select("origin", F.col("o_orderkey").cast("long").alias("respondent_id"), "origin_count")
    columns = ["origin", "respondent_id", *SPEC.items, "origin_count"]
    return source.mapInArrow(derived, ", ".join(f"{c} {'int' if c in SPEC.items or c == 'origin_count' else 'long'}" for c in columns))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers: respondent_id, origin, origin_count and one column per item."""

    def build() -> DataFrame:
        respondents = counted_origins(table(spark, sf, "orders"))
        return derive_answers(respondents.repartition(spark.sparkContext.defaultParallelism, "o_orderkey"))

    return written(spark, f"answers|{sf}", build)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned and scored answers, written once as the table all statistics start from."""
    return written(spark, f"clean|{sf}", lambda: clean_rows(spark, sf))


def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Valid answers of unique origins, reverse-keyed, with domain scores: one narrow stage."""
    df = cleaning.unique_origin(cleaning.valid_answers(answers(spark, sf), SPEC))
    return scoring.domain_scores(cleaning.reverse_key(df, SPEC), SPEC).drop("origin", "origin_count")


def norms(spark: SparkSession, sf: str) -> DataFrame:
    """(form, domain, mean, sd, n) over the clean answers."""
    return written(spark, f"norms|{sf}", lambda: norm_ops.fit_norms(clean(spark, sf), SPEC).coalesce(1))


def full_norms(spark: SparkSession, sf: str) -> dict[str, tuple[float, float]]:
    return norm_ops.norm_values(norms(spark, sf), SPEC, "full")


def short_norms(spark: SparkSession, sf: str) -> dict[str, tuple[float, float]]:
    return norm_ops.norm_values(norms(spark, sf), SPEC, "short")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Clean answers with percentiles and the extraversion x stability stratum."""

    def build() -> DataFrame:
        df = scoring.score_percentiles(clean(spark, sf), full_norms(spark, sf), SPEC)
        df = strata.add_bins(df, {"ext_q": "ext_score", "est_q": "est_score"})
        return df.withColumn("split_stratum", strata.composite_stratum(["ext_q", "est_q"])).drop("ext_q", "est_q")

    return written(spark, f"scored|{sf}", build)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """The scored table with its exact stratified split, one Parquet folder per split."""
    return written(
        spark,
        f"responses|{sf}",
        lambda: strata.stratified_split(scored(spark, sf), "split_stratum", "respondent_id", seed=SEED),
        "split",
    )


def part(spark: SparkSession, sf: str, split: str) -> DataFrame:
    return responses(spark, sf).filter(F.col("split") == split)


SELECTIONS = {
    "short_form": [*SPEC.short_items],
    "first_n": [f"{d}{n}" for d in SPEC.domains for n in range(1, 5)],
}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction rows of two averaging scorers for every respondent."""
    return written(
        spark,
        f"predictions|{sf}",
        lambda: predict.averaging_predictions(scored(spark, sf), SPEC, SELECTIONS, full_norms(spark, sf), SPREAD),
        "method",
    )


def item_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Pair sums of the clean answers (a few hundred rows)."""
    return written(spark, f"item_sums|{sf}", lambda: items.item_sums(clean(spark, sf), SPEC).coalesce(1))


def item_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked items, one row each."""

    def build() -> DataFrame:
        correlations = items.item_domain_correlations(item_sums(spark, sf))
        return items.rank_items(correlations, items.response_distributions(clean(spark, sf), SPEC), SPEC).coalesce(1)

    return written(spark, f"item_pool|{sf}", build)


def r_bars(spark: SparkSession, sf: str) -> DataFrame:
    return items.inter_item_r(item_sums(spark, sf))


def selected(spark: SparkSession, sf: str) -> DataFrame:
    """(method, k, item, home_domain) of the whole method x K grid."""
    return written(
        spark, f"selected|{sf}",
        lambda: selection.selections(selection.placements(item_pool(spark, sf), SPEC), SPEC).coalesce(1),
    )


def sweep_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Score cells of every selection over all respondents."""
    return written(spark, f"cells|{sf}", lambda: sweep.score_cells(clean(spark, sf), selected(spark, sf), SPEC))


def at_most(df: DataFrame, rows: int) -> list[Row]:
    """Collect a table whose size the layout gives; a larger one is an error."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"expected at most {rows} rows")
    return found


def item_ranks(spark: SparkSession, sf: str) -> dict[str, int]:
    """Item -> rank; as many entries as the scale has items."""
    return {r["item"]: r["rank"] for r in at_most(item_pool(spark, sf).select("item", "rank"), SPEC.n_items)}


def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions: every respondent answers 8 to 50 items in a random order of their own."""
    n_items = SPEC.n_items

    def orders(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of answers per key, and its items in order (rows x items): ``draw_array`` and ``uniform`` of whole batches."""
        lengths, order = np.empty(len(keys), np.int64), np.empty((len(keys), n_items), np.int64)
        for rows, digits in decimals(keys):
            blocks = [md5_words(b"log|order|", digits, b"|%d" % b) for b in range((n_items - 1) // DRAWS_PER_DIGEST + 1)]
            order[rows] = np.concatenate(blocks)[:n_items].T.argsort(axis=1, kind="stable")
            lengths[rows] = 8 + np.floor(draw_of_word(md5_words(b"log|len|", digits, b"|0")[0]) * (n_items - 8 + 1))
        return lengths, order

    def sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(SPEC.items)
        for batch in batches:
            for at in range(0, batch.num_rows, KEYS_AT_ONCE):
                part = batch.slice(at, KEYS_AT_ONCE)
                keys = part.column("session").to_numpy()
                lengths, order = orders(keys)
                row, pos = np.nonzero(np.arange(n_items) < lengths[:, None])
                item = order[row, pos]
                values = part.column("answers").flatten().take(pa.array(row * n_items + item))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row]), pa.array(pos + 1, pa.int32()), names.take(pa.array(item)), values], names=["session", "pos", "item", "value"],
                )

    def build() -> DataFrame:
        taken = clean(spark, sf).select(F.col("respondent_id").alias("session"), F.array(*SPEC.items).alias("answers"))
        return taken.filter("session is not null").mapInArrow(sessions, "session long, pos int, item string, value int")

    return written(spark, f"answer_log|{sf}", build)


def r_bar_values(spark: SparkSession, sf: str) -> dict[str, float]:
    return {r["domain"]: r["r_bar"] for r in at_most(r_bars(spark, sf), len(SPEC.domains))}


def sds(spark: SparkSession, sf: str) -> dict[str, float]:
    return {d: sd for d, (_, sd) in full_norms(spark, sf).items()}


def pool_rows(spark: SparkSession, sf: str) -> list[PoolItem]:
    rows = at_most(item_pool(spark, sf).orderBy("rank"), SPEC.n_items)
    return [
        PoolItem(r["item"], r["home_domain"], SPEC.domain_no[r["home_domain"]], r["own_r"], r["rank"], r["domain_correlations"])
        for r in rows
    ]
