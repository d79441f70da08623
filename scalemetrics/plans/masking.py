"""Masks and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.operators import masks
from scalemetrics.operators.masks import MaskPlan
from scalemetrics.plans import itemstats  # noqa: F401  (registers the pool CTE)
from scalemetrics.plans.registry import query
from scalemetrics.plans.sqlparts import expanded, part, quota, row_hash, sql
from scalemetrics.plans.tables import SEED, SPEC, item_ranks, scored


def draws_sql(passes: int) -> tuple[str, str]:
    """Row and item draws: number 1..5 per row, 6..10 and 11..15 per domain, 16..65 and 66..115 per item."""
    u = lambda index: expanded("hh", index)
    rows = f"""SELECT rid, pass, hh, {u('1')} AS u_k, {u('2')} AS u_bucket, {u('3')} AS u_kind, {u('4')} AS u_hit, {u('5')} AS u_k2 FROM
      (SELECT rid, pass, {row_hash("' || CAST(42 + pass AS VARCHAR) || '", 'rid')} AS hh FROM good CROSS JOIN range(0, {passes}) p(pass))"""
    cells = f"""SELECT c.*, row_number() OVER (PARTITION BY rid, pass ORDER BY ub, ino) AS upos,
      row_number() OVER (PARTITION BY rid, pass, home ORDER BY ub, ino) AS dpos, dord, u_in FROM
      (SELECT r.*, pool.item, pool.ino, home, rank, in_short, {u('15 + pool.ino')} AS ub, -ln({u('65 + pool.ino')}) * (rank + 1) AS race
       FROM mrow{passes} r CROSS JOIN pool JOIN itm USING (item)) c
      JOIN (SELECT rid, pass, domain AS home, row_number() OVER (PARTITION BY rid, pass ORDER BY {u('5 + dno')}, dno) AS dord, {u('10 + dno')} AS u_in
            FROM mrow{passes} CROSS JOIN dom) USING (rid, pass, home)"""
    return rows, cells


for n_passes in (1, 3):
    rows_text, cells_text = draws_sql(n_passes)
    part(f"mrow{n_passes}", rows_text, "good")
    part(f"mcell{n_passes}", cells_text, f"mrow{n_passes}", "good", "pool", "itm", "dom")


def between(u: str, lo: int, hi: int) -> str:
    return f"({lo} + floor({u} * {hi - lo + 1}))"


def balanced_sql(n: int, lo: int, hi: int) -> str:
    later = f"row_number() OVER (PARTITION BY rid, pass, dpos <= {n} ORDER BY race, ino)"
    return f"(dpos <= {n} OR {later} <= greatest(0, {between('u_k', lo, hi)} - {5 * n}))"


WEIGHTED = f"row_number() OVER (PARTITION BY rid, pass ORDER BY race, ino) <= {between('u_k', 8, 40)}"
_SKEW = "(dord <= CASE WHEN u_hit < 0.6 THEN 1 ELSE 2 END)"
_HEAVY = "(dord <= CASE WHEN u_hit < 0.4 THEN 1 ELSE 2 END)"
IMBALANCED = f"""(CASE WHEN u_kind < 0.5 THEN rank <= {between('u_k2', 5, 25)}
  WHEN u_kind < 0.8 THEN NOT {_SKEW} AND row_number() OVER (PARTITION BY rid, pass, {_SKEW} ORDER BY upos) <= {between('u_k2', 5, 20)}
  ELSE dpos <= CASE WHEN {_HEAVY} THEN {between('u_in', 6, 8)} ELSE {between('u_in', 0, 1)} END END)"""


def bucketed_sql(short: bool, imb: bool) -> str:
    s = masks.bucket_shares(short, imb)
    edge = lambda n: repr(sum(s[: n + 1])) + "::DOUBLE"
    small, medium, large = (balanced_sql(*b) for b in masks.BUCKETS)
    shorts = f"WHEN u_bucket < {edge(1)} THEN in_short" if short else ""
    last = f"WHEN u_bucket < {edge(3)} THEN {large} ELSE {IMBALANCED} END" if imb else f"ELSE {large} END"
    return f"(CASE WHEN u_bucket < {edge(0)} THEN {small} {shorts} WHEN u_bucket < {edge(2)} THEN {medium} {last})"


def mask_sql(rule: str, passes: int = 1, extra: str = "") -> str:
    return sql(
        f"""SELECT rid AS respondent_id, {"CAST(pass AS INTEGER) AS pass, " if passes > 1 else ""}string_agg(item, ',' ORDER BY ino) FILTER (WHERE keep) AS kept,
        count(*) FILTER (WHERE keep) AS n_kept FROM (SELECT rid, pass, item, ino, {rule} AS keep FROM mcell{passes}) GROUP BY rid, pass""",
        f"mcell{passes}",
    )


def listed(df: DataFrame, *keys: str) -> DataFrame:
    names = masks.kept_names(SPEC)
    return df.select("respondent_id", *keys, F.when(masks.n_kept() > 0, names).alias("kept"), masks.n_kept().cast("bigint").alias("n_kept"))


def masked(spark: SparkSession, sf: str, plan: MaskPlan) -> DataFrame:
    return listed(masks.with_mask(scored(spark, sf).select("respondent_id"), SPEC, item_ranks(spark, sf), plan, seed=SEED))


@query("w13_weighted_mask", mask_sql(WEIGHTED))
def w13(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf, MaskPlan(balanced=False))


@query("w14_balanced_mask", mask_sql(balanced_sql(4, 20, 40)))
def w14(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf, MaskPlan())


@query("w15_imbalanced_mask", mask_sql(IMBALANCED))
def w15(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf, MaskPlan(only_imbalanced=True))


@query("w16_bucketed_mask", mask_sql(bucketed_sql(True, True)))
def w16(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf, MaskPlan(focused=True, with_imbalanced=True))


@query("w16_bucketed_without_short_form", mask_sql(bucketed_sql(False, False)))
def w16_plain(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf, MaskPlan(focused=True, short_form=False))


@query("w17_multi_pass", mask_sql(bucketed_sql(True, False), 3))
def w17(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf).select("respondent_id")
    return listed(masks.multi_pass(df, SPEC, item_ranks(spark, sf), MaskPlan(focused=True), 3, seed=SEED), "pass")


@query(
    "w18_mask_dispatch",
    sql(
        f"""SELECT plan, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS kept_cells FROM (
        SELECT plan, rid, count(*) FILTER (WHERE keep) AS n FROM (
          SELECT 'weighted' AS plan, rid, {WEIGHTED} AS keep FROM mcell1 UNION ALL SELECT 'balanced', rid, {balanced_sql(4, 20, 40)} FROM mcell1
          UNION ALL SELECT 'focused', rid, {bucketed_sql(True, False)} FROM mcell1) GROUP BY plan, rid) GROUP BY plan""",
        "mcell1",
    ),
)
def w18(spark: SparkSession, sf: str) -> DataFrame:
    plans = {"weighted": MaskPlan(balanced=False), "balanced": MaskPlan(), "focused": MaskPlan(focused=True, balanced=True)}
    df = scored(spark, sf).select("respondent_id")
    parts = [
        masks.with_mask(df, SPEC, item_ranks(spark, sf), p, seed=SEED).select(F.lit(name).alias("plan"), masks.n_kept().alias("n"))
        for name, p in plans.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("plan").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("kept_cells")
    )


@query(
    "w19_hold_out_then_mask",
    sql(
        f"""SELECT rid AS respondent_id, CAST(pass AS INTEGER) AS pass, held_out, string_agg(item, ',' ORDER BY ino) FILTER (WHERE keep) AS kept,
        count(*) FILTER (WHERE keep) AS n_kept FROM (SELECT rid, pass, item, ino, {balanced_sql(4, 20, 40)} AS keep FROM mcell3) JOIN
        (SELECT rid AS r, rn <= quota AS held_out FROM (SELECT rid, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {row_hash(SEED, 'rid')}, rid) AS rn FROM st)
         JOIN ({quota('st', 'stratum', 0.15)}) ON s = stratum) ON r = rid WHERE NOT (held_out AND pass > 0) GROUP BY rid, pass, held_out""",
        "mcell3", "st",
    ),
)
def w19(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf).select("respondent_id", "split_stratum")
    return listed(masks.hold_out_then_mask(df, SPEC, item_ranks(spark, sf), MaskPlan(), 3, seed=SEED), "pass", "held_out")
