"""Common table expressions the oracle statements are put together from.

They work on long tables (one row per respondent and item or domain), while the
DataFrame operators work on wide ones, so the two sides share no formulation.
"""

from __future__ import annotations

from scalemetrics.functions.draws import MIX1, MIX2, STEP
from scalemetrics.functions.normal import DENOMINATOR, NUMERATOR, SQRT_2PI, TAIL_FROM
from scalemetrics.spec import FIVE_DOMAIN as SPEC

# Half-width of the averaging intervals.  Scores move in tenths and means of n items in 1/n,
# so no interval end can coincide with a target: at 0.5 some did, and whether they counted as
# covered depended on the last bit of the norms.
SPREAD = 0.53

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, text: str, *needs: str) -> None:
    PARTS[name] = (needs, text)


def sql(body: str, *needs: str) -> str:
    """Prefix a SELECT with the CTEs it needs, in dependency order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for n in PARTS[name][0]:
                add(n)
            done.append(name)

    for n in needs:
        add(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in done)
    return f"WITH {ctes}\n{body}" if done else body


def h(key_sql: str, id_sql: str = "o_orderkey") -> str:
    return f"CAST('0x' || substr(md5(concat({key_sql}, '|', CAST({id_sql} AS VARCHAR))), 1, 8) AS BIGINT)"


def row_hash(seed: object, id_sql: str) -> str:
    return f"CAST('0x' || substr(md5(concat('{seed}|', CAST({id_sql} AS VARCHAR))), 1, 15) AS BIGINT)"


def uniform(seed: object, stream: str, id_sql: str, index_sql: str) -> str:
    """Four 32-bit draws per digest; ``index_sql`` is the draw number."""
    word = (
        f"substr(md5(concat({seed}, '|{stream}|', CAST({id_sql} AS VARCHAR), '|', CAST(({index_sql}) // 4 AS VARCHAR))),"
        f" CAST((({index_sql}) % 4) * 8 + 1 AS INTEGER), 8)"
    )
    return f"((CAST(CAST('0x' || {word} AS BIGINT) AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE))"


def _mod64(x: str) -> str:
    return f"CAST(({x}) & CAST(18446744073709551615 AS UHUGEINT) AS UBIGINT)"


def _u128(x: object) -> str:
    return f"CAST({x} AS UHUGEINT)"


def expanded(hash_sql: str, index_sql: str) -> str:
    """SplitMix64 expansion of a row hash; unsigned 128-bit products stand for wrap-around."""
    mix = lambda z, shift, by: f"list_transform([{z}], lambda v: {_mod64(_u128(f'xor(v, v >> {shift})') + ' * ' + _u128(by))})[1]"
    z1 = _mod64(f"{_u128(hash_sql)} + {_u128(index_sql)} * {_u128(STEP)}")
    z3 = mix(mix(z1, 30, MIX1), 27, MIX2)
    return f"list_transform([{z3}], lambda v: CAST(xor(v, v >> 31) >> 11 AS DOUBLE) / 9007199254740992)[1]"


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    acc = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        acc = f"({acc} * {x} + CAST({c!r} AS DOUBLE))"
    return acc


def phi(z: str) -> str:
    """Normal distribution function of a column name."""
    a = f"least(abs({z}), CAST(37 AS DOUBLE))"
    dens = f"exp(-{a} * {a} / CAST(2 AS DOUBLE))"
    near = f"({dens} * {_horner(a, NUMERATOR)} / {_horner(a, DENOMINATOR)})"
    far = (
        f"({dens} / ({a} + 1.0::DOUBLE / ({a} + 2.0::DOUBLE / ({a} + 3.0::DOUBLE / ({a} + 4.0::DOUBLE / "
        f"({a} + 0.65::DOUBLE))))) / {SQRT_2PI}::DOUBLE)"
    )
    up = f"(CASE WHEN {a} < {TAIL_FROM}::DOUBLE THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN CAST(1 AS DOUBLE) - {up} ELSE {up} END)"


def pct(z: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * {phi(z)}))"


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def corr(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"


def values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"'{v}'" if isinstance(v, str) else ("NULL" if v is None else str(v))

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


part("dom", f"SELECT * FROM ({values([(d, n) for d, n in SPEC.domain_no.items()])}) t(domain, dno)")
part(
    "itm",
    "SELECT * FROM ("
    + values([
        (
            i, SPEC.domain_of[i], int(i[3:]), SPEC.item_no[i], i in SPEC.reversed_items, i in SPEC.short_items,
            SPEC.short_form[SPEC.domain_of[i]].index(i) + 1 if i in SPEC.short_items else None,
        )
        for i in SPEC.items
    ])
    + ") t(item, domain, num, ino, rev, in_short, spos)",
)
part(
    "resp0",
    f"""SELECT o_orderkey AS rid,
    CASE WHEN {h("'ip'")} % 10 < 6 THEN o_orderkey ELSE 1000000000000 + o_custkey END AS origin,
    {h("'g'")} % 1000 AS g, {h("'bad'")} % 100 AS bad FROM orders""",
)
part("oc", "SELECT origin, count(*) AS origin_count FROM resp0 GROUP BY origin", "resp0")
part(
    "raw",
    f"""SELECT rid, origin, domain, item, num, ino, rev, in_short, spos,
    CAST(CASE WHEN item = 'ext1' AND bad < 3 THEN 0 WHEN rev THEN 6 - v ELSE v END AS INTEGER) AS val
    FROM (SELECT *, 1 + ((5 * dv + g + 4 * ({h("item", "rid")} % 1000)) // 10) // 200 AS v
          FROM (SELECT r.*, d.domain, {h("d.domain", "rid")} % 1000 AS dv FROM resp0 r CROSS JOIN dom d)
          JOIN itm USING (domain))""",
    "resp0", "dom", "itm",
)
part(
    "good",
    """SELECT rid FROM raw JOIN oc USING (origin) GROUP BY rid
    HAVING min(val) >= 1 AND max(val) <= 5 AND max(origin_count) = 1""",
    "raw", "oc",
)
part(
    "cl",
    """SELECT rid, domain, item, num, ino, rev, in_short, spos, CASE WHEN rev THEN 6 - val ELSE val END AS x
    FROM raw JOIN good USING (rid)""",
    "raw", "good",
)
part("sc", "SELECT rid, domain, sum(x)::DOUBLE / count(x) AS score FROM cl GROUP BY rid, domain", "cl")
part("ssc", "SELECT rid, domain, sum(x)::DOUBLE / count(x) AS score FROM cl WHERE in_short GROUP BY rid, domain", "cl")
part(
    "nm",
    """SELECT 'full' AS form, domain, avg(score) AS mean, stddev_samp(score) AS sd, count(*) AS n FROM sc GROUP BY domain
    UNION ALL
    SELECT 'short', domain, avg(score), stddev_samp(score), count(*) FROM ssc GROUP BY domain""",
    "sc", "ssc",
)
part(
    "pc",
    f"""SELECT rid, domain, score, z, {pct('z')} AS pct FROM
    (SELECT rid, sc.domain, score, (score - mean) / sd AS z FROM sc JOIN nm ON nm.domain = sc.domain AND form = 'full')""",
    "sc", "nm",
)
part(
    "edges",
    """SELECT domain, e FROM (SELECT domain, unnest(quantile_cont(score, [0.2, 0.4, 0.6, 0.8])) AS e FROM sc GROUP BY domain)
    JOIN (SELECT domain, min(score) AS lo, max(score) AS hi FROM sc GROUP BY domain) USING (domain)
    WHERE e > lo AND e < hi GROUP BY domain, e""",
    "sc",
)
part(
    "bins",
    """SELECT rid, sc.domain, score, count(e) AS q FROM sc LEFT JOIN edges ON edges.domain = sc.domain AND e < score
    GROUP BY rid, sc.domain, score""",
    "sc", "edges",
)
part(
    "st",
    """SELECT rid, CAST(5 * max(CASE WHEN domain = 'ext' THEN q END) + max(CASE WHEN domain = 'est' THEN q END) AS SMALLINT) AS stratum,
    CAST(25 * max(CASE WHEN domain = 'ext' THEN q END) + 5 * max(CASE WHEN domain = 'est' THEN q END)
      + max(CASE WHEN domain = 'opn' THEN q END) AS SMALLINT) AS stratum3 FROM bins GROUP BY rid""",
    "bins",
)


def merged(source: str, col: str) -> str:
    """Nearest populated stratum for strata with fewer than three rows."""
    return f"""SELECT c.s, CASE WHEN c.n >= 3 THEN c.s ELSE coalesce((SELECT arg_min(p.s, abs(CAST(p.s AS BIGINT) - c.s) * 1000 + p.s)
      FROM (SELECT {col} AS s, count(*) AS n FROM {source} GROUP BY 1) p WHERE p.n >= 3), 0) END AS m
      FROM (SELECT {col} AS s, count(*) AS n FROM {source} GROUP BY 1) c"""


def quota(source: str, col: str, fraction: float) -> str:
    """Largest-remainder quota per stratum adding up to ceil(fraction * N)."""
    return f"""SELECT s, b + CASE WHEN row_number() OVER (ORDER BY rem DESC, s) <= t - sum(b) OVER () THEN 1 ELSE 0 END AS quota
      FROM (SELECT s, t, (n * t) // tot AS b, (n * t) % tot AS rem FROM (
        SELECT s, n, CAST(sum(n) OVER () AS BIGINT) AS tot,
          CAST(ceil(CAST({fraction!r} AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS t
        FROM (SELECT {col} AS s, count(*) AS n FROM {source} GROUP BY 1)))"""


part("m1", merged("st", "stratum"), "st")
part("st1", f"SELECT rid, stratum, m AS ms, {row_hash(42, 'rid')} AS hh FROM st JOIN m1 ON s = stratum", "st", "m1")
part("q1", quota("st1", "ms", 0.15), "st1")
part(
    "t1",
    """SELECT rid, stratum, hh, rn <= quota AS is_test FROM
    (SELECT *, row_number() OVER (PARTITION BY ms ORDER BY hh, rid) AS rn FROM st1) JOIN q1 ON s = ms""",
    "st1", "q1",
)
part("rest", "SELECT rid, stratum, hh FROM t1 WHERE NOT is_test", "t1")
part("m2", merged("rest", "stratum"), "rest")
part("st2", "SELECT rid, stratum, m AS ms, hh FROM rest JOIN m2 ON s = stratum", "rest", "m2")
part("q2", quota("st2", "ms", 0.15 / (1 - 0.15)), "st2")
part(
    "sp",
    """SELECT rid, stratum, 'test' AS split FROM t1 WHERE is_test
    UNION ALL
    SELECT rid, stratum, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END FROM
    (SELECT *, row_number() OVER (PARTITION BY ms ORDER BY hh, rid) AS rn FROM st2) JOIN q2 ON s = ms""",
    "t1", "st2", "q2",
)


# Two scorers by averaging, both with 20 items: the short form and the first four items of
# every domain.  The interval ends are the means of the halves, moved out by SPREAD.
part(
    "pred0",
    f"""SELECT rid, domain, method, avg(x) AS raw_pred, avg(x) FILTER (WHERE p <= 2) - {SPREAD}::DOUBLE AS raw_lower,
    avg(x) FILTER (WHERE p > 2) + {SPREAD}::DOUBLE AS raw_upper FROM (
      SELECT rid, domain, x, 'short_form' AS method, spos AS p FROM cl WHERE in_short
      UNION ALL SELECT rid, domain, x, 'first_n', num FROM cl WHERE num <= 4) GROUP BY ALL""",
    "cl",
)
part(
    "pred1",
    f"""SELECT rid, domain, method, raw_pred, raw_lower, raw_upper, raw_true, true_pct,
    {pct('zl')} AS l0, {pct('zp')} AS p0, {pct('zu')} AS u0 FROM
    (SELECT pred0.*, pc.score AS raw_true, pc.pct AS true_pct, (raw_lower - mean) / sd AS zl, (raw_pred - mean) / sd AS zp,
     (raw_upper - mean) / sd AS zu FROM pred0 JOIN pc USING (rid, domain) JOIN nm ON nm.domain = pred0.domain AND form = 'full')""",
    "pred0", "pc", "nm",
)
part(
    "pred",
    """SELECT *, l0 > u0 OR p0 < l0 OR p0 > u0 AS crossed, least(l0, p0, u0) AS lower, greatest(l0, p0, u0) AS upper,
    l0 + p0 + u0 - least(l0, p0, u0) - greatest(l0, p0, u0) AS mid_check,
    list_sort([l0, p0, u0])[2] AS pred, true_pct AS "true" FROM pred1""",
    "pred1",
)
