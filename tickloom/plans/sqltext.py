"""SQL building bricks for the twins of the registered queries."""

from __future__ import annotations

from tickloom.plans.registry import q6

EVENTS = """trace AS (
  SELECT event_type AS series_id,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS tick, ts, value
  FROM events)"""
USERS = """trace AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, ts, value
  FROM events)"""
REVENUE = """daily AS (
  SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts,
         round_even(sum(l_extendedprice * (1 - l_discount)) * 100, 0) / 100 AS value
  FROM lineitem GROUP BY 1, 2),
trace AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS tick, ts, value
  FROM daily)"""
MASKED = """kept AS (SELECT *, (tick * 2) % 5 < 2 AS sampled FROM trace)"""

D = "::DOUBLE"


def reset_var(x: str, floor: float) -> str:
    return f"greatest({floor}{D}, (abs({x}) * 0.1{D}) * (abs({x}) * 0.1{D}))"


def tracker(name: str, source: str, keys: str = "series_id", *, threshold: float = 1.0, tolerance: int = 3,
            alpha: float = 0.05, beta: float = 0.5, floor: float = 0.0) -> str:
    """Recursive CTE of the dense tracker over ``source(keys, tick, value)``."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"t.{k} = r.{k}" for k in ks)
    tk = ", ".join(f"t.{k}" for k in ks)
    return f"""{name} AS (
  SELECT {keys}, tick, value, 'INIT' AS status, value AS mean, {reset_var('value', floor)} AS var,
         0 AS cnt, 0.0{D} AS z_score, 1.0{D} AS alpha
  FROM {source} WHERE tick = 0
  UNION ALL
  SELECT {keys}, tick, value, status,
         CASE status WHEN 'DRIFT_RESET' THEN value WHEN 'OUTLIER' THEN m0
              ELSE (1{D} - a) * m0 + a * value END,
         CASE status WHEN 'DRIFT_RESET' THEN {reset_var('value', floor)} WHEN 'OUTLIER' THEN v0
              ELSE (1{D} - a) * v0 + a * ((value - m0) * (value - m0)) END,
         CASE WHEN status = 'OUTLIER' THEN c1 ELSE 0 END, z,
         CASE status WHEN 'DRIFT_RESET' THEN 1.0{D} WHEN 'OUTLIER' THEN 0.0{D} ELSE a END
  FROM (
    SELECT *, CASE WHEN NOT far THEN 'NORMAL' WHEN c1 >= {tolerance} THEN 'DRIFT_RESET'
                   ELSE 'OUTLIER' END AS status,
           {alpha}{D} * (1{D} - {beta}{D} * ((1{D} / sqrt(2{D} * pi())) * exp(-0.5{D} * (z * z)))) AS a
    FROM (
      SELECT *, abs(z) > {threshold}{D} AS far, c0 + 1 AS c1
      FROM (
        SELECT {tk}, t.tick, t.value, r.mean AS m0, r.var AS v0, r.cnt AS c0,
               (t.value - r.mean) / (sqrt(r.var) + 1e-8{D}) AS z
        FROM {name} r JOIN {source} t ON {on} AND t.tick = r.tick + 1))))"""


def linear_interval(u: str, lo: int, hi: int) -> str:
    return f"CAST(least(greatest(round_even({hi}{D} - {hi - lo}{D} * ({u}), 0), {lo}), {hi}) AS INTEGER)"


def sampler(name: str, source: str, keys: str = "series_id", *, mode: str = "step",
            threshold: float = 1.0, tolerance: int = 3, alpha: float = 0.05, beta: float = 0.5,
            floor: float = 0.0, lo: int = 1, hi: int = 20, warmup: int = 5, window: int = 20,
            positive_only: bool = False) -> str:
    """Recursive CTE of the urgency-adaptive sampler.

    ``mode``: ``step`` skips ticks, ``feed`` reads all, ``live`` reads sums since the
    last read. Columns: keys, tick, value, sampled, interval, urgency, status, mean,
    std, z_score (the last four NULL on skipped ticks).
    """
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"t.{k} = r.{k}" for k in ks)
    tk = ", ".join(f"t.{k}" for k in ks)
    take = "TRUE" if mode == "feed" else "steps1 >= cur"
    x = "acc1 / greatest(1, steps1)" if mode == "live" else "value"
    shown = "cur" if mode == "step" else "CASE WHEN take THEN " + linear_interval("u1", lo, hi) + " ELSE cur END"
    warm_ok = "status = 'NORMAL'" + (" AND s1 > 0" if positive_only else "")
    return f"""{name} AS (
  SELECT {keys}, tick, value, TRUE AS sampled, {lo} AS interval, 1.0{D} AS urgency, 'INIT' AS status,
         value AS mean, sqrt({reset_var('value', floor)}) AS std, 0.0{D} AS z_score,
         value AS k_mean, {reset_var('value', floor)} AS k_var, 0 AS k_cnt, 1.0{D} AS k_u,
         0.0{D} AS k_drift, 0.0{D} AS k_out, '0' AS k_ring, 0 AS k_steps, TRUE AS k_auto,
         0.0{D} AS k_sigma, 0 AS k_warm, 0.0{D} AS k_acc
  FROM {source} WHERE tick = 0
  UNION ALL
  SELECT {keys}, tick, value, take, {shown}, u1,
         CASE WHEN take THEN status END, CASE WHEN take THEN m1 END, CASE WHEN take THEN s1 END,
         CASE WHEN take THEN z END,
         m1, v1, cnt1, u1, drift1, out1, ring1, CASE WHEN take THEN 0 ELSE steps1 END, auto1,
         sigma1, warm1, CASE WHEN take THEN 0.0{D} ELSE acc1 END
  FROM (
    SELECT *, CASE WHEN NOT take THEN k_u WHEN k_auto THEN 1.0{D}
                   ELSE least(1{D}, greatest(0{D}, CASE WHEN raw < 0.2{D} THEN mix * (1{D} - 0.1{D}) ELSE mix END)) END AS u1
    FROM (
      SELECT *, 0.6{D} * k_u + (1{D} - 0.6{D}) * raw AS mix
      FROM (
        SELECT *, least(1{D}, greatest(0{D},
                 least(1{D}, greatest(0{D}, (s1 / (sigma1 + 1e-8{D}) - 1{D}) * 1{D})),
                 length(replace(ring1, '0', '')) / length(ring1){D} * 1{D}, drift1, out1)) AS raw
        FROM (
          SELECT *,
                 CASE WHEN NOT take OR k_auto THEN k_drift WHEN status = 'DRIFT_RESET' THEN 1.0{D}
                      ELSE k_drift * 0.9{D} END AS drift1,
                 CASE WHEN NOT take OR k_auto THEN k_out
                      WHEN status IN ('OUTLIER', 'DRIFT_RESET')
                      THEN greatest(k_out, least(1{D}, (abs(z) - {threshold}{D}) / {threshold}{D}))
                      ELSE k_out * 0.85{D} END AS out1,
                 CASE WHEN NOT take THEN k_sigma
                      WHEN k_auto THEN CASE WHEN {warm_ok} AND k_warm + 1 >= {warmup} THEN s1 ELSE k_sigma END
                      WHEN s1 > 0 THEN (1{D} - 0.01{D}) * k_sigma + 0.01{D} * s1 ELSE k_sigma END AS sigma1,
                 CASE WHEN take AND k_auto AND {warm_ok} THEN k_warm + 1 ELSE k_warm END AS warm1,
                 CASE WHEN take AND k_auto AND {warm_ok} AND k_warm + 1 >= {warmup} THEN FALSE ELSE k_auto END AS auto1,
                 CASE WHEN take THEN substr(CASE WHEN status IN ('OUTLIER', 'DRIFT_RESET') THEN '1' ELSE '0' END
                           || k_ring, 1, {window}) ELSE k_ring END AS ring1
          FROM (
            SELECT *, sqrt(v1) AS s1
            FROM (
              SELECT *,
                     CASE WHEN NOT take OR status = 'OUTLIER' THEN k_mean WHEN status = 'DRIFT_RESET' THEN x
                          ELSE (1{D} - a) * k_mean + a * x END AS m1,
                     CASE WHEN NOT take OR status = 'OUTLIER' THEN k_var WHEN status = 'DRIFT_RESET' THEN {reset_var('x', floor)}
                          ELSE (1{D} - a) * k_var + a * ((x - k_mean) * (x - k_mean)) END AS v1,
                     CASE WHEN NOT take THEN k_cnt WHEN status = 'OUTLIER' THEN k_cnt + 1 ELSE 0 END AS cnt1
              FROM (
                SELECT *, CASE WHEN abs(z) <= {threshold}{D} THEN 'NORMAL'
                               WHEN k_cnt + 1 >= {tolerance} THEN 'DRIFT_RESET' ELSE 'OUTLIER' END AS status,
                       {alpha}{D} * (1{D} - {beta}{D} * ((1{D} / sqrt(2{D} * pi())) * exp(-0.5{D} * (z * z)))) AS a
                FROM (
                  SELECT *, {take} AS take, (x - k_mean) / (sqrt(k_var) + 1e-8{D}) AS z
                  FROM (
                    SELECT *, {x} AS x
                    FROM (
                      SELECT {tk}, t.tick, t.value, r.k_steps + 1 AS steps1, r.k_acc + t.value AS acc1,
                             {linear_interval('r.k_u', lo, hi)} AS cur,
                             r.k_mean, r.k_var, r.k_cnt, r.k_u, r.k_drift, r.k_out, r.k_ring, r.k_auto,
                             r.k_sigma, r.k_warm
                      FROM {name} r JOIN {source} t ON {on} AND t.tick = r.tick + 1)))))))))))"""


def masked_tracker(name: str, source: str, keys: str = "series_id", **kw) -> str:
    """Tracker over the kept ticks of ``source(keys, tick, value, sampled)``, back on all ticks."""
    return f"""{name}_seen AS (
  SELECT {keys}, tick AS full_tick, value, row_number() OVER (PARTITION BY {keys} ORDER BY tick) - 1 AS tick
  FROM {source} WHERE sampled),
{tracker(name + '_run', name + '_seen', keys, **kw)},
{name} AS (
  SELECT {', '.join('k.' + x.strip() for x in keys.split(','))}, k.tick, k.value, k.sampled,
         r.status, r.mean, sqrt(r.var) AS std, r.z_score
  FROM {source} k
  LEFT JOIN {name}_seen s ON {' AND '.join(f's.{x.strip()} = k.{x.strip()}' for x in keys.split(','))} AND s.full_tick = k.tick
  LEFT JOIN {name}_run r ON {' AND '.join(f'r.{x.strip()} = s.{x.strip()}' for x in keys.split(','))} AND r.tick = s.tick)"""


def both_known(keys: str, value: str, cond: str, x: str = "tick") -> str:
    """Columns x0, y0, x1, y1: nearest known points on both sides."""
    w = f"PARTITION BY {keys} ORDER BY {x}"
    back = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    xs = f"CASE WHEN {cond} THEN {x} END"
    ys = f"CASE WHEN {cond} THEN {value} END"
    return (f"last_value({xs} IGNORE NULLS) {back} AS x0, last_value({ys} IGNORE NULLS) {back} AS y0, "
            f"first_value({xs} IGNORE NULLS) {ahead} AS x1, first_value({ys} IGNORE NULLS) {ahead} AS y1")


LERP = ("CASE WHEN x0 IS NULL THEN coalesce(y1, 0.0) WHEN x1 IS NULL OR x1 = x0 THEN y0 "
        "ELSE y0 + (y1 - y0) * ({x} - x0) / (x1 - x0) END")


def interpolated(name: str, source: str, keys: str, columns: dict[str, str], cond: str = "sampled") -> str:
    """CTE adding linearly interpolated columns ``{out: value}`` to ``source``."""
    ks = [k.strip() for k in keys.split(",")]
    parts, outs, joins = [], [], []
    for i, (out, value) in enumerate(columns.items()):
        parts.append(f"{name}_{out} AS (SELECT {keys}, tick, {LERP.format(x='tick')} AS {out} FROM ("
                     f"SELECT *, {both_known(keys, value, cond)} FROM {source}))")
        outs.append(f"j{i}.{out}")
        joins.append(f"JOIN {name}_{out} j{i} ON "
                     + " AND ".join(f"j{i}.{k} = b.{k}" for k in ks) + f" AND j{i}.tick = b.tick")
    return ",\n".join(parts) + f",\n{name} AS (SELECT b.*, {', '.join(outs)} FROM {source} b {' '.join(joins)})"


def corr(x: str, y: str) -> str:
    return (f"CASE WHEN count(*) > 1 AND stddev_pop({x}) * stddev_pop({y}) > 0 "
            f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")


def span(value: str = "value") -> str:
    return f"(CASE WHEN max({value}) - min({value}) < 1e-8 THEN 1.0 ELSE max({value}) - min({value}) END)"


def efficiency(source: str, keys: str = "series_id", tail: str = "") -> str:
    """SELECT of the sampling-efficiency columns."""
    return f"""SELECT {keys}, n_total, n_sampled, {q6('n_sampled / n_total::DOUBLE')} AS sample_ratio,
  CAST(CASE WHEN n_sampled > 1 THEN max_gap ELSE n_total END AS BIGINT) AS max_gap,
  {q6('CASE WHEN n_sampled > 1 THEN mean_gap ELSE n_total END')} AS mean_gap,
  {q6('CASE WHEN n_sampled > 1 THEN p95_gap ELSE n_total END')} AS p95_gap
FROM (SELECT {keys}, count(*) AS n_total, CAST(sum(CASE WHEN sampled THEN 1 ELSE 0 END) AS BIGINT) AS n_sampled,
        max(gap) AS max_gap, avg(gap) AS mean_gap, quantile_cont(CAST(gap AS DOUBLE), 0.95) AS p95_gap
      FROM (SELECT *, CASE WHEN sampled THEN tick - max(CASE WHEN sampled THEN tick END) OVER (
              PARTITION BY {keys} ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap
            FROM {source}) GROUP BY {keys}){tail}"""
