"""DuckDB oracle SQL for the registered queries (independent formulations: window sums, brute-force
pair joins, ``ASOF JOIN``).  Views ``orders customer events ...`` are registered by the driver.

Floating outputs are wrapped in ``R()`` = ``round(x, 6) + 0.0`` like the Spark side.
"""

from __future__ import annotations

# fixed values, written out here so that an error in the package cannot pass on both sides: blend weights, normal
# quantile of a 95 % band, coefficients of the erfc fit, steps of the threshold grid
CLASSIFIER_BLEND = {"p1": 0.45, "p2": 0.05, "p3": 0.05, "p4": 0.2, "p5": 0.125, "p6": 0.125}
CLASSIFIER_BLEND_2 = {"p1": 0.975, "p2": 0.025}
RANKING_BLEND = {"r1": 0.29, "r2": 0.29, "r3": 0.29, "r4": 0.06, "r5": 0.07}
Z_95 = 1.959963984540054
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
THRESHOLDS = [(i * 0.01, i * 0.01 + 0.01, i * 0.01 + 0.01) for i in range(33)]

# ---------------------------------------------------------------------------------- derived frames

S = """S AS (
  SELECT CAST(o_orderkey AS BIGINT) id, c_mktsegment grp,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 AS DOUBLE) "time",
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END event,
         CAST(o_totalprice / 500001.0 AS DOUBLE) pred,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE c_acctbal END x_num,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END x_cat,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END x_code
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

G = """G AS (
  WITH n AS (SELECT event_id id, event_type grp, ts, value,
                    lead(ts) OVER w nt, lead(event_type) OVER w ne
             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       m AS (SELECT max(ts) mx FROM events)
  SELECT id, grp, CAST(epoch_us(coalesce(nt, mx)) - epoch_us(ts) AS DOUBLE) / 1e6 "time",
         CASE WHEN ne = 'purchase' THEN 1 ELSE 0 END event, value pred
  FROM n, m)"""


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _p_cols() -> str:
    # fixed values: same multipliers/offsets as the Spark frame
    mult = [(7919, 1), (104729, 2), (1299709, 3), (15485863, 5), (32452843, 7), (49979687, 11)]
    cols = [f"{_d(0.05)} + {_d(0.55)} * (((id * {a} + {b}) % 1000003) / {_d(1000003.0)}) + {_d(0.35)} * event p{i}"
            for i, (a, b) in enumerate(mult, 1)]
    cols.append(f"{_d(0.5)} + {_d(2.0)} * ((id * 86028121 + 13) % 1000003) / {_d(1000003.0)} r1")
    cols.append(f"((id * 122949823 + 17) % 1000003) / {_d(1000003.0)} r2")
    return ",\n         ".join(cols)


P = f"""PB AS (
  SELECT id, grp, "time", event,
         {_p_cols()},
         CAST(floor(least(greatest(ln(1 + "time"), 1), 4) / 0.5) AS INT) time_bin
  FROM S),
ST AS (SELECT grp, event, time_bin, count(*) n FROM PB GROUP BY ALL),
SO AS (SELECT grp, event, time_bin,
              coalesce(sum(n) OVER (ORDER BY grp, event, time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) off
       FROM ST),
P AS (SELECT PB.* EXCLUDE (time_bin),
             CAST((SO.off + row_number() OVER (PARTITION BY PB.grp, PB.event, PB.time_bin
                     ORDER BY md5(CAST(PB.id AS VARCHAR) || ':60'), PB.id) - 1) % 7 + 1 AS INT) fold
      FROM PB JOIN SO USING (grp, event, time_bin))"""


def R(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------------- survival curves

# per-time counts, at-risk, events so far (global)
_C = """c AS (SELECT "time", count(*) removed, CAST(sum(event) AS BIGINT) d FROM {f} GROUP BY "time"),
r AS (SELECT "time", removed, d, CAST(sum(removed) OVER (ORDER BY "time" DESC) AS BIGINT) n,
             CAST(sum(d) OVER (ORDER BY "time") AS BIGINT) ce FROM c)"""
_CG = """c AS (SELECT grp, "time", count(*) removed, CAST(sum(event) AS BIGINT) d FROM {f} GROUP BY grp, "time"),
r AS (SELECT grp, "time", removed, d, CAST(sum(removed) OVER (PARTITION BY grp ORDER BY "time" DESC) AS BIGINT) n,
             CAST(sum(d) OVER (PARTITION BY grp ORDER BY "time") AS BIGINT) ce FROM c)"""
# smoothed increments: the j-th tied event at a time contributes 1/(n - j)
_INC = """e AS (SELECT "time", n, unnest(range(d)) j FROM r),
inc AS (SELECT "time", sum(1.0 / (n - j)) inc, sum(1.0 / ((n - j) * (n - j))) v FROM e GROUP BY "time"),
h AS (SELECT r.*, coalesce(inc.inc, 0) inc, coalesce(inc.v, 0) v FROM r LEFT JOIN inc USING ("time"))"""
_INCG = """e AS (SELECT grp, "time", n, unnest(range(d)) j FROM r),
inc AS (SELECT grp, "time", sum(1.0 / (n - j)) inc FROM e GROUP BY grp, "time"),
h AS (SELECT r.*, coalesce(inc.inc, 0) inc FROM r LEFT JOIN inc USING (grp, "time"))"""
_KM = """k AS (SELECT *, sum(CASE WHEN d >= n THEN 0 ELSE ln(1 - d / n) END) OVER (ORDER BY "time") ls,
                  sum(CASE WHEN d >= n AND d > 0 THEN 1 ELSE 0 END) OVER (ORDER BY "time") z,
                  sum(CASE WHEN d >= n THEN 0 ELSE d / (n * (n - d)) END) OVER (ORDER BY "time") gw FROM r),
k2 AS (SELECT *, CASE WHEN z > 0 THEN 0.0 ELSE exp(ls) END s FROM k)"""

SQL["km_events_only"] = W(S, _C.format(f="S"), "tot AS (SELECT sum(event) e FROM S)") + f"""
SELECT S.id, {R("1 - r.ce / tot.e")} survival_probability FROM S JOIN r USING ("time"), tot"""

SQL["km_censored"] = W(S, _C.format(f="S"), _KM) + f"""
SELECT {R('"time"')} "time", n at_risk, d observed, {R("s")} survival FROM k2"""

SQL["km_by_group"] = W(S, _CG.format(f="S"), "tot AS (SELECT grp, sum(event) e FROM S GROUP BY grp)") + f"""
SELECT S.id, S.grp, {R("CASE WHEN tot.e > 0 THEN 1 - r.ce / tot.e ELSE 1 END")} group_survival_probability
FROM S JOIN r USING (grp, "time") JOIN tot USING (grp)"""

SQL["km_at_rows"] = W(S, _C.format(f="S"), _KM, 'pr AS (SELECT id, pred * 3000.0 probe FROM S)') + f"""
SELECT pr.id, {R("pr.probe")} probe, {R("coalesce(k2.s, 1.0)")} survival
FROM pr ASOF LEFT JOIN k2 ON pr.probe >= k2."time" """

for _name, _ties in (("na_smooth", "inc"), ("na_breslow", "d / n")):
    SQL[_name] = W(S, _C.format(f="S"), _INC) + f"""
SELECT {R('"time"')} "time", n at_risk, d observed,
       {R(f'sum({_ties}) OVER (ORDER BY "time")')} cumulative_hazard, {R(_ties)} hazard_rate FROM h"""

SQL["na_by_group"] = W(G, _CG.format(f="G"), _INCG) + f"""
SELECT G.id, G.grp, {R('sum(h.inc) OVER (PARTITION BY h.grp ORDER BY h."time")')} group_cumulative_hazard,
       {R("h.inc")} group_hazard_rate
FROM G JOIN h USING (grp, "time")"""

SQL["na_at_rows"] = W(G, _C.format(f="G"), _INC, 'hh AS (SELECT "time", sum(inc) OVER (ORDER BY "time") ch FROM h)') + f"""
SELECT G.id, {R("hh.ch")} cumulative_hazard FROM G JOIN hh USING ("time")"""

SQL["hazard_rate"] = W(S, _C.format(f="S"), _INC) + f"""
SELECT S.id, {R("h.inc")} hazard_rate FROM S JOIN h USING ("time")"""

SQL["survival_targets"] = W(
    S, _C.format(f="S"), _INC, "tot AS (SELECT sum(event) e FROM S)",
    'gl AS (SELECT "time", 1 - ce / (SELECT e FROM tot) sp, sum(inc) OVER (ORDER BY "time") ch, inc hr FROM h)',
    """gc AS (SELECT grp, "time", count(*) removed, CAST(sum(event) AS BIGINT) d FROM S GROUP BY grp, "time")""",
    """gr AS (SELECT grp, "time", d, CAST(sum(removed) OVER (PARTITION BY grp ORDER BY "time" DESC) AS BIGINT) n,
                CAST(sum(d) OVER (PARTITION BY grp ORDER BY "time") AS BIGINT) ce FROM gc)""",
    """ge AS (SELECT grp, "time", n, unnest(range(d)) j FROM gr)""",
    """gi AS (SELECT grp, "time", sum(1.0 / (n - j)) inc FROM ge GROUP BY grp, "time")""",
    """gt AS (SELECT grp, sum(event) e FROM S GROUP BY grp)""",
    """gg AS (SELECT gr.grp, gr."time", CASE WHEN gt.e > 0 THEN 1 - gr.ce / gt.e ELSE 1 END sp,
                sum(coalesce(gi.inc, 0)) OVER (PARTITION BY gr.grp ORDER BY gr."time") ch, coalesce(gi.inc, 0) hr
             FROM gr LEFT JOIN gi USING (grp, "time") JOIN gt USING (grp))""",
    """rows AS (SELECT S.id, gl.sp, gl.ch, gl.hr, gg.sp gsp, gg.ch gch, gg.hr ghr, ln(1 + gl.sp) lk
               FROM S JOIN gl USING ("time") JOIN gg USING (grp, "time"))""",
) + f"""
SELECT id, {R("sp")} survival_probability, {R("ch")} cumulative_hazard, {R("hr")} hazard_rate,
       {R("gsp")} group_survival_probability, {R("gch")} group_cumulative_hazard, {R("ghr")} group_hazard_rate,
       {R("(lk - min(lk) OVER ()) / (max(lk) OVER () - min(lk) OVER ())")} log_km_survival_probability,
       {R("-exp(ch)")} na_cumulative_hazard, {R("-exp(hr)")} na_hazard_rate
FROM rows"""

_z = repr(Z_95)
SQL["curve_table"] = W(S, _C.format(f="S"), _INC, _KM.replace("FROM r)", "FROM h)"),
                       'q AS (SELECT *, sum(inc) OVER (ORDER BY "time") ch, sum(v) OVER (ORDER BY "time") hv FROM k2)') + f"""
SELECT {R('"time"')} "time", n at_risk, d observed, removed - d censored, {R("s")} survival,
       {R("1 - s")} cumulative_density,
       {R(f"CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) + {_z} * sqrt(gw) / (-ln(s)))) WHEN s >= 1 THEN 1.0 END")} survival_lower,
       {R(f"CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) - {_z} * sqrt(gw) / (-ln(s)))) WHEN s >= 1 THEN 1.0 END")} survival_upper,
       {R("ch")} cumulative_hazard,
       {R(f"CASE WHEN ch > 0 THEN ch * exp(-{_z} * sqrt(hv) / ch) END")} hazard_lower,
       {R(f"CASE WHEN ch > 0 THEN ch * exp({_z} * sqrt(hv) / ch) END")} hazard_upper
FROM q"""

SQL["prefix_scan"] = W(S, """c AS (SELECT grp, "time", count(*) n, CAST(sum(event) AS BIGINT) d FROM S GROUP BY grp, "time")""") + f"""
SELECT grp, {R('"time"')} "time", n, d,
       CAST(sum(n) OVER (PARTITION BY grp ORDER BY "time" DESC) AS BIGINT) at_risk,
       CAST(sum(d) OVER (PARTITION BY grp ORDER BY "time") AS BIGINT) events_so_far FROM c"""

# ---------------------------------------------------------------------------------- parametric

SQL["exponential_fit"] = W(S, 'l AS (SELECT sum("time") / sum(event) lam FROM S)') + f"""
SELECT id, {R('exp(-("time" / lam))')} survival, {R('"time" / lam')} cumulative_hazard, {R("1.0 / lam")} hazard FROM S, l"""

SQL["exponential_by_group"] = W(G) + f"""
SELECT grp, {R('sum("time") / sum(event)')} lambda_ FROM G GROUP BY grp"""

SQL["weibull_curve"] = W(S) + f"""
SELECT id, {R(f'exp(-pow("time" / {_d(800.0)}, {_d(1.3)}))')} survival,
       {R(f'pow("time" / {_d(800.0)}, {_d(1.3)})')} cumulative_hazard,
       {R(f'{_d(1.3)} / {_d(800.0)} * pow("time" / {_d(800.0)}, {_d(1.3)} - {_d(1.0)})')} hazard FROM S"""

_q = f'pow("time" / {_d(900.0)}, {_d(2.2)})'
SQL["loglogistic_curve"] = W(S) + f"""
SELECT id, {R(f"1.0 / (1.0 + {_q})")} survival, {R(f"ln(1 + {_q})")} cumulative_hazard,
       {R(f'{_d(2.2)} / {_d(900.0)} * pow("time" / {_d(900.0)}, {_d(2.2)} - {_d(1.0)}) / (1.0 + {_q})')} hazard FROM S"""

# ---------------------------------------------------------------------------------- targets and folds

SQL["log_time_targets"] = W(G) + f"""
SELECT id, {R('ln("time")')} log_time, {R('CASE WHEN event = 0 THEN -"time" ELSE "time" END')} inverted_time FROM G"""

SQL["sample_weights"] = W(S) + f"""SELECT id, {R("CASE WHEN event = 1 THEN 1.5 ELSE 1.0 END")} weight FROM S"""

SQL["time_bins"] = W(S) + """
SELECT id, CAST(floor(least(greatest(ln(1 + "time"), 1), 4) / 0.5) AS INT) time_bin FROM S"""

SQL["stratified_folds"] = W(S, P) + "SELECT id, fold FROM P"

SQL["fold_one_hot"] = W(S, P) + "SELECT id, fold, " + ", ".join(
    f"CASE WHEN fold = {i} THEN 1 ELSE 0 END fold{i}" for i in range(1, 8)) + " FROM P"

SQL["fold_counts"] = W(S, P, """c AS (SELECT fold, 'group' kind, CAST(grp AS VARCHAR) v FROM P
  UNION ALL SELECT fold, 'event', CAST(event AS VARCHAR) FROM P)""") + """
SELECT f.fold, k.kind, k.v AS "value", count(c.kind) AS "count"
FROM (SELECT DISTINCT fold FROM c) f, (SELECT DISTINCT kind, v FROM c) k
LEFT JOIN c ON c.fold = f.fold AND c.kind = k.kind AND c.v IS NOT DISTINCT FROM k.v
GROUP BY f.fold, k.kind, k.v"""

SQL["fold_report"] = W(S, P) + f"""
SELECT fold, count(*) validation_size, CAST(sum(event) AS BIGINT) events, {R('avg("time")')} time_mean
FROM P GROUP BY fold"""

SQL["fold_balance"] = W(S, P, """f AS (SELECT fold, count(*) n, avg("time") m FROM P GROUP BY fold)""",
                        """g AS (SELECT grp, stddev_samp(n) s FROM (SELECT fold, grp, count(*) n FROM P GROUP BY ALL) GROUP BY grp)""",
                        """e AS (SELECT event, stddev_samp(n) s FROM (SELECT fold, event, count(*) n FROM P GROUP BY ALL) GROUP BY event)""") + f"""
SELECT 'validation_size_std' metric, {R("stddev_pop(n)")} value FROM f
UNION ALL SELECT 'time_mean_std', {R("stddev_pop(m)")} FROM f
UNION ALL SELECT 'group_average_std', {R("avg(s)")} FROM g
UNION ALL SELECT 'event_average_std', {R("avg(s)")} FROM e"""

SQL["two_stage_mask"] = W(S, P, "folds AS (SELECT range::INT fold FROM range(1, 8))") + """
SELECT folds.fold,
       (SELECT count(*) FROM P WHERE P.fold <> folds.fold) training,
       (SELECT count(*) FROM P WHERE P.fold <> folds.fold AND P.event = 1) two_stage,
       (SELECT count(*) FROM P WHERE P.fold = folds.fold) validation
FROM folds"""

# ---------------------------------------------------------------------------------- encoders

SQL["one_hot_infrequent"] = W(S, """u AS (SELECT id, 'x_cat' col, x_cat v FROM S
                                 UNION ALL SELECT id, 'x_code', CAST(x_code AS VARCHAR) FROM S)""",
                              "cnt AS (SELECT col, v, count(*) c FROM u GROUP BY ALL)") + """
SELECT u.id, CASE WHEN cnt.c >= 500 THEN u.col || '_' || coalesce(u.v, 'nan') ELSE u.col || '_infrequent_sklearn' END feature
FROM u JOIN cnt ON u.col = cnt.col AND u.v IS NOT DISTINCT FROM cnt.v"""

SQL["one_hot_strict"] = W(S) + "SELECT id, 'x_cat_' || coalesce(x_cat, 'nan') feature FROM S"

_ORD = """SELECT id, CAST(dense_rank() OVER (ORDER BY coalesce(x_cat, 'missing')) - 1 AS INT) x_cat_encoded,
       CAST(dense_rank() OVER (ORDER BY coalesce(x_code, -1.0)) - 1 AS INT) x_code_encoded FROM S"""
SQL["ordinal_missing"] = W(S) + _ORD
SQL["encoder_reload"] = W(S) + _ORD

SQL["ordinal_null"] = W(S) + f"""
SELECT id, {R("CASE WHEN x_cat IS NULL THEN NULL ELSE dense_rank() OVER (PARTITION BY x_cat IS NULL ORDER BY x_cat) - 1 END")} x_cat_encoded,
       {R("CASE WHEN x_code IS NULL THEN NULL ELSE dense_rank() OVER (PARTITION BY x_code IS NULL ORDER BY x_code) - 1 END")} x_code_encoded
FROM S"""

SQL["standardise"] = W(S, "st AS (SELECT avg(x_num) m, stddev_pop(x_num) s, median(x_num) med FROM S)") + f"""
SELECT id, {R("(coalesce(x_num, med) - m) / CASE WHEN s = 0 OR s IS NULL THEN 1.0 ELSE s END")} x_num_normalized FROM S, st"""

SQL["median_impute"] = W(S, "st AS (SELECT median(x_num) a, median(x_code) b FROM S)") + f"""
SELECT id, {R("coalesce(x_num, a)")} x_num, {R("coalesce(x_code, b)")} x_code FROM S, st"""

SQL["category_cast"] = W(S) + "SELECT id, CAST(x_code AS VARCHAR) x_code_category FROM S"
SQL["string_cast"] = W(S) + "SELECT id, coalesce(CAST(x_code AS VARCHAR), 'nan') x_code_str FROM S"

SQL["cardinality"] = W(S) + """
SELECT 'x_cat_encoded' "column", CAST(count(DISTINCT coalesce(x_cat, 'missing')) AS INT) cardinality FROM S
UNION ALL SELECT 'x_code_encoded', CAST(count(DISTINCT coalesce(x_code, -1.0)) AS INT) FROM S"""

SQL["preprocess_pipeline"] = W(S, "st AS (SELECT avg(x_num) m, stddev_pop(x_num) s, median(x_num) med FROM S)") + f"""
SELECT id, {R('CASE WHEN "time" = 0 THEN CAST(\'-inf\' AS DOUBLE) ELSE ln("time") END')} log_time,
       {R('CASE WHEN event = 0 THEN -"time" ELSE "time" END')} inverted_time,
       {R("CASE WHEN event = 1 THEN 1.5 ELSE 1.0 END")} weight,
       CAST(dense_rank() OVER (ORDER BY coalesce(x_cat, 'missing')) - 1 AS INT) x_cat_encoded,
       {R("(coalesce(x_num, med) - m) / CASE WHEN s = 0 OR s IS NULL THEN 1.0 ELSE s END")} x_num_normalized
FROM S, st"""

# ---------------------------------------------------------------------------------- combination

SQL["rank_transform"] = W(S, P, "x AS (SELECT id, fold, round(r1, 2) r FROM P)") + f"""
SELECT id, {R("(rank() OVER (PARTITION BY fold ORDER BY r) - 1 + (count(*) OVER (PARTITION BY fold, r) + 1) / 2.0) / count(*) OVER (PARTITION BY fold)")} "rank"
FROM x"""

SQL["two_stage_log_time"] = W(S, P) + f"SELECT id, {R('r1')} reg_1_prediction, {R('p1 / exp(r1)')} prediction FROM P"
SQL["two_stage_time"] = W(S, P) + f"SELECT id, {R('r1')} reg_1_prediction, {R('p1 / r1')} prediction FROM P"
SQL["two_stage_exp"] = W(S, P) + f"SELECT id, {R('r2')} reg_1_prediction, {R('p1 * exp(r2)')} prediction FROM P"

_SEEDS = "sl AS (SELECT id, 1 seed, p1 prediction FROM P UNION ALL SELECT id, 2, p2 FROM P UNION ALL SELECT id, 3, p3 FROM P)"
SQL["seed_average"] = W(S, P, _SEEDS) + f"SELECT id, {R('avg(prediction)')} prediction FROM sl GROUP BY id"

SQL["fold_rank_average"] = W(S, P, "lg AS (" + " UNION ALL ".join(
    f"SELECT id, 'p{i}' model, p{i} prediction FROM P" for i in range(1, 7)) + ")",
    """rk AS (SELECT id, (rank() OVER (PARTITION BY model ORDER BY prediction) - 1
              + (count(*) OVER (PARTITION BY model, prediction) + 1) / 2.0) / count(*) OVER (PARTITION BY model) r FROM lg)""") + f"""
SELECT id, {R('avg(r)')} prediction FROM rk GROUP BY id"""


def _blend_sql(weights: dict, rename: dict | None = None) -> str:
    rename = rename or {}
    return " + ".join(f"{rename.get(c, c)} * {_d(w)}" for c, w in weights.items())


SQL["classifier_blend"] = W(S, P) + f"SELECT id, {R(_blend_sql(CLASSIFIER_BLEND))} prediction FROM P"
SQL["classifier_blend_2"] = W(S, P) + f"SELECT id, {R(_blend_sql(CLASSIFIER_BLEND_2))} prediction FROM P"
SQL["ranking_blend"] = W(S, P) + f"""SELECT id, {R(_blend_sql(RANKING_BLEND, {"r3": "p3", "r4": "p4", "r5": "p5"}))} prediction FROM P"""

# fixed values: same per-group multipliers as the Spark query
_GF = {"AUTOMOBILE": 1.1, "BUILDING": 0.9, "FURNITURE": 1.0, "HOUSEHOLD": 1.05, "MACHINERY": 0.95}
SQL["group_multiplier"] = W(S, P, f"b AS (SELECT id, grp, {_blend_sql(CLASSIFIER_BLEND)} x FROM P)") + f"""
SELECT id, {R("CASE " + " ".join(f"WHEN grp = '{g}' THEN x * {_d(k)}" for g, k in _GF.items()) + " ELSE x END")} prediction FROM b"""

SQL["snap_extremes"] = W(S, P) + f"""
SELECT id, {R("CASE WHEN p1 >= 0.9 THEN 1.0 WHEN p1 <= 0.1 THEN 0.0 ELSE p1 END")} p1 FROM P"""

SQL["threshold_scaling"] = W(S, P) + "SELECT id, " + R("r1" + "".join(
    f" * CASE WHEN p1 >= {_d(lo)} AND p1 < {_d(hi)} THEN {_d(k)} ELSE 1.0 END" for lo, hi, k in THRESHOLDS)) + " r1 FROM P"

SQL["prediction_error"] = W(S, P) + f"SELECT id, {R('event - p1')} error FROM P"

SQL["oof_pivot"] = W(S, P) + f"SELECT id, {R('p1')} m1_prediction, {R('p2')} m2_prediction, {R('p3')} m3_prediction FROM P"

SQL["attach_predictions"] = W(S, P) + f"""
SELECT S.id, S.grp, {R('S."time"')} "time", {R('P.p1')} efs_prediction FROM S LEFT JOIN P USING (id)"""

SQL["scatter_group_curve"] = W(S, _CG.format(f="S"),
                               """k AS (SELECT *, sum(CASE WHEN d >= n THEN 0 ELSE ln(1 - d / n) END) OVER (PARTITION BY grp ORDER BY "time") ls,
                  sum(CASE WHEN d >= n AND d > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY "time") z,
                  sum(d / n) OVER (PARTITION BY grp ORDER BY "time") na FROM r)""") + f"""
SELECT S.id, S.grp, {R("CASE WHEN z > 0 THEN 0.0 ELSE exp(ls) END")} km, {R("na")} na FROM S JOIN k USING (grp, "time")"""

SQL["append_oof"] = W(S, P) + " UNION ALL ".join(
    [f"SELECT CAST(NULL AS DOUBLE) reg_1_prediction, '{f}' fold, {R('p1')} prediction, id FROM P WHERE fold = {f}"
     for f in range(1, 8)] + [f"SELECT {R('r1')}, 'OOF', {R('p1')}, id FROM P"])

# ---------------------------------------------------------------------------------- scalar functions

SQL["scalar_functions"] = W(G) + f"""
SELECT id, {R('ln("time")')} ln_t, {R('ln(1 + "time")')} log1p_t, {R('exp(-"time" / 1e6)')} exp_t,
       {R('-exp(pred / 100.0)')} neg_exp, {R('least(greatest(ln(1 + "time"), 1.0), 4.0)')} clip_t,
       CAST(floor(ln(1 + "time") / 0.5) AS INT) fdiv, {R('CASE WHEN event = 0 THEN -"time" ELSE "time" END')} signed,
       {R('1.0 / (1.0 + exp(-(pred / 100.0 - 2.0)))')} sigmoid, {R(f'pred * {_d(0.3)} + ("time" / 1e6) * {_d(0.7)}')} wsum
FROM G"""

SQL["slug_names"] = W(S) + """
SELECT regexp_replace(lower(trim(grp || ' Group  x')), '\\s+', '_', 'g') slug, 'x_cat_' || coalesce(x_cat, 'nan') feature
FROM (SELECT DISTINCT grp, x_cat FROM S)"""

SQL["conditional_scale"] = W(S, P, "a AS (SELECT id, grp, CASE WHEN event = 1 THEN p1 * 1.2 ELSE p1 END p1 FROM P)") + f"""
SELECT id, {R("CASE WHEN grp = 'BUILDING' THEN p1 * 0.5 ELSE p1 END")} p1 FROM a"""

SQL["nan_to_null"] = W(S) + f"SELECT id, {R('CASE WHEN id % 13 = 0 THEN NULL ELSE x_num END')} x FROM S"

SQL["fill_missing"] = W(S) + f"SELECT id, coalesce(x_cat, 'missing') x_cat, {R('coalesce(x_code, -1.0)')} x_code FROM S"

SQL["min_max_scale"] = W(S, "v AS (SELECT id, ln(1 + pred) v FROM S)") + f"""
SELECT id, {R("(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())")} v FROM v"""

SQL["table_roundtrip"] = W(S) + f'SELECT id, grp, {R(chr(34) + "time" + chr(34))} "time", event FROM S'

# ---------------------------------------------------------------------------------- metrics
# brute-force pair joins for concordance: comparable = e_i = 1 and (t_i < t_j or t_i = t_j and e_j = 0)


def _pairs(src: str, by: str | None = None) -> str:
    eq = f" AND a.{by} = b.{by}" if by else ""
    sel = f"a.{by} g, " if by else ""
    score = "CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END s"
    return f"""x AS (SELECT {by + ' ,' if by else ''} "time" t, event e, pred p FROM {src}),
pairs AS (SELECT {sel}{score} FROM x a JOIN x b ON a.e = 1 AND a.t < b.t{eq}
          UNION ALL
          SELECT {sel}{score} FROM x a JOIN x b ON a.e = 1 AND a.t = b.t AND b.e = 0{eq})"""


SQL["cindex_global"] = W(S, _pairs("S")) + f"SELECT {R('sum(s) / count(*)')} concordance, count(*) pairs FROM pairs"
SQL["cindex_no_ties"] = W(G, _pairs("G")) + f"SELECT {R('sum(s) / count(*)')} concordance, count(*) pairs FROM pairs"
SQL["cindex_by_group"] = W(S, _pairs("S", "grp")) + f"""
SELECT g grp, {R('sum(s) / count(*)')} concordance, count(*) pairs FROM pairs GROUP BY g"""

SQL["cindex_stratified"] = W(
    S, _pairs("S", "grp"), "gp AS (SELECT g, sum(s) / count(*) c FROM pairs GROUP BY g)",
    _pairs("S").replace("x AS", "y AS").replace("FROM x a JOIN x b", "FROM y a JOIN y b").replace("pairs AS", "allp AS")) + f"""
SELECT 'micro_concordance_index' metric, {R('sum(s) / count(*)')} value FROM allp
UNION ALL SELECT regexp_replace(lower(trim(g)), '\\s+', '_', 'g') || '_concordance_index', {R('c')} FROM gp
UNION ALL SELECT 'macro_concordance_index', {R('avg(c)')} FROM gp
UNION ALL SELECT 'std_concordance_index', {R('stddev_pop(c)')} FROM gp
UNION ALL SELECT 'stratified_concordance_index', {R('avg(c) - stddev_pop(c)')} FROM gp"""


def _cls(pred: str, weight: str = "1.0") -> str:
    """log loss and brute-force AUC, overall and per group, long form."""
    eps = "CAST('2.220446049250313e-16' AS DOUBLE)"
    q = f"least(greatest({pred}, {eps}), 1 - {eps})"
    return f"""b AS (SELECT grp, event, {pred} p, {weight} w, -(event * ln({q}) + (1 - event) * ln(1 - {q})) l FROM P),
u AS (SELECT '' g, 0 sc, * EXCLUDE (grp) FROM b UNION ALL SELECT grp, 1, * EXCLUDE (grp) FROM b),
ll AS (SELECT sc, g, sum(w * l) / sum(w) log_loss FROM u GROUP BY sc, g),
au AS (SELECT a.sc, a.g, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*) roc_auc
       FROM u a JOIN u b ON a.sc = b.sc AND a.g = b.g AND a.event = 1 AND b.event = 0 GROUP BY a.sc, a.g),
m AS (SELECT * FROM ll JOIN au USING (sc, g))
SELECT CASE WHEN sc = 0 THEN 'log_loss' ELSE regexp_replace(lower(trim(g)), '\\s+', '_', 'g') || '_log_loss' END metric,
       {R('log_loss')} value FROM m
UNION ALL
SELECT CASE WHEN sc = 0 THEN 'roc_auc' ELSE regexp_replace(lower(trim(g)), '\\s+', '_', 'g') || '_roc_auc' END, {R('roc_auc')} FROM m"""


SQL["log_loss_grouped"] = W(S, P).rstrip() + ",\n" + _cls("p1")
SQL["log_loss_weighted"] = W(S, P).rstrip() + ",\n" + _cls("p2", "CASE WHEN event = 1 THEN 1.5 ELSE 1.0 END")

SQL["auc_grouped"] = W(S, P, "b AS (SELECT fold, event, round(p2, 2) s FROM P)") + f"""
SELECT a.fold, {R('sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / count(*)')} roc_auc
FROM b a JOIN b b ON a.fold = b.fold AND a.event = 1 AND b.event = 0 GROUP BY a.fold"""

# curve points: cumulative counts by descending threshold
_PTS = """c AS (SELECT {by}{s} thr, CAST(sum(event) AS BIGINT) pos, CAST(count(*) - sum(event) AS BIGINT) neg FROM P GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY thr DESC) tp, sum(neg) OVER (PARTITION BY {part} ORDER BY thr DESC) fp FROM c),
tot AS (SELECT {part} k, sum(pos) "P", sum(neg) "N" FROM c GROUP BY ALL),
cc AS (SELECT cu.*, tot."P", tot."N", tp - pos tpa, fp - neg fpa FROM cu JOIN tot ON tot.k = cu.{part})"""


def _pts(s: str, by: str | None) -> str:
    if by:
        return _PTS.format(by=f"{by}, ", s=s, part=by)
    return _PTS.replace("PARTITION BY {part} ", "").format(by="", s=s, part="one").replace(
        "FROM P GROUP BY ALL)", "FROM P GROUP BY ALL), one AS (SELECT 1 one)").replace(
        "tot AS (SELECT one k", "tot AS (SELECT 1 k").replace("JOIN tot ON tot.k = cu.one", ", tot")


SQL["roc_points"] = W(S, P, _pts("p1", None)) + f"""
SELECT {R('thr')} threshold, {R('fp / "N"')} fpr, {R('tp / "P"')} tpr, {R('fpa / "N"')} fpr_prev, {R('tpa / "P"')} tpr_prev FROM cc
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0, NULL, NULL"""

SQL["pr_points"] = W(S, P, _pts("p1", None)) + f"""
SELECT {R('thr')} threshold, {R('tp / (tp + fp)')} "precision", {R('tp / "P"')} recall,
       {R('CASE WHEN tpa + fpa > 0 THEN tpa / (tpa + fpa) ELSE 1.0 END')} precision_next, {R('tpa / "P"')} recall_next FROM cc
UNION ALL SELECT NULL, 1.0, 0.0, NULL, NULL"""

# per-fold curves in curve order (ROC: origin, then thresholds descending; PR: thresholds ascending, then the end point)
_ROC_CURVE = """curve AS (SELECT fold, CAST('inf' AS DOUBLE) thr, 0.0 x, 0.0 y FROM (SELECT DISTINCT fold FROM P)
          UNION ALL SELECT fold, thr, fp / "N", tp / "P" FROM cc),
cp AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY thr DESC) pos FROM curve)"""
_PR_CURVE = """curve AS (SELECT fold, thr, 1 - tp / "P" x, tp / (tp + fp) y, 0 e FROM cc
          UNION ALL SELECT fold, NULL, 1.0, 1.0, 1 FROM (SELECT DISTINCT fold FROM P)),
cp AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY e, thr) pos FROM curve)"""
_GRID = "grid AS (SELECT CAST(range AS INT) k, CASE WHEN range = 99 THEN 1.0 ELSE range * (CAST(1 AS DOUBLE) / 99) END g FROM range(100))"
_INTERP = """lf AS (SELECT grid.k, grid.g, cp.fold, max(cp.pos) lpos FROM grid JOIN cp ON cp.x <= grid.g GROUP BY ALL),
it AS (SELECT lf.fold, lf.k, lf.g,
              CASE WHEN l.x = lf.g OR r.pos IS NULL THEN l.y ELSE l.y + (lf.g - l.x) * (r.y - l.y) / (r.x - l.x) END y
       FROM lf JOIN cp l ON l.fold = lf.fold AND l.pos = lf.lpos
       LEFT JOIN cp r ON r.fold = lf.fold AND r.pos = lf.lpos + 1)"""

SQL["interpolate_grid"] = W(S, P, _pts("round(p3, 2)", "fold"), _ROC_CURVE, _GRID, _INTERP) + f"""
SELECT fold, k, {R('g')} g, {R('y')} y FROM it"""

SQL["roc_mean_curve"] = W(S, P, _pts("p1", "fold"), _ROC_CURVE, _GRID, _INTERP,
                          "it2 AS (SELECT fold, k, g, CASE WHEN k = 0 THEN 0.0 ELSE y END y FROM it)",
                          "mm AS (SELECT k, g, CASE WHEN k = 99 THEN 1.0 ELSE avg(y) END m, stddev_pop(y) s FROM it2 GROUP BY k, g)") + f"""
SELECT k, {R('g')} fpr, {R('m')} tpr_mean, {R('s')} tpr_std, {R('greatest(m - s, 0.0)')} tpr_lower,
       {R('least(m + s, 1.0)')} tpr_upper FROM mm"""

SQL["roc_mean_summary"] = W(S, P, _pts("p1", "fold"), _ROC_CURVE, _GRID, _INTERP,
                            "it2 AS (SELECT fold, k, g, CASE WHEN k = 0 THEN 0.0 ELSE y END y FROM it)",
                            "mm AS (SELECT k, g, CASE WHEN k = 99 THEN 1.0 ELSE avg(y) END m FROM it2 GROUP BY k, g)",
                            "ml AS (SELECT *, lag(g) OVER (ORDER BY k) g0, lag(m) OVER (ORDER BY k) m0 FROM mm)") + f"""
SELECT {R('sum((g - g0) * (m + m0) / 2.0)')} auc, {R('arg_min(g, (-(m - g), k))')} best_fpr,
       {R('arg_min(m, (-(m - g), k))')} best_tpr_mean FROM ml"""

SQL["pr_mean_curve"] = W(S, P, _pts("p1", "fold"), _PR_CURVE, _GRID, _INTERP,
                         "it2 AS (SELECT fold, 99 - k k, CASE WHEN 99 - k = 0 THEN 1.0 ELSE y END y FROM it)",
                         "mm AS (SELECT it2.k, grid.g, CASE WHEN it2.k = 99 THEN 0.0 ELSE avg(y) END m, stddev_pop(y) s "
                         "FROM it2 JOIN grid USING (k) GROUP BY it2.k, grid.g)") + f"""
SELECT k, {R('g')} recall, {R('m')} precision_mean, {R('s')} precision_std, {R('greatest(m - s, 0.0)')} precision_lower,
       {R('least(m + s, 1.0)')} precision_upper FROM mm"""

SQL["curve_auc"] = W(S, P, _pts("round(p1, 2)", "fold"),
                     _ROC_CURVE, _PR_CURVE.replace("curve AS", "prc AS").replace("cp AS", "pcp AS").replace("FROM curve", "FROM prc"),
                     "ra AS (SELECT fold, sum((x - x0) * (y + y0) / 2.0) auc FROM (SELECT *, lag(x) OVER w x0, lag(y) OVER w y0 FROM cp WINDOW w AS (PARTITION BY fold ORDER BY pos)) GROUP BY fold)",
                     "pa AS (SELECT fold, sum(((1 - x) - (1 - x1)) * (y + y1) / 2.0) auc FROM (SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM pcp WINDOW w AS (PARTITION BY fold ORDER BY pos)) GROUP BY fold)") + f"""
SELECT fold, {R('auc')} auc, 'roc' kind FROM ra UNION ALL SELECT fold, {R('auc')}, 'pr' FROM pa"""


def _reg(extra: str = "", target: str = '"time"', pred: str = f"r1 * {_d(800.0)}") -> str:
    eps = "CAST('2.220446049250313e-16' AS DOUBLE)"
    return f"""b AS (SELECT {extra}grp, {target} y, {pred} p FROM P),
u AS (SELECT {extra}'' g, 0 sc, y, p FROM b UNION ALL SELECT {extra}grp, 1, y, p FROM b),
m AS (SELECT {extra}sc, g, avg((y - p) * (y - p)) mse, avg(abs(y - p)) mae,
             avg(abs((p + 1) - (y + 1)) / greatest(abs(y + 1), {eps})) mape FROM u GROUP BY ALL),
l AS (SELECT {extra}sc, g, unnest([{{'m': 'mean_squared_error', 'v': mse}}, {{'m': 'mean_absolute_error', 'v': mae}},
                           {{'m': 'mean_absolute_percentage_error', 'v': mape}}]) r FROM m)"""


_SLUG = "CASE WHEN sc = 0 THEN r.m ELSE regexp_replace(lower(trim(g)), '\\s+', '_', 'g') || '_' || r.m END"
SQL["regression_errors"] = W(S, P, _reg()) + f"SELECT {_SLUG} metric, {R('r.v')} value FROM l"


def _cls_folds(pred: str) -> str:
    eps = "CAST('2.220446049250313e-16' AS DOUBLE)"
    q = f"least(greatest({pred}, {eps}), 1 - {eps})"
    return f"""b AS (SELECT CAST(fold AS VARCHAR) f, grp, event, {pred} p, -(event * ln({q}) + (1 - event) * ln(1 - {q})) l FROM P
           UNION ALL SELECT 'OOF', grp, event, {pred}, -(event * ln({q}) + (1 - event) * ln(1 - {q})) FROM P),
u AS (SELECT f, '' g, 0 sc, event, p, l FROM b UNION ALL SELECT f, grp, 1, event, p, l FROM b),
ll AS (SELECT f, sc, g, avg(l) log_loss FROM u GROUP BY ALL),
au AS (SELECT a.f, a.sc, a.g, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*) roc_auc
       FROM u a JOIN u b ON a.f = b.f AND a.sc = b.sc AND a.g = b.g AND a.event = 1 AND b.event = 0 GROUP BY ALL),
m AS (SELECT * FROM ll JOIN au USING (f, sc, g)),
l AS (SELECT f, sc, g, unnest([{{'m': 'log_loss', 'v': log_loss}}, {{'m': 'roc_auc', 'v': roc_auc}}]) r FROM m),
sct AS (SELECT f fold, {_SLUG} metric, r.v value FROM l)"""


SQL["score_table"] = W(S, P, _cls_folds("p1")) + f"SELECT fold, metric, {R('value')} value FROM sct"
SQL["score_summary"] = W(S, P, _cls_folds("p1")) + f"""
SELECT metric, {R('avg(value)')} mean, {R('coalesce(stddev_samp(value), 0.0)')} std FROM sct WHERE fold <> 'OOF' GROUP BY metric"""

_REG_F = f"""b AS (SELECT CAST(fold AS VARCHAR) f, grp, "time" y, r1 * {_d(800.0)} p FROM P
           UNION ALL SELECT 'OOF', grp, "time", r1 * {_d(800.0)} FROM P),
u AS (SELECT f, '' g, 0 sc, y, p FROM b UNION ALL SELECT f, grp, 1, y, p FROM b),
m AS (SELECT f, sc, g, avg((y - p) * (y - p)) mse, avg(abs(y - p)) mae,
             avg(abs((p + 1) - (y + 1)) / greatest(abs(y + 1), CAST('2.220446049250313e-16' AS DOUBLE))) mape
      FROM u GROUP BY ALL),
l AS (SELECT f, sc, g, unnest([{{'m': 'mean_squared_error', 'v': mse}}, {{'m': 'mean_absolute_error', 'v': mae}},
                           {{'m': 'mean_absolute_percentage_error', 'v': mape}}]) r FROM m),
sct AS (SELECT f fold, {_SLUG} metric, r.v value FROM l)"""
SQL["oof_vs_folds"] = W(S, P, _REG_F) + f"""
SELECT metric, {R("avg(value) FILTER (WHERE fold <> 'OOF')")} mean,
       {R("coalesce(stddev_samp(value) FILTER (WHERE fold <> 'OOF'), 0.0)")} std,
       {R("max(value) FILTER (WHERE fold = 'OOF')")} oof FROM sct GROUP BY metric"""

_RB = _blend_sql(RANKING_BLEND, {"r3": "p3", "r4": "p4", "r5": "p5"})
SQL["score_table_ranking"] = W(
    S, P, f"""q AS (SELECT CAST(fold AS VARCHAR) f, grp, "time" t, event e, {_RB} p FROM P
                  UNION ALL SELECT 'OOF', grp, "time", event, {_RB} FROM P)""",
    """u AS (SELECT f, '' g, 0 sc, t, e, p FROM q UNION ALL SELECT f, grp, 1, t, e, p FROM q)""",
    """pr AS (SELECT a.f, a.sc, a.g, CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END s
              FROM u a JOIN u b ON a.f = b.f AND a.sc = b.sc AND a.g = b.g AND a.e = 1 AND a.t < b.t
              UNION ALL
              SELECT a.f, a.sc, a.g, CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END
              FROM u a JOIN u b ON a.f = b.f AND a.sc = b.sc AND a.g = b.g AND a.e = 1 AND a.t = b.t AND b.e = 0)""",
    "c AS (SELECT f, sc, g, sum(s) / count(*) c FROM pr GROUP BY ALL)") + f"""
SELECT f fold, 'micro_concordance_index' metric, {R('c')} value FROM c WHERE sc = 0
UNION ALL SELECT f, regexp_replace(lower(trim(g)), '\\s+', '_', 'g') || '_concordance_index', {R('c')} FROM c WHERE sc = 1
UNION ALL SELECT f, 'macro_concordance_index', {R('avg(c)')} FROM c WHERE sc = 1 GROUP BY f
UNION ALL SELECT f, 'std_concordance_index', {R('stddev_pop(c)')} FROM c WHERE sc = 1 GROUP BY f
UNION ALL SELECT f, 'stratified_concordance_index', {R('avg(c) - stddev_pop(c)')} FROM c WHERE sc = 1 GROUP BY f"""

_PC = [f"p{i}" for i in range(1, 7)]
SQL["correlations"] = W(S, P) + " UNION ALL ".join(
    f"SELECT '{a}' a, '{b}' b, {R(f'corr({a}, {b})')} corr FROM P" for a in _PC for b in _PC)

SQL["target_histogram"] = W(S, 'mm AS (SELECT min("time") lo, max("time") hi FROM S)',
                            'w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 32 ELSE 1.0 END wd FROM mm)') + f"""
SELECT event, CAST(least(floor(("time" - lo) / wd), 31) AS INT) bin, {R('lo + least(floor(("time" - lo) / wd), 31) * wd')} lo,
       {R('lo + (least(floor(("time" - lo) / wd), 31) + 1) * wd')} hi, count(*) "count"
FROM S, w GROUP BY ALL"""

_TRIALS = """tr AS (SELECT CAST(fold * 1000 + ascii(grp) AS BIGINT) number,
                CASE WHEN fold = 3 AND grp = 'MACHINERY' THEN NULL ELSE round(avg(p1), 2) END value,
                count(*) params_n, round(avg(r2), 4) params_lr FROM P GROUP BY fold, grp),
full_tr AS (SELECT * FROM tr WHERE value IS NOT NULL)"""
SQL["study_table"] = W(S, P, _TRIALS) + f"""
SELECT number, {R('value')} value, params_n, {R('params_lr')} params_lr FROM full_tr
QUALIFY row_number() OVER (PARTITION BY value ORDER BY number) = 1"""
SQL["best_trial"] = W(S, P, _TRIALS) + f"""
SELECT number, {R('value')} value, params_n, {R('params_lr')} params_lr FROM full_tr ORDER BY value DESC, number LIMIT 1"""

_FE = _PC + ["r1", "r2"]
SQL["importance_summary"] = W(S, P, "per AS (SELECT fold, " + ", ".join(f"abs(corr({c}, event)) {c}" for c in _FE) + " FROM P GROUP BY fold)",
                              "lg AS (" + " UNION ALL ".join(f"SELECT fold, '{c}' feature, {c} importance FROM per" for c in _FE) + ")") + f"""
SELECT feature, {R('avg(importance)')} mean, {R('coalesce(stddev_samp(importance), 0.0)')} std FROM lg GROUP BY feature"""

# ---------------------------------------------------------------------------------- nearest neighbours

_KNN = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v, label FROM embeddings),
dd AS (SELECT a.vec_id, b.vec_id nb, list_distance(a.v, b.v) dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nb) r FROM dd QUALIFY r <= 5)"""
SQL["knn_exact"] = W(_KNN) + f"""
SELECT vec_id, CAST(r AS INT) "rank", nb neighbor_id, {R('dist')} distance FROM rk"""
SQL["knn_classify"] = W(_KNN, "v AS (SELECT rk.vec_id, e.label, count(*) c FROM rk JOIN e ON e.vec_id = rk.nb GROUP BY ALL)") + f"""
SELECT vec_id, arg_min(label, (-c, label)) predicted_label, {R('max(c) / 5.0')} share FROM v GROUP BY vec_id"""

# ---------------------------------------------------------------------------------- log-normal curve


def _erfc_sql(x: str) -> str:
    poly = _d(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = f"({_d(c)} + tt * {poly})"
    return poly


SQL["lognormal_curve"] = W(S, f"""zz AS (SELECT id, "time", (ln("time") - {_d(7.8)}) / {_d(1.2)} z FROM S)""",
                          f"""ee AS (SELECT *, abs(z / {_d(2.0 ** 0.5)}) az, 1.0 / (1.0 + 0.5 * abs(z / {_d(2.0 ** 0.5)})) tt FROM zz)""",
                          f"""ef AS (SELECT *, CASE WHEN z / {_d(2.0 ** 0.5)} >= 0 THEN tt * exp(-az * az + {_erfc_sql('az')})
                                         ELSE 2.0 - tt * exp(-az * az + {_erfc_sql('az')}) END erfc FROM ee)""",
                          f"""sf AS (SELECT *, 0.5 * erfc s, exp(-z * z / 2.0) / ({_d(1.2)} * "time" * {_d((2.0 * 3.141592653589793) ** 0.5)}) pdf FROM ef)""") + f"""
SELECT id, {R('s')} survival, {R('-ln(s)')} cumulative_hazard, {R('pdf / s')} hazard FROM sf"""

SQL["pr_mean_summary"] = W(S, P, _pts("p1", "fold"), _PR_CURVE, _GRID, _INTERP,
                           "it2 AS (SELECT fold, 99 - k k, CASE WHEN 99 - k = 0 THEN 1.0 ELSE y END y FROM it)",
                           "mm AS (SELECT it2.k, grid.g, CASE WHEN it2.k = 99 THEN 0.0 ELSE avg(y) END m "
                           "FROM it2 JOIN grid USING (k) GROUP BY it2.k, grid.g)",
                           "ml AS (SELECT *, lag(g) OVER (ORDER BY k) g0, lag(m) OVER (ORDER BY k) m0, "
                           "2.0 * g * m / (g + m) f1 FROM mm)") + f"""
SELECT {R('sum((g - g0) * (m + m0) / 2.0)')} auc, {R('arg_min(g, (-coalesce(f1, CAST(\'-inf\' AS DOUBLE)), k))')} best_recall,
       {R('arg_min(m, (-coalesce(f1, CAST(\'-inf\' AS DOUBLE)), k))')} best_precision_mean FROM ml"""

SQL["load_oof"] = SQL["oof_pivot"]

# ---------------------------------------------------------------------------------- survival regression

# numeric features filled with their median, as the model frame has them; folds from P
_MF = """MF AS (SELECT S.id, S."time", S.event, P.fold, coalesce(x_num, (SELECT median(x_num) FROM S)) f0,
                       coalesce(x_code, (SELECT median(x_code) FROM S)) f1, S.pred f2 FROM S JOIN P USING (id))"""


def _given(rows: str) -> str:
    return f"given AS (SELECT * FROM (VALUES {rows}) v(fold, {{}}))"


# fixed values: the given models, by fold f from 1 to 7
_COX_GIVEN = ", ".join(f"({f}, {_d(0.00001 * f)}, {_d(0.01 - 0.002 * f)}, {_d(0.3 + 0.05 * f)}, {_d(4000.0 + 10 * f)}, {_d(12.0)}, {_d(0.3)})" for f in range(1, 8))
_AFT_GIVEN = ", ".join(f"({f}, {_d(6.5 + 0.1 * f)}, {_d(0.00002 * f)}, {_d(0.01)}, {_d(-0.2)}, {_d(0.8 + 0.05 * f)})" for f in range(1, 8))
_COX_TABLE = _given(_COX_GIVEN).format("b0, b1, b2, c0, c1, c2")
# each row once for each model it trains
_COX_LONG = 'L AS (SELECT g.fold m, MF."time", MF.event, f0, f1, f2, b0, b1, b2, c0, c1, c2 FROM MF JOIN given g ON MF.fold <> g.fold)'

SQL["cox_given_oof"] = W(S, P, _MF, _COX_TABLE, _COX_LONG,
                         'tt AS (SELECT m, "time", sum(event) d, sum(exp((f0 - c0) * b0 + (f1 - c1) * b1 + (f2 - c2) * b2)) a FROM L GROUP BY m, "time")',
                         'rs AS (SELECT m, "time", d, sum(a) OVER (PARTITION BY m ORDER BY "time" DESC) s0 FROM tt)',
                         'bl AS (SELECT m, "time", sum(d / s0) OVER (PARTITION BY m ORDER BY "time") h0 FROM rs)',
                         'pr AS (SELECT id, MF.fold, "time", exp((f0 - c0) * b0 + (f1 - c1) * b1 + (f2 - c2) * b2) risk FROM MF JOIN given g ON g.fold = MF.fold)',
                         'jj AS (SELECT pr.*, coalesce(bl.h0, 0.0) h0 FROM pr ASOF LEFT JOIN bl ON pr.fold = bl.m AND pr."time" >= bl."time")') + f"""
SELECT id, fold, {R('risk')} oof_risk_score, {R('h0 * risk')} oof_cumulative_hazard, {R('exp(-h0 * risk)')} oof_survival_probability FROM jj"""

# one row an event: the l-th of d tied events, by the definition
_EFRON_W = "exp(f0 * b0 + f1 * b1 + f2 * b2)"
_EFRON_X = 'X AS (SELECT m, "time", event, f0 - o0 f0, f1 - o1 f1, f2 - o2 f2, b0, b1, b2 FROM L, (SELECT avg(f0) o0, avg(f1) o1, avg(f2) o2 FROM MF))'
_EFRON_T = "ts AS (SELECT m, \"time\", sum(event) d, sum(event * (f0 * b0 + f1 * b1 + f2 * b2)) fit, sum(w) a, sum(event * w) da, " + ", ".join(
    f"sum(w * f{i}) a{i}, sum(event * w * f{i}) da{i}, sum(w * f{i} * f{i}) q{i}, sum(event * w * f{i} * f{i}) dq{i}, sum(event * f{i}) x{i}" for i in range(3)) + \
    f" FROM (SELECT *, {_EFRON_W} w FROM X) GROUP BY m, \"time\")"
_EFRON_R = "rs AS (SELECT m, d, fit, da, x0, x1, x2, " + ", ".join(f"da{i}, dq{i}, sum(a{i}) OVER k s{i}, sum(q{i}) OVER k sq{i}" for i in range(3)) + \
    ', sum(a) OVER k s FROM ts WINDOW k AS (PARTITION BY m ORDER BY "time" DESC))'
_EFRON_E = "ev AS (SELECT m, d, fit, l, x0, x1, x2, s - l / d * da r, " + ", ".join(f"s{i} - l / d * da{i} r{i}, sq{i} - l / d * dq{i} rq{i}" for i in range(3)) + \
    " FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) l FROM rs WHERE d > 0))"
SQL["cox_efron_sums"] = W(S, P, _MF, _COX_TABLE, _COX_LONG, _EFRON_X, _EFRON_T, _EFRON_R, _EFRON_E) + "SELECT m fold, " + R(
    "(sum(CASE WHEN l = 0 THEN fit ELSE 0 END) - sum(ln(r))) / count(*)") + " loglik, " + ", ".join(
    f"{R(f'(sum(CASE WHEN l = 0 THEN x{i} ELSE 0 END) - sum(r{i} / r)) / count(*)')} g_{n}, {R(f'sum(rq{i} / r - r{i} / r * (r{i} / r)) / count(*)')} h_{n}"
    for i, n in enumerate(("x_num", "x_code", "pred"))) + " FROM ev GROUP BY m"

_AFT_Z = 'z AS (SELECT id, MF.fold, a + b0 * f0 + b1 * f1 + b2 * f2 eta, s, (ln("time") - (a + b0 * f0 + b1 * f1 + b2 * f2)) / s z FROM MF JOIN given g ON g.fold = MF.fold)'
_AFT_E = f"""ee AS (SELECT *, abs(z / {_d(2.0 ** 0.5)}) az, 1.0 / (1.0 + 0.5 * abs(z / {_d(2.0 ** 0.5)})) tt FROM z),
ef AS (SELECT *, CASE WHEN z >= 0 THEN tt * exp(-az * az + {_erfc_sql('az')}) ELSE 2.0 - tt * exp(-az * az + {_erfc_sql('az')}) END erfc FROM ee),
hh AS (SELECT id, fold, eta, 'weibull' family, exp(z) H, exp(eta + s * ln(ln(2.0))) mid FROM ef
       UNION ALL SELECT id, fold, eta, 'loglogistic', ln(1.0 + exp(z)), exp(eta) FROM ef
       UNION ALL SELECT id, fold, eta, 'lognormal', -ln(0.5 * erfc), exp(eta) FROM ef)"""
SQL["aft_given_oof"] = W(S, P, _MF, _given(_AFT_GIVEN).format("a, b0, b1, b2, s"), _AFT_Z, _AFT_E) + f"""
SELECT id, fold, family, {R('-eta')} oof_risk_score, {R('H')} oof_cumulative_hazard, {R('exp(-H)')} oof_survival_probability, {R('mid')} oof_median FROM hh"""


# ---------------------------------------------------------------------------------- AUC of the folds beside the mean curves

def _auc_folds(curve: str, area: str, lag: str) -> str:
    return W(S, P, _pts("p1", "fold"), curve,
             f"fa AS (SELECT fold, sum({area}) auc FROM (SELECT *, {lag} FROM cp WINDOW w AS (PARTITION BY fold ORDER BY pos)) GROUP BY fold)") + f"""
SELECT {R('avg(auc)')} auc_mean, {R('stddev_pop(auc)')} auc_std FROM fa"""


SQL["roc_fold_summary"] = f"SELECT * FROM ({SQL['roc_mean_summary']}) CROSS JOIN (" + _auc_folds(
    _ROC_CURVE, "(x - x0) * (y + y0) / 2.0", "lag(x) OVER w x0, lag(y) OVER w y0") + ")"
SQL["pr_fold_summary"] = f"SELECT * FROM ({SQL['pr_mean_summary']}) CROSS JOIN (" + _auc_folds(
    _PR_CURVE, "((1 - x) - (1 - x1)) * (y + y1) / 2.0", "lead(x) OVER w x1, lead(y) OVER w y1") + ")"

# ---------------------------------------------------------------------------------- maximum likelihood by recursion

def _rows(keys: str) -> str:
    return f'b AS (SELECT {keys}ln("time") l, CAST(event AS DOUBLE) e, CAST(count(*) AS DOUBLE) n FROM S WHERE "time" > 0 GROUP BY ALL)'


_WEIBULL = ("st AS (SELECT grp, max(l) mx, sum(n * e) D, sum(n * e * l) - sum(n * e) * max(l) SL FROM b GROUP BY grp)",
            "c AS (SELECT grp, l - mx u, n FROM b JOIN st USING (grp))",
            """nr AS (SELECT grp, 0 i, CAST(1.0 AS DOUBLE) r FROM st WHERE D > 0
  UNION ALL SELECT grp, i + 1, CASE WHEN r - sc / dv > 0 THEN r - sc / dv ELSE r / 2 END
  FROM (SELECT grp, i, r, D / r + SL - D * B / A sc, -D / (r * r) - D * (C * A - B * B) / (A * A) dv
        FROM (SELECT nr.grp, nr.i, nr.r, sum(n * exp(r * u)) A, sum(n * exp(r * u) * u) B, sum(n * exp(r * u) * u * u) C
              FROM nr JOIN c USING (grp) WHERE nr.i < 25 GROUP BY nr.grp, nr.i, nr.r) JOIN st USING (grp)))""",
            "wf AS (SELECT nr.grp, exp(any_value(mx) + ln(sum(n * exp(r * u)) / any_value(D)) / r) lam, r rho FROM nr JOIN c USING (grp) JOIN st USING (grp) WHERE nr.i = 25 GROUP BY nr.grp, r)")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


SQL["weibull_fit"] = _recursive(W(S, _rows("grp, "), *_WEIBULL)) + f"SELECT grp, {R('lam')} lambda_, {R('rho')} rho_, TRUE converged FROM wf"
SQL["weibull_fitted_curve"] = _recursive(W(S, _rows("grp, "), *_WEIBULL)) + f"""
SELECT id, grp, {R('exp(-pow("time" / lam, rho))')} survival, {R('pow("time" / lam, rho)')} cumulative_hazard,
       {R('rho / lam * pow("time" / lam, rho - 1.0)')} hazard FROM S LEFT JOIN wf USING (grp)"""


def _damped(init: str, terms: str, positive_b: bool, steps: int = 40) -> tuple[str, str]:
    """Damped Newton in (a, b): ``terms`` gives per-row ll, ga, gb, haa, hab, hbb at (pa, pb)."""
    size = f"greatest(abs(da), abs(db){' / greatest(tb, 1e-12)' if positive_b else ''}, 1e-300)"
    half = "CASE WHEN -db * sc / tb >= 1 THEN pow(0.5, floor(log2(-db * sc / tb)) + 1) ELSE 1.0 END" if positive_b else "1.0"
    return (f"i0 AS ({init})", f"""nr AS (SELECT g, 0 i, a, b, CAST(NULL AS DOUBLE) best, CAST(0.0 AS DOUBLE) sa, CAST(0.0 AS DOUBLE) sb FROM i0
  UNION ALL SELECT g, i + 1, CASE WHEN ok THEN ta ELSE a END, CASE WHEN ok THEN tb ELSE b END, CASE WHEN ok THEN ll ELSE best END,
                   CASE WHEN ok THEN da * sc * hv ELSE sa / 2 END, CASE WHEN ok THEN db * sc * hv ELSE sb / 2 END
  FROM (SELECT *, {half} hv FROM (SELECT *, least(1.0, 1.0 / {size}) sc FROM (
    SELECT *, best IS NULL OR ll >= best - 1e-12 * abs(best) ok,
           CASE WHEN haa * hbb - hab * hab > 0 AND haa < 0 THEN -(hbb * ga - hab * gb) / (haa * hbb - hab * hab) ELSE 1e-3 * ga END da,
           CASE WHEN haa * hbb - hab * hab > 0 AND haa < 0 THEN -(haa * gb - hab * ga) / (haa * hbb - hab * hab) ELSE 1e-3 * gb END db
    FROM (SELECT g, i, a, b, best, sa, sb, pa ta, pb tb, sum(n * ll) ll, sum(n * ga) ga, sum(n * gb) gb, sum(n * haa) haa, sum(n * hab) hab, sum(n * hbb) hbb
          FROM ({terms}) GROUP BY g, i, a, b, best, sa, sb, pa, pb)))))""")


_TRY = f"SELECT nr.*, bb.l, bb.e, bb.n, nr.a + nr.sa pa, nr.b + nr.sb pb FROM nr JOIN bb USING (g) WHERE nr.i < 40"
_LOGISTIC = f"""SELECT *, e * (ln(pb) - pa + (pb - 1) * u) - (1 + e) * CASE WHEN pb * u > 30 THEN pb * u ELSE ln(1 + exp(pb * u)) END ll, -e * pb + (1 + e) * pb * sg ga,
  e * (1 / pb + u) - (1 + e) * sg * u gb, -(1 + e) * pb * pb * sg * (1 - sg) haa, -e + (1 + e) * sg + (1 + e) * pb * sg * (1 - sg) * u hab,
  -e / (pb * pb) - (1 + e) * sg * (1 - sg) * u * u hbb FROM (SELECT *, l - pa u, 1 / (1 + exp(-pb * (l - pa))) sg FROM ({_TRY}))"""
SQL["loglogistic_fit"] = _recursive(W(S, _rows(""), "bb AS (SELECT 1 g, * FROM b)", *_damped(
    "SELECT 1 g, sum(n * l) / sum(n) a, CAST(1.0 AS DOUBLE) b FROM b", _LOGISTIC, True))) + f"SELECT {R('exp(a)')} alpha_, {R('b')} beta_, TRUE converged FROM nr WHERE i = 40"
_NORMAL_Z = f"SELECT *, (l - pa) / exp(pb) z, exp(pb) sg FROM ({_TRY})"
_NORMAL_T = f"SELECT *, abs(z / {_d(2.0 ** 0.5)}) az, 1.0 / (1.0 + 0.5 * abs(z / {_d(2.0 ** 0.5)})) tt FROM ({_NORMAL_Z})"
_NORMAL_S = f"SELECT *, 0.5 * CASE WHEN z >= 0 THEN tt * exp(-az * az + {_erfc_sql('az')}) ELSE 2.0 - tt * exp(-az * az + {_erfc_sql('az')}) END sf FROM ({_NORMAL_T})"
_NORMAL_L = f"SELECT *, exp(-z * z / 2.0) / {_d((2.0 * 3.141592653589793) ** 0.5)} / sf lam FROM ({_NORMAL_S})"
_NORMAL = f"""SELECT *, e * (-pb - l - {_d(0.9189385332046727)} - z * z / 2) + (1 - e) * ln(sf) ll, e * z / sg + (1 - e) * lam / sg ga, e * (z * z - 1) + (1 - e) * lam * z gb,
  -e / (sg * sg) - (1 - e) * lam * (lam - z) / (sg * sg) haa, -2 * e * z / sg + (1 - e) * (-z * lam * (lam - z) - lam) / sg hab,
  -2 * e * z * z + (1 - e) * (-z * z * lam * (lam - z) - lam * z) hbb FROM ({_NORMAL_L})"""
SQL["lognormal_fit"] = _recursive(W(S, _rows("grp, "), "bb AS (SELECT grp g, l, e, n FROM b)", *_damped(
    "SELECT grp g, sum(n * l) / sum(n) a, ln(sqrt(sum(n * l * l) / sum(n) - pow(sum(n * l) / sum(n), 2))) b FROM b GROUP BY grp", _NORMAL, False))) + \
    f"SELECT g grp, {R('a')} mu_, {R('exp(b)')} sigma_, TRUE converged FROM nr WHERE i = 40"

SQL["knn_oof"] = W("""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v, CAST(vec_id % 7 + 1 AS INT) fold, CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END y FROM embeddings)""",
                   """rk AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) r
FROM e a JOIN e b ON a.fold <> b.fold QUALIFY r <= 5)""") + f"""
SELECT vec_id, any_value(fold) fold, {R('avg(rk.y)')} prediction FROM e JOIN rk USING (vec_id) GROUP BY vec_id"""


# normal equations of three features by Cramer's rule on the training rows of each fold

def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _normal_equations(l2: float) -> str:
    sums = ", ".join([f"covar_pop(f{i}, f{j}) * count(*) + {_d(l2 if i == j else 0.0)} a{i}{j}" for i in range(3) for j in range(3)]
                     + [f"covar_pop(f{i}, y) * count(*) c{i}, avg(f{i}) m{i}" for i in range(3)])
    a = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
    beta = ", ".join(f"{_det([[f'c{i}' if j == k else a[i][j] for j in range(3)] for i in range(3)])} / {_det(a)} b{k}" for k in range(3))
    return W(S, P, _MF, 'Y AS (SELECT *, ln("time") y FROM MF)', "fo AS (SELECT DISTINCT fold f FROM MF)",
             f"sm AS (SELECT f, avg(y) my, {sums} FROM Y JOIN fo ON Y.fold <> fo.f GROUP BY f)", f"be AS (SELECT f, my, m0, m1, m2, {beta} FROM sm)") + f"""
SELECT id, fold, {R('my + b0 * (f0 - m0) + b1 * (f1 - m1) + b2 * (f2 - m2)')} prediction FROM MF JOIN be ON be.f = MF.fold"""


SQL["linear_oof"] = _normal_equations(0.0)
SQL["ridge_oof"] = _normal_equations(1000.0)


# ---------------------------------------------------------------------------------- folds as frames, exact lookup

SQL["fold_frames"] = W(S, P, "fo AS (SELECT DISTINCT fold f FROM P)") + f"""
SELECT f fold, CAST(count(*) FILTER (fold <> f) AS BIGINT) training, CAST(count(*) FILTER (fold <> f AND event = 1) AS BIGINT) two_stage,
       CAST(count(*) FILTER (fold = f) AS BIGINT) validation, {R('avg("time") FILTER (fold <> f AND event = 1)')} two_stage_time,
       {R('avg(p1) FILTER (fold = f)')} validation_p1 FROM P, fo GROUP BY f"""
SQL["exact_lookup"] = W(S, _C.format(f="S"), _KM, "pr AS (SELECT id, grp, floor(pred * 3000.0) + CASE WHEN id % 3 = 0 THEN 0.5 ELSE 0.0 END probe FROM S)") + f"""
SELECT pr.id, {R("pr.probe")} probe, {R("k2.s")} survival FROM pr LEFT JOIN k2 ON pr.probe = k2."time" """
