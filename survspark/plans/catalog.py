"""Registered queries: one per operator family of the survey, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (through the frames S, G, P, E that Spark derives from
them) and runs over whole tables.  Floating outputs are rounded to 6 decimals (the same
rounding is applied in the DuckDB oracle) so that last-bit differences in summation order do
not decide equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import scalar as sc
from ..operators import combine, concord, encode, estimate, folds, metrics, parametric, scan, targets
from ..session import scratch_path, written
from ..sources import io
from . import frames

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (and turn -0.0 into 0.0) for engine-independent comparison."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def _s(spark, d):
    return frames.frame_s(spark, d)


def _g(spark, d):
    return frames.frame_g(spark, d)


def _p(spark, d):
    return frames.frame_p(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, d, _fn=fn: rounded(_fn(spark, d))
        QUERIES[name].__doc__ = fn.__doc__
        QUERIES[name].__name__ = name
        return fn
    return deco


# --------------------------------------------------------------------------- survival curves (SV1-SV8)

@query("km_events_only")
def q_km_events_only(spark, d):
    """SV1+SV4: KM fitted on event rows, evaluated at every row's time."""
    s = _s(spark, d)
    c = estimate.survival_curve(s)
    return estimate.attach_curve(s.select("id", "time"), c, {"survival_probability": "km_events_only"}).drop("time")


@query("km_censored")
def q_km_censored(spark, d):
    """SV2: KM with censoring, one row per distinct time."""
    return estimate.kaplan_meier(_s(spark, d), events_only=False)


@query("km_by_group")
def q_km_by_group(spark, d):
    """SV3+JN4: per-group KM (event rows) scattered back to rows."""
    s = _s(spark, d)
    c = estimate.survival_curve(s, by=["grp"])
    return estimate.attach_curve(s.select("id", "grp", "time"), c, {"group_survival_probability": "km_events_only"},
                                 by=["grp"]).drop("time")


@query("km_at_rows")
def q_km_at_rows(spark, d):
    """JN3/SV4: as-of lookup of the censored KM curve at probe times ``pred * 3000`` (before the
    first time -> 1, between times -> step value, after the last -> last value)."""
    s = _s(spark, d)
    curve = estimate.kaplan_meier(s, events_only=False)
    probes = s.select("id", (F.col("pred") * F.lit(3000.0)).alias("probe"))
    return scan.lookup_asof(probes, curve, "probe", ["survival"], key="id", initial={"survival": 1.0})


@query("na_smooth")
def q_na_smooth(spark, d):
    """SV5: Nelson-Aalen with tie smoothing, per distinct time."""
    return estimate.nelson_aalen(_s(spark, d), ties="smooth")


@query("na_breslow")
def q_na_breslow(spark, d):
    """SV5: Nelson-Aalen with Breslow ties (d/n), per distinct time."""
    return estimate.nelson_aalen(_s(spark, d), ties="breslow")


@query("na_by_group")
def q_na_by_group(spark, d):
    """SV6/SV8: per-group cumulative hazard and hazard rate at each row (frame G, no ties)."""
    g = _g(spark, d)
    c = estimate.survival_curve(g, by=["grp"])
    return estimate.attach_curve(g.select("id", "grp", "time"), c,
                                 {"group_cumulative_hazard": "na_smooth", "group_hazard_rate": "na_smooth_inc"},
                                 by=["grp"]).drop("time")


@query("na_at_rows")
def q_na_at_rows(spark, d):
    """SV7/JN2: global cumulative hazard at each row's own time (frame G, one zero duration)."""
    g = _g(spark, d)
    c = estimate.survival_curve(g)
    return estimate.attach_curve(g.select("id", "time"), c, {"cumulative_hazard": "na_smooth"}).drop("time")


@query("hazard_rate")
def q_hazard_rate(spark, d):
    """SV8/WN3: discrete hazard (increment of H at the row's time, 0 at censor-only times)."""
    s = _s(spark, d)
    c = estimate.survival_curve(s)
    return estimate.attach_curve(s.select("id", "time"), c, {"hazard_rate": "na_smooth_inc"}).drop("time")


@query("survival_targets")
def q_survival_targets(spark, d):
    """SV15, TG3-TG5: full per-row target table."""
    return estimate.survival_targets(_s(spark, d)).drop("time", "grp")


@query("curve_table")
def q_curve_table(spark, d):
    """SV18: plot numbers per time: KM with log-log band, 1-S, censor counts, NA with band."""
    return estimate.curve_table(_s(spark, d))


@query("prefix_scan")
def q_prefix_scan(spark, d):
    """WN2: per group, rows at risk (suffix count) and events so far (prefix count) per time."""
    c = _s(spark, d).groupBy("grp", "time").agg(F.count(F.lit(1)).alias("n"), F.sum("event").cast("long").alias("d"))
    a = scan.prefix_scan(c, "time", {"at_risk": "n"}, by=["grp"], reverse=True, unique=True)
    return scan.prefix_scan(a, "time", {"events_so_far": "d"}, by=["grp"], unique=True)


# --------------------------------------------------------------------------- parametric (SV9-SV14)

@query("exponential_fit")
def q_exponential_fit(spark, d):
    """SV9/SV14: exponential fit on S, S(t), H(t), h(t) at each row."""
    s = _s(spark, d)
    p = parametric.fit_exponential(s)
    return parametric.evaluate(s.select("id", "time"), p, "exponential").drop("time")


@query("exponential_by_group")
def q_exponential_by_group(spark, d):
    """SV9: exponential scale per group (frame G)."""
    return parametric.fit_exponential(_g(spark, d), group="grp")


@query("weibull_curve")
def q_weibull_curve(spark, d):
    """SV10/SV14: Weibull S, H, h at row times for given parameters (lambda=800, rho=1.3)."""
    s = _s(spark, d)
    p = parametric.params_frame(spark, "weibull", {"lambda_": 800.0, "rho_": 1.3})
    return parametric.evaluate(s.select("id", "time"), p, "weibull").drop("time")


@query("loglogistic_curve")
def q_loglogistic_curve(spark, d):
    """SV11/SV14: log-logistic S, H, h at row times for given parameters (alpha=900, beta=2.2)."""
    s = _s(spark, d)
    p = parametric.params_frame(spark, "loglogistic", {"alpha_": 900.0, "beta_": 2.2})
    return parametric.evaluate(s.select("id", "time"), p, "loglogistic").drop("time")


# --------------------------------------------------------------------------- targets and folds (TG, FD)

@query("log_time_targets")
def q_log_time_targets(spark, d):
    """TG1/TG2: ln(t) (-inf at t=0) and the censoring-signed time, frame G."""
    return targets.add_targets(_g(spark, d).select("id", "time", "event")).drop("time", "event")


@query("sample_weights")
def q_sample_weights(spark, d):
    """TG6: weight 1.5 for event rows."""
    return targets.sample_weight(_s(spark, d).select("id", "event"), "event", 1.5).drop("event")


@query("time_bins")
def q_time_bins(spark, d):
    """FD1: time bin of each row."""
    return folds.time_bin(_s(spark, d).select("id", "time")).drop("time")


@query("stratified_folds")
def q_stratified_folds(spark, d):
    """FD2/WN4: seeded stratified 7-fold assignment."""
    return _p(spark, d).select("id", "fold")


@query("fold_one_hot")
def q_fold_one_hot(spark, d):
    """FD3/PR1: wide fold membership columns."""
    return folds.widen_folds(_p(spark, d).select("id", "fold"), 7)


@query("fold_counts")
def q_fold_counts(spark, d):
    """FD6: group and event counts of every fold, zero where a fold lacks a value."""
    return folds.fold_counts(_p(spark, d))


@query("fold_report")
def q_fold_report(spark, d):
    """AG2/AG11/FD6: per-fold size, events, mean time."""
    return folds.fold_report(_p(spark, d))


@query("fold_balance")
def q_fold_balance(spark, d):
    """AG1/AG3/AG4/AG11: balance statistics across folds."""
    return folds.fold_balance(_p(spark, d))


@query("two_stage_mask")
def q_two_stage_mask(spark, d):
    """FD4/FD5/PR3: per fold, training rows (other folds), two-stage rows (other folds and event)
    and validation rows, from one aggregate by fold (no per-fold pass over the rows)."""
    per = _p(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("validation"),
                                           F.sum("event").cast("long").alias("__ev"))
    tot = Window.partitionBy()  # over the k-row per-fold table only
    return per.select("fold", (F.sum("validation").over(tot) - F.col("validation")).alias("training"),
                      (F.sum("__ev").over(tot) - F.col("__ev")).alias("two_stage"), "validation")


@query("fold_frames")
def q_fold_frames(spark, d):
    """FD4/FD5/PR3: training, two-stage and validation frames of each fold, as the trainers take them, described by counts and means."""
    p = _p(spark, d)
    parts = []
    for f in range(1, 8):
        train, valid = folds.split_fold(p, f)
        events, _ = folds.split_fold(p, f, event="event", events_only=True)
        a = train.agg(F.count(F.lit(1)).alias("training"))
        b = events.agg(F.count(F.lit(1)).alias("two_stage"), F.avg("time").alias("two_stage_time"))
        c = valid.agg(F.count(F.lit(1)).alias("validation"), F.avg("p1").alias("validation_p1"))
        parts.append(a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).select(F.lit(f).alias("fold"), "*"))  # one row each
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("exact_lookup")
def q_exact_lookup(spark, d):
    """JN2: Kaplan-Meier at probes that hit a time of the curve exactly; null elsewhere (no step is taken)."""
    s = _s(spark, d)
    curve = estimate.survival_curve(s).select("time", F.col("km").alias("survival"))
    probe = F.floor(F.col("pred") * 3000.0).cast("double") + F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.0)
    return scan.lookup_exact(s.select("id", probe.alias("probe")), curve, "probe", ["survival"]).select("id", "probe", "survival")


# --------------------------------------------------------------------------- encoders (EN1-EN11)

def _onehot_long(df: DataFrame, enc: encode.OneHot) -> DataFrame:
    cols = enc.output_columns()
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("v")) for c in cols])
    x = enc.transform(df.select("id", *enc.cols)).select("id", F.explode(arr).alias("u"))
    return x.filter(F.col("u.v") == 1).select("id", F.col("u.feature").alias("feature"))


@query("one_hot_infrequent")
def q_one_hot_infrequent(spark, d):
    """EN1: one-hot of x_cat and x_code with infrequent bucket (min 500) and nan category; long form
    ``(id, feature)`` of the hot cells."""
    s = _s(spark, d)
    enc = encode.OneHot(["x_cat", "x_code"], min_count=500).fit(s)
    return _onehot_long(s, enc)


@query("one_hot_strict")
def q_one_hot_strict(spark, d):
    """EN2: strict one-hot (no bucket, unknown raises) of x_cat."""
    s = _s(spark, d)
    enc = encode.OneHot(["x_cat"], min_count=0, unknown="error").fit(s)
    return _onehot_long(s, enc)


@query("ordinal_missing")
def q_ordinal_missing(spark, d):
    """EN3: ordinal codes with missing coded ('missing' / -1)."""
    s = _s(spark, d)
    return encode.Ordinal(["x_cat", "x_code"]).fit(s).transform(s.select("id", "x_cat", "x_code")).drop("x_cat", "x_code")


@query("ordinal_null")
def q_ordinal_null(spark, d):
    """EN4: ordinal codes keeping missing as missing (float)."""
    s = _s(spark, d)
    return (encode.Ordinal(["x_cat", "x_code"], missing="null").fit(s)
            .transform(s.select("id", "x_cat", "x_code")).drop("x_cat", "x_code"))


@query("standardise")
def q_standardise(spark, d):
    """EN5: standardised x_num (population std, median fill)."""
    s = _s(spark, d)
    return encode.Standardise(["x_num"]).fit(s).transform(s.select("id", "x_num")).drop("x_num")


@query("median_impute")
def q_median_impute(spark, d):
    """EN8/PR10/AG6: exact median fill of x_num and x_code."""
    s = _s(spark, d).select("id", "x_num", "x_code")
    return encode.MedianImputer(["x_num", "x_code"]).fit(s).transform(s)


@query("category_cast")
def q_category_cast(spark, d):
    """EN6/PR7: category cast with suffix (missing stays missing)."""
    return sc.cast_columns(_s(spark, d).select("id", "x_code"), ["x_code"], "category").drop("x_code")


@query("string_cast")
def q_string_cast(spark, d):
    """EN7/PR7: string cast with suffix (missing -> 'nan')."""
    return sc.cast_columns(_s(spark, d).select("id", "x_code"), ["x_code"], "str").drop("x_code")


@query("cardinality")
def q_cardinality(spark, d):
    """EN9: number of ordinal codes per encoded column."""
    s = _s(spark, d)
    card = encode.Ordinal(["x_cat", "x_code"]).fit(s).cardinalities()
    return spark.createDataFrame(sorted(card.items()), "column string, cardinality int")


@query("encoder_reload")
def q_encoder_reload(spark, d):
    """IO7/EN10: fit, save as Parquet, load and transform without refitting."""
    s = _s(spark, d)
    path = scratch_path(spark, "ordinal")
    encode.save_encoder(spark, encode.Ordinal(["x_cat", "x_code"]).fit(s), path)
    enc = encode.load_encoder(spark, path)
    return enc.transform(s.select("id", "x_cat", "x_code")).drop("x_cat", "x_code")


@query("preprocess_pipeline")
def q_preprocess_pipeline(spark, d):
    """EN11: targets, weights, one-hot, ordinal and standardise fitted once and applied in one projection."""
    s = _s(spark, d)
    spec = {"categorical": ["x_cat"], "continuous": ["x_num"], "event_weight": 1.5, "min_count": 500}
    out, _ = encode.preprocess(s, spec)
    return out.select("id", "log_time", "inverted_time", "weight", "x_cat_encoded", "x_num_normalized")


# --------------------------------------------------------------------------- combination (PP, WN1, ML10, ML12)

@query("rank_transform")
def q_rank_transform(spark, d):
    """WN1/PP5: percentile rank (average ties) of round(r1, 2) within each fold."""
    p = _p(spark, d).select("id", "fold", F.round("r1", 2).alias("r"))
    return combine.rank_pct(p, "r", "rank", by=["fold"]).select("id", "rank")


@query("two_stage_log_time")
def q_two_stage_log_time(spark, d):
    """PP1/PP4: p / exp(r) with the raw regression kept."""
    return combine.two_stage(_p(spark, d).select("id", "p1", "r1"), "p1", "r1", "log_time").drop("p1", "r1")


@query("two_stage_time")
def q_two_stage_time(spark, d):
    """PP2: p / r."""
    return combine.two_stage(_p(spark, d).select("id", "p1", "r1"), "p1", "r1", "time").drop("p1", "r1")


@query("two_stage_exp")
def q_two_stage_exp(spark, d):
    """PP3: p * exp(r) (survival-probability and hazard targets)."""
    return combine.two_stage(_p(spark, d).select("id", "p1", "r2"), "p1", "r2",
                             "log_km_survival_probability").drop("p1", "r2")


def _seed_long(p: DataFrame) -> DataFrame:
    """Three seeds' predictions per row, derived from the planted columns."""
    return p.select("id", F.explode(F.array(
        F.struct(F.lit(1).alias("seed"), F.col("p1").alias("prediction")),
        F.struct(F.lit(2).alias("seed"), F.col("p2").alias("prediction")),
        F.struct(F.lit(3).alias("seed"), F.col("p3").alias("prediction")))).alias("u")).select("id", "u.*")


@query("seed_average")
def q_seed_average(spark, d):
    """ML10: average of the per-seed predictions."""
    return combine.seed_average(_seed_long(_p(spark, d)))


@query("fold_rank_average")
def q_fold_rank_average(spark, d):
    """ML12: each row scored by the six models, rank-transformed per model, ranks averaged."""
    p = _p(spark, d)
    cols = [f"p{i}" for i in range(1, 7)]
    long = p.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("prediction"))
                                              for c in cols])).alias("u")).select("id", "u.*")
    return combine.fold_rank_average(long)


@query("classifier_blend")
def q_classifier_blend(spark, d):
    """PP6: 0.45/0.05/0.05/0.2/0.125/0.125 blend of six classifiers."""
    return combine.blend(_p(spark, d), combine.CLASSIFIER_BLEND).select("id", "prediction")


@query("classifier_blend_2")
def q_classifier_blend_2(spark, d):
    """PP7: 0.975/0.025 blend."""
    return combine.blend(_p(spark, d), combine.CLASSIFIER_BLEND_2).select("id", "prediction")


def _ranking_inputs(p: DataFrame) -> DataFrame:
    return p.select("id", "grp", "time", "event", "fold", F.col("r1"), F.col("r2"),
                    F.col("p3").alias("r3"), F.col("p4").alias("r4"), F.col("p5").alias("r5"), "p1")


@query("ranking_blend")
def q_ranking_blend(spark, d):
    """PP8: 0.29/0.29/0.29/0.06/0.07 blend of five ranking predictions."""
    return combine.blend(_ranking_inputs(_p(spark, d)), combine.RANKING_BLEND).select("id", "prediction")


# fixed values: per-group multipliers used by the query (the published ones are all 1.0)
GROUP_FACTORS = {"AUTOMOBILE": 1.1, "BUILDING": 0.9, "FURNITURE": 1.0, "HOUSEHOLD": 1.05, "MACHINERY": 0.95}


@query("group_multiplier")
def q_group_multiplier(spark, d):
    """PP9/PR5: per-group multiplier applied to the classifier blend."""
    b = combine.blend(_p(spark, d), combine.CLASSIFIER_BLEND)
    return combine.group_multiplier(b, "prediction", "grp", GROUP_FACTORS).select("id", "prediction")


@query("snap_extremes")
def q_snap_extremes(spark, d):
    """PP10: p >= 0.9 -> 1, p <= 0.1 -> 0."""
    return combine.snap_extremes(_p(spark, d).select("id", "p1"), "p1", lo=0.1, hi=0.9)


@query("threshold_scaling")
def q_threshold_scaling(spark, d):
    """PP12: ranking score r1 scaled by the 0.01 grid of event probability p1 below 0.33."""
    return combine.threshold_scaling(_p(spark, d).select("id", "p1", "r1"), "p1", "r1").select("id", "r1")


@query("prediction_error")
def q_prediction_error(spark, d):
    """PP11: event - p."""
    return combine.prediction_error(_p(spark, d).select("id", "event", "p1"), "event", "p1", "error").select("id", "error")


@query("oof_pivot")
def q_oof_pivot(spark, d):
    """IO5: long predictions of three models pivoted to ``{model}_prediction`` columns."""
    long = _seed_long(_p(spark, d)).select("id", F.concat(F.lit("m"), F.col("seed")).alias("model"),
                                           F.col("prediction").alias("v"))
    return io.pivot_predictions(long, ["m1", "m2", "m3"])


@query("attach_predictions")
def q_attach_predictions(spark, d):
    """JN1/PR2: attach OOF predictions to subjects by key (not position), renamed."""
    s = _s(spark, d).select("id", "grp", "time")
    p = _p(spark, d).select("id", "p1")
    return combine.attach(s, p, "id", ["p1"], rename={"p1": "efs_prediction"})


@query("scatter_group_curve")
def q_scatter_group_curve(spark, d):
    """JN4: per-group censored KM and Breslow hazard scattered back to rows."""
    s = _s(spark, d)
    c = estimate.survival_curve(s, by=["grp"])
    return estimate.attach_curve(s.select("id", "grp", "time"), c, {"km": "km", "na": "na_breslow"},
                                 by=["grp"]).drop("time")


@query("append_oof")
def q_append_oof(spark, d):
    """ST1/ST2/PP13: fold blocks appended by name, with reversed column order of the score table."""
    p = _p(spark, d)
    parts = [p.filter(F.col("fold") == f).select("id", F.col("p1").alias("prediction"), F.lit(str(f)).alias("fold"))
             for f in range(1, 8)]
    parts.append(p.select("id", F.col("p1").alias("prediction"), F.col("r1").alias("reg_1_prediction"),
                          F.lit("OOF").alias("fold")))
    u = combine.append_oof(parts)
    return u.select(*u.columns[::-1])


# --------------------------------------------------------------------------- scalar functions

@query("scalar_functions")
def q_scalar_functions(spark, d):
    """SC1-SC6, SC8, SC10: ln, log1p, exp, -exp, clip, floor-div, sign flip, sigmoid, weighted sum."""
    g = _g(spark, d)
    t = F.col("time")
    return g.select("id", sc.ln(t).alias("ln_t"), F.log1p(t).alias("log1p_t"),
                    F.exp(-t / F.lit(1e6)).alias("exp_t"), (-F.exp(F.col("pred") / F.lit(100.0))).alias("neg_exp"),
                    sc.clip(F.log1p(t), 1.0, 4.0).alias("clip_t"), sc.floor_div(F.log1p(t), 0.5).alias("fdiv"),
                    sc.sign_flip(t, F.col("event") == 0).alias("signed"),
                    sc.sigmoid(F.col("pred") / F.lit(100.0) - F.lit(2.0)).alias("sigmoid"),
                    sc.weighted_sum([("pred", 0.3), (t / F.lit(1e6), 0.7)]).alias("wsum"))


@query("slug_names")
def q_slug_names(spark, d):
    """SC7/SC11: slugged group names and prefixed feature names."""
    s = _s(spark, d).select("grp", "x_cat").distinct()
    return s.select(sc.slug(F.concat(F.col("grp"), F.lit(" Group  x"))).alias("slug"),
                    sc.prefixed("x_cat", F.coalesce(F.col("x_cat"), F.lit("nan"))).alias("feature"))


@query("conditional_scale")
def q_conditional_scale(spark, d):
    """PR5/SC6: scale where a mask holds, in order."""
    p = _p(spark, d).select("id", "grp", "p1", "event")
    return combine.scale_where(p, "p1", [(F.col("event") == 1, 1.2), (F.col("grp") == "BUILDING", 0.5)]).select("id", "p1")


@query("nan_to_null")
def q_nan_to_null(spark, d):
    """PR8: NaN becomes null (the input has NaN for every 13th order)."""
    s = _s(spark, d).select("id", F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("x_num")).alias("x"))
    return sc.nan_to_null(s, ["x"])


@query("fill_missing")
def q_fill_missing(spark, d):
    """PR9: 'missing' for strings, -1 for numbers."""
    return sc.fill_missing(_s(spark, d).select("id", "x_cat", "x_code"), ["x_cat", "x_code"])


@query("min_max_scale")
def q_min_max_scale(spark, d):
    """AG5/TG3: min-max scaled log1p of the KM probability."""
    s = _s(spark, d).select("id", F.log1p("pred").alias("v"))
    return targets.min_max_scale(s, "v")


@query("table_roundtrip")
def q_table_roundtrip(spark, d):
    """IO1-IO4, IO8: S written as Parquet and as headered CSV, read back with a schema, id kept."""
    s = _s(spark, d).select("id", "grp", "time", "event", "x_cat")
    base = scratch_path(spark, "roundtrip")
    io.write_table(s, f"{base}/s.parquet")
    pq = io.read_table(spark, f"{base}/s.parquet")
    io.write_table(pq, f"{base}/s.csv", fmt="csv")
    back = io.read_table(spark, f"{base}/s.csv", schema="id bigint, grp string, time double, event int, x_cat string",
                         fmt="csv")
    return io.drop_columns(back, "x_cat")


# --------------------------------------------------------------------------- metrics (MT1-MT15)

@query("cindex_global")
def q_cindex_global(spark, d):
    """MT1/JN5: concordance over all comparable pairs of S (heavy time ties)."""
    c = concord.concordance(_s(spark, d))
    return c.select("concordance", F.col("pairs").cast("long").alias("pairs"))


@query("cindex_by_group")
def q_cindex_by_group(spark, d):
    """MT2: concordance per group."""
    c = concord.concordance(_s(spark, d), group="grp")
    return c.select("grp", "concordance", F.col("pairs").cast("long").alias("pairs"))


@query("cindex_stratified")
def q_cindex_stratified(spark, d):
    """MT1-MT3: micro, per-group, macro, std and stratified (macro - std) concordance."""
    return concord.ranking_score(_s(spark, d))


@query("cindex_no_ties")
def q_cindex_no_ties(spark, d):
    """MT1 on frame G (almost no ties, a zero duration)."""
    c = concord.concordance(_g(spark, d))
    return c.select("concordance", F.col("pairs").cast("long").alias("pairs"))


@query("log_loss_grouped")
def q_log_loss_grouped(spark, d):
    """MT4/MT5: log loss and ROC AUC overall and per group."""
    return metrics.classification_score(_p(spark, d), "grp", "event", "p1")


@query("log_loss_weighted")
def q_log_loss_weighted(spark, d):
    """MT4: weighted log loss (event weight 1.5) overall and per group."""
    p = targets.sample_weight(_p(spark, d), "event", 1.5)
    return metrics.classification_score(p, "grp", "event", "p2", weight="weight")


@query("auc_grouped")
def q_auc_grouped(spark, d):
    """MT5: exact ROC AUC (average ranks for ties) per fold of a tied score round(p2, 2)."""
    p = _p(spark, d).withColumn("s", F.round("p2", 2))
    return metrics.auc_table(p, "event", "s", ["fold"])


@query("roc_points")
def q_roc_points(spark, d):
    """MT6: ROC points of p1 with their neighbouring points."""
    return metrics.roc_points(_p(spark, d), "event", "p1")


@query("pr_points")
def q_pr_points(spark, d):
    """MT7: precision-recall points of p1 with their neighbouring points."""
    return metrics.pr_points(_p(spark, d), "event", "p1")


@query("curve_auc")
def q_curve_auc(spark, d):
    """MT9: trapezoid areas under each fold's ROC and PR curves of round(p1, 2)."""
    p = _p(spark, d).withColumn("s", F.round("p1", 2))
    roc = metrics.curve_auc(metrics.roc_points(p, "event", "s", ["fold"]), "roc", ["fold"]).withColumn("kind", F.lit("roc"))
    pr = metrics.curve_auc(metrics.pr_points(p, "event", "s", ["fold"]), "pr", ["fold"]).withColumn("kind", F.lit("pr"))
    return roc.unionByName(pr)


@query("interpolate_grid")
def q_interpolate_grid(spark, d):
    """SC9: each fold's ROC curve of round(p3, 2) interpolated on the 100-point grid."""
    p = _p(spark, d).withColumn("s", F.round("p3", 2))
    pts = metrics.roc_points(p, "event", "s", ["fold"]).filter(F.col("fpr_prev").isNotNull())
    seg = pts.select("fold", F.col("fpr_prev").alias("x0"), F.col("tpr_prev").alias("y0"),
                     F.col("fpr").alias("x1"), F.col("tpr").alias("y1"))
    last = pts.groupBy("fold").agg(F.max_by(F.struct("fpr", "tpr"), F.struct("fpr", "tpr")).alias("l"))
    tail = last.select("fold", F.col("l.fpr").alias("x0"), F.col("l.tpr").alias("y0"),
                       F.lit(float("inf")).alias("x1"), F.col("l.tpr").alias("y1"))
    return metrics._interp_segments(seg.unionByName(tail), ["fold"], 100)


@query("roc_mean_curve")
def q_roc_mean_curve(spark, d):
    """MT10: mean ROC of p1 over the seven folds with +/- 1 std band."""
    return metrics.mean_roc(_p(spark, d), "event", "p1", "fold")


@query("pr_mean_curve")
def q_pr_mean_curve(spark, d):
    """MT11: mean precision-recall curve of p1 over folds with band."""
    return metrics.mean_pr(_p(spark, d), "event", "p1", "fold")


@query("roc_mean_summary")
def q_roc_mean_summary(spark, d):
    """MT10: area under the mean ROC and the best Youden point."""
    return metrics.grid_summary(metrics.mean_roc(_p(spark, d), "event", "p1", "fold"), "fpr", "tpr_mean", "roc")


@query("roc_fold_summary")
def q_roc_fold_summary(spark, d):
    """MT10: AUC of the mean ROC, mean and std of the folds' AUCs, best Youden point."""
    return metrics.fold_auc_summary(_p(spark, d), "event", "p1", "fold", "roc")


@query("pr_fold_summary")
def q_pr_fold_summary(spark, d):
    """MT11: AUC of the mean precision-recall curve, mean and std of the folds' AUCs, best F1 point."""
    return metrics.fold_auc_summary(_p(spark, d), "event", "p1", "fold", "pr")


@query("regression_errors")
def q_regression_errors(spark, d):
    """MT8: MSE, MAE, MAPE(+1) of 800 * r1 against time, overall and per group."""
    p = _p(spark, d).withColumn("yhat", F.col("r1") * F.lit(800.0))
    return metrics.regression_score(p, "grp", "time", "yhat")


@query("score_table")
def q_score_table(spark, d):
    """MT12/MT13/ST1: classification scores of p1 per validation fold plus OOF."""
    return metrics.score_table(_p(spark, d), "classification", pred="p1")


@query("score_table_ranking")
def q_score_table_ranking(spark, d):
    """MT12/MT13: concordance family per fold and OOF for the ranking blend."""
    p = combine.blend(_ranking_inputs(_p(spark, d)), combine.RANKING_BLEND)
    return metrics.score_table(p, "ranking", pred="prediction")


@query("score_summary")
def q_score_summary(spark, d):
    """AG12: fold mean and sample std of each classification metric."""
    return metrics.score_summary(metrics.score_table(_p(spark, d), "classification", pred="p1"))


@query("oof_vs_folds")
def q_oof_vs_folds(spark, d):
    """MT15: fold mean/std next to the OOF value per regression metric."""
    p = _p(spark, d).withColumn("yhat", F.col("r1") * F.lit(800.0))
    return metrics.oof_vs_folds(metrics.score_table(p, "regression", pred="yhat", target="time"))


@query("correlations")
def q_correlations(spark, d):
    """AG7: Pearson correlations of the six classifier columns."""
    return metrics.correlations(_p(spark, d), [f"p{i}" for i in range(1, 7)])


@query("target_histogram")
def q_target_histogram(spark, d):
    """AG8/MT14: 32-bin histogram of time per event class."""
    return metrics.histogram(_s(spark, d), "time", "event", 32)


def _trials(p: DataFrame) -> DataFrame:
    """A study table derived from P: one trial per (fold, group)."""
    t = p.groupBy("fold", "grp").agg(F.round(F.avg("p1"), 2).alias("value"), F.count(F.lit(1)).alias("params_n"),
                                    F.round(F.avg("r2"), 4).alias("params_lr"))
    number = (F.col("fold") * 1000 + F.ascii(F.col("grp"))).cast("long")
    value = F.when((F.col("fold") == 3) & (F.col("grp") == "MACHINERY"), None).otherwise(F.col("value"))
    return t.select(number.alias("number"), value.alias("value"), "params_n", "params_lr")


@query("study_table")
def q_study_table(spark, d):
    """WN5/SO1/ML14: complete trials, one per distinct value, by value descending."""
    return metrics.study_table(_trials(_p(spark, d)))


@query("best_trial")
def q_best_trial(spark, d):
    """SO2: the best complete trial."""
    return metrics.best_trial(_trials(_p(spark, d)))


@query("importance_summary")
def q_importance_summary(spark, d):
    """ML11: per-fold |corr(feature, event)| as importance, mean and std over folds."""
    p = _p(spark, d)
    feats = [f"p{i}" for i in range(1, 7)] + ["r1", "r2"]
    per = p.groupBy("fold").agg(*[F.abs(F.corr(c, "event")).alias(c) for c in feats])
    long = per.select("fold", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance"))
                                                  for c in feats])).alias("u")).select("fold", "u.*")
    return metrics.importance_summary(long)


# --------------------------------------------------------------------------- fitted models (rows-only checks)

def _model_frame(spark, d) -> DataFrame:
    """S features (median-filled, ordinal-coded) with the folds of P."""
    s = _s(spark, d)
    s = encode.MedianImputer(["x_num", "x_code"]).fit(s).transform(s)
    s = encode.Ordinal(["x_cat"]).fit(s).transform(s)
    f = _p(spark, d).select("id", "fold", "p1")
    return (s.join(f, "id").withColumn("log_time", sc.ln(F.col("time")))
            .withColumn("x_cat_encoded", F.col("x_cat_encoded").cast("double")))


FEATURES = ["x_num", "x_code", "x_cat_encoded", "pred"]


@query("weibull_fit")
def q_weibull_fit(spark, d):
    """SV10: Weibull maximum likelihood per group (Newton on the profile score)."""
    return parametric.fit_weibull(_s(spark, d), group="grp")


@query("loglogistic_fit")
def q_loglogistic_fit(spark, d):
    """SV11: log-logistic maximum likelihood (damped Newton)."""
    return parametric.fit_loglogistic(_s(spark, d))


@query("weibull_fitted_curve")
def q_weibull_fitted_curve(spark, d):
    """SV10/SV14: fitted Weibull per group evaluated at each row's time."""
    s = _s(spark, d)
    p = parametric.fit_weibull(s, group="grp")
    return parametric.evaluate(s.select("id", "grp", "time"), p, "weibull", group="grp").drop("time")


@query("gbt_classifier_oof")
def q_gbt_classifier_oof(spark, d):
    """ML1/ML9: boosted-tree event classifier, out-of-fold over 7 folds."""
    from ..operators import train
    oof, _ = train.train_oof(_model_frame(spark, d), "gbt", FEATURES, "event", "classification",
                             params={"maxIter": 5, "maxDepth": 3})
    return oof


@query("gbt_regressor_two_stage")
def q_gbt_regressor_two_stage(spark, d):
    """ML2/PP1/PP5: boosted-tree regressor on log time of event rows, combined two-stage with the
    event probability and rank-transformed per fold."""
    from ..operators import train
    oof, _ = train.train_oof(_model_frame(spark, d), "gbt", FEATURES, "log_time", "regression",
                             params={"maxIter": 5, "maxDepth": 3}, two_stage_target="log_time", prob="p1", rank=True)
    return oof


@query("logistic_oof")
def q_logistic_oof(spark, d):
    """ML4/ML10: weighted logistic regression, two seeds averaged."""
    from ..operators import train
    m = targets.sample_weight(_model_frame(spark, d), "event", 1.5)
    oof, _ = train.train_oof(m, "logistic", FEATURES, "event", "classification", seeds=(1, 2),
                             params={"maxIter": 50}, weight="weight")
    return oof


@query("forest_oof")
def q_forest_oof(spark, d):
    """ML3: random-forest classifier out of fold."""
    from ..operators import train
    oof, _ = train.train_oof(_model_frame(spark, d), "random_forest", FEATURES, "event", "classification",
                             params={"numTrees": 20, "maxDepth": 4})
    return oof


@query("svc_oof")
def q_svc_oof(spark, d):
    """ML5: linear SVM margins out of fold."""
    from ..operators import train
    oof, _ = train.train_oof(_model_frame(spark, d), "linear_svc", FEATURES, "event", "classification",
                             params={"maxIter": 5, "regParam": 0.01})
    return oof


@query("mlp_oof")
def q_mlp_oof(spark, d):
    """ML7: multilayer perceptron (4-8-2) out of fold."""
    from ..operators import train
    oof, _ = train.train_oof(_model_frame(spark, d), "mlp", FEATURES, "event", "classification",
                             params={"layers": [4, 8, 2], "maxIter": 30})
    return oof


@query("gaussian_mixture")
def q_gaussian_mixture(spark, d):
    """ML8: posterior of mixture component 0 on all rows."""
    from ..operators import train
    return train.mixture_score(_model_frame(spark, d), FEATURES)


@query("fold_models_predict")
def q_fold_models_predict(spark, d):
    """ML12/IO6: fold models saved, reloaded, applied to every row, ranks averaged."""
    from ..operators import train
    m = written(_model_frame(spark, d), "model_frame")  # read by fit and prediction
    _, models = train.train_oof(m, "logistic", FEATURES, "event", "classification", params={"maxIter": 20})
    path = scratch_path(spark, "models")
    train.save_models(models, path)
    back = train.load_models(spark, path, list(models))
    return train.predict_folds(back, m, FEATURES, "classification")


@query("gbt_importance")
def q_gbt_importance(spark, d):
    """ML11: feature importances of the fold models, mean and std over folds."""
    from ..operators import train
    _, models = train.train_oof(_model_frame(spark, d), "gbt", FEATURES, "event", "classification",
                                params={"maxIter": 5, "maxDepth": 3})
    rows = train.importances(models, FEATURES)
    long = spark.createDataFrame(rows, "feature string, fold string, importance double")
    return metrics.importance_summary(long)


@query("search_oof")
def q_search_oof(spark, d):
    """ML13: small grid search of tree depth by OOF ROC AUC."""
    from ..operators import train
    m = _model_frame(spark, d)
    truth = written(m.select("id", "event"), "truth")  # read by every trial

    def auc(oof):
        t = metrics.auc_table(oof.join(truth, "id"), "event", "prediction", [])
        return t.first()["roc_auc"]

    space = [{"maxDepth": 2, "numTrees": 10}, {"maxDepth": 4, "numTrees": 10}]
    return metrics.study_table(train.search(m, "random_forest", space, FEATURES, "event", "classification", auc))


@query("aft_fit")
def q_aft_fit(spark, d):
    """SV16: Weibull accelerated-failure-time regression (Spark ML), predicted time per row."""
    from ..operators import train
    m = train.assemble(_model_frame(spark, d).withColumn("censor", F.col("event").cast("double")), FEATURES)
    model = train.make_learner("aft", "regression", {"labelCol": "time", "censorCol": "censor", "maxIter": 50}).fit(m)
    return model.transform(m).select("id", "prediction")


@query("cox_fit")
def q_cox_fit(spark, d):
    """SV16/SV17: Cox model (ridge 0.01, Breslow ties): risk, H and S at each row's own time."""
    from ..operators import cox
    m = _model_frame(spark, d)
    model = cox.fit_cox(m, "time", "event", ["x_num", "x_code", "pred"], l2=0.01)
    return cox.predict_cox(m, model, "time", "event")


# --------------------------------------------------------------------------- nearest neighbours (JN6, ML6)

@query("knn_exact")
def q_knn_exact(spark, d):
    """JN6: leave-one-out exact 5 nearest neighbours of every embedding (Euclidean, float64)."""
    from ..operators import knn
    return knn.knn(frames.frame_e(spark, d), k=5)


@query("knn_classify")
def q_knn_classify(spark, d):
    """ML6: majority label of the 5 nearest neighbours and its share."""
    from ..operators import knn
    e = frames.frame_e(spark, d)
    return knn.knn_classify(knn.knn(e, k=5), e)


@query("knn_oof")
def q_knn_oof(spark, d):
    """JN6/ML6: share of the five nearest embeddings of all other folds whose label is below 5."""
    from ..operators import knn
    e = frames.frame_e(spark, d).withColumn("fold", (F.col("vec_id") % 7 + 1).cast("int")).withColumn("target", (F.col("label") < 5).cast("int"))
    return knn.knn_oof(e, "target")


@query("second_blend_oof")
def q_second_blend_oof(spark, d):
    """PP7: second classifier blend, out-of-fold logistic regression and out-of-fold k-NN (15 neighbours) on
    standardised features."""
    from ..operators import knn, train
    m = _model_frame(spark, d)
    cols = ["x_num", "x_code", "pred"]
    m = written(encode.Standardise(cols).fit(m).transform(m), "model_frame")  # read by both learners
    features = [f"{c}_normalized" for c in cols]
    logistic, _ = train.train_oof(m, "logistic", features, "event", "classification", params={"maxIter": 50})
    near = knn.knn_oof(m.select("id", "fold", "event", F.array(*features).alias("vec")), "event", key="id", vec="vec", k=15)
    both = logistic.select("id", "fold", F.col("prediction").alias("p1")).join(near.select("id", F.col("prediction").alias("p2")), "id")
    return combine.blend(both, combine.CLASSIFIER_BLEND_2)


@query("lognormal_fit")
def q_lognormal_fit(spark, d):
    """SV12: log-normal maximum likelihood per group (damped Newton, normal tail via erfc)."""
    return parametric.fit_lognormal(_s(spark, d), group="grp")


@query("lognormal_curve")
def q_lognormal_curve(spark, d):
    """SV12/SV14: log-normal S, H, h at row times for given parameters (mu=7.8, sigma=1.2)."""
    s = _s(spark, d)
    p = parametric.params_frame(spark, "lognormal", {"mu_": 7.8, "sigma_": 1.2})
    return parametric.evaluate(s.select("id", "time"), p, "lognormal").drop("time")


@query("pr_mean_summary")
def q_pr_mean_summary(spark, d):
    """MT11: area under the mean precision-recall curve and the best-F1 point."""
    return metrics.grid_summary(metrics.mean_pr(_p(spark, d), "event", "p1", "fold"), "recall", "precision_mean", "pr")


@query("gamma_fit")
def q_gamma_fit(spark, d):
    """SV13: generalised gamma maximum likelihood (stencil Newton, incomplete gamma in NumPy)."""
    from ..operators import gengamma
    return gengamma.fit_generalized_gamma(_s(spark, d))


@query("gamma_curve")
def q_gamma_curve(spark, d):
    """SV13/SV14: fitted generalised gamma S, H, h at each row's time."""
    from ..operators import gengamma
    s = _s(spark, d)
    p = gengamma.fit_generalized_gamma(s).first().asDict()
    return gengamma.evaluate_generalized_gamma(s.select("id", "time"), p).drop("time")


@query("load_oof")
def q_load_oof(spark, d):
    """IO5: each model's OOF file (``id, prediction``) written as Parquet, read back and pivoted to
    ``{model}_prediction`` columns keyed by id."""
    p = _p(spark, d)
    base = scratch_path(spark, "oof")
    paths = {}
    for m, c in (("m1", "p1"), ("m2", "p2"), ("m3", "p3")):
        paths[m] = f"{base}/{m}"
        io.write_table(p.select("id", F.col(c).alias("prediction")), paths[m])
    return io.load_oof(spark, paths)


# --------------------------------------------------------------------------- survival regression out of fold

COX_FEATURES = ["x_num", "x_code", "pred"]
#: Given models by fold, for the queries whose SQL needs no fit: (coefficients, centre) and (intercept, coefficients, sigma).
COX_GIVEN = {f: ([0.00001 * f, 0.01 - 0.002 * f, 0.3 + 0.05 * f], [4000.0 + 10 * f, 12.0, 0.3]) for f in range(1, 8)}
AFT_GIVEN = {f: (6.5 + 0.1 * f, [0.00002 * f, 0.01, -0.2], 0.8 + 0.05 * f) for f in range(1, 8)}


@query("cox_oof")
def q_cox_oof(spark, d):
    """SV16: Cox with Efron ties for each fold on the others; risk, H and S of unseen rows at their own time."""
    from ..operators import survreg
    m = written(_model_frame(spark, d), "model_frame")  # read by fit, baseline and prediction
    fit = survreg.fit_cox_folds(m, "time", "event", COX_FEATURES)
    return survreg.predict_cox_folds(m, fit, survreg.cox_baseline(m, fit, "time", "event"), "time")


@query("cox_coefficients")
def q_cox_coefficients(spark, d):
    """SV16: coefficients of each fold's Cox model with mean and std over folds."""
    from ..operators import survreg
    return survreg.coefficient_table(spark, survreg.fit_cox_folds(_model_frame(spark, d), "time", "event", COX_FEATURES))


@query("cox_given_oof")
def q_cox_given_oof(spark, d):
    """SV16: baseline hazard of each fold's training rows and predictions of unseen rows, for given coefficients."""
    from ..operators import survreg
    m = _model_frame(spark, d)
    given = survreg.cox_models({f: c for f, (c, _) in COX_GIVEN.items()}, {f: c for f, (_, c) in COX_GIVEN.items()}, COX_FEATURES)
    return survreg.predict_cox_folds(m, given, survreg.cox_baseline(m, given, "time", "event"), "time")


@query("cox_efron_sums")
def q_cox_efron_sums(spark, d):
    """SV16: log partial likelihood with Efron ties, its gradient and the diagonal of its negative Hessian for
    each fold's training rows at given coefficients, per event."""
    import numpy as np

    from ..operators import survreg
    m = _model_frame(spark, d)
    frame = survreg.Frame(m, "time", "event", COX_FEATURES, "fold")
    sums = survreg.cox_sums(frame, {i: np.array(COX_GIVEN[f][0]) for i, f in enumerate(frame.names)}, "efron",
                            scan.quantile_bounds(frame.table.select("t").distinct(), "t"))
    rows = [(int(frame.names[i]), *(float(v) / frame.events[i] for v in (s[0], *s[1], *s[2].diagonal()))) for i, s in sums.items()]
    return spark.createDataFrame(rows, "fold int, loglik double, " + ", ".join(f"{k}_{f} double" for k in ("g", "h") for f in COX_FEATURES))


@query("coxnet_path")
def q_coxnet_path(spark, d):
    """SV17: elastic-net Cox coefficients of each fold along eight alphas."""
    from ..operators import survreg
    return survreg.coxnet_path(written(_model_frame(spark, d), "model_frame"), "time", "event", COX_FEATURES, n_alphas=8, alpha_min_ratio=0.01)[0]


def _aft(family: str):
    def run(spark, d):
        from ..operators import survreg
        m = written(_model_frame(spark, d), "model_frame")  # read by fit and prediction
        return survreg.predict_aft_folds(m, survreg.fit_aft_folds(m, family, "time", "event", COX_FEATURES), "time")

    run.__doc__ = f"SV16: {family} accelerated failure time, out of fold: risk, H, S at own time, median."
    return run


for _family in ("weibull", "loglogistic", "lognormal"):
    query(f"aft_{_family}_oof")(_aft(_family))


@query("aft_given_oof")
def q_aft_given_oof(spark, d):
    """SV16: the three AFT families for given parameters by fold, at each row's own time."""
    from ..operators import survreg
    m = _model_frame(spark, d)
    parts = [survreg.predict_aft_folds(m, survreg.aft_models(f, AFT_GIVEN, COX_FEATURES), "time").withColumn("family", F.lit(f))
             for f in ("weibull", "loglogistic", "lognormal")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _linear(l2: float):
    def run(spark, d):
        from ..operators import linear
        m = _model_frame(spark, d)
        return linear.predict_folds_linear(m, linear.fit_linear_folds(m, COX_FEATURES, "log_time", l2=l2))

    run.__doc__ = "ML4/ML9: out-of-fold " + ("ridge regression" if l2 else "least squares") + " of log time, all folds from one set of moments."
    return run


query("linear_oof")(_linear(0.0))
query("ridge_oof")(_linear(1000.0))


@query("logistic_newton_oof")
def q_logistic_newton_oof(spark, d):
    """ML4/ML9: out-of-fold logistic regression of the event by Newton steps, all folds a job."""
    from ..operators import linear
    m = targets.sample_weight(_model_frame(spark, d), "event", 1.5)
    return linear.predict_folds_linear(m, linear.fit_logistic_folds(m, COX_FEATURES, "event", weight="weight"))


@query("mlp_sparse_oof")
def q_mlp_sparse_oof(spark, d):
    """ML7/EN1: multilayer perceptron on the sparse one-hot of all category columns and standardised numbers, out of fold."""
    from ..operators import train
    m = _model_frame(spark, d)
    m = encode.Standardise(["x_num", "pred"]).fit(m).transform(m).withColumn("code", F.col("x_code").cast("int").cast("string"))
    enc = encode.OneHot(["grp", "x_cat", "code"], min_count=128).fit(m)
    m = enc.sparse(m, ["x_num_normalized", "pred_normalized"], out="inputs")
    width = len(enc.output_columns()) + 2
    oof, _ = train.train_oof(m, "mlp", ["inputs"], "event", "classification", params={"layers": [width, 8, 2], "maxIter": 100})
    return oof


@query("search_halving")
def q_search_halving(spark, d):
    """ML13: successive halving of six forests drawn from a space, by trees, on out-of-fold ROC AUC."""
    from ..operators import train
    m = written(_model_frame(spark, d), "model_frame")  # read by every fit
    # predictions carry their own row's event; only ids that come more than once meet the events of other rows
    truth = written(m.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.sum("event").alias("events")).where("rows > 1"), "truth")

    def auc(oof):
        met = oof.join(truth, "id", "left").where("id is not null").groupBy("prediction").agg(
            F.sum(F.coalesce("rows", F.lit(1))).alias("rows"), F.sum(F.coalesce("events", "event")).alias("event"))
        # scored once: the scan below reads its input more than once
        return metrics.auc_table(written(met, "scores"), "event", "prediction", [], rows="rows").first()["roc_auc"]

    space = {"maxDepth": ("int", 2, 6), "minInstancesPerNode": ("int", 1, 101, 10), "subsamplingRate": ("float", 0.4, 1.0, 0.1),
             "featureSubsetStrategy": ("categorical", ["sqrt", "all", "0.75"])}
    return train.halving_search(m, "random_forest", space, FEATURES, "event", "classification", auc, "numTrees", (4, 16), n_trials=6, seed=7,
                                carry=["event"])
