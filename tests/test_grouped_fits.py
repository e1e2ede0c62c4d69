import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survspark.operators import gengamma, parametric


def _groups(n_groups=6, rows=120, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        t = rng.weibull(1.0 + 0.3 * g, rows) * (5 + 3 * g) + 0.01
        c = rng.exponential(20, rows)
        out.append(pd.DataFrame({"grp": f"g{g}", "time": np.round(np.minimum(t, c), 2) + 0.01, "event": (t <= c).astype(int)}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("family", ["weibull", "loglogistic", "lognormal"])
def test_each_group_equals_its_own_fit_and_solves_its_score_equations(spark, family):
    pdf = pd.concat([_groups(4), pd.DataFrame({"grp": "none", "time": [1.0, 2.0], "event": [0, 0]}), pd.DataFrame({"grp": [None], "time": [1.0], "event": [1]})])
    df = spark.createDataFrame(pdf)
    got = {r.grp: r.asDict() for r in parametric.fit(df, family, group="grp").collect()}
    assert set(got) == {"g0", "g1", "g2", "g3", "none"}
    names = [c for c in got["g0"] if c.endswith("_")]
    assert all(got["none"][c] is None for c in [*names, "converged"])
    for g in ("g0", "g3"):
        own = df.where(F.col("grp") == g)
        alone = parametric.fit(own, family).first()
        assert got[g]["converged"] and all(math.isclose(got[g][c], alone[c], rel_tol=1e-8) for c in names)
        score = parametric.score_equations(own, got[g], family)
        assert all(abs(v) < 1e-5 for v in score.values()), score


def test_weibull_of_100000_groups(spark):
    df = spark.range(600_000).select((F.col("id") % 100_000).alias("grp"), (F.lit(1.0) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("time"),
                                     (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) > 0).cast("int").alias("event"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    fit = parametric.fit_weibull(df, group="grp").persist()
    n = fit.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("converged").cast("int")).alias("c"), F.sum((F.col("rho_") > 0).cast("int")).alias("p")).first()
    assert n.n == 100_000 and n.c >= 0.99 * n.n and n.p >= n.c and spark.conf.get("spark.sql.shuffle.partitions") == before
    fit.unpersist()


def test_generalised_gamma_by_group(spark):
    df = spark.createDataFrame(_groups(3, rows=200, seed=2))
    got = {r.grp: r for r in gengamma.fit_generalized_gamma(df, group="grp").collect()}
    alone = gengamma.fit_generalized_gamma(df.where("grp = 'g1'")).first()
    assert set(got) == {"g0", "g1", "g2"} and all(math.isclose(got["g1"][c], alone[c], rel_tol=1e-3, abs_tol=1e-3) for c in ("mu_", "sigma_", "lambda_"))
    none = gengamma.fit_generalized_gamma(df.withColumn("event", F.lit(0)), group="grp").collect()
    assert len(none) == 3 and all(r.mu_ is None and r.converged is None for r in none)


def test_fits_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "grp string, time double, event int")
    assert parametric.fit_weibull(empty, group="grp").collect() == [] and parametric.fit_lognormal(empty, group="grp").collect() == []
    assert parametric.fit_loglogistic(empty).first().alpha_ is None
