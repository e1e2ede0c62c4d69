import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
CHECK = ["km_censored", "na_smooth", "cindex_stratified", "rank_transform", "threshold_scaling", "stratified_folds", "fold_frames", "exact_lookup",
         "survival_targets", "curve_table", "roc_fold_summary", "pr_fold_summary", "cox_given_oof", "cox_efron_sums", "aft_given_oof", "weibull_fit",
         "loglogistic_fit", "lognormal_fit", "linear_oof", "ridge_oof", "knn_oof"]


def _norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"metric", "value"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_selected_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in ("orders", "customer", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in CHECK:
        sdf = E.queries()[name](spark, SF)
        cols = sorted(sdf.columns)
        a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
        rel = con.sql(E.oracle_sql()[name])
        idx = [rel.columns.index(c) for c in cols]
        b = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
        assert a == b, name
