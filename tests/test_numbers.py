"""Percentiles of many columns, medians along rows, places in an order."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weft.operators import matrix, percentiles, relational
from weft.plans import omics


def jobs(spark, work):
    """What `work` returns, and how many jobs it ran."""
    tag = "weft-test-jobs"
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    spark.sparkContext.setJobGroup(tag, tag)
    out = work()
    spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)) - before


def test_ordered_bits():
    x = np.array([-np.inf, -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e200, np.inf])
    bits = percentiles.ordered_bits(x)
    assert (np.diff(bits.astype(object)) > 0).all() and [percentiles.from_bits(int(b)) for b in bits] == x.tolist()
    assert percentiles.ordered_bits(np.array([-0.0]))[0] == percentiles.ordered_bits(np.array([0.0]))[0]


def test_percentiles_of_many_columns(spark):
    rng = np.random.default_rng(8)
    n = 501
    data = {f"t{i}": np.round(rng.standard_normal(n) * 10.0 ** rng.integers(-5, 6), 12) for i in range(50)}
    data |= {"zeros": np.zeros(n), "same": np.full(n, -7.25), "tail": np.concatenate([np.zeros(n - 3), [1e9, 2e9, 1e300]]), "ties": rng.integers(0, 3, n).astype(float)}
    frame = pd.DataFrame(data)
    frame.loc[::3, "t1"], frame.loc[:, "none"] = np.nan, np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame.columns)).repartition(4)
    _, of_one = jobs(spark, lambda: percentiles.percentiles(df, ["t0"], 0.5))
    for share in (0.0, 0.5, 0.99, 1.0):
        got, n_jobs = jobs(spark, lambda share=share: percentiles.percentiles(df, list(frame.columns), share))
        assert n_jobs <= of_one + 1  # an adaptive plan submits a shuffle's stages as jobs of their own; columns add none
        for c in frame.columns:
            own = frame[c].dropna().to_numpy()
            assert got[c] is None if not len(own) else np.isclose(got[c], np.quantile(own, share), rtol=1e-12, atol=0), (c, share)
    with_zeros = percentiles.percentiles(df, ["t1", "none"], 0.99, missing=0.0)
    assert np.isclose(with_zeros["t1"], np.quantile(frame["t1"].fillna(0), 0.99), rtol=1e-12) and with_zeros["none"] == 0
    assert percentiles.percentiles(df.limit(0), ["t1"], 0.5) == {"t1": None}


def test_weights_of_missing_values_and_zero_percentiles(spark):
    rows = [("G1.1", 0, 0.0, 2.0), ("G2.1", 1, 0.0, None), ("G3.1", 2, 0.0, -1.0), ("G4.1", 3, None, float("nan")), ("G1.9", 4, 5.0, 9.0)]
    got = {r.ensembl_id: (r.tw_a, r.tw_b) for r in omics.tissue_weights(spark.createDataFrame(rows, "Name string, idx long, a double, b double"), ["a", "b"]).collect()}
    bound = np.quantile([2.0, 0.0, -1.0, 0.0], 0.99)
    assert got == {"G1": (0.0, 1.0), "G2": (0.0, 0.0), "G3": (0.0, 0.0), "G4": (0.0, 0.0)} and bound < 2
    one = relational.clipped_by_percentile(spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double"), "v", 1.0, "w")
    assert sorted((r.v or 0, r.w) for r in one.collect()) == [(0, 0.0), (1.0, 0.25), (4.0, 1.0)]


def test_places_in_an_order(spark):
    rows = [(i % 17, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = relational.numbered(df, [F.col("a").desc(), F.col("b")], "place").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.place for r in got) == list(range(1, 5001))
    assert relational.numbered(df.limit(0), [F.col("a")], "place").count() == 0


def test_medians_in_place_agree_with_the_long_form(spark):
    rng = np.random.default_rng(2)
    samples = [(f"S-{k}-{t:02d}", f" Disease {k % 3}", t) for k in range(60) for t in ((1 + k % 9, 11) if k % 2 else (2,))]
    names = [s for s, *_ in samples]
    x = np.round(rng.standard_normal((40, len(names))) + np.array([t < 10 for *_, t in samples]) * 3, 3).astype(object)
    x[rng.random(x.shape) < 0.1] = None
    wide = spark.createDataFrame([(f"G{i}.2", *row) for i, row in enumerate(x.tolist())], ", ".join(["gene string", *[f"`{n}` double" for n in names]])).repartition(3)
    info = spark.createDataFrame([*samples, ("elsewhere", "disease 0", 1)], "sample string, disease string, sample_type_id int")
    cross = spark.createDataFrame([("disease 0", "D0", "EFO:0"), ("disease 1", "D1", "EFO:1"), ("nobody", "D9", "EFO:9")], "primary_disease string, tcga_code string, ontology_id string")
    long = wide.unpivot(["gene"], names, "sample", "value")
    expected, got = omics.differential_expression(long, info, cross), omics.differential_expression_wide(wide, info, cross)
    assert got.columns == expected.columns and "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and expected.count() > 0
    direct = matrix.median_differences(wide, "gene", {"g": (names[:5], names[5:9])}, 4, 0.0)
    for r in direct.collect():
        own = [[v for v in x[int(r.gene[1:-2])][a:b] if v is not None] for a, b in ((0, 5), (5, 9))]
        assert np.isclose(r["diff"], np.median(own[0]) - np.median(own[1])) and (r.n_case, r.n_control) == (5, 4)
    text = spark.createDataFrame([("a", "1", "x", None), ("b", "3", "4", "2")], "k string, p string, q string, r string")
    assert [(r.k, r["diff"]) for r in matrix.median_differences(text, "k", {"g": (["p", "q"], ["r"])}, 1, 0).collect()] == [("b", 1.5)]
