import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vector as V


def one(spark, **cols):
    kinds = ", ".join(f"{k} array<float>" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], kinds)


def test_normalize(spark):
    df = one(spark, a=[3.0, 4.0], zero=[0.0, 0.0], none=None)
    r = df.select(V.normalize("a").alias("a"), V.normalize("zero").alias("zero"), V.normalize("none").alias("none")).first()
    assert r.a == pytest.approx([0.6, 0.8]) and r.zero == [0.0, 0.0] and r.none is None


def test_normalize_evaluates_the_norm_once(spark):
    plan = one(spark, a=[1.0]).select(V.normalize("a").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 1 and plan.count("aggregate(") == 1


def test_quantize_rounds_halves_away_and_clamps(spark):
    values = [0.5 / 127, -0.5 / 127, 1.5, -1.5, 1.0, -1.0, 0.0]
    r = one(spark, a=values).select(V.quantize(F.col("a").cast("array<double>"), "int8").alias("q")).first()
    assert r.q[2:] == [127, -127, 127, -127, 0]
    exact = spark.createDataFrame([([2.5 / 127, -2.5 / 127],)], "a array<double>").select(V.quantize("a", "int8").alias("q")).first()
    assert exact.q == [3, -3]


@pytest.mark.parametrize("mode,off", [("int8", 0.02), ("int16", 0.01)])
def test_quantized_dot_is_close(spark, mode, off):
    rng = np.random.default_rng(123)
    m = rng.standard_normal((100, 2, 128)).astype(np.float32)
    m /= np.linalg.norm(m, axis=2, keepdims=True)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in m], "a array<float>, b array<float>")
    rows = df.select(V.dot("a", "b").alias("x"), V.dot_codes("a", V.quantize("b", mode), mode).alias("y")).collect()
    assert max(abs(r.x - r.y) for r in rows) < off
    assert [r.x for r in rows] == pytest.approx((m[:, 0].astype(float) * m[:, 1]).sum(axis=1).tolist(), abs=1e-9)


def test_dequantize(spark):
    r = one(spark, a=[1.0, -0.5]).select(V.dequantize(V.quantize("a", "int16"), "int16").alias("d")).first()
    assert r.d == pytest.approx([1.0, -0.5], abs=1e-4)


def test_distances(spark):
    df = one(spark, a=[1.0, 0.0], b=[0.0, 2.0], zero=[0.0, 0.0])
    r = df.select(V.cosine("a", "b").alias("c"), V.cosine("a", "zero").alias("nan"), V.cosine_or_zero("a", "zero").alias("z"), V.euclidean_distance("a", "b").alias("e"), V.distance("cosine", "a", "a").alias("d"), V.magnitude("b").alias("m")).first()
    assert r.c == 0 and math.isnan(r.nan) and r.z == 0 and r.e == pytest.approx(math.sqrt(5)) and r.d == 0 and r.m == 2
    with pytest.raises(ValueError):
        V.distance("manhattan", "a", "b")


def test_truncate_is_slice_and_renormalize(spark):
    r = one(spark, a=[3.0, 4.0, 12.0]).select(V.truncate("a", 2).alias("t"), V.truncate("a", 2, False).alias("raw")).first()
    assert r.t == pytest.approx([0.6, 0.8]) and r.raw == [3.0, 4.0]


def test_side(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 5.0], 2.0)], "n array<float>, v array<float>, t double")
    r = df.select(V.side("n", "v", F.col("t")).alias("s")).first()
    assert r.s.margin == 0 and r.s.left


def test_names():
    assert [V.parse_quantization(x) for x in ("q8", "Q16", "f32", "float32")] == ["int8", "int16", "fp32", "fp32"]
    with pytest.raises(ValueError):
        V.parse_quantization("int4")


def test_formats(spark):
    from lodestone.functions import formats

    assert [formats.quantization_label(x) for x in ("Q8", "f32", "q4")] == ["int8", "fp32", "unknown"] and [formats.quantization_bits(x) for x in ("q16", "x")] == [16, 0]
    assert formats.progress_line("trees", 3, 20) == "[trees] 3/20 (15.0%)" and formats.progress_line("x", 0, 0) == ""
    cases = {12: "12ns", 999: "999ns", 1000: "1.0µs", 2_340_000: "2.3ms", 1150: "1.1µs", 1250: "1.2µs", None: None, 1_500_000_000: "1.50s"}
    rows = spark.createDataFrame([(n,) for n in cases], "n bigint").select("n", formats.duration(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == cases
