import math
import random

import pytest
from pyspark.sql import functions as F

from evalloom.functions import stats as S


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pre double, post double")


def test_theoretical_effects(spark):
    n, v, rho = F.lit(600), F.lit(0.025), F.lit(0.9)
    r = spark.range(1).select(S.paired_mde(n, v, rho).alias("p"), S.adjusted_mde(n, v, rho).alias("a")).first()
    assert r.p == pytest.approx(0.008089, abs=1e-5) and r.a == pytest.approx(0.007884, abs=1e-5)
    assert r.a / r.p == pytest.approx(math.sqrt((1 + 0.9) / 2), abs=1e-6)


def test_paired_delta_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [(x := rnd.random(), x + rnd.gauss(0.1, 0.2)) for _ in range(200)]
    r = S.paired_delta(pairs(spark, [*rows, (None, 1.0)])).first()
    d = [b - a for a, b in rows]
    m = sum(d) / 200
    se = math.sqrt(sum((x - m) ** 2 for x in d) / 199 / 200)
    assert (r.n, r.delta, r.delta_se) == (200, pytest.approx(m), pytest.approx(se)) and r.mde_80 == pytest.approx(S.Z_ALPHA_BETA * se)


def test_constant_and_tiny_groups(spark):
    assert S.paired_delta(pairs(spark, [(1.0, 2.0)])).count() == 0
    r = S.paired_delta(pairs(spark, [(1.0, 2.0), (1.0, 2.0)])).first()
    assert (r.delta, r.delta_se, r.rho, r.z) == (1.0, 0.0, 0.0, 0.0)
    assert S.adjusted_delta(pairs(spark, [(1.0, 2.0), (1.0, 3.0)])).count() == 0
    assert S.paired_delta(pairs(spark, [])).count() == 0


def test_normal_tail_and_decisions(spark):
    r = spark.range(1).select(S.upper_tail(F.lit(1.96)).alias("p"), S.upper_tail(F.lit(-1.0)).alias("q"), S.sequential_decision(F.lit(3), F.lit(2.1), 3).alias("d"), S.sequential_decision(F.lit(1), F.lit(2.1), 3).alias("e")).first()
    assert r.p == pytest.approx(0.5 * math.erfc(1.96 / math.sqrt(2)), rel=1e-6) and r.q == pytest.approx(0.8413447, rel=1e-6)
    assert (r.d, r.e) == ("stop_reject_null", "continue")
    with pytest.raises(NotImplementedError):
        S.sequential_decision(F.lit(1), F.lit(1.0), 7)
