"""Fixed decimals round half to even on the exact binary value."""

import math
import random

import pytest

from corpusqa.functions import text as tx


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_fixed_equals_exact_rounding(spark, digits):
    rng = random.Random(4)
    values = [0.125, 0.625, 0.0625, 1.25, 0.145, 0.155, 2.675, 1.005, -0.125, -0.0, 0.0, -0.0001, 2.5, 1e12 + 0.0005, math.nan, math.inf, -math.inf, None]
    values += [rng.randint(0, 4096) / rng.choice([8, 16, 32, 64]) for _ in range(800)]
    values += [rng.randint(0, 10**5) / 1000 + rng.choice([0, 0.0005, 0.005, 0.05]) for _ in range(800)]
    values += [math.nextafter(rng.randint(0, 9999) / 16, rng.choice([0, 1e9])) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    got = [r[0] for r in df.select(tx.fixed("x", digits)).collect()]
    assert got == [None if v is None else f"{v:.{digits}f}" for v in values]
