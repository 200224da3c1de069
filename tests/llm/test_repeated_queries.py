"""Exact top-k where ids and rows repeat, in blocks of any size."""

import math
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from glyphmill.llm import bit_sliced  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.mark.parametrize("block_rows,block_queries,parts", [(65536, 64, 1), (16, 3, 3), (5, 1, 4)])
def test_every_query_row_has_its_own_ranks(spark, block_rows, block_queries, parts):
    rng = random.Random(5)
    rows = [(k, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for k in range(80)]
    rows += [(20, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, -1.0, 0.0, 0.0]), (20, [0.0, -1.0, 0.0, 0.0]), (40, rows[40][1]), (7, rows[9][1])] + [(200, [0.5] * 4)] * 30
    rows += [(220, None), (None, [1.0] * 4), (240, [float("nan")] * 4), (260, [1.0]), (280, [2.0]), (300, []), (320, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and not any(math.isnan(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, u)), j) for b, (j, u) in enumerate(good) if a != b and len(u) == len(v))
            want += [(i, k, j, -s) for k, (s, j) in enumerate(scored[:6], 1)]
    got = bit_sliced.top_k(df, F.col("id") % 20 == 0, k=6, block_rows=block_rows, block_queries=block_queries).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
