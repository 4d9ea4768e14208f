"""Rows that share words, against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import linking


@pytest.mark.parametrize("more", [{}, {"tried": 1}, {"tried": 4}])
def test_most_shared_words(spark, more):
    rng = random.Random(7)
    pick = lambda n: [f"w{min(int(rng.expovariate(0.15)), 30)}" for _ in range(n)]
    left = [(k, pick(rng.choice([1, 3, 8, 20]))) for k in range(25)] + [(90, []), (91, None), (92, ["nowhere"]), (93, ["w0", None]), (94, ["only"])]
    right = [(k, pick(rng.choice([0, 1, 5, 15]))) for k in range(150)] + [(k, ["w3", "w1", "w2", "w1"]) for k in range(300, 320)] + [(400, None), (401, ["only", "other"])]
    texts = spark.createDataFrame([(k, None if w is None else " ".join(w)) for k, w in right], "id long, text string").repartition(3)
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        read.add(1)
        return None if text is None else text.split()

    got = linking.shared_words(spark.createDataFrame(left, "id long, words array<string>"), texts.select("id", words("text").alias("words")), **more)
    assert dict(got.dtypes)["shared"] == "bigint"
    wanted = []
    for k, a in left:
        known = sorted((-n, j) for j, b in right if (n := len(({*(a or [])} - {None}) & {*(b or [])})))
        wanted += [(k, j, -n, place) for place, (n, j) in enumerate(known[:3], 1)]
    assert sorted(tuple(r[c] for c in ("left_id", "right_id", "shared", "place")) for r in got.collect()) == sorted(wanted)
    # No text is read and cut into words twice.
    assert read.value == len(right)
