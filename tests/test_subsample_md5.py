"""Draws by md5: whole classes count, and records that can't change a draw aren't drawn."""

import hashlib

from pyspark.sql import functions as F

from riskspark import stats


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_large_classes_are_drawn_whole_but_only_where_it_matters(spark, monkeypatch):
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 40, "f": 90}
    df = spark.createDataFrame([(c,) for c, k in sizes.items() for _ in range(k)], "c string")
    for fraction in (0.02, 0.5):
        want = {}
        for c, k in sizes.items():
            name = hashlib.md5(c.encode()).hexdigest()
            for r in range(1, 31):
                if sum(uniform(stats.SEED, r, name, i) < fraction for i in range(1, k + 1)) == 1:
                    draws, also = want.get(r, (0, 0))
                    want[r] = draws + 1, also + (k == 1)
        got = {x.replicate: (x.draw_unique, x.also_unique) for x in stats.subsample_md5(df, ["c"], fraction).collect()}
        assert got == want
    hot = spark.range(200_000).select(F.lit("x").alias("c"))
    drawn = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        drawn.add(1)
        return 0.0

    monkeypatch.setattr(stats, "md5_uniform", lambda *parts: counted(parts[-1]))
    assert stats.subsample_md5(hot, ["c"], 0.5).count() == 0
    assert drawn.value <= 30 * 200  # not 30 * 200,000
