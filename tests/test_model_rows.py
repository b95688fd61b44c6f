import random

import pytest

from riskspark import logistic


def test_rows_of_models_are_plain_and_lie_by_area(spark, monkeypatch):
    """Cells are laid out in plain columns, an area's in few tasks unless it is hot; the fit is that of one task."""
    rng = random.Random(5)
    rows = [(m, i % 2, int(rng.random() < 0.3 + 0.2 * (i % 2)), 7.0 if m == "flat" else rng.choice([1e4, 5e4, None]), rng.choice([1e5, 3e5]), "hot" if rng.random() < 0.5 else f"a{rng.randrange(20)}", *(rng.choice("uv") for _ in logistic.CATEGORICAL))
            for m in ("flat", "full") for i in range(1500)]
    kinds = ", ".join(["configuration string, is_black int, is_denied int", *(f"{c} double" for c in logistic.CONTINUOUS), f"{logistic.AREA} string", *(f"{c} string" for c in logistic.CATEGORICAL)])
    df = spark.createDataFrame(rows, kinds)
    one = sorted(logistic.adjusted_disparity(df).collect())
    kept = {}
    monkeypatch.setattr(logistic, "discard", lambda df: None)
    monkeypatch.setattr(logistic, "written", lambda df, name, real=logistic.written: kept.setdefault(name, real(df, name)))
    monkeypatch.setattr(logistic, "FIT_CELLS", 200)
    many = sorted(logistic.adjusted_disparity(df).collect())
    assert [r.status for r in many] == ["estimated"] * 2
    for a, b in zip(one, many, strict=True):
        assert b.asDict() == {k: pytest.approx(v, rel=1e-7) if isinstance(v, float) else v for k, v in a.asDict().items()}
    ready = kept["model-rows"]
    assert not [t for _, t in ready.dtypes if t.startswith("array")]
    files = ready.selectExpr("by", "area", "_metadata.file_path as file").where("area is not null").distinct().groupBy("by", "area").count().collect()
    assert sum(r["count"] == 1 for r in files) > len(files) / 2 and len({r["count"] for r in files}) > 1
