"""Word odds, trees and thresholds of the PII operator come from every labelled row."""

from pyspark.sql import functions as F

from riskspark.llm import pii


def test_every_labelled_row_counts(spark, monkeypatch):
    n = 2_600  # more spans of a kind than any bound that was there
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("so write user.%d@mail%d.example.com about order %d", "id", F.col("id") % 7, 10**9 + F.col("id")).alias("text"))
    seen, bins = {}, []
    odds, fit = pii.word_odds, pii.GBTClassifier

    def counted(rows):
        count = F.sum("n") if "n" in rows.columns else F.count("*")
        seen.update({(r["kind"], r["label"]): r["c"] for r in rows.groupBy("kind", "label").agg(count.alias("c")).collect()})
        return odds(rows)

    def fitted(**how):
        bins.append(how.get("maxBins", 32))
        return fit(**how)

    monkeypatch.setattr(pii, "word_odds", counted)
    monkeypatch.setattr(pii, "GBTClassifier", fitted)
    found = pii.find(df)
    assert found.count() == n
    # each address as it stands and in six forms, three quarters of them not held out
    assert 0.7 * 7 * n < seen["email", 1.0] < 0.8 * 7 * n
    rows = found.sparkSession.createDataFrame([("email", 1.0, 6_000), ("email", 1.0, 2_000), ("email", 0.0, 500)], "kind string, label double, n long")
    assert sorted((r.label, r.w) for r in pii.weighed(rows).collect()) == [(0.0, 500.0), (1.0, 500.0), (1.0, 1500.0)]
    assert bins and bins[0] >= 32
