"""Broadcast hints follow the counted size; results do not."""

from popweave.functions.sizes import fits, small
from popweave.operators import variants


def test_hint_follows_size(spark):
    df = spark.range(5).toDF("sample_idx")
    assert fits(df, 5) and not fits(df, 4)
    assert "hint" in small(df, 5)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in small(df, 4)._jdf.queryExecution().logical().toString().lower()


def test_same_counts_without_a_broadcast(spark, monkeypatch):
    g = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 1), (2, 0, None, None)], "site_id long, sample_idx int, a1 int, a2 int")
    pops = spark.createDataFrame([("m", 0), ("m", 1), ("f", 1)], "pop string, sample_idx int")
    want = sorted(map(tuple, variants.allele_counts(g, pops).collect()))
    monkeypatch.setattr(variants, "small", lambda df: df)
    assert sorted(map(tuple, variants.allele_counts(g, pops).collect())) == want == [(1, "f", 0, 2, 2), (1, "m", 1, 3, 4)]
