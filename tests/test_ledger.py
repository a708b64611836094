import pytest

from panelforge.sources import ledger


def test_fingerprint_ignores_key_order():
    assert ledger.fingerprint({"a": 1, "b": 2}) == ledger.fingerprint({"b": 2, "a": 1}) != ledger.fingerprint({"a": 1, "b": 3})


def test_aligned_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    ledger.check_aligned(a, a.repartition(3).select("k"), ["k"])
    with pytest.raises(ValueError, match="different"):
        ledger.check_aligned(a, a.withColumn("k", a.k + 1), ["k"])
    with pytest.raises(ValueError, match="repeated"):
        ledger.check_aligned(a.unionAll(a), a, ["k"])


def test_a_stage_is_built_once_and_a_changed_configuration_raises(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert ledger.run_stage(spark, str(tmp_path), "r1", "s", {"n": 5}, build).count() == 5
    assert len(calls) == 1
    with pytest.raises(ValueError, match="other inputs"):
        ledger.run_stage(spark, str(tmp_path), "r1", "s", {"n": 6}, build)
    ledger.run_stage(spark, str(tmp_path), "r2", "s", {"n": 6}, build)
    assert len(calls) == 2


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 0.5), (None, None)], "x string, y double")
    assert ledger.markdown(df) == "| x | y |\n| --- | --- |\n| a\\|b | 0.5 |\n|  |  |"
    with pytest.raises(ValueError, match="at most"):
        ledger.markdown(spark.range(3).toDF("x"), 2)
