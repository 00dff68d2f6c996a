import pytest
from pyspark.sql import functions as F

from tallyforge.operators import reports

CARD = {"models": {"m": [{"input": 1, "output": 2, "cache_read": 0.1, "cache_write_5m": 0, "effective_until": "2024-01-01", "tiers": [{"above": 10, "input": 3, "output": 4}]}, {"input": 5, "output": 6, "effective_from": "2024-01-01", "fast_multiplier": 2}]}, "aliases": {"x": "m"}}


def test_rate_card(spark):
    rates, tiers, aliases = reports.rate_card(spark, CARD)
    got = {r.variant: r for r in rates.collect()}
    assert float(got[0].rate_5m) == 1 and got[0].fast_multiplier is None and float(got[1].fast_multiplier) == 2 and got[1].effective_until is None
    assert tiers.first().above == 10 and aliases.first().target == "m"
    with pytest.raises(ValueError):
        reports.rate_card(spark, {"models": {"m": {"input": -1}}})
    with pytest.raises(ValueError):
        reports.rate_card(spark, {"models": {}, "aliases": {"a": "b"}})


def test_bridge_and_rendering(spark):
    docs = spark.createDataFrame([("q", 1, "use `Foo.bar` and `baz`"), ("q", 2, "`baz` again, `nope`")], "question string, place int, text string")
    symbols = spark.createDataFrame([("baz", f"u{i}") for i in range(5)] + [("Foo.bar", "v")], "name string, unit string")
    assert sorted((r.name, r.unit, r.place) for r in reports.bridged(docs, symbols).collect()) == [("Foo.bar", "v", 1), ("baz", "u0", 1), ("baz", "u1", 1), ("baz", "u2", 1)]
    table = reports.markdown(spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int"), "T", [F.desc("n")])
    assert table.splitlines()[-2:] == ["|  | 2 |", "| a\\|b | 1 |"]
    assert spark.range(1).select(reports.escaped(F.lit("a|b\nc*"))).first()[0] == "a\\|b c\\*"
