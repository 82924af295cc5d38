"""Ticker rules, registry and source cascade."""

from datetime import date

import pytest

from trendcloud import schema
from trendcloud.operators import cascade, registry, tickers

CASES = {
    "aapl": ("AAPL", None),
    " msft\t": ("MSFT", None),
    "BRK1": ("BRK1", None),
    " x \x1f": ("X", None),
    "1": ("1", None),
    "": (None, tickers.NOT_A_STRING),
    None: (None, tickers.NOT_A_STRING),
    "   ": (None, tickers.BAD_LENGTH),
    "INVALID_TICKER": (None, tickers.BAD_LENGTH),
    "DELETE": (None, tickers.BAD_LENGTH),
    "A@PL": (None, tickers.BAD_CHARACTERS),
    "A PL": (None, tickers.BAD_CHARACTERS),
    "äbc": (None, tickers.BAD_CHARACTERS),
    "test": (None, "Ticker 'TEST' is not allowed"),
    " drop\n": (None, "Ticker 'DROP' is not allowed"),
    "tests": ("TESTS", None),
}


def plain_rule(name):
    if not name:
        return None, tickers.NOT_A_STRING
    name = name.upper().strip()
    if not 1 <= len(name) <= 5:
        return None, tickers.BAD_LENGTH
    if not all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" for c in name):
        return None, tickers.BAD_CHARACTERS
    if name in tickers.BLACKLIST:
        return None, f"Ticker '{name}' is not allowed"
    return name, None


def judged(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "ticker string")
    return {
        r.ticker: (r.symbol, r.reason, r.is_valid) for r in tickers.validate_tickers(df).collect()
    }


def test_rules(spark):
    got = judged(spark, CASES)
    for name, (symbol, reason) in CASES.items():
        assert got[name] == (symbol, reason, symbol is not None), repr(name)
        assert plain_rule(name) == (symbol, reason), repr(name)


def test_rules_on_random_names(spark):
    import random

    rng = random.Random(5)
    letters = "aAzZ09 \t\n\x1c@_ß İtesTdrop"
    names = {"".join(rng.choices(letters, k=rng.randrange(8))) for _ in range(3000)}
    names |= {w + t for w in tickers.BLACKLIST for t in ("", " ", "X")}
    for name, (symbol, reason, valid) in judged(spark, names).items():
        assert (symbol, reason) == plain_rule(name), repr(name)
        assert valid == (symbol is not None)


def names_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def test_exists(spark):
    got = tickers.ticker_exists(names_of(spark, "A", "B", None), names_of(spark, "A", "A"))
    assert {(r.ticker, r.exists) for r in got.collect()} == {("A", True), ("B", False), (None, False)}


def test_registry_list_keeps_repeats(spark):
    lines = spark.createDataFrame([(v,) for v in (" B ", "", "A\t", "  ", "B")], "value string")
    listed = registry.registry_list(lines)
    assert [r.ticker for r in listed.collect()] == ["A", "B", "B"]
    assert registry.registry_count(listed).first()[0] == 3


def test_registry_cap(spark):
    full = names_of(spark, *[f"T{i:03}" for i in range(100)])
    merged, refused = registry.registry_merge(full, names_of(spark, "T005", "NEW"))
    assert merged.count() == 101 and refused.count() == 0
    merged, refused = registry.registry_merge(full, names_of(spark, "T005", "NEW"), 100)
    assert merged.count() == 100 and [r.ticker for r in refused.collect()] == ["NEW"]
    merged, refused = registry.registry_merge(full, names_of(spark, "B", "A", "C", "A"), 102)
    assert merged.count() == 102 and [r.ticker for r in refused.collect()] == ["C"]
    over, refused = registry.registry_merge(full, names_of(spark, "A"), 50)
    assert over.count() == 100 and refused.count() == 1
    listed = [r.ticker for r in merged.collect()]
    assert listed == sorted(listed)


def source(spark, **tickers_to_close):
    rows = [
        (t, date(2024, 1, i + 1), 1.0, 1.0, 1.0, float(c), 1)
        for t, closes in tickers_to_close.items()
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, schema.BARS)


def served(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.ticker, r.source), []).append(r.close)
    return {k: sorted(v) for k, v in out.items()}


def test_cascade(spark):
    snapshot = source(spark, S=[1, 2])
    stored = source(spark, S=[3], C=[4, 5], AAPL=[6])
    local = source(spark, AAPL=[7], L=[8])
    provider = source(spark, S=[9], C=[9], AAPL=[9], L=[9], P=[10])

    def run(**flags):
        gated = cascade.gate_sources(snapshot, stored, local, provider, local_ticker="AAPL", **flags)
        return served(cascade.resolve_sources(gated))

    everything = {t: (t, "yahoo_finance") for t in ("S", "C", "AAPL", "L", "P")}
    assert run() == {everything[t]: [10.0 if t == "P" else 9.0] for t in everything}
    assert run(use_s3=True) == {
        ("S", "s3_cache"): [1.0, 2.0],
        ("C", "s3_csv"): [4.0, 5.0],
        ("AAPL", "s3_csv"): [6.0],
        ("L", "yahoo_finance"): [9.0],
        ("P", "yahoo_finance"): [10.0],
    }
    assert run(use_s3=True, use_cache=False)[("S", "s3_csv")] == [3.0]
    local_first = run(use_csv=True)
    assert local_first[("AAPL", "local_csv")] == [7.0]
    assert local_first[("L", "yahoo_finance")] == [9.0]
    with pytest.raises(ValueError):
        cascade.resolve_sources([("x", provider, False)])


def test_labels(spark):
    df = spark.createDataFrame([("s3_csv",), ("other",)], "source string")
    got = df.select(cascade.source_label(df.source)).collect()
    assert [r[0] for r in got] == ["AWS S3 CSV", "other"]
