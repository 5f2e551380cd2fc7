"""The ledger's plans, their execution and reads."""

import datetime

import pytest
from kinledger.compat import Compat
from kinledger.ledger import reads
from kinledger.ledger.execute import Ledger
from kinledger.ledger.fragments import fifo_select, fragment_sizes
from kinledger.ledger.model import Asset, AssetNotFound, DuplicateIdempotencyKey, InsufficientFunds, InvalidAmount, LedgerError, UnconsumedSlice, may_become
from kinledger.plans.metrics import Metrics
from kinledger.sources.store import Conflict, SnapshotStore
from pyspark.sql import functions as F

T = datetime.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def start(spark):
    return Ledger.empty(spark).create_asset("USD", 10_000, 2)


def have(ledger, owner, code="USD"):
    row = reads.balance(ledger.objects, ledger.asset(code).id, owner).first()
    return row["available"], row["reserved"]


def minted(ledger, owner, amount, **more):
    return ledger.atomic(lambda p: p.mint(ledger.asset("USD").id, owner, amount, **more), T)


def frozen(ledger, path):
    """The ledger as a store's version, which is how a long run keeps its plans short."""
    store = SnapshotStore(ledger.spark, str(path))
    store.commit(store.version(), ledger.tables())
    return Ledger(**store.read())


def test_amounts(spark, start):
    usd = Asset("x", "USD", 1, 2)
    assert usd.to_internal(12.345) == 1234 and usd.to_display(1234) == 12.34
    cut = lambda a, u, m: spark.range(1).select(fragment_sizes(F.lit(a).cast("long"), F.lit(u).cast("long"), m)).first()[0]
    assert cut(25_000, 10_000, 1000) == [10_000, 10_000, 5_000]
    assert cut(100, 1, 10) == [10] * 10 and cut(0, 5, 10) == [] and sum(cut(101, 1, 10)) == 101
    with pytest.raises(AssetNotFound):
        start.asset("EUR")
    changed = start.create_asset("USD", 500, 3)
    assert changed.asset("USD").id == start.asset("USD").id and changed.asset("USD").unit == 500
    states = spark.createDataFrame([("alive", "burned"), ("reserved", "alive"), ("burned", "alive")], "a string, b string")
    assert [r[0] for r in states.select(may_become(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_transfer_with_change(start, tmp_path):
    ledger = frozen(minted(start, "ann", 25_000), tmp_path)
    usd = ledger.asset("USD").id

    def pay(p):
        money = p.money(usd, "ann", 12_000)
        part = money.slice(12_000)
        fee = part.slice(500)
        part.transfer_to("shop")
        fee.burn()

    after = ledger.atomic(pay, T)
    assert have(after, "ann") == (13_000, 0) and have(after, "shop") == (11_500, 0)
    assert after.objects.where("state = 'burned'").agg(F.sum("amount")).first()[0] in (15_000, 20_000)  # the fragments are of one age
    assert after.transactions.count() == 3 and have(ledger, "ann") == (25_000, 0)


def test_reserve_and_settle(start, tmp_path):
    ledger = frozen(minted(start, "ann", 10_000), tmp_path)
    usd = ledger.asset("USD").id
    held = frozen(ledger.atomic(lambda p: p.reserve(usd, "ann", "court", 6_000), T), tmp_path)
    assert have(held, "ann") == (4_000, 0) and have(held, "court") == (0, 6_000)
    done = held.atomic(lambda p: p.settle(usd, "court", "bob", 5_000), T)
    assert have(done, "court") == (0, 1_000) and have(done, "bob") == (5_000, 0)
    with pytest.raises(InsufficientFunds):
        held.atomic(lambda p: p.settle(usd, "court", "bob", 7_000))


def test_refusals(start):
    ledger = minted(start, "ann", 100, key="once")
    usd = ledger.asset("USD").id
    for make, error in (
        (lambda p: p.mint(usd, "ann", 0), InvalidAmount), (lambda p: p.mint(usd, "ann", 2**63), InvalidAmount), (lambda p: p.money(usd, "ann", 101), InsufficientFunds),
        (lambda p: p.burn(usd, "ann", 101), InsufficientFunds), (lambda p: p.money(usd, "ann", 50), LedgerError), (lambda p: p.money(usd, "ann", 50).slice(60), InvalidAmount),
        (lambda p: p.money(usd, "ann", 50).slice(50), UnconsumedSlice), (lambda p: p.mint(usd, "ann", 1, key="once"), DuplicateIdempotencyKey),
    ):
        with pytest.raises(error):
            ledger.atomic(make, T)
    assert reads.by_idempotency_key(ledger.transactions, ledger.keys, "once").count() == 1
    assert reads.by_idempotency_key(ledger.transactions, ledger.keys, "never").count() == 0


def test_fifo_is_oldest_first(spark):
    rows = [("c", "a", "o", 5, "alive", None, T), ("a", "a", "o", 5, "alive", None, T), ("b", "a", "o", 5, "alive", None, T - datetime.timedelta(1)), ("d", "a", "o", 50, "burned", None, T - datetime.timedelta(9))]
    from kinledger.ledger.model import VALUE_OBJECTS

    locks = spark.createDataFrame([("a", "o", 6)], "asset string, owner string, required long")
    assert sorted(r.id for r in fifo_select(spark.createDataFrame(rows, VALUE_OBJECTS), locks).collect()) == ["a", "b"]


def test_holdings_and_journal(start):
    ledger = minted(start, "ann", 1_000)
    usd = ledger.asset("USD").id
    empty = ledger.atomic(lambda p: p.burn(usd, "ann", 1_000), T)
    assert reads.holdings(empty.objects, empty.assets, "ann").count() == 0
    assert reads.holdings(empty.objects, empty.assets, "ann", Compat(legacy_holdings=True)).count() == 1
    held = reads.holdings(ledger.objects, ledger.assets)
    rates = ledger.spark.createDataFrame([("EUR", 2.0)], "code string, rate double")
    assert held.first()["quantity"] == 10.0 and reads.portfolio_value(held, rates).first()["value"] == 0.0
    assert reads.sorted_holdings(held).first()["code"] == "USD"
    assert reads.of_owner(empty.transactions, "ann", T, T).count() == 2
    assert reads.of_asset(empty.transactions, usd, T + datetime.timedelta(1), T + datetime.timedelta(2)).count() == 0
    one = empty.transactions.first()["id"]
    assert reads.transaction(empty.transactions, empty.assets, one, empty.keys).first()["code"] == "USD"


def test_one_of_two_writers_wins(start, tmp_path):
    store = SnapshotStore(start.spark, str(tmp_path / "s"))
    base = store.commit(0, minted(start, "ann", 100).tables())
    ledger = Ledger(**store.read())
    usd = ledger.asset("USD").id

    def spend(p):
        p.money(usd, "ann", 100).slice(100).transfer_to("bob")

    assert store.commit(base, ledger.atomic(spend, T).tables()) == base + 1
    with pytest.raises(Conflict):
        store.commit(base, ledger.atomic(spend, T).tables())
    assert have(Ledger(**store.read()), "bob") == (100, 0)
    assert have(Ledger(**store.read(base)), "ann") == (100, 0)


def test_a_writer_that_dies_leaves_nothing(start, tmp_path, monkeypatch):
    store = SnapshotStore(start.spark, str(tmp_path / "s"))
    base = store.commit(0, start.tables())
    pointer = store._fs(f"{store.path}/versions/.2-dead")
    pointer[0].create(pointer[1], False)  # never written, never closed, never renamed
    assert store.version() == base and set(store.read()) == set(start.tables())
    assert store.commit(base, start.tables()) == base + 1
    monkeypatch.setattr(store, "version", lambda: base)  # another writer was faster than this one saw
    with pytest.raises(Conflict):
        store.commit(base, start.tables())


def test_metrics_of_a_run(start):
    metrics = Metrics()
    start.atomic(lambda p: p.mint(start.asset("USD").id, "ann", 700), T, metrics)
    with pytest.raises(InvalidAmount), metrics.timed("mint"):
        start.atomic(lambda p: p.mint(start.asset("USD").id, "ann", 0), T, metrics)
    assert metrics.counters["ledger.success"] == 1 and metrics.histograms["ledger.amount"] == [700] and len(metrics.histograms["mint.duration_ms"]) == 1
