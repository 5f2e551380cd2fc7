"""Objects, edges, traversals, constraints and changes on small hand-made graphs."""

import datetime

import pytest
from kinledger.compat import Compat
from kinledger.functions.predicates import Filter, combined, eq, predicate
from kinledger.model import NIL_OWNER, SYSTEM_OWNER, EdgeType, ObjectType, SchemaError
from kinledger.operators import constraints, mutate
from kinledger.operators.engine import Engine
from kinledger.operators.sequences import Sequences, StoredSequences, numbered
from kinledger.operators.traverse import grouped, nested
from kinledger.operators.unions import as_variants
from kinledger.plans.query import EdgeQuery, Query
from kinledger.sources.catalog import Catalog
from kinledger.sources.store import SnapshotStore
from pyspark.sql import functions as F

NOW = datetime.datetime(2024, 1, 1)
PERSON = ObjectType("person", {"name": "string", "mail": "string", "coins": "long", "secret": "string"}, index=("name:search+sort", "mail", "coins:search"), unique=(("name",),), views={"card": ("id", "name")}, private=frozenset({"secret"}))
NOTE = ObjectType("note", {"title": "string", "status": "string", "tags": "array<string>", "stars": "long"}, index=("title:search", "title:sort", "status", "tags"), defaults={"status": "draft"})
KNOWS = EdgeType("knows", {"close": "boolean", "since": "long"}, index=("close", "since:sort"))


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def catalog(spark):
    people = [(n, SYSTEM_OWNER, NOW, NOW, name, f"{name}@x", coins, "s") for n, name, coins in (("1", "alice", 100), ("2", "bob", 200), ("3", "charlie", None), ("4", "dora", 50))]
    people.append(("5", NIL_OWNER, NOW, NOW, "eve", "e%e@x", 9, "s"))
    notes = [(f"n{i:02}", "1" if i < 6 else "2", NOW, NOW, f"Note {i}", None if i == 0 else ("open" if i % 2 else "shut"), ["a", "b"][: i % 3], i if i % 4 else None) for i in range(10)]
    edges = [("1", "2", True, 5), ("1", "3", False, 7), ("3", "2", True, 1), ("2", "1", True, 2), ("4", "4", False, 9), ("1", "gone", True, 8)]
    return Catalog(spark).rows(PERSON, people).rows(NOTE, notes).rows(KNOWS, edges)


@pytest.fixture(scope="module")
def engine(catalog):
    return Engine(catalog)


def test_declarations_are_checked():
    for bad in (
        lambda: ObjectType("x", {"id": "long"}), lambda: ObjectType("x", {"a": "long"}, index=("b",)), lambda: ObjectType("x", {"a": "long"}, index=("a:find",)),
        lambda: ObjectType("x", {"a": "long"}, views={"v": ("b",)}), lambda: ObjectType("x", {"a": "long"}, unique=(("created_at",),)),
        lambda: ObjectType("x", {"a": "long"}, views={"v": ("a",)}, private=frozenset({"a"})), lambda: EdgeType("x", {"from": "long"}),
    ):
        with pytest.raises(SchemaError):
            bad()
    assert NOTE.indexes["title"] == {"search", "sort"} and "created_at" in NOTE.indexes
    assert set(KNOWS.indexes) == {"src", "dst", "close", "since"}


def test_reads(engine):
    assert ids(engine.fetch_object(PERSON, "2")) == ["2"]
    assert sorted(ids(engine.fetch_objects(PERSON, ["1", "1", "3", "x"]))) == ["1", "3"]
    assert ids(engine.fetch_owned_object(NOTE, "2")) == ["n06"]
    assert len(ids(engine.fetch_owned_objects_batch(NOTE, ["1", "2"]))) == 10
    assert ids(engine.find_object(PERSON, [eq("name", "bob")])) == ["2"]
    assert ids(engine.find_object(NOTE, [eq("status", "open")], owner="1")) == ["n05"]
    assert engine.fetch_object(NOTE, "n00").first()["status"] == "draft"


def test_long_lists_of_keys_are_joined(engine, monkeypatch):
    from kinledger.plans import query as module

    monkeypatch.setattr(module, "MOST_LISTED", 1)
    assert sorted(ids(engine.fetch_objects(PERSON, ["1", "3", "x"]))) == ["1", "3"]


def test_order_limit_and_cursor(engine):
    q = Query()
    assert ids(engine.query_objects(PERSON, q.with_cursor("3").with_limit(9))) == ["2", "1"]
    assert ids(engine.query_objects(PERSON, q.sort_desc("name"))) == ["4", "3", "2", "1"]
    assert ids(engine.query_objects(PERSON, q.sort_asc("coins"))) == ["4", "1", "2", "3"]
    assert ids(engine.query_objects(PERSON, q.sort_desc("coins"))) == ["3", "2", "1", "4"]
    page = ids(engine.query_objects(NOTE, Query.wide().with_limit(5)))
    assert page == ["n09", "n08", "n07", "n06", "n05"]
    assert ids(engine.query_objects(NOTE, Query.wide().paginate(page[-1]).with_limit(3))) == ["n04", "n03", "n02"]
    plan = engine.query_objects(NOTE, Query.wide().with_limit(5))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(
    "query,want",
    [
        (Query().where_ne("coins", 100), ["2", "4"]), (Query().where_gt("coins", 50), ["1", "2"]), (Query().where_gte("coins", 50), ["1", "2", "4"]),
        (Query().where_lt("coins", 100), ["4"]), (Query().where_lte("coins", 100), ["1", "4"]), (Query().where_contains("name", "LI"), ["1", "3"]),
        (Query().where_begins_with("name", "B"), ["2"]), (Query().where_contains_all("name", "ALICE"), ["1"]), (Query.wide().where_contains("mail", "%"), ["5"]),
        (Query().where_eq("name", "alice").or_eq("name", "bob"), ["1", "2"]), (Query().or_eq("name", "alice").or_eq("name", "eve"), ["1"]),
        (Query().where_eq("name", "dora").or_eq("name", "bob").where_gt("coins", 500), ["4"]), (Query.wide(), ["1", "2", "3", "4", "5"]),
    ],
)
def test_filters(engine, query, want):
    assert sorted(ids(engine.query_objects(PERSON, query))) == want


def test_array_filters(engine):
    q = Query.wide()
    assert sorted(ids(engine.query_objects(NOTE, q.where_contains("tags", ["b", "z"])))) == ["n02", "n05", "n08"]
    assert sorted(ids(engine.query_objects(NOTE, q.where_contains_all("tags", ["a", "b"])))) == ["n02", "n05", "n08"]
    assert len(ids(engine.query_objects(NOTE, q.where_contains("tags", [])))) == 10
    with pytest.raises(ValueError):
        predicate(Filter("tags", ["a"], "eq"), F.col("tags"))


def test_compat_switches(catalog):
    old = Engine(catalog, Compat(legacy_or=True, legacy_text_sort=True, legacy_like=True, legacy_nil_scope=True))
    # the operator stands after its filter: the first or leaks out of the scope, the last does nothing
    assert sorted(ids(old.query_objects(PERSON, Query().or_eq("name", "alice").or_eq("name", "eve")))) == ["1", "5"]
    assert ids(old.query_objects(PERSON, Query().where_eq("name", "alice").or_eq("name", "bob"))) == []
    assert ids(old.query_objects(PERSON, Query().where_gt("coins", 0).sort_asc("coins"))) == ["1", "2", "4"]
    assert "5" not in ids(old.query_objects(PERSON, Query.wide()))
    assert len(ids(old.query_objects(PERSON, Query.wide().where_contains("mail", "%")))) == 4
    assert combined([], [], F.col) is None


def test_counts(engine):
    assert engine.count_objects(NOTE).first()["n"] == 10
    assert engine.count_objects(NOTE, Query.of("1").where_eq("status", "open").with_limit(1)).first()["n"] == 3
    assert engine.count_edges(KNOWS, "1").first()["n"] == 3
    assert engine.count_edges(KNOWS, "1", EdgeQuery().where_eq("close", True)).first()["n"] == 2
    assert engine.count_reverse_edges(KNOWS, "2").first()["n"] == 2


def test_edges(engine):
    assert ids(engine.query_edges(KNOWS, "1", EdgeQuery().sort_desc("since")), "dst") == ["gone", "3", "2"]
    assert ids(engine.query_edges(KNOWS, "1", EdgeQuery().with_cursor("3").with_limit(5)), "dst") == ["2"]
    assert sorted(ids(engine.query_reverse_edges(KNOWS, "2"), "src")) == ["1", "3"]
    assert engine.fetch_edge(KNOWS, "1", "3").first()["since"] == 7
    with pytest.raises(ValueError):
        engine.query_edges(KNOWS, "1", EdgeQuery().sort_asc("created_at"))


def test_traversal_from_one(engine):
    t = engine.preload_object(PERSON, "1").edge(KNOWS, PERSON)
    assert sorted(ids(t.collect())) == ["2", "3"]
    assert ids(t.collect_reverse()) == ["2"]
    assert ids(t.edge_eq("close", True).collect()) == ["2"] and ids(t.edge_eq("close", False).collect()) == ["3"]
    assert ids(t.where_eq("name", "charlie").collect()) == ["3"]
    assert ids(t.sort_desc("name").collect()) == ["3", "2"] and ids(t.edge_sort_asc("since").with_limit(1).collect()) == ["2"]
    assert len(ids(t.collect_edges(), "dst")) == 3
    assert {(r.direction, r.id) for r in t.collect_both().collect()} == {("forward", "2"), ("forward", "3"), ("reverse", "2")}
    loop = engine.preload_object(PERSON, "4").edge(KNOWS, PERSON)
    assert sorted(ids(loop.collect_both_edges(), "direction")) == sorted(ids(loop.collect_both(), "direction")) == ["forward", "reverse"]
    pair = nested(t.edge_eq("close", False).collect_with_target(), KNOWS, PERSON).first()
    assert pair["edge"]["dst"] == pair["object"]["id"] == "3"
    assert engine.preload_object(PERSON, "2").preload(NOTE).count() == 4
    assert engine.preload_object(PERSON, "3").preload(NOTE).first()["child_id"] is None


def test_traversal_from_many(engine):
    t = engine.preload_objects(PERSON, Query()).edge(KNOWS, PERSON)
    found = {(r.parent_id, r.id) for r in t.collect().collect()}
    assert found == {("1", "2"), ("1", "3"), ("2", "1"), ("3", "2"), ("4", "4")}
    assert {(r.parent_id, r.id) for r in t.collect_reverse().collect()} == {("1", "2"), ("2", "1"), ("2", "3"), ("3", "1"), ("4", "4")}
    assert {r.parent_id: r.n for r in t.count().collect()} == {"1": 3, "2": 1, "3": 1, "4": 1}
    assert {r.parent_id: r.n for r in t.edge_eq("close", False).count_reverse().collect()} == {"1": 0, "2": 0, "3": 1, "4": 1}
    assert {(r.parent_id, r.edge_dst) for r in t.edge_sort_desc("since").per_parent_limit(1).collect_edges().collect()} == {("1", "gone"), ("2", "1"), ("3", "2"), ("4", "4")}
    assert sum(r.edge_dst is not None for r in t.with_limit(2).collect_edges().collect()) == 2
    lists = {r.parent_id: len(r.children) for r in grouped(t.obj_eq("name", "bob").collect()).collect()}
    assert lists == {"1": 1, "2": 0, "3": 1, "4": 0}
    assert engine.preload_objects(PERSON, Query()).preload(NOTE).count() == 12


def test_unions_and_views(engine, catalog):
    both = engine.fetch_union_objects(PERSON, NOTE, ["1", "n01"])
    assert {(r.type, r.id) for r in both.collect()} == {("person", "1"), ("note", "n01")}
    variants = as_variants(both, {k.name: catalog[k] for k in (PERSON, NOTE)}).collect()
    assert sorted(bool(r.first) + 2 * bool(r.second) for r in variants) == [1, 2]
    assert engine.fetch_owned_union_object(PERSON, NOTE, "1").first()["id"] == "n00"
    assert "secret" not in PERSON.public(catalog[PERSON]).columns and "owner" not in PERSON.public(catalog[PERSON]).columns
    assert PERSON.view("card", catalog[PERSON]).columns == ["id", "name"]
    assert catalog.everything([PERSON, NOTE]).count() == 15


def test_unique_values_and_changes(catalog, spark):
    people = catalog[PERSON]
    new = spark.createDataFrame([("9", SYSTEM_OWNER, NOW, NOW, "alice", "m", 1, "s")], PERSON.schema)
    with pytest.raises(mutate.UniqueViolation) as e:
        mutate.create_objects(people, new, PERSON)
    assert e.value.field == "name"
    assert mutate.create_objects(people, new.withColumn("name", F.lit("zoe")), PERSON).count() == 6
    assert constraints.violations(people.unionByName(new), PERSON).first()["n"] == 2
    pairs = ObjectType("pair", {"a": "string", "b": "string"}, unique=(("a", "b"),))
    rows = spark.createDataFrame([("1", None, None, None, "x", "y"), ("2", None, None, None, "x", "y")], pairs.schema)
    assert constraints.conflicts(rows.limit(0), rows, pairs).first()["field"] == "a+b"
    after = mutate.update_objects(people, spark.createDataFrame([("1", "al"), ("x", "no")], "id string, name string"), PERSON, NOW + datetime.timedelta(1))
    assert {r.id: (r.name, r.updated_at > NOW) for r in after.collect()}["1"] == ("al", True) and after.count() == 5
    with pytest.raises(mutate.UniqueViolation):
        mutate.update_objects_checked(people, spark.createDataFrame([("1", "bob")], "id string, name string"), PERSON)
    kept, gone = mutate.delete_object(people, "1", "someone")
    assert kept.count() == 5 and gone.isEmpty()
    kept, gone = mutate.delete_objects(people, ["1", "5"], SYSTEM_OWNER)
    assert kept.count() == 4 and ids(gone) == ["1"]
    moved, changed = mutate.transfer_object(people, "1", SYSTEM_OWNER, "me")
    assert ids(changed) == ["1"] and moved.where("owner = 'me'").count() == 1
    assert mutate.transfer_object(people, "1", "not me", "me")[1].isEmpty()


def test_edge_changes(catalog, spark):
    edges = catalog[KNOWS]
    more = spark.createDataFrame([("1", "2", False, 50), ("1", "4", True, 1)], KNOWS.schema)
    after = {(r.src, r.dst): r.since for r in constraints.upsert_edges(edges, more).collect()}
    assert after["1", "2"] == 50 and len(after) == 7
    assert mutate.update_edge(edges, "1", "2", {"since": 6}, to="3").where("src = '1'").count() == 2
    assert mutate.delete_object_edges(edges, "1").count() == 3


def test_edges_without_an_end_stay(catalog, spark):
    edges = spark.createDataFrame([("1", "2", True, 1), ("1", "3", True, 2), (None, "2", True, 3), ("1", None, True, 4)], KNOWS.schema)
    left = lambda df: sorted(((r.src or "", r.dst or "", r.since) for r in df.collect()))
    every = left(edges)
    assert left(mutate.update_edge(edges, "1", "9", {"since": 8}, to="3")) == every  # no such edge: nothing is replaced
    assert left(mutate.update_edge(edges, "1", "2", {"since": 8}, to="3")) == sorted([("1", "3", 8), ("", "2", 3), ("1", "", 4)])
    assert left(mutate.delete_edge(edges, "1", "2")) == [r for r in every if r != ("1", "2", 1)]
    assert left(mutate.delete_object_edges(edges, "1")) == [("", "2", 3)]
    twice = spark.createDataFrame([("1", "2", True, 5), ("1", "2", True, 7)], KNOWS.schema)
    assert ("1", "2", 7) in left(constraints.upsert_edges(edges, twice)) and len(left(constraints.upsert_edges(edges, twice))) == 4


def test_pivots_cut_edges_before_objects(engine):
    plan = engine.preload_objects(PERSON, Query()).edge(KNOWS, PERSON).collect()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")  # deeper in the tree


def test_a_database_over_jdbc(spark, tmp_path):
    """Spark ships one: written to it and read back in parallel."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    people = spark.createDataFrame([(str(i), "me", f"n{i}", i) for i in range(20)], "id string, owner string, name string, coins long")
    people.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "people").option("createTableColumnTypes", "id VARCHAR(20), owner VARCHAR(20), name VARCHAR(20)").save()
    mine = Catalog(spark).jdbc(PERSON, url, "people", column="coins", bounds=(0, 20, 3), driver=driver)
    assert mine[PERSON].rdd.getNumPartitions() == 3
    assert sorted(ids(Engine(mine).query_objects(PERSON, Query.of("me").where_gte("coins", 17)))) == ["17", "18", "19"]


def test_stored_counters(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    one, two = StoredSequences(store), StoredSequences(SnapshotStore(spark, str(tmp_path)))
    assert (one.value("x"), one.next_value("x"), two.next_value("x"), one.take("x", 5), two.value("x"), two.value("y")) == (1, 2, 3, 4, 8, 1)


def test_numbers_without_buckets(spark):
    rows = [(None if k % 50 == 0 else k * 37 % 500, k) for k in range(500)]
    got = {r.k: r.number for r in numbered(spark.createDataFrame(rows, "v long, k long"), ["v", "k"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {k: i + 1 for i, (_, k) in enumerate(want)}
    text = spark.createDataFrame([("b",), ("a",)], "v string")
    assert {r.v: r.number for r in numbered(text, ["v"]).collect()} == {"a": 1, "b": 2}


def test_sequences(spark):
    s = Sequences()
    assert (s.value("x"), s.next_value("x"), s.value("x")) == (1, 2, 2)
    assert s.take("x", 5) == 3 and s.value("x") == 7
    df = spark.createDataFrame([(k, k // 3) for k in (5, 1, 4, 2, 3)], "k long, g long")
    assert [r.number for r in numbered(df, ["k"], 10, F.col("g")).orderBy("k").collect()] == [10, 11, 12, 13, 14]
