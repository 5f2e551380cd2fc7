"""The driver's queries of this engine: types bound to the star-schema tables, and DuckDB SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import Filter, eq
from .ledger import fragments as frag
from .ledger import reads
from .ledger.execute import Ledger
from .ledger.model import DuplicateIdempotencyKey, may_become
from .model import EdgeType, ObjectType
from .operators import constraints, mutate
from .operators.engine import Engine
from .operators.sequences import numbered
from .operators.traverse import grouped, nested
from .plans.metrics import Metrics
from .plans.query import EdgeQuery, Query
from .sources.catalog import Catalog

USER = ObjectType(
    "user", {"username": "string", "balance": "double", "segment": "string"}, index=("username:search+sort", "balance:search", "segment:search"),
    unique=(("username",), ("segment", "balance")), views={"card": ("id", "username", "segment")}, private=frozenset({"balance"}), key="long",
)
ORG = ObjectType("org", {"name": "string", "balance": "double"}, index=("name:search",), key="long")
POST = ObjectType("post", {"title": "string", "status": "string", "view_count": "double"}, index=("title:search+sort", "status:search", "view_count:search+sort"), key="long")
PART = ObjectType("part", {"title": "string", "status": "string", "tags": "array<string>"}, index=("tags:search", "title:search", "status:search"), key="long")
FOLLOW = EdgeType("follow", {"weight": "long", "notification": "boolean"}, index=("weight:search+sort", "notification:search"), key="long")
CONTAINS = EdgeType("contains", {"line": "int", "supplier": "long", "quantity": "double", "price": "double", "shipped": "timestamp_ntz"}, key="long")


_NOW = datetime.datetime(2024, 5, 1)


def catalog(spark: SparkSession, d: str) -> Catalog:
    """The types on the tables of a folder. A table's file is opened when a query asks for its type."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")

    def of(name: str, columns: dict[str, str]):
        return lambda: read(name).select(*(F.expr(c).alias(n) for n, c in columns.items()))

    def follows() -> DataFrame:
        users = read("customer")
        n = F.lit(users.count())
        edges = users.select(F.col("c_custkey").alias("src"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("weight"))
        return edges.select("src", ((F.col("src") + F.col("weight")) % n).alias("dst"), "weight", (F.col("weight") % 2 == 0).alias("notification"))

    return (
        Catalog(spark)
        .defer(USER, of("customer", {"id": "c_custkey", "owner": "c_nationkey", "username": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}))
        .defer(ORG, of("supplier", {"id": "s_suppkey", "owner": "s_nationkey", "name": "s_name", "balance": "s_acctbal"}))
        .defer(POST, of("orders", {"id": "o_orderkey", "owner": "o_custkey", "created_at": "o_orderdate", "title": "o_orderpriority", "status": "o_orderstatus", "view_count": "o_totalprice"}))
        .defer(PART, of("part", {"id": "p_partkey", "owner": "p_size", "title": "p_name", "status": "p_type", "tags": "split(p_name, ' ')"}))
        .defer(FOLLOW, follows)
        .defer(CONTAINS, of("lineitem", {"src": "l_orderkey", "dst": "l_partkey", "line": "l_linenumber", "supplier": "l_suppkey", "quantity": "l_quantity", "price": "l_extendedprice", "shipped": "l_shipdate"}))
    )


def engine(spark: SparkSession, d: str) -> Engine:
    return Engine(catalog(spark, d))


#: The same bindings for DuckDB.
VIEWS = {
    "users": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS owner, c_name AS username, c_acctbal AS balance, c_mktsegment AS segment FROM customer",
    "orgs": "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS owner, s_name AS name, s_acctbal AS balance FROM supplier",
    "posts": "SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS created_at, o_orderpriority AS title, o_orderstatus AS status, o_totalprice AS view_count FROM orders",
    "parts": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS owner, p_name AS title, p_type AS status, string_split(p_name, ' ') AS tags FROM part",
    "follows": "SELECT c_custkey AS src, (c_custkey + j) % (SELECT count(*) FROM customer) AS dst, j AS weight, j % 2 = 0 AS notification FROM customer, range(1, 11) AS r(j)",
    "objects": "SELECT event_id AS id, r_name AS asset, user_id AS owner, CAST(round(value * 100) AS BIGINT) AS amount, CASE event_type WHEN 'click' THEN 'reserved' WHEN 'error' THEN 'burned' ELSE 'alive' END AS state, ts AS created_at FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE event_type <> 'view'",
    "txns": "SELECT o_orderkey AS id, r_name AS asset, o_custkey AS sender, (o_custkey + 1) % (SELECT count(*) FROM customer) AS receiver, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderdate AS created_at FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with SQL over VIEWS."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            used = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in sql]
            _SQL[f.__name__] = (f"WITH {', '.join(used)} " if used else "") + sql
        return f

    return put


def _user(df: DataFrame) -> DataFrame:
    return df.select("id", "owner", "username", "balance", "segment")


def _post(df: DataFrame) -> DataFrame:
    return df.select("id", "owner", "created_at", "title", "status", "view_count")


def _part(df: DataFrame) -> DataFrame:
    return df.select("id", "owner", "title", "status")


# point reads


@query("SELECT * FROM users WHERE id = 42")
def q_fetch_object(spark, d):
    return _user(engine(spark, d).fetch_object(USER, 42))


@query("SELECT * FROM users WHERE id IN (1, 5, 7, 99)")
def q_fetch_objects(spark, d):
    return _user(engine(spark, d).fetch_objects(USER, [7, 1, 5, 5, 99, -3]))


@query("SELECT * FROM posts WHERE owner = 10")
def q_fetch_owned(spark, d):
    return _post(engine(spark, d).fetch_owned_objects(POST, 10))


@query("SELECT * FROM posts WHERE owner = 10 ORDER BY id LIMIT 1")
def q_fetch_owned_one(spark, d):
    return _post(engine(spark, d).fetch_owned_object(POST, 10))


@query("SELECT * FROM posts WHERE owner IN (3, 4, 5)")
def q_fetch_owned_batch(spark, d):
    return _post(engine(spark, d).fetch_owned_objects_batch(POST, [3, 4, 5]))


@query("SELECT * FROM users WHERE owner = 7 AND segment = 'BUILDING' ORDER BY id DESC LIMIT 1")
def q_find_with_owner(spark, d):
    return _user(engine(spark, d).find_object(USER, [eq("segment", "BUILDING")], owner=7))


@query("SELECT * FROM users WHERE owner = 7 AND segment = 'BUILDING' AND balance > 0 ORDER BY id DESC LIMIT 1")
def q_find_object(spark, d):
    return _user(engine(spark, d).find_object(USER, [eq("segment", "BUILDING"), Filter("balance", 0.0, "gt")], owner=7))


# filters


def _posts(spark, d, q: Query) -> DataFrame:
    return _post(engine(spark, d).query_objects(POST, q))


@query("SELECT * FROM posts WHERE status = 'F'")
def q_query_objects_eq(spark, d):
    return _posts(spark, d, Query.wide().where_eq("status", "F"))


@query("SELECT * FROM posts WHERE status <> 'F'")
def q_query_objects_ne(spark, d):
    return _posts(spark, d, Query.wide().where_ne("status", "F"))


@query("SELECT * FROM posts WHERE view_count > 200000")
def q_query_objects_gt(spark, d):
    return _posts(spark, d, Query.wide().where_gt("view_count", 200000.0))


@query("SELECT * FROM posts WHERE view_count >= 200000 AND status = 'O'")
def q_query_objects_gte(spark, d):
    return _posts(spark, d, Query.wide().where_gte("view_count", 200000.0).where_eq("status", "O"))


@query("SELECT * FROM posts WHERE view_count < 5000")
def q_query_objects_lt(spark, d):
    return _posts(spark, d, Query.wide().where_lt("view_count", 5000.0))


@query("SELECT * FROM posts WHERE created_at <= TIMESTAMP '1995-06-30' AND view_count <= 50000")
def q_query_objects_lte(spark, d):
    return _posts(spark, d, Query.wide().where_lte("created_at", datetime.datetime(1995, 6, 30)).where_lte("view_count", 50000.0))


@query("SELECT * FROM posts WHERE owner = 10 AND status = 'O'")
def q_query_objects_owner(spark, d):
    return _posts(spark, d, Query.of(10).where_eq("status", "O"))


@query("SELECT id, owner, title, status FROM parts WHERE title ILIKE '%RE%'")
def q_contains_text(spark, d):
    return _part(engine(spark, d).query_objects(PART, Query.wide().where_contains("title", "RE")))


@query("SELECT id, owner, title, status FROM parts WHERE title ILIKE 'RED%'")
def q_begins_with(spark, d):
    return _part(engine(spark, d).query_objects(PART, Query.wide().where_begins_with("title", "RED")))


@query("SELECT id, owner, title, status FROM parts WHERE list_has_any(tags, ['red', 'blue'])")
def q_contains_any(spark, d):
    return _part(engine(spark, d).query_objects(PART, Query.wide().where_contains("tags", ["red", "blue"])))


@query("SELECT id, owner, title, status FROM parts WHERE list_has_all(tags, string_split((SELECT p_name FROM part ORDER BY p_partkey LIMIT 1), ' '))")
def q_contains_all(spark, d):
    first = spark.read.parquet(f"{d}/part.parquet").orderBy("p_partkey").first()["p_name"]
    return _part(engine(spark, d).query_objects(PART, Query.wide().where_contains_all("tags", first.split(" "))))


@query("SELECT id, owner, title, status FROM parts WHERE lower(status) = lower((SELECT p_type FROM part ORDER BY p_partkey LIMIT 1))")
def q_contains_all_text(spark, d):
    first = spark.read.parquet(f"{d}/part.parquet").orderBy("p_partkey").first()["p_type"]
    return _part(engine(spark, d).query_objects(PART, Query.wide().where_contains_all("status", first.swapcase())))


@query("SELECT * FROM posts WHERE status = 'P' OR view_count > 250000")
def q_or(spark, d):
    return _posts(spark, d, Query.wide().where_eq("status", "P").or_gt("view_count", 250000.0))


@query("SELECT * FROM posts WHERE owner = 10 AND (status = 'P' OR status = 'F' AND view_count < 100000 OR title ILIKE '1-%')")
def q_and_or_mix(spark, d):
    return _posts(spark, d, Query.of(10).where_eq("status", "P").or_eq("status", "F").where_lt("view_count", 100000.0).or_begins_with("title", "1-"))


@query("SELECT * FROM posts WHERE status = 'P' OR status <> 'O'")
def q_or_ne(spark, d):
    return _posts(spark, d, Query.wide().where_eq("status", "P").or_ne("status", "O"))


@query("SELECT * FROM posts WHERE owner = 10 AND (status = 'P' OR view_count >= 100000)")
def q_or_gte(spark, d):
    return _posts(spark, d, Query.of(10).where_eq("status", "P").or_gte("view_count", 100000.0))


@query("SELECT * FROM posts WHERE status = 'P' OR view_count < 5000")
def q_or_lt(spark, d):
    return _posts(spark, d, Query.wide().where_eq("status", "P").or_lt("view_count", 5000.0))


@query("SELECT * FROM posts WHERE status = 'P' AND view_count > 100000 OR view_count <= 3000")
def q_or_lte(spark, d):
    return _posts(spark, d, Query.wide().where_eq("status", "P").where_gt("view_count", 100000.0).or_lte("view_count", 3000.0))


@query("SELECT id, owner, title, status FROM parts WHERE title ILIKE 'RED%' OR list_has_any(tags, ['blue', 'green'])")
def q_or_contains(spark, d):
    return _part(engine(spark, d).query_objects(PART, Query.wide().where_begins_with("title", "red").or_contains("tags", ["blue", "green"])))


@query("SELECT id, owner, title, status FROM parts WHERE owner = 5 OR list_has_all(tags, string_split((SELECT p_name FROM part ORDER BY p_partkey LIMIT 1), ' '))")
def q_or_contains_all(spark, d):
    first = spark.read.parquet(f"{d}/part.parquet").orderBy("p_partkey").first()["p_name"]
    return _part(engine(spark, d).query_objects(PART, Query.wide().where_eq("owner", 5).or_contains_all("tags", first.split(" "))))


@query("SELECT * FROM posts WHERE created_at = (SELECT min(created_at) FROM posts)")
def q_eq_time(spark, d):
    e = engine(spark, d)
    first = e.catalog[POST].agg(F.min("created_at")).first()[0]
    return _post(e.query_objects(POST, Query.wide().where_eq("created_at", first)))


@query("SELECT id, owner, title, status FROM parts WHERE status = (SELECT min(p_type) FROM part)")
def q_contains_empty(spark, d):
    """An empty list doesn't filter."""
    e = engine(spark, d)
    first = e.catalog[PART].agg(F.min("status")).first()[0]
    return _part(e.query_objects(PART, Query.wide().where_eq("status", first).where_contains("tags", [])))


# order, limit, cursor


@query("SELECT * FROM posts WHERE status = 'O' ORDER BY title ASC NULLS LAST, view_count DESC NULLS FIRST, id DESC LIMIT 50")
def q_sort_multi(spark, d):
    return _posts(spark, d, Query.wide().where_eq("status", "O").sort_asc("title").sort_desc("view_count").with_limit(50))


@query("SELECT * FROM posts WHERE id < 900 ORDER BY id DESC LIMIT 20")
def q_limit_cursor(spark, d):
    return _posts(spark, d, Query.wide().with_cursor(900).with_limit(20))


@query("SELECT * FROM posts ORDER BY view_count DESC NULLS FIRST, id DESC LIMIT 100")
def q_wide(spark, d):
    return _posts(spark, d, Query.wide().sort_desc("view_count").with_limit(100))


@query("SELECT * FROM posts WHERE owner = 10 ORDER BY view_count DESC NULLS FIRST, id DESC LIMIT 20")
def q_query_objects(spark, d):
    return _posts(spark, d, Query.of(10).sort_desc("view_count").with_limit(20))


# counts


@query("SELECT count(*) AS n FROM posts")
def q_count_objects(spark, d):
    return engine(spark, d).count_objects(POST)


@query("SELECT count(*) AS n FROM posts WHERE owner = 10 AND status = 'O'")
def q_count_objects_filtered(spark, d):
    return engine(spark, d).count_objects(POST, Query.of(10).where_eq("status", "O").with_limit(3).with_cursor(5))


# edges


@query("SELECT * FROM follows WHERE src = 17")
def q_edges_fwd(spark, d):
    return engine(spark, d).query_edges(FOLLOW, 17)


@query("SELECT * FROM follows WHERE dst = 17")
def q_edges_rev(spark, d):
    return engine(spark, d).query_reverse_edges(FOLLOW, 17)


@query("SELECT * FROM follows WHERE src = 17 AND (notification = true OR weight > 8) ORDER BY weight DESC LIMIT 4")
def q_edges_filter(spark, d):
    return engine(spark, d).query_edges(FOLLOW, 17, EdgeQuery().where_eq("notification", True).or_gt("weight", 8).sort_desc("weight").with_limit(4))


@query("SELECT * FROM follows WHERE src = 17 AND dst < 24 ORDER BY dst DESC LIMIT 3")
def q_edges_cursor(spark, d):
    return engine(spark, d).query_edges(FOLLOW, 17, EdgeQuery().with_cursor(24).with_limit(3))


@query("SELECT * FROM follows WHERE dst = 17 AND src < 14 ORDER BY src DESC LIMIT 3")
def q_edges_rev_cursor(spark, d):
    return engine(spark, d).query_reverse_edges(FOLLOW, 17, EdgeQuery().with_cursor(14).with_limit(3))


@query("SELECT * FROM follows WHERE src = 3 AND dst = 7")
def q_fetch_edge(spark, d):
    return engine(spark, d).fetch_edge(FOLLOW, 3, 7)


@query("SELECT count(*) AS n FROM follows WHERE src = 17 AND weight >= 4")
def q_count_edges(spark, d):
    return engine(spark, d).count_edges(FOLLOW, 17, EdgeQuery().where_gte("weight", 4))


@query("SELECT count(*) AS n FROM follows WHERE dst = 17")
def q_count_reverse(spark, d):
    return engine(spark, d).count_reverse_edges(FOLLOW, 17)


@query("SELECT count(*) AS n FROM follows WHERE dst = 17 AND notification = false")
def q_count_reverse_filtered(spark, d):
    return engine(spark, d).count_reverse_edges(FOLLOW, 17, EdgeQuery().where_eq("notification", False))


# traversal from one object


def _from(spark, d, id_=17):
    return engine(spark, d).preload_object(USER, id_).edge(FOLLOW, USER)


_PAIR = "f.src AS edge_src, f.dst AS edge_dst, f.weight AS edge_weight, f.notification AS edge_notification, u.*"


def _pair(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "edge_src", "edge_dst", "edge_weight", "edge_notification", "id", "owner", "username", "balance", "segment")


@query("SELECT u.* FROM follows f JOIN users u ON u.id = f.dst WHERE f.src = 17")
def q_traverse_fwd(spark, d):
    return _user(_from(spark, d).collect())


@query("SELECT u.* FROM follows f JOIN users u ON u.id = f.src WHERE f.dst = 17")
def q_traverse_rev(spark, d):
    return _user(_from(spark, d).collect_reverse())


@query(f"SELECT {_PAIR} FROM follows f JOIN users u ON u.id = f.dst WHERE f.src = 17")
def q_traverse_with_target(spark, d):
    return _pair(_from(spark, d).collect_with_target())


@query(f"SELECT {_PAIR} FROM follows f JOIN users u ON u.id = f.src WHERE f.dst = 17")
def q_traverse_rev_with_target(spark, d):
    return _pair(_from(spark, d).collect_reverse_with_target())


@query("SELECT u.* FROM follows f JOIN users u ON u.id = f.dst WHERE f.src = 17 AND f.notification")
def q_traverse_edge_filter(spark, d):
    return _user(_from(spark, d).edge_eq("notification", True).collect())


@query("SELECT u.* FROM follows f JOIN users u ON u.id = f.dst WHERE f.src = 17 AND (u.balance > 0 OR u.segment = 'BUILDING') AND u.id < 26 ORDER BY u.balance DESC LIMIT 5")
def q_traverse_obj_filter(spark, d):
    return _user(_from(spark, d).where_gt("balance", 0.0).or_eq("segment", "BUILDING").with_cursor(26).sort_desc("balance").with_limit(5).collect())


@query("SELECT * FROM follows WHERE src = 17 AND weight < 6")
def q_traverse_edges(spark, d):
    return _from(spark, d).edge_lt("weight", 6).collect_edges()


@query("SELECT * FROM follows WHERE dst = 17 AND weight < 6")
def q_traverse_rev_edges(spark, d):
    return _from(spark, d).edge_lt("weight", 6).collect_reverse_edges()


@query("SELECT 'forward' AS direction, u.* FROM follows f JOIN users u ON u.id = f.dst WHERE f.src = 5 UNION ALL SELECT 'reverse', u.* FROM follows f JOIN users u ON u.id = f.src WHERE f.dst = 5")
def q_both(spark, d):
    return _from(spark, d, 5).collect_both().select("direction", "id", "owner", "username", "balance", "segment")


@query(f"SELECT 'forward' AS direction, {_PAIR} FROM follows f JOIN users u ON u.id = f.dst WHERE f.src = 5 UNION ALL SELECT 'reverse', {_PAIR} FROM follows f JOIN users u ON u.id = f.src WHERE f.dst = 5")
def q_both_with_target(spark, d):
    return _pair(_from(spark, d, 5).collect_both_with_target(), "direction")


@query("SELECT 'forward' AS direction, * FROM follows WHERE src = 5 UNION ALL SELECT 'reverse', * FROM follows WHERE dst = 5")
def q_both_edges(spark, d):
    return _from(spark, d, 5).collect_both_edges()


# traversal from many objects


def _many(spark, d):
    return engine(spark, d).preload_objects(USER, Query.of(7))


_PARENTS = "(SELECT id AS parent_id FROM users WHERE owner = 7) p"


@query(f"SELECT p.parent_id, u.* FROM {_PARENTS} LEFT JOIN (follows f JOIN users u ON u.id = f.dst AND u.balance > 5000) ON f.src = p.parent_id")
def q_preload_edge_fwd(spark, d):
    return _many(spark, d).edge(FOLLOW, USER).where_gt("balance", 5000.0).collect().drop("created_at", "updated_at")


@query(f"SELECT p.parent_id, u.* FROM {_PARENTS} LEFT JOIN (follows f JOIN users u ON u.id = f.src) ON f.dst = p.parent_id")
def q_preload_edge_rev(spark, d):
    return _many(spark, d).edge(FOLLOW, USER).collect_reverse().drop("created_at", "updated_at")


@query(f"SELECT p.parent_id, f.src AS edge_src, f.dst AS edge_dst, f.weight AS edge_weight, f.notification AS edge_notification FROM {_PARENTS} LEFT JOIN follows f ON f.src = p.parent_id AND f.weight > 7")
def q_preload_edges(spark, d):
    return _many(spark, d).edge(FOLLOW, USER).with_edge_query(EdgeQuery().where_gt("weight", 7)).collect_edges()


@query(f"SELECT p.parent_id, f.src AS edge_src, f.dst AS edge_dst, f.weight AS edge_weight, f.notification AS edge_notification FROM {_PARENTS} LEFT JOIN follows f ON f.dst = p.parent_id")
def q_preload_rev_edges(spark, d):
    return _many(spark, d).edge(FOLLOW, USER).collect_reverse_edges()


@query(f"SELECT p.parent_id, {_PAIR} FROM {_PARENTS} LEFT JOIN (follows f JOIN users u ON u.id = f.dst AND u.segment = 'MACHINERY') ON f.src = p.parent_id")
def q_preload_pairs(spark, d):
    return _pair(_many(spark, d).edge(FOLLOW, USER).obj_eq("segment", "MACHINERY").collect_with_target(), "parent_id")


@query(f"SELECT p.parent_id, {_PAIR} FROM {_PARENTS} LEFT JOIN (follows f JOIN users u ON u.id = f.src) ON f.dst = p.parent_id")
def q_preload_rev_pairs(spark, d):
    return _pair(_many(spark, d).edge(FOLLOW, USER).collect_reverse_with_target(), "parent_id")


@query(f"SELECT p.parent_id, x.src AS edge_src, x.dst AS edge_dst, x.weight AS edge_weight, x.notification AS edge_notification FROM {_PARENTS} LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) AS k FROM follows) x ON x.src = p.parent_id AND x.k <= 3")
def q_preload_per_parent(spark, d):
    return _many(spark, d).edge(FOLLOW, USER).edge_sort_desc("weight").per_parent_limit(3).collect_edges()


@query("SELECT u.id AS parent_id, count(f.src) AS n FROM users u LEFT JOIN follows f ON f.src = u.id AND f.notification GROUP BY u.id")
def q_preload_count(spark, d):
    return engine(spark, d).preload_objects(USER, Query.wide()).edge(FOLLOW, USER).edge_eq("notification", True).count()


@query("SELECT u.id AS parent_id, count(f.src) AS n FROM users u LEFT JOIN follows f ON f.dst = u.id AND f.weight > 9 GROUP BY u.id")
def q_preload_count_rev(spark, d):
    return engine(spark, d).preload_objects(USER, Query.wide()).edge(FOLLOW, USER).edge_gt("weight", 9).count_reverse()


_OWNED = "u.id AS parent_id, u.username AS parent_username, p.id AS child_id, p.status AS child_status, p.view_count AS child_view_count"


def _owned(df: DataFrame) -> DataFrame:
    return df.select("parent_id", "parent_username", "child_id", "child_status", "child_view_count")


@query(f"SELECT {_OWNED} FROM users u LEFT JOIN posts p ON p.owner = u.id WHERE u.id = 10")
def q_owned_single(spark, d):
    return _owned(engine(spark, d).preload_object(USER, 10).preload(POST))


@query(f"SELECT {_OWNED} FROM users u LEFT JOIN posts p ON p.owner = u.id WHERE u.owner = 7")
def q_owned_batch(spark, d):
    return _owned(_many(spark, d).preload(POST))


@query(f"SELECT p.parent_id, x.src AS edge_src, x.dst AS edge_dst, x.weight AS edge_weight, x.notification AS edge_notification FROM {_PARENTS} LEFT JOIN (SELECT f.* FROM follows f JOIN users u ON u.id = f.src AND u.owner = 7 ORDER BY weight DESC, dst DESC, src LIMIT 5) x ON x.src = p.parent_id")
def q_batch_limit(spark, d):
    """The limit is over all pivots' rows together."""
    return _many(spark, d).edge(FOLLOW, USER).edge_sort_desc("weight").with_limit(5).collect_edges()


@query(f"SELECT p.parent_id, count(u.id) AS n, CAST(coalesce(sum(u.id), 0) AS BIGINT) AS ids FROM {_PARENTS} LEFT JOIN (follows f JOIN users u ON u.id = f.dst AND u.balance > 5000) ON f.src = p.parent_id GROUP BY p.parent_id")
def q_nested_children(spark, d):
    """One row a pivot with an array of objects, here told by size and sum of ids."""
    lists = grouped(_many(spark, d).edge(FOLLOW, USER).where_gt("balance", 5000.0).collect())
    total = F.aggregate("children", F.lit(0).cast("long"), lambda a, x: a + x["id"])
    return lists.select("parent_id", F.size("children").cast("long").alias("n"), total.alias("ids"))


@query("SELECT f.weight AS edge_weight, u.id AS object_id, u.username AS object_username FROM follows f JOIN users u ON u.id = f.dst WHERE f.src = 17")
def q_nested_pairs(spark, d):
    pairs = nested(_from(spark, d).collect_with_target(), FOLLOW, USER)
    return pairs.select(F.col("edge.weight").alias("edge_weight"), F.col("object.id").alias("object_id"), F.col("object.username").alias("object_username"))


_LOOPED = "(SELECT src, CASE WHEN weight = 10 THEN src ELSE dst END AS dst, weight, notification FROM follows)"


@query(f"SELECT 'forward' AS direction, * FROM {_LOOPED} WHERE src = 5 UNION ALL SELECT 'reverse', * FROM {_LOOPED} WHERE dst = 5")
def q_self_loops(spark, d):
    """An edge from 5 to itself stands in both directions."""
    e = engine(spark, d)
    e.catalog.bind(FOLLOW, e.catalog[FOLLOW].withColumn("dst", F.when(F.col("weight") == 10, F.col("src")).otherwise(F.col("dst"))))
    return e.preload_object(USER, 5).edge(FOLLOW, USER).collect_both_edges()


# two types


_UNION = "(SELECT 'user' AS type, id, owner, username, segment, balance, NULL AS name FROM users UNION ALL SELECT 'org', id, owner, NULL, NULL, balance, name FROM orgs)"


def _union(df: DataFrame) -> DataFrame:
    return df.select("type", "id", "owner", "username", "segment", "balance", "name")


@query(f"SELECT * FROM {_UNION} WHERE id = 12")
def q_union_by_id(spark, d):
    return _union(engine(spark, d).fetch_union_object(USER, ORG, 12))


@query(f"SELECT * FROM {_UNION} WHERE id IN (1, 2, 50)")
def q_union_by_ids(spark, d):
    return _union(engine(spark, d).fetch_union_objects(USER, ORG, [1, 2, 50]))


@query(f"SELECT * FROM {_UNION} WHERE owner = 7")
def q_union_owned(spark, d):
    return _union(engine(spark, d).fetch_owned_union_objects(USER, ORG, 7))


@query(f"SELECT * FROM {_UNION} WHERE owner = 7 ORDER BY id, type LIMIT 1")
def q_union_owned_one(spark, d):
    return _union(engine(spark, d).fetch_owned_union_object(USER, ORG, 7))


# views, constraints, changes


@query("SELECT id, username, segment FROM users")
def q_view_card(spark, d):
    return USER.view("card", engine(spark, d).catalog[USER])


@query("SELECT id, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at, username, segment FROM users")
def q_view_public(spark, d):
    return USER.public(engine(spark, d).catalog[USER])


@query("SELECT id, 'user' AS type, 'username' AS field, sha256('user::username::' || username) AS key FROM users")
def q_unique_hash(spark, d):
    return constraints.unique_hashes(engine(spark, d).catalog[USER], USER).where("field = 'username'")


_BY_SEGMENT = ObjectType("post", {"title": "string", "status": "string"}, unique=(("title", "status"),), key="long")


@query("SELECT 'title+status' AS field, sha256('post::title+status::title:' || title || ':status:' || status) AS key, count(*) AS n FROM posts GROUP BY ALL HAVING count(*) > 1")
def q_unique_violations(spark, d):
    return constraints.violations(engine(spark, d).catalog[POST], _BY_SEGMENT)


_ONE_POST = ObjectType("post", {"title": "string"}, unique=(("owner",),), key="long")


@query("SELECT 'owner' AS field, sha256('post::owner::' || CAST(owner AS VARCHAR)) AS key, count(*) AS n FROM posts GROUP BY ALL HAVING count(*) > 1")
def q_unique_owner(spark, d):
    return constraints.violations(engine(spark, d).catalog[POST], _ONE_POST)


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS line, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price, l_shipdate AS shipped FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1")
def q_edge_upsert(spark, d):
    order = [F.col(c).desc() for c in ("line", "supplier", "shipped", "price", "quantity")]
    return constraints.last_writes(engine(spark, d).catalog[CONTAINS], order)


@query("SELECT * FROM users WHERE owner <> 7")
def q_delete_owned(spark, d):
    return _user(mutate.delete_owned_objects(engine(spark, d).catalog[USER], 7)[0])


@query("SELECT * FROM users WHERE NOT (id IN (3, 4, 12) AND owner = (SELECT owner FROM users WHERE id = 4))")
def q_delete_objects(spark, d):
    users = engine(spark, d).catalog[USER]
    owner = users.where("id = 4").first()["owner"]
    return _user(mutate.delete_objects(users, [3, 4, 12], owner)[0])


@query("SELECT id, CASE WHEN id = 4 THEN 99 ELSE owner END AS owner, username, balance, segment FROM users")
def q_transfer(spark, d):
    users = engine(spark, d).catalog[USER]
    owner = users.where("id = 4").first()["owner"]
    return _user(mutate.transfer_object(users, 4, owner, 99)[0])


@query("SELECT id, owner, username, CASE WHEN segment = 'BUILDING' THEN balance + 1 ELSE balance END AS balance, segment FROM users")
def q_update(spark, d):
    users = engine(spark, d).catalog[USER]
    updates = users.where("segment = 'BUILDING'").select("id", (F.col("balance") + 1).alias("balance"))
    return _user(mutate.update_objects(users, updates, USER))


@query("SELECT src, dst, CASE WHEN src = 3 AND dst = 7 THEN 100 ELSE weight END AS weight, notification FROM follows WHERE src <> 9 AND NOT (src = 4 AND dst = 5)")
def q_edge_changes(spark, d):
    follows = engine(spark, d).catalog[FOLLOW]
    return mutate.delete_object_edges(mutate.delete_edge(mutate.update_edge(follows, 3, 7, {"weight": 100}), 4, 5), 9)


def _new_users(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "id long, owner long, username string, balance double, segment string")


@query("SELECT * FROM users UNION ALL SELECT -1, 7, 'new one', CAST(-123456.5 AS DOUBLE), 'BUILDING' UNION ALL SELECT -2, 8, 'new two', CAST(-123457.5 AS DOUBLE), 'BUILDING'")
def q_create_object(spark, d):
    new = _new_users(spark, [(-1, 7, "new one", -123456.5, "BUILDING"), (-2, 8, "new two", -123457.5, "BUILDING")])
    return _user(mutate.create_objects(engine(spark, d).catalog[USER], USER.conform(new), USER))


def _conflicting(spark, users: DataFrame) -> DataFrame:
    taken = users.where("id = 4").first()["username"]
    return USER.conform(_new_users(spark, [(-1, 7, taken, -1e5, "A"), (-3, 7, "x", -2e5, "B"), (-4, 7, "y", -2e5, "B"), (-5, 7, "z", -3e5, "B")]))


@query("SELECT -1 AS id, 'username' AS field UNION ALL SELECT -3, 'segment+balance'")
def q_create_conflicts(spark, d):
    """One name is an old user's; two new ones want the same pair of values, and the lesser id has it."""
    users = engine(spark, d).catalog[USER]
    return constraints.conflicts(users, _conflicting(spark, users), USER)


@query("SELECT -1 AS id, 'username' AS field UNION ALL SELECT -3, 'segment+balance'")
def q_insert_unique_conflicts(spark, d):
    users = engine(spark, d).catalog[USER]
    return constraints.insert_unique_hashes(constraints.unique_hashes(users, USER), _conflicting(spark, users), USER)[1]


@query("SELECT id, 'user' AS type, 'username' AS field, sha256('user::username::' || username) AS key FROM (SELECT id, username FROM users WHERE id <> 4 UNION ALL SELECT -1, 'new one')")
def q_unique_stored(spark, d):
    """Stored hashes after an object came and another's were deleted by key."""
    users = engine(spark, d).catalog[USER]
    stored = constraints.unique_hashes(users, USER)
    stored, _ = constraints.insert_unique_hashes(stored, USER.conform(_new_users(spark, [(-1, 7, "new one", -1e5, "A")])), USER)
    gone = [r["key"] for r in constraints.hashes_of_object(stored, 4).collect()]
    return constraints.delete_unique_hashes(stored, gone).where("field = 'username'").select("id", "type", "field", "key")


@query("SELECT 'username' AS field, sha256('user::username::' || username) AS key FROM users WHERE id = 4")
def q_hashes_of_object(spark, d):
    return constraints.hashes_of_object(constraints.unique_hashes(engine(spark, d).catalog[USER], USER), 4).where("field = 'username'")


@query("SELECT * FROM users WHERE id <> 4")
def q_delete_object(spark, d):
    users = engine(spark, d).catalog[USER]
    kept, _ = mutate.delete_object(users, 4, users.where("id = 4").first()["owner"])
    return _user(mutate.delete_object(kept, 5, -1)[0])  # nobody's: nothing goes


@query("SELECT id, owner, username, CASE id WHEN 4 THEN 2.5 WHEN 5 THEN 7 ELSE balance END AS balance, segment FROM users")
def q_update_repeated(spark, d):
    """Of two updates of one object the greater counts, and the object stays one row."""
    users = engine(spark, d).catalog[USER]
    return _user(mutate.update_objects(users, spark.createDataFrame([(4, 1.5), (4, 2.5), (5, 7.0), (-9, 1.0)], "id long, balance double"), USER))


@query("SELECT * FROM follows WHERE NOT (src = 3 AND dst IN (7, 8)) UNION ALL SELECT 3, 7, 60, true UNION ALL SELECT 3, 8, 1, false UNION ALL SELECT 3, -1, 5, true")
def q_upsert_edges(spark, d):
    follows = engine(spark, d).catalog[FOLLOW]
    rows = [(3, 7, 50, False), (3, 7, 60, True), (3, 8, 1, False), (3, -1, 5, True)]
    return constraints.upsert_edges(follows, spark.createDataFrame(rows, FOLLOW.schema), [F.col("weight").desc()])


@query("SELECT src, CASE WHEN src = 3 AND dst = 7 THEN 9 ELSE dst END AS dst, CASE WHEN src = 3 AND dst = 7 THEN 100 ELSE weight END AS weight, notification FROM follows WHERE NOT (src = 3 AND dst = 9)")
def q_edge_retarget(spark, d):
    """The edge to 7 leads to 9 afterwards, in place of the one that led there."""
    return mutate.update_edge(engine(spark, d).catalog[FOLLOW], 3, 7, {"weight": 100}, to=9)


@query("SELECT * FROM follows")
def q_edge_retarget_missing(spark, d):
    """There is no edge to -7, so the one to 9 stays."""
    return mutate.update_edge(engine(spark, d).catalog[FOLLOW], 3, -7, {"weight": 100}, to=9)


@query("SELECT * FROM (VALUES ('balance', 'double', true, false, true), ('segment', 'string', true, false, false), ('username', 'string', true, true, false)) AS v(field, type, searched, sorted, private)")
def q_fields(spark, d):
    """What a type says of its fields."""
    rows = [(n, t, "search" in USER.indexes.get(n, ()), "sort" in USER.indexes.get(n, ()), n in USER.private) for n, t in USER.fields.items()]
    return spark.createDataFrame(rows, "field string, type string, searched boolean, sorted boolean, private boolean")


@query("SELECT 1 AS id, 7 AS owner, 'a' AS name, 2.5 AS balance")
def q_memory_source(spark, d):
    """Objects of rows in memory."""
    mine = Catalog(spark).rows(ORG, [(1, 7, None, None, "a", 2.5), (2, 8, None, None, "b", 1.0)])
    return Engine(mine).fetch_owned_objects(ORG, 7).select("id", "owner", "name", "balance")


@query("SELECT 'query.rows' AS name, count(*) AS n FROM posts WHERE status = 'F' UNION ALL SELECT 'query_edges.rows', count(*) FROM follows WHERE src = 17")
def q_metrics(spark, d):
    """Rows that two queries gave, counted in their own jobs."""
    metrics = Metrics()
    e = Engine(catalog(spark, d), metrics=metrics)
    for df in (e.query_objects(POST, Query.wide().where_eq("status", "F")), e.query_edges(FOLLOW, 17)):
        df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(metrics.rows().items()), "name string, n long")


# joins and tops


@query("SELECT p.id AS post_id, p.title, p.view_count, u.username FROM posts p JOIN users u ON u.id = p.owner WHERE p.status = 'F' ORDER BY p.view_count DESC, p.id LIMIT 20")
def q_join_top20(spark, d):
    e = engine(spark, d)
    posts = e.query_objects(POST, Query.wide().where_eq("status", "F")).select(F.col("id").alias("post_id"), "owner", "title", "view_count")
    users = e.catalog[USER].select(F.col("id").alias("owner"), "username")
    return posts.join(users, "owner").orderBy(F.col("view_count").desc(), "post_id").limit(20).drop("owner")


@query("SELECT id, owner, view_count, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY view_count DESC, id) AS k FROM posts) WHERE k <= 3")
def q_top3_per_owner(spark, d):
    posts = engine(spark, d).catalog[POST].select("id", "owner", "view_count")
    return constraints.top_per_owner(posts, 3, F.col("view_count").desc())


@query("SELECT id, row_number() OVER (ORDER BY created_at, id) + 100 AS number FROM posts")
def q_sequence_numbers(spark, d):
    posts = engine(spark, d).catalog[POST].select("id", "created_at")
    return numbered(posts, ["created_at", "id"], 101, F.to_date("created_at")).drop("created_at")


# ledger


def _assets(spark, d, table: str, key: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    region = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("asset"))
    user = read("customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias(key), "asset")
    return read(table).join(user, key)


def value_objects(spark, d) -> DataFrame:
    events = _assets(spark, d, "events", "user_id").where("event_type <> 'view'")
    state = F.when(F.col("event_type") == "click", "reserved").when(F.col("event_type") == "error", "burned").otherwise("alive")
    return events.select(F.col("event_id").alias("id"), "asset", F.col("user_id").alias("owner"), F.round(F.col("value") * 100).cast("long").alias("amount"), state.alias("state"), F.col("ts").alias("created_at"))


def transactions(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    orders = _assets(spark, d, "orders", "o_custkey")
    return orders.select(
        F.col("o_orderkey").alias("id"), "asset", F.col("o_custkey").alias("sender"), ((F.col("o_custkey") + 1) % n).alias("receiver"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), F.col("o_orderdate").alias("created_at"),
    )


def assets(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("id"), F.col("r_name").alias("code"), F.lit(2).alias("decimals"))


_SUMS = "CAST(coalesce(sum(amount) FILTER (state = 'alive'), 0) AS BIGINT) AS available, CAST(coalesce(sum(amount) FILTER (state = 'reserved'), 0) AS BIGINT) AS reserved"
_HELD = f"(SELECT owner, asset, available, reserved, available + reserved AS total, (available + reserved) / 100.0::DOUBLE AS quantity FROM (SELECT owner, asset, {_SUMS} FROM objects GROUP BY owner, asset) WHERE available + reserved > 0)"
_RATE = "CASE asset WHEN 'ASIA' THEN 1.5::DOUBLE WHEN 'EUROPE' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END"


def _rates(spark) -> DataFrame:
    return spark.createDataFrame([("ASIA", 1.5), ("EUROPE", 2.0)], "code string, rate double")


@query(f"SELECT asset, owner, available, reserved, available + reserved AS total FROM (SELECT asset, owner, {_SUMS} FROM objects GROUP BY asset, owner)")
def q_balance(spark, d):
    return reads.balances(value_objects(spark, d))


@query(f"SELECT available, reserved, available + reserved AS total FROM (SELECT {_SUMS} FROM objects WHERE owner = 5 AND asset = (SELECT min(asset) FROM objects WHERE owner = 5))")
def q_balance_one(spark, d):
    objects = value_objects(spark, d)
    asset = objects.where("owner = 5").agg(F.min("asset")).first()[0]
    return reads.balance(objects, asset, 5)


@query(f"SELECT owner, asset, asset AS code, 2 AS decimals, available, reserved, total, quantity FROM {_HELD}")
def q_holdings(spark, d):
    return reads.holdings(value_objects(spark, d), assets(spark, d))


@query(f"SELECT owner, round(sum(quantity * {_RATE}), 6) AS value FROM {_HELD} GROUP BY owner")
def q_portfolio_value(spark, d):
    held = reads.holdings(value_objects(spark, d), assets(spark, d))
    return reads.portfolio_value(held, _rates(spark)).select("owner", F.round("value", 6).alias("value"))


@query(f"SELECT owner, asset AS code, quantity, {_RATE} AS rate, quantity * {_RATE} AS value FROM {_HELD} ORDER BY value DESC, owner LIMIT 10")
def q_portfolio_sorted(spark, d):
    held = reads.valued(reads.holdings(value_objects(spark, d), assets(spark, d)), _rates(spark))
    return held.select("owner", "code", "quantity", "rate", "value").orderBy(F.col("value").desc(), "owner").limit(10)


@query("SELECT * FROM txns WHERE (sender = 7 OR receiver = 7) AND created_at BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31'")
def q_txn_by_owner(spark, d):
    return reads.of_owner(transactions(spark, d), 7, datetime.datetime(1993, 1, 1), datetime.datetime(1997, 12, 31))


@query("SELECT * FROM txns WHERE asset = 'ASIA' AND created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def q_txn_by_asset(spark, d):
    return reads.of_asset(transactions(spark, d), "ASIA", datetime.datetime(1995, 1, 1), datetime.datetime(1995, 3, 31))


@query("SELECT t.id, t.asset, t.sender, t.receiver, t.amount, t.created_at FROM txns t WHERE t.id = 77")
def q_txn_idempotent(spark, d):
    txns = transactions(spark, d)
    keys = txns.select(F.sha2(F.concat(F.lit("order-"), F.col("id").cast("string")), 256).alias("key"), F.col("id").alias("transaction_id"))
    return reads.by_idempotency_key(txns, keys, "order-77")


@query("SELECT t.*, asset AS code FROM txns t WHERE id = 123")
def q_txn_get(spark, d):
    return reads.transaction(transactions(spark, d), assets(spark, d), 123)


def _held(spark, d) -> DataFrame:
    return reads.valued(reads.holdings(value_objects(spark, d), assets(spark, d)), _rates(spark)).select("owner", "code", "quantity", "rate", "value")


_VALUED = f"SELECT owner, asset AS code, quantity, {_RATE} AS rate, quantity * {_RATE} AS value FROM {_HELD}"


@query(f"{_VALUED} ORDER BY quantity DESC, code, owner LIMIT 10")
def q_portfolio_largest(spark, d):
    return reads.sorted_holdings(_held(spark, d)).limit(10)


@query(f"{_VALUED} ORDER BY quantity, code, owner LIMIT 10")
def q_portfolio_smallest(spark, d):
    return reads.sorted_holdings(_held(spark, d), largest=False).limit(10)


@query(f"{_VALUED} ORDER BY value DESC, code, owner LIMIT 10")
def q_portfolio_value_desc(spark, d):
    return reads.sorted_holdings(_held(spark, d), "value").limit(10)


@query(f"{_VALUED} ORDER BY value, code, owner LIMIT 10")
def q_portfolio_value_asc(spark, d):
    return reads.sorted_holdings(_held(spark, d), "value", largest=False).limit(10)


@query(f"SELECT * FROM ({_VALUED}) WHERE code = 'ASIA'")
def q_portfolio_get(spark, d):
    return reads.holding(_held(spark, d), "ASIA")


# the ledger's write side, on the tables: what each operation leaves


def _ledger(spark, d) -> Ledger:
    empty = Ledger.empty(spark)
    kinds = {f.name: f.dataType for f in empty.objects.schema}
    objects = value_objects(spark, d).withColumn("reserved_for", F.when(F.col("state") == "reserved", F.col("owner")))
    named = assets(spark, d).withColumn("unit", F.lit(1_000_000).cast("long")).select("id", "code", "unit", "decimals")
    return Ledger(named, objects.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())), empty.transactions, empty.keys)


def _states(ledger: Ledger) -> DataFrame:
    """What each owner has of each asset, by state."""
    sums = (F.coalesce(F.sum(F.when(F.col("state") == s, F.col("amount"))), F.lit(0)).cast("long").alias(s) for s in ("alive", "reserved", "burned"))
    return ledger.objects.groupBy("asset", "owner").agg(*sums)


def _richest(ledger: Ledger, state: str) -> tuple[str, str, int]:
    """The asset and owner with the most in a state, and half of that."""
    row = _states(ledger).orderBy(F.col(state).desc(), "asset", "owner").first()
    return row["asset"], row["owner"], row[state] // 2


_SUM3 = ", ".join(f"CAST(coalesce(sum(amount) FILTER (state = '{s}'), 0) AS BIGINT) AS {s}" for s in ("alive", "reserved", "burned"))
_MINE = ", o AS (SELECT CAST(id AS VARCHAR) AS id, asset, CAST(owner AS VARCHAR) AS owner, amount, state, created_at FROM objects)"
_ALL_OF = f"SELECT asset, owner, {_SUM3} FROM"


def _spending(state: str, *receipts: str) -> str:
    """The richest owner spends half of what is in ``state``: oldest fragments burn, change comes back, and
    receipts (owner, amount, state) arrive."""
    parts = [f"SELECT asset, owner, -t, '{state}' FROM payer, taken", "SELECT asset, owner, t, 'burned' FROM payer, taken", f"SELECT asset, owner, t - need, '{state}' FROM payer, taken"]
    parts += [f"SELECT asset, {r} FROM payer" for r in receipts]
    return f"""{_MINE}, s AS ({_ALL_OF} o GROUP BY asset, owner), payer AS (SELECT asset, owner, {state} // 2 AS need FROM s ORDER BY {state} DESC, asset, owner LIMIT 1),
  run AS (SELECT o.amount, sum(o.amount) OVER (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) - o.amount AS before, need FROM o JOIN payer USING (asset, owner) WHERE state = '{state}'),
  taken AS (SELECT sum(amount) AS t FROM run WHERE before < need), later AS (SELECT asset, owner, amount, state FROM o UNION ALL {" UNION ALL ".join(parts)})
  {_ALL_OF} later GROUP BY asset, owner"""


@query(f"{_MINE} {_ALL_OF} (SELECT asset, owner, amount, state FROM o UNION ALL SELECT 'ASIA', 'shop', 2500000, 'alive') GROUP BY asset, owner")
def q_ledger_mint(spark, d):
    return _states(_ledger(spark, d).atomic(lambda p: p.mint("ASIA", "shop", 2_500_000), _NOW))


@query("SELECT amount, count(*) AS n FROM (VALUES (1000000), (1000000), (500000)) AS v(amount) GROUP BY amount")
def q_ledger_mint_fragments(spark, d):
    after = _ledger(spark, d).atomic(lambda p: p.mint("ASIA", "shop", 2_500_000), _NOW)
    return after.objects.where("owner = 'shop'").groupBy("amount").agg(F.count("*").alias("n"))


@query(_spending("alive", "'shop', need - 100, 'alive'"))
def q_ledger_transfer(spark, d):
    """Money is sliced: a fee is burned, the rest goes to the shop, change comes back."""
    start = _ledger(spark, d)
    asset, owner, amount = _richest(start, "alive")

    def pay(p):
        part = p.money(asset, owner, amount).slice(amount)
        fee = part.slice(100)
        part.transfer_to("shop")
        fee.burn()

    return _states(start.atomic(pay, _NOW))


@query(_spending("alive", "'court', need, 'reserved'"))
def q_ledger_reserve(spark, d):
    start = _ledger(spark, d)
    asset, owner, amount = _richest(start, "alive")
    return _states(start.atomic(lambda p: p.reserve(asset, owner, "court", amount), _NOW))


@query(_spending("reserved", "'bob', need, 'alive'"))
def q_ledger_settle(spark, d):
    """Of what is reserved the oldest burns, and its change stays reserved."""
    start = _ledger(spark, d)
    asset, owner, amount = _richest(start, "reserved")
    return _states(start.atomic(lambda p: p.settle(asset, owner, "bob", amount), _NOW))


@query(_spending("alive"))
def q_ledger_burn(spark, d):
    start = _ledger(spark, d)
    asset, owner, amount = _richest(start, "alive")
    return _states(start.atomic(lambda p: p.burn(asset, owner, amount), _NOW))


@query("SELECT 'ASIA' AS asset, CAST(NULL AS VARCHAR) AS sender, 'ann' AS receiver, 0 AS burned_amount, 500 AS minted_amount, sha256('once') AS key, true AS refused")
def q_ledger_idempotent(spark, d):
    """Minted once, and a second time with the same key, which is refused and leaves no trace."""
    after, refused = _ledger(spark, d).atomic(lambda p: p.mint("ASIA", "ann", 500, key="once"), _NOW), False
    try:
        after.atomic(lambda p: p.mint("ASIA", "ann", 500, key="once"), _NOW)
    except DuplicateIdempotencyKey:
        refused = True
    keys = after.keys.select(F.col("transaction_id").alias("id"), "key")
    return after.transactions.join(keys, "id").select("asset", "sender", "receiver", "burned_amount", "minted_amount", "key", F.lit(refused).alias("refused"))


@query(f"{_MINE}, s AS ({_ALL_OF} o GROUP BY asset, owner), p AS (SELECT asset, owner, alive // 2 AS need FROM s ORDER BY alive DESC, asset, owner LIMIT 1) SELECT asset, CAST(NULL AS VARCHAR) AS sender, 'shop' AS receiver, 0 AS burned_amount, 7 AS minted_amount FROM p UNION ALL SELECT asset, owner, 'shop', need, need FROM p UNION ALL SELECT asset, owner, NULL, 10, 0 FROM p")
def q_ledger_journal(spark, d):
    """The transactions of a plan of three operations."""
    start = _ledger(spark, d)
    asset, owner, amount = _richest(start, "alive")

    def make(p):
        p.mint(asset, "shop", 7)
        p.money(asset, owner, amount).slice(amount).transfer_to("shop")
        p.burn(asset, owner, 10)

    return start.atomic(make, _NOW).transactions.select("asset", "sender", "receiver", "burned_amount", "minted_amount")


@query("SELECT r_name AS id, r_name AS code, CAST(CASE r_name WHEN 'ASIA' THEN 500 ELSE 1000000 END AS BIGINT) AS unit, CASE r_name WHEN 'ASIA' THEN 3 ELSE 2 END AS decimals FROM region")
def q_ledger_create_asset(spark, d):
    """An asset of a known code changes and keeps its id."""
    return _ledger(spark, d).create_asset("ASIA", 500, 3).assets.select("id", "code", "unit", "decimals")


@query(f"SELECT asset, owner, CAST(300000 AS BIGINT) AS required, available FROM (SELECT asset, owner, {_SUMS} FROM objects GROUP BY asset, owner) WHERE available < 300000")
def q_shortfalls(spark, d):
    objects = value_objects(spark, d)
    return frag.shortfalls(objects, objects.select("asset", "owner", F.lit(300000).cast("long").alias("required")).distinct())


@query("SELECT a AS old, b AS new, (a, b) IN (('alive', 'reserved'), ('alive', 'burned'), ('reserved', 'alive'), ('reserved', 'burned')) AS allowed FROM (VALUES ('alive'), ('reserved'), ('burned')) AS x(a), (VALUES ('alive'), ('reserved'), ('burned')) AS y(b)")
def q_state_machine(spark, d):
    states = ("alive", "reserved", "burned")
    pairs = spark.createDataFrame([(a, b) for a in states for b in states], "old string, new string")
    return pairs.withColumn("allowed", may_become(F.col("old"), F.col("new")))


_LOCKED = "SELECT *, CAST(sum(amount) OVER (PARTITION BY asset, owner ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) - amount AS before FROM objects WHERE state = 'alive'"


@query(f"SELECT id, asset, owner, amount, before FROM ({_LOCKED}) WHERE before < 5000")
def q_fifo_select(spark, d):
    objects = value_objects(spark, d)
    locks = objects.select("asset", "owner", F.lit(5000).cast("long").alias("required")).distinct()
    return frag.fifo_select(objects, locks).select("id", "asset", "owner", "amount", "before")


@query("SELECT id, CAST(i - 1 AS INTEGER) AS position, CAST(least(c, amount - (i - 1) * c) AS BIGINT) AS fragment FROM (SELECT id, amount, greatest(1000000, CAST(ceil(amount / 20.0) AS BIGINT)) AS c FROM txns), unnest(range(1, CAST(ceil(amount / CAST(c AS DOUBLE)) AS BIGINT) + 1)) AS u(i)")
def q_fragment(spark, d):
    return frag.fragments(transactions(spark, d).select("id", "amount", F.lit(1000000).cast("long").alias("unit")), 20)


@query(f"SELECT o.id, o.asset, o.owner, o.amount, CASE WHEN l.before < 5000 AND s.total >= 5000 THEN 'burned' ELSE o.state END AS state FROM objects o LEFT JOIN ({_LOCKED}) l ON l.id = o.id LEFT JOIN (SELECT asset, owner, sum(amount) AS total FROM objects WHERE state = 'alive' GROUP BY asset, owner) s ON s.asset = o.asset AND s.owner = o.owner")
def q_burn_state(spark, d):
    """Every owner that can pays 5000: the state of all fragments afterwards."""
    objects = value_objects(spark, d)
    locks = objects.select("asset", "owner", F.lit(5000).cast("long").alias("required")).distinct()
    payable = locks.join(frag.shortfalls(objects, locks), ["asset", "owner"], "left_anti")
    spent = frag.fifo_select(objects, payable).select(F.col("id").alias("spent"))
    state = F.when(F.col("spent").isNotNull(), "burned").otherwise(F.col("state"))
    return objects.join(spent, F.col("id") == F.col("spent"), "left").select("id", "asset", "owner", "amount", state.alias("state"))


@query(f"SELECT asset, owner, CAST(sum(amount) - 5000 AS BIGINT) AS amount, count(*) AS most FROM ({_LOCKED}) l WHERE before < 5000 GROUP BY asset, owner HAVING sum(amount) > 5000")
def q_change(spark, d):
    """What comes back to each owner that pays 5000."""
    objects = value_objects(spark, d)
    locks = objects.select("asset", "owner", F.lit(5000).cast("long").alias("required")).distinct()
    taken = frag.fifo_select(objects, locks)
    return taken.groupBy("asset", "owner").agg((F.sum("amount") - F.first("required")).alias("amount"), F.count("*").alias("most")).where("amount > 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
