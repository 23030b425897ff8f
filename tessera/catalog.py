"""Queries over the relational tables, one per operator, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .functions import dates, documents, keys
from .functions.handles import Handle, Qualified, and_, not_, or_, raw, true, where_if
from .operators import aggregate as agg
from .operators import bulk
from .operators.bulk import changed_columns
from .operators.include import Include
from .operators.paging import encode_cursor, keyset_frame, offset_page_meta
from .plans.engine import Engine, Repo
from .plans.query import Query
from .schema.diff import converted, diff, rebuilt
from .schema.migrate import Migrator, between
from .sources.rawsql import raw_query
from .sources.store import Changes, Store
from .spec import ModelSpec, RelationSpec, column, model
from .streaming import events as log
from .streaming import inbox, outbox, run, windows
from .unit import Session, Units

REGION = model("region", column("r_regionkey", "int"), column("r_name", "string"), key="r_regionkey")
NATION = model(
    "nation", column("n_nationkey", "int"), column("n_name", "string"), column("n_regionkey", "int"), key="n_nationkey",
    relations=(RelationSpec("region", "belongs_to", REGION, "n_regionkey"), RelationSpec("customers", "has_many", lambda: CUSTOMER, "c_nationkey")),
)
CUSTOMER = model(
    "customer", column("c_custkey", "long"), column("c_name", "string"), column("c_nationkey", "int"), column("c_acctbal", "double"), column("c_mktsegment", "string"), key="c_custkey",
    relations=(RelationSpec("nation", "belongs_to", NATION, "c_nationkey"), RelationSpec("orders", "has_many", lambda: ORDERS, "o_custkey"), RelationSpec("latest", "has_one", lambda: ORDERS, "o_custkey")),
)
ORDERS = model(
    "orders", column("o_orderkey", "long"), column("o_custkey", "long"), column("o_orderstatus", "string"), column("o_totalprice", "double"), column("o_orderdate", "timestamp_ntz"), column("o_orderpriority", "string"), key="o_orderkey",
    relations=(RelationSpec("customer", "belongs_to", CUSTOMER, "o_custkey"), RelationSpec("items", "has_many", lambda: LINEITEM, "l_orderkey"), RelationSpec("parts", "many_to_many", lambda: PART, "l_orderkey", "lineitem", "l_partkey")),
)
PART = model("part", column("p_partkey", "long"), column("p_name", "string"), column("p_brand", "string"), column("p_type", "string"), column("p_size", "int"), column("p_retailprice", "double"), key="p_partkey")
SUPPLIER = model("supplier", column("s_suppkey", "long"), column("s_name", "string"), column("s_nationkey", "int"), column("s_acctbal", "double"), key="s_suppkey", relations=(RelationSpec("nation", "belongs_to", NATION, "s_nationkey"),))
#: The table has no key of its own; these columns are its ordering, and ties in them are equal in all that the queries show.
LINEITEM = model(
    "lineitem", column("l_orderkey", "long"), column("l_partkey", "long"), column("l_suppkey", "long"), column("l_linenumber", "int"), column("l_quantity", "double"), column("l_extendedprice", "double"), column("l_discount", "double"),
    column("l_tax", "double"), column("l_returnflag", "string"), column("l_linestatus", "string"), column("l_shipdate", "timestamp_ntz"), key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"),
)
EVENTS = model("events", column("event_id", "long"), column("ts", "timestamp_ntz"), column("user_id", "long"), column("event_type", "string", values=("click", "error", "purchase", "signup", "view")), column("value", "double"), column("props", "string"), key="event_id")
CONVERSATIONS = model("conversations", column("conv_id", "long"), column("turn", "long"), column("role", "string"), column("text", "string"), key=("conv_id", "turn"))
#: Orders whose finished ones count as deleted.
LIVE_ORDERS = replace(ORDERS, filters={"live": Handle("o_orderstatus").neq("F")})
#: Orders whose lowest priority counts as unknown.
RANKED = replace(ORDERS, table="ranked_orders", columns=(*ORDERS.columns, column("priority", "string", nullable=True)), relations=())

STATUS, PRICE, KEY, CUST, ORDERED, PRIORITY = (ORDERS.c(n) for n in ("o_orderstatus", "o_totalprice", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"))
NAME, SEGMENT, BALANCE = CUSTOMER.c("c_name"), CUSTOMER.c("c_mktsegment"), CUSTOMER.c("c_acctbal")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, f"parquet:{sf_dir}")
    return e.register("ranked_orders", lambda: e.table("orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW"))))


def query(sql: str, name: str | None = None) -> Callable:
    """Registers a function of an engine with its SQL."""

    def wrap(f: Callable[[Engine], DataFrame]) -> Callable[[Engine], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(engine(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return wrap


def orders(e: Engine) -> Query:
    return e.repo(ORDERS).query()


ORDER_COLUMNS = ", ".join(ORDERS.names)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


@query("""SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS sum_price FROM orders JOIN customer ON o_custkey = c_custkey
          WHERE o_orderstatus = 'O' GROUP BY c_mktsegment ORDER BY c_mktsegment""", "flagship")
def _flagship(e: Engine) -> DataFrame:
    q = orders(e).where(STATUS.eq("O")).inner_join(CUSTOMER, Qualified("orders.o_custkey").eq_col(Qualified("customer.c_custkey"))).order_by(SEGMENT.asc())
    return q.group_by([SEGMENT], [agg.count_star().as_("n_orders"), agg.sum_("o_totalprice").as_("s")]).select("c_mktsegment", "n_orders", F.round("s", 2).alias("sum_price"))


# ---- scan and projection

query("SELECT * FROM nation", "scan_all")(lambda e: e.repo(NATION).query().df())
query("SELECT o_orderkey, o_totalprice FROM orders", "select_cols")(lambda e: orders(e).select(KEY, PRICE))
query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "select_distinct")(lambda e: orders(e).distinct().select(STATUS, PRIORITY))
query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", "select_qualified_join")(
    lambda e: orders(e).where(PRICE.gt(300000)).inner_join(CUSTOMER, Qualified("orders.o_custkey").eq_col(Qualified("customer.c_custkey"))).select("orders.o_orderkey", "customer.c_name")
)
query("SELECT r_regionkey, upper(r_name) AS name FROM region WHERE r_regionkey > 1", "raw_query")(
    lambda e: raw_query(e.spark, "SELECT r_regionkey, upper(r_name) AS name FROM {r} WHERE r_regionkey > $1 AND $1 = $1", 1, r=e.table("region"))
)

# ---- predicates: name, predicate, SQL

DAY = datetime(1996, 1, 1)
for _name, _p, _sql in [
    ("eq", STATUS.eq("O"), "o_orderstatus = 'O'"), ("neq", STATUS.neq("O"), "o_orderstatus <> 'O'"),
    ("gt", PRICE.gt(250000), "o_totalprice > 250000"), ("gte", PRICE.gte(250000), "o_totalprice >= 250000"),
    ("lt", PRICE.lt(5000), "o_totalprice < 5000"), ("lte", PRICE.lte(5000), "o_totalprice <= 5000"),
    ("between_num", PRICE.between(1000, 9000), "o_totalprice BETWEEN 1000 AND 9000"),
    ("between_time", ORDERED.between(DAY, datetime(1996, 2, 1)), "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-02-01'"),
    ("before_after", and_(ORDERED.after(DAY), ORDERED.before(datetime(1996, 3, 1))), "o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'"),
    ("in_list", PRIORITY.in_("1-URGENT", "2-HIGH"), "o_orderpriority IN ('1-URGENT', '2-HIGH')"), ("in_empty", PRIORITY.in_(), "FALSE"),
    ("not_in", PRIORITY.not_in("1-URGENT", "2-HIGH"), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"), ("not_in_empty", PRIORITY.not_in(), "TRUE"),
    ("like", PRIORITY.like("_-H%"), "o_orderpriority LIKE '_-H%'"), ("ilike", PRIORITY.ilike("%urGENt"), "o_orderpriority ILIKE '%urGENt'"),
    ("contains_wildcard", PRIORITY.contains("-_IGH"), "o_orderpriority LIKE '%-_IGH%'"), ("has_prefix", PRIORITY.has_prefix("3-"), "o_orderpriority LIKE '3-%'"), ("has_suffix", PRIORITY.has_suffix("LOW"), "o_orderpriority LIKE '%LOW'"),
    ("and_or_not", (STATUS.eq("O") & PRICE.gt(200000)) | ~PRIORITY.in_("1-URGENT", "5-LOW", "2-HIGH"), "(o_orderstatus = 'O' AND o_totalprice > 200000) OR NOT o_orderpriority IN ('1-URGENT', '5-LOW', '2-HIGH')"),
    ("and_empty", and_(), "TRUE"), ("or_empty", or_(), "FALSE"), ("or_with_noop", or_(true(), STATUS.eq("F")), "o_orderstatus = 'F'"), ("not_true", not_(true()), "FALSE"),
    ("where_if", and_(where_if(True, STATUS.eq("P")), where_if(False, PRICE.lt(0))), "o_orderstatus = 'P'"),
    ("raw_predicate", or_(raw("o_totalprice * ? > ? AND o_orderpriority <> '?'", 2, 800000), KEY.eq(7)), "o_totalprice * 2 > 800000 OR o_orderkey = 7"),
    ("eq_null", STATUS.eq(None), "o_orderstatus = NULL"),
]:
    query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE {_sql}", _name)(lambda e, p=_p: orders(e).where(p).df())

_RANKED_SQL = "(SELECT *, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)"
for _name, _p, _sql in [
    ("is_null", RANKED.c("priority").is_null(), "priority IS NULL"), ("is_not_null", RANKED.c("priority").is_not_null(), "priority IS NOT NULL"),
    ("not_in_null_col", RANKED.c("priority").not_in("1-URGENT"), "priority NOT IN ('1-URGENT')"), ("neq_null_col", RANKED.c("priority").neq("1-URGENT"), "priority <> '1-URGENT'"),
]:
    query(f"SELECT o_orderkey, priority FROM {_RANKED_SQL} WHERE {_sql}", _name)(lambda e, p=_p: e.repo(RANKED).where(p).select("o_orderkey", "priority"))

_FLAGGED = replace(LINEITEM, table="flagged", columns=(*LINEITEM.columns, column("returned", "boolean", nullable=True)))
for _name, _p, _sql in [("bool_true", _FLAGGED.c("returned").is_true(), "l_returnflag = 'R'"), ("bool_false", _FLAGGED.c("returned").is_false(), "l_returnflag = 'A'")]:
    query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {_sql}", _name)(
        lambda e, p=_p: e.register("flagged", e.table("lineitem").withColumn("returned", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R"))).repo(_FLAGGED).where(p).select("l_orderkey", "l_linenumber", "l_partkey")
    )

query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderkey = 42", "find_pk")(lambda e: e.repo(ORDERS).find_query(42).df())
query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1", "find_composite_pk")(lambda e: e.repo(CONVERSATIONS).find_query(3, 1).select("conv_id", "turn", "role"))

# ---- named filters

query("SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'", "soft_delete_default")(lambda e: e.repo(LIVE_ORDERS).query().count_df())
query("SELECT count(*) AS n FROM orders", "unscoped")(lambda e: e.repo(LIVE_ORDERS).unscoped().count_df())
query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000", "without_filter")(lambda e: e.repo(LIVE_ORDERS).without_filter("live").where(PRICE.gt(1000)).count_df())

# ---- joins

_TO_CUSTOMER = Qualified("orders.o_custkey").eq_col(Qualified("customer.c_custkey"))
query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "inner_join")(lambda e: orders(e).inner_join("customer", _TO_CUSTOMER).select("orders.o_orderkey", "customer.c_name"))
query("SELECT o_orderkey, coalesce(l_partkey, -1) AS l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", "left_join")(
    lambda e: orders(e).left_join("lineitem", Qualified("orders.o_orderkey").eq_col(Qualified("lineitem.l_orderkey"))).select("orders.o_orderkey", "lineitem.l_partkey").na.fill(-1, "l_partkey")
)
query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL", "left_join_unmatched")(
    lambda e: orders(e).left_join("lineitem", Qualified("orders.o_orderkey").eq_col(Qualified("lineitem.l_orderkey"))).where(Qualified("lineitem.l_orderkey").is_null()).select("orders.o_orderkey")
)
query("""SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""", "multi_join")(
    lambda e: orders(e).inner_join("customer", _TO_CUSTOMER).inner_join("nation", Qualified("customer.c_nationkey").eq_col(Qualified("nation.n_nationkey"))).inner_join("region", Qualified("nation.n_regionkey").eq_col(Qualified("region.r_regionkey")))
    .group_by(["region.r_name"], [agg.count_star().as_("n")])
)
query("SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "join_group")(
    lambda e: e.repo(CUSTOMER).inner_join("nation", Qualified("customer.c_nationkey").eq_col(Qualified("nation.n_nationkey"))).group_by(["nation.n_name"], [agg.count_star().as_("n"), agg.avg("c_acctbal").as_("a")]).select("n_name", "n", F.round("a", 6).alias("avg_bal"))
)
query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "semi_keys")(
    lambda e: e.repo(CUSTOMER).where_in("c_custkey", orders(e).where(PRICE.gt(400000)), "o_custkey").select("c_custkey")
)
query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "anti_keys")(
    lambda e: e.repo(CUSTOMER).where_not_in("c_custkey", orders(e).where(PRICE.gt(400000)), "o_custkey").select("c_custkey")
)

# ---- aggregates

query("SELECT round(sum(o_totalprice), 2) AS total FROM orders", "sum")(lambda e: orders(e).aggregate(agg.sum_("o_totalprice").as_("t")).select(F.round("t", 2).alias("total")))
query("SELECT coalesce(sum(o_totalprice), 0) AS total FROM orders WHERE o_orderkey < 0", "sum_empty_zero")(lambda e: orders(e).where(KEY.lt(0)).aggregate(agg.sum_("o_totalprice").as_("total")))
query("SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total FROM part WHERE p_size > 10", "sum_int")(lambda e: e.repo(PART).where(PART.c("p_size").gt(10)).aggregate(agg.sum_("p_size").as_("total")))
query("SELECT round(avg(o_totalprice), 6) AS mean FROM orders", "avg")(lambda e: orders(e).aggregate(agg.avg("o_totalprice").as_("m")).select(F.round("m", 6).alias("mean")))
query("SELECT avg(o_totalprice) AS mean FROM orders WHERE o_orderkey < 0", "avg_empty_null")(lambda e: orders(e).where(KEY.lt(0)).aggregate(agg.avg("o_totalprice").as_("mean")))
query("SELECT min(o_totalprice) AS low FROM orders", "min")(lambda e: orders(e).aggregate(agg.min_("o_totalprice").as_("low")))
query("SELECT max(o_orderdate) AS high FROM orders", "max")(lambda e: orders(e).aggregate(agg.max_("o_orderdate").as_("high")))
query(f"SELECT count(priority) AS n FROM {_RANKED_SQL}", "count_col")(lambda e: e.repo(RANKED).query().aggregate(agg.count_col("priority").as_("n")))
query("SELECT count(*) AS n FROM orders", "count_star")(lambda e: orders(e).aggregate(agg.count_star().as_("n")))
query("SELECT count(DISTINCT o_custkey) AS n FROM orders", "count_distinct")(lambda e: orders(e).aggregate(agg.count_distinct("o_custkey").as_("n")))
query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'", "count_terminal_ignores_limit")(lambda e: orders(e).where(STATUS.eq("O")).order_by(KEY.asc()).skip(3).limit(5).count_df())
query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS found", "exists")(lambda e: orders(e).where(PRICE.gt(100000)).base().limit(1).agg((F.count(F.lit(1)) > 0).alias("found")))
query("SELECT round(sum(o_totalprice), 2) AS total FROM orders", "aggregate_ignores_limit")(lambda e: orders(e).order_by(KEY.asc()).limit(3).skip(1).aggregate(agg.sum_("o_totalprice").as_("t")).select(F.round("t", 2).alias("total")))
query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", "group_by")(lambda e: orders(e).group_by([STATUS], [agg.count_star().as_("n")]))
query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL", "group_by_multi")(
    lambda e: orders(e).group_by([STATUS, PRIORITY], [agg.count_star().as_("n"), agg.max_("o_totalprice").as_("top"), agg.count_distinct("o_custkey").as_("customers")])
)
query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", "group_having_raw")(lambda e: orders(e).group_by([CUST], [agg.count_star().as_("n")], having=raw("n > ?", 15)))
query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 2", "group_order_limit")(
    lambda e: orders(e).order_by(Handle("n").desc(), CUST.asc()).limit(10).skip(2).group_by([CUST], [agg.count_star().as_("n")])
)

# ---- order and limit: position is shown, so that order counts

query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20", "order_multi")(lambda e: orders(e).order_by(PRIORITY.asc()).order_by(PRICE.desc(), KEY.asc()).limit(20).select(KEY))
query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20", "order_desc")(lambda e: orders(e).order_by(ORDERED.desc(), KEY.desc()).limit(20).select(KEY))
_PRIORITY = RANKED.c("priority")
query(f"SELECT o_orderkey, priority FROM {_RANKED_SQL} ORDER BY priority DESC NULLS FIRST, o_orderkey LIMIT 20", "nulls_first")(lambda e: e.repo(RANKED).order_by(_PRIORITY.desc().nulls_first(), KEY.asc()).limit(20).select("o_orderkey", "priority"))
query(f"SELECT o_orderkey, priority FROM {_RANKED_SQL} ORDER BY priority ASC NULLS LAST, o_orderkey DESC LIMIT 20", "nulls_last")(lambda e: e.repo(RANKED).order_by(_PRIORITY.asc().nulls_last(), KEY.desc()).limit(20).select("o_orderkey", "priority"))
query(f"SELECT o_orderkey, priority FROM {_RANKED_SQL} ORDER BY priority ASC NULLS FIRST, o_orderkey LIMIT 20", "nulls_default")(lambda e: e.repo(RANKED).order_by(_PRIORITY.asc(), KEY.asc()).limit(20).select("o_orderkey", "priority"))
query(f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_orderkey LIMIT 25", "limit")(lambda e: orders(e).order_by(KEY.asc()).limit(25).df())
query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30", "skip_take")(lambda e: orders(e).order_by(KEY.asc()).skip(30).take(10).select(KEY))
query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", "first")(lambda e: orders(e).where(STATUS.eq("P")).order_by(PRICE.desc(), KEY.asc()).limit(1).df())
query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", "top_k")(
    lambda e: orders(e).where(STATUS.eq("O"), PRICE.gte(1000)).order_by(PRICE.desc(), KEY.asc()).limit(50).select(KEY, PRICE)
)

# ---- nested relations: lists are shown as text

query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2", "per_parent_limit")(
    lambda e: e.repo(CUSTOMER).query().include(Include("orders").only("o_orderkey", "o_custkey").order_by(PRICE.desc()).limit(2)).select(F.explode("orders").alias("o")).select("o.o_orderkey", "o.o_custkey")
)


def _listed(c: str, field: str) -> list:
    return [F.size(c).cast("long").alias("n"), F.array_join(F.transform(c, lambda x: x[field].cast("string")), ",").alias("listed")]


_HAS_MANY = """SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), '') AS listed
               FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey {where} GROUP BY o_orderkey"""
_ITEMS = Include("items").only("l_partkey").order_by(LINEITEM.c("l_linenumber").asc(), LINEITEM.c("l_partkey").asc(), LINEITEM.c("l_suppkey").asc(), LINEITEM.c("l_quantity").asc())
query(_HAS_MANY.format(where=""), "include_has_many")(lambda e: orders(e).include(_ITEMS).select("o_orderkey", *_listed("items", "l_partkey")))
query("SELECT o_orderkey, CAST(0 AS BIGINT) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "include_has_many_empty")(
    lambda e: orders(e).include(Include("items")).where(F.size("items") == 0).select("o_orderkey", F.size("items").cast("long").alias("n"))
)
query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON c_custkey = o_custkey AND rn = 1
         """, "include_has_one")(lambda e: e.repo(CUSTOMER).query().include(Include("latest").order_by(ORDERED.asc(), KEY.asc())).select("c_custkey", F.col("latest.o_orderkey").alias("o_orderkey")))
query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "include_belongs_to")(lambda e: orders(e).include(Include("customer")).select("o_orderkey", "customer.c_name"))
query("""SELECT o_orderkey, count(p_partkey) AS n, coalesce(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_name, p_partkey), '') AS listed FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey
         LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey""", "include_m2m")(lambda e: orders(e).include(Include("parts").only("p_partkey").order_by(PART.c("p_name").asc())).select("o_orderkey", *_listed("parts", "p_partkey")))
query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_items FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey""", "include_nested")(
    lambda e: e.repo(CUSTOMER).query().include(Include("orders").only("o_orderkey").then(Include("items").only("l_linenumber"))).select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.aggregate("orders", F.lit(0), lambda a, x: a + F.size(x["items"])).cast("long").alias("n_items"))
)
query("""SELECT r_name, n_name, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""", "include_two")(
    lambda e: e.repo(NATION).query().include(Include("region"), Include("customers")).select("region.r_name", "n_name", F.size("customers").cast("long").alias("n"))
)
query(_HAS_MANY.format(where="AND l_quantity > 25"), "include_filtered")(lambda e: orders(e).include(_ITEMS.where(LINEITEM.c("l_quantity").gt(25))).select("o_orderkey", *_listed("items", "l_partkey")))
_LIVE_CUSTOMER = replace(CUSTOMER, relations=(RelationSpec("orders", "has_many", LIVE_ORDERS, "o_custkey"),))
query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'F' GROUP BY c_custkey", "include_scoped")(
    lambda e: e.repo(_LIVE_CUSTOMER).query().include(Include("orders")).select("c_custkey", F.size("orders").cast("long").alias("n"))
)
query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "include_unscoped")(
    lambda e: e.repo(_LIVE_CUSTOMER).query().include(Include("orders").unscoped()).select("c_custkey", F.size("orders").cast("long").alias("n"))
)

# ---- paging

query("SELECT count(*) AS total, CAST(3 AS BIGINT) AS page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 60 < count(*) AS has_more FROM orders WHERE o_orderstatus = 'O'", "page_offset_meta")(
    lambda e: offset_page_meta(orders(e).where(STATUS.eq("O")).order_by(KEY.asc()).skip(40).take(20))
)
_BY_PRICE = [PRICE.desc(), KEY.asc()]
query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 21", "keyset_page1")(lambda e: keyset_frame(orders(e).order_by(PRIORITY.asc()).limit(20))[0].select(KEY.name))
query("SELECT o_orderkey FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 500) ORDER BY o_orderpriority, o_orderkey LIMIT 21", "keyset_page2")(
    lambda e: keyset_frame(orders(e).order_by(PRIORITY.asc()).limit(20).after(encode_cursor(["o_orderpriority", "o_orderkey"], ["2-HIGH", 500])))[0].select(KEY.name)
)
query("SELECT o_orderkey FROM orders WHERE o_orderpriority < '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey < 500) ORDER BY o_orderpriority DESC, o_orderkey DESC LIMIT 21", "keyset_before")(
    lambda e: keyset_frame(orders(e).order_by(PRIORITY.asc()).limit(20).before(encode_cursor(["o_orderpriority", "o_orderkey"], ["2-HIGH", 500])))[0].select(KEY.name)
)
query("""SELECT o_orderkey FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND (o_totalprice < 100000 OR (o_totalprice = 100000 AND o_orderkey > 5)))
         ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 21""", "keyset_multi")(
    lambda e: keyset_frame(orders(e).order_by(STATUS.asc(), PRICE.desc()).limit(20).after(encode_cursor(["o_orderstatus", "o_totalprice", "o_orderkey"], ["F", 100000.0, 5])))[0].select(KEY.name)
)
query(f"SELECT o_orderkey, priority FROM {_RANKED_SQL} WHERE priority IS NULL AND o_orderkey > 300 ORDER BY o_orderkey LIMIT 21", "keyset_nullable")(
    lambda e: keyset_frame(e.repo(RANKED).order_by(_PRIORITY.asc().nulls_last()).limit(20).after(encode_cursor(["priority", "o_orderkey"], [None, 300])))[0].select("o_orderkey", "priority")
)

# ---- functions

query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders""", "date_parts")(
    lambda e: orders(e).df().select("o_orderkey", dates.year(F.col("o_orderdate")).alias("y"), dates.month(F.col("o_orderdate")).alias("m"), dates.day(F.col("o_orderdate")).alias("d"), dates.to_text(F.col("o_orderdate")).alias("shown"))
)
query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due FROM orders", "date_add_days")(lambda e: orders(e).df().select("o_orderkey", dates.to_text(dates.add_days(dates.date_of(F.col("o_orderdate")), 30)).alias("due")))
query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01'", "date_of_ts")(
    lambda e: orders(e).df().select("o_orderkey", dates.date_of(F.col("o_orderdate")).alias("day")).where(F.col("day") >= F.lit(date(2000, 6, 1))).withColumn("day", dates.to_text(F.col("day")))
)
query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "json_extract")(lambda e: e.repo(EVENTS).query().df().select("event_id", documents.get(F.col("props"), "$.k", "bigint").alias("k")))
query("SELECT event_id, TRUE AS same FROM events", "json_equal")(lambda e: e.repo(EVENTS).query().df().select("event_id", documents.equal(F.col("props"), F.regexp_replace("props", ":", " : ")).alias("same")))
query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)", "array_explode")(
    lambda e: e.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))
)
query("SELECT event_id, event_type IN ('click', 'error', 'purchase', 'signup') AS valid FROM events", "enum_valid")(
    lambda e: e.repo(EVENTS).query().df().select("event_id", documents.is_member(F.col("event_type"), ("click", "error", "purchase", "signup")).alias("valid"))
)
query("SELECT n_nationkey, '00000000-0000-0000-0000-' || lpad(lower(printf('%x', n_nationkey)), 12, '0') AS u FROM nation", "uuid_normalize")(
    lambda e: e.repo(NATION).query().df().select("n_nationkey", keys.normalize_uuid(F.concat(F.lit("{"), F.lpad(F.hex("n_nationkey"), 32, "0"), F.lit("}"))).alias("u"))
)

# ---- writes: a store gets the rows, operators change them, and the committed table is read back

SOFT_ORDERS = model("soft_orders", *ORDERS.columns, key="o_orderkey", soft_delete=True)
VERSIONED_ORDERS = model("versioned_orders", *ORDERS.columns, key="o_orderkey", versioned=True)
_NEW_ORDERS = "(SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 300 = 0)"
_SOURCE = f"(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 150 = 0 UNION ALL SELECT * FROM {_NEW_ORDERS})"


def _new_orders(e: Engine) -> DataFrame:
    return orders(e).df().where("o_orderkey % 300 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)


def _upsert_source(e: Engine) -> DataFrame:
    return orders(e).df().where("o_orderkey % 150 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(_new_orders(e))


def stored(e: Engine, spec: ModelSpec = ORDERS, **more: StructType) -> Store:
    """A new store in the shared folder that holds a model's table with all orders, and empty tables by name."""
    store = Store(e.spark, run.shared_folder(e.spark))
    changes = store.begin()
    for table, schema in {spec.table: spec.schema(), **more}.items():
        changes.create(table, schema)
    changes.commit()
    store.transact(lambda c: bulk.insert(c, spec, orders(e).df()))
    return store


def written(e: Engine, write: Callable[[Changes, Query], Any], spec: ModelSpec = ORDERS) -> DataFrame:
    """The table after a committed write, which is given the transaction and a query of its rows."""
    store = stored(e, spec)
    store.transact(lambda c: write(c, Repo(e, spec, lambda: c.frame(spec.table)).query()))
    return store.read(spec.table)


def in_session(e: Engine, work: Callable[[Session], Any], spec: ModelSpec) -> DataFrame:
    """The table after a unit of work."""
    store = stored(e, spec)
    Units(store, e).run(work)
    return store.read(spec.table)


query(f"SELECT {ORDER_COLUMNS} FROM orders UNION ALL SELECT * FROM {_NEW_ORDERS}", "bulk_insert_result")(lambda e: written(e, lambda c, q: bulk.insert(c, ORDERS, _new_orders(e))))
query(f"""SELECT coalesce(o.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, s.o_custkey) AS o_custkey, coalesce(o.o_orderstatus, s.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, o.o_totalprice) AS o_totalprice,
          coalesce(o.o_orderdate, s.o_orderdate) AS o_orderdate, coalesce(o.o_orderpriority, s.o_orderpriority) AS o_orderpriority FROM orders o FULL JOIN {_SOURCE} s ON o.o_orderkey = s.o_orderkey""", "upsert_update")(
    lambda e: written(e, lambda c, q: bulk.upsert(c, ORDERS, _upsert_source(e), ("o_orderkey",), ("o_totalprice",)))
)
query(f"SELECT {ORDER_COLUMNS} FROM orders UNION ALL SELECT * FROM {_NEW_ORDERS}", "upsert_do_nothing")(lambda e: written(e, lambda c, q: bulk.upsert(c, ORDERS, _upsert_source(e), ("o_orderkey",), None)))
query(f"SELECT {', '.join('CASE WHEN o_totalprice < 5000 THEN 0 ELSE o_totalprice END AS o_totalprice' if c == 'o_totalprice' else c for c in ORDERS.names)} FROM orders", "bulk_update")(
    lambda e: written(e, lambda c, q: bulk.update(c, q.where(PRICE.lt(5000)), {"o_totalprice": 0.0}))
)
query(f"SELECT {', '.join('o_totalprice + 1 AS o_totalprice' if c == 'o_totalprice' else c for c in ORDERS.names)} FROM orders", "bulk_update_expression")(
    lambda e: written(e, lambda c, q: bulk.update(c, q.all_rows(), {"o_totalprice": bulk.Sql("o_totalprice + ?", (1,))}))
)
query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE NOT (o_orderstatus = 'P')", "bulk_delete")(lambda e: written(e, lambda c, q: bulk.delete(c, q.where(STATUS.eq("P")))))
query("SELECT o_orderkey, o_orderstatus = 'F' AS deleted FROM orders", "soft_delete_apply")(
    lambda e: written(e, lambda c, q: bulk.delete(c, q.where(STATUS.eq("F"))), SOFT_ORDERS).select("o_orderkey", F.col("deleted_at").isNotNull().alias("deleted"))
)
query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "hard_delete")(
    lambda e: written(e, lambda c, q: bulk.delete(c, q.where(STATUS.eq("F")), hard=True), SOFT_ORDERS).where("deleted_at IS NULL").select("o_orderkey")
)


def _touch(s: Session) -> None:
    for row in s.all(s.repo(VERSIONED_ORDERS).where(PRICE.gt(450000))):
        row["o_orderstatus"] = "X"


def _take_away(s: Session) -> None:
    for row in s.all(s.repo(VERSIONED_ORDERS).where(PRICE.gt(450000))):
        s.remove(row)


query("SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, 1 + CAST(o_totalprice > 450000 AS INTEGER) AS version FROM orders", "versioned_update")(
    lambda e: in_session(e, _touch, VERSIONED_ORDERS).select("o_orderkey", "o_orderstatus", "version")
)
query("SELECT o_orderkey, 1 AS version FROM orders WHERE NOT o_totalprice > 450000", "unit_remove")(lambda e: in_session(e, _take_away, VERSIONED_ORDERS).select("o_orderkey", "version"))


def _savepoints(s: Session) -> None:
    kept = s.add(ORDERS, {"o_orderkey": -1, "o_custkey": 1, "o_orderstatus": "N", "o_totalprice": 1.0, "o_orderdate": datetime(2024, 1, 1), "o_orderpriority": "none"})
    try:
        with s.savepoint():
            s.add(ORDERS, {**kept, "o_orderkey": -2})
            s.flush()
            raise LookupError
    except LookupError:
        pass
    with s.savepoint():
        s.add(ORDERS, {**kept, "o_orderkey": -3})


query("SELECT o_orderkey FROM orders UNION ALL SELECT unnest([-1, -3])", "unit_savepoint")(lambda e: in_session(e, _savepoints, ORDERS).select("o_orderkey"))


def _with_events(e: Engine) -> DataFrame:
    store = stored(e, ORDERS, outbox=outbox.OUTBOX)
    units = Units(store, e)
    units.add_sink(outbox.Outbox(mapper=lambda key: ("order_placed", {"key": key}, None)).sink)
    units.insert_with_events(ORDERS, _new_orders(e), lambda rows: sorted(r[0] for r in rows.select("o_orderkey").collect()))
    return store.read("outbox").select("id", "type", "payload")


query(f"""SELECT row_number() OVER (ORDER BY o_orderkey) AS id, 'order_placed' AS type, '{{"key": ' || o_orderkey || '}}' AS payload FROM {_NEW_ORDERS}""", "bulk_insert_with_events")(_with_events)


def _compacted(e: Engine) -> DataFrame:
    store = stored(e)
    store.transact(lambda c: bulk.insert(c, ORDERS, _new_orders(e)))
    store.compact("orders")
    store.vacuum()
    return store.read("orders")


query(f"SELECT {ORDER_COLUMNS} FROM orders UNION ALL SELECT * FROM {_NEW_ORDERS}", "store_compact")(_compacted)
query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'o_orderstatus,' ELSE '' END || 'o_totalprice' AS changed FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus <> 'X'""", "diff_changed_columns")(
    lambda e: changed_columns(
        orders(e).df(), orders(e).df().where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))), ("o_orderkey",)
    ).select("o_orderkey", F.array_join("changed", ",").alias("changed"))
)

# ---- log

_LOG_SQL = "(SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_id AS global_pos, event_id // 10 AS xact_id, event_type, props AS payload, value FROM events)"


def _log(e: Engine) -> DataFrame:
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.table("events").select(F.col("user_id").alias("stream_id"), version.alias("version"), F.col("event_id").alias("global_pos"), F.expr("event_id div 10").alias("xact_id"), "event_type", F.col("props").alias("payload"), "value")


query(f"SELECT stream_id, version, event_type FROM {_LOG_SQL} WHERE stream_id = 7 AND version >= 3", "stream_read")(lambda e: log.read_stream(_log(e), 7, 3).select("stream_id", "version", "event_type"))
query(f"SELECT xact_id, global_pos, event_type FROM {_LOG_SQL} WHERE (xact_id > 20 OR (xact_id = 20 AND global_pos > 205)) AND xact_id < 60 ORDER BY xact_id, global_pos LIMIT 100", "readall_after")(
    lambda e: log.read_all(_log(e), log.Position(20, 205), 100, committed=60).select("xact_id", "global_pos", "event_type")
)
query(f"SELECT stream_id, count(*) AS n_events, max(version) AS version, arg_max(event_type, version) AS last_type FROM {_LOG_SQL} GROUP BY stream_id", "projection_fold")(lambda e: log.fold(_log(e)))


def _outbox(e: Engine) -> DataFrame:
    """Events as messages: some done, some dead, some held, until the middle of the log."""
    k = F.col("event_id")
    return e.table("events").select(
        k.alias("id"), F.col("event_type").alias("type"), F.col("props").alias("payload"), F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("partition_key"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(k % 5 == 0, F.current_timestamp()).alias("processed_at"), F.when(k % 11 == 0, F.lit("other")).alias("claimed_by"), F.when(k % 11 == 0, F.lit(datetime(2100, 1, 1))).cast("timestamp").alias("claimed_until"),
        (k % 7).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.when(k % 7 >= 5, F.current_timestamp()).alias("dead_at"),
    )


_OUTBOX_SQL = "(SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS partition_key, event_id % 11 = 0 AS held FROM events WHERE event_id % 5 <> 0 AND event_id % 7 < 5)"
query(f"SELECT partition_key, min(id) AS first_id FROM {_OUTBOX_SQL} GROUP BY partition_key ORDER BY first_id LIMIT 20", "outbox_candidates")(lambda e: outbox.candidate_keys(_outbox(e), 20))
query(f"""SELECT id, partition_key FROM {_OUTBOX_SQL} o WHERE NOT held AND (partition_key IS NULL OR partition_key NOT IN (SELECT partition_key FROM {_OUTBOX_SQL} WHERE held AND partition_key IS NOT NULL)) ORDER BY id LIMIT 50""", "outbox_claim")(
    lambda e: outbox.claimable(_outbox(e), 50).select("id", "partition_key")
)
query(f"SELECT id, row_number() OVER (PARTITION BY coalesce(partition_key, '#' || id) ORDER BY id) AS turn FROM {_OUTBOX_SQL}", "outbox_order")(lambda e: outbox.publish_order(_outbox(e)).select("id", "turn"))


def _relayed(e: Engine) -> DataFrame:
    """Sign-ups as messages without a key, sent by a relay to a publisher that takes none whose number divides by 7."""
    store = Store(e.spark, run.shared_folder(e.spark))
    store.transact(lambda c: c.create("outbox", outbox.OUTBOX))
    fresh = {"partition_key": None, "processed_at": None, "claimed_by": None, "claimed_until": None, "attempts": 0, "dead_at": None}
    store.transact(lambda c: c.append("outbox", _outbox(e).where("type = 'signup'").withColumns({n: F.lit(v) for n, v in fresh.items()})))

    def publish(m: outbox.Message) -> None:
        if m.id % 7 == 0:
            raise ValueError("down")

    outbox.Relay(store, publish, batch=10_000, attempts=2).drain()
    return store.read("outbox").select("id", F.col("dead_at").isNotNull().alias("dead"), F.col("processed_at").isNotNull().alias("sent"), "attempts", "last_error")


query("SELECT event_id AS id, event_id % 7 = 0 AS dead, event_id % 7 <> 0 AS sent, 1 + CAST(event_id % 7 = 0 AS INTEGER) AS attempts, CASE WHEN event_id % 7 = 0 THEN 'down' END AS last_error FROM events WHERE event_type = 'signup'", "dead_letter")(_relayed)


def _event_store(e: Engine) -> Store:
    """A log with two events for each region's stream, appended by two writers that commit between each other's appends."""
    store = Store(e.spark, run.shared_folder(e.spark))
    events = log.EventLog(store)
    store.transact(events.create)
    regions = [(r["r_regionkey"], r["r_name"]) for r in e.repo(REGION).order_by(REGION.c("r_regionkey").asc()).all()]
    for key, name in regions:
        outer = store.begin()
        events.append(outer, name, 0, ("created", {"key": key}), ("named", {"name": name}))
        store.transact(lambda c, key=key: events.append(c, f"between-{key}", 0, ("passed", {})))
        outer.commit()
    return store


query("""SELECT stream_id, version, row_number() OVER (ORDER BY k, turn, version) AS global_pos, event_type, payload FROM (
           SELECT r_name AS stream_id, 1 AS version, r_regionkey AS k, 1 AS turn, 'created' AS event_type, '{"key": ' || r_regionkey || '}' AS payload FROM region
           UNION ALL SELECT r_name, 2, r_regionkey, 1, 'named', '{"name": "' || r_name || '"}' FROM region UNION ALL SELECT 'between-' || r_regionkey, 1, r_regionkey, 0, 'passed', '{}' FROM region)""", "event_append")(
    lambda e: _event_store(e).read("events").select("stream_id", F.col("version").cast("int").alias("version"), "global_pos", "event_type", "payload")
)


def _projected(e: Engine) -> DataFrame:
    store = _event_store(e)
    store.transact(lambda c: c.create("totals", StructType([StructField("stream_id", StringType()), StructField("n", LongType())])))

    def apply(c: Changes, part: DataFrame) -> None:
        grown = c.frame("totals").unionByName(part.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n")))
        c.rewrite("totals", grown.groupBy("stream_id").agg(F.sum("n").alias("n")))

    log.EventLog(store).project("totals", apply, limit=4)
    return store.read("totals")


query("SELECT r_name AS stream_id, 2 AS n FROM region UNION ALL SELECT 'between-' || r_regionkey, 1 FROM region", "event_projection")(lambda e: _projected(e).select("stream_id", F.col("n").cast("int").alias("n")))


def _inbox(e: Engine) -> tuple[DataFrame, DataFrame]:
    messages = e.table("events").select(F.col("user_id").cast("string").alias("message_id"), F.col("event_type").alias("handler"), "event_id")
    done = messages.where("event_id % 50 = 0").select("message_id", "handler", F.lit(datetime(2024, 1, 1)).alias("processed_at")).distinct()
    return messages, done


query("""SELECT CAST(user_id AS VARCHAR) AS message_id, event_type AS handler, min(event_id) AS event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 50 = 0) GROUP BY ALL""", "inbox_dedupe")(
    lambda e: inbox.fresh(*_inbox(e), order="event_id")
)


def _purged(e: Engine) -> DataFrame:
    store = Store(e.spark, run.shared_folder(e.spark))
    store.transact(lambda c: c.create("inbox", inbox.INBOX))
    seen = e.table("events").select(F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("handler"), F.col("ts").cast("timestamp").alias("received_at"))
    rest = {"processed_at": F.lit(None), "attempts": F.lit(1), "last_error": F.lit(None)}
    store.transact(lambda c: c.append("inbox", seen.withColumns(rest)))
    gone = store.transact(lambda c: inbox.Inbox(store).purge(c, F.lit("2024-01-10").cast("timestamp")))
    return store.read("inbox").select("message_id", F.lit(gone).cast("long").alias("gone"))


query("SELECT CAST(event_id AS VARCHAR) AS message_id, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-10') AS gone FROM events WHERE NOT (ts < TIMESTAMP '2024-01-10')", "purge")(_purged)

# ---- streams, run over what is there


def streaming(sql: str, name: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run.drain(plan(run.source(spark, sf_dir, "events", "ts")), mode)
    ORACLE_SQL[name] = sql


def _measured(s: DataFrame) -> tuple:
    return F.count(F.lit(1)).alias("n"), F.max("value").alias("top")


def _days(df: DataFrame) -> DataFrame:
    return df.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "top")


streaming(
    "SELECT user_id AS stream_id, count(*) AS n_events, max(event_id) AS version, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id", "stream_projection_complete",
    lambda s: log.fold(s.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("version"), "event_type")), "complete",
)
streaming(
    "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(value) AS top FROM events GROUP BY ALL", "stream_tumbling",
    lambda s: _days(windows.tumbling(s, "ts", "1 day", ("event_type",), *_measured(s), lateness="1 hour")), "complete",
)
streaming(
    "SELECT event_type, strftime(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS day, count(*) AS n, max(value) AS top FROM events, range(2) t(k) GROUP BY ALL", "stream_sliding",
    lambda s: _days(windows.sliding(s, "ts", "2 days", "1 day", ("event_type",), *_measured(s), lateness="1 hour")), "complete",
)
streaming(
    """SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n, max(value) AS top
       FROM (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run
             FROM (SELECT *, CAST(coalesce(ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 20 MINUTE, TRUE) AS INTEGER) AS cut FROM events)) GROUP BY event_type, run""", "stream_session",
    lambda s: windows.sessions(s, "ts", "20 minutes", ("event_type",), *_measured(s), lateness="1 hour").select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n", "top"), "complete",
)
streaming(
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS message_id, event_type AS handler FROM events", "stream_dedupe",
    lambda s: inbox.fresh_stream(s.select(F.col("user_id").cast("string").alias("message_id"), F.col("event_type").alias("handler"), "ts"), "ts", "36500 days").select("message_id", "handler"), "append",
)

# ---- schema

query("SELECT o_orderkey, coalesce(CAST(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END, '') AS BIGINT), -1) AS cust FROM orders", "type_change_cast")(
    lambda e: orders(e).df().withColumn("t", F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string"))).select("o_orderkey", converted(F.col("t"), column("t", "string").type, column("t", "long").type, True).alias("cust")).na.fill(-1, "cust")
)
_NEW_PART = ModelSpec("part", (column("p_partkey", "long"), column("title", "string", renamed_from="p_name"), column("p_size", "long"), column("stock", "int", default=0)), ("p_partkey",))
query("SELECT p_partkey, p_name AS title, CAST(p_size AS BIGINT) AS p_size, 0 AS stock FROM part", "table_rebuild_copy")(lambda e: rebuilt(e.table("part"), _NEW_PART))


def _migrated(e: Engine) -> DataFrame:
    """Parts in a store, through a migration, back, and forward again."""
    store = Store(e.spark, run.shared_folder(e.spark))
    migrator = Migrator(store, [between("001", "parts", [], [PART]), between("002", "titles", [PART], [_NEW_PART])])
    migrator.up(1)
    store.transact(lambda c: bulk.insert(c, PART, e.repo(PART).query().df()))
    for _ in range(2):
        migrator.up()
        migrator.down()
    migrator.up()
    return store.read("part")


query("SELECT p_partkey, p_name AS title, CAST(p_size AS BIGINT) AS p_size, 0 AS stock FROM part", "migration_applied")(_migrated)
query("""SELECT * FROM (VALUES ('rename_column', 'title'), ('change_type', 'p_size'), ('add_column', 'stock'), ('drop_column', 'p_brand'), ('drop_column', 'p_type'), ('drop_column', 'p_retailprice')) t(kind, name)""", "schema_diff_ops")(
    lambda e: e.spark.createDataFrame([(op.kind, op.column) for op in diff([PART], [_NEW_PART])], "kind string, name string")
)
