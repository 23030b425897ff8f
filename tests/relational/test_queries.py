import random
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions.handles import Handle, Qualified, and_, marker_positions, not_, or_, raw, true, where_if
from tessera.operators import aggregate as agg
from tessera.operators.include import Include
from tessera.operators.paging import decode_cursor, encode_cursor
from tessera.plans.batch import Batch
from tessera.plans.engine import Engine, QueryTimeoutError, scans_everything
from tessera.sources import scan
from tessera.sources.rawsql import numbered, raw_query, raw_row
from tessera.spec import ModelSpec, RelationSpec, column, model

PRODUCTS = model("products", column("id", "int"), column("name", "string"), column("category", "string"), column("price", "double"))
CATEGORIES = model("categories", column("name", "string"), column("description", "string"), key="name")
PAGES = model("page_rows", column("id", "int"), column("name", "string"), column("rank", "int", nullable=True))


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("products", spark.createDataFrame([(1, "Widget A", "electronics", 9.99), (2, "Widget B", "electronics", 19.99), (3, "Gadget C", "accessories", 5.99), (4, "Gadget D", "accessories", 14.99)], PRODUCTS.schema()))
    e.register("categories", spark.createDataFrame([("electronics", "Powered devices"), ("accessories", "Add-ons"), ("empty", "Nothing")], CATEGORIES.schema()))
    rng = random.Random(1)
    e.register("page_rows", spark.createDataFrame([(i, f"row-{i:02d}", rng.choice([None, 0, 1, 2])) for i in range(1, 41)], PAGES.schema()))
    return e


ID, NAME, CATEGORY, PRICE = (PRODUCTS.c(n) for n in PRODUCTS.names)


def ids(query):
    return sorted(r["id"] for r in query.all())


def test_predicates_match_sqlite_logic(engine):
    p = engine.repo(PRODUCTS)
    assert ids(p.where(PRICE.between(5.99, 14.99))) == [1, 3, 4]
    assert ids(p.where(CATEGORY.in_())) == [] and ids(p.where(CATEGORY.not_in())) == [1, 2, 3, 4]
    assert ids(p.where(and_())) == [1, 2, 3, 4] and ids(p.where(or_())) == []
    assert ids(p.where(or_(true(), ID.eq(1)))) == [1] and ids(p.where(or_(true()))) == [] and ids(p.where(not_(true()))) == []
    assert ids(p.where(where_if(False, ID.eq(1)))) == [1, 2, 3, 4]
    assert ids(p.where(NAME.contains("_idget"))) == [1, 2] and ids(p.where(NAME.has_suffix("C") | NAME.ilike("WIDGET a"))) == [1, 3]
    assert ids(p.where(raw("price > ? AND name <> '?'", 10))) == [2, 4]
    assert ids(p.where(raw("name = ?", "x' OR '1'='1"))) == [] and ids(p.where(raw("name = ?", "a\\' OR 1=1 --"))) == []
    with pytest.raises(errors.RawArgumentError):
        raw("a = ? AND b = ?", 1)
    assert marker_positions("a = ? -- ?\n AND b = '?' AND `?` = ? /* ? */") == [4, 34]
    r = engine.repo(PAGES)
    rank = PAGES.c("rank")
    total, nulls = r.count(), r.where(rank.is_null()).count()
    assert r.where(rank.neq(1)).count() + r.where(rank.eq(1)).count() == total - nulls == r.where(rank.not_in(9)).count()
    assert r.where(not_(rank.eq(1))).count() == r.where(rank.neq(1)).count() and r.where(rank.eq(None)).count() == 0


def test_literals_come_back(spark):
    values = [None, True, 7, 1 << 40, 1.5, float("inf"), Decimal("12.50"), date(2020, 2, 29), datetime(2020, 1, 2, 3, 4, 5, 6), "it's \\ \"?\" é\n", b"\x00\xff"]
    for v in values:
        out = spark.range(1).select(raw("?", v).column().alias("v")).first()["v"]
        assert (bytes(out) if isinstance(v, bytes) else out) == v


def test_queries_are_immutable(engine):
    a = engine.repo(PRODUCTS).where(PRICE.gt(6))
    b = a.where(CATEGORY.eq("accessories")).order_by(PRICE.desc()).limit(1)
    assert ids(a) == [1, 2, 4] and ids(b) == [4] and ids(a) == [1, 2, 4]


def test_terminals(engine):
    p = engine.repo(PRODUCTS)
    assert p.find(3)["name"] == "Gadget C"
    with pytest.raises(errors.NotFoundError):
        p.find(9)
    assert p.find_query(9).first_or_none() is None and p.where(ID.eq(9)).exists() is False and p.exists()
    q = p.order_by(PRICE.asc()).skip(1).limit(2)
    assert [r["id"] for r in q.all()] == [1, 4] and q.count() == 4 and q.count_rows() == 2 and q.limit(0).exists() is False
    assert q.first()["id"] == 1


def test_projection_shapes(engine):
    @dataclass
    class Item:
        name: str
        price: float

    p = engine.repo(PRODUCTS)
    assert p.order_by(ID.asc()).limit(1).select(NAME, PRICE, into_shape=Item).collect()[0] == ("Widget A", 9.99)
    with pytest.raises(errors.ProjectionError):
        p.query().select(NAME, into_shape=Item)
    with pytest.raises(errors.ProjectionError):
        p.query().select(NAME, PRICE, ID, into_shape=Item)
    from tessera.sources.rawsql import into

    assert into(p.order_by(ID.asc()).select(ID), int) == [1, 2, 3, 4]
    with pytest.raises(errors.ProjectionError):
        into(p.query().select(ID, NAME), int)
    assert sorted(r[0] for r in p.query().distinct().select(CATEGORY).collect()) == ["accessories", "electronics"]


def test_aggregates(engine):
    p = engine.repo(PRODUCTS).query()
    one = lambda a, q=p: q.aggregate(a).first()[0]
    assert one(agg.sum_("price")) == pytest.approx(50.96) and one(agg.count_distinct("category")) == 2
    none = p.where(ID.lt(0))
    assert one(agg.sum_("price"), none) == 0 and one(agg.sum_("id"), none) == 0 and one(agg.avg("price"), none) is None and one(agg.max_("price"), none) is None
    assert one(agg.count_star(), p.order_by(ID.asc()).skip(2).limit(1)) == 4
    rows = p.order_by(Handle("total").desc()).limit(5).group_by([CATEGORY], [agg.sum_("price").as_("total")], having=raw("total > ?", 25)).collect()
    assert [r["category"] for r in rows] == ["electronics"]


def test_joins(engine):
    on = Qualified("products.category").eq_col(Qualified("categories.name"))
    q = engine.repo(PRODUCTS).inner_join("categories", on)
    assert {(r["id"], r["description"]) for r in q.select("products.id", "categories.description").collect()} == {(1, "Powered devices"), (2, "Powered devices"), (3, "Add-ons"), (4, "Add-ons")}
    assert q.where(NAME.eq("Widget A")).df().columns == list(PRODUCTS.names)  # the model's own name, though both tables have one
    assert q.where(Qualified("categories.name").eq("accessories")).count_rows() == 2 and q.count() == 4
    left = engine.repo(CATEGORIES).left_join("products", Qualified("categories.name").eq_col(Qualified("products.category"))).where(Qualified("products.id").is_null())
    assert [r["name"] for r in left.df().collect()] == ["empty"]


@pytest.mark.parametrize("null_order", ["low", "high"])
@pytest.mark.parametrize("order", [lambda c: c.asc(), lambda c: c.desc(), lambda c: c.asc().nulls_last(), lambda c: c.desc().nulls_first()])
def test_null_placement(engine, null_order, order):
    e = Engine(engine.spark, null_order=null_order).register("page_rows", engine.table("page_rows"))
    o = order(PAGES.c("rank"))
    rows = [(r["rank"], r["id"]) for r in e.repo(PAGES).order_by(o, PAGES.c("id").asc()).all()]
    first = o.nulls == "first" if o.nulls else (null_order == "low") != o.descending
    want = sorted(rows, key=lambda r: ((r[0] is None) != first, 0 if r[0] is None else -r[0] if o.descending else r[0], r[1]))
    assert rows == want


@pytest.mark.parametrize("order", [lambda c: c.asc().nulls_first(), lambda c: c.desc().nulls_last(), lambda c: c.asc().nulls_last()])
def test_walking_pages_is_sorting(engine, order):
    q = engine.repo(PAGES).order_by(order(PAGES.c("rank"))).limit(7)
    whole = [r["id"] for r in replace(q, size=None).order_by(PAGES.c("id").asc()).all()]
    seen, page, pages = [], q.page(), [None]
    while True:
        seen += [r["id"] for r in page.rows]
        pages.append(page)
        if not page.has_more:
            break
        page = q.after(page.next_cursor).page()
    assert seen == whole and page.has_prev and not pages[1].has_prev
    back = q.before(pages[-1].prev_cursor).page()
    assert [r["id"] for r in back.rows] == [r["id"] for r in pages[-2].rows] and back.has_more
    assert q.before(q.after(pages[1].next_cursor).page().prev_cursor).page().has_prev is False


def test_page_errors(engine):
    p, rank = engine.repo(PAGES), PAGES.c("rank")
    with pytest.raises(errors.NeedsOrderError):
        p.limit(3).page()
    with pytest.raises(errors.NeedsLimitError):
        p.order_by(rank.asc()).page()
    with pytest.raises(errors.InvalidPageSizeError):
        p.order_by(rank.asc()).limit(0).page()
    for bad in ("", "###", encode_cursor(["name", "id"], ["x", 1])):
        with pytest.raises(errors.InvalidCursorError):
            p.order_by(rank.asc()).limit(2).after(bad).page()
    with pytest.raises(errors.NullableCursorError):
        p.order_by(rank.asc()).limit(2).after(encode_cursor(["rank", "id"], [None, 1])).page()
    page = p.order_by(PAGES.c("id").asc()).skip(30).limit(15).page_offset()
    assert (page.page, page.total, page.total_pages, page.has_more, page.has_prev) == (3, 40, 3, False, True)
    values = [1, 1.5, "é", None, True, Decimal("1.10"), date(2020, 1, 1), datetime(2020, 1, 1, tzinfo=UTC), b"\x00"]
    assert decode_cursor(encode_cursor(list("abcdefghi"), values), list("abcdefghi")) == values


# ---- nested relations

AUTHORS = ModelSpec("authors", (column("id", "int"), column("name", "string")), relations=(
    RelationSpec("books", "has_many", lambda: BOOKS, "author_id"), RelationSpec("profile", "has_one", lambda: PROFILES, "author_id"), RelationSpec("tags", "many_to_many", lambda: TAGS, "author_id", "author_tags", "tag_id")))
BOOKS = ModelSpec("books", (column("id", "int"), column("author_id", "int", nullable=True), column("title", "string"), column("gone", "boolean")), filters={"live": Handle("gone").eq(False)}, relations=(RelationSpec("author", "belongs_to", lambda: AUTHORS, "author_id"), RelationSpec("reviews", "has_many", lambda: REVIEWS, "book_id")))
REVIEWS = ModelSpec("reviews", (column("id", "int"), column("book_id", "int"), column("stars", "int")))
PROFILES = ModelSpec("profiles", (column("id", "int"), column("author_id", "int"), column("bio", "string")))
TAGS = ModelSpec("tags", (column("id", "int"), column("label", "string")))


@pytest.fixture(scope="module")
def library(spark):
    e = Engine(spark)
    make = lambda m, rows: e.register(m.table, spark.createDataFrame(rows, m.schema()))
    make(AUTHORS, [(1, "Ann"), (2, "Bob"), (3, "Cyd")])
    make(BOOKS, [(10, 1, "A1", False), (11, 1, "A2", False), (12, 2, "B1", False), (13, 1, "A3", False), (14, 1, "A4", True), (15, 2, "B2", False), (16, 2, "B3", False), (17, None, "N", False)])
    make(REVIEWS, [(100, 10, 5), (101, 10, 4), (102, 11, 3), (103, 12, 2)])
    make(PROFILES, [(1, 1, "old"), (2, 1, "new"), (3, 2, "bob")])
    make(TAGS, [(1, "zeta"), (2, "alpha"), (3, "mid")])
    return e.register("author_tags", spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (1, 3)], "author_id int, tag_id int"))


def test_includes(library):
    a = library.repo(AUTHORS).order_by(AUTHORS.c("id").asc())
    rows = a.include(Include("books").limit(2).then(Include("reviews").order_by(REVIEWS.c("stars").asc())), Include("profile"), Include("tags").order_by(TAGS.c("label").asc())).collect()
    assert [[b["id"] for b in r["books"]] for r in rows] == [[10, 11], [12, 15], []]
    assert [[x["stars"] for x in b["reviews"]] for b in rows[0]["books"]] == [[4, 5], [3]] and rows[1]["books"][1]["reviews"] == []
    assert [r["profile"] and r["profile"]["bio"] for r in rows] == ["new", "bob", None]
    assert [[t["label"] for t in r["tags"]] for r in rows] == [["alpha", "mid", "zeta"], ["mid"], []]
    slim = a.include(Include("books").only("title").order_by(BOOKS.c("id").desc()).then(Include("reviews").only("stars")))
    assert slim.schema["books"].dataType.elementType.names == ["title", "reviews"] and [b["title"] for b in slim.first()["books"]] == ["A3", "A2", "A1"]
    every = a.include(Include("books").unscoped()).collect()
    assert [len(r["books"]) for r in every] == [4, 3, 0]
    some = a.include(Include("books").where(BOOKS.c("title").has_prefix("A")).order_by(BOOKS.c("id").desc()), Include("tags").limit(1)).collect()
    assert [[b["id"] for b in r["books"]] for r in some] == [[13, 11, 10], [], []] and [[t["id"] for t in r["tags"]] for r in some] == [[1], [3], []]
    books = library.repo(BOOKS).order_by(BOOKS.c("id").asc()).include(Include("author").where(AUTHORS.c("name").neq("Bob"))).collect()
    assert [r["author"] and r["author"]["name"] for r in books] == ["Ann", "Ann", None, "Ann", None, None, None]


def test_include_limit_is_cut_before_the_shuffle(library):
    plan = library.repo(AUTHORS).query().include(Include("books").limit(2))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan


# ---- plumbing


def test_batch(engine):
    b = Batch(engine)
    p = engine.repo(PRODUCTS)
    good, bad, n = b.all(p.where(ID.eq(1))), b.first(p.where(ID.eq(99))), b.count(p.query())
    with pytest.raises(errors.BatchNotExecutedError):
        good.get()
    with pytest.raises(errors.BatchPartialError):
        b.execute()
    assert good.get()[0]["id"] == 1 and n.get() == 4
    with pytest.raises(errors.NotFoundError):
        bad.get()


def test_hooks_and_notes(engine):
    e = Engine(engine.spark, dev=True, slow=1e-9).register("products", engine.table("products"))
    seen = []
    e.on_query(seen.append)
    e.watch.within = 60
    for _ in range(10):
        e.repo(PRODUCTS).where(ID.eq(1)).all()
    assert seen[0].kind == "all" and {"unbounded", "slow"} <= set(seen[0].notes) and "repeated" in seen[-1].notes and e.healthy()
    with pytest.raises(errors.NotFoundError):
        e.repo(PRODUCTS).find(99)


def test_time_limit(engine):
    slow = F.udf(lambda i: __import__("time").sleep(20) or i, "int")
    e = Engine(engine.spark, seconds=30).register("products", engine.table("products").withColumn("id", slow("id")))
    with pytest.raises(QueryTimeoutError):
        e.repo(PRODUCTS).query().timeout(1).all()


def test_raw_queries(spark):
    assert numbered("a = $2 AND b = '$1' AND c = $1 OR $2")[0] == "a = :p2 AND b = '$1' AND c = :p1 OR :p2"
    assert raw_query(spark, "SELECT id FROM range(10) WHERE id > $2 AND id < $1 AND $2 = $2", 8, 5).count() == 2
    assert raw_query(spark, "SELECT id FROM {t} WHERE id = ?", 3, t=spark.range(5)).collect() == [(3,)]
    with pytest.raises(errors.RawArgumentError):
        raw_query(spark, "SELECT ?", 1, 2)
    with pytest.raises(errors.NotFoundError):
        raw_row(spark, "SELECT id FROM range(3) WHERE id = ?", 7)


def test_sources(spark, tmp_path):
    assert scan.locate("postgres://u:p@h:5432/db?x=1") == scan.Location("jdbc", "jdbc:postgresql://h:5432/db?x=1", {"user": "u", "password": "p"})
    assert scan.locate("sqlite:///a/b.db").path == "jdbc:sqlite:/a/b.db" and scan.locate("orders").kind == "view" and scan.locate("/a/b.orc").kind == "orc" and scan.locate("json:/x").kind == "json"
    df = spark.range(20).withColumn("v", F.col("id") % 3)
    for kind in ("parquet", "orc", "json"):
        scan.write(df, f"{kind}:{tmp_path}/{kind}", mode="overwrite")
        assert scan.read(spark, f"{kind}:{tmp_path}/{kind}").count() == 20
    e = Engine(spark, f"parquet:{tmp_path}")
    df.write.parquet(f"{tmp_path}/numbers.parquet")
    numbers = model("numbers", column("id", "long"), column("v", "long"))
    assert e.repo(numbers).where(numbers.c("v").eq(0)).count() == 7
    assert scans_everything(e.repo(numbers).query().df()) and not scans_everything(e.repo(numbers).where(numbers.c("v").eq(0)).df())


def test_keyset_is_pushed_down():
    from pyspark.sql import SparkSession

    from tessera import catalog

    spark = SparkSession.getActiveSession()
    plan = catalog.QUERIES["keyset_page2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderpriority" in plan and "TakeOrderedAndProject" in plan
    point = catalog.QUERIES["find_pk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,42)" in point


def test_catalog_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessera import catalog

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert len(catalog.QUERIES) > 100 and set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    for name, f in catalog.QUERIES.items():
        got = f(spark, sf)
        want = con.sql(catalog.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns), name
        order = sorted(got.columns)
        rows = [tuple(str(v) for v in r) for r in con.sql(f"SELECT {', '.join(order)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()]
        assert sorted(tuple(str(v) for v in r) for r in got.select(*order).collect()) == sorted(rows), name
