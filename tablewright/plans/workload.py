"""Named queries over the driver's tables, one or more for every operator, with their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicate, col
from ..functions.values import Kind, displayed, fits
from ..operators import constraints, joins
from ..operators.constraints import ORDINAL
from ..schema import Column, TableDef, TableError
from ..scratch import new_path
from ..sources import storage
from ..table import Table
from .catalog import Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, primary_key: tuple[str, ...] = ()) -> Table:
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return Table.of(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), primary_key)


def with_nulls(t: Table, **columns: object) -> Table:
    """The table with a value of each column made null."""
    return Table(t.df.withColumns({c: F.nullif(F.col(c), F.lit(v).cast(t.df.schema[c].dataType)) for c, v in columns.items()}), t.definition)


# Scans and filters


@query("SELECT * FROM region")
def scan_all(spark, sf_dir):
    return table(spark, sf_dir, "region").select_all()


ORDERS = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders)"
LINES = "(SELECT l_orderkey, l_partkey, nullif(l_linenumber, 3) AS n FROM lineitem)"


def _orders(spark, sf_dir, where: Predicate) -> DataFrame:
    return with_nulls(table(spark, sf_dir, "orders"), o_orderstatus="F").select_where(where).select("o_orderkey", F.col("o_orderstatus").alias("s"))


def _lines(spark, sf_dir, where: Predicate) -> DataFrame:
    return with_nulls(table(spark, sf_dir, "lineitem"), l_linenumber=3).select_where(where).select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("n"))


@query(f"SELECT * FROM {ORDERS} WHERE s = 'O'")
def filter_eq(spark, sf_dir):
    return _orders(spark, sf_dir, col("o_orderstatus") == "O")


@query(f"SELECT * FROM {ORDERS} WHERE s IS DISTINCT FROM 'O'")
def filter_ne(spark, sf_dir):
    return _orders(spark, sf_dir, col("o_orderstatus") != "O")


@query(f"SELECT * FROM {ORDERS} WHERE s IS NULL")
def filter_eq_null(spark, sf_dir):
    return _orders(spark, sf_dir, col("o_orderstatus") == None)  # noqa: E711


@query(f"SELECT * FROM {ORDERS} WHERE s IS NOT NULL")
def filter_ne_null(spark, sf_dir):
    return _orders(spark, sf_dir, col("o_orderstatus") != None)  # noqa: E711


@query(f"SELECT * FROM {LINES} WHERE n > 4 OR n IS NULL")
def filter_gt(spark, sf_dir):
    return _lines(spark, sf_dir, col("l_linenumber") > 4)


@query(f"SELECT * FROM {LINES} WHERE n >= 4 OR n IS NULL")
def filter_ge(spark, sf_dir):
    return _lines(spark, sf_dir, col("l_linenumber") >= 4)


@query(f"SELECT * FROM {LINES} WHERE n < 4")
def filter_lt(spark, sf_dir):
    return _lines(spark, sf_dir, col("l_linenumber") < 4)


@query(f"SELECT * FROM {LINES} WHERE n <= 4")
def filter_le(spark, sf_dir):
    return _lines(spark, sf_dir, col("l_linenumber") <= 4)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01 00:00:00' OR o_orderdate IS NULL")
def filter_date_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select_where(col("o_orderdate") > dt.datetime(1996, 6, 1)).select("o_orderkey", "o_totalprice")


# Joins


@query("SELECT n_nationkey AS nation_n_nationkey, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey, r_regionkey AS region_r_regionkey, r_name AS region_r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_join(spark, sf_dir):
    return joins.underscored(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")]).df)


@query("SELECT c_custkey, n_name FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) JOIN (SELECT n_name, nullif(n_nationkey, 3) AS j FROM nation) ON k IS NOT DISTINCT FROM j")
def inner_join_nullsafe(spark, sf_dir):
    c, n = with_nulls(table(spark, sf_dir, "customer"), c_nationkey=3), with_nulls(table(spark, sf_dir, "nation"), n_nationkey=3)
    return c.join(n, [("c_nationkey", "n_nationkey")]).df.select(F.col("`customer.c_custkey`").alias("c_custkey"), F.col("`nation.n_name`").alias("n_name"))


@query("SELECT d.doc_id, l.doc_id AS l_doc_id, l.quality, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), [("doc_id", "doc_id")], "left", aliases=("d", "l"), matched=True).df
    return j.select(F.col("`d.doc_id`").alias("doc_id"), F.col("`l.doc_id`").alias("l_doc_id"), F.col("`l.quality`").alias("quality"), F.col("__matched").alias("matched"))


@query("SELECT d.doc_id, l.toxic, l.doc_id IS NOT NULL AS matched FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def right_join(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), [("doc_id", "doc_id")], "right", aliases=("l", "d"), matched=True).df
    return j.select(F.col("`d.doc_id`").alias("doc_id"), F.col("`l.toxic`").alias("toxic"), F.col("__matched").alias("matched"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_totalprice > 1000")
def join_where(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], where=lambda c, o: (c("c_acctbal") < 0) & (o("o_totalprice") > 1000))
    return j.df.select(F.col("`customer.c_custkey`").alias("c_custkey"), F.col("`orders.o_orderkey`").alias("o_orderkey"), F.col("`orders.o_totalprice`").alias("o_totalprice"))


def _returned(spark, sf_dir, how: str, **options) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a, r = (Table(lines.select_where(col("l_returnflag") == flag), lines.definition) for flag in "AR")
    j = a.join(r, [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")], how, aliases=("a", "r"), **options).df
    return j.select(*(F.col(f"`{s}.{c}`").alias(f"{s}_{c}") for s in "ar" for c in ("l_orderkey", "l_linenumber", "l_partkey")))


def _returned_sql(how: str, where: str = "") -> str:
    columns = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ar" for c in ("l_orderkey", "l_linenumber", "l_partkey"))
    return f"SELECT {columns} FROM (SELECT * FROM lineitem WHERE l_returnflag = 'A') a {how} JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') r ON a.l_orderkey = r.l_orderkey AND a.l_linenumber = r.l_linenumber {where}"


@query(_returned_sql("INNER"))
def inner_join_multi(spark, sf_dir):
    return _returned(spark, sf_dir, "inner")


@query(_returned_sql("LEFT"))
def left_join_multi(spark, sf_dir):
    return _returned(spark, sf_dir, "left")


@query(_returned_sql("RIGHT"))
def right_join_multi(spark, sf_dir):
    return _returned(spark, sf_dir, "right")


@query(_returned_sql("INNER", "WHERE a.l_quantity < r.l_quantity"))
def join_multi_where(spark, sf_dir):
    return _returned(spark, sf_dir, "inner", where=lambda a, r: a("l_quantity") < r("l_quantity"))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_join_empty_keys(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), []).df
    return j.select(F.col("`nation.n_name`").alias("n_name"), F.col("`region.r_name`").alias("r_name"))


@query("SELECT a.n_nationkey AS x_n_nationkey, a.n_name AS x_n_name, a.n_regionkey AS x_n_regionkey, b.n_nationkey AS x_n_nationkey_, b.n_name AS x_n_name_, b.n_regionkey AS x_n_regionkey_ FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_aliases(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return joins.underscored(n.join(n, [("n_regionkey", "n_regionkey")], aliases=("x", "x")).df)


@query("SELECT n_nationkey AS a_a_n_nationkey, n_name AS a_a_n_name, n_regionkey AS a_a_n_regionkey, r_regionkey AS b_b_r_regionkey, r_name AS b_b_r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_aliases(spark, sf_dir):
    a, b = table(spark, sf_dir, "nation").with_alias("a"), table(spark, sf_dir, "region").with_alias("b")
    return joins.underscored(a.join(b, [("a.n_regionkey", "b.r_regionkey")], aliases=("a", "b")).df)


@query("SELECT r_regionkey AS g_r_regionkey, r_name AS g_r_name FROM region")
def with_alias(spark, sf_dir):
    return joins.underscored(table(spark, sf_dir, "region").with_alias("g").df)


# Groups


@query("SELECT o_orderstatus, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1")
def group_by_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").group_by("o_orderstatus")


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def group_by_all_rows(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.group_rows("o_orderstatus", col("o_totalprice") > 1000.0).select("o_orderstatus", "o_orderkey", "o_totalprice")


def _aggregate(spark, sf_dir, func: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").aggregate("l_returnflag", "l_quantity", func)


@query("SELECT l_returnflag, sum(l_quantity)::DOUBLE AS sum_l_quantity FROM lineitem GROUP BY 1")
def agg_sum(spark, sf_dir):
    return _aggregate(spark, sf_dir, "sum")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS avg_l_quantity FROM lineitem GROUP BY 1")
def agg_avg(spark, sf_dir):
    return _aggregate(spark, sf_dir, "avg").withColumn("avg_l_quantity", F.round("avg_l_quantity", 6))


@query("SELECT l_returnflag, count(*)::BIGINT AS count_l_quantity FROM lineitem GROUP BY 1")
def agg_count(spark, sf_dir):
    return _aggregate(spark, sf_dir, "count")


@query("SELECT l_returnflag, min(l_quantity) AS min_l_quantity FROM lineitem GROUP BY 1")
def agg_min(spark, sf_dir):
    return _aggregate(spark, sf_dir, "min")


@query("SELECT l_returnflag, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1")
def agg_max(spark, sf_dir):
    return _aggregate(spark, sf_dir, "max")


@query("SELECT event_type, count(*)::BIGINT AS count_event_id, round(sum(value), 2) AS sum_value, min(value) AS min_value, max(ts) AS max_ts FROM events WHERE value > 50 OR value IS NULL GROUP BY 1")
def agg_group_filtered(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    out = t.aggregate_group("event_type", [("event_id", "count"), ("value", "sum"), ("value", "min"), ("ts", "max")], col("value") > 50.0)
    return out.withColumn("sum_value", F.round("sum_value", 2))


@query(
    "SELECT n AS l_linenumber, count(*)::BIGINT AS count_q, coalesce(sum(q), 0)::DOUBLE AS sum_q, min(q) AS min_q, CASE WHEN count(*) FILTER (WHERE q IS NULL) > 0 THEN NULL ELSE max(q) END AS max_q "
    "FROM (SELECT nullif(l_linenumber, 3) AS n, CASE WHEN l_linenumber < 6 THEN nullif(l_quantity, 7) ELSE l_quantity + 100 END AS q FROM lineitem) GROUP BY 1"
)
def agg_null_semantics(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.when(F.col("l_linenumber") < 6, F.nullif(F.col("l_quantity"), F.lit(7.0))).otherwise(F.col("l_quantity") + 100)
    t = Table.of("lines", lines.select(F.nullif(F.col("l_linenumber"), F.lit(3)).alias("l_linenumber"), q.alias("q")))
    return t.aggregate_group("l_linenumber", [("q", "count"), ("q", "sum"), ("q", "min"), ("q", "max")])


@query("SELECT o_orderstatus, 0.0::DOUBLE AS sum_o_orderpriority, 0.0::DOUBLE AS avg_o_orderpriority FROM orders GROUP BY 1")
def agg_non_numeric(spark, sf_dir):
    return table(spark, sf_dir, "orders").aggregate_group("o_orderstatus", [("o_orderpriority", "sum"), ("o_orderpriority", "avg")])


# Data changes


def _declared(t: Table, *columns: Column, primary_key: tuple[str, ...] = ()) -> Table:
    return Table(t.df, TableDef(t.name, columns, primary_key).validate())


@query("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (7, 'NOWHERE'), (8, 'ATLANTIS')")
def insert_defaults(spark, sf_dir):
    t = _declared(table(spark, sf_dir, "region"), Column("r_regionkey", Kind.INT), Column("r_name", Kind.VARCHAR, default="NOWHERE"), primary_key=("r_regionkey",))
    return t.insert((7, None), (8, "ATLANTIS")).df


@query("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (5, 'a'), (9, 'b'), (10, 'c'), (11, 'd'), (12, 'f')")
def insert_autoincrement(spark, sf_dir):
    t = _declared(table(spark, sf_dir, "region"), Column("r_regionkey", Kind.INT, not_null=True, autoincrement=True), Column("r_name", Kind.VARCHAR), primary_key=("r_regionkey",))
    return t.insert((None, "a"), (9, "b"), (None, "c"), (None, "d"), (None, "f")).df


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P'")
def insert_from(spark, sf_dir):
    t = table(spark, sf_dir, "orders", ("o_orderkey",))
    first = Table(t.select_where(col("o_orderstatus") == "F"), t.definition)
    return first.insert_from(t.select_where(col("o_orderstatus") == "P")).df


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 7 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark, sf_dir):
    return table(spark, sf_dir, "customer").update_where(col("c_nationkey") == 7, {"c_mktsegment": "MOVED"}).df.select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT * FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW'")
def delete_where(spark, sf_dir):
    return table(spark, sf_dir, "orders").delete_where(col("o_orderpriority") == "5-LOW").df


def _transaction(spark, sf_dir, end: str) -> DataFrame:
    db = Database()
    db.put(table(spark, sf_dir, "nation"))
    db.begin("nation")
    db.put(db["nation"].delete_where(col("n_regionkey") == 1).rename_column("n_name", "label"), "nation")
    getattr(db, end)("nation")
    return db["nation"].df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tx_rollback(spark, sf_dir):
    return _transaction(spark, sf_dir, "rollback")


@query("SELECT n_nationkey, n_name AS label, n_regionkey FROM nation WHERE n_regionkey <> 1")
def tx_commit(spark, sf_dir):
    return _transaction(spark, sf_dir, "commit")


# Constraints


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def violations_pk(spark, sf_dir):
    return constraints.duplicate_keys(table(spark, sf_dir, "lineitem").df, ("l_orderkey", "l_linenumber"))


@query("SELECT p_name, count(*)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def violations_unique(spark, sf_dir):
    return constraints.duplicate_keys(table(spark, sf_dir, "part").df, ("p_name",))


def _broken(spark, t: Table, key: str, *columns: Column) -> DataFrame:
    """Rows of a table, numbered by a key, that break the rules of these columns."""
    empty = Table.create(spark, t.name, columns)
    new = t.df.select(*(c.name for c in columns), F.col(key).cast("long").alias(ORDINAL))
    return empty.violations(new).select(F.col(ORDINAL).alias("id"), "message")


@query("SELECT p_partkey AS id, 'Column ''p_brand'' is NOT NULL' AS message FROM part WHERE nullif(p_brand, 'Brand#11') IS NULL")
def violations_not_null(spark, sf_dir):
    t = with_nulls(table(spark, sf_dir, "part"), p_brand="Brand#11")
    return _broken(spark, t, "p_partkey", Column("p_brand", Kind.VARCHAR, not_null=True))


@query("SELECT o_orderkey AS id, 'CHECK failed for column ''o_orderstatus'': o_orderstatus = O' AS message FROM orders WHERE o_orderstatus <> 'O'")
def violations_check(spark, sf_dir):
    return _broken(spark, table(spark, sf_dir, "orders"), "o_orderkey", Column("o_orderstatus", Kind.VARCHAR, check="o_orderstatus = O"))


@query("SELECT o_orderkey AS id, 'Invalid enum value for column ''o_orderpriority''' AS message FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def violations_enum(spark, sf_dir):
    return _broken(spark, table(spark, sf_dir, "orders"), "o_orderkey", Column("o_orderpriority", Kind.ENUM, allowed=("1-URGENT", "2-HIGH")))


@query("SELECT p_partkey AS id, 'Invalid set value for column ''p_type''' AS message FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda x: x NOT IN ('STANDARD', 'SMALL', 'PROMO'))) > 0")
def violations_set(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    t = Table.of("part", t.df.withColumn("p_type", F.split("p_type", " ")))
    return _broken(spark, t, "p_partkey", Column("p_type", Kind.SET, allowed=("STANDARD", "SMALL", "PROMO")))


@query("SELECT n_nationkey, n_regionkey + n_nationkey % 7 AS k FROM nation WHERE n_regionkey + n_nationkey % 7 NOT IN (SELECT r_regionkey FROM region)")
def fk_validation(spark, sf_dir):
    db = Database()
    db.put(table(spark, sf_dir, "region"))
    nation = table(spark, sf_dir, "nation").df.select("n_nationkey", (F.col("n_regionkey") + F.col("n_nationkey") % 7).alias("k"))
    db.put(_declared(Table.of("nation", nation), Column("n_nationkey", Kind.INT), Column("k", Kind.INT, foreign_key="region")))
    db.validate_foreign_keys()
    return db.orphans("nation", "k", "r_regionkey")


#: Definitions that break a rule: table name, columns, primary key.
BROKEN = {
    "twice": ([Column("id", Kind.INT), Column("id", Kind.INT)], ()),
    "no key": ([Column("id", Kind.INT)], ("not_id",)),
    "null default": ([Column("id", Kind.INT, not_null=True, default=None)], ()),
    "counted text": ([Column("id", Kind.VARCHAR, not_null=True, autoincrement=True)], ()),
    "counted nulls": ([Column("id", Kind.INT, autoincrement=True)], ()),
    "other member": ([Column("e", Kind.ENUM, allowed=("a",), default="b")], ()),
    "other members": ([Column("s", Kind.SET, allowed=("a",), default=("a", "b"))], ()),
}


@query(
    "SELECT * FROM (VALUES ('twice', 'Duplicate column name: id'), ('no key', 'Primary key column ''not_id'' does not exist in table ''t'''), "
    "('null default', 'Column ''id'' is NOT NULL but has a default of NULL'), ('counted text', 'AUTOINCREMENT column ''id'' must be INT or BIGINT'), "
    "('counted nulls', 'AUTOINCREMENT column ''id'' must be NOT NULL'), ('other member', 'Default ''b'' of ENUM column ''e'' is not allowed'), "
    "('other members', 'Default of SET column ''s'' has members that are not allowed')) v(definition, message)"
)
def schema_rules(spark, sf_dir):
    found = []
    for name, (columns, key) in BROKEN.items():
        try:
            Table.create(spark, "t", columns, key)
        except TableError as e:
            found.append((name, str(e)))
    return spark.createDataFrame(found, "definition string, message string")


@query("SELECT * FROM (VALUES ('Int', 5, true), ('Int', 6, false), ('Char', 1, true), ('Char', 2, false), ('Date', 3, true), ('Date', 4, false)) v(kind, literal, fits)")
def type_compatibility(spark, sf_dir):
    literals = {1: "x", 2: "xy", 3: dt.date(2024, 1, 1), 4: dt.datetime(2024, 1, 1), 5: 7, 6: True}
    asked = [(Kind.INT, 5), (Kind.INT, 6), (Kind.CHAR, 1), (Kind.CHAR, 2), (Kind.DATE, 3), (Kind.DATE, 4)]
    return spark.createDataFrame([(k.value, i, fits(literals[i], k)) for k, i in asked], "kind string, literal int, fits boolean")


# Schema changes


@query("SELECT p_partkey, p_size, 'new' AS p_state FROM part")
def alter_add(spark, sf_dir):
    return table(spark, sf_dir, "part").add_column(Column("p_state", Kind.VARCHAR, not_null=True, default="new")).df.select("p_partkey", "p_size", "p_state")


@query("SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def rename_column(spark, sf_dir):
    return table(spark, sf_dir, "part", ("p_partkey",)).rename_column("p_partkey", "id").df


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def drop_column(spark, sf_dir):
    return table(spark, sf_dir, "part", ("p_partkey",)).drop_column("p_retailprice").df


@query("SELECT p_partkey, p_name FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def index_lookup(spark, sf_dir):
    t = table(spark, sf_dir, "part").create_index("p_name", ordered=True)
    least = t.df.agg(F.min("p_name")).first()[0]
    return t.select_where(col("p_name") == least).select("p_partkey", "p_name")


# Storage


@query("SELECT * FROM customer")
def csv_roundtrip(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    path = new_path(spark, "csv")
    storage.save_csv(t, path)
    return storage.load_csv(spark, path, t.definition).df


@query(
    "SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderdate AS at, o_orderstatus AS c, o_totalprice > 1000 AS dear, string_split(o_orderpriority, '-') AS parts, "
    "strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%H:%M:%S') AS h, nullif(o_orderstatus, 'F') AS s FROM orders"
)
def csv_types_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").df
    at = F.col("o_orderdate")
    time = F.to_time(F.date_format(at + F.make_dt_interval(secs=F.col("o_orderkey") % 86400), "HH:mm:ss"))
    df = orders.select(
        F.col("o_orderkey").alias("id"),
        at.cast("date").alias("day"),
        at.alias("at"),
        F.col("o_orderstatus").alias("c"),
        (F.col("o_totalprice") > 1000).alias("dear"),
        F.split("o_orderpriority", "-").alias("parts"),
        time.alias("h"),
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"),
    )
    kinds = [Kind.BIGINT, Kind.DATE, Kind.DATETIME, Kind.CHAR, Kind.BOOLEAN, Kind.SET, Kind.TIME, Kind.ENUM]
    allowed = {"parts": ("1", "URGENT"), "s": ("O", "P")}
    t = Table(df, TableDef("typed", tuple(Column(n, k, allowed=allowed.get(n, ())) for n, k in zip(df.columns, kinds, strict=True))))
    path = new_path(spark, "csv")
    storage.save_csv(t, path)
    return storage.load_csv(spark, path, t.definition).df.withColumn("h", F.col("h").cast("string"))


@query("SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 AND n_nationkey <> 7 GROUP BY 1")
def lazy_view(spark, sf_dir):
    db = Database()
    db.put(table(spark, sf_dir, "nation"))
    db.put(table(spark, sf_dir, "customer"))
    joined = [("c_nationkey", "n_nationkey")]
    db.view("poor", lambda d: d["customer"].join(d["nation"], joined, where=lambda c, n: c("c_acctbal") < 0).df.select(F.col("`nation.n_name`").alias("n_name")))
    db.put(db["nation"].delete_where(col("n_nationkey") == 7))  # after the view was named
    db.read_view("poor")
    return spark.sql("SELECT n_name, count(*) AS n FROM poor GROUP BY n_name")


@query("SELECT doc_id, text, nullif(lang, 'en') AS lang, source, n_chars FROM documents")
def view_roundtrip(spark, sf_dir):
    t = with_nulls(table(spark, sf_dir, "documents"), lang="en")
    folder = new_path(spark, "views")
    storage.save_view(t, folder, "db", "texts")
    return storage.load_view(spark, folder, "db", "texts", t.definition).df


@query("SELECT n_name AS nation_n_name, r_name AS region_r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 10")
def join_view_roundtrip(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")], where=lambda n, r: n("n_nationkey") > 10)
    folder = new_path(spark, "views")
    storage.save_view(j, folder, "db", "places", aliases=("nation", "region"))
    back = storage.load_view(spark, folder, "db", "nation.region.places", j.definition)
    return joins.underscored(back.df).select("nation_n_name", "region_r_name")


@query("SELECT * FROM orders")
def parquet_roundtrip(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    path = new_path(spark, "parquet")
    storage.save_parquet(t, path)
    return storage.load_parquet(spark, path, t.definition).df


@query("SELECT o_orderkey::VARCHAR AS k, coalesce(nullif(o_orderstatus, 'F'), 'NULL') AS s, '{' || o_orderstatus || ',' || o_orderpriority || '}' AS members FROM orders")
def display_strings(spark, sf_dir):
    df = with_nulls(table(spark, sf_dir, "orders"), o_orderstatus="F").df
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("j"), F.array("o_orderstatus", "o_orderpriority").alias("m"))
    both = df.join(raw, F.col("o_orderkey") == F.col("j"))
    return both.select(displayed(F.col("o_orderkey"), Kind.BIGINT).alias("k"), displayed(F.col("o_orderstatus"), Kind.VARCHAR).alias("s"), displayed(F.col("m"), Kind.SET).alias("members"))
