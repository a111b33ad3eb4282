import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright import Column, Database, Kind, Table, TableDef, TableError, col
from tablewright.functions.predicates import OPERATORS, Predicate
from tablewright.sources import storage

PEOPLE = [Column("id", Kind.INT), Column("name", Kind.VARCHAR)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def people(spark, *data, primary_key=("id",)):
    return Table.create(spark, "people", PEOPLE, primary_key).insert(*data)


def test_insert_and_select(spark):
    t = people(spark, (1, "Alice"), (2, "Bob"))
    assert rows(t.select_all()) == [(1, "Alice"), (2, "Bob")]
    assert rows(t.select_where(col("id") == 1)) == [(1, "Alice")]


def test_type_mismatch(spark):
    with pytest.raises(TableError) as e:
        Table.create(spark, "people", PEOPLE).insert(("Not an Int", "Bob"))
    assert str(e.value) == 'Type mismatch at column id: expected Int, got Varchar("Not an Int")'
    with pytest.raises(TableError, match="Column count mismatch"):
        Table.create(spark, "people", PEOPLE).insert((1,))
    with pytest.raises(TableError, match="does not match declared type"):
        Table.create(spark, "test", PEOPLE[:1]).validate_row(("oops",))


def test_update_and_delete_without_index(spark):
    t = people(spark, (1, "Alice"), (2, "Bob"))
    assert rows(t.update_where(col("id") == 1, {"name": "Alicia"}).df) == [(1, "Alicia"), (2, "Bob")]
    assert rows(t.delete_where(col("id") == 1).df) == [(2, "Bob")]
    assert rows(t.delete_where(col("id") > 999).df) == rows(t.df)
    with pytest.raises(TableError, match="Primary key constraint violated"):
        t.update_where(col("id") > 0, {"id": 5})
    assert rows(t.update_where(col("id") == 2, {"id": 3, "name": None}).df) == [(1, "Alice"), (3, None)]
    assert Table.create(spark, "empty", PEOPLE).delete_where(col("id") == 1).df.count() == 0


@pytest.mark.parametrize(
    ("columns", "key", "message"),
    [
        ([Column("id", Kind.INT), Column("id", Kind.INT)], (), "Duplicate column name"),
        ([Column("id", Kind.INT)], ("not_id",), "Primary key column"),
        ([Column("id", Kind.INT, not_null=True, default=None)], (), "default of NULL"),
        ([Column("id", Kind.VARCHAR, not_null=True, autoincrement=True)], (), "must be INT or BIGINT"),
        ([Column("id", Kind.INT, autoincrement=True)], (), "must be NOT NULL"),
        ([Column("e", Kind.ENUM, allowed=("a",), default="b")], (), "not allowed"),
        ([Column("s", Kind.SET, allowed=("a",), default=("a", "b"))], (), "not allowed"),
    ],
)
def test_schema_rules(spark, columns, key, message):
    with pytest.raises(TableError, match=message):
        Table.create(spark, "users", columns, key)


@pytest.mark.parametrize(
    ("column", "good", "bad", "message"),
    [
        (Column("x", Kind.VARCHAR, not_null=True), "a", None, "NOT NULL"),
        (Column("x", Kind.ENUM, allowed=("Red", "Blue")), "Red", "Green", "Invalid enum value"),
        (Column("x", Kind.SET, allowed=("safe", "reviewed")), [], ["dangerous"], "Invalid set value"),
        (Column("x", Kind.VARCHAR, check="x = active"), "active", "inactive", "CHECK failed"),
        (Column("x", Kind.INT, unique=True), 2, 1, "Unique constraint violated"),
    ],
)
def test_row_rules(spark, column, good, bad, message):
    t = Table.create(spark, "test", [column])
    t = t.insert((1,)) if column.unique else t
    assert t.insert((good,)).df.count() == t.df.count() + 1
    with pytest.raises(TableError, match=message):
        t.insert((good,), (bad,))
    if not column.not_null:
        assert t.insert((None,)).df.count() == t.df.count() + 1


def test_checks_that_say_nothing_pass(spark):
    for check in ("y = a", "x <> a", "nonsense"):
        Table.create(spark, "t", [Column("x", Kind.VARCHAR, check=check)]).insert(("b",))
    Table.create(spark, "t", [Column("x", Kind.INT, check="x = 1")]).insert((2,))


def test_keys(spark):
    with pytest.raises(TableError) as e:
        people(spark, (1, "Alice")).insert((1, "Bob"))
    assert str(e.value) == "Primary key constraint violated: duplicate entry"
    two = Table.create(spark, "multi", [Column("a", Kind.INT), Column("b", Kind.INT)], ("a", "b")).insert((1, 2), (1, 3), (None, 1))
    for bad in ((1, 2), (None, 1)):
        with pytest.raises(TableError, match="Primary key"):
            two.insert(bad)
    with pytest.raises(TableError, match="Unique"):
        Table.create(spark, "u", [Column("x", Kind.INT, unique=True)]).insert((None,), (None,))


def test_defaults_and_autoincrement(spark):
    t = Table.create(spark, "accounts", [Column("id", Kind.INT, not_null=True, autoincrement=True), Column("role", Kind.VARCHAR, default="user")])
    t = t.insert((None, None)).insert((None, "admin"))
    assert rows(t.df) == [(1, "user"), (2, "admin")]
    t = t.insert((None, None), (9, "x"), (None, None), (None, None), (3, "y"), (None, None))
    assert [r[0] for r in rows(t.df.select("id"))] == sorted([1, 2, 3, 9, 10, 11, 3, 12], key=lambda x: repr((x,)))
    big = Table.create(spark, "big", [Column("id", Kind.BIGINT, not_null=True, autoincrement=True)]).insert((1 << 40,)).insert((None,))
    assert rows(big.df) == [(1 << 40,), ((1 << 40) + 1,)]


def test_bulk_insert_numbers_rows_once(spark):
    t = Table.create(spark, "n", [Column("id", Kind.BIGINT, not_null=True, autoincrement=True), Column("v", Kind.BIGINT)], ("id",)).insert((5, 0))
    new = spark.range(0, 25_000, 1, 4).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("v"))
    got = t.insert_from(new).df.agg(F.min("id"), F.max("id"), F.count_distinct("id"), F.count("*")).first()
    assert tuple(got) == (5, 25_005, 25_001, 25_001)
    with pytest.raises(TableError, match="does not match declared type"):
        t.insert_from(new.withColumn("v", F.lit("x")))


@pytest.fixture(scope="module")
def numbers(spark):
    data = [(None, None), (1, 1.5), (2, float("nan")), (3, -2.0), (3, None), (None, 0.0)]
    return Table.create(spark, "n", [Column("i", Kind.INT), Column("d", Kind.DOUBLE)]).insert(*data), data


def model(row, op, value):
    """Null equals null and exceeds all; NaN has no order."""
    if op in ("==", "!="):
        same = row is None and value is None or row is not None and value is not None and (row == value or row != row and value != value)
        return same == (op == "==")
    if row is None or value is None:
        a, b = row is None, value is None
    elif math.isnan(row) or math.isnan(value):
        return False
    else:
        a, b = row, value
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(op=st.sampled_from(OPERATORS), column=st.sampled_from(["i", "d"]), pick=st.integers(0, 5))
def test_predicates_follow_the_model(numbers, op, column, pick):
    t, data = numbers
    k = "id".index(column)
    value = {"i": [None, 0, 1, 2, 3, 4], "d": [None, 0.0, 1.5, float("nan"), -2.0, 9.0]}[column][pick]
    want = sorted((r for r in data if model(r[k], op, value)), key=repr)
    assert repr(rows(t.select_where(Predicate(column, op, value)))) == repr(want)
    left = sorted((r for r in data if not model(r[k], op, value)), key=repr)
    assert repr(rows(t.delete_where(Predicate(column, op, value)).df)) == repr(left)


def test_unknown_column_and_wrong_literal(numbers):
    with pytest.raises(TableError, match="not found"):
        numbers[0].select_where(col("zz") == 1)
    with pytest.raises(TableError, match="Type mismatch"):
        numbers[0].select_where(col("i") == 1.0)


@pytest.fixture(scope="module")
def sides(spark):
    a = Table.create(spark, "a", [Column("k", Kind.INT), Column("x", Kind.VARCHAR)]).insert((1, "p"), (None, "q"), (2, "r"))
    b = Table.create(spark, "b", [Column("k", Kind.INT), Column("y", Kind.VARCHAR)]).insert((1, "s"), (None, "t"), (3, "u"))
    return a, b


def test_joins(sides):
    a, b = sides
    on = [("k", "k")]
    inner = [(1, "p", 1, "s"), (None, "q", None, "t")]
    assert rows(a.join(b, on).df) == sorted(inner, key=repr)
    assert rows(a.join(b, on, "left").df) == sorted([*inner, (2, "r", None, None)], key=repr)
    assert rows(a.join(b, on, "right").df) == sorted([*inner, (None, None, 3, "u")], key=repr)
    assert a.join(b, on).df.columns == ["a.k", "a.x", "b.k", "b.y"]
    assert a.join(b, []).df.count() == 9 and a.join(b, [], "left").df.count() == 9
    assert rows(a.join(b, on, where=lambda p, q: q("y") == "t").df) == [(None, "q", None, "t")]
    marked = a.join(b, on, "left", matched=True).df
    assert sorted(r["__matched"] for r in marked.collect()) == [False, True, True]
    assert a.join(a, on, aliases=("s", "s")).df.columns == ["s.k", "s.x", "s.k_", "s.x_"]
    with pytest.raises(TableError, match="not found"):
        a.join(b, [("zz", "k")])
    with pytest.raises(TableError, match="Type mismatch in join"):
        a.join(b, [("k", "y")])


def test_aggregates(spark):
    t = Table.create(spark, "g", [Column("k", Kind.INT), Column("v", Kind.DOUBLE), Column("s", Kind.VARCHAR), Column("f", Kind.FLOAT)])
    t = t.insert((1, 2.0, "b", 0.1), (1, None, "a", 0.2), (None, -3.0, None, None), (2, None, "z", None))
    got = t.aggregate_group("k", [("v", "sum"), ("v", "avg"), ("v", "count"), ("v", "min"), ("v", "max"), ("s", "min"), ("s", "sum"), ("s", "max")])
    assert rows(got) == sorted([(1, 2.0, 2.0, 2, 2.0, None, "a", 0.0, "b"), (None, -3.0, -3.0, 1, -3.0, -3.0, None, 0.0, None), (2, 0.0, 0.0, 1, None, None, "z", 0.0, "z")], key=repr)
    assert rows(t.group_by("k", col("k") == 1)) == [(1, 2)]
    assert t.group("k", None).count() == 1
    with pytest.raises(TableError, match="Unknown aggregation function"):
        t.delete_where(col("k") != 99).aggregate("k", "v", "median")


def test_schema_changes(spark):
    t = people(spark, (1, "Alice"))
    more = t.add_column(Column("age", Kind.INT, not_null=True, default=3)).add_column(Column("note", Kind.TEXT))
    assert rows(more.df) == [(1, "Alice", 3, None)]
    moved = Table.create(spark, "c", [Column("s", Kind.VARCHAR, check="s = on")], ("s",)).create_index("s").rename_column("s", "state")
    assert moved.definition.primary_key == ("state",) and moved.definition.indexes == {"state": "hash"}
    with pytest.raises(TableError, match="CHECK"):
        moved.insert(("off",))
    assert more.drop_column("age").df.columns == ["id", "name", "note"]
    for bad in (lambda: t.drop_column("id"), lambda: t.drop_column("zz"), lambda: t.rename_column("id", "id"), lambda: t.add_column(PEOPLE[0]), lambda: t.add_column(Column("z", Kind.INT, not_null=True)), lambda: t.create_index("zz")):
        with pytest.raises(TableError):
            bad()


def test_catalog(spark):
    db = Database()
    db.put(Table.create(spark, "orders", [Column("user_id", Kind.INT, foreign_key="users")]))
    with pytest.raises(TableError) as e:
        db.validate_foreign_keys()
    assert str(e.value) == "Table 'orders' has a foreign key to missing table 'users'."
    db.put(Table.create(spark, "users", [Column("id", Kind.INT)]))
    db.validate_foreign_keys()
    assert rows(db.put(db["orders"].insert((1,), (None,))).df) == [(1,), (None,)]
    assert rows(db.orphans("orders", "user_id", "id")) == [(1,)]

    db.view("named", lambda d: d["people"].select_where(col("name") != "Bob"))
    with pytest.raises(TableError, match="Table 'people' not found"):
        db.read_view("named")
    with pytest.raises(TableError, match="View 'other' not found"):
        db.read_view("other")
    db.put(people(spark, (1, "Alice"), (2, "Bob")))
    assert rows(db.read_view("named")) == rows(spark.table("named")) == [(1, "Alice")]
    db.put(people(spark, (1, "Alice")))
    db.begin("people")
    with pytest.raises(TableError, match="already in progress"):
        db.begin("people")
    db.put(db["people"].add_column(Column("z", Kind.INT)).insert((2, "Bob", 3)))
    assert rows(db.rollback("people").df) == [(1, "Alice")]
    for end in (db.rollback, db.commit):
        with pytest.raises(TableError, match="No transaction to"):
            end("people")
    db.begin("people")
    db.put(db["people"].insert((2, "Bob")))
    db.commit("people")
    assert db["people"].df.count() == 2


def test_storage_keeps_values(spark, tmp_path):
    columns = [Column("c", Kind.CHAR), Column("t", Kind.TEXT), Column("s", Kind.SET, allowed=("a", "b")), Column("b", Kind.BOOLEAN), Column("i", Kind.BIGINT), Column("d", Kind.DATE), Column("h", Kind.TIME), Column("m", Kind.DATETIME), Column("f", Kind.DOUBLE)]
    t = Table.create(spark, "all", columns).insert(
        ("x", ' say "hi", \n twice ', ["a", "b"], True, 1 << 40, dt.date(2024, 1, 1), dt.time(1, 2, 3), dt.datetime(2024, 1, 1, 4, 5, 6, 7), 0.1),
        (None,) * 9,
        ("é", "NULL", [], False, -1, None, None, None, None),
        ('"', "", ["b"], None, 0, None, None, None, -0.5),
    )
    storage.save_table(t, str(tmp_path), "db")
    back = storage.load_table(spark, str(tmp_path), "db", t.definition, validate=True)
    assert rows(back.df) == rows(t.df)
    storage.save_parquet(t, f"{tmp_path}/p")
    assert rows(storage.load_parquet(spark, f"{tmp_path}/p", t.definition).df) == rows(t.df)
    storage.save_view(t, str(tmp_path), "db", "v", aliases=("l", "r"))
    assert rows(storage.load_view(spark, str(tmp_path), "db", "l.r.v", t.definition).df) == rows(t.df)
    narrow = TableDef("all", tuple(columns[:2]))
    with pytest.raises(Exception, match="."):  # another width stops the job
        storage.load_table(spark, str(tmp_path), "db", narrow).df.collect()


def test_loading_may_validate(spark, tmp_path):
    t = Table.create(spark, "p", PEOPLE).insert((1, "a"), (1, "b"))
    storage.save_table(t, str(tmp_path), "db")
    keyed = TableDef("p", tuple(PEOPLE), ("id",))
    assert storage.load_table(spark, str(tmp_path), "db", keyed).df.count() == 2
    with pytest.raises(TableError, match="Primary key"):
        storage.load_table(spark, str(tmp_path), "db", keyed, validate=True)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.lit("x").alias("wide")).write.parquet(f"{tmp_path}/t")
    t = Table.of("t", spark.read.parquet(f"{tmp_path}/t"))
    plan = t.aggregate_group("id", [("id", "count")], col("id") >= 50)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(GreaterThanOrEqual(id,50),IsNull(id))]" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_checkpoint_cuts_the_plan(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    t = people(spark, (1, "Alice")).update_where(col("id") == 1, {"name": "Bella"}).checkpoint()
    assert rows(t.df) == [(1, "Bella")] and "ExistingRDD" in t.df._jdf.queryExecution().toString()


def test_console(spark, capsys):
    t = people(spark, (1, "Alice"), (2, None))
    t.show()
    assert capsys.readouterr().out == "people\nid             name\n1              Alice\n2              NULL\n"
    t.join(people(spark, (1, "Bob")), [("id", "id")], aliases=("a", "b")).show_joined()
    assert capsys.readouterr().out == "a.id | a.name | b.id | b.name\n1 | Alice | 1 | Bob\n"
    t.show(0)
    assert capsys.readouterr().out == "people\nid             name\n"


def test_groups_keep_their_rows_in_order(spark):
    t = Table.create(spark, "g", [Column("k", Kind.INT), Column("v", Kind.INT)]).insert(*((None if i % 3 == 0 else i % 2, i) for i in range(60)))
    got = [tuple(r) for r in t.group_rows("k", col("v") < 50).collect()]
    assert sorted(got, key=repr) == sorted(((None if i % 3 == 0 else i % 2, i) for i in range(50)), key=repr)
    keys = [k for k, _ in got]
    assert keys == [None] * keys.count(None) + [0] * keys.count(0) + [1] * keys.count(1)
    with pytest.raises(TableError, match="not found"):
        t.group_rows("zz")


def test_repeats_are_found_once(spark):
    t = Table.create(spark, "r", [Column("k", Kind.INT, unique=True), Column("v", Kind.INT)])
    old = Table(spark.createDataFrame([(1, 0)] * 50 + [(None, 0)] * 50, t.df.schema), t.definition)
    new = spark.createDataFrame([(0, 1, 0), (1, 5, 0), (2, 5, 0), (3, None, 0), (4, None, 0), (5, 7, 0)], "__ordinal long, k int, v int")
    for small in (True, False):
        assert sorted(r["__ordinal"] for r in old.violations(new, small).collect()) == [0, 2, 3, 4]
        assert sorted(r["__ordinal"] for r in t.violations(new, small).collect()) == [2, 4]


def test_updates_name_the_first_broken_rule(spark):
    columns = [Column("k", Kind.INT), Column("a", Kind.VARCHAR, not_null=True), Column("b", Kind.ENUM, allowed=("x", "y")), Column("u", Kind.INT, unique=True)]
    t = Table.create(spark, "t", columns, ("k",)).insert((1, "p", "x", 1), (2, "q", "y", 2), (3, "r", None, 3))
    for values, message in (({"a": None, "b": "z"}, "NOT NULL"), ({"b": "z", "u": 9}, "Invalid enum"), ({"u": 9, "k": 9}, "Unique"), ({"k": 9}, "Primary key")):
        with pytest.raises(TableError, match=message):
            t.update_where(col("k") > 1, values)
    assert rows(t.update_where(col("k") > 9, {"a": None}).df) == rows(t.df)


def test_indexed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_side", "right_side"):
            t = Table.of(name, spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias(name)))
            with pytest.raises(TableError, match="has no index"):
                storage.save_bucketed(t, name, 4)
            storage.save_bucketed(t.create_index("k"), name, 4)
        both = Table.of("l", spark.table("left_side")).join(Table.of("r", spark.table("right_side")), [("k", "k")]).df
        plain = spark.table("left_side").join(spark.table("right_side"), "k")
        assert both.count() == plain.count() == 800
        assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_side", "right_side"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
