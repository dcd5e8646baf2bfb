import json

import pytest
from pyspark.sql import functions as F

from mergelake.operators import merge, retention, scan
from mergelake.operators.capture import LimitExceeded
from mergelake.operators.schema import COLUMN_HLCS, COLUMN_SIGS, DELETED_ROWS, ROW_HLC, EngineError, ValidationError
from mergelake.plans.clock import Clock, ClockError, node_of, parse
from mergelake.plans.guard import Guard, StatementRefused, is_query, tables_in
from mergelake.plans.policy import DigestSignatures, SignatureError
from mergelake.sources import feed
from mergelake.sources.store import MigrationError, Store, StoreConfig, StoreLocked
from mergelake.streaming.apply import apply_stream, latest_values, read_feed_stream

A, B = "00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002"


class Ticks:
    def __init__(self, at=1_735_689_600):
        self.at = at << 32

    def __call__(self):
        self.at += 1 << 32
        return self.at


def opened(spark, path, device=A, **more):
    return Store(spark, str(path), StoreConfig(device, now=more.pop("now", Ticks()), **more))


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, body string")


def create(store):
    with store.write() as tx:
        tx.create_table("items", "id string, body string, note_no_sync string", ["id"])


def rows_of(store, name="items"):
    return {r.id: r.asDict() for r in store.snapshot().table(name).collect()}


def test_two_stores_end_to_end(spark, tmp_path):
    keys = {"a": "secret", "b": "other"}
    one, two = opened(spark, tmp_path / "one", A, signatures=DigestSignatures("a", keys)), opened(spark, tmp_path / "two", B, signatures=DigestSignatures("b", keys))
    with one.write() as tx:
        tx.create_table("toys_no_sync", "id string, body string", ["id"])
        tx.insert("toys_no_sync", items(spark, ("t", "local")))
    for s in (one, two):
        create(s)
    with one.write() as tx:
        tx.rename_table("toys_no_sync", "cache_no_sync")
        tx.insert("items", items(spark, ("x", "1"), ("y", "2")))
        tx.update("items", {"body": F.lit("1b")}, F.col("id") == "x")
        assert tx.table("items").count() == 2
    assert one.scan_dirty_tables() == ["items"]
    changes = one.snapshot().scan("items")
    feed.write_json_feed(changes, str(tmp_path / "wire"))
    outcome = two.apply(feed.read_json_feed(spark, str(tmp_path / "wire")))
    assert outcome.report()["applied"] == 2 and rows_of(two)["x"]["body"] == "1b"
    assert rows_of(two)["x"][COLUMN_SIGS] == rows_of(one)["x"][COLUMN_SIGS] and two.scan_dirty_tables() == []
    assert parse(two.clock.draw())[0] > parse(changes.first().hlc_timestamp)[0]
    with two.write() as tx:
        tx.delete("items", F.col("id") == "x")
        tx.upsert("items", items(spark, ("y", "2c"), ("z", "3")), ["body"])
    cursor = changes.agg(F.max("hlc_timestamp")).first()[0]
    back = two.snapshot().scan("items", after_hlc=cursor).unionByName(two.snapshot().scan(DELETED_ROWS))
    one.apply(back)
    assert {k: r["body"] for k, r in rows_of(one).items()} == {k: r["body"] for k, r in rows_of(two).items()} == {"y": "2c", "z": "3"}
    assert one.snapshot().stats() == {"live_row_count": 2, "crdt_table_count": 1, "delete_log_row_count": 1}
    forged = changes.withColumn("value", F.lit('"forged"'))
    with pytest.raises(SignatureError):
        two.apply(forged)
    one.clean(["items", DELETED_ROWS])
    assert one.scan_dirty_tables() == [] and one.snapshot().discover() == [DELETED_ROWS, "items"]
    one.vacuum()
    assert rows_of(one)["z"]["body"] == "3"


def test_transactions(spark, tmp_path):
    store = opened(spark, tmp_path, max_transaction_bytes=100)
    create(store)
    seen = []
    store.observe(seen.append)
    store.observe(lambda tables: 1 / 0)
    version = store.snapshot().manifest["version"]
    with pytest.raises(RuntimeError), store.write() as tx:
        tx.insert("items", items(spark, ("x", "1")))
        raise RuntimeError
    assert store.snapshot().manifest["version"] == version and seen == []
    with store.write() as tx:
        tx.insert("items", items(spark, ("x", "1")))
        assert tx.sql("SELECT count(*) AS n FROM items").first().n == 1
        clock = tx.hlc
    assert seen == [["items"]] and rows_of(store)["x"][ROW_HLC] == clock and rows_of(store)["x"][COLUMN_HLCS] == {"body": clock}
    for bad in (lambda tx: tx.insert("items", items(spark, ("x", "again"))), lambda tx: tx.insert("items", items(spark, ("d", "1"), ("d", "2"))), lambda tx: tx.insert("items", items(spark, ("x2", "y" * 200))), lambda tx: tx.update("items", {ROW_HLC: F.lit("1/1")}), lambda tx: tx.update("items", {"id": F.lit("k")}), lambda tx: tx.insert("nowhere", items(spark, ("x", "1")))):
        with pytest.raises(EngineError), store.write() as tx:
            bad(tx)
    with pytest.raises(LimitExceeded), store.write() as tx:
        for k in range(3):
            tx.insert("items", items(spark, (f"n{k}", "y" * 60)))
    store.clean(["items"])
    with store.write() as tx:
        tx.update("items", {"body": F.lit("1")}, F.col("id") == "x")
    assert store.scan_dirty_tables() == [] and rows_of(store)["x"][ROW_HLC] != clock and rows_of(store)["x"][COLUMN_HLCS] == {"body": clock}
    with store.write() as tx:
        tx.replace("items", items(spark, ("x", "new"), ("w", "1")))
    assert sorted(rows_of(store)) == ["w", "x"] and set(store.scan_dirty_tables()) == {"items"}
    with store.write() as tx:
        tx.replace("items", items(spark, ("w", "1")))
    assert store.snapshot().table(DELETED_ROWS).first().row_pks == '{"id":"x"}'
    pinned = store.snapshot()
    with store.write() as tx:
        tx.delete("items", F.lit(True))
    assert pinned.table("items").count() == 1 and store.snapshot().table("items").count() == 0
    with pytest.raises(StoreLocked):
        opened(spark, tmp_path)
    reader = Store(spark, str(tmp_path), StoreConfig(B), writable=False)
    assert reader.read("SELECT count(*) AS n FROM items").first().n == 0
    with pytest.raises(StoreLocked), reader.write():
        pass
    store.close()
    again = opened(spark, tmp_path)
    assert parse(again.clock.draw())[0] > parse(store.clock.current())[0] - 1
    again.close()


def test_schema_changes(spark, tmp_path):
    store = opened(spark, tmp_path, bootstrap=lambda tx: tx.create_table("seed", "id string", ["id"]))
    assert "seed" in store.snapshot().names()
    create(store)
    with store.write() as tx:
        tx.insert("items", items(spark, ("x", "1")))
        clock = tx.hlc
    from pyspark.sql import types as T

    with store.write() as tx:
        tx.alter_table("items", lambda s: s.add_column(T.StructField("late", T.StringType())))
        tx.alter_table("items", lambda s: s.rename_column("body", "text"), {"body": "text"})
    assert {(r.column_name, r.hlc_timestamp, r.value) for r in store.snapshot().scan("items").collect()} == {("text", clock, '"1"'), ("late", clock, "null")}
    with pytest.raises(ValidationError), store.write() as tx:
        tx.rename_table("items", "items_no_sync")
    with store.write() as tx:
        tx.create_table("legacy_no_sync", "id string, body string", ["id"], synced=False)
        tx.insert("legacy_no_sync", items(spark, ("l", "1")))
    with store.write() as tx:
        tx.install("legacy_no_sync")
        clock = tx.hlc
    assert rows_of(store, "legacy_no_sync")["l"][COLUMN_HLCS] == {"body": clock}
    assert store.stamp_unstamped() == []
    with store.write() as tx:
        tx.create_table("notes", "id string, item string", ["id"], foreign_keys=(("item", "items", "id"),))
    with pytest.raises(EngineError, match="foreign keys"), store.write(check_foreign_keys=True) as tx:
        tx.insert("notes", spark.createDataFrame([("n", "gone")], "id string, item string"))
    with store.write(check_foreign_keys=True) as tx:
        tx.insert("notes", spark.createDataFrame([("n", "x"), ("m", None)], "id string, item string"))
    text = '{"create": "m", "schema": "id string, v string", "pks": ["id"]}\n--> breakpoint\n{"add": "w long", "to": "m"}'
    assert store.migrate({"0001": text}) == ["0001"] and store.migrate({"0001": text}) == []
    assert store.snapshot().specs["m"].names == ["id", "v", "w"]
    for bad in ({"0001": text + " "}, {}, {"0001": text, "0002": '{"drop": "m"}'}):
        with pytest.raises(MigrationError):
            store.migrate(bad)
    store.close()


def test_cleanup(spark, tmp_path):
    store = opened(spark, tmp_path)
    create(store)
    for k in ("x", "y"):
        with store.write() as tx:
            tx.insert("items", items(spark, (k, "1")))
        with store.write() as tx:
            tx.delete("items", F.col("id") == k)
    seen = []
    assert store.cleanup(retention.Retention(365_000))["rows_deleted"] == 0
    with pytest.raises(ZeroDivisionError):
        store.cleanup(retention.Retention(), lambda pruned: 1 / 0)
    result = store.cleanup(retention.Retention(), lambda pruned: seen.append(pruned.count()))
    assert result["rows_deleted"] == 2 and seen == [2] and parse(result["max_pruned_hlc"]) and store.snapshot().stats()["delete_log_row_count"] == 0
    store.close()


def test_streaming(spark, tmp_path):
    one, two = opened(spark, tmp_path / "one"), opened(spark, tmp_path / "two", B)
    for s in (one, two):
        create(s)
    with one.write() as tx:
        tx.insert("items", items(spark, *[(f"k{n}", str(n)) for n in range(5)]))
    feed.write_feed(one.snapshot().scan("items"), str(tmp_path / "feed"), 2)
    with one.write() as tx:
        tx.update("items", {"body": F.lit("later")}, F.col("id") == "k1")
        cursor = tx.hlc
    feed.write_feed(one.snapshot().scan("items").filter(F.col("hlc_timestamp") == cursor), str(tmp_path / "feed"), 1)
    apply_stream(two, read_feed_stream(spark, str(tmp_path / "feed"), 1), str(tmp_path / "checkpoint")).awaitTermination()
    assert {k: r["body"] for k, r in rows_of(two).items()} == {k: r["body"] for k, r in rows_of(one).items()}
    newest = feed.read_feed(spark, str(tmp_path / "feed"), cursor)
    assert newest.count() == 0
    recent = feed.read_feed(spark, str(tmp_path / "feed"), f"{parse(cursor)[0] - 1}/1")
    assert recent.count() == 1 and "hlc_key" in recent._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    query = latest_values(read_feed_stream(spark, str(tmp_path / "feed"))).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {json.loads(r.row_pks)["id"]: json.loads(r.value) for r in spark.table("latest").collect()} == {k: r["body"] for k, r in rows_of(one).items()}
    one.close()
    two.close()


def test_clock():
    now = Ticks()
    clock = Clock(A, now)
    drawn = [parse(clock.draw()) for _ in range(3)]
    assert drawn == sorted(drawn) and {n for _, n in drawn} == {node_of(A)} == {1 << 120}
    frozen = Clock(A, lambda: 160)
    assert [parse(frozen.draw())[0] for _ in range(3)] == [160, 161, 162]
    frozen.advance("1000/a")
    assert parse(frozen.draw())[0] == 1001
    with pytest.raises(ClockError):
        frozen.advance(f"{(13 * 3600) << 32}/a")
    assert parse(Clock(A, lambda: 5, last="900/1").draw())[0] == 901
    for bad in ("5", "5/", "5/0a", "x/a", "18446744073709551616/a", "5/A"):
        with pytest.raises(ClockError):
            parse(bad)
    with pytest.raises(ClockError):
        node_of("00000000-0000-0000-0000-000000000000")


def test_local_writes_keep_constraints(spark, tmp_path):
    store = opened(spark, tmp_path / "s")
    with store.write() as tx:
        tx.create_table("people", "id string, alias string, since string", ["id"], required=("since",), unique=(("alias",),))
        tx.insert("people", spark.createDataFrame([("a", "x", "1"), ("b", None, "1"), ("c", None, "1")], "id string, alias string, since string"))
    people = lambda *rows: spark.createDataFrame(list(rows), "id string, alias string, since string")
    faults = [
        (lambda tx: tx.insert("people", people(("d", "x", "1"))), "repeat"),
        (lambda tx: tx.insert("people", people(("d", "y", "1"), ("e", "y", "1"))), "repeat"),
        (lambda tx: tx.insert("people", people(("d", "y", None))), "missing"),
        (lambda tx: tx.upsert("people", people(("b", "x", "1")), ["alias"]), "repeat"),
        (lambda tx: tx.upsert("people", people(("d", "y", None))), "missing"),
        (lambda tx: tx.update("people", {"alias": F.lit("x")}, F.col("id") == "b"), "repeat"),
        (lambda tx: tx.update("people", {"since": F.lit(None).cast("string")}, F.col("id") == "b"), "missing"),
        (lambda tx: tx.replace("people", people(("a", "x", "1"), ("b", "x", "1"))), "repeat"),
        (lambda tx: tx.upsert("people", spark.createDataFrame([("a", 1)], "id string, nowhere int"), ["nowhere"]), "unknown columns"),
    ]
    for write, said in faults:
        with pytest.raises(EngineError, match=said), store.write() as tx:
            write(tx)
    assert {i: r["alias"] for i, r in rows_of(store, "people").items()} == {"a": "x", "b": None, "c": None}


def test_update_returns_its_rows_only(spark, tmp_path):
    store = opened(spark, tmp_path / "s")
    create(store)
    with store.write() as tx:
        tx.insert("items", items(spark, ("1", "a"), ("2", "b")))
    with store.write() as tx:
        tx.insert("items", items(spark, ("3", "c")))
        assert [(r.id, r.body) for r in tx.update("items", {"body": F.lit("z")}, F.col("body") == "a").collect()] == [("1", "z")]


def test_vacuum_spares_a_running_write(spark, tmp_path):
    store = opened(spark, tmp_path / "s")
    create(store)
    with store.write() as tx:
        tx.insert("items", items(spark, ("1", "a")))
        with pytest.raises(EngineError, match="outside a transaction"):
            store.vacuum()
    store.vacuum()
    assert set(rows_of(store)) == {"1"}
    with pytest.raises(EngineError, match="writer"):
        opened_for_reading = Store(spark, str(tmp_path / "s"), StoreConfig(A, now=Ticks()), writable=False)
        opened_for_reading.vacuum()


def test_preflight_comes_before_the_policy(spark, tmp_path):
    """A batch with a bad name and a bad signature is refused for the name."""
    store = opened(spark, tmp_path / "s", signatures=DigestSignatures("a", {"a": "k"}))
    create(store)
    row = ("items; drop", '{"id":"x"}', "body", "5/1", '"v"', "d", '{"author":"a","digest":"no"}')
    with pytest.raises(ValidationError, match="invalid table name"):
        store.apply(spark.createDataFrame([row], "table_name string, row_pks string, column_name string, hlc_timestamp string, value string, device_id string, sig string"))


@pytest.mark.parametrize(
    "text",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT 1 WHERE 'a' = java_method('java.lang.System', 'setProperty', 'a', 'b')",
        "SELECT (SELECT max(try_reflect('java.lang.System', 'getProperty', 'x'))) AS y",
        "WITH x AS (SELECT reflect('a.B', 'c') AS y) SELECT * FROM x",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/etc/hostname`)",
        "SELECT * FROM python_worker_logs()",
    ],
)
def test_guard_keeps_statements_inside(spark, text):
    with pytest.raises(StatementRefused):
        Guard().check(spark, text)


def test_guard_lets_plain_reads_pass(spark):
    for text in ("SELECT count(*), max(upper('a')) FROM range(3)", "SELECT explode(array(1, 2))", "SELECT 'reflect(x)' AS t"):
        Guard().check(spark, text)


def test_guard(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert Guard(frozenset({"numbers"})).run(spark, "WITH x AS (SELECT id FROM numbers) SELECT * FROM x UNION SELECT 9", 10)
    assert tables_in(spark, "WITH x AS (SELECT * FROM a) SELECT * FROM x JOIN b WHERE EXISTS (SELECT 1 FROM c)") == ["b", "a", "c"] or set(tables_in(spark, "WITH x AS (SELECT * FROM a) SELECT * FROM x JOIN b WHERE EXISTS (SELECT 1 FROM c)")) == {"a", "b", "c"}
    for text in ("DROP TABLE numbers", "INSERT INTO numbers VALUES (1)", "CREATE TABLE t (id INT)", "SET spark.x = 1", "SELECT 1; SELECT 2", "not sql", "CREATE OR REPLACE TEMP VIEW v AS SELECT 1", "TRUNCATE TABLE numbers", "USE x"):
        with pytest.raises(StatementRefused):
            Guard().sql(spark, text)
    with pytest.raises(StatementRefused):
        Guard(frozenset({"other"})).sql(spark, "SELECT * FROM numbers")
    assert is_query(spark, "SELECT 1")


def test_observed_outcome_of_apply(spark, tmp_path):
    store = opened(spark, tmp_path)
    create(store)
    seen = []
    store.observe(seen.append)
    batch = spark.createDataFrame([("items", '{"id":"a"}', "body", "5/1", '"x"', "d", None)], "table_name string, row_pks string, column_name string, hlc_timestamp string, value string, device_id string, sig string")
    assert isinstance(store.apply(batch), merge.Outcome) and seen == [["items"]]
    assert scan.scan_changes(store.snapshot().table("items"), store.snapshot().specs["items"]).count() == 1
    store.close()
