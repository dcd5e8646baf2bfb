import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mergelake.operators import capture as cap
from mergelake.operators import merge, retention, scan
from mergelake.operators.schema import (
    BATCH, CHANGE, COLUMN_HLCS, COLUMN_SIGS, DELETED_ROWS, DELETED_ROWS_SPEC, METADATA, ROW_HLC, EngineError, MissingMetadata, TableSpec, ValidationError, ensure_metadata, is_safe_identifier, normalize_table_name, partition_columns,
)
from mergelake.sources.staging import staging
from tests.model import Model

NOW = 1_735_689_600 << 32
ITEMS = TableSpec.of("items", "id string, body string, title string, local_no_sync string", ["id"])


def batch(spark, rows):
    """(table, pks, column, clock, value[, sig])"""
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], "d", r[5] if len(r) > 5 else None, i) for i, r in enumerate(rows)], BATCH)


def state(spark, spec, rows=()):
    """(values..., row clock, column clocks)"""
    return spark.createDataFrame([(*r[:-2], r[-2], r[-1], {}) for r in rows], spec.schema)


def table(df):
    return {r[0]: r.asDict() for r in df.collect()}


def tables(spark, items=(), log=()):
    return {"items": state(spark, ITEMS, items), DELETED_ROWS: state(spark, DELETED_ROWS_SPEC, log)}


def item(key, column, clock, value, *sig):
    return ("items", f'{{"id":"{key}"}}', column, clock, value, *sig)


def tombstone(entry, key, clock, target="items"):
    return [(DELETED_ROWS, f'{{"id":"{entry}"}}', "table_name", clock, f'"{target}"'), (DELETED_ROWS, f'{{"id":"{entry}"}}', "row_pks", clock, '"{\\"id\\":\\"%s\\"}"' % key)]


def apply(spark, now, rows, **more):
    return merge.apply_batch(now, {"items": ITEMS}, batch(spark, rows), NOW, save=staging(spark), **more)


def statuses(outcome):
    return {r.input_index: r.status for r in outcome.classified.collect()}


def test_columns_merge_on_their_own(spark):
    now = tables(spark, [("a", "old", "keep", "mine", "5/1", {"body": "5/1", "title": "5/1"})])
    out = apply(spark, now, [item("a", "body", "6/1", '"new"'), item("a", "title", "4/9", '"stale"'), item("a", "title", "5/1", '"equal loses"'), item("b", "body", "3/1", '"fresh"', '{"by":1}')])
    rows = table(out.tables["items"])
    assert (rows["a"]["body"], rows["a"]["title"], rows["a"]["local_no_sync"], rows["a"][ROW_HLC]) == ("new", "keep", "mine", "6/1")
    assert rows["a"][COLUMN_HLCS] == {"body": "6/1", "title": "5/1"} and rows["b"][COLUMN_SIGS] == {"body": '{"by":1}'}
    assert statuses(out) == {0: "applied", 1: "stale", 2: "stale", 3: "applied"}
    assert out.report()["applied"] == 2 and out.report()["skipped_stale"] == 2 and out.max_applied == "6/1"
    assert {r.input_index for r in out.skipped().collect()} == {1, 2}


def test_row_clock_never_goes_back(spark):
    now = tables(spark, [("a", "x", "y", None, "9/1", {"body": "2/1"})])
    rows = table(apply(spark, now, [item("a", "body", "3/1", '"z"'), item("a", "title", "1/1", '"never stamped, so oldest"')]).tables["items"])
    assert rows["a"][ROW_HLC] == "9/1" and rows["a"]["title"] == "never stamped, so oldest"


def test_signature_of_the_winner_replaces(spark):
    now = tables(spark, [("a", "x", "y", None, "5/1", {"body": "5/1"})])
    now["items"] = now["items"].withColumn(COLUMN_SIGS, F.create_map(F.lit("body"), F.lit('"old"'), F.lit("title"), F.lit('"kept"')))
    rows = table(apply(spark, now, [item("a", "body", "6/1", '"z"')]).tables["items"])
    assert rows["a"][COLUMN_SIGS] == {"title": '"kept"'}


def test_reasons(spark):
    now = tables(spark) | {"plain": spark.createDataFrame([], "id string, body string")}
    specs = {"items": ITEMS, "plain": TableSpec.of("plain", "id string, body string", ["id"])}
    rows = [("gone", "{}", "x", "5/1", "1"), ("plain", '{"id":"a"}', "body", "5/1", "1"), ("items", '{"id":"a","x":1}', "body", "5/1", "1"), ("items", "no", "body", "5/1", "1"), item("a", "other", "5/1", "1"), item("a", "id", "5/1", "1"), item("a", ROW_HLC, "5/1", "1"), item("a", "local_no_sync", "5/1", "1"), item("a", "absent_no_sync", "5/1", "1"), item("a", "body", "5", '"no node"'), item("a", "body", "", '"empty"'), item("a", "title", "5/1", '"x"'), item("a", "title", "5/2", '"y"'), item("b", "title", "5/2", '"rejected"')]
    out = merge.apply_batch(now, specs, batch(spark, rows), NOW, decide=lambda b: b.filter("input_index = 13").select("input_index"), save=staging(spark))
    assert [statuses(out)[i] for i in range(len(rows))] == ["missing_table", "missing_metadata", "invalid_row_identity", "invalid_row_identity", "unknown_column", "reserved_column", "reserved_column", "no_sync_column", "unknown_column", "stale", "stale", "superseded_in_batch", "applied", "policy"]
    assert out.report() == {"applied": 1, "skipped_stale": 2, "skipped_shadowed_by_delete": 0, "skipped_unknown_table": 4, "skipped_unknown_column": 2, "skipped_no_sync_column": 1, "skipped_reserved_column": 2, "skipped_policy": 1, "skipped_insert_constraint": 0, "skipped_superseded_in_batch": 1, "skipped_delete_target_newer": 0}


def test_preflight_refuses_in_order(spark):
    good = item("a", "body", "5/1", "1")
    for bad, error in ((("a b", "{}", "x", "5/1", "1"), "invalid table name"), (item("a", "", "5/1", "1"), "invalid column name"), (item("a", "body", "18446744073709551615/0abc", "1"), "malformed"), (item("a", "body", f"{NOW + (13 * 3600 << 32)}/a", "1"), "too far ahead")):
        with pytest.raises(EngineError, match=error):
            apply(spark, tables(spark), [good, bad])
    apply(spark, tables(spark), [item("a", "body", f"{NOW + (11 * 3600 << 32)}/a", "1")])
    with pytest.raises(merge.DecodeError):
        spec = TableSpec.of("n", "id long, v long", ["id"])
        merge.apply_batch({"n": state(spark, spec)}, {"n": spec}, batch(spark, [("n", '{"id":1}', "v", "5/1", '"text"')]), NOW)


def test_spellings_of_a_key_are_one_row(spark):
    spec = TableSpec.of("pair", "b long, a long, body string", ["a", "b"])
    out = merge.apply_batch({"pair": state(spark, spec)}, {"pair": spec}, batch(spark, [("pair", '{"a":1,"b":2}', "body", "5/1", '"x"'), ("pair", '{ "b":2, "a":1 }', "body", "6/1", '"y"')]), NOW, save=staging(spark))
    assert [(r.b, r.a, r.body) for r in out.tables["pair"].collect()] == [(2, 1, "y")]
    assert statuses(out) == {0: "superseded_in_batch", 1: "applied"}


def test_blobs(spark):
    spec = TableSpec.of("blobs", "id binary, payload binary, note string", ["id"])
    pk = '{"id":{"$blob_hex":"00ff"}}'
    out = merge.apply_batch({"blobs": state(spark, spec)}, {"blobs": spec}, batch(spark, [("blobs", pk, "payload", "5/1", '{"$blob_hex":"deadbeef"}'), ("blobs", pk, "note", "5/1", '"{\\"$blob_hex\\":\\"00\\"}"')]), NOW, save=staging(spark))
    row = out.tables["blobs"].first()
    assert (bytes(row.id), bytes(row.payload), row.note) == (b"\x00\xff", b"\xde\xad\xbe\xef", '{"$blob_hex":"00"}')
    again = scan.scan_changes(out.tables["blobs"], spec).collect()
    assert {(r.row_pks, r.column_name, r.value) for r in again} == {(pk, "payload", '{"$blob_hex":"deadbeef"}'), (pk, "note", '"{\\"$blob_hex\\":\\"00\\"}"')}


def test_deletes(spark):
    items = [("a", "x", None, None, "5/1", {"body": "5/1"}), ("b", "x", None, None, "7/1", {"body": "7/1"}), ("c", "x", None, None, None, {})]
    out = apply(spark, tables(spark, items), [*tombstone("t1", "a", "5/1"), *tombstone("t2", "b", "6/1"), *tombstone("t3", "c", "1/1"), *tombstone("t4", "nobody", "9/1"), *tombstone("t5", "b", "9/9", "elsewhere")])
    assert sorted(table(out.tables["items"])) == ["b"] and out.target_newer == 1
    assert len(table(out.tables[DELETED_ROWS])) == 5
    log = [("t1", "items", '{ "id":"a"}', "5/1", {"table_name": "5/1", "row_pks": "5/1"}), ("t0", "items", '{"id":"n"}', None, {})]
    hidden = apply(spark, tables(spark, [], log), [item("a", "body", "5/1", '"tie"'), item("a", "title", "4/1", '"older"'), item("n", "body", "1/1", '"no clock, no shadow"')])
    assert statuses(hidden) == {0: "shadowed_by_delete", 1: "shadowed_by_delete", 2: "applied"} and sorted(table(hidden.tables["items"])) == ["n"]
    again = apply(spark, tables(spark, [], log), [item("a", "body", "5/2", '"newer"'), item("a", "title", "4/1", '"older"')])
    assert table(again.tables["items"])["a"]["title"] == "older"
    replay = apply(spark, tables(spark, items, log), tombstone("t1", "a", "5/1"))
    assert set(statuses(replay).values()) == {"stale"} and "a" not in table(replay.tables["items"])


def test_merge_depends_on_batches_with_tombstones_only(spark):
    a, b = item("r", "body", "10/1", '"A"'), item("r", "title", "17/1", '"B"')
    delete = tombstone("t", "r", "16/1")
    one = table(apply(spark, tables(spark), [a, b, *delete]).tables["items"])
    assert (one["r"]["body"], one["r"]["title"], one["r"][ROW_HLC]) == ("A", "B", "17/1")
    now = tables(spark)
    for part in ([a], delete, [b]):
        now = now | apply(spark, now, part).tables
    assert (table(now["items"])["r"]["body"], table(now["items"])["r"]["title"]) == (None, "B")


@pytest.mark.parametrize("seed", range(5))
def test_against_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    model, now = Model(), tables(spark)
    for _ in range(3):
        changes = []
        for _ in range(40):
            clock = rng.choice([f"{rng.randrange(1, 12)}/{rng.randrange(1, 4):x}"] * 9 + ["7"])
            if rng.random() < 0.12 and "/" in clock:
                entry = rng.choice("pqrs")
                changes.append(("delete", "k" + entry, entry, clock, None))
            else:
                changes.append(("set", "k" + rng.choice("pqrsuv"), rng.choice(["body", "title"]), clock, f"v{rng.randrange(1000)}"))
        want = model.apply(changes)
        rows, of = [], []
        for i, c in enumerate(changes):
            new = tombstone(c[2], c[1], c[3]) if c[0] == "delete" else [item(c[1], c[2], c[3], f'"{c[4]}"')]
            rows += new
            of += [i] * len(new)
        out = apply(spark, now, rows)
        now = now | out.tables
        got = statuses(out)
        for k, i in enumerate(of):
            if changes[i][0] == "set":
                assert got[k] == want[i], (seed, changes[i])
            else:
                assert (got[k] == "applied") <= (want[i] in ("applied", "stale")) and (want[i] == "stale") <= (got[k] != "applied")
        state_now = {k: (r[ROW_HLC], r[COLUMN_HLCS], {c: r[c] for c in ("body", "title") if r[c] is not None}) for k, r in table(now["items"]).items()}
        assert state_now == model.rows
    before = table(now["items"])
    assert table((now | apply(spark, now, [r for r in rows if r[0] == "items"]).tables)["items"]).keys() >= before.keys()


def test_order_and_split_dont_matter_without_tombstones(spark):
    rng = random.Random(9)
    changes = [item(rng.choice("abc"), rng.choice(["body", "title"]), f"{k + 1}/{rng.randrange(1, 5)}", f'"{k}"') for k in range(40)]
    whole = table(apply(spark, tables(spark), changes).tables["items"])
    rng.shuffle(changes)
    now = tables(spark)
    for part in (changes[:15], changes[15:17], changes[17:]):
        now = now | apply(spark, now, part).tables
    assert table(now["items"]) == whole


def test_constraints(spark):
    spec = TableSpec.of("d", "id string, alias string, first_seen string", ["id"], required=("first_seen",), unique=(("alias",),))
    now = {"d": state(spark, spec, [("z", "taken", "t", "1/1", {})])}
    rows = [("d", '{"id":"a"}', "alias", "5/1", '"x"'), ("d", '{"id":"b"}', "alias", "5/1", '"taken"'), ("d", '{"id":"b"}', "first_seen", "5/1", '"t"'), ("d", '{"id":"c"}', "alias", "6/1", '"dup"'), ("d", '{"id":"c"}', "first_seen", "6/1", '"t"'), ("d", '{"id":"e"}', "alias", "5/1", '"dup"'), ("d", '{"id":"e"}', "first_seen", "5/1", '"t"')]
    out = merge.apply_batch(now, {"d": spec}, batch(spark, rows), NOW, save=staging(spark), on_constraint="skip")
    assert [statuses(out)[i] for i in range(7)] == ["insert_not_null", "insert_unique", "insert_unique", "insert_unique", "insert_unique", "applied", "applied"]
    assert sorted(table(out.tables["d"])) == ["e", "z"] and out.report()["skipped_insert_constraint"] == 5
    with pytest.raises(EngineError, match="can't be inserted"):
        merge.apply_batch(now, {"d": spec}, batch(spark, rows), NOW, save=staging(spark))


def cells(table, pk, hlc, **values):
    return [(table, f'{{"id":"{pk}"}}', c, hlc, f'"{v}"') for c, v in values.items()]


def test_failed_row_takes_no_value(spark):
    """A row that can't be inserted doesn't keep a whole one out, for one unique set or several."""
    spec = TableSpec.of("d", "id string, alias string, first_seen string", ["id"], required=("first_seen",), unique=(("alias",),))
    rows = cells("d", "a", "5/1", alias="x") + cells("d", "b", "6/1", alias="x", first_seen="t")
    out = merge.apply_batch({"d": state(spark, spec)}, {"d": spec}, batch(spark, rows), NOW, save=staging(spark), on_constraint="skip")
    assert sorted(table(out.tables["d"])) == ["b"]
    spec = TableSpec.of("e", "id string, one string, two string", ["id"], unique=(("one",), ("two",)))
    # b meets a by one, c meets b by two only: b is refused, so c is inserted; d meets c.
    rows = cells("e", "a", "1/1", one="p", two="q") + cells("e", "b", "2/1", one="p", two="r") + cells("e", "c", "3/1", one="s", two="r") + cells("e", "d", "4/1", one="s", two="t")
    out = merge.apply_batch({"e": state(spark, spec)}, {"e": spec}, batch(spark, rows), NOW, save=staging(spark), on_constraint="skip")
    assert sorted(table(out.tables["e"])) == ["a", "c"]


# Scans


def test_scan_falls_back_and_filters(spark):
    rows = state(spark, ITEMS, [("a", "x", None, "l", "5/b", {"body": "7/a"}), ("b", "y", "t", "l", "", {"body": "", "title": "100/a"}), ("c", "z", None, "l", None, {})])
    got = {(r.row_pks, r.column_name, r.hlc_timestamp, r.value) for r in scan.scan_changes(rows, ITEMS).collect()}
    assert got == {('{"id":"a"}', "body", "7/a", '"x"'), ('{"id":"a"}', "title", "5/b", "null"), ('{"id":"b"}', "title", "100/a", '"t"')}
    assert [r.row_pks for r in scan.scan_changes(rows, ITEMS, after_hlc="99/a").collect()] == ['{"id":"b"}']
    assert [r.hlc_timestamp for r in scan.scan_changes(rows, ITEMS, filters=scan.ScanFilters(origin_node="b".rjust(32, "0"))).collect()] == ["5/b"]
    assert scan.scan_changes(rows, ITEMS, filters=scan.ScanFilters(row_pks=['{"id":"a"}'])).count() == 2
    assert scan.scan_changes(rows, ITEMS, filters=scan.ScanFilters(row_pks=[f'{{"id":"{k}"}}' for k in range(500)] + ['{"id":"b"}'])).count() == 1
    assert scan.scan_changes(rows, ITEMS, filters=scan.ScanFilters(column_eq=("local_no_sync", "l"))).count() == 3
    assert scan.scan_changes(rows, ITEMS, filters=scan.ScanFilters(column_eq=("absent", "l"))).schema == CHANGE
    with pytest.raises(ValidationError):
        scan.scan_changes(rows, ITEMS, filters=scan.ScanFilters(column_eq=('b"ad', "l")))
    with pytest.raises(MissingMetadata):
        scan.scan_changes(spark.createDataFrame([], "id string, body string"), ITEMS)
    assert scan.scan_changes(None, ITEMS, spark=spark).count() == 0


@pytest.mark.parametrize("budget", [1, 60, 100, 250, 10**9])
def test_pages_keep_transactions_whole(spark, budget):
    rng = random.Random(budget)
    changes = spark.createDataFrame([(f"{rng.choice([9, 10, 99, 100, 101])}/{rng.choice('ab1')}", "x" * rng.randrange(9)) for _ in range(60)], "hlc_timestamp string, body string")
    size = lambda rows: sum(len(r.body) for r in rows) + len(rows) - 1 + 2
    groups = {}
    for r in changes.collect():
        groups.setdefault(r.hlc_timestamp, []).append(r)
    from tests.model import clock_key

    want, spent = [[]], 0
    for h in sorted(groups, key=lambda h: (clock_key(h), h)):
        if want[-1] and spent + size(groups[h]) > budget:
            want.append([])
            spent = 0
        want[-1].append(h)
        spent += size(groups[h])
    page, more = scan.first_page(changes, budget, record=F.col("body"))
    assert Counter(r.hlc_timestamp for r in page.collect()) == Counter({h: len(groups[h]) for h in want[0]}) and more == (len(want) > 1)
    every = scan.pages(changes, budget, record=F.col("body")).collect()
    assert {r.hlc_timestamp: r.page for r in every} == {h: k for k, hs in enumerate(want) for h in hs}
    assert {r.hlc for r in scan.page_groups(scan.group_sizes(changes, record=F.col("body")), budget).collect()} == set(want[0])
    assert scan.first_page(changes.limit(0), budget, record=F.col("body"))[1] is False


@pytest.mark.parametrize("budget, steps", [(0, 100_000), (150, 3), (150, 0), (700, 100_000), (3000, 3), (10**6, 0)])
@pytest.mark.parametrize("sizes", ["equal", "mixed"])
def test_many_pages_are_cut_outside_the_driver(spark, monkeypatch, budget, steps, sizes):
    monkeypatch.setattr(scan, "STEPS", steps)
    rng = random.Random(budget)
    bodies = {f"{t}/{n}": "x" * (20 if sizes == "equal" else rng.choice([1, 5, 30, 200])) for t in range(700) for n in "2a"}
    changes = spark.createDataFrame([*bodies.items(), (None, "x")], "hlc_timestamp string, body string")
    paged = scan.pages(changes, budget, record=F.col("body"))
    want, spent, page = {None: 0}, 3, 0  # a missing clock is the oldest
    for h, body in bodies.items():
        if spent + len(body) + 2 > budget:
            spent, page = 0, page + 1
        spent += len(body) + 2
        want[h] = page
    assert {r.hlc_timestamp: r.page for r in paged.collect()} == want
    # The plan holds no page.
    few = scan.pages(changes.limit(3), budget, record=F.col("body"))
    length = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert length(paged) < length(few) + 2000


@pytest.mark.parametrize("times, more", [([1], False), ([1, 2], True), (range(1, 9), True)])
def test_page_of_one_oversized_transaction(spark, times, more):
    changes = spark.createDataFrame([(f"{t}/a", "x" * (500 if t == 1 else 5)) for t in times], "hlc_timestamp string, body string")
    page, has_more = scan.first_page(changes, 100, record=F.col("body"))
    assert [r.hlc_timestamp for r in page.collect()] == ["1/a"] and has_more is more


# Capture, retention, schema


def test_capture(spark):
    old = state(spark, ITEMS, [("a", "x", "t", "l", "5/1", {"body": "5/1", "title": "4/1"}), ("b", "y", None, "l", "5/1", {"body": "5/1"}), ("c", "z", None, "l", "5/1", {})])
    new = spark.createDataFrame([("a", "x2", "t", "l"), ("b", "y", None, "l2"), ("n", None, None, None)], "id string, body string, title string, local_no_sync string")
    rows, deleted, kinds = cap.capture(old, new, ITEMS, "9/9")
    got = table(rows)
    assert got["a"][COLUMN_HLCS] == {"body": "9/9", "title": "4/1"} and got["a"][ROW_HLC] == "9/9"
    assert got["b"][COLUMN_HLCS] == {"body": "5/1"} and got["b"][ROW_HLC] == "9/9" and got["b"]["local_no_sync"] == "l2"
    assert got["n"][COLUMN_HLCS] == {"body": "9/9", "title": "9/9"}
    assert [r.row_pks for r in deleted.collect()] == ['{"id":"c"}']
    assert {(r.kind, r.dirty) for r in kinds.collect()} == {("update", True), ("update", False), ("insert", True), ("delete", True)}
    touched, changed = cap.update_rows(old, ITEMS, F.col("id") < "c", {"body": F.lit("y")}, "9/9")
    assert [(r[ROW_HLC], r[COLUMN_HLCS].get("body")) for r in touched.orderBy("id").collect()] == [("9/9", "9/9"), ("9/9", "5/1"), ("5/1", None)]
    assert [r.id for r in old.filter(changed).collect()] == ["a"]
    with pytest.raises(ValidationError):
        cap.check_written(new.withColumn(ROW_HLC, F.lit("1/1")), ITEMS)
    with pytest.raises(cap.LimitExceeded):
        cap.charge(new, ITEMS, 5)
    assert cap.charge(new, ITEMS) == 10


def test_upsert_install_stamp(spark):
    old = state(spark, ITEMS, [("a", "x", "t", "l", "5/1", {"body": "5/1", "title": "4/1"})])
    rows = spark.createDataFrame([("a", "x", "new", "l2"), ("b", "y", None, None)], "id string, body string, title string, local_no_sync string")
    done = table(cap.upsert(old, rows, ITEMS, "9/9", ["body", "local_no_sync"]))
    assert done["a"][COLUMN_HLCS] == {"body": "9/9", "title": "4/1", "local_no_sync": "9/9"} and done["a"]["title"] == "t" and done["b"]["body"] == "y"
    nothing = table(cap.upsert(old, rows, ITEMS, "9/9"))
    assert nothing["a"] == table(old)["a"] and set(nothing) == {"a", "b"}
    installed = table(cap.install(rows, ITEMS, "3/3"))
    assert installed["a"][COLUMN_HLCS] == {"body": "3/3", "title": "3/3", "local_no_sync": "3/3"} and installed["a"][ROW_HLC] == "3/3"
    bare = table(cap.stamp_unstamped(ensure_metadata(rows), ITEMS, "3/3"))
    assert bare["b"][COLUMN_HLCS] == {"body": "3/3", "title": "3/3"}
    with pytest.raises(ValidationError):
        cap.merge_legacy(rows, rows.withColumn("body", F.lit("other")), ["id"])


def test_retention(spark):
    day = 86_400_000_000_000
    log = state(spark, DELETED_ROWS_SPEC, [(str(k), "items", "{}", h, {}) for k, h in enumerate([f"{5 * day}/a", f"{5 * day}/b", f"{50 * day}/a", None, "noslash"])])
    pruned, kept = retention.split_prunable(log, retention.Retention(30), 60 * day)
    assert {r.id for r in pruned.collect()} == {"0", "1", "4"} and {r.id for r in kept.collect()} == {"2", "3"}
    assert tuple(retention.prune_summary(pruned).first()) == (3, f"{5 * day}/b")
    assert retention.split_prunable(log, retention.Retention(), None)[1].count() == 1
    assert retention.split_prunable(log, retention.Retention(30), None)[0].count() == 0
    assert tuple(retention.prune_summary(log.limit(0)).first()) == (0, None)
    assert [retention.counts_for_stats(n) for n in ("items", "x_no_sync", "x-no-sync", DELETED_ROWS, "no_sync")] == [True, False, False, False, True]


def test_schema_rules():
    assert partition_columns(ITEMS) == (["id"], ["body", "title"])
    assert [is_safe_identifier(n) for n in ("a-b_1", "grün", "", "a b", 'x"')] == [True, True, False, False, False]
    assert normalize_table_name('main."Items"') == "items"
    for change in (lambda: ITEMS.rename_column("body", "body_no_sync"), lambda: ITEMS.drop_column("id"), lambda: ITEMS.rename_column("id", "x"), lambda: TableSpec.of("x y", "id string", ["id"]), lambda: TableSpec.of("x", "id string", ["k"])):
        with pytest.raises(ValidationError):
            change()
    assert set(METADATA) <= set(ITEMS.schema.fieldNames()) and not TableSpec.of("c_no_sync", "id string", ["id"]).synced
