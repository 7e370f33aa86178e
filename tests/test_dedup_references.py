import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from revloom.functions.message_ids import id_pairs, with_message_key
from revloom.operators import dedup, references

T0 = datetime(2024, 1, 1)


def test_message_keys(spark, rows):
    raw = spark.createDataFrame([(12, "PRRC_a"), (12, "PRRC_a"), (13, None), (None, "PRRC_x")], "id long, node_id string")
    df = spark.createDataFrame([(1, " PRRC_a "), (2, "12"), (3, "012\t"), (4, "13"), (5, "\u00a014\u2003"), (6, " "), (7, None), (8, "PRRC_z")], "k int, id string")
    got = dict(rows(with_message_key(df, "id", id_pairs(raw)).select("k", "message_key")))
    assert got == {1: "PRRC_a", 2: "PRRC_a", 3: "PRRC_a", 4: "13", 5: "14", 6: None, 7: None, 8: "PRRC_z"}


@pytest.mark.parametrize("seed", range(3))
def test_surplus_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = []
    for k in range(400):
        # One message holds a third of all rows.
        key = "hot" if rnd.random() < 0.33 else None if rnd.random() < 0.03 else f"m{rnd.randint(0, 120)}"
        data.append((key, rnd.choice([None, 1, 2, 3, -5, rnd.randint(0, 10**15)]), k, rnd.choice(["2024-01", "2024-02", "none", "2024-07"])))
    data += data[:20]
    df = spark.createDataFrame(data, "message_key string, rank_at long, row_key long, bucket string")
    best: dict = {}
    for key, at, row, _ in data:
        if key is not None:
            best[key] = min(best.get(key, (float("inf"), 0)), (float("inf") if at is None else -at, row)) if key in best else (float("inf") if at is None else -at, row)
    want = {row for key, _, row, _ in data if key is not None and best[key][1] != row}
    assert {r.row_key for r in dedup.surplus(df).collect()} == want


def test_bloom_has_no_false_negative(spark):
    df = spark.createDataFrame([(f"k{i}", 0, i * 2 + b, f"b{b}") for i in range(3000) for b in range(2)], "message_key string, rank_at long, row_key long, bucket string")
    assert dedup.winners(df).count() == 3000


def test_instants_and_empty_tables(spark, tmp_path):
    schema = "delivery_id long, received_at timestamp, id long, node_id string, updated_at string, extra string"
    at = [(1, T0, 7, "n7", "2024-01-01T10:00:00Z", "x"), (2, T0, 7, "n7", "2024-01-01T12:00:00+05:30", None), (3, None, 7, "n7", None, None), (4, T0, 7, "n7", "2024-01-01T10:00:00.000Z", None), (5, T0, 7, "n7", "never", None), (6, T0, None, None, None, None)]
    raw, kept = spark.createDataFrame(at, schema), spark.createDataFrame([(1, T0, "7"), (2, T0 + timedelta(days=90), " n7"), (3, T0, None), (4, T0, None)], "delivery_id long, received_at timestamp, id string")
    raw.write.parquet(f"{tmp_path}/pull_review_comments.parquet")
    kept.write.parquet(f"{tmp_path}/review_comments.parquet")
    got = {tuple(r) for r in dedup.surplus_messages(spark, str(tmp_path)).collect()}
    assert got == {("pull_review_comments", k) for k in (2, 3, 4, 5)} | {("review_comments", 2)}
    per = {(r.src_table, r.month): (r.n_rows, r.n_kept, r.n_surplus) for r in dedup.copies_by_month(spark, str(tmp_path)).collect()}
    assert per[("review_comments", "2024-03")] == (1, 0, 1) and per[("pull_review_comments", "none")] == (1, 0, 1)
    raw.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/pull_review_comments.parquet")
    kept.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/review_comments.parquet")
    assert dedup.surplus_messages(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_broken_references_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    when = lambda: T0 + timedelta(hours=rnd.randint(0, 200))
    targets = []
    for _ in range(150):
        a = None if rnd.random() < 0.05 else when()
        d = when() if rnd.random() < 0.5 else None
        targets.append((rnd.choice("fg"), "hot" if rnd.random() < 0.3 else f"k{rnd.randint(0, 25)}", a, d))
    refs = [(f"r{i}", rnd.choice("fg"), "hot" if rnd.random() < 0.3 else f"k{rnd.randint(0, 30)}", None if rnd.random() < 0.03 else when()) for i in range(300)]
    deltas = references.target_deltas(spark.createDataFrame(targets, "ref_field string, key string, a timestamp, d timestamp"), "a", "d")
    df = spark.createDataFrame(refs, "src_key string, ref_field string, key string, at timestamp").withColumn("at", F.unix_micros("at")).withColumn("src_table", F.lit("t"))
    got = {r.src_key for r in references.broken_references(df.select("src_table", "src_key", "ref_field", "key", "at"), deltas).collect()}
    want = {r for r, f, k, t in refs if t is None or not any(ff == f and kk == k and a is not None and a <= t and (d is None or d > t) for ff, kk, a, d in targets)}
    assert got == want


def test_reference_edges(spark):
    t = [("f", "same", T0, None), ("f", "cut", T0, T0 + timedelta(hours=1)), ("f", "never", T0 + timedelta(hours=2), T0)]
    deltas = references.target_deltas(spark.createDataFrame(t, "ref_field string, key string, a timestamp, d timestamp"), "a", "d")
    refs = [("1", "same", T0), ("2", "cut", T0 + timedelta(hours=1)), ("3", "cut", T0 + timedelta(minutes=59)), ("4", "never", T0 + timedelta(hours=3)), ("5", "gone", T0)]
    df = spark.createDataFrame(refs, "src_key string, key string, t timestamp").select(F.lit("t").alias("src_table"), "src_key", F.lit("f").alias("ref_field"), "key", F.unix_micros("t").alias("at"))
    assert {r.src_key for r in references.broken_references(df, deltas).collect()} == {"2", "4", "5"}
    assert references.broken_references(df.limit(0), deltas).count() == 0
    assert references.broken_references(df, deltas.limit(0)).count() == 5


def test_batches_give_what_one_table_gives(spark, tmp_path):
    rnd = random.Random(9)
    schema = "message_key string, rank_at long, row_key long, bucket string"
    data = [("hot" if rnd.random() < 0.33 else None if rnd.random() < 0.05 else f"m{rnd.randint(0, 80)}", rnd.choice([None, rnd.randint(0, 9)]), k, rnd.choice(["2024-01", "2024-02", "none"])) for k in range(300)]
    store = dedup.MessageStorage(spark, str(tmp_path / "messages"), slices=3, filter_bits=1 << 10)
    seen: list = []
    for batch in (data[:120], [], data[120:200], data[200:]):
        got = {r.message_key: (r.keep_key, r.copies, r.kept_before) for r in store.add(spark.createDataFrame(batch, schema)).collect()}
        before = best_of(seen)
        seen += batch
        want = {k: (best_of(seen)[k][1], sum(x[0] == k for x in seen), before.get(k, (0, None))[1]) for k in {x[0] for x in batch if x[0]} if sum(x[0] == k for x in seen) > 1}
        assert got == want
    assert {r.message_key: r.keep_key for r in dedup.winners(spark.createDataFrame(data, schema)).collect()} == {k: v[1] for k, v in best_of(data).items() if sum(x[0] == k for x in data) > 1}
    (tmp_path / "messages" / "rows" / "9").mkdir()  # a batch that broke off
    assert store.stored().agg(F.sum("n")).first()[0] == sum(x[0] is not None for x in data)


def best_of(rows):
    out: dict = {}
    for key, at, row, _ in rows:
        if key is not None:
            mine = (float("inf") if at is None else -at, row)
            out[key] = min(out.get(key, mine), mine)
    return out


def test_counts_are_maintained(spark, tmp_path):
    rnd = random.Random(3)
    schema = "ref_field string, key string, delta int"
    state = references.ReferenceCounts(spark, str(tmp_path / "counts"))
    assert state.orphans().count() == 0
    total: dict = {}
    for _ in range(4):
        refs, targets = ([("f", "hot" if rnd.random() < 0.33 else rnd.choice([None, *"abcdefgh"]), rnd.choice([1, 1, -1])) for _ in range(25)] for _ in range(2))
        state.add(spark.createDataFrame(refs, schema), spark.createDataFrame(targets, schema))
        for rows, at in ((refs, 0), (targets, 1)):
            for _, k, d in rows:
                if k is not None:
                    total.setdefault(k, [0, 0])[at] += d
        assert {(r.key, r.refs) for r in state.orphans().collect()} == {(k, r) for k, (r, t) in total.items() if r > 0 and t <= 0}
