"""D1 against the sequential definition; the crowded and incremental forms."""

import random

from pyspark.sql import functions as F

from newsloom.operators import dedupe as D


def sequential(rows):
    seen1, seen2, kept = set(), set(), []
    for order, k1, k2 in sorted(rows):
        if (k1 is not None and k1 in seen1) or (k2 is not None and k2 in seen2):
            continue
        kept.append(order)
        if k1 is not None:
            seen1.add(k1)
        if k2 is not None:
            seen2.add(k2)
    return sorted(kept)


def run(spark, rows):
    df = spark.createDataFrame(rows, "o long, k1 string, k2 string")
    return sorted(r[0] for r in D.greedy_dedupe(df, ["k1", "k2"], "o").select("o").collect())


def test_three_row_chain(spark):
    rows = [(0, "1", "1"), (1, "2", "1"), (2, "2", "3")]
    assert run(spark, rows) == [0, 2]
    chained = spark.createDataFrame(rows, "o long, k1 string, k2 string").orderBy("o")
    # chained single-key dedupes give a different (wrong) answer on this input
    first1 = D.first_seen(chained, "k1", "o")
    first2 = D.first_seen(first1, "k2", "o")
    assert sorted(r[0] for r in first2.select("o").collect()) == [0]


def test_random_inputs_equal_sequential(spark):
    rnd = random.Random(7)
    for _ in range(6):
        n = rnd.randint(5, 60)
        rows = [(i, str(rnd.randint(0, 8)), str(rnd.randint(0, 8))) for i in rnd.sample(range(1000), n)]
        assert run(spark, rows) == sequential(rows)


def test_null_keys_never_collide(spark):
    rows = [(0, None, "a"), (1, None, "b"), (2, "x", None), (3, "x", "c"), (4, None, None), (5, None, None)]
    assert run(spark, rows) == sequential(rows) == [0, 1, 2, 4, 5]


def test_incremental_equals_full(spark):
    rnd = random.Random(3)
    rows = [(i, str(rnd.randint(0, 10)), str(rnd.randint(0, 10))) for i in range(80)]
    df = spark.createDataFrame(rows, "o long, k1 string, k2 string")
    first = D.greedy_dedupe(df.where(F.col("o") < 40), ["k1", "k2"], "o")
    second = D.greedy_dedupe(df.where(F.col("o") >= 40), ["k1", "k2"], "o", seen=D.seen_keys(first, ["k1", "k2"]))
    got = sorted(r[0] for r in first.union(second).select("o").collect())
    assert got == sequential(rows)


def test_same_answer_on_one_and_many_partitions(spark):
    rnd = random.Random(11)
    rows = [(i, str(rnd.randint(0, 5)), str(rnd.randint(0, 5))) for i in range(100)]
    df = spark.createDataFrame(rows, "o long, k1 string, k2 string")
    a = sorted(r[0] for r in D.greedy_dedupe(df.coalesce(1), ["k1", "k2"], "o").select("o").collect())
    b = sorted(r[0] for r in D.greedy_dedupe(df.repartition(8), ["k1", "k2"], "o").select("o").collect())
    assert a == b == sequential(rows)


def test_ban_rows(spark):
    df = spark.createDataFrame([("Image 1 of 3 Image 2 of 3 Image 3 of 3", []), ("ok", ["News Traffic Weather"]),
                                ("Image 1 of 2 Image 2 of 2", ["A"])], "text string, authors array<string>")
    out = D.ban_rows(df, keep_rejects=True).select("ban_reason").collect()
    assert [r[0] for r in out] == ["gallery", "author_line", None]


def test_hot_key_third_of_rows(spark):
    """One url key holds a third of the rows; the answer must still equal the sequential walk."""
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        k1 = "hot" if i % 3 == 0 else str(rnd.randint(0, 60))
        rows.append((i, k1, str(rnd.randint(0, 80))))
    assert run(spark, rows) == sequential(rows)


def test_mark_seen_is_exact(spark):
    """No wrong answer at any number of keys; nulls, repeated keys and a clashing column are defined cases."""
    members = spark.createDataFrame([(f"key{i}", 1) for i in range(0, 6000, 2)] * 2 + [(None, 1)], "k string, seen int")
    probe = spark.createDataFrame([(i, f"key{i}") for i in range(6000)] + [(6000 + i, "key4") for i in range(3000)] + [(9000, None)],
                                  "id int, k string")
    out = {r["id"]: r["seen"] for r in D.mark_seen(probe, "k", members, "k").collect()}
    assert len(out) == 9001
    assert all(out[i] == (i % 2 == 0) for i in range(6000)) and all(out[i] for i in range(6000, 9000)) and not out[9000]
    assert not any(r["seen"] for r in D.mark_seen(probe, "k", members.limit(0), "k").collect())


def test_long_chain_takes_logarithmic_steps(spark):
    """Row i shares k1 with row i - 1 or k2 with row i + 1, so the sequential walk alternates over 10,000 rows."""
    n = 10_000
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(n)]
    assert run(spark, rows) == sequential(rows)
    assert D.LAST_ROUNDS[-1] <= 30


def test_chains_with_branches_and_crowds(spark):
    rnd = random.Random(11)
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(300)]                         # a chain
    rows += [(1000 + i, f"a{rnd.randint(0, 150)}", f"c{i // 3}") for i in range(200)]         # rows that hang on it
    rows += [(2000 + i, "hot", f"b{rnd.randint(0, 400)}") for i in range(300)]                # one key with many rows
    rows += [(3000 + i, f"d{i // 2}", f"e{(i + 1) // 2}") for i in rnd.sample(range(99), 80)]  # broken chains
    assert run(spark, rows) == sequential(rows)
