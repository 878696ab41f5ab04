"""Plans that hold on long sessions, many copies and ties."""

import random
from collections import Counter

from strandline.operators import events, inference, joins, structure


def test_path_counts_read_a_session_once(spark):
    chain = [i * i % 7 % 3 for i in range(3000)]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(chain)] + [("short", 0, 1)], "s string, i int, x int")
    paths = [[0, 1], [1, 2, 0], [0, 1, 1, 0], [9, 0]]
    df = inference.path_counts(rows, ["s"], "i", "x", spark.createDataFrame([(p,) for p in paths], "path array<int>"))
    assert "currentrow$(), unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {tuple(r["path"]): (r["count"], r["expected"]) for r in df.collect()}
    moves, left = Counter(zip(chain, chain[1:])), Counter(chain[:-1])
    for p in paths:
        n = len(p)
        want = float(sum(x == p[0] for x in chain[: len(chain) - n + 1]))
        for a, b in zip(p, p[1:]):
            want *= moves[a, b] / left[a] if left[a] else 0
        assert got[tuple(p)] == (sum(chain[i : i + n] == p for i in range(len(chain) - n + 1)), round(want, 6))


def test_copies_are_joined_once_and_all_their_pairs_come_out(spark):
    points = [("a", 1.0, None if i == 7 else i) for i in range(1500)] + [("a", 12.5, 9000), ("b", 1.0, 9001), ("a", None, 9002)]
    spans = [("a", 0.5, 12.0, i) for i in range(3)] + [("a", 1.0, 1.0, 10), ("a", 12.5, 31.0, None), ("b", None, 3.0, 12)]
    p, s = spark.createDataFrame(points, "k string, t double, i int"), spark.createDataFrame(spans, "k string, lo double, hi double, j int")
    df = joins.interval_join(p, s, ["k"], "t", "lo", "hi", 10.0, copies=True)
    assert df.columns == joins.interval_join(p, s, ["k"], "t", "lo", "hi", 10.0).columns
    want = Counter((k, t, i, lo, hi, j) for k, t, i in points for b, lo, hi, j in spans if k == b and None not in (t, lo) and lo <= t < hi)
    assert Counter(map(tuple, df.collect())) == want


def test_tied_intervals_merge_in_any_order(spark):
    rows = [(k, s, s + d) for k in range(20) for s in (0, 0, 0, 3, 3, 9, 9, 20, 20, 21) for d in (2, 2, 5)]
    for merge, by, gap, n in ((events.merged_intervals, ["k"], 0, "n"), (structure.adjacent_intervals, ["k"], 1, "members")):
        for seed in (1, 2):
            df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "k int, s int, e int").repartition(5)
            want = []
            for k, s, e in sorted(rows):
                if want and want[-1][0] == k and s <= want[-1][2] + gap:
                    want[-1] = (k, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
                else:
                    want.append((k, s, e, 1))
            assert sorted(map(tuple, merge(df, by, "s", "e").select("k", "s", "e", n).collect())) == want
