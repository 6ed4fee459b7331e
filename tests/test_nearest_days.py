import itertools

import numpy as np

from dwellspark.operators import patterns as pt


def test_nearest_days_come_from_long_rows(spark):
    rng = np.random.default_rng(3)
    x = {(key, day): {f"f{i}": float(rng.random()) for i in rng.choice(9, 4, replace=False)} for key in "ab" for day in range(20)}
    x["a", 3] = x["a", 7]  # equal days stand by their day
    long = spark.createDataFrame([(*at, f, v) for at, h in x.items() for f, v in h.items()], "key string, day int, feature string, value double")
    labels = spark.createDataFrame([(key, day, day % 4 - 1) for key, day in x], "key string, day int, label int")
    want = set()
    for key in "ab":
        for label in (0, 1, 2):
            days = [d for k, d in x if k == key and d % 4 - 1 == label]
            v = np.array([[x[key, d].get(f"f{i}", 0.0) for i in range(9)] for d in days])
            d2 = ((v - v.mean(axis=0)) ** 2).sum(axis=1).round(9)
            want |= {(key, label, r + 1, d) for r, (_, d) in enumerate(sorted(zip(d2, days))[:3])}
    assert {tuple(r) for r in pt.nearest_days(long, labels).collect()} == want


def test_equally_near_days_go_by_day(spark):
    # four days of features of their own, with equal values in other orders: their squared distances are equal and lie within 1e-18 of half a ninth digit
    same = [(140742210, 164900526, 105315435), (140742210, 164900526, 146721685), (24077579, 165429342, 78574786), (155046599, 62211836, 134048813), (163583989, 171961586, 25614478)]
    orders = list(itertools.permutations(range(3)))
    keys = {f"v{i}-{j}": [[x[o] for o in orders[(j + k) % 6]] for k in range(4)] for i, x in enumerate(same) for j in range(6)}
    long = spark.createDataFrame([(key, day, f"f{day}-{f}", v / 1e9) for key, days in keys.items() for day, held in enumerate(days) for f, v in enumerate(held)], "key string, day int, feature string, value double")
    labels = spark.createDataFrame([(key, day, 0) for key in keys for day in range(4)], "key string, day int, label int")
    assert {tuple(r) for r in pt.nearest_days(long, labels).collect()} == {(key, 0, day + 1, day) for key in keys for day in range(3)}
