"""Embedding links, groups and recall against brute force; odd vectors."""

import numpy as np
import pytest

from attestra.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for p in range(len(good)):
        for q in range(p):
            (i, a, la), (j, b, lb) = good[p], good[q]
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return links, {i: find(i) for i in root}


def sample():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        v = rng.standard_normal(32)
        rows.append((len(rows), v.astype(np.float32).tolist(), i % 3))
        for _ in range(rng.integers(0, 4)):
            near = v + rng.standard_normal(32) * rng.choice([0.0, 0.02, 0.1, 0.25])
            rows.append((len(rows), (near * rng.choice([1.0, 3.0])).astype(np.float32).tolist(), i % 3))
    v = rng.standard_normal(32)
    for _ in range(80):  # a group in one bucket
        rows.append((len(rows), (v + rng.standard_normal(32) * 0.03).astype(np.float32).tolist(), 1))
    odd = [None, [], [0.0] * 32, [1.0, None] * 16, [float("nan")] * 32, [float("inf")] * 32, [1.0] * 16, [1.0] * 16]
    rows += [(1000 + k, x, 1) for k, x in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], 99), (2002, [1e30] * 32, 5), (2003, [1e-30] * 32, 5)]
    return rows


@pytest.mark.parametrize(("small_bucket", "block"), [(64, 2048), (4, 16)])
def test_links_and_groups(spark, small_bucket, block):
    rows = sample()
    links, groups = brute(rows)
    got = {r["vec_id"]: r for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA), small_bucket=small_bucket, block=block).collect()}
    assert len(got) == len(rows)
    total = sum(links.values())
    assert all(got[i]["n_links"] <= n for i, n in links.items()) and sum(r["n_links"] for r in got.values()) >= 0.99 * total
    right = sum(got[i]["component_id"] == g for i, g in groups.items())
    assert right >= 0.99 * len(rows) and got[1000]["n_links"] == 0 and got[1006]["n_links"] == 1 and got[2000]["n_links"] == 0 and got[2002]["n_links"] == 1


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (2, [0.0, 1.0], 1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA + ", node string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in E.near_duplicates(frame).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("2", 0, "2"), ("None", 0, "None")]
    assert E.near_duplicates(frame.limit(0)).count() == 0


def test_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    a = E.unit(rng.standard_normal((2000, 64)))
    other = rng.standard_normal((2000, 64))
    other = E.unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * other
    assert (E.bucket_keys(a) == E.bucket_keys(b)).any(axis=1).mean() > 0.93
