import math
import random

import numpy as np
import pytest

from corpusmill.llm.embedding_dedup import LEAST_BITS, MISS, SPARE, _forest, embedding_groups, signatures, tables_for, unit_rows

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.93):
    """n_links and component of each row over all pairs of rows of a label."""
    def ok(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    root = list(range(len(rows)))
    links = [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((top(i), top(j)))
                    root[q] = p
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[top(i)] = min(names.get(top(i), r[0]), r[0])
    return sorted(((-1 if r[0] is None else r[0]), links[i], names.get(top(i), -1)) for i, r in enumerate(rows))


def planted(seed=1, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        base = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows) * 3 + 1, (base + rng.normal(size=dims) * rng.choice([0, 0.05, 0.25])).tolist(), int(rng.integers(0, 2)), ""))
    hot = rng.normal(size=dims)
    rows += [(1000 + i, (hot + rng.normal(size=dims) * 0.1).tolist(), 0, "") for i in range(60)]
    rows += [(2000 + i, [1.0] * dims, 1, "") for i in range(30)]
    odd = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), [1.0] * (dims + 1), [1e-38] * dims]
    rows += [(3000 + i, v, 1, "") for i, v in enumerate(odd)] + [(3100, [1.0] * dims, None, ""), (2000, [1.0] * dims, 1, ""), (None, [1.0] * dims, 1, ""), (None, None, 1, "")]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_links_and_components_match_brute_force(spark, block):
    rows = planted()
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, miss=1e-7).collect()
    assert sorted(((-1 if r.vec_id is None else r.vec_id), r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("bits", [1, 5, 10, 14])
def test_recall_at_the_threshold(bits):
    rng = np.random.default_rng(0)
    x = unit_rows(rng.normal(size=(4000, 64)))
    y = rng.normal(size=x.shape)
    y = unit_rows(y - (y * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    tables = tables_for(bits)
    assert (signatures(x, tables, bits) == signatures(y, tables, bits)).any(axis=1).mean() > 0.999
    alike = (1 - math.acos(0.93) / math.pi) ** bits
    assert (1 - alike) ** tables <= MISS < (1 - alike) ** (tables - 1)
    assert tables_for(0) == 1 and (signatures(x, 1, 0) == 0).all()


def test_many_classes_of_a_label_match_brute_force(spark):
    """3,000 vectors of one label, links planted around the threshold."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[1000:2000] = x[:1000] + rng.normal(size=(1000, 24)) * rng.uniform(0.1, 0.6, size=(1000, 1))
    rows = [(i, v, 0, "") for i, v in enumerate(x.astype(np.float32).tolist())]
    u = unit_rows(np.array([r[1] for r in rows]))
    linked = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(3000)] == linked.tolist() and linked.sum() > 500


def test_empty_table(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_forest_reaches_over_chains():
    order = list(range(50))
    random.Random(0).shuffle(order)
    assert set(_forest(50, np.array(order[:-1]), np.array(order[1:]))) == {0}


@pytest.mark.parametrize("n", [40, 400, 4000])
def test_fewer_pairs_are_compared_than_all_at_any_size(n):
    """By the operator's own bits and tables: buckets hold a small part of all pairs, and links at the threshold are found."""
    rng = np.random.default_rng(n)
    x = unit_rows(rng.normal(size=(n, 64)))
    bits = max(LEAST_BITS, math.ceil(math.log2(n)) + SPARE)
    s = signatures(x, tables_for(bits), bits)
    compared = sum(int((c * (c - 1) // 2).sum()) for t in range(s.shape[1]) for c in [np.unique(s[:, t], return_counts=True)[1]])
    assert compared < (0.25 if n < 100 else 0.06) * n * (n - 1) / 2
    y = unit_rows(rng.normal(size=(n, 64)))
    y = unit_rows(y - (y * x).sum(axis=1, keepdims=True) * x)
    near = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    assert (signatures(near, tables_for(bits), bits) == s).any(axis=1).all()


def test_buckets_are_compared_whole_wherever_batches_are_cut(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + 0.03 * rng.normal(size=8)).tolist(), i % 3, "x") for i in range(700)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        got = embedding_groups(spark.createDataFrame(rows, SCHEMA), miss=1e-7).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute([(r[0], [float(np.float32(v)) for v in r[1]], r[2]) for r in rows])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
