"""In-order packing by ranges against the plain walk."""

import random

import pytest

from corpusmill.operators import tokens


def plain(lens, limit):
    pack, fill, out = -1, None, []
    for n in lens:
        if tokens._opens(fill, n, limit):
            pack, fill = pack + 1, 0
        out.append((pack, fill))
        fill += n
    return out, pack + 1, fill


@pytest.mark.parametrize("seed", range(6))
def test_transfer_functions_tell_what_a_walk_would_do(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 7, 20])
    for _ in range(300):
        lens = [rng.choice([0, 1, 2, 3, 5, 8, limit, limit + 1, 3 * limit]) for _ in range(rng.randint(1, 25))]
        act = tokens._transfer(lens, limit)
        assert len(act[0]) <= limit + 1
        for fill in [None, *range(3 * limit + 2)]:
            done, now = 0, fill
            for n in lens:
                if tokens._opens(now, n, limit):
                    done, now = done + 1, 0
                now += n
            assert tokens._acted(fill, *act) == (done, now)


@pytest.mark.parametrize("by", [None, "part"])
def test_packs_by_ranges_equal_the_walk(spark, by):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 30, 90, 100, 250]), "hot" if i % 10 else f"k{i % 7}") for i in range(6000)]
    got = tokens.in_order_packs(spark.createDataFrame(rows, "row_id long, len long, part string").repartition(5), 200, by).collect()
    for key in {r[2] for r in rows} if by else {None}:
        own = [r for r in rows if by is None or r[2] == key]
        want, _, _ = plain([r[1] for r in own], 200)
        mine = sorted((r.row_id, r.len, r.pack_no, r.offset) for r in got if by is None or r.part == key)
        assert mine == [(r[0], r[1], p, o) for r, (p, o) in zip(own, want)]
    assert len(got) == len(rows)


def test_a_million_rows_and_no_task_that_reads_them_all(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("id as row_id", "id * 7919 % 600 + 1 as len")
    got = tokens.in_order_packs(rows, 4096)
    told = got.selectExpr("count(*) c", "max(pack_no) p", "sum(pack_no) s", "sum(offset) o").first()
    want, packs, _ = plain([i * 7919 % 600 + 1 for i in range(n)], 4096)
    assert tuple(told) == (n, packs - 1, sum(p for p, _ in want), sum(o for _, o in want))


def test_empty_tables(spark):
    assert tokens.in_order_packs(spark.createDataFrame([], "row_id long, len long"), 10).collect() == []
