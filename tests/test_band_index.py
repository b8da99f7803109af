"""The index by band keys against plain comparison of all texts, and what a batch reads and writes."""

import random
from pathlib import Path

import pytest

from corpusmill.operators import dedup
from corpusmill.operators.band_index import BandIndex
from corpusmill.operators.stored import Scratch

T = "row_id long, text string"


def rows_of(hits):
    return sorted((r.row_id, r.match_id, round(r.jaccard, 6), r["rank"]) for r in hits.collect())


def plain(batches, threshold=0.85):
    """The hits of each batch by comparing each text with all earlier ones."""
    firsts, out = {}, []
    for batch in batches:
        found = []
        for row_id, raw in sorted(batch):
            norm = " ".join(raw.lower().split())
            if not norm:
                continue
            if norm in firsts:
                found.append((row_id, firsts[norm][0], 1.0, 1))
                continue
            own = set(dedup.shingle_set(norm).tolist())
            hits = [(-len(own & s) / len(own | s), i) for i, s in firsts.values()]
            hits = sorted(h for h in hits if -h[0] >= threshold)
            found += [(row_id, i, round(-j, 6), k) for k, (j, i) in enumerate(hits, 1)]
            firsts[norm] = (row_id, own)
        out.append(sorted(found))
    return out


def made(seed, batches, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(30)) for _ in range(40)]
    out = []
    for b in range(batches):
        rows = []
        for i in range(size):
            t = rng.choice(base).split()
            kind = rng.random()
            if kind < 0.4:
                t[rng.randrange(len(t))] = word()
            elif kind < 0.7:
                t = [word() for _ in range(30)]
            rows.append((b * 1000 + i, " ".join(t)))
        rows.append((b * 1000 + 999, " \n"))
        out.append(rows)
    return out


def test_batches_give_the_hits_of_all_earlier_texts(spark, tmp_path):
    batches = made(1, 4, 30)
    index = BandIndex(spark, str(tmp_path / "index"), fill=64, fan=2)
    for k, (batch, want) in enumerate(zip(batches, plain(batches))):
        for _ in range(1 + (k == 2)):  # a batch that runs again changes nothing
            got = rows_of(index.add(spark.createDataFrame(batch, T), k))
            assert got == want
    assert sum(r["rows"] for r in index.runs()) == len({" ".join(t.split()) for b in batches for _, t in b if t.strip()})
    assert [r["level"] for r in index.runs()] == [2]  # four batches, merged two by two
    with pytest.raises(ValueError, match="batch 1"):
        index.add(spark.createDataFrame(batches[1], T), 1)
    seen = []
    index.query(spark.createDataFrame([(7, batches[0][0][1]), (8, batches[0][0][1] + " x"), (9, batches[0][0][1] + " x")], T), lambda df: seen.extend(rows_of(df)))
    assert (7, batches[0][0][0], 1.0, 1) in seen and [r[1:] for r in seen if r[0] == 8] == [r[1:] for r in seen if r[0] == 9] != []


def test_a_failed_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    index = BandIndex(spark, str(tmp_path / "index"))
    batches = made(2, 2, 12)
    index.add(spark.createDataFrame(batches[0], T), 0)
    with monkeypatch.context() as m:
        m.setattr(BandIndex, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.add(spark.createDataFrame(batches[1], T), 1)
    assert rows_of(index.add(spark.createDataFrame(batches[1], T), 1)) == plain(batches)[1]


def test_empty_batches_and_folders_opened(spark, tmp_path):
    index = BandIndex(spark, str(tmp_path / "index"), fill=16, fan=100)
    assert index.add(spark.createDataFrame([], T), 0).collect() == [] and index.runs() == []
    batches = made(3, 1, 200)
    index.add(spark.createDataFrame(batches[0], T), 1)
    (run,) = index.runs()
    folders = list((tmp_path / "index" / "runs" / run["id"] / "keys").glob("part=*"))
    assert 2 ** run["bits"] >= len(folders) > 50
    one = spark.createDataFrame([(5, "asked once")], T).selectExpr("row_id", "text norm").withColumn("digest", dedup.digest("norm"))
    keys = index._sketched(one).selectExpr("explode(keys) key")
    assert len(index._opened(run, "keys", keys, "key").inputFiles()) == len(folders)  # inputFiles ignores the filter; the scan does not
    plan = index._opened(run, "keys", keys, "key")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan


def test_work_of_a_batch_does_not_grow_with_the_index(spark, tmp_path):
    """Ten batches of new texts: what is written stays within the logarithm, and a lookup opens no more folders than it has keys."""
    index = BandIndex(spark, str(tmp_path / "index"), fill=32, fan=3)
    batches = made(4, 10, 30)
    opened = []
    original = BandIndex._opened

    def counting(self, run, name, asked, column):
        table = original(self, run, name, asked, column)
        opened[-1] += table.select("part").distinct().count()
        return table

    BandIndex._opened = counting
    try:
        for k, batch in enumerate(batches):
            opened.append(0)
            index.add(spark.createDataFrame(batch, T), k)
    finally:
        BandIndex._opened = original
    live = {r["id"] for r in index.runs()}
    files = [p for p in Path(tmp_path / "index" / "runs").rglob("*.parquet") if p.parts[-4] in live]
    rows = sum(r["rows"] for r in index.runs())
    assert len(index.runs()) <= 3 * 3 and files and rows > 150
    assert max(opened[5:]) <= 3 * 31 * (dedup.BANDS + 2)
    assert not [p for p in Path(tmp_path).rglob("scratch-*")]


def test_as_a_stream(spark, tmp_path):
    from corpusmill.streaming import incremental

    source, seen = tmp_path / "in", []
    source.mkdir()
    (source / "a.json").write_text('{"row_id": 1, "text": "The quick brown fox jumps over the lazy dog in the yard"}\n')
    index = BandIndex(spark, str(tmp_path / "index"))
    stream = lambda: incremental.read_json_stream(spark, str(source), T)
    run = lambda: incremental.run_available(stream(), index.each(lambda df, _: seen.extend(rows_of(df))), str(tmp_path / "ck"))
    run()
    (source / "b.json").write_text('{"row_id": 2, "text": "The quick brown fox jumps over the lazy dog in the yards"}\n')
    run()
    assert [r[:2] for r in seen] == [(2, 1)]


def test_a_batch_is_compared_with_the_index_and_itself_at_once(spark, tmp_path, monkeypatch):
    """One pass over the pairs for both, which gives what two passes give; each normal form is made once."""
    batches = made(5, 2, 40)
    asked, plans, original, put = [], [], dedup.similar, Scratch.__call__
    monkeypatch.setattr(dedup, "similar", lambda *a, **k: asked.append(1) or original(*a, **k))
    monkeypatch.setattr(Scratch, "__call__", lambda self, rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or put(self, rows))
    index = BandIndex(spark, str(tmp_path / "index"))
    got = [rows_of(index.add(spark.createDataFrame(b, T), k)) for k, b in enumerate(batches)]
    assert got == plain(batches) and len(asked) == 2
    assert [p.count("normalized_exact(") for p in plans if "normalized_exact(" in p] == [1, 1]
    monkeypatch.undo()
    new, old = (dedup.sketches(dedup._firsts(spark.createDataFrame(b, T).withColumnRenamed("text", "norm"))).localCheckpoint() for b in batches[::-1])
    pairs = lambda df: sorted((r.left_id, r.right_id, r.jaccard) for r in df.collect())
    two = pairs(original(new, old)) + pairs(original(new))
    for block in (512, 3):
        assert pairs(original(new, old, both=True, block=block)) == sorted(two) != []


def test_common_shingles_and_least_hashes(spark):
    rng = random.Random(6)
    texts = ["", "ab", "abcab", *("".join(rng.choices("abc ", k=n)) for n in (6, 1030, 5000))]
    for s in map(dedup.shingle_set, texts):
        assert (s[1:] > s[:-1]).all()
        for t in map(dedup.shingle_set, texts):
            assert dedup._common(s, t) == len(set(s.tolist()) & set(t.tolist()))
    a, b = (x.tolist() for x in dedup._multipliers(8))
    mix = lambda v: v ^ v >> 31
    want = []
    for t in texts:
        least = [min((mix((int(x) * p + q) % 2**64) for x in dedup.shingle_set(t)), default=None) for p, q in zip(a, b)]
        want.append([(sum((v ^ v >> 27) * w for v, w in zip(least[i : i + 4], a)) + 2**63) % 2**64 - 2**63 for i in (0, 4)] if t else [])
    got = dedup.sketches(spark.createDataFrame(list(enumerate(texts)), "row_id long, norm string"), num_perm=8, bands=2).orderBy("row_id").collect()
    assert [r["keys"] for r in got] == want
