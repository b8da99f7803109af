import numpy as np
import pytest
import zlib
from collections import defaultdict

from corpusmill.llm.packing import pack
from corpusmill.llm.quality_classifier import quality_scores
from corpusmill.llm.quality_rules import clean_lines, judge
from corpusmill.llm.secrets import redact
from corpusmill.llm.simhash import fingerprint
from corpusmill.llm.tokens import WordEncoder

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty, odd = docs.limit(0), docs.selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "source", "cast(null as bigint) n_chars").limit(3)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, empty, SF).collect() == []
        assert len(stage(spark, odd, SF).collect()) <= 3
    assert pipeline.STAGES[-1][1](spark, empty, SF).collect() == []


def test_stages_against_plain_python_with_failing_lines_removed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = {r.doc_id: r.text for r in docs.collect()}
    likely = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    text = {d: clean_lines(raw[d])[0] for d in sorted(likely) if judge(raw[d])[6]}
    prints, root = {d: fingerprint(t) for d, t in text.items()}, {d: d for d in text}
    links = [(a, b) for a in text for b in text if (prints[a] ^ prints[b]).bit_count() <= 3]
    for _ in text:  # smallest id spreads over links
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    ids = {d: WordEncoder().encode(redact(t)).tolist() + [2] for d, t in text.items() if root[d] == d}
    assert any(text[d] != raw[d] for d in ids)
    found = defaultdict(list)
    for r in pipeline.run(spark, SF).collect():
        found[r.doc_id].append(r)
    assert set(found) == set(ids) and len(ids) < len(text) < len(raw)
    for d, rows in found.items():
        parts = sorted(rows, key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts[:-1]]).tolist()
        for r in parts:
            assert r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(len(x) for x in ids.values()) == sum(sum(n for *_, n in s) for s in pack([len(x) for x in ids.values()])[0])
