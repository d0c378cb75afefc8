"""Registered queries on the small tables: against their SQL, plain versions, exact round trips or held-out labels."""

import os
import zlib

import numpy as np
import pytest

import seqweave.llm.queries as q
from tests.llm import plain
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return {r["doc_id"]: r for r in q.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    ok, message, _, _ = compare(spark, connect(SF), name, q.QUERIES[name], q.SQL[name], SF)
    assert ok, message


def test_op1(spark, texts):
    got, ids = result(spark, "op1_document_fingerprints"), sorted(texts)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        text, quarter = texts[i] or "", len(texts[i] or "") // 4
        edited = text[: len(text) - quarter] + (texts[after] or "")[:quarter]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), plain.sha256(edited))
        assert got[i]["fingerprint"] == "".join(f"{x:x}" for x in plain.fingerprint(text))
        a, b = plain.shingles(text), plain.shingles(edited)
        assert abs(got[i]["near_edited"] - len(a & b) / max(1, len(a | b))) < 0.25


def test_op2(spark, texts):
    for i, r in result(spark, "op2_secret_scan").items():
        spans = plain.base_secrets(texts[i])
        assert r["base_sha256"] == plain.sha256(plain.joined(spans))
        assert set(plain.joined(spans).split(",")) <= set(r["spans"].split(",")) | {""}


def test_op3(spark, texts):
    want = plain.components(texts)
    got = result(spark, "op3_ngram_jaccard_join")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(plain.shingles(t)), want[i]) for i, t in texts.items()}


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(q.public_tokenizers.path("byte_bpe_50k.json")), q.QUERIES["op6_packing"](spark, SF).collect()
    held: dict[int, list] = {}
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(part.tobytes()))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        ends = [a + b for a, b in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sum(r.length for r in rows) == sum(x.doc_tokens for x in rows if x.start == 0)


def test_op9(spark, texts):
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, item in items.items() if item in " ".join((t or "").lower().split())}
    assert want <= {(r.doc_id, r.item_id) for r in q.QUERIES["op9_decontamination"](spark, SF).collect()}


def test_pipeline(spark, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    quality = result(spark, "op7_quality")
    good = {i: t for i, t in texts.items() if quality[i]["predicted"] == 1}
    groups = plain.components(good)
    one = {i: t for i, t in good.items() if groups[i] == i}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.STAGES[1][1](spark, pipeline.STAGES[0][1](spark, docs, SF), SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(one)
    leaked = {r.doc_id for r in q.QUERIES["op9_decontamination"](spark, SF).collect()}
    pieces = pipeline.run(spark, SF).select("doc_id", "start", "length", "doc_tokens").collect()
    assert {p.doc_id for p in pieces} == set(one) - leaked
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
