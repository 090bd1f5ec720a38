"""The registered text queries on the smallest tables: against SQL, or their contract."""

import collections
import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tallyfold.llm import bpe, queries
from test_registry import ordered


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, tables, name):
    df = entry.queries()[name](spark, tables)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, cursor.fetchall())


def test_all_are_registered():
    names = sorted(queries.QUERIES)
    assert [n for n in names if n == "pipeline"] and sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert set(queries.QUERIES) <= set(entry.queries())


def test_packed_documents(spark, duck, tables):
    rows = entry.queries()["op8_packed_sequences"](spark, tables).collect()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    lengths, at = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        ids = np.append(bpe.encode(texts[r["doc_id"]] or "", bpe.default_path()), 0).astype("<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        lengths[r["doc_id"]] += r["length"]
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(lengths[d] == len(bpe.encode(t or "", bpe.default_path())) + 1 for d, t in texts.items())
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


def test_section_tokens_add_up(spark, duck, tables):
    rows = entry.queries()["op5_section_tokens"](spark, tables).collect()
    total = collections.Counter()
    for r in rows:
        total[r["doc_id"]] += r["tokens"]
    for doc, source, text in duck.execute("SELECT doc_id, source, text FROM documents").fetchall():
        assert total[doc] == len(bpe.encode(f"{source or ''}\n{text or ''}", bpe.default_path()))


def test_every_document_has_a_class_and_a_score(spark, duck, tables):
    ids = [r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()]
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    classes = entry.queries()["op4_jaccard_classes"](spark, tables).collect()
    assert sorted(r["doc_id"] for r in classes) == sorted(ids)
    assert all(r["text_md5"] == hashlib.md5(texts[r["doc_id"]].encode()).hexdigest() for r in classes)
    scores = entry.queries()["op7_toxicity_scores"](spark, tables).collect()
    assert sorted(r["doc_id"] for r in scores) == sorted(ids)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in scores)


def test_leaks_are_what_the_texts_hold(spark, duck, tables):
    words = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()) + " "
    items = [(i, words(t)) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i) for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall() for i, w in items if w.strip() and w in words(t)}
    got = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op3_benchmark_leaks"](spark, tables).collect()}
    assert want and want <= got
