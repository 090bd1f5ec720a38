"""Fill-in-the-middle: the rank index against the offsets themselves, examples against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyfold.llm import fim


def texts():
    rng = random.Random(5)
    some = ["a", "é", "漢", "😀", " ", "\n"]
    yield from ["", "a", "é", "漢字", "😀", "plain ascii " * 500, "漢" * 4000, "é" * 300 + "a" * 300]
    yield "".join(rng.choice(some) for _ in range(20_000))
    yield "a" * 50_000 + "漢" * 50_000 + "é" * 50_000 + "".join(rng.choice(some) for _ in range(50_000))
    yield "".join(("a" * k + "😀" * (500 - k)) for k in range(0, 500, 7))
    for n in range(1, 60):
        yield "".join(rng.choice(some) for _ in range(n))


@pytest.mark.parametrize("error", [0, 1, 7, 126])
def test_index_gives_every_boundary(error):
    for text in texts():
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        want = np.cumsum([0, *[len(c.encode()) for c in text]])
        bounds = fim.char_bounds(data)
        assert bounds.tolist() == want.tolist()
        index = fim.fit(bounds, error)
        ranks = np.arange(len(want))
        assert index.units == len(text) and index.offsets(ranks).tolist() == want.tolist()
        assert np.abs(index.predict(ranks) - want).max() <= error + 1


def test_straight_text_is_one_segment_and_segments_are_few():
    assert len(fim.fit(np.arange(100_001)).starts) == 1
    rng = np.random.default_rng(1)
    mixed = np.concatenate([[0], np.cumsum(rng.choice([1, 2], 200_000, p=[0.95, 0.05]))])
    assert len(fim.fit(mixed).starts) < 60


def example(doc, text, salt="1"):
    """The contract in plain Python."""
    text = text or ""
    h = hashlib.sha256(f"{salt}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, None, None, "plain", text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, a, b - a, "spm", f"<S>{s}<P>{p}<M>{m}"
    return n, a, b - a, "psm", f"<P>{p}<S>{s}<M>{m}"


def test_examples_equal_plain_python_and_come_back(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(1000, None), (1001, "has <P> inside"), (1002, "<S"), (None, "no id"), (1004, "x<"), (1004, "x<"), (1005, "S>P>M><"), (1006, "w " * 300_000)]
    rows += [(2000 + i, "a<P" + "é>" * (i % 5) + "<<S") for i in range(200)]
    # names that clash with the operator's own
    df = spark.createDataFrame([Row(doc_id=d, text=t, _text=1, _n="k", form="f") for d, t in rows], "doc_id long, text string, _text int, _n string, form string")
    out = fim.fill_in_middle(df.repartition(3))
    assert out.columns == ["doc_id", "text", "_text", "_n", "form", "example"]
    out = out.withColumn("back", fim.restored(F.col("example.form"), F.col("example.output")))
    got = out.collect()
    assert len(got) == len(rows) and all(r["_text"] == 1 and r["_n"] == "k" and r["form"] == "f" for r in got)
    kinds = set()
    for r in got:
        assert tuple(r["example"]) == example(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        kinds.add(r["example"]["form"])
    assert kinds == {"plain", "psm", "spm"}


def test_lines_as_units_and_an_empty_table(spark):
    df = spark.createDataFrame([(i, "one\ntwo\n\nlast" if i % 2 else "ends\n") for i in range(60)], "doc_id long, text string")
    out = fim.fill_in_middle(df, unit="line", plain_percent=0)
    out = out.withColumn("back", fim.restored(F.col("example.form"), F.col("example.output"))).collect()
    assert all(r["back"] == r["text"] and r["example"]["n"] == (4 if r["doc_id"] % 2 else 1) for r in out)
    for r in out:
        prefix = r["example"]["output"].split("<P>")[1].split("<S>")[0].split("<M>")[0]
        assert prefix == "".join(r["text"].splitlines(keepends=True)[: r["example"]["prefix_units"]])
    assert fim.fill_in_middle(df.limit(0)).count() == 0
