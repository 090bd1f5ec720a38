"""Interleaved shards and secret scans against brute force, and their edge cases."""

import collections
import random
import re

from pyspark.sql import functions as F

from tallyfold.llm import secret_scan, sharding


def dealt(spark, rows, shards=7):
    df = spark.createDataFrame(rows, "doc_id long, source string, bucket int, _start int")
    return sharding.interleave(df, shards, seed=3).collect()


def check_law(out, total, shards):
    sizes = collections.Counter(r["shard"] for r in out)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes.get(s, 0)))


def test_every_shard_has_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), 1, 2) for i in range(3000)]
    rows += rows[:20] + [(None, "a", 1, 2), (None, None, 1, 2)]
    rng.shuffle(rows)
    out = dealt(spark, rows)
    check_law(out, len(rows), 7)
    share = collections.Counter(r[1] for r in rows)
    for s in range(7):
        here = collections.Counter(r["source"] for r in out if r["shard"] == s)
        for source, n in share.items():
            assert abs(here[source] - n / 7) <= 3
    # neither the order of rows nor the bucket size matters
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100_000)
    again = dealt(spark, rows[::-1])
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["source"] or "", r["shard"], r["slot"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_few_or_no_rows(spark):
    check_law(dealt(spark, [(1, "a", 0, 0), (2, None, 0, 0)]), 2, 7)
    assert dealt(spark, []) == []


NAME = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    out = []
    for kind, pattern, keep in (
        ("assign", re.compile(NAME, re.I), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ):
        for m in pattern.finditer(text or ""):
            if keep(m):
                out.append((m.start(), secret_scan.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


LIVE = "aB3dE5gH7jK9mN1pQ3sT"


def corpus():
    rng = random.Random(8)
    bits = ["password = 'hunter2hunter2'", "token:abc", 'token="secret": "abcdefghijklmnop"', "é api_key=ABCDEF123456", "AKIA" + "Z" * 14,
            "AKIA" + "Z" * 13, "AKIAAKIA" + "0" * 12, "0123456789abcdef", "0123456789abcde", "deadbeef" * 5, "SECRET : 'x.y=z-12345678'",
            "passwd==aaaaaaaaaaaaaaa", "plain words", "\n", "ünï", LIVE, "token=password=abcdefghijklmnop", "apikey='0123456789abcdef01'"]
    rows = [(i, f"s{i % 4}", " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500, "s0", None), (501, None, ""), (None, "s1", "password=aaaaaaaaaaaaaaaa")]
    rows += [(502, "s1", " ".join(["token=abcdefghijkl" + str(k) for k in range(700)])), (503, "s9", "key " + LIVE[::-1])]
    return rows + rows[-2:]


def test_spans_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, row_of string")
    out = secret_scan.scan(df, repository="source").collect()
    assert len(out) == len(rows)
    want = collections.Counter((i, tuple(base_spans(t))) for i, _, t in rows)
    listed = lambda r: tuple(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"] if s["kind"] != "owned")
    assert collections.Counter((r["doc_id"], listed(r)) for r in out) == want


def test_owned_values_are_told_from_copied_ones(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = secret_scan.scan(df, repository="source").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in out}
    owned = {texts[r["doc_id"]][s["start"] : s["end"]] for r in out for s in r["secrets"] if s["kind"] == "owned"}
    # LIVE stands in documents of four owners, its reverse in those of one
    assert owned == {LIVE[::-1]}
    widespread = {(s["kind"], s["owners"]) for r in out for s in r["secrets"] if texts[r["doc_id"]][s["start"] : s["end"]] == "0123456789abcdef"}
    assert widespread == {("hex", 4)}


def test_redaction_leaves_the_rest(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = secret_scan.scan(df, repository="source")
    out = found.withColumn("clean", secret_scan.redacted(found.text, found.secrets)).collect()
    for r in out:
        text, clean = r["text"], []
        if text is None:
            continue
        hidden = [False] * len(text)
        for s in r["secrets"]:
            for k in range(s["start"], s["end"]):
                hidden[k] = True
        starts = {s["start"] for s in r["secrets"] if not s["start"] or not hidden[s["start"] - 1] or s["start"] in {x["end"] for x in r["secrets"]}}
        for k, c in enumerate(text):
            if k in starts:
                clean.append(secret_scan.MARK)
            if not hidden[k]:
                clean.append(c)
        assert r["clean"] == "".join(clean)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert secret_scan.scan(df).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    import time

    rng = random.Random(3)
    run = lambda: "".join(rng.choices("abcdefXYZ0123456789_-", k=24))

    def text(size):
        return " ".join(rng.choice([run(), "é😀", "secret=" + run()]) for _ in range(size // 20))

    def seconds(texts):
        df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id int, source string, text string").coalesce(1)
        begin = time.perf_counter()
        found = secret_scan.scan(df, "source", "source").withColumn("out", secret_scan.redacted(F.col("text"), F.col("secrets"))).collect()
        taken = time.perf_counter() - begin
        for r in found:
            at, out, plain = 0, [], r["text"]
            for s in r["secrets"]:
                if s["start"] >= at:
                    out += [plain[at : s["start"]], secret_scan.MARK]
                at = max(at, s["end"])
            assert r["out"] == "".join(out) + plain[at:]
            assert sum(s["kind"] == "assign" for s in r["secrets"]) == len(re.findall("secret=[A-Za-z0-9_-]{12,}", plain))
        return taken

    texts = [text(1_000_000)]
    seconds(["secret=abcdefghijkl"])  # starts what the first run has to
    # one text of 1 MB against the same in twenty texts
    assert seconds(texts) < 4 * seconds([texts[0][k : k + 50_000] for k in range(0, len(texts[0]), 50_000)]) + 2


def test_redaction_at_every_border(spark):
    block = secret_scan._TEXT_BLOCK
    text = "".join(chr(97 + k % 26) if k % 5 else "😀" for k in range(3 * block))
    places = [(0, 3), (2, 9), (9, 12), (block - 1, block + 1), (2 * block, 2 * block + 5), (3 * block - 4, 3 * block)]
    for spans in ([], places[:1], places[3:4], places[5:], places, [(0, 3 * block)], [(0, 100), (5, 10), (50, 120)]):
        rows = [(text, [("hex", a, b) for a, b in spans])]
        df = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:bigint,end:bigint>>")
        at, out = 0, []
        for a, b in spans:
            if a >= at:
                out += [text[at:a], secret_scan.MARK]
            at = max(at, b)
        assert df.select(secret_scan.redacted(F.col("text"), F.col("spans")).alias("o")).first()["o"] == "".join(out) + text[at:]
