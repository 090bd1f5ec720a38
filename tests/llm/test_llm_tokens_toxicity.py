"""Token counts, packing, toxicity, archives and the pipeline: exact round trips, brute force, held-out accuracy."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyfold.llm import bpe, decontaminate, jaccard, packing, queries, secret_scan, token_counts, toxicity, warc

TEXTS = [None, "", "a", "Hello, wörld!\nnew line\n\nend", "日本語 text\nß" * 5, "\n", "x" * 5000, " \n" * 40, "<|endoftext|> it's", "emoji 👩‍👩‍👧 ok\nüñî"]


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizer_file(spark, tables):
    t, path = reference(), bpe.default_path()
    texts = [x or "" for x in TEXTS] + [r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").collect()]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(text, path).tolist() == want.ids


def with_special_tokens():
    rng = random.Random(4)
    parts = ["<|endoftext|>", " ", "  ", "\n", "a", "it's", "é", "<|", "|>", "12", "<|endoftext", "end", "日本", "word " * 700]
    return [*TEXTS, "a <|endoftext|> b", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300))]


def test_special_tokens_are_those_of_the_tokenizer_file():
    t, path = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.default_path()
    texts = [x or "" for x in with_special_tokens()]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(text, path, special=True).tolist() == want.ids


def test_registered_queries_and_the_pipeline_encode_special_tokens(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(enumerate(with_special_tokens()))
    docs = spark.createDataFrame([(i, "s<|endoftext|>", x) for i, x in texts.items()], "doc_id long, source string, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, x in texts.items()}
    for rows in (queries.op8_packed_sequences(spark, str(tmp_path)).collect(), corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()):
        assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
        for r in rows:
            assert r["doc_tokens"] == len(ids[r["doc_id"]])
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    got, want = collections.Counter(), collections.Counter()
    for r in queries.op5_section_tokens(spark, str(tmp_path)).collect():
        got[r["doc_id"], r["start"], r["end"]] += r["tokens"]
    for i, x in texts.items():
        whole = f"s<|endoftext|>\n{x or ''}"
        cuts = [0, 15, *(k + 1 for k in range(15, len(whole) - 1) if whole[k] == "\n"), len(whole)]
        spans = list(zip(cuts[:-1], cuts[1:]))
        want.update({(i, *s): 0 for s in spans})
        for a, b in t.encode(whole, add_special_tokens=False).offsets:
            want[(i, *max(spans, key=lambda s: min(b, s[1]) - max(a, s[0])))] += 1
    assert got == want


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_equal_brute_force(spark, rule):
    t = reference()
    rows = [(i, f"s{i}" if i % 3 else None, text, 1) for i, text in enumerate(TEXTS)] + [(None, "ab\ncd", "ef\n\ngh", 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    out = token_counts.section_tokens(df, rule=rule, section_end="\n").collect()
    got = collections.Counter(tuple(r) for r in out)
    want = collections.Counter()
    for doc, source, text, _ in rows:
        whole = f"{source or ''}\n{text or ''}"
        cut = len(source or "") + 1
        spans = [["source", 0, 0, cut]]
        for k, line in enumerate((text or "").splitlines(keepends=True) if "\r" not in (text or "") else []):
            spans.append(["text", k, spans[-1][3], spans[-1][3] + len(line)])
        if not text:
            spans.append(["text", 0, cut, cut])
        count = collections.Counter()
        for a, b in t.encode(whole, add_special_tokens=False).offsets:
            held = [max(0, min(b, s[3]) - max(a, s[2])) for s in spans]
            into = [k for k, n in enumerate(held) if n]
            k = {"first": into[0], "last": into[-1], "most": held.index(max(held))}[rule]
            count[k, "tokens"] += 1
            count[k, "crossing"] += len(into) > 1
        for k, s in enumerate(spans):
            want[doc, *s, count[k, "tokens"], count[k, "crossing"]] += 1
    assert got == want


def test_crossing_tokens_follow_the_rule():
    begin, end, starts = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 4, 6])
    assert token_counts.allot(begin, end, starts, "first")[0].tolist() == [0, 0, 2]
    assert token_counts.allot(begin, end, starts, "last")[0].tolist() == [0, 2, 2]
    owner, crosses = token_counts.allot(begin, end, starts, "most")
    assert owner.tolist() == [0, 0, 2] and crosses.tolist() == [False, True, False]


def test_pieces_hold_every_id_once(spark):
    path = bpe.default_path()
    rng = random.Random(0)
    rows = [(i, text, 1) for i, text in enumerate(TEXTS)] + [(50 + i, "word " * rng.randint(0, 3000), 1) for i in range(40)] + [(None, "z", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    out = packing.pack(packing.pieces(df), loss="loss").collect()
    texts = {r[0]: r[1] or "" for r in rows}
    per = collections.defaultdict(list)
    for r in out:
        per[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids = np.append(bpe.encode(text, path), 0).astype("<u4")
        copies = sum(r[0] == doc for r in rows)
        pieces = sorted(per[doc], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    check_sequences(out, 1024, 64)


def check_sequences(rows, tokens, segments):
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens and len(parts) <= segments
    return held


def test_every_limit_holds_and_little_is_padded(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 1000), rng.randint(1, 5), None) for i in range(3000)]
    rows = [(i, n, s, rng.randint(0, min(n, 600))) for i, n, s, _ in rows]
    df = spark.createDataFrame(rows, "id long, length long, segs int, learn int").repartition(2)
    out = packing.pack(df, segments="segs", loss="learn", max_segments=8, max_loss=600).collect()
    assert sorted(r["id"] for r in out) == [r[0] for r in rows]
    by = {r[0]: r for r in rows}
    totals = collections.defaultdict(lambda: [0, 0, 0])
    for r in out:
        for k in range(3):
            totals[r["sequence_id"]][k] += by[r["id"]][k + 1]
    assert all(a <= 1024 and b <= 8 and c <= 600 for a, b, c in totals.values())
    need = max(sum(r[1] for r in rows) / 1024, sum(r[2] for r in rows) / 8, sum(r[3] for r in rows) / 600)
    assert len(totals) <= 1.12 * need


def test_packing_nothing_and_too_much(spark):
    df = spark.createDataFrame([(1, 5000), (2, None), (3, 0)], "id long, length long")
    out = {r["id"]: r for r in packing.pack(df).collect()}
    assert len(out) == 3 and out[1]["sequence_id"] not in (out[2]["sequence_id"], out[3]["sequence_id"])
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def toxic_corpus(n=1500):
    rng = random.Random(9)
    voc, bad = [f"w{i}" for i in range(3000)], ["vile", "scum", "trash"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [rng.choice(voc) for _ in range(rng.randint(5, 150))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = toxic_corpus()
    truth = dict(labels)
    extra = [(9000, None), (9001, ""), (None, "vile scum trash"), (9002, "vile " * 40000)] + docs[:3]
    df = spark.createDataFrame([(*r, 7) for r in docs + extra], "doc_id long, text string, score int").repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1), (9000, None), labels[0]], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.train(df, marks)).collect()
    assert len(out) == len(docs) + len(extra)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    hits = sum(r["predicted"] and truth[r["doc_id"]] for r in held)
    assert hits >= 0.9 * sum(truth[r["doc_id"]] for r in held) and hits >= 0.95 * sum(r["predicted"] for r in held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = toxic_corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scores = []
    for flip in (False, True):
        marks = [(i, 1 - t if flip and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
        model = toxicity.train(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
        scores.append([r["score"] for r in toxicity.score(df, model).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]


def test_no_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(df, toxicity.train(df, none)).collect()] == [0, 0]
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score(df.limit(0), toxicity.train(df, one)).count() == 0


def test_the_risk_is_never_driven_below_zero():
    """A flexible fit on few texts would make the clean part of the risk negative; the estimator steps back."""
    positive = [np.array([k], dtype=np.int32) for k in range(20)]
    unlabelled = [np.array([k % 40], dtype=np.int32) for k in range(200)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    assert np.isfinite(model.weights).all() and abs(model.bias) < 50


def pages():
    rng = random.Random(3)
    big = ["<p>" + "é" * 600 + "</p>", "x" * 1000, "y" * 999]
    rows = [(i, f"http://h{i % 7}/é {i}?q=%20\r\nX: y", rng.choice([*big, f"<html>{i}</html>", "", "z" * rng.randint(0, 3000)])) for i in range(300)]
    rows += [(None, None, big[0]), (None, "u", None), (400, "a", None), (5, "again", big[1]), (401, "last", big[1]), (401, "last", big[1])]
    return rows + [(500 + i, f"c{i}", big[0]) for i in range(300)]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 3000)
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)
    folder = warc.archive_folder(spark)
    index = warc.write_archives(df, folder, file_bytes=20_000)
    out = warc.read_archives(index, folder).collect()
    best = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, i), i)
    want = collections.Counter()
    for i, url, html in rows:
        data = (html or "").encode()
        first = best.get(html)
        revisit = first is not None and first != i and [r[2] for r in rows].count(html) > 1
        want[i, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None,
             None if revisit else html or ""] += 1
    assert collections.Counter(tuple(r) for r in out) == want
    # a selection reads its records alone
    some = index.filter("page_id % 7 = 3")
    assert {r["page_id"] for r in warc.read_archives(some, folder).collect()} == {r[0] for r in rows if r[0] is not None and r[0] % 7 == 3}
    assert index.select("file").distinct().count() > 4


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    assert warc.read_archives(warc.write_archives(df, folder), folder).count() == 0


def test_stages_work_on_what_their_predecessor_kept(spark, tables):
    """Every stage against brute force on its own input."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    some = docs.orderBy("doc_id").limit(2)
    extra = some.unionByName(some.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(extra)  # repeated rows, null ids and texts
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in kept.collect()]
        frame = spark.createDataFrame(before, docs.schema)
        out = stage(spark, frame, tables)
        rows = [r.asDict() for r in out.collect()]
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(frame, labels)
            bad = {r["doc_id"] for r in toxicity.score(frame, model).collect() if r["predicted"]}
            assert sorted(str(r) for r in rows) == sorted(str(r) for r in before if r["doc_id"] not in bad)
        elif name == "n-gram Jaccard join":
            classes = {(r["doc_id"], r["text_md5"]): r["class_md5"] for r in jaccard.jaccard_links(frame).collect()}
            count = collections.Counter(classes[r["doc_id"], md5(r["text"])] for r in rows if r["text"] is not None)
            assert set(count.values()) == {1} and set(count) == {c for c in classes.values() if c}
            assert sum(r["text"] is None for r in rows) == sum(r["text"] is None for r in before)
        elif name == "benchmark decontamination":
            bench = spark.read.parquet(f"{tables}/benchmark.parquet").collect()
            words = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()]
            dirty = {r["doc_id"] for r in before if any(found(words(b["text"]), words(r["text"])) for b in bench)}
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows} == dirty - {None}
        elif name == "secret scans":
            assert len(rows) == len(before)
            left = secret_scan.scan(out, repository="source").select(F.explode("secrets")).count()
            assert left == 0
            changed = sum(a["text"] != b["text"] for a, b in zip(sorted(before, key=order), sorted(rows, key=order)))
            assert 0 < changed < len(rows) / 2
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        else:
            ids = collections.Counter()
            for r in rows:
                ids[r["doc_id"]] += r["length"]
            want = collections.Counter()
            for r in before:
                want[r["doc_id"]] += len(bpe.encode(r["text"] or "", bpe.default_path())) + 1
            assert ids == want
            check_sequences(rows, 1024, 64)
        kept = spark.createDataFrame(rows, docs.schema) if name != "packing" else kept


def order(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def found(item, words):
    """Exact copies; edited ones are tested apart."""
    n = len(item)
    return n > 0 and any(words[k : k + n] == item for k in range(len(words) - n + 1))


def test_run_is_the_stages_in_turn(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert [s[0] for s in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"
    ]
    check_sequences(rows, 1024, 64)
    assert rows


def long_runs(n):
    rng = random.Random(6)
    yield from (" " * n, "\n" * n, "\t" * n, " \n" * (n // 2), "!" * n, "a" * n, "漢" * n, " " * n + "word", "x" + "\n" * n + "é" + " " * n)
    yield " " * n + "<|endoftext|>" + "\u3000" * n + "a<|endoftext|>"
    yield "\x1c" * n + " " * n + "\x1cx"
    yield "".join(rng.choice("漢字a b\n!") for _ in range(n))
    yield "".join(rng.choice([" ", "\n"]) * rng.choice([1, 3, bpe.LONG_RUN, bpe.LONG_RUN + 1]) + rng.choice(["a", "'s", "<|endoftext|>", ""]) for _ in range(20))


def test_long_runs_have_the_ids_of_the_tokenizer_file():
    special, plain, path = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), reference(), bpe.default_path()
    for text in [*long_runs(60_000), " " * 1_000_000, "\n" * 1_000_000 + "a"]:
        assert bpe.encode(text, path, special=True).tolist() == special.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text, path).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_million_spaces_are_packed_and_counted(spark):
    df = spark.createDataFrame([(1, "s", " " * 1_000_000), (2, "s", "\n " * 500_000)], "doc_id long, source string, text string")
    rows = packing.pack(packing.pieces(df, special=True), loss="loss").collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1_000_001
    counts = token_counts.section_tokens(df, special=True).groupBy("doc_id").agg(F.sum("tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in counts}[1] == len(bpe.encode("s\n" + " " * 1_000_000, bpe.default_path()))


def test_archives_are_read_by_several_tasks(spark):
    rng = random.Random(1)
    pages = [(i, "u", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60_000))) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    folder = warc.archive_folder(spark)
    read = warc.read_archives(warc.write_archives(df, folder), folder)
    assert read.rdd.getNumPartitions() > 1
    assert {r["page_id"]: r["payload_bytes"] for r in read.select("page_id", "payload_bytes").collect()} == {i: 60_000 for i in range(400)}


def test_near_copies_keep_one_row_of_a_repeated_document(spark, tables):
    rows = [(1, "same text of a document here", "en", "b", 28), (1, "same text of a document here", "de", "z", 28),
            (1, "same text of a document here", None, "y", 28), (2, "another", "en", "a", 7), (3, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(tuple(r) for r in corpus_pipeline.near_copies(spark, docs, tables).collect())
    assert got == [rows[2], rows[3], rows[4]]


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, n)) for n in (0, 1, 7, 400, 20_000, 3, 0, 900)]
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.3, 0.1)
    together = model.scores(*toxicity.features(pa.array(texts)))
    for text, score in zip(texts, together):
        assert model.scores(*toxicity.features(pa.array([text]))).tolist() == [score]
        words, _ = toxicity.features(pa.array([text]))
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(sum(float(model.weights[w]) for w in words) - 0.3, -60, 60))), rel=1e-9)


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_the_fit_descends_the_stated_risk(monkeypatch, prior):
    """Against central differences of the risk, also where the estimate turns negative and is stepped back from."""
    monkeypatch.setattr(toxicity, "ROUNDS", 40)
    rng = np.random.default_rng(8)
    rows = lambda n, words: [np.unique(rng.choice(words, 6)).astype(np.int32) for _ in range(n)]
    positive = rows(40, np.arange(0, 12))
    unlabelled = [*rows(10, np.arange(0, 12)), *rows(90, np.arange(8, 40))]
    share = lambda k, texts: sum(k in t for t in texts)
    expected = {k: share(k, unlabelled) * len(positive) / len(unlabelled) for k in range(40)}
    used = [k for k in range(40) if share(k, positive) - expected[k] >= 2 * np.sqrt(expected[k] + 1)]
    p, u = (np.array([[k in t for k in used] for t in texts], dtype=float) for texts in (positive, unlabelled))
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    below = 0

    def objective(x, rest_only):
        zp, zu = p @ x[:-1] + x[-1], u @ x[:-1] + x[-1]
        rest = loss(-zu) - prior * loss(-zp)
        return (-rest if rest_only else prior * loss(zp) + rest) + toxicity.DECAY / 2 * (x[:-1] ** 2).sum()

    x = np.append(np.zeros(len(used)), np.log(prior / (1 - prior)))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, 41):
        negative = loss(-(u @ x[:-1] + x[-1])) < prior * loss(-(p @ x[:-1] + x[-1]))
        below += negative
        g = np.array([(objective(x + d, negative) - objective(x - d, negative)) / 2e-5 for d in np.eye(len(x)) * 1e-5])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    model = toxicity.fit(positive, unlabelled, prior)
    assert used and np.flatnonzero(model.weights).tolist() == used
    assert np.allclose(model.weights[used], x[:-1], atol=2e-3)
    assert model.bias == pytest.approx(x[-1], abs=2e-3)
    assert 0 < below < 40  # both branches took part
