"""Log-probabilities of whole texts under an n-gram model of the corpus, by a weighted backoff automaton.

The model is a hierarchy of Dirichlet priors (MacKay and Peto 1995): with c the
counts of the training texts and k the strength of the prior,
p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k), h' being h without its first word,
down to single words with half a count added. As an automaton: a state per
context h that the training texts hold, an arc per n-gram weighing log p(w | h),
and a failure arc from h to h' weighing log k / (c(h) + k). Reading a word from a
state takes its arc, or fails until there is one; the weights on the way add up
to log p.

The model grows with the corpus, so no machine holds it. Texts are dealt into
chunks of bounded size. A chunk asks for the counts of the n-grams it holds,
sorted by hash and packed by hash range; a task per range adds up what the
chunks sent and answers each; a chunk then builds the part of the automaton that
its texts can reach and traverses them. An n-gram, however frequent, is sent
once by a chunk. Longer n-grams are asked for when the shorter ones are
answered: if no other chunk holds a part of one, its count in the chunk is its
count in the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

ORDER = 3
#: prior strength k: so many words' worth of trust in the shorter context
STRENGTH = 500.0
#: bytes of text in a chunk, and in the share of the corpus whose n-grams one task adds up
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
#: words a lane reads; long texts are read by several lanes
LANE = 512

#: bytes inside a word: all but space and the controls 9 to 13
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False
#: stand for the end of a text, and for the place before its first word
_END, _START = np.uint64(0xE4D0F7E879), np.uint64(0x57A2707E87)
_ROOT, _BEGIN, _FIRST = 0, 1, 2
#: weights are whole numbers of 1 / UNIT, so sums do not depend on order, lanes or batches
UNIT = 1 << 40


def fixed_log10(p: np.ndarray | float) -> np.ndarray:
    # Arrow's logarithm is the C library's, the same on every processor; numpy's is not
    logs = pc.log10(pa.array(np.atleast_1d(p))).to_numpy()
    return np.floor(logs * UNIT + 0.5).astype(np.int64)


def _sums(weights: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sum of weights from each head to the next, as numbers; halves are added apart, so none overflows."""
    high = np.add.reduceat(weights >> 32, heads).tolist()
    low = np.add.reduceat(weights & 0xFFFFFFFF, heads).tolist()
    return np.array([((h << 32) + l) / UNIT for h, l in zip(high, low, strict=True)])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; ascending 64-bit values as differences."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    """What ``packed`` was given."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), dtype=np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=np.uint64) if values.dtype == np.uint64 else values


@dataclass
class Stream:
    """Texts as one run of words, each text closed by an end.

    ``grams[k - 1]`` holds for every place the hash of the k words that end there,
    ``whole[k - 1]`` whether a text's words and its beginning reach so far back.
    """

    starts: np.ndarray
    grams: list[np.ndarray | None]
    whole: list[np.ndarray]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and words per text; worked out for a few texts at once, as bytes take many times their size."""
    found = []
    for batch in tokens.slices(pa.record_batch([texts], names=["text"]), "text"):
        hashes, starts = tokens.words(pc.ascii_lower(batch.column(0)), lower=False, inside=_INSIDE)
        found.append((hashes, np.diff(starts)))
    hashes, counts = zip(*found, strict=True) if found else ([np.empty(0, np.uint64)], [np.empty(0, np.int64)])
    return np.concatenate(hashes), np.concatenate(counts)


def stream(texts: pa.Array, order: int) -> Stream:
    hashes, counts = _words(texts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    closed = starts + np.arange(len(starts))
    words = np.empty(closed[-1], dtype=np.uint64)
    is_end = np.zeros(len(words), dtype=bool)
    is_end[closed[1:] - 1] = True
    words[is_end] = _END
    words[~is_end] = hashes
    place = np.arange(len(words)) - np.repeat(closed[:-1], counts + 1)
    grams, whole = [words], [np.ones(len(words), dtype=bool)]
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[place == 0] = _START
    rolled = before  # the words before this one, from the nearest on
    for k in range(2, order + 1):
        salt = np.uint64(2 * k + 1)
        grams.append(tokens.mix(tokens.mix(rolled * salt) + words))
        whole.append(place >= k - 2)
        further = np.zeros_like(words)
        further[k - 1 :] = before[: len(words) - k + 1]
        rolled = tokens.mix(rolled) + further * salt
    return Stream(closed, grams, whole)


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """First place of every hash range, and the end, in ascending hashes."""
    which = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(which, np.arange(ranges + 1))


@dataclass
class Held:
    """The distinct n-grams of one size that a chunk's texts hold.

    ``ids``: which of them ends at each place (-1: none). ``local``: training
    counts in the chunk. ``asked``: those whose counts other chunks may add to.
    ``totals`` and ``shared`` come with the answers: counts in the corpus, and
    whether another chunk holds the n-gram too.
    """

    grams: np.ndarray
    ids: np.ndarray
    local: np.ndarray
    asked: np.ndarray
    totals: np.ndarray | None = None
    shared: np.ndarray | None = None

    def take(self, values: np.ndarray) -> None:
        self.totals = self.local.copy()
        self.totals[self.asked] = values >> 1
        self.shared = np.zeros(len(self.grams), dtype=bool)
        self.shared[self.asked] = values & 1


def hold(run: Stream, of_train: np.ndarray, size: int, shorter: Held | None) -> Held:
    """The n-grams of one size. One whose first or last size - 1 words no other chunk holds need not be asked for."""
    grams, whole = run.grams[size - 1], run.whole[size - 1]
    distinct, inverse = np.unique(grams[whole], return_inverse=True)
    ids = np.full(len(grams), -1, dtype=np.int32)
    ids[whole] = inverse
    run.grams[size - 1] = None  # no longer needed, and large
    local = np.bincount(inverse, weights=of_train[whole], minlength=len(distinct)).astype(np.int64)
    asked = np.ones(len(distinct), dtype=bool)
    if shorter is not None:
        at = np.empty(len(distinct), dtype=np.int64)
        at[inverse] = np.flatnonzero(whole)
        asked = shorter.shared[shorter.ids[at]] & shorter.shared[shorter.ids[at - 1]]
    return Held(distinct, ids, local, asked)


def resolve(run: Stream, of_train: np.ndarray, answers: list[np.ndarray]) -> list[Held]:
    """The n-grams of the sizes that are answered."""
    held: list[Held] = []
    for size, values in enumerate(answers, 1):
        held.append(hold(run, of_train, size, held[-1] if size > 2 else None))
        held[-1].take(values)
    return held


def requests(held: Held, size: int, chunk: int, ranges: int) -> pa.RecordBatch:
    """What a chunk asks and tells: its n-grams of one size and their training counts, by hash range."""
    grams, counts = held.grams[held.asked], held.local[held.asked].astype(np.uint32)
    cuts = _ranges(grams, ranges)
    rows = []
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[r], cuts[r + 1])
        rows.append((r, chunk, size, int(cuts[r + 1] - cuts[r]), packed(grams[part]), packed(counts[part])))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_REQUEST_NAMES)


_REQUEST_NAMES = ["range", "chunk", "size", "n", "grams", "counts"]
_REQUEST = "range long, chunk long, size int, n long, grams binary, counts binary"


def _added_up(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Entries per row, for each entry the place of its n-gram, and the counts of the distinct n-grams."""
    sizes = table.column("n").to_pylist()
    rows = list(zip(table.column("grams").to_pylist(), table.column("counts").to_pylist(), sizes, strict=True))
    grams = np.concatenate([unpacked(g, n, np.uint64) for g, _, n in rows])
    counts = np.concatenate([unpacked(c, n, np.uint32) for _, c, n in rows])
    _, inverse = np.unique(grams, return_inverse=True)
    return sizes, inverse, np.bincount(inverse, weights=counts).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """For every request of a hash range, in the order asked: twice the counts in the corpus, plus 1 where several chunks asked."""
    sizes, inverse, totals = _added_up(table)
    values = 2 * totals + (np.bincount(inverse) > 1)
    parts = np.split(values[inverse], np.cumsum(sizes)[:-1])
    small = [p.astype(np.uint32) if p.max() < 1 << 32 else p for p in parts]
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "size": table.column("size"),
            "range": table.column("range"),
            "n": table.column("n"),
            "width": pa.array([p.dtype.itemsize for p in small], pa.int32()),
            "counts": pa.array([packed(p) for p in small], pa.binary()),
        }
    )


_ANSWER = "chunk long, size int, range long, n long, width int, counts binary"


def _totals(table: pa.Table) -> pa.Table:
    """Words and distinct words of training texts in a hash range."""
    counts = _added_up(table)[2]
    return pa.table({"words": pa.array([int(counts.sum())], pa.int64()), "types": pa.array([int((counts > 0).sum())], pa.int64())})


@dataclass(frozen=True)
class Corpus:
    """Words (ends counted), distinct words and texts that the model learns from."""

    words: int
    types: int
    texts: int

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their counts alone, half a count added."""
        return (counts + 0.5) / (self.words + 0.5 * (self.types + 1))


class Automaton:
    """The states and arcs that a run of texts can reach.

    States are the root, the beginning of a text, and the contexts of 1 to
    order - 1 words with a count. ``arcs[k, i]`` is the arc that reads the word at
    place i from a context of k - 1 words, or -1 if that state has none.
    """

    def __init__(self, run: Stream, grams: list[Held], corpus: Corpus, strength: float):
        counts, ids = [g.totals for g in grams], [g.ids for g in grams]
        order, places = len(counts), len(ids[0])
        first = run.starts[:-1]
        self.order = order
        self.arcs = np.full((order + 1, places), -1, dtype=np.int32)
        self.bases = [_FIRST]
        now, probability = None, None  # count and probability of the n-gram that ends at each place
        self.unseen = int(fixed_log10(corpus.single(np.zeros(1)))[0])
        weights, orders, fails, fail_weights = ([np.zeros(_FIRST, np.int64)] for _ in range(4))
        orders[0][_BEGIN] = 1
        fail_weights[0][_BEGIN] = fixed_log10(strength / (corpus.texts + strength))[0]
        for k in range(1, order + 1):
            n = len(counts[k - 1])
            at = np.zeros(n, dtype=np.int64)  # a place of every distinct n-gram
            there = np.flatnonzero(ids[k - 1] >= 0)
            at[ids[k - 1][there]] = there
            before, now = now, np.where(ids[k - 1] >= 0, counts[k - 1][ids[k - 1]], 0) if n else np.zeros(places, np.int64)
            if k > 1:
                context = np.empty(places, dtype=np.int64)
                context[1:] = before[:-1]
                context[first] = corpus.texts if k == 2 else 0
                probability = (now + strength * probability) / (context + strength)
            else:
                probability = corpus.single(now)
            # the arcs of this order and the states that they spell share their numbers
            self.arcs[k] = np.where(now > 0, self.bases[k - 1] + ids[k - 1], -1)
            weights.append(fixed_log10(probability[at]))
            orders.append(np.full(n, k))
            fails.append(self.bases[k - 2] + ids[k - 2][at] if k > 1 else np.full(n, _ROOT))
            fail_weights.append(fixed_log10(strength / (counts[k - 1] + strength)))
            self.bases.append(self.bases[-1] + n)
        self.weight, self.orders = np.concatenate(weights), np.concatenate(orders)
        self.fail, self.fail_weight = np.concatenate(fails), np.concatenate(fail_weights)

    def read(self, states: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading the words at ``places`` from ``states``, and the weights of the way."""
        gained, after = np.zeros(len(states), np.int64), np.zeros(len(states), np.int64)
        open_ = np.arange(len(states))
        while len(open_):
            now, at = states[open_], places[open_]
            level = self.orders[now] + 1
            arc = self.arcs[level, at]
            taken, root = arc >= 0, now == _ROOT
            done = taken | root
            lane = open_[taken]
            gained[lane] += self.weight[arc[taken]]
            # an arc of the longest order leads to the state of its last order - 1 words
            after[lane] = np.where(level[taken] < self.order, arc[taken], self.fail[arc[taken]])
            lost = open_[root & ~taken]
            gained[lost] += self.unseen
            after[lost] = _ROOT
            stay = ~done
            open_ = open_[stay]
            gained[open_] += self.fail_weight[now[stay]]
            states = states.copy()
            states[open_] = self.fail[now[stay]]
        return after, gained

    def scores(self, starts: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The sum of weights of every text, read from left to right.

        Texts are read side by side, long ones by several lanes. A lane within a
        text starts order - 1 words early at the root: the state is fixed by that
        many words, and their weights are left out.
        """
        lengths = np.diff(starts)
        lanes = (lengths + lane - 1) // lane
        text = np.repeat(np.arange(len(lengths)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        early = np.where(nth > 0, self.order - 1, 0)
        begin = starts[:-1][text] + nth * lane - early
        length = np.minimum(lengths[text] - nth * lane, lane) + early
        by_length = np.argsort(-length, kind="stable")
        begin, length, early_s = begin[by_length], length[by_length], early[by_length]
        states = np.where(nth[by_length] > 0, _ROOT, _BEGIN)
        total = np.zeros(len(text), np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step, side="left"))  # lanes longer than this step
            states[:n], gained = self.read(states[:n], begin[:n] + step)
            total[:n] += np.where(step >= early_s[:n], gained, 0)
        back = np.empty_like(total)
        back[by_length] = total
        return _sums(back, np.cumsum(lanes) - lanes) if len(text) else np.empty(0)


def traverse(run: Stream, grams: list[Held], corpus: Corpus, strength: float) -> dict[str, np.ndarray]:
    """Per text: n_tokens, n_known, base_score, score."""
    single = grams[0].totals[grams[0].ids]
    heads = run.starts[:-1]
    return {
        "n_tokens": np.diff(run.starts),
        "n_known": np.add.reduceat((single > 0).astype(np.int64), heads),
        "base_score": _sums(fixed_log10(corpus.single(single)), heads),
        "score": Automaton(run, grams, corpus, strength).scores(run.starts),
    }


def _open(texts: pa.Table, order: int) -> tuple[Stream, np.ndarray]:
    """A chunk's words, and which of them training counts."""
    run = stream(texts.column("_text").combine_chunks(), order)
    return run, np.repeat(texts.column("_train").to_numpy(), np.diff(run.starts))


def _values(answers: pa.Table, order: int) -> list[np.ndarray]:
    """The answers per size, in the order asked."""
    out = []
    for k in range(1, order + 1):
        rows = answers.filter(pc.equal(answers.column("size"), k)).sort_by("range")
        rows = zip(*(rows.column(c).to_pylist() for c in ("counts", "n", "width")), strict=True)
        parts = [unpacked(data, n, np.uint32 if width == 4 else np.int64).astype(np.int64) for data, n, width in rows]
        out.append(np.concatenate([np.empty(0, np.int64), *parts]))
    return out


def _ask_short(ranges: int):
    """Words and pairs of words: all are asked for."""

    def run(texts: pa.Table) -> pa.Table:
        words, of_train = _open(texts, 2)
        chunk = texts.column("_chunk")[0].as_py()
        return pa.Table.from_batches([requests(hold(words, of_train, k, None), k, chunk, ranges) for k in (1, 2)])

    return run


def _ask(size: int, ranges: int):
    """N-grams of one size, the shorter ones being answered."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, of_train = _open(texts, size)
        held = resolve(words, of_train, _values(answers, size - 1))
        return pa.Table.from_batches([requests(hold(words, of_train, size, held[-1]), size, texts.column("_chunk")[0].as_py(), ranges)])

    return run


def _count(ranges: int, chunk_bytes: int):
    """Single words only; texts are gathered up to a chunk's size so that a frequent word is sent once."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk_bytes:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held):
        return requests(hold(*_open(pa.Table.from_batches(held), 1), 1, None), 1, 0, ranges)

    return run


def _read(order: int, corpus: Corpus, strength: float):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, of_train = _open(texts, order)
        found = traverse(words, resolve(words, of_train, _values(answers, order)), corpus, strength)
        keep = texts.drop_columns(["_text", "_chunk"])
        for name, values in found.items():
            keep = keep.append_column(name, pa.array(values))
        return keep

    return run


def _dealt(df: DataFrame, doc: str, text: str, train: Column, chunks: int | None) -> DataFrame:
    narrow = df.select(
        F.col(f"`{doc}`").alias("_doc"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
        F.coalesce(train, F.lit(False)).alias("_train"),
    )
    if chunks is None:
        return narrow
    chunk = F.pmod(F.xxhash64("_doc", "_text"), F.lit(chunks))
    return narrow.withColumn("_chunk", chunk).repartition(chunks, "_chunk")


def corpus_of(df: DataFrame, train: Column, doc: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Corpus:
    """Exact totals of the training texts."""
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`"))), F.count_if(F.coalesce(train, F.lit(False)))).first()
    ranges = 1 + (size[0] or 0) // (4 * RANGE_BYTES)
    told = _dealt(df, doc, text, train, None).select("_text", "_train").mapInArrow(_count(ranges, chunk_bytes), _REQUEST)
    found = told.groupBy("range").applyInArrow(_totals, "words long, types long").agg(F.sum("words"), F.sum("types")).first()
    return Corpus(found[0] or 0, found[1] or 0, size[1])


def score(
    df: DataFrame,
    train: Column,
    doc: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    strength: float = STRENGTH,
    chunk_bytes: int = CHUNK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Score every whole text: doc, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``train`` holds. Words are runs without
    white space, in ASCII lower case; the end of a text is a token too, so an empty
    or null text has one. ``n_known`` counts tokens that training texts hold.
    ``base_score`` is the log10 probability by single words with half a count
    added, ``score`` that of the model. Without training texts every token is
    unseen. Repeated rows are texts each, null ids included; an empty table gives
    none; other columns are ignored.
    """
    if order < 2:
        raise ValueError("a model of single words needs no automaton; the order must be 2 or more")
    corpus = corpus_of(df, train, doc, text, chunk_bytes)
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    chunks, ranges = 1 + size // chunk_bytes, 1 + size // range_bytes
    dealt = _dealt(df, doc, text, train, chunks)
    # the texts are dealt out once; what follows reads that exchange again
    by_chunk = dealt.groupBy("_chunk")
    asked = by_chunk.applyInArrow(_ask_short(ranges), _REQUEST)
    answers = asked.groupBy("range").applyInArrow(_answer, _ANSWER).repartition(chunks, "chunk")
    for size in range(3, order + 1):
        asked = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_ask(size, ranges), _REQUEST)
        longer = asked.groupBy("range").applyInArrow(_answer, _ANSWER).repartition(chunks, "chunk")
        answers = answers.unionByName(longer)
    kind = df.schema[doc].dataType.simpleString()
    found = "n_tokens long, n_known long, base_score double, score double"
    read = _read(order, corpus, strength)
    scored = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(read, f"_doc {kind}, _train boolean, {found}")
    return scored.select(
        F.col("_doc").alias(doc),
        (~F.col("_train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(corpus.words).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
