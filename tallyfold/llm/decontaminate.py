"""Benchmark passages inside documents, within an edit distance.

Words are the symbols. Windows are embedded by the CGK random walk (Chakraborty,
Goldenberg, Koucky 2016): a walk writes the word it stands on and goes on or stays by
a random bit of that word, as many steps as an item of the window's class has
words. Two windows a few edits apart soon walk in step again, so their edit
distance becomes a small Hamming distance, and a few sampled steps are a key that
both share with a fair chance. Walks and samples are drawn anew for every
repeat, and repeated until the wanted recall is reached. An item is embedded
from several anchors of its first half, so a cut or replaced head spoils only
some; a text from every word. Every place met is verified by its exact edit distance.

Windows are embedded, and places verified, only if they hold enough word pairs of
the benchmark: an edit spoils at most two of them, so this count filter loses
nothing.

``search="pieces"`` is a second, exhaustive search: of k + 1 pieces of an item one
survives k edits, and is looked up at every word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .shared import map_batches

#: an item is found where at most this share of its words is edited
MAX_EDITS = 0.2
#: the share of such places to be met by a key, whatever the kind of edit
RECALL = 0.99
#: steps of a walk that make up a key
SAMPLED = 3
#: ratio of the longest to the shortest item that share a window length
CLASS_RATIO = 1.25
#: anchors of an item lie so many to its length, in its first half
ANCHORS = 24
#: windows embedded at once
WINDOWS = 1 << 13
#: words of a piece that are hashed, at most: a piece left as it was begins as it did
PIECE_WORDS = 8
#: candidates worked on at once
CANDIDATES = 1 << 18
#: bytes of benchmark text whose index is sent to the tasks at once; more text means more passes
BLOCK_BYTES = 4 << 20
#: slots of the table of known word pairs for each pair in it
_SLOTS = 16


def repeats(width: int, recall: float) -> int:
    """Walks for windows of ``width`` words, so that an item at the largest distance is met with probability ``recall``.

    One walk meets it, by any of its anchors, with the probability measured for
    the worst of nine kinds of edit: at least 1/2 up to 50 words, 0.33 at 97, 0.11 at 293.
    """
    hit = min(0.5, 32 / width)
    return max(1, math.ceil(math.log(max(1 - recall, 1e-9)) / math.log(1 - hit)))


def window_length(n: int) -> int:
    """The window length for items of ``n`` words: the largest step of a geometric scale up to n."""
    w = 1
    while (up := max(w + 1, int(w * CLASS_RATIO))) <= n:
        w = up
    return w


def anchors(n: int) -> range:
    """The words of an item of ``n`` words from which it is embedded."""
    return range(0, n // 2 + 1, max(1, n // ANCHORS))


class Walks:
    """Seeded walks of one window length, each with steps of its own to sample, and the items' keys."""

    def __init__(self, width: int, recall: float, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, width])
        self.width, self.count = width, repeats(width, recall)
        draw = lambda shape: rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bits = draw((self.count, width))
        sampled = rng.integers(0, width, (self.count, SAMPLED))
        self.weights = draw((self.count, SAMPLED))
        self.salts = draw((self.count, 1))
        self.at_step = [np.nonzero(sampled == step) for step in range(width)]

    def keys(self, flat: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Keys of the windows that begin at ``at`` and see words before ``stop``: one row per walk."""
        place = np.repeat(at[None, :], self.count, axis=0)
        out = np.repeat(self.salts, len(at), axis=1)
        for step, (walk, which) in enumerate(self.at_step):
            symbol = np.where(place < stop, flat[np.minimum(place, len(flat) - 1)], np.uint64(0))
            for r, j in zip(walk, which):
                out[r] += tokens.mix(symbol[r] + np.uint64(j + 1)) * self.weights[r, j]
            place += ((symbol * self.bits[:, step, None]) >> np.uint64(63)).astype(np.int64)
        return tokens.mix(out)

    def learn(self, flat: np.ndarray, items: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> None:
        """Index ``items`` of this length by the keys of all their anchors; ``limits`` are their edits."""
        sizes = starts[items + 1] - starts[items]
        which = np.repeat(np.arange(len(items)), [len(anchors(n)) for n in sizes.tolist()])
        offsets = np.concatenate([np.array(anchors(n), dtype=np.int64) for n in sizes.tolist()])
        keys = self.keys(flat, starts[items[which]] + offsets, starts[items[which] + 1]).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.table = keys[order]
        self.items, self.offsets = items[np.tile(which, self.count)[order]], np.tile(offsets, self.count)[order]
        self.longest, self.edits = int(sizes.max()), int(limits[items].max())
        self.need = int((sizes - 1 - 2 * limits[items]).min())


def cuts(n: int, edits: int) -> list[tuple[int, int]]:
    """First word and hashed words of each piece of an item of ``n`` words, more than ``edits``."""
    keys = edits + 1
    bounds = [n * k // keys for k in range(keys + 1)]
    return [(a, min(b - a, PIECE_WORDS)) for a, b in zip(bounds[:-1], bounds[1:])]


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on; none where fewer are left."""
    out = tokens.mix(words[: max(0, len(words) - length + 1)] + np.uint64(length))
    for k in range(1, length):
        out = tokens.mix(out * np.uint64(3) + words[k : k + len(out)])
    return out


def _bits(n: int) -> int:
    return min(26, max(12, math.ceil(math.log2(_SLOTS * max(1, n)))))


class Pieces:
    """The pieces of one length: sorted keys with item and first word of each, and a table of the keys there are."""

    def __init__(self, length: int, keys: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.length, self.keys, self.items, self.offsets = length, keys[order], items[order], offsets[order]
        self.bits = _bits(len(keys))
        self.known = np.zeros(1 << self.bits, dtype=bool)
        self.known[self.slot(keys)] = True

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)


class Index:
    """The items of one block: words, known words and word pairs, and what the search looks up. ``max_edits`` is below 1."""

    def __init__(self, ids: list, texts: list[str | None], max_edits: float, recall: float, search: str = "walks") -> None:
        if not 0 <= max_edits < 1:
            raise ValueError("max_edits must be at least 0 and below 1")
        if search not in ("walks", "pieces"):
            raise ValueError(f"search must be 'walks' or 'pieces', not {search!r}")
        hashes, starts = tokens.words(pa.array(texts, pa.string()))
        self.ids = ids
        self.items = [hashes[a:b] for a, b in zip(starts[:-1], starts[1:])]
        self.sizes = np.diff(starts)
        self.limits = np.array([int(max_edits * n) for n in self.sizes.tolist()], dtype=np.int64)
        self.bits = _bits(len(hashes))
        self.known = np.zeros(1 << self.bits, dtype=bool)
        self.single = np.zeros(1 << self.bits, dtype=bool)
        self.single[self.slot(hashes)] = True
        by_length: dict[int, list[tuple[int, int]]] = {}
        by_width: dict[int, list[int]] = {}
        for i, words in enumerate(self.items):
            if len(words):
                self.known[self.slot(_pairs(words))] = True
                by_width.setdefault(window_length(len(words)), []).append(i)
                for offset, length in cuts(len(words), self.edits(i)) if search == "pieces" else ():
                    by_length.setdefault(length, []).append((i, offset))
        self.pieces, self.walks = [], []
        for length, found in sorted(by_length.items()):
            items, offsets = np.array(found, dtype=np.int64).T
            self.pieces.append(Pieces(length, _runs(hashes, length)[starts[items] + offsets], items, offsets))
        for width, members in sorted(by_width.items()) if search == "walks" else ():
            self.walks.append(Walks(width, recall))
            self.walks[-1].learn(hashes, np.array(members), starts, self.limits)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def edits(self, item: int) -> int:
        return int(self.limits[item])


def _pairs(words: np.ndarray) -> np.ndarray:
    return tokens.mix(words[:-1] * np.uint64(3) + words[1:])


def matches(item: np.ndarray, region: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """(distance, end) of separate runs of ``region`` within ``edits`` of ``item``, the best of each place.

    Bit-parallel (Myers 1999), one bit per word of the item, of any length.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    out: list[tuple[int, int]] = []
    for j, word in enumerate(region.tolist(), 1):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # a run may begin anywhere: nothing is carried in
        mh = (mh << 1) & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score <= edits:
            if not out or j - out[-1][1] > n // 2:
                out.append((score, j))
            elif score < out[-1][0]:
                out[-1] = (score, j)
    return out


def find(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, least distance, places, end of the first place in words) of every item found in a text."""
    flat, starts = tokens.words(texts)
    if len(flat) == 0 or not (index.pieces or index.walks):
        return []
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = np.zeros(len(flat) + 1, dtype=np.int32)
    known = index.known[index.slot(_pairs(flat))] & (owner[:-1] == owner[1:])
    np.cumsum(known, out=pairs[1:-1])
    pairs[-1] = pairs[-2]
    hits = [np.empty((3, 0), dtype=np.int64)]
    for place, item, offset in _met_walks(index, flat, starts, owner, pairs) if index.walks else _met_pieces(index, flat, starts, owner):
        row, at = owner[place], place - offset
        low, high = _around(index, starts, item, row, at)
        need = index.sizes[item] - 1 - 2 * index.limits[item]
        enough = (high > low) & (pairs[high - 1] - pairs[low] >= need)
        hits.append(np.unique(np.stack([item, row, at])[:, enough], axis=1))
    return _verify(index, flat, starts, np.unique(np.concatenate(hits, axis=1), axis=1))


def _met_walks(index: Index, flat, starts, owner, pairs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, item, offset of its anchor) wherever a window shares a key with an item."""
    begin = np.flatnonzero(index.single[index.slot(flat)])
    first, stop = starts[:-1][owner[begin]], starts[1:][owner[begin]]
    for walks in index.walks:
        reach = walks.longest + walks.edits
        # what an item can cover that is anchored here
        low, high = np.maximum(first, begin - walks.longest // 2 - walks.edits), np.minimum(stop, begin + reach)
        some = np.flatnonzero(pairs[high - 1] - pairs[low] >= walks.need)
        for at in range(0, len(some), WINDOWS):
            now = some[at : at + WINDOWS]
            keys = walks.keys(flat, begin[now], stop[now])
            yield from _looked_up(walks.table, keys.reshape(-1), np.tile(begin[now], walks.count), walks.items, walks.offsets)


def _met_pieces(index: Index, flat, starts, owner) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, item, offset of the piece) wherever a text holds a piece."""
    stop = starts[1:][owner]
    for pieces in index.pieces:
        keys = _runs(flat, pieces.length)
        places = np.arange(len(keys))
        places = places[pieces.known[pieces.slot(keys)] & (places + pieces.length <= stop[: len(keys)])]
        yield from _looked_up(pieces.keys, keys[places], places, pieces.items, pieces.offsets)


def _looked_up(table, keys, places, items, offsets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries of each key, some candidates at a time."""
    left = np.searchsorted(table, keys, "left")
    count = np.searchsorted(table, keys, "right") - left
    places, left, count = places[count > 0], left[count > 0], count[count > 0]
    parts = np.flatnonzero(np.diff(np.cumsum(count) // CANDIDATES)) + 1
    for place, first, n in zip(np.split(places, parts), np.split(left, parts), np.split(count, parts)):
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.repeat(place, n), items[entry], offsets[entry]


def _around(index: Index, starts, item, row, at) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of what an item can cover that lies at ``at``, give or take its edits."""
    edits = index.limits[item]
    return np.maximum(starts[row], at - edits), np.minimum(starts[row + 1], at + index.sizes[item] + edits)


def _verify(index: Index, flat, starts, hits) -> list[tuple[int, int, int, int, int]]:
    """The hits (item, row, place; in this order) whose item is within its edit distance, by row and item."""
    found: dict[tuple[int, int], list[int]] = {}
    bounds = np.flatnonzero(np.diff(hits[0])) + 1
    for mine in np.split(hits, bounds, axis=1) if hits.shape[1] else []:
        item, rows = int(mine[0, 0]), mine[1]
        words, edits = index.items[item], index.edits(item)
        n = len(words)
        low, high = _around(index, starts, *mine)
        # all but ``edits`` of the item's words must be there: loses nothing, and is cheaper than the distance
        likely = np.zeros(len(rows), dtype=bool)
        step = max(1, (1 << 19) // (n + 2 * edits))
        for begin in range(0, len(rows), step):
            some = slice(begin, begin + step)
            around = low[some, None] + np.arange(n + 2 * edits)
            present = np.isin(flat[np.minimum(around, len(flat) - 1)], words) & (around < high[some, None])
            likely[some] = present.sum(axis=1) >= n - edits
        # overlapping surroundings of one row are searched as one
        rows, low, high = rows[likely], low[likely], high[likely]
        apart = np.flatnonzero((rows[1:] != rows[:-1]) | (low[1:] > high[:-1])) + 1
        for first, last in zip(np.append(0, apart)[: len(rows)], np.append(apart, len(rows))):
            row, begin = int(rows[first]), int(low[first])
            for distance, end in matches(words, flat[begin : int(high[last - 1])], edits):
                seen = found.setdefault((row, item), [distance, 0, begin + end - int(starts[row])])
                seen[0] = min(seen[0], distance)
                seen[1] += 1
    return [(row, item, *v) for (row, item), v in sorted(found.items())]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list]:
    """The items in blocks of about ``block_bytes`` of text, dealt by a hash: one query set, block by block."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()


def _indexes(
    benchmark: DataFrame, item: str, text: str, max_edits: float, recall: float, block_bytes: int, search: str
) -> Iterator:
    """The broadcast index of each block that has items."""
    context = benchmark.sparkSession.sparkContext
    for items in _blocks(benchmark, item, text, block_bytes):
        if items:
            yield context.broadcast(Index([r["item"] for r in items], [r["text"] for r in items], max_edits, recall, search))


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    max_edits: float = MAX_EDITS,
    recall: float = RECALL,
    block_bytes: int = BLOCK_BYTES,
    search: str = "walks",
) -> DataFrame:
    """One row per document row and item found in it: doc, item, distance, item_words, places, first_end.

    An item of n words is found where a run of the document's words is within
    floor(max_edits n) word edits of it: an exact copy always, an edited one with
    probability ``recall`` or more (always by ``search="pieces"``); ``max_edits`` is
    below 1. ``distance`` is the least one found, ``places`` how many separate places
    were found, ``first_end`` the place of the first, in words.

    Words are runs of letters and digits, in lower case. Null, empty or
    wordless texts contain nothing and are contained in nothing. Repeated
    documents and items are reported each; an empty table on either side gives
    an empty result. Other columns are ignored. Documents are read once per
    block of the benchmark and never shuffled; an index is sent to the tasks
    for each block of ``block_bytes``.
    """
    spark = documents.sparkSession
    doc_field, item_field = documents.schema[doc], benchmark.schema[item]
    schema = T.StructType(
        [
            T.StructField("doc_id", doc_field.dataType),
            T.StructField("item_id", item_field.dataType),
            T.StructField("distance", T.IntegerType()),
            T.StructField("item_words", T.IntegerType()),
            T.StructField("places", T.IntegerType()),
            T.StructField("first_end", T.IntegerType()),
        ]
    )
    narrow = documents.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = to_arrow_type(item_field.dataType)
    parts = [
        map_batches(narrow, _finder(index, kind), schema) for index in _indexes(benchmark, item, item_text, max_edits, recall, block_bytes, search)
    ]
    out = spark.createDataFrame([], schema) if not parts else parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def _finder(index, kind):
    def run(batches):
        book = index.value
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                found = find(book, piece.column("text"))
                if found:
                    rows, items, distance, places, ends = zip(*found)
                    yield pa.record_batch(
                        [
                            piece.column("doc_id").take(pa.array(rows, pa.int64())),
                            pa.array([book.ids[i] for i in items], kind),
                            pa.array(distance, pa.int32()),
                            pa.array([len(book.items[i]) for i in items], pa.int32()),
                            pa.array(places, pa.int32()),
                            pa.array(ends, pa.int32()),
                        ],
                        names=["doc_id", "item_id", "distance", "item_words", "places", "first_end"],
                    )

    return run


def clean(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    max_edits: float = MAX_EDITS,
    recall: float = RECALL,
    block_bytes: int = BLOCK_BYTES,
    search: str = "walks",
) -> DataFrame:
    """The rows, whole, in whose text no benchmark item is found; see ``leaks``."""

    def without(index):
        def run(batches):
            for batch in batches:
                for piece in tokens.slices(batch, text):
                    dirty = np.zeros(piece.num_rows, dtype=bool)
                    dirty[[row for row, *_ in find(index.value, piece.column(text))]] = True
                    yield piece.filter(pa.array(~dirty))

        return run

    out = documents
    for index in _indexes(benchmark, item_text, item_text, max_edits, recall, block_bytes, search):
        out = map_batches(out, without(index), documents.schema)
    return out
