"""Fill-in-the-middle examples, cut by a learned index from a unit's rank to its place.

A cut after r units needs the place (byte offset) of boundary r. The index of a
text fits straight segments to all its boundary offsets, each within a fixed
error, and keeps the small rest of every boundary. A cut is predicted by its
segment and made exact by the rest. Between changes of the units' width the
offsets are straight, so a segment that holds at these changes holds at every
boundary; plain ASCII is one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, map_batches

#: marks of the three parts (fixed values, the format)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: largest distance of a boundary from its segment; with rounding it fits one signed byte
ERROR = 126
_FIRST_BLOCK = 256


@dataclass
class RankIndex:
    """Byte offsets of ranks 0 .. n: segments (first rank, its offset, slope) and a rest for every rank."""

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    rests: np.ndarray

    @property
    def units(self) -> int:
        return len(self.rests) - 1

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets by the segments alone, off by ``ERROR`` and a rounding at most."""
        k = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[k] + np.rint(self.slopes[k] * (ranks - self.starts[k])).astype(np.int64)

    def offsets(self, ranks) -> np.ndarray:
        """The exact offsets."""
        ranks = np.asarray(ranks, dtype=np.int64)
        return self.predict(ranks) + self.rests[ranks]


def fit(bounds: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index of ascending boundary offsets, the first being 0.

    Segments are grown greedily: from a segment's first boundary, each next one
    allows a range of slopes, and the segment ends before the ranges no longer
    meet. Ranges are met in growing blocks, so the work is linear.
    """
    n = len(bounds) - 1
    widths = np.diff(bounds)
    knots = np.append(np.flatnonzero(widths[1:] != widths[:-1]) + 1, n) if n else np.empty(0, np.int64)
    starts, slopes = [0], []
    at, size = 0, _FIRST_BLOCK  # the first knot beyond the segment's start
    low, high, first, done = -np.inf, np.inf, 0, 0
    while at + done < len(knots):
        ranks = knots[at + done : at + done + size]
        run, rise = ranks - first, bounds[ranks] - bounds[first]
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        apart = lows > highs
        stop = int(np.argmax(apart)) if apart.any() else len(ranks)
        if stop:
            low, high = lows[stop - 1], highs[stop - 1]
        done += stop
        size *= 2
        if stop < len(ranks):
            slopes.append((low + high) / 2)
            at, first = at + done, int(knots[at + done - 1])
            starts.append(first)
            low, high, done, size = -np.inf, np.inf, 0, _FIRST_BLOCK
    slopes.append((low + high) / 2 if done else 0.0)
    index = RankIndex(np.array(starts), bounds[starts], np.array(slopes), np.zeros(n + 1, np.int8))
    rests = bounds - index.predict(np.arange(n + 1))
    index.rests = rests.astype(np.int8)
    if not np.array_equal(index.rests, rests):
        raise ArithmeticError("a boundary lies farther from its segment than the error allows")
    return index


def char_bounds(data: np.ndarray) -> np.ndarray:
    """Offsets of all code points of UTF-8 bytes, and their end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Offsets of all lines of UTF-8 bytes, and their end; a line ends after its newline."""
    ends = np.flatnonzero(data == 10) + 1
    inner = ends[ends < len(data)]
    return np.concatenate([[0], inner, [len(data)]]) if len(data) else np.zeros(1, np.int64)


UNITS = {"char": char_bounds, "line": line_bounds}


def _cutter(unit: str, error: int, names: list[str], given: list[str], added: list[str]):
    def run(batches):
        for batch in batches:
            raw, form, one, two = (batch.column(c) for c in given)
            counts, before, middle, texts = [], [], [], []
            for r in range(batch.num_rows):
                text = raw[r].as_py() or b""
                index = fit(UNITS[unit](np.frombuffer(text, dtype=np.uint8)), error)
                counts.append(index.units)
                kind = form[r].as_py()
                if kind == "plain":
                    before.append(None)
                    middle.append(None)
                    texts.append(text)
                    continue
                cuts = sorted((one[r].as_py() % (index.units + 1), two[r].as_py() % (index.units + 1)))
                a, b = index.offsets(cuts).tolist()
                p, m, s = text[:a], text[a:b], text[b:]
                parts = (PREFIX, p, SUFFIX, s) if kind == "psm" else (SUFFIX, s, PREFIX, p)
                texts.append(b"".join(x.encode() if isinstance(x, str) else x for x in (*parts, MIDDLE, m)))
                before.append(cuts[0])
                middle.append(cuts[1] - cuts[0])
            columns = [batch.column(c) for c in names]
            columns += [pa.array(x, pa.int64()) for x in (counts, before, middle)] + [form, pa.array(texts, pa.binary())]
            yield pa.record_batch(columns, names=[*names, *added])

    return run


def fill_in_middle(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    salt: str = "1",
    plain_percent: int = 10,
    spm_percent: int = 20,
    unit: str = "char",
    error: int = ERROR,
    into: str = "example",
) -> DataFrame:
    """Add the struct ``into``: n, prefix_units, middle_units, form, output.

    ``n`` counts the units (code points, or lines that keep their newline) of the
    whole text. Two cuts and the form come from the SHA-256 of salt, colon and
    id (a null id counts as empty), so a row gets the same example on every run.
    Plain texts (empty or null ones, texts that hold a mark, and
    ``plain_percent`` of the rest) are left as they are, their cuts null;
    ``spm_percent`` of the others put the suffix first. Repeated rows are
    repeated; an empty table stays empty; all other columns pass through, a
    column called like ``into`` is replaced.
    """
    names = [c for c in df.columns if c.lower() != into.lower()]
    given = fresh(df, "_text", "_form", "_one", "_two")
    added = fresh(df, "_n", "_prefix", "_middle", "_kind", "_output")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(f"`{doc}`").cast("string"), F.lit(""))), 256)
    word = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (word(2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(word(3) % 100 < spm_percent, "spm").otherwise("psm")
    values = (whole.cast("binary"), form, word(0), word(1))
    ready = df.select(*[F.col(f"`{c}`") for c in names], *[v.alias(g) for g, v in zip(given, values, strict=True)])
    types = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType())
    fields = [T.StructField(a, t) for a, t in zip(added, types, strict=True)]
    schema = T.StructType([df.schema[c] for c in names] + fields)
    cut = map_batches(ready, _cutter(unit, error, names, given, added), schema)
    parts = dict(zip(("n", "prefix_units", "middle_units", "form", "output"), added, strict=True))
    parts = [(F.col(c).cast("string") if p == "output" else F.col(c)).alias(p) for p, c in parts.items()]
    return cut.select(*[F.col(f"`{c}`") for c in names], F.struct(*parts).alias(into))


def restored(form: Column, output: Column) -> Column:
    """The exact text of an example, from its form and output."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    back = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == "plain", output).otherwise(back.otherwise(F.concat(parts[2], parts[3], parts[1])))
