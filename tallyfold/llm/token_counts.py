"""Tokens per field and section, from one encoding of the whole document.

Cutting a text before encoding changes its tokens. Here the document is encoded
once, whole; the tokens' character spans are joined with the spans of the
fields and sections, and a token that crosses a boundary goes to one side by an
explicit rule.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .shared import map_batches

#: "most": the span that holds most of the token's characters, the earlier one on a tie;
#: "first", "last": the span that holds its first or last character
RULES = ("most", "first", "last")


def spans_of(parts: Sequence[str], between: str, section_end: str | None) -> tuple[str, np.ndarray, np.ndarray]:
    """The document, its spans' starts (and one end), and the field of each span.

    ``between`` belongs to the field it follows. The last field is cut after
    each ``section_end``. A field without characters has one empty span.
    """
    starts, fields, at = [], [], 0
    for k, part in enumerate(parts):
        starts.append(at)
        fields.append(k)
        if k == len(parts) - 1 and section_end:
            cut = part.find(section_end)
            while 0 <= cut < len(part) - len(section_end):
                cut += len(section_end)
                starts.append(at + cut)
                fields.append(k)
                cut = part.find(section_end, cut)
        at += len(part) + (len(between) if k < len(parts) - 1 else 0)
    return between.join(parts), np.array([*starts, at]), np.array(fields)


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token; a character split between tokens belongs to each."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    end = np.cumsum(sizes[ids])
    begin = end - sizes[ids]
    if len(data) == len(text):
        return begin, end
    place = np.cumsum((data & 0xC0) != 0x80) - 1
    return place[begin], place[end - 1] + 1


def allot(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The span of each token, and whether the token crosses a boundary."""
    first = np.searchsorted(starts[1:], begin, "right")
    last = np.searchsorted(starts[1:], end - 1, "right")
    crosses = first != last
    if rule == "first" or not crosses.any():
        return first, crosses
    if rule == "last":
        return last, crosses
    out = first.copy()
    for t in np.flatnonzero(crosses):
        spans = np.arange(first[t], last[t] + 1)
        held = np.minimum(starts[spans + 1], end[t]) - np.maximum(starts[spans], begin[t])
        out[t] = spans[int(np.argmax(held))]
    return out, crosses


def _count(fields: int, between: str, section_end: str | None, rule: str, path: str, special: bool):
    def run(batches):
        sizes = bpe.byte_sizes(path)
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1, fields + 1)]
            rows, out = [], {k: [] for k in ("field", "section", "start", "end", "tokens", "crossing")}
            for r in range(batch.num_rows):
                text, starts, owner = spans_of([c[r] or "" for c in columns], between, section_end)
                ids = bpe.encode(text, path, special)
                begin, end = token_spans(text, ids, sizes)
                span, crosses = allot(begin, end, starts, rule)
                n = len(owner)
                rows.append(np.full(n, r))
                out["field"].append(owner)
                out["section"].append(np.arange(n) - np.searchsorted(owner, owner))
                out["start"].append(starts[:-1])
                out["end"].append(starts[1:])
                out["tokens"].append(np.bincount(span, minlength=n))
                out["crossing"].append(np.bincount(span[crosses], minlength=n))
                if len(rows) >= 512 or r == batch.num_rows - 1:
                    ids_column = batch.column(0).take(pa.array(np.concatenate(rows)))
                    yield pa.record_batch(
                        [ids_column, *[pa.array(np.concatenate(v).astype(np.int32)) for v in out.values()]],
                        names=["doc_id", *out],
                    )
                    rows, out = [], {k: [] for k in out}

    return run


def section_tokens(
    df: DataFrame,
    doc: str = "doc_id",
    fields: Sequence[str] = ("source", "text"),
    between: str = "\n",
    section_end: str | None = "\n",
    rule: str = "most",
    path: str | None = None,
    special: bool = False,
) -> DataFrame:
    """One row per document, field and section: doc_id, field, section, start, end, tokens, crossing.

    The document is its ``fields`` joined by ``between``; it is encoded whole. The
    last field is cut into sections after each ``section_end``. ``start`` and ``end``
    are code points in the document; every character lies in one section, so
    ``tokens`` add up to the document's. ``crossing`` counts those among them
    that reach into another section and came here by ``rule``. ``special`` as in
    ``bpe.encode``.

    Null or empty fields have one empty section with no tokens. A null doc_id
    stays null; repeated rows are counted each; an empty table gives no rows;
    other columns are ignored. No shuffle: a document is one row's work.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or bpe.default_path()
    narrow = df.select(
        F.col(f"`{doc}`").alias("doc_id"), *[F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)]
    )
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[doc].dataType)]
        + [T.StructField(n, T.IntegerType()) for n in ("field", "section", "start", "end", "tokens", "crossing")]
    )
    counted = map_batches(narrow, _count(len(fields), between, section_end, rule, path, special), schema)
    names = F.array(*[F.lit(f) for f in fields])
    return counted.withColumn("field", F.get(names, F.col("field")))
