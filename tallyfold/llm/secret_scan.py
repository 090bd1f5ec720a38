"""Secrets in texts, told apart by how many owners share them. Native columns only.

Three kinds of credentials are found by pattern in every whole text. Beside
them, long mixed runs of characters are candidates: their hashes are counted
corpus-wide by distinct repositories and owners. A value that few owners hold
is taken for a live credential of theirs, one that many hold for a copied
example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, materialize

_VALUE = "[A-Za-z0-9+/_.=-]"
_NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: kind -> pattern. Runs shorter than the kind's least length cannot hide a longer
#: match in hex and access, so these two ask for the length at once.
PATTERNS = {
    "assign": f"{_NAME}{_VALUE}+",
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
}
ASSIGN_LENGTH = 12
KINDS = (*PATTERNS, "owned")
CANDIDATE = "[A-Za-z0-9_-]{20,}"
#: a candidate looks live with lower and upper case letters, two digits and so many different characters
LIVE = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9])"
LIVE_CHARACTERS = 10
#: a value held by at most so many owners is theirs
MAX_OWNERS = 2
MARK = "[SECRET]"

_BLOCK = 256
#: code points of a text that are cut out at once
_TEXT_BLOCK = 1024
_LONGS = "array<bigint>"


def _running(steps: Column) -> Column:
    """Sum of the steps before each place; two levels, so long arrays are not copied for every step."""

    def plain(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), F.array().cast(_LONGS).alias("out"))
        grow = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, zero, grow, lambda a: a["out"])

    def blocks(xs: Column) -> Column:
        n = F.floor((F.size(xs) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda b: F.slice(xs, b * _BLOCK + 1, _BLOCK))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        return let(plain(sums, F.lit(0)), lambda starts: F.flatten(F.transform(parts, lambda p, i: plain(p, F.get(starts, i)))))

    return F.when(F.size(steps) == 0, F.array().cast(_LONGS)).otherwise(let(let(steps, blocks), joined))


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:bigint>>"


def _spans(text: Column, pattern: str, kind: int, value: str | None = None, live: bool = False) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, hash of the value); with ``live`` those that look it.

    Every match is judged where it is at hand: cutting it out of the text again
    would count from the text's beginning each time.
    """

    def place(gaps: Column) -> Column:
        def with_matches(found: Column) -> Column:
            steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
            return let(
                _running(steps),
                lambda before: F.transform(found, lambda m, i: span(m, F.get(before, i) + F.length(F.get(gaps, i)))),
            )

        def span(m: Column, start: Column) -> Column:
            secret = F.regexp_replace(m, value, "") if value else m
            keep = F.length(secret) >= ASSIGN_LENGTH if value else F.lit(True)
            if live:
                keep = m.rlike(LIVE) & (F.size(F.array_distinct(F.split(m, ""))) >= LIVE_CHARACTERS)
            one = F.struct(
                start.cast("long").alias("start"),
                F.lit(kind).alias("kind"),
                (start + F.length(m)).cast("long").alias("end"),
                F.xxhash64(secret).alias("hash"),
            )
            return F.when(keep, one)

        found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_matches)
        return F.when(F.size(gaps) == 1, F.array().cast(_SPAN)).otherwise(F.array_compact(found))

    return let(F.split(text, pattern), place)


def scan(
    df: DataFrame,
    owner: str = "source",
    repository: str = "source",
    text: str = "text",
    max_owners: int = MAX_OWNERS,
    carry: tuple[str, ...] | None = None,
    into: str = "secrets",
) -> DataFrame:
    """Add the array ``into`` of spans: start, kind (name), end, owners, repositories.

    Spans are in code points, end exclusive, ordered by start, then kind as in
    ``KINDS``. ``assign``, ``access`` and ``hex`` are always kept; ``owned`` are further
    candidates that at most ``max_owners`` owners hold. ``owners`` and
    ``repositories`` say how many hold the value, over the whole table.

    A null text has no secrets. A null owner or repository counts as one more
    owner or repository. Repeated rows are scanned each. An empty table gives
    an empty one. ``carry`` names the columns to keep (all by default); what is
    kept is written once to the shared folder with the spans found, as counts
    and verdicts both need them.
    """
    kept = [c for c in df.columns if c != into] if carry is None else list(carry)
    row, found, own, repo, row_of, spans_of = fresh(df, "row", "found", "owner_of", "repository_of", "row_of", "spans_of")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = [
        _spans(t, PATTERNS["assign"], 0, f"^{_NAME}"),
        _spans(t, PATTERNS["access"], 1),
        _spans(t, PATTERNS["hex"], 2),
    ]
    spans = F.concat(*base, _spans(t, CANDIDATE, KINDS.index("owned"), live=True))
    scanned = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"`{owner}`").cast("string").alias(own),
        F.col(f"`{repository}`").cast("string").alias(repo),
        F.monotonically_increasing_id().alias(row),
        spans.alias(found),
    )
    scanned = materialize(scanned, "scanned")
    each = scanned.select(
        F.col(row).alias("row"), F.col(own).alias("owner"), F.col(repo).alias("repo"), F.explode(found).alias("s")
    )
    # distinct holders first, so a value repeated in most documents is a few rows here
    holders = each.select(F.col("s.hash").alias("hash"), "owner", "repo").distinct()
    owners = holders.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    shared = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    names = F.array(*[F.lit(k) for k in KINDS])
    judged = each.select("row", "s.*").join(shared, "hash")
    judged = judged.filter((F.col("kind") != KINDS.index("owned")) | (F.col("owners") <= max_owners))
    one = F.struct("start", "kind", "end", "owners", "repositories")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    per_row = per_row.select(
        F.col("row").alias(row_of),
        F.transform("spans", lambda s: s.withField("kind", F.get(names, s["kind"]))).alias(spans_of),
    )
    # rows without any span, mostly the bulk, need no join
    nothing = F.array().cast("array<struct<start:bigint,kind:string,end:bigint,owners:bigint,repositories:bigint>>")
    hit = scanned.filter(F.size(found) > 0).join(per_row, F.col(row) == F.col(row_of), "left")
    hit = hit.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(spans_of), nothing).alias(into))
    clean = scanned.filter(F.size(found) == 0)
    return hit.unionAll(clean.select(*[F.col(f"`{c}`") for c in kept], nothing.alias(into)))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _most_before(values: Column) -> Column:
    """The largest of the values before each place, 0 before the first; in two levels, as ``_running``."""

    def plain(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), F.array().cast(_LONGS).alias("out"))
        grow = lambda a, x: F.struct(F.greatest(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, zero, grow, lambda a: a["out"])

    def joined(parts: Column) -> Column:
        most = F.transform(parts, lambda p: F.array_max(p))
        return let(plain(most, F.lit(0)), lambda starts: F.flatten(F.transform(parts, lambda p, i: plain(p, F.get(starts, i)))))

    n = lambda xs: F.floor((F.size(xs) - 1) / _BLOCK).cast("int")
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), n(xs)), lambda b: F.slice(xs, b * _BLOCK + 1, _BLOCK))
    return let(let(values, blocks), joined)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``MARK``.

    The text is cut into blocks once, so that a piece of it is reached without
    counting from the beginning, and the pieces are joined once.
    """

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        def part(k: Column) -> Column:
            first = F.greatest(start - k * _TEXT_BLOCK, F.lit(0).cast("long"))
            length = F.least(end - k * _TEXT_BLOCK, F.lit(_TEXT_BLOCK).cast("long")) - first
            return F.substring(F.get(blocks, k.cast("int")), (first + 1).cast("int"), length.cast("int"))

        whole = F.sequence(F.floor(start / _TEXT_BLOCK), F.floor((end - 1) / _TEXT_BLOCK))
        return F.when(end > start, F.array_join(F.transform(whole, part), "")).otherwise("")

    def build(blocks: Column, before: Column) -> Column:
        def marked(s: Column, i: Column) -> Column:
            at = F.get(before, i)
            return F.when(s["start"] >= at, F.concat(piece(blocks, at, s["start"]), F.lit(MARK))).otherwise("")

        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        last = piece(blocks, end, F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(spans, marked), ""), last)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))
    before = _most_before(F.transform(spans, lambda s: s["end"]))
    changed = let(blocks, lambda bs: let(before, lambda ends: build(bs, ends)))
    return F.when(F.size(spans) == 0, text).otherwise(changed)
