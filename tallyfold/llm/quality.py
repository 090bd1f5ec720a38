"""Quality rules judged per document and per host.

Every document is measured once. Rule failures are then counted per host, each
host's failure rate is shrunk towards the rate of all hosts with a beta prior
fitted to the hosts themselves, and the verdict on the host goes back to its
documents. Native columns only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, materialize

#: words are runs of anything but these
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: least part of the spread of rates that is held to lie between hosts; keeps the prior finite
LEAST_SPREAD = 1e-6

#: production rules: a document fails a rule where the condition holds
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * word_chars",
    "copied_lines": "100 * n_dup_lines > 60 * n_lines",
}
#: a host is rejected where the shrunk failure rate of a rule exceeds its limit
LIMITS = {"short": 0.5, "repetitive": 0.5, "symbols": 0.5, "copied_lines": 0.5}


def _covered(windows: Column) -> Column:
    """How many words lie in a window whose hash occurs at least twice.

    Sorting (hash, place) brings equal windows together: n log n for any text.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        same = lambda p, k: (
            ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))
        )
        return F.filter(pairs, same)

    places = F.flatten(F.transform(let(placed, repeated), lambda p: F.array(*[p["i"] + k for k in range(WINDOW)])))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.size(F.array_distinct(places)))


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, _covered))


def measure(df: DataFrame, text: str = "text", into: str = "measured") -> DataFrame:
    """Add the struct ``into`` with the measures of every whole text.

    n_words, word_chars (code points in words), n_symbols, n_lines and
    n_dup_lines (lines with a word; equal to an earlier one), n_repeat_words
    (words in windows of three words found twice or more; windows are compared
    by a 64-bit hash inside one text). A null text has no words: all zero.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE + "+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    measures = F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    flat = let(
        measures,
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["l"]["n_lines"].alias("n_lines"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )
    return df.withColumn(into, flat)


def host_rates(failures: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """One row per host: ``host``, documents, failures and shrunk rate per rule.

    ``failures`` has a 0/1 column per rule. With p the pooled rate of a rule
    and g the share of the spread of rates that lies between hosts (moment
    estimate, Kleinman 1973), the prior is Beta(p m, (1 - p) m) with
    m = 1 / g - 1. Rows without a host belong to none.
    """
    counts = (
        failures.filter(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(f"k_{r}") for r in rules])
    )
    pooled = counts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        *[F.sum(f"k_{r}").alias(f"all_{r}") for r in rules],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"q_{r}") for r in rules],
    ).first()  # one row: the prior's parameters are numbers from here on
    out, inside = counts, pooled["hosts"] - 1
    for r in rules:
        p, between = 0.0, 0.0
        if pooled["total"]:
            total, p = float(pooled["total"]), pooled[f"all_{r}"] / pooled["total"]
            room = total - pooled["squares"] / total - inside
            if 0 < p < 1 and room > 0:
                between = ((pooled[f"q_{r}"] - total * p * p) / (p * (1 - p)) - inside) / room
        m = 1 / min(max(between, LEAST_SPREAD), 1 - LEAST_SPREAD) - 1
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + p * m) / (F.col("n") + m))
    return out.select(host, "n", *[f"k_{r}" for r in rules], *[f"rate_{r}" for r in rules])


def judge(
    measured: DataFrame,
    host: str = "source",
    rules: Mapping[str, str] | None = None,
    limits: Mapping[str, float] | None = None,
    own: tuple[str, ...] = ("short", "repetitive"),
    into: str = "quality",
) -> DataFrame:
    """Add ``base_failed``, ``host_failed`` and ``kept`` to the struct ``into`` of measures.

    ``measured`` comes from ``measure``; it is written to the shared folder
    once, as counts and join both read it, so drop a text that is not needed.
    ``rules`` maps a name to a condition on the measures, ``limits`` to the
    largest shrunk failure rate of a good host. ``base_failed``: a rule in
    ``own`` fails. ``kept``: neither the document nor its host fails.

    Null or empty text: all measures are 0, so "short" fails. Null host: no
    host verdict. Repeated rows each count and each get a verdict. An empty
    table gives an empty one. Other columns pass through untouched, whatever
    their names, unless one is called like ``into``.
    """
    rules, limits = dict(rules or RULES), dict(limits or LIMITS)
    names = list(rules)
    measured = materialize(measured, "quality")
    flat = measured.select(F.col(host).alias("host"), f"{into}.*")
    failures = flat.select("host", *[F.expr(f"cast({rules[r]} AS int)").alias(r) for r in names])
    rates = host_rates(failures, "host", names)
    over = [F.col(f"rate_{r}") > limits[r] for r in names]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    verdicts = rates.select(F.col("host").alias("_h"), F.struct(bad.alias("bad")).alias("_verdict"))
    own_failed = F.expr(" OR ".join(f"({_qualified(rules[r], into)})" for r in own))
    joined = measured.alias("d").join(verdicts.alias("v"), F.col(f"d.{host}") == F.col("v._h"), "left")
    host_failed = F.coalesce(F.col("v._verdict.bad"), F.lit(False))
    quality = F.col(into).withField("base_failed", own_failed).withField("host_failed", host_failed)
    quality = quality.withField("kept", ~own_failed & ~host_failed)
    return joined.select(*[F.col(f"d.`{c}`") for c in measured.columns if c != into], quality.alias(into))


def _qualified(rule: str, struct: str) -> str:
    """The rule with its measures read from ``struct``."""
    measures = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return re.sub(rf"\b({'|'.join(measures)})\b", rf"{struct}.\1", rule)
