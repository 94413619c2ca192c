"""Quality rules: a learned list of threshold conjunctions over document statistics.

Sequential covering.  A rule is grown condition by condition on two thirds of the labelled
rows, always by the condition of most information gain; it is pruned back to the prefix
that does best on the other third; the rows it covers are taken out and the next rule
is grown.  Every step is one grouping of the labelled statistics, of which only counts
per feature and bin reach the driver.  The finished list is one ordered ``CASE`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.common import UPPER, bind, fresh, text_of, words
from commutelens.session import cut

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _repeat_words(found: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by their 64-bit hash.  Only texts that repeat a window sort
    theirs; each repeated window adds the words that the one before it doesn't cover.
    """

    def equal(a, b):
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def covered(at):
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(s):
        again = F.filter(s, lambda e, i: equal(F.get(s, i - 1), e) | equal(F.get(s, i + 1), e))
        return bind(F.sort_array(F.transform(again, lambda e: e["i"])), covered)

    def among(hashes):
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bind(F.sort_array(pairs), repeated)
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(found) - 3),
        lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)),
    )
    return F.when(F.size(found) < 3, F.lit(0)).otherwise(bind(windows, among))


def _dup_lines(text: Column) -> Column:
    with_word = bind(F.split(text, "\n"), lambda lines: F.filter(lines, lambda x: x.rlike(r"[^ \t-\r]")))
    return bind(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def statistics(docs: DataFrame, into: str = "_stats") -> DataFrame:
    """``docs`` with the counts of its ``text`` in one struct column ``into``.

    A null text counts as empty and has zeros everywhere.  Texts are taken whole.
    """
    text = text_of("text")
    of_words = bind(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("repeated")),
    )
    held = fresh(docs, "_words")
    counts = docs.withColumn(held, of_words)
    longs = {
        "n_words": F.col(f"{held}.n"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")),
        "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": _dup_lines(text),
        "n_repeat_words": F.col(f"{held}.repeated"),
        "n_lines": _count(text, "\n") + 1,
        "n_upper": _count(text, UPPER),
        "n_digits": _count(text, "0123456789"),
        "n_marks": _count(text, "!?"),
        "n_stops": _count(text, ".,;:"),
    }
    return counts.withColumn(
        into, F.struct(*[c.cast("long").alias(name) for name, c in longs.items()])
    ).drop(held)


def features(stats: str = "_stats") -> dict[str, Column]:
    """What conditions may ask about: the counts, most of them per word or letter."""

    def per(a: str, b: str) -> Column:
        return F.col(f"{stats}.{a}") / F.greatest(F.col(f"{stats}.{b}"), F.lit(1))

    return {
        "words": F.col(f"{stats}.n_words").cast("double"),
        "letters_per_word": per("word_chars", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "stops": per("n_stops", "n_words"),
    }


def base_failed(stats: str = "_stats") -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, named: dict[str, Column]) -> Column:
        value = named[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.4g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, named: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(named)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class Learner:
    """Limits of the search.

    ``max_rows`` bounds the labelled rows that are learned from; beyond it a share of them is
    taken by the hash of their id.  A rule is accepted if on the rows it was not grown on it covers
    ``support`` bad ones at least and that share ``precision`` of what it covers is bad.
    """

    max_rows: int = 1_000_000
    bins: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    precision: float = 0.9
    support: int = 3


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def _bin(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value))


def learn(stats: DataFrame, labels: DataFrame, how: Learner = Learner()) -> list[Rule]:
    """Rules that find label 0, most valuable first.

    ``stats`` has ``doc_id`` and ``_stats``; ``labels`` has ``doc_id, quality``.  Rows
    without an id or a quality of 0 or 1 teach nothing; an id labelled twice counts twice.
    No labelled rows, or only one class: no rules.  Documents that fail the base rule
    are left out, as the list never judges them.
    """
    named = features()
    rows = (
        stats.where(~base_failed())
        .join(labels.where("quality IN (0, 1)").select("doc_id", "quality"), "doc_id")
        .select(
            "doc_id",
            (F.col("quality") == 0).cast("long").alias("bad"),
            F.array(*named.values()).alias("v"),
        )
    )
    rows = cut(rows, "rules-labelled")
    total = rows.count()
    if total > how.max_rows:
        share = int(1_000_000 * how.max_rows / total)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share)
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0
    rows = rows.withColumn("held", part)
    names = list(named)
    at = {name: F.col("v")[i] for i, name in enumerate(names)}
    probabilities = [k / how.bins for k in range(1, how.bins)]
    bounds = rows.groupBy("bad").agg(
        *[F.percentile_approx(c, probabilities, 10_000).alias(n) for n, c in at.items()]
    ).collect()
    # thresholds at quantiles of either class, as most of the bad ones may lie in one tail
    edges = {n: sorted({float(x) for row in bounds for x in row[n] or []}) for n in names}
    if {row["bad"] for row in bounds} != {0, 1}:
        return []
    # the bin of a value is the number of thresholds at or below it
    binned = rows.select(
        "bad",
        "held",
        "v",
        F.array(
            *[_bin(at[n], edges[n]) for n in names]
        ).alias("bins"),
    )
    left = cut(binned, "rules-binned")

    def counts(df: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
        grouped = df.select("bad", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin")
        found = grouped.agg(F.sum("bad").alias("p"), F.count("*").alias("all")).collect()
        return {(r["feature"], r["bin"]): (r["p"], r["all"] - r["p"]) for r in found}

    rules: list[Rule] = []
    while len(rules) < how.max_rules:
        conditions: list[Condition] = []
        covered = left.where(~F.col("held"))
        p0 = n0 = None
        while len(conditions) < how.max_conditions:
            table = counts(covered)
            p0 = sum(p for (f, _), (p, _) in table.items() if f == 0)
            n0 = sum(n for (f, _), (_, n) in table.items() if f == 0)
            if not p0 or not n0:
                break
            best: tuple[float, Condition] | None = None
            for f, name in enumerate(names):
                below_p = below_n = 0
                for b in range(len(edges[name])):
                    p, n = table.get((f, b), (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for at_least, pp, nn in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                        gain = _gain(pp, nn, p0, n0)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = gain, Condition(name, at_least, edges[name][b])
            if best is None:
                break
            conditions.append(best[1])
            covered = covered.where(best[1].column(at))
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        tallies = left.where("held").agg(
            *[F.sum(F.when(r.column(at), F.col("bad"))).alias(f"p{k}") for k, r in enumerate(prefixes)],
            *[F.count(F.when(r.column(at), 1)).alias(f"a{k}") for k, r in enumerate(prefixes)],
        ).first()
        score = [
            ((2 * (tallies[f"p{k}"] or 0) - tallies[f"a{k}"]) / max(tallies[f"a{k}"], 1), -k)
            for k in range(len(prefixes))
        ]
        k = -max(score)[1]
        p, every = tallies[f"p{k}"] or 0, tallies[f"a{k}"]
        if p < how.support or p < how.precision * every:
            break
        rules.append(prefixes[k])
        left = left.where(~prefixes[k].column(at))
    return rules


def verdict(rules: list[Rule], stats: str = "_stats") -> Column:
    """The first rule that holds, as text; null where none does."""
    named = features(stats)
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.column(named), F.lit(str(rule)))
    return F.lit(None).cast("string") if out is None else out


def keeps(rules: list[Rule], stats: str = "_stats") -> Column:
    """Whether neither the base rule nor a learned one rejects a document."""
    return ~base_failed(stats) & verdict(rules, stats).isNull()


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` (of :func:`statistics`) with ``base_failed``, ``rule`` and ``kept``."""
    return (
        docs.withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
        .withColumn("kept", keeps(rules))
    )
