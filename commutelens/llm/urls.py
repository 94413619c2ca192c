"""URL filters: rules for hosts and paths, and boosted trees for what no rule fits.

The trees learn from labelled URLs; lexical features of the URL and statistics of its host's
suffixes are DataFrame expressions, the trees are Spark's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.common import bind, lower_az, text_of
from commutelens.session import cut

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        here = (host == self.host) | host.endswith(f".{self.host}")
        return here & path.startswith(self.path)


RULES = [
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
]


@dataclass(frozen=True)
class Boosting:
    """Settings of the trees; ``max_rows`` bounds the distinct labelled URLs they learn from.

    ``folds`` are parts of the hosts: the trees see a URL with shares of blocked URLs from the
    other parts, as its own label is in its own part's shares.  URLs of a suffix meet its statistics
    in ``parts`` keys, as one suffix may hold most of them.
    """

    trees: int = 12
    depth: int = 4
    step: float = 0.2
    max_rows: int = 200_000
    smoothing: float = 20.0
    folds: int = 5
    parts: int = 16
    seed: int = 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL and for one without ``://``."""
    whole = text_of(url)
    return lower_az(F.regexp_extract(whole, PARTS, 1)), F.regexp_extract(whole, PARTS, 2)


def _first(rules: Sequence[UrlRule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, as one ordered expression; of two as long, block."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(str(r)), r.verdict != "block", str(r))):
        out = (F if out is None else out).when(rule.fits(host, path), F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def apply_rules(pages: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """``page_id, url, host, path, rule, ruled``; the last two are null where no rule fits."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return parts.withColumns({
        "rule": _first(rules, F.col("host"), F.col("path"), str),
        "ruled": _first(rules, F.col("host"), F.col("path"), lambda r: r.verdict),
    })


def _entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        times = F.transform(
            F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double")
        )
        weighed = F.aggregate(times, F.lit(0.0), lambda total, k: total + k * F.log2(k))
        return F.when(n > 0, F.log2(n) - weighed / n).otherwise(0.0)

    return bind(F.array_remove(F.split(text, ""), ""), of)


def _times(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("double")


def suffix(host: Column, labels: int) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


def lexical() -> dict[str, Column]:
    """Features of ``url, host, path`` by themselves."""
    url, host, path = text_of("url"), F.col("host"), F.col("path")
    rest = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _times(path, "/"),
        "host_labels": _times(host, ".") + 1,
        "host_hyphens": _times(host, "-"),
        "digit_ratio": _times(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _times(host, "0123456789"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": F.when(rest == "", 0.0).otherwise(_times(rest, "&") + 1),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"),
    }


def featured(pages: DataFrame, labels: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """``pages`` (with ``url, host, path``), a struct ``_x`` of all features and a struct ``_learn``.

    ``labels (url, blocked)`` gives each suffix its share of blocked URLs, drawn to the share
    of all.  ``_learn`` has the shares without the hosts of the URL's fold, in place of those in
    ``_x``: so a suffix tells the trees as much as it tells of hosts not seen yet.  Suffixes are
    grouped before anything is joined.
    """
    out = pages.withColumn("_lexical", F.struct(*[c.alias(n) for n, c in lexical().items()])).withColumn(
        "_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(how.parts)).cast("int")
    )
    host, _ = host_and_path(F.col("url"))
    marked = labels.select(host.alias("host"), "blocked")
    overall = marked.agg(F.coalesce(F.avg("blocked"), F.lit(0.5)).alias("mean")).first()["mean"]
    columns, learn = [F.col("_lexical.*")], []

    def fold(host: Column) -> Column:
        return F.pmod(F.xxhash64(host, F.lit(how.seed)), F.lit(how.folds)).cast("int")

    def drawn(blocked: Column, all_: Column) -> Column:
        return (F.coalesce(blocked, F.lit(0)) + how.smoothing * overall) / (F.coalesce(all_, F.lit(0)) + how.smoothing)

    def in_fold(value: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(fold(F.col("host")) == k, value)), F.lit(0)) for k in range(how.folds)])

    for n in (1, 2):
        end = f"_end{n}"
        seen = (
            pages.groupBy(suffix(F.col("host"), n).alias(end), "host")
            .agg(F.count("*").alias("pages"))
            .groupBy(end)
            .agg(F.log1p(F.sum("pages")).alias(f"pages{n}"), F.log1p(F.count("*")).alias(f"hosts{n}"))
        )
        share = marked.groupBy(suffix(F.col("host"), n).alias(end)).agg(
            F.sum("blocked").alias(f"_blocked{n}"),
            F.count("*").alias(f"_all{n}"),
            in_fold(F.col("blocked")).alias(f"_own_blocked{n}"),
            in_fold(F.lit(1)).alias(f"_own_all{n}"),
        )
        every = F.explode(F.sequence(F.lit(0), F.lit(how.parts - 1)))
        table = seen.join(share, end, "left").withColumn("_part", every)
        out = out.withColumn(end, suffix(F.col("host"), n)).join(table, [end, "_part"])
        own_blocked, own_all = (F.get(f"_own_{what}{n}", fold(F.col("host"))) for what in ("blocked", "all"))
        columns += [f"pages{n}", f"hosts{n}", drawn(F.col(f"_blocked{n}"), F.col(f"_all{n}")).alias(f"blocked{n}")]
        others = drawn(F.col(f"_blocked{n}") - own_blocked, F.col(f"_all{n}") - own_all)
        learn.append(others.alias(f"blocked{n}"))
    return out.select(*pages.columns, F.struct(*columns).alias("_x"), F.struct(*learn).alias("_learn"))


def judge(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: Sequence[UrlRule] = RULES,
    how: Boosting = Boosting(),
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages (page_id, url)``.

    ``labels (url, blocked 0/1)`` are the labelled URLs; without any, those that a rule decides.
    The verdict is the rule's where one fits, else block if ``score``, the trees' probability,
    is over one half.  If the labels are of one class only, that class is the answer, and without any
    it is allow.  Null and broken URLs are empty in all parts and judged like the others;
    repeated rows are judged alike; an empty table gives an empty one; other columns are ignored.
    """
    ruled = cut(apply_rules(pages, rules), "urls-ruled")
    if labels is None:
        labels = ruled.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").cast("int").alias("blocked"))
    # a URL that is copied often teaches once
    labels = cut(labels.where("url IS NOT NULL AND blocked IN (0, 1)").distinct(), "urls-labelled")
    counts = {r["blocked"]: r["count"] for r in labels.groupBy("blocked").count().collect()}
    if len(counts) < 2:
        only = float(next(iter(counts), 0))
        scored = ruled.withColumn("score", F.lit(only))
    else:
        x = cut(featured(ruled, labels, how), "urls-features")
        share = min(1.0, how.max_rows / sum(counts.values()))
        taken = labels.where(F.pmod(F.xxhash64("url", F.lit(how.seed)), F.lit(1_000_000)) < int(share * 1_000_000))
        names = x.schema["_x"].dataType.names
        assembler = VectorAssembler(inputCols=names, outputCol="features")
        shares = {n: F.col(f"_learn.{n}") for n in x.schema["_learn"].dataType.names}
        one_each = x.dropDuplicates(["url"]).select("url", "_x.*", "_learn").withColumns(shares)
        training = assembler.transform(one_each.join(taken, "url")).select(
            F.col("blocked").cast("double").alias("label"), "features"
        )
        trees = GBTClassifier(
            maxIter=how.trees, maxDepth=how.depth, stepSize=how.step, seed=how.seed
        ).fit(cut(training, "urls-training"))
        from_trees = trees.transform(assembler.transform(x.select("page_id", "host", "path", "rule", "ruled", "_x.*")))
        scored = from_trees.withColumn("score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
