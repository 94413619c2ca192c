"""Secret scans with corpus-wide ownership.

Patterns find the base spans; any other long token that mixes letters and digits at random is
a candidate.  The values of all of them are hashed, and for each hash the documents and the
owners that hold it are counted over the whole corpus.  What many owners hold is an example
that is copied around, and so is what few owners hold in very many documents; what belongs to few
in few looks live, and such candidates become spans too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.common import text_of
from commutelens.session import cut

KINDS = ["assign", "access", "hex", "token"]
"""In the order in which spans of one start are listed; the last is what this method adds."""
# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

FEW_OWNERS = 2
"""A value that more owners hold is an example."""
FEW_REPOSITORIES = 20
"""So is a value that its owners hold in more different repositories than this each, on average."""
ENTROPY = 3.0
"""Least entropy of a live value, in bits a character."""

Span = tuple[str, int, int, str]


def entropy(value: str) -> float:
    return -sum(k / len(value) * math.log2(k / len(value)) for k in Counter(value).values()) if value else 0.0


def base_spans(text: str) -> list[Span]:
    """Kind, start, end and value of the base spans, by start and kind."""
    out, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if max(map(len, text.split()), default=0) >= 20:  # neither kind holds a blank
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def random_looking(value: str) -> bool:
    return (
        any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
        and entropy(value) >= ENTROPY
    )


def other_tokens(text: str, base: list[Span]) -> list[Span]:
    """Random-looking tokens that touch no base span."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    found = [("token", *m.span(), m[0]) for m in TOKEN.finditer(text) if random_looking(m[0])]
    return [s for s in found if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


SCANNED = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, "
    "found array<struct<kind:string,`start`:long,`end`:long,value:long,strong:boolean>>"
)


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, the base counts and digest, and every span with its value's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("strong", pa.bool_())]
        )
        for batch in batches:
            counts, digests, found = {k: [] for k in KINDS[:3]}, [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for k in counts:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append(
                    [
                        {
                            "kind": kind,
                            "start": a,
                            "end": b,
                            "value": xxhash.xxh64_intdigest(value) - (1 << 63),
                            "strong": random_looking(value),
                        }
                        for kind, a, b, value in base + other_tokens(text, base)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    *[pa.array(c, pa.int64()) for c in counts.values()],
                    pa.array(digests),
                    pa.array(found, pa.list_(struct)),
                ],
                [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    rows = docs.select(*keep, text_of("text").alias("text"))
    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{fields}, {SCANNED}")


def ownership(spans: DataFrame) -> DataFrame:
    """``value, repositories, owners`` of ``spans (value, repository, owner)``.

    Two groupings, the first by value and owner, so that no task gets all rows of a value.
    """
    held = spans.groupBy("value", "owner", "repository").agg(F.lit(1).alias("_one"))
    return (
        held.groupBy("value", "owner")
        .agg(F.count("*").alias("_held"))
        .groupBy("value")
        .agg(F.sum("_held").alias("repositories"), F.count("*").alias("owners"))
    )


def find(
    docs: DataFrame, few: int = FEW_OWNERS, owner: str = "source", few_repositories: int = FEW_REPOSITORIES
) -> DataFrame:
    """Spans of each row of ``docs (doc_id, text, owner)``.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_live, n_shared, n_copied``: how
    many spans have a random-looking value of few owners and repositories, a value of many owners,
    and a value that few owners hold in many repositories.  A text of an owner is a repository,
    so copies of one document are one.  A null text is empty, a null owner is one owner of its
    own, rows that repeat an id and a text get equal results.  Other columns are ignored.
    """
    keyed = docs.select(
        "doc_id",
        "text",
        F.xxhash64("text").alias("_text"),
        F.coalesce(F.concat(F.lit("s"), F.col(owner).cast("string")), F.lit("n")).alias("_owner"),
    )
    scanned = cut(scan(keyed, ["doc_id", "_text", "_owner"]), "secrets-scanned")
    spans = scanned.select("doc_id", "_text", "_owner", F.inline("found"))
    known = ownership(spans.select("value", F.col("_text").alias("repository"), F.col("_owner").alias("owner")))
    copied = (F.col("owners") <= few) & (F.col("repositories") > few_repositories * F.col("owners"))
    live = F.col("strong") & (F.col("owners") <= few) & ~copied
    judged = (
        spans.distinct()
        .join(known, "value")
        .withColumns({"live": live, "copied": copied})
        .groupBy("doc_id", "_text", "_owner")
        .agg(
            F.collect_list(
                F.when(
                    F.col("live") | (F.col("kind") != "token"),
                    F.struct("start", _rank(F.col("kind")).alias("rank"), "end", "kind"),
                )
            ).alias("_spans"),
            F.sum(F.col("live").cast("long")).alias("n_live"),
            F.sum((F.col("owners") > few).cast("long")).alias("n_shared"),
            F.sum(F.col("copied").cast("long")).alias("n_copied"),
        )
        .withColumnsRenamed({"doc_id": "_id", "_text": "_of", "_owner": "_by"})
    )
    same = (
        scanned["doc_id"].eqNullSafe(judged["_id"])
        & (scanned["_text"] == judged["_of"])
        & (scanned["_owner"] == judged["_by"])
    )
    as_text = F.transform(
        F.sort_array("_spans"),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return scanned.join(judged, same, "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(as_text, ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
