"""Secret scanning with corpus-wide ownership frequency.

One pass over the texts finds the base spans (assignments, access keys, long hex) and further
credential-shaped tokens that no keyword announces. Candidate values are then counted over the whole
corpus by distinct owners (``source``) and distinct repositories (texts; whole copies are one, as forks
are): a value that many owners share, or very many repositories of few owners, is a copied example; one that
is specific to its owners is live. Bare tokens count as secrets only if they are live and look random, so the
base spans always stay and the method only adds.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, lean, load, small_batches, stage, whole_row

KINDS = ("assign", "access", "hex", "token", "jwt", "pem", "bare")
#: A value seen at more owners than this is a widely copied example.
MAX_OWNERS = 3
#: So is one in more repositories than this, whoever owns them.
MAX_REPOSITORIES = 100
#: Bits per character from which a bare token looks random.
MIN_ENTROPY = 3.5
MASK = "[SECRET]"

_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so the length bound can stand in the pattern
_MORE = (
    ("token", re.compile(r"(?a)\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})")),
    ("jwt", re.compile(r"(?a)(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}")),
    # to the END line, else over the base64 lines that follow (line ends may be written as \n), else the header alone
    ("pem", re.compile(
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?P<whole>(?s:(?!-----(?:BEGIN|END) ).)*)-----END [A-Z ]{0,40}PRIVATE KEY-----"
        r"|(?P<cut>(?:(?:\s|\\r|\\n)+(?:(?:Proc-Type|DEK-Info):[^\n]{0,200}|[A-Za-z0-9+/]{24,}={0,2}))+(?:(?:[ \t\r]*\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]+={0,2}(?=[ \t\r]*(?:[\n\\\"']|\Z)))?)|)")),
    ("bare", re.compile(r"(?a)[A-Za-z0-9+/_]{24,}={0,2}")),
)
_PEM = dict(_MORE)["pem"]
_DIGIT_AND_LETTER = re.compile(r"(?a)(?=.*[0-9])(?=.*[A-Za-z])")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind index, end, start of the secret value) of the base rules."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def _union(spans: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans cover, ascending."""
    starts, ends = [], []
    for a, _, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def more_spans(text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Candidates of the further kinds that overlap no base span; private keys also where they do."""
    found: list[tuple[int, int, int, int]] = []
    for k, (kind, pattern) in enumerate(_MORE, 3):
        # a key stays whole where a base span or token touches it; spans of one kind never overlap
        starts, ends = _union(found if kind == "pem" else taken + found)
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "bare" and (not _DIGIT_AND_LETTER.match(m[0]) or entropy(m[0]) < MIN_ENTROPY):
                continue
            at = bisect_left(starts, b) - 1  # the last stretch that starts before this one ends
            if at < 0 or ends[at] <= a:
                found.append((a, k, b, a))
    return found


def secret_value(text: str, span: tuple[int, int, int, int]) -> str:
    """What ownership counts: of a private key the body without white space, else the span from its value on."""
    _, kind, end, at = span
    if KINDS[kind] == "pem":
        m = _PEM.match(text, at)
        return re.sub(r"\s|\\[rn]", "", m["whole"] or m["cut"] or "") or text[at:end]
    return text[at:end]


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
_SCAN = pa.schema([
    ("doc_id", pa.int64()), ("key", pa.int64()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
    ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()), ("spans", pa.list_(_SPAN)),
])
_SCAN_DDL = (
    "doc_id long, key long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base string,"
    " spans array<struct<kind:int,start:int,end:int,value:string>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, key, owner, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            text = text.as_py()
            base = base_spans(text)
            listing, kinds = joined(base), Counter(s[1] for s in base)
            rows.append({
                "doc_id": doc_id.as_py(), "key": key.as_py(), "owner": owner.as_py(),
                "n_assign": kinds[0], "n_access": kinds[1], "n_hex": kinds[2], "base": listing,
                "base_sha256": hashlib.sha256(listing.encode()).hexdigest(),
                "spans": [
                    {"kind": k, "start": a, "end": b, "value": hashlib.sha256(secret_value(text, s).encode()).hexdigest()}
                    for s in sorted(base + more_spans(text, base)) for a, k, b, _ in [s]
                ],
            })
        yield pa.RecordBatch.from_pylist(rows, _SCAN)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Base spans and candidates of every row, staged; ``key`` tells rows of one id but other text apart."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    return stage(picked.mapInArrow(lean(_scan), _SCAN_DDL), "secret-scan")


def ownership(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per candidate value: distinct owners and repositories over the corpus, and whether it looks live.

    A repository is a distinct text, so that copies of a document count once. Distinct (value, owner) and (value,
    repository) pairs are formed before counting, so a value that fills a third of the corpus is combined
    map-side and never gathers in one task.
    """
    seen = scanned.select("owner", "key", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), "owner", "key")
    owners = seen.select("value", F.coalesce("owner", F.lit("")).alias("owner")).distinct().groupBy("value").agg(F.count("*").alias("owners"))
    repos = seen.select("value", "key").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    return owners.join(repos, "value").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """All spans of every row with their ownership verdicts.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, key, found``, one row
    per input row. Null or empty text: no spans, the digest of the empty string. A null owner counts as
    one owner of its own. Repeated rows are reported each and count once. Extra columns are ignored.
    """
    scanned = scan(docs, id_col, text_col, owner_col)
    verdicts = ownership(scanned, max_owners, max_repositories)
    # only rows that hold a candidate meet the verdicts; one row per (id, text)
    held = (
        scanned.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "key"])
        .select("doc_id", "key", F.explode("spans").alias("s"))
        .join(verdicts, F.col("s.value") == F.col("value"))
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind", "s.end", "live", "owners", "repositories"))).alias("found"))
    )
    held = broadcast_if_small(stage(held, "secret-verdicts"))
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter(F.col("h.found"), lambda s: (s["kind"] < 3) | s["live"])
    listing = F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    s = scanned.alias("s")
    return s.join(held.alias("h"), F.col("s.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("s.key") == F.col("h.key")), "left").select(
        "s.doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", F.coalesce(listing, F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter(kept, lambda x: x["live"])), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter(kept, lambda x: ~x["live"])), F.lit(0)).cast("long").alias("n_example"),
        "s.key", kept.alias("found"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``[SECRET]``; all rows and columns stay.

    Widely copied examples are left as they are. Null text stays null.
    """
    hits = find_secrets(docs, id_col, text_col, owner_col, max_owners, max_repositories).select("doc_id", "key", F.filter("found", lambda x: x["live"]).alias("cuts"))
    hits = stage(hits.filter(F.size("cuts") > 0).dropDuplicates(["doc_id", "key"]), "secret-hits")
    text = F.col("t")
    # rebuilt left to right; overlapping spans merge because a cut never moves back
    cut = F.aggregate(
        F.col("h.cuts"), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK)).alias("out"), x["end"].alias("at")))
        .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    own = F.col(text_col).cast("string")
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"), own.alias("t"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("own"))
    met = rows.join(broadcast_if_small(hits).alias("h"), F.col("id").eqNullSafe(F.col("h.doc_id")) & (F.col("own") == F.col("h.key")), "left")
    return met.select(*[F.coalesce(cut, text).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(load(spark, sf_dir, "documents")).drop("key", "found")


QUERIES = {"op9_secrets": op9_secrets}
ORACLE_SQL: dict[str, str] = {}
