"""Language identification with error-correcting output codes over hashed byte n-grams.

Training counts n-grams per language over every labelled training row (a distributed sum of fixed-size
vectors). Each column of the code matrix is a binary problem: a linear n-gram classifier separates the
languages whose codeword has the bit set from the others. A bounded sample of the training rows scales
the margins and weighs each bit by how well it separates. A text gets the language whose codeword has
the least weighted logistic loss; the gap to the runner-up becomes the score, and a small one is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, load, small_batches, text_or_empty, whole_row

N_FEATURES = 1 << 14
ORDERS = (1, 2, 3)
#: Labelled rows per language, at most, that calibrate margins and weigh bits.
CALIBRATION_ROWS = 500
#: Below this score a prediction counts as ambiguous.
AMBIGUOUS = 0.05
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# every code point is folded to lower case before hashing; digits and marks become one blank
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def counts_of(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text."""
    octets = _FOLD[np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)].astype(np.int64)
    total = np.zeros(N_FEATURES, np.int64)
    for order in ORDERS:
        code = np.full(max(0, len(octets) - order + 1), order, np.int64)
        for k in range(order):
            code = code * 257 + octets[k : len(octets) - order + 1 + k]
        slots = ((code * 0x9E3779B1) >> 7) & (N_FEATURES - 1)
        # runs of blanks say nothing about a language
        blank = octets[: len(slots)] != 32 if order == 1 else (octets[: len(slots)] != 32) | (octets[1 : len(slots) + 1] != 32)
        total += np.bincount(slots[blank], minlength=N_FEATURES)
    return total


def code_matrix(n: int) -> np.ndarray:
    """Codewords of ±1 for ``n`` classes: the exhaustive code up to 6, else rows of a Hadamard matrix."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = [[1.0] + [1.0 if (c >> k) & 1 else -1.0 for k in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(bits).T
    h = np.ones((1, 1))
    while h.shape[0] < 2 * n:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]


class Model:
    """``langs``, code (languages × bits), weights (features × bits), per-bit scale, shift and weight."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, code_matrix(len(langs))
        logs = np.zeros((N_FEATURES, self.code.shape[1]), np.float64)
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * N_FEATURES) if len(langs) else counts
        for b in range(self.code.shape[1]):
            on, off = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if len(on) and len(off):
                logs[:, b] = np.log(on.mean(0)) - np.log(off.mean(0))
        self.weights = logs.astype(np.float32)
        self.scale = np.ones(self.code.shape[1])
        self.shift = np.zeros(self.code.shape[1])
        self.weight = np.full(self.code.shape[1], 1 / max(1, self.code.shape[1]))

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean log odds per n-gram, one per bit."""
        return counts @ self.weights / max(1, counts.sum())

    def calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Centre and scale each bit on labelled margins; weigh it by its accuracy above chance."""
        if not len(labels):
            return
        for b in range(self.code.shape[1]):
            y = self.code[labels, b]
            on, off = margins[y > 0, b], margins[y < 0, b]
            if len(on) and len(off):
                self.shift[b] = (on.mean() + off.mean()) / 2
                self.scale[b] = 4 / max(1e-6, on.mean() - off.mean())
                z = (margins[:, b] - self.shift[b]) * y
                self.weight[b] = max(0.01, 2 * (z > 0).mean() - 1)
        self.weight /= self.weight.sum()

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return UNDETERMINED, 0.0
        z = np.clip((self.margins(counts) - self.shift) * self.scale, -20, 20)
        loss = np.log1p(np.exp(-self.code * z)) @ self.weight
        order = np.argsort(loss, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        return self.langs[order[0]], float(np.tanh((loss[order[1]] - loss[order[0]]) * 2))


def _count_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per language within the task: at most languages × features rows leave it."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            counts, lang = counts_of(text.as_py()), lang.as_py()
            if lang in sums:
                sums[lang] += counts
            else:
                sums[lang] = counts
    for lang, total in sums.items():
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(total[slots], pa.int64())], ["lang", "slot", "n"])


def fit(rows: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """A model from ``(lang, text)``; every row counts, a bounded sample per language calibrates.

    What reaches the driver is languages × features sums and languages × bits margins of the sample.
    """
    small_batches(rows.sparkSession)
    per_lang = rows.mapInArrow(lean(_count_udf), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = per_lang.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    counts = np.zeros((len(packed), N_FEATURES))
    for i, row in enumerate(packed):
        counts[i, row.slots] = row.ns
    model = Model([row.lang for row in packed], counts)
    share = dict(rows.groupBy("lang").count().collect())
    if not share:
        return model
    # about the wanted share of each language by hash, then the smallest hashes of those: the same rows in any layout
    spread = F.lit(1 << 20)
    keep = F.lit(False)
    for lang, n in share.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("text"), spread) * F.lit(n) <= F.lit(2 * calibration_rows) * spread))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("text"), spread), F.xxhash64("text")))
    some = rows.filter(keep).withColumn("nth", nth).filter(F.col("nth") <= calibration_rows).select("lang", "text")
    index = {lang: i for i, lang in enumerate(model.langs)}

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.margins(counts_of(t.as_py())).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["lang", "margins"])

    sample = sorted(some.mapInArrow(margins, "lang string, margins array<double>").collect(), key=lambda r: (r.lang, r.margins))
    model.calibrate(np.array([r.margins for r in sample]), np.array([index[r.lang] for r in sample], int))
    return model


def _guesser(spark: SparkSession, model: Model):
    """A column function from text to (language, score)."""
    model_of = spark.sparkContext.broadcast(model)

    def guess(texts: pa.Array) -> pa.Array:
        model = model_of.value
        out = [model.predict(counts_of(t)) if has_letter(t) else (UNDETERMINED, 0.0) for t in map(str, texts)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["lang", "score"])

    guess.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(guess, "struct<lang:string,score:double>")


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with a language and a score in 0..1 added.

    Null texts and texts without a letter get ``und`` and score 0, and so does every text if the
    model saw no language. Ties go to the language that sorts first. Other columns pass through; a
    column of the name of an added one is replaced by it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(whole_row(docs).alias("row"), text_or_empty(text_col).alias("t")).select("row", _guesser(docs.sparkSession, model)("t").alias("guess"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in (pred_col, score_col)]
    return rows.select(*kept, F.col("guess.lang").alias(pred_col), F.col("guess.score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit_on_training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on the rows outside the held-out quarter that have a language and a text."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return fit(rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose language can be told, with ``lang_col`` set to it; the columns stay.

    Null texts and texts without a letter go. If no row is labelled there is nothing to learn: texts with
    letters stay as they are.
    """
    model = fit_on_training_rows(docs, id_col, text_col, lang_col)
    if not model.langs:
        return docs.filter(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    rows = docs.select(whole_row(docs).alias("row"), text_or_empty(text_col).alias("t")).select("row", _guesser(docs.sparkSession, model)("t").alias("guess"))
    return rows.filter(F.col("guess.lang") != UNDETERMINED).select(*[F.col("guess.lang").alias(c) if c == lang_col else F.col(f"row.`{c}`") for c in docs.columns])


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit_on_training_rows(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", (F.col("score") < AMBIGUOUS).alias("ambiguous"))


QUERIES = {"op8_langid": op8_langid}
ORACLE_SQL: dict[str, str] = {}
