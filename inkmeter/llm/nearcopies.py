"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

Prefix filtering: with all shingles in one global order, two sets of n and m at similarity 0.8 share one of
their first n // 5 + 1 and m // 5 + 1. Texts meet at those, and only pairs whose sizes and places still allow
the similarity are compared over their whole sets. Any order is exact; shingles that a sample finds common
come last, so that a widely copied line brings few texts together.

Before whole sets travel, parities decide most pairs: shingles fall into 2^k buckets by hash, and sets whose
buckets differ in parity at d places differ by d shingles at least. Of the pairs that are left, one a text is
compared first, then those that this has not linked. Where more than ``DIRECT`` texts meet, a few rounds link
each to one centre; groups that are still apart are compared in blocks, by parities, in the tasks that hold them.
Those tasks pass on a forest of what parities allow, never all pairs; what it connects meets once, with whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_staged, lean, small_batches, stage, text_or_empty
from .graph import components, forest
from .simhash import SEED, bit_majority

SHINGLE = 5
#: Texts from which common shingles are drawn (they set the order alone, never the result).
SAMPLE_ROWS = 2_000
#: Groups up to this size send their pairs, larger ones go through the rounds.
DIRECT = 8
#: Rounds of links to one centre a group before the pairs that are still apart.
ROUNDS = 2
#: Rows of a group that meet as one block.
BLOCK = 2_048
#: Shingles of texts that meet as one block, with their whole sets.
SET_BLOCK = 1 << 19
#: Buckets of parities, at least.
LEAST_BITS = 1_024
#: Sides up to this size are broadcast within the rounds.
FEW_ROWS, FEW_BYTES = 20_000, 1 << 20
_ROWS = 1 << 17
#: Links that a task holds before it passes them on.
_LINKS = 1 << 20


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all word shingles, repeats included; fewer words are one shingle, no words none."""
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(t), SEED) for t in zip(*(words[k:] for k in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1)


def parities(grams: np.ndarray) -> bytes:
    """A bit for each of 2^k buckets (no fewer than shingles): whether the distinct shingles in it are odd in number."""
    size = max(LEAST_BITS, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """Parities of ``size`` bytes: buckets that fall together add up."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_be_alike(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sets of n and m shingles with these parities can have similarity 0.8: they then differ by (n + m) / 9 at most."""
    size = min(len(x), len(y))
    return 9 * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= n + m


def _sets(docs: DataFrame, key: str, shingle: int) -> DataFrame:
    """``(key, grams)`` of rows of (key, UTF-8 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(shingles(t.as_py().lower().split(), shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["key", "grams"])

    return docs.select(key, "t").mapInArrow(lean(run), "key long, grams array<long>")


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Shingles of three or more distinct texts of a sample, sorted."""
    rows = docs.count()
    some = docs.sample(min(1.0, SAMPLE_ROWS / max(1, rows)), 5).select(text_or_empty(text_col).alias("t")).distinct()
    grams = _sets(some.select(F.xxhash64("t").alias("own"), F.encode("t", "UTF-8").alias("t")), "own", shingle)
    often = grams.select(F.explode("grams").alias("h")).groupBy("h").count().filter("count >= 3").select("h")
    return np.sort(np.array([r.h for r in often.collect()], np.int64).view(np.uint64))


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, own, key, fp, n, prefix, bits)`` of every row.

    ``own`` tells texts apart and ``key`` their words; ``fp`` is the fingerprint, ``n`` the number of distinct
    shingles, ``prefix`` the first of them and ``bits`` their parities.
    """
    small_batches(docs.sparkSession)
    common = common_shingles(docs, text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps, sizes, prefixes, bits = [], [], [], [], []
            for t in batch.column(2):
                words = t.as_py().lower().split()
                hashes = shingles(words, shingle)
                grams = np.unique(hashes)
                bits.append(parities(grams))
                if len(common) and len(grams):
                    at = np.searchsorted(common, grams)
                    grams = grams[np.argsort(common[np.minimum(at, len(common) - 1)] == grams, kind="stable")]
                keys.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                fps.append(bit_majority(hashes) if len(hashes) else 0)
                sizes.append(len(grams))
                prefixes.append(grams[: len(grams) // 5 + 1].view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), signed(keys), signed(fps), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(bits, pa.binary())],
                ["doc_id", "own", "key", "fp", "n", "prefix", "bits"])

    text = text_or_empty(text_col)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), F.encode(text, "UTF-8").alias("t"))
    return picked.mapInArrow(lean(run), "doc_id long, own long, key long, fp long, n long, prefix array<long>, bits binary")


def _close(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and places of rows i and j still allow similarity 0.8 (n ascends from i to j)."""
    return 9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])


def _offsets(start: np.ndarray, size: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and j = i + 1, i + 2, ... of the same group (sorted by n) for as long as sizes allow similarity 0.8."""
    left = np.repeat(start + size, size) - np.arange(len(n))
    at, k = np.flatnonzero(left > 1), 1
    while len(at):
        at = at[5 * n[at] >= 4 * n[at + k]]
        yield at, at + k
        k += 1
        at = at[left[at] > k]


def _pairs(h: np.ndarray, n: np.ndarray, key: np.ndarray, pos: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different labels in groups of equal ``h`` up to ``DIRECT`` (sorted by h and n), and the mask of the rows of larger groups."""
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)])
    large = np.repeat(size, size) > DIRECT
    own, some = np.flatnonzero(~large), size[size <= DIRECT]
    n_, key_, pos_, label_ = n[own], key[own], pos[own], label[own]
    a, b = [key[:0]], [key[:0]]
    for i, j in _offsets(np.cumsum(some) - some, some, n_):
        hit = (label_[i] != label_[j]) & _close(n_, pos_, i, j)
        a.append(key_[i[hit]])
        b.append(key_[j[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return both[0], both[1], large


def _in_groups(batches: Iterator[pa.RecordBatch], keys: int, out, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """``out(table)`` of rows that are sorted by their first ``keys`` columns, about ``rows`` in whole groups at a time.

    A group that fills a chunk is cut, and ``most`` of its rows at least come with the last part.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(n, bool)  # the last group may go on
            for k in range(keys):
                own = table.column(k).to_numpy()
                same &= own == own[-1]
            cut = int(n - same.sum()) or max(0, n - most)
            held, n = table.slice(cut).to_batches(), n - cut
            if cut:
                yield from out(table.slice(0, cut))
    if n:
        yield from out(pa.Table.from_batches(held).combine_chunks())


def meetings(texts: DataFrame) -> DataFrame:
    """``(h, a, n, pos, b)``: pairs of keys (b set, h null), and the members of the groups that are too large for that (b null).

    ``texts`` has ``key, n, prefix, label``; texts of one label are linked already.
    """

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, n, key, pos, label = (table.column(k).to_numpy() for k in range(5))
        a, b, large = _pairs(h, n, key, pos, label)
        cols = [(None, h[large]), (a, key[large]), (None, n[large]), (None, pos[large]), (b, None)]
        nulls = (pa.nulls(len(a), pa.int64()), pa.nulls(int(large.sum()), pa.int64()))
        whole = [pa.concat_arrays([nulls[k] if x is None else pa.array(x, pa.int64()) for k, x in enumerate(c)]) for c in cols]
        yield pa.RecordBatch.from_arrays(whole, ["h", "a", "n", "pos", "b"])

    grams = texts.select("key", "n", "label", F.posexplode("prefix").alias("pos", "h")).select("h", "n", "key", F.col("pos").cast("long"), "label")
    dealt = grams.repartition("h").sortWithinPartitions("h", "n", "key")
    return dealt.mapInArrow(lean(lambda batches: _in_groups(batches, 1, out, _ROWS, DIRECT + 1)), "h long, a long, n long, pos long, b long")


def _in_blocks(rows: DataFrame, group: str, amount: Column, most: int) -> DataFrame:
    """``rows`` dealt and sorted by (group, x, y), so that every two blocks of a group meet in a task of their own.

    ``amount`` over a group sets its number of blocks, of about ``most`` each; ``own`` is the block of a row.
    """
    sizes = broadcast_if_small(stage(rows.groupBy(group).agg(F.ceil(amount / most).cast("int").alias("blocks")), "group-sizes"))  # one row a group
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    met = rows.join(sizes, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *rows.columns, "own")
    return met.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "n", "key")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """First rows of the groups of equal keys, and the number of rows."""
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.r_[np.flatnonzero(np.r_[True, new]), len(keys[0])]


def _block_pairs(rows: DataFrame) -> DataFrame:
    """``(a, b)`` that connect what pairs of different labels connect which sizes, places and parities allow.

    ``rows`` has ``h, key, n, pos, label, bits``. A group of more than ``BLOCK`` rows is dealt to blocks, so no task
    holds a whole group. A pair meets at every shingle that both begin with, and copies in a group make pairs with
    its square; a task passes on a forest, with fewer links than it has texts.
    """

    def out(table: pa.Table) -> Iterator[np.ndarray]:
        h, x, y, n, key, pos, label, own = (table.column(k).to_numpy() for k in range(8))
        full = table.column(8).to_pylist()
        few = np.stack([folded(v, LEAST_BITS // 8) for v in full])
        wide = np.array([len(v) for v in full]) > LEAST_BITS // 8
        nodes, at = np.unique(key, return_inverse=True)
        root, found = np.arange(len(nodes)), [np.empty((2, 0), np.int64)]
        start = _starts(h, x, y)
        for i, j in _offsets(start[:-1], np.diff(start), n):
            hit = (label[i] != label[j]) & (root[at[i]] != root[at[j]]) & _close(n, pos, i, j) & ((x[i] == y[i]) | (own[i] != own[j]))
            i, j = i[hit], j[hit]
            hit = 9 * np.bitwise_count(few[i] ^ few[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
            i, j = i[hit], j[hit]
            hit = ~(wide[i] & wide[j])  # the others have no more parities to compare
            for k in np.flatnonzero(~hit).tolist():
                hit[k] = may_be_alike(int(n[i[k]]), full[i[k]], int(n[j[k]]), full[j[k]])
            tops, members = forest(root[at[i[hit]]], root[at[j[hit]]])
            if len(members):
                found.append(np.stack([nodes[tops], nodes[members]]))
                step = np.arange(len(nodes))
                step[members] = tops
                root = step[root]
        yield np.concatenate(found, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.empty((2, 0), np.int64)
        for found in _in_groups(batches, 3, out, 4 * BLOCK, 1 << 30):
            links = np.stack(forest(*np.concatenate([links, found], axis=1)))
            if links.shape[1] > _LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in links], ["a", "b"])
                links = links[:, :0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in links], ["a", "b"])

    dealt = _in_blocks(rows, "h", F.count("*"), BLOCK).select("h", "x", "y", "n", "key", "pos", "label", "own", "bits")
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _alike_labels(label: np.ndarray, own: np.ndarray | None, sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Links of labels that connect what pairs of ``sets`` (none empty, sizes ascend) at similarity 0.8 connect; with ``own``, pairs of two blocks."""
    n = sets.value_lengths().to_numpy().astype(np.int64)
    distinct, gram = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    end = np.cumsum(n)
    grams = [gram[e - k : e] for e, k in zip(end.tolist(), n.tolist(), strict=True)]
    names, root = np.unique(label, return_inverse=True)
    last = np.searchsorted(4 * n, 5 * n, "right")  # sizes beyond rule the similarity out
    held, a, b = np.zeros(len(distinct), bool), [], []
    for i in range(len(n)):
        j = np.arange(i + 1, last[i])
        j = j[root[j] != root[i]]
        if own is not None:
            j = j[own[j] != own[i]]
        if not len(j):
            continue
        held[grams[i]] = True
        both = np.add.reduceat(held[np.concatenate([grams[k] for k in j.tolist()])], np.cumsum(n[j]) - n[j], dtype=np.int64)
        held[grams[i]] = False
        for other in np.unique(root[j[9 * both >= 4 * (n[i] + n[j])]]):
            a.append(root[i])
            b.append(other)
            root[root == other] = root[i]
    return names[np.array(a, np.int64)], names[np.array(b, np.int64)]


def _cluster_links(rows: DataFrame) -> DataFrame:
    """``(a, b)``, links of labels that connect what pairs at similarity 0.8 within a cluster connect, from ``(cluster, key, label, n, grams)``.

    A cluster of more than ``SET_BLOCK`` shingles is dealt to blocks.
    """

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cluster, x, y, label, own = (table.column(k).to_numpy() for k in range(5))
        sets, start = table.column(5).chunk(0), _starts(cluster, x, y).tolist()
        for s, e in zip(start, start[1:], strict=False):
            a, b = _alike_labels(label[s:e], own[s:e] if x[s] != y[s] else None, sets.slice(s, e - s))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = _in_blocks(rows, "cluster", F.sum("n"), SET_BLOCK).select("cluster", "x", "y", "label", "own", "grams")
    return dealt.mapInArrow(lean(lambda batches: _in_groups(batches, 3, out, 1, 1 << 30)), "a long, b long")


def _few(side: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Broadcast only what is very small: a broadcast stays in every executor's memory until the driver collects it, and there are many rounds."""
    return broadcast_if_small(side, staged, rows=FEW_ROWS, size=FEW_BYTES)


def _allowed(x: str, y: str) -> Column:
    """Whether sizes and places still allow similarity 0.8."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (9 * F.least(a - F.col(f"{x}.pos"), b - F.col(f"{y}.pos")) >= 4 * (a + b))


def _by_parities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that parities allow, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            keep = [may_be_alike(i, x.as_py(), j, y.as_py()) for i, j, x, y in zip(n.tolist(), m.tolist(), batch.column(4), batch.column(5), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: texts.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return stage(met.mapInArrow(lean(run), "a long, b long"), "pairs")


def join_labels(docs: DataFrame, texts: DataFrame, labels: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``(key, label)`` with the labels of all texts joined that similarity 0.8 connects.

    ``texts`` has one row a key with the ``doc_id`` and ``own`` of a row that holds it, ``n``, ``prefix``, ``bits`` and a
    first ``label``, which ``labels`` has as well; both are staged.
    """
    met = stage(meetings(texts.filter("n > 0").select("key", "n", "prefix", "label")), "meetings")
    slim = texts.select("key", "n", "bits")
    small, large = met.filter("b is not null").select("a", "b").distinct(), met.filter("b is null").select("h", F.col("a").alias("key"), "n", "pos")
    text = text_or_empty(text_col)
    bodies = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def sets_of(keys: DataFrame) -> DataFrame:
        """Whole sets of the texts that pairs are left of: the documents are scanned once, and only those texts go on."""
        rep = broadcast_if_small(stage(texts.select("key", "own", "doc_id").join(keys, "key"), "candidates")).alias("w")
        met = bodies.alias("d").join(rep, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).filter(F.xxhash64("d.text") == F.col("w.own"))
        return stage(_sets(met.select("key", F.encode("d.text", "UTF-8").alias("t")).dropDuplicates(["key"]), "key", shingle), "candidate-sets")

    def merged(links: DataFrame, labels: DataFrame) -> DataFrame:
        roots = stage(components(links), "label-roots")
        return stage(labels.join(_few(roots), labels.label == roots.node, "left").select("key", F.coalesce("root", "label").alias("label")), "labels")

    def linked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return labels
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        of = lambda c: _few(sets.select(F.col("key").alias(c), F.col("grams").alias(f"g{c}")), sets)
        met = pairs.join(of("a"), "a").join(of("b"), "b").filter("9L * size(array_intersect(ga, gb)) >= 4L * (size(ga) + size(gb))")
        labels = merged(met.select(F.col("la").alias("a"), F.col("lb").alias("b")), labels)
        drop_staged(sets)
        return labels

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        side = _few(labels)
        for c in ("a", "b"):
            pairs = pairs.join(side.select(F.col("key").alias(c), F.col("label").alias(f"l{c}")), c)
        return stage(pairs.filter("la <> lb").select("a", "b", "la", "lb"), "apart")

    def joined(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """One pair a text first: in a group of copies it leaves little for the rest."""
        pairs = apart(pairs, labels)
        first = pairs.groupBy("b").agg(F.min(F.struct("a", "la", "lb")).alias("p")).select("p.a", "b", "p.la", "p.lb")
        labels = linked(stage(first, "first-pairs"), labels)
        return linked(apart(pairs.select("a", "b"), labels), labels)

    labels = joined(_by_parities(small, slim), labels)
    if large.isEmpty():
        return labels
    for nth in range(ROUNDS):
        # one centre a group, the same in all groups that hold it
        rows = large.join(_few(labels), "key")
        centre = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("key", F.lit(nth)).alias("o"), "key", "n", "pos", "label")).alias("c")).select("h", "c.*")
        centre = stage(centre, "group-centres")
        pairs = rows.alias("x").join(broadcast_if_small(centre).alias("y"), "h").filter((F.col("x.label") != F.col("y.label")) & _allowed("x", "y"))
        pairs = pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
        labels = linked(apart(_by_parities(pairs, slim), labels), labels)
    rows = large.join(_few(labels), "key")
    still = rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    rows = stage(rows.join(still, "h", "left_semi"), "still-apart")
    if rows.isEmpty():
        return labels
    roots = stage(components(_block_pairs(rows.join(texts.select("key", "bits"), "key").select("h", "key", "n", "pos", "label", "bits"))), "cluster-roots")
    if roots.isEmpty():
        return labels
    heads = roots.select(F.col("root").alias("key"), F.col("root").alias("cluster")).distinct()
    members = stage(roots.select(F.col("node").alias("key"), F.col("root").alias("cluster")).unionByName(heads), "clusters")
    sets = sets_of(members.select("key"))
    rows = sets.join(_few(members), "key").join(_few(labels), "key").select("cluster", "key", "label", F.size("grams").alias("n"), "grams")
    labels = merged(_cluster_links(rows), labels)
    drop_staged(sets)
    return labels


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int | None = None) -> DataFrame:
    """``(doc_id, own, label, component_id)``, one row per input row, staged; ``label`` tells components apart.

    Fingerprints of the shingles within ``most`` bits link as in ``simhash.near_duplicates``, and so do texts
    of similarity 0.8 or more, all transitively; ``component_id`` is the smallest id reachable.
    """
    from .simhash import MOST_BITS, links

    rows = stage(described(docs, id_col, text_col, shingle), "shingles")
    roots = stage(components(links(rows.select("fp").distinct(), MOST_BITS if most is None else most)), "fingerprint-roots")
    first = rows.groupBy("key").agg(F.min("fp").alias("fp"))  # words decide the fingerprint
    labels = stage(first.join(_few(roots), first.fp == roots.node, "left").select("key", F.coalesce("root", "fp").alias("label")), "labels")
    texts = stage(rows.dropDuplicates(["key"]).select("key", "own", "doc_id", "n", "prefix", "bits").join(labels, "key"), "distinct-texts")
    labels = join_labels(docs, texts, labels, id_col, text_col, shingle)
    known = stage(rows.select("doc_id", "own", "key").join(_few(labels), "key"), "labelled")
    lowest = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return stage(known.join(lowest, "label").select("doc_id", "own", "label", "component_id"), "near-copies")
