"""Order-preserving sequence packing by dynamic programming over cut positions.

Documents are tokenised in scan order; the stream of a block of documents is cut into sequences of at
most 2048 ids. A cut may lie at the end of a document (free), at the end of a sentence (small penalty) or,
where neither is in reach, at any multiple of a short stride (large penalty). The programme minimises
padding plus penalties: ``cost(i) = penalty(i) + min over j in [i - 2048, i) of cost(j) + pad(i - j)``.
``pad`` is linear but for power-of-two lengths, which need none, so the minimum over the window comes from
a monotone queue of ``cost(j) + j`` and the few power-of-two predecessors are looked up one by one.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, load, small_batches, text_or_empty

MOST = 2_048
END = 1
SENTENCE_PENALTY = 8
FREE_PENALTY = 100
#: A sentence longer than this may also be cut inside, at multiples of it.
STRIDE = 256
#: Ids after which a block is closed; each block is packed by itself.
BLOCK_IDS = 1 << 18
#: Characters whose words are looked up together.
CHUNK_CHARS = 1 << 19
#: Words that share one call's encoding, which costs more than its words.
WORDS_PER_LINE = 64
#: Words whose ids a worker remembers, at most, in each of two generations.
CACHE_WORDS = 600_000


class Words:
    """Ids of a text by a word-BPE vocabulary file of ``tokenizers``, remembered word by word.

    Texts of Latin letters are cut at white space, and each new word is handed to the tokenizer once;
    that is the same as encoding the whole text, because its pieces never cross white space. Texts with
    other letters, unusual spaces or the names of special tokens are encoded whole.
    """

    # white space that both sides see alike, and Latin letters whose lower case needs no context
    _PLAIN = re.compile("[\t\n\v\f\r -~¡-ɏ‐-‧″-›]*")

    _SIGNS = ".,!?;:&$#%*"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # switched off for words that are in normal form already; one tokenizer a worker is enough
        self.normalizer, self.no_normalizer = self.tokenizer.normalizer, normalizers.Sequence([])
        self.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.at_spaces = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = CACHE_WORDS
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.is_stop = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_stop[[i for x in (".", "!", "?", "...", "\".", ".\"") for i in self.tokenizer.encode(x, add_special_tokens=False).ids]] = True

    def _encode(self, texts: list[str], normal: bool = False) -> list[bytes]:
        self.tokenizer.normalizer = self.no_normalizer if normal else self.normalizer
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> Iterator[bytes]:
        """The same for words of nothing but letters: each is one piece, whose last id alone ends a word, so many share one encoding."""
        lines = [" ".join(words[at : at + WORDS_PER_LINE]) for at in range(0, len(words), WORDS_PER_LINE)]
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.no_normalizer, self.at_spaces
        encoded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        self.tokenizer.pre_tokenizer = self.pre_tokenizer
        for line in encoded:
            ids = array("I", line.ids).tobytes()
            start = 0
            for end in ((np.flatnonzero(self.ends_word[np.frombuffer(ids, np.uint32)]) + 1) * 4).tolist():
                yield ids[start:end]
                start = end

    def _learn(self, words: set[str]) -> None:
        """Takes words over from the older generation, or has them encoded; letters and the signs behind them apart."""
        new = words.difference(self.known)
        if len(self.known) + 2 * len(new) > self.most:
            self.known, self.older = {}, self.known
            new = set(words)  # changed below
        if self.older:
            kept = {w: self.older[w] for w in new if w in self.older}
            self.known.update(kept)
            new.difference_update(kept)
        signs = self._SIGNS
        ended = {w: core for w in new if w[-1] in signs and (core := w.rstrip(signs)).isalpha()}
        new.difference_update(ended)
        new.update(ended.values())
        new.update(w[len(core) :] for w, core in ended.items())
        new = new.difference(self.known)
        letters = [w for w in new if w.isalpha()]
        others = [w for w in new if not w.isalpha()]
        known = self.known
        known.update(zip(letters, self._encode_letters(letters), strict=True))
        known.update(zip(others, self._encode(others, normal=True), strict=True))
        known.update({w: known[core] + known[w[len(core) :]] for w, core in ended.items()})

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        out: list = [None] * len(texts)
        for at, text in enumerate(texts):
            lowered = text.lower()  # may spell a special token that the text did not
            if self._PLAIN.fullmatch(text) and not any(s in lowered for s in self.special) and unicodedata.is_normalized("NFC", text):
                out[at] = lowered.split()
        self._learn(set().union(*filter(None, out)))
        find, join = self.known.__getitem__, b"".join
        return [join(map(find, words)) if words is not None else self._encode([text])[0] for words, text in zip(out, texts, strict=True)]


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One vocabulary a worker process, kept between tasks."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def cut_positions(lengths: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, ascending from 0 to its end, and what a cut there costs.

    ``lengths`` are ids per document, ``stops`` the positions after sentence ends.
    """
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.zeros(total + 1, np.int8)  # 1 sentence, 2 document, 3 inside a long sentence
    kind[stops[stops < total]] = 1
    kind[ends] = 2
    kind[0] = 2
    marks = np.flatnonzero(kind)
    gaps = np.flatnonzero(np.diff(marks) > STRIDE)
    for start, end in zip(marks[gaps].tolist(), marks[gaps + 1].tolist(), strict=True):
        kind[start + STRIDE : end : STRIDE] = 3
    at = np.flatnonzero(kind)
    cost = np.array([0, SENTENCE_PENALTY, 0, FREE_PENALTY], np.int64)[kind[at]]
    return at, cost


def plan_cuts(at: np.ndarray, penalty: np.ndarray, most: int = MOST) -> np.ndarray:
    """Positions of ``at`` where sequences end, the last being its end; padding plus penalties is least.

    Ties go to the latest predecessor with a full window, so the result is determined.
    """
    n = len(at)
    if n <= 1:
        return at[1:]
    powers: dict[int, list[int]] = {}
    for p in range(most.bit_length()):
        if (1 << p) > most:
            break
        back = np.searchsorted(at, at - (1 << p))
        for i in np.flatnonzero((at >= 1 << p) & (at[np.minimum(back, n - 1)] == at - (1 << p))).tolist():
            powers.setdefault(i, []).append(int(back[i]))
    where, pen = at.tolist(), penalty.tolist()
    cost, came = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0] * n
    for i in range(1, n):
        here = where[i]
        while where[queue[0]] < here - most:
            queue.popleft()
        j = queue[0]
        least = key[j] - here + most
        if i in powers:
            for x in powers[i]:
                if cost[x] < least:
                    least, j = cost[x], x
        least += pen[i]
        cost[i], came[i] = least, j
        k = key[i] = least + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    cuts, i = [], n - 1
    while i > 0:
        cuts.append(where[i])
        i = came[i]
    return np.array(cuts[::-1], np.int64)


def pack_block(ids: list[bytes], is_stop: np.ndarray, most: int = MOST) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, crc32, sequence, offset) of documents given as id bytes, in order; ``is_stop`` by id."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    stream = b"".join(ids)
    numbers = np.frombuffer(stream, "<u4")
    at, penalty = cut_positions(lengths, np.flatnonzero(is_stop[numbers]) + 1)
    cuts = plan_cuts(at, penalty, most)
    ends = np.cumsum(lengths)
    bounds = np.unique(np.concatenate([[0], cuts, ends]))
    starts, stops = bounds[:-1], bounds[1:]
    doc = np.searchsorted(ends, starts, side="right")
    seq = np.searchsorted(cuts, starts, side="right")
    doc_start, seq_start = ends - lengths, np.concatenate([[0], cuts])
    view = memoryview(stream)
    return [
        (d, a - ds, b - a, zlib.crc32(view[4 * a : 4 * b]), s, a - ss)
        for d, a, ds, b, s, ss in zip(doc.tolist(), starts.tolist(), doc_start[doc].tolist(), stops.tolist(), seq.tolist(), seq_start[seq].tolist(), strict=True)
    ]


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], most: int = MOST, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of every document in sequences of at most ``most`` ids.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Documents keep the order
    in which their partition is scanned; no row moves to another task. ``sequence_id`` holds the partition in
    its upper 31 bits. A null or empty text is the end id alone; repeated rows are packed each; null ids
    stay null; an empty table gives no rows. ``tokenizer`` is the path of a vocabulary file, or a function that a worker
    calls to find it on its own machine. ``cache_words`` trades a worker's memory for time; results are the same. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = words_of(tokenizer if isinstance(tokenizer, str) else tokenizer())
        words.most = cache_words
        end = np.array([END], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held
            pieces = pack_block(ids, words.is_stop, most)
            doc, start, length, crc, seq, offset = zip(*pieces, strict=True)
            out = pa.RecordBatch.from_arrays([
                pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array([len(ids[d]) // 4 for d in doc], pa.int64()), pa.array(np.array(seq, np.int64) + first), pa.array(offset, pa.int64())], schema=_OUT)
            first += seq[-1] + 1
            doc_ids.clear()
            ids.clear()
            held = 0
            return out

        def take(texts: list[str], of: list[int | None]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for doc_id, own in zip(of, words.ids(texts), strict=True):
                doc_ids.append(doc_id)
                ids.append(own + end)
                held += len(own) // 4 + 1
                if held >= block_ids:
                    yield flush()

        for batch in batches:
            texts, of, chars = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                texts.append(text.as_py())
                of.append(doc_id.as_py())
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    yield from take(texts, of)
                    texts, of, chars = [], [], 0
            yield from take(texts, of)
        if held:
            yield flush()
        words.older = {}

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokenizer_file)


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
