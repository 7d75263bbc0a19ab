"""Sequence kernels on plain Python values, shared by the column functions and the value-level library.

Distances use the bit-parallel recurrence of Myers (1999) in Hyyrö's form (2003) on unbounded integers: one
column of the matrix is a handful of integer operations. Edit scripts are traced back through the vertical
and horizontal difference bits; only every √n-th column is kept and the others are computed again.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import regex

_CLUSTER = regex.compile(r"(?s)\X")
_WORD_BREAK = regex.compile(r"(?wV1)\b")
_JOINING = re.compile("[^\x00-\u02ff]|\r\n")
# letters, decimal digits and the signs whose word-break class is plain; of these, marks between letters or digits join
_LATIN = re.compile("[\n !-9;-~À-ÖØ-öø-ɏ–—‘’“”„]*")
_A, _N = "A-Za-zÀ-ÖØ-öø-ɏ", "0-9"
_LATIN_WORD = re.compile(f"[{_A}{_N}_](?:[{_A}{_N}_]|(?<=[{_A}])[.'‘’](?=[{_A}])|(?<=[{_N}])[,;.'‘’](?=[{_N}]))*")
_PRIVATE = regex.compile("[\ue000-\uf8ff]")
#: The library keeps an apostrophe with a vowel that follows it, which UAX #29 does not.
_LEADING = regex.compile(r"^(?:['’]\p{M}*)+(?=.)")
#: A segment without any character outside these categories is no word.
_WORDLIKE = regex.compile(r"[^\p{M}\p{P}\p{Z}\p{S}\p{Cc}\p{Cf}]")


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def graphemes(text: str) -> list[str]:
    """UAX #29 extended grapheme clusters. Below U+0300, and without CR LF, every code point is one."""
    return _CLUSTER.findall(text) if _JOINING.search(text) else list(text)


def words(text: str) -> list[str]:
    """UAX #29 word segments that hold a letter, digit or other word-like character.

    Private-use characters count as letters: they are masked one to one before the text is segmented. Texts of
    common Latin characters are matched by one pattern that says the same.
    """
    if _LATIN.fullmatch(text):
        return [w for w in _LATIN_WORD.findall(text) if w.strip("_")]
    out, at = [], 0
    for piece in _WORD_BREAK.split(_PRIVATE.sub("a", text)):
        own = _LEADING.sub("", text[at : at + len(piece)])
        at += len(piece)
        if _WORDLIKE.search(own):
            out.append(own)
    return out


def _peq(tokens: Sequence[str]) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, t in enumerate(tokens):
        found[t] = found.get(t, 0) | (1 << i)
    return found


def _columns(a: Sequence[str], b: Sequence[str], vp: int, vn: int) -> Iterator[tuple[int, int, int]]:
    """(vertical plus, vertical minus, horizontal plus) after each token of ``b``."""
    peq, full = _peq(a), (1 << len(a)) - 1
    for t in b:
        x = peq.get(t, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = (vn | ~(vp | d0)) & full
        x = (hp << 1) | 1
        vn = x & d0 & full
        vp = ((hn << 1) | ~(x | d0)) & full
        yield vp, vn, hp


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance of two token sequences with unit costs."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    vp = vn = 0
    for vp, vn, _ in _columns(a, b, (1 << len(a)) - 1, 0):
        pass
    # the last column's vertical steps sum to D[m][n] - D[0][n]
    return len(b) + vp.bit_count() - vn.bit_count()


def edit_script(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int]]:
    """A shortest script as ``(op, position in a, position in b)``, ascending.

    Of the shortest scripts the one is taken that, traced from the ends, matches equal tokens first, then
    deletes, then inserts, then replaces. Memory is O(n·√n) bits.
    """
    tail = 0
    while tail < min(len(a), len(b)) and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    step = max(1, math.isqrt(len(b)))
    state = ((1 << len(a)) - 1, 0)
    kept = [state]
    if a:
        for j, (vp, vn, _) in enumerate(_columns(a, b, *state), 1):
            if j % step == 0:
                kept.append((vp, vn))
    ops: list[tuple[str, int, int]] = []
    i, j = len(a), len(b)
    first, block = len(b) + 1, []  # columns first+1 … of the block now held
    while i or j:
        if not i:
            ops.append(("insert", 0, j - 1))
            j -= 1
            continue
        if not j:
            ops.append(("delete", i - 1, 0))
            i -= 1
            continue
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            continue
        if j <= first:
            first = (j - 1) // step * step
            block = list(_columns(a, b[first : min(len(b), first + step)], *kept[first // step]))
        vp, _, hp = block[j - 1 - first]
        bit = 1 << (i - 1)
        if vp & bit:
            ops.append(("delete", i - 1, j))
            i -= 1
        elif hp & bit:
            ops.append(("insert", i, j - 1))
            j -= 1
        else:
            ops.append(("replace", i - 1, j - 1))
            i, j = i - 1, j - 1
    return ops[::-1]


def differing(a: Sequence[str], b: Sequence[str]) -> Iterator[tuple[str | None, str | None]]:
    """The unequal pairs of ``align``, in order."""
    for op, p, q in edit_script(a, b):
        yield None if op == "insert" else a[p], None if op == "delete" else b[q]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[str | None, str | None]]:
    """Pairs of aligned tokens; a deletion has no right, an insertion no left side."""
    out: list[tuple[str | None, str | None]] = []
    i = j = 0
    for op, p, q in edit_script(a, b):
        while i < p or j < q:  # what lies between two operations matches
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        left, right = op != "insert", op != "delete"
        out.append((a[i] if left else None, b[j] if right else None))
        i, j = i + left, j + right
    out += zip(a[i:], b[j:], strict=True)
    return out


def rate(d: int, n: int) -> float:
    """Errors per reference token: 0 without errors, infinite without reference tokens."""
    return 0.0 if d == 0 else math.inf if n == 0 else d / n


def score_hint(error_rate: float, n: int) -> int | None:
    """Expected distance, rounded up; None if it is not finite."""
    if math.isnan(error_rate):
        raise ValueError("the error rate is not a number")
    expected = error_rate * n
    return math.ceil(expected) if math.isfinite(expected) else None
