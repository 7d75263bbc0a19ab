"""The library on plain Python values: texts, token lists, and page trees, one pair at a time."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from inkmeter.functions import kernels
from inkmeter.functions.unicode_text import plain_value
from inkmeter.sources import parse


@dataclass(frozen=True)
class ExtractedText:
    """Text of a file as the segments it came in, joined by ``joiner``; or one text without segments.

    Raises on a text that is not in the normal form ``form``, on a malformed id and on an unknown joiner.
    """

    segments: tuple[tuple[str | None, str], ...] = field(default=())
    joiner: str = "\n"
    form: str = "nfc_sbb"

    def __post_init__(self):
        if self.joiner not in ("", " ", "\n"):
            raise ValueError(f"unknown joiner {self.joiner!r}")
        for own, text in self.segments:
            if own is not None and not re.match(r"[\w-]+", own):
                raise ValueError(f"segment id {own!r} is malformed")
            if plain_value(text, self.form) != text:
                raise ValueError(f"text of segment {own!r} is not in the normal form {self.form}")

    @classmethod
    def from_str(cls, text: str, form: str = "nfc_sbb") -> ExtractedText:
        return cls(((None, plain_value(text, form)),), form=form)

    @classmethod
    def from_segments(cls, segments: Iterable[parse.Segment], form: str = "nfc_sbb") -> ExtractedText:
        return cls(tuple((own, plain_value(text, form)) for _, own, text in segments), form=form)

    @property
    def text(self) -> str:
        return self.joiner.join(t for _, t in self.segments)

    @property
    def grapheme_clusters(self) -> list[str]:
        return kernels.graphemes(self.text)

    def segment_id_for_pos(self, pos: int) -> str | None:
        """Id of the segment at a code-point position; None on joiners and outside."""
        at = 0
        for own, text in self.segments:
            if at <= pos < at + len(text):
                return own
            at += len(text) + len(self.joiner)
        return None


Tokens = str | ExtractedText | Iterable[str]


def _clusters(x: Tokens) -> list[str]:
    if isinstance(x, str):
        return kernels.graphemes(kernels.nfc(x))
    return x.grapheme_clusters if isinstance(x, ExtractedText) else list(x)


def words(x: str | ExtractedText) -> list[str]:
    return kernels.words(x if isinstance(x, str) else x.text)


def _words(x: Tokens) -> list[str]:
    return words(kernels.nfc(x if isinstance(x, str) else x.text)) if isinstance(x, (str, ExtractedText)) else list(x)


def distance(a: Tokens, b: Tokens) -> int:
    return kernels.distance(_clusters(a), _clusters(b))


def editops(a: str, b: str) -> list[tuple[str, int, int]]:
    return kernels.edit_script(_clusters(a), _clusters(b))


def align(a: str, b: str) -> list[tuple[str | None, str | None]]:
    return kernels.align(_clusters(a), _clusters(b))


def seq_align(a: Iterable[str], b: Iterable[str], score_hint: int | None = None) -> list[tuple[str | None, str | None]]:
    """Alignment of token sequences; the hint is accepted and not needed."""
    return kernels.align(list(a), list(b))


score_hint = kernels.score_hint


def character_error_rate_n(reference: Tokens, compared: Tokens) -> tuple[float, int]:
    a = _clusters(reference)
    return kernels.rate(kernels.distance(a, _clusters(compared)), len(a)), len(a)


def character_error_rate(reference: Tokens, compared: Tokens) -> float:
    return character_error_rate_n(reference, compared)[0]


def word_error_rate_n(reference: Tokens, compared: Tokens) -> tuple[float, int]:
    a = _words(reference)
    return kernels.rate(kernels.distance(a, _words(compared)), len(a)), len(a)


def word_error_rate(reference: Tokens, compared: Tokens) -> float:
    return word_error_rate_n(reference, compared)[0]


def _root(tree: ET.Element | ET.ElementTree) -> ET.Element:
    return tree.getroot() if isinstance(tree, ET.ElementTree) else tree


def alto_namespace(tree) -> str:
    return parse.namespace_of(_root(tree), "alto")


def page_namespace(tree) -> str:
    return parse.namespace_of(_root(tree), "PcGts")


def alto_text(tree) -> str:
    return ExtractedText.from_segments(parse.alto_segments(_root(tree))).text


def page_text(tree, *, textequiv_level: str = "region") -> str:
    return ExtractedText.from_segments(parse.page_segments(_root(tree), textequiv_level)).text


def extract(filename: str, *, textequiv_level: str = "region", plain_encoding: str = "autodetect") -> ExtractedText:
    _, found = parse.extract(Path(filename).read_bytes(), textequiv_level, plain_encoding)
    return ExtractedText(tuple((own, text) for _, own, text in found))


def plain_text(filename: str, encoding: str = "autodetect") -> str:
    return ExtractedText.from_segments(parse.plain_segments(Path(filename).read_bytes(), encoding)).text


def text(filename: str) -> str:
    return extract(filename).text
