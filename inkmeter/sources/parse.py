"""File contents to text segments: format sniffing, encodings, PAGE and ALTO trees, METS, on plain Python values.

A segment is ``(region_id, segment_id, text)``; texts are normalised as the caller asks.
"""

from __future__ import annotations

import codecs
import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from inkmeter.functions.unicode_text import plain_value

Segment = tuple[str | None, str | None, str]
LEVELS = ("region", "line")
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def detect_encoding(content: bytes) -> str:
    """A byte-order mark decides, else UTF-8 if the bytes are valid, else Windows-1252, else Latin-1."""
    for mark, name in _BOMS:
        if content.startswith(mark):
            return name
    for name in ("utf-8", "cp1252"):
        try:
            content.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return "latin-1"


def split_name(tag: str) -> tuple[str, str]:
    """(namespace, local name) of an element's tag."""
    space, _, local = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
    return space, local


def namespace_of(root: ET.Element, local: str) -> str:
    """The root's namespace, of whatever version, if the root is the expected element."""
    space, name = split_name(root.tag)
    if name != local:
        raise ValueError(f"Not an {'ALTO' if local == 'alto' else 'PAGE'} tree")
    return space


def _tag(space: str, local: str) -> str:
    return f"{{{space}}}{local}" if space else local


# ---------------------------------------------------------------- plain text


def plain_segments(content: bytes, encoding: str = "autodetect", prefix: str = "") -> list[Segment]:
    """One segment a line, stripped on both ends; a trailing line break adds no line."""
    text = content.decode(detect_encoding(content) if encoding == "autodetect" else encoding)
    lines = re.split("\r\n|\r|\n", text)
    if lines[-1] == "":
        lines.pop()
    return [(None, f"{prefix}line {no}", line.strip()) for no, line in enumerate(lines)]


# ---------------------------------------------------------------- ALTO


def alto_segments(root: ET.Element) -> list[Segment]:
    """All text lines in document order; a line is its direct strings, joined by blanks."""
    space = namespace_of(root, "alto")
    return [
        (None, line.get("ID"), " ".join(s.get("CONTENT") or "" for s in line.findall(_tag(space, "String"))))
        for line in root.iter(_tag(space, "TextLine"))
    ]


# ---------------------------------------------------------------- PAGE


def _number(element: ET.Element, name: str) -> float:
    value = element.get(name)
    return math.nan if value is None else float(value)


def choose_equiv(index: list[float], conf: list[float]) -> int | None:
    """Position of the text alternative that counts: least index, else greatest confidence, else the first."""
    if len(index) <= 1:
        return 0 if index else None
    for values, better in ((index, min), (conf, max)):
        present = [(v, i) for i, v in enumerate(values) if not math.isnan(v)]
        if present:
            top = better(v for v, _ in present)
            return next(i for v, i in present if v == top)
    return 0


def _equiv_text(segment: ET.Element, space: str) -> str:
    equivs = segment.findall(_tag(space, "TextEquiv"))
    at = choose_equiv([_number(e, "index") for e in equivs], [_number(e, "conf") for e in equivs])
    if at is None:
        return ""
    return equivs[at].findtext(_tag(space, "Unicode")) or ""


def _in_reading_order(group: ET.Element, space: str) -> Iterator[str]:
    """Region references below a group, in order."""
    for child in _children_in_order(group):
        name = split_name(child.tag)[1]
        if name in ("OrderedGroup", "OrderedGroupIndexed", "UnorderedGroup", "UnorderedGroupIndexed"):
            yield from _in_reading_order(child, space)
        elif child.get("regionRef"):
            yield child.get("regionRef")


def _children_in_order(group: ET.Element) -> list[ET.Element]:
    name = split_name(group.tag)[1]
    if name in ("OrderedGroup", "OrderedGroupIndexed"):
        return sorted((c for c in group if c.get("index") is not None), key=lambda c: int(c.get("index")))
    if name in ("UnorderedGroup", "UnorderedGroupIndexed"):
        return list(group)
    raise NotImplementedError(f"reading order group {name}")


def page_segments(root: ET.Element, level: str = "region") -> list[Segment]:
    """Text regions in reading order (all of them in document order where none is given), empty ones left out.

    At level ``line`` a region gives one segment for each of its direct text lines.
    """
    if level not in LEVELS:
        raise KeyError(level)
    space = namespace_of(root, "PcGts")
    regions = list(root.iter(_tag(space, "TextRegion")))
    order = root.find(".//" + _tag(space, "ReadingOrder"))
    if order is not None:
        by_id: dict[str, ET.Element] = {}
        for r in regions:
            by_id.setdefault(r.get("id"), r)
        regions = [by_id[ref] for group in order for ref in _in_reading_order(group, space) if ref in by_id]
    out: list[Segment] = []
    for r in regions:
        if level == "region":
            parts = [(r.get("id"), r.get("id"), _equiv_text(r, space))]
        else:
            parts = [(r.get("id"), line.get("id"), _equiv_text(line, space)) for line in r.findall(_tag(space, "TextLine"))]
        if "\n".join(p[2] for p in parts):
            out += parts
    return out


# ---------------------------------------------------------------- any format


def extract(content: bytes, level: str = "region", encoding: str = "autodetect", form: str = "nfc_sbb", prefix: str = "") -> tuple[str, list[Segment]]:
    """(format, normalised segments) of a file, told by its content: PAGE, ALTO, or plain text if it is no XML."""
    try:
        root = ET.fromstring(content)
    except (ET.ParseError, UnicodeDecodeError, LookupError):
        kind, found = "plain", plain_segments(content, encoding, prefix)
    else:
        kind = "page" if split_name(root.tag)[1] == "PcGts" else "alto"
        found = page_segments(root, level) if kind == "page" else alto_segments(root)
    return kind, [(region, own, plain_value(text, form)) for region, own, text in found]


def mets_files(content: bytes) -> list[tuple[str | None, str, str, str | None, str | None]]:
    """(page id, file id, file group, location, media type) of every file of a METS document, a row for each page it is on."""
    root = ET.fromstring(content)
    if split_name(root.tag)[1] != "mets":
        raise ValueError("Not a METS tree")
    space = split_name(root.tag)[0]
    pages: dict[str, list[str]] = {}
    for div in root.iter(_tag(space, "div")):
        if div.get("TYPE") == "page":
            for pointer in div.findall(_tag(space, "fptr")):
                pages.setdefault(pointer.get("FILEID"), []).append(div.get("ID"))
    out = []
    for group in root.iter(_tag(space, "fileGrp")):
        for file in group.findall(_tag(space, "file")):
            place = file.find(_tag(space, "FLocat"))
            href = None if place is None else next((v for k, v in place.attrib.items() if split_name(k)[1] == "href"), None)
            out += [(page, file.get("ID"), group.get("USE"), href, file.get("MIMETYPE")) for page in pages.get(file.get("ID"), [None])]
    return out


def guarded(work: Callable, *args) -> tuple[object, str | None]:
    """(result, None) or (None, message): one bad file does not stop a corpus."""
    try:
        return work(*args), None
    except Exception as e:  # noqa: BLE001  the message becomes a column
        return None, f"{type(e).__name__}: {e}"
