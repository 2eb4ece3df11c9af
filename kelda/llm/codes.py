"""Texts as arrays: folding, words and hashes of a whole batch at once.

A batch of texts becomes one array of folded character codes, and words become 64-bit
hashes, so that operators on every word of a corpus run in a few passes of numpy
instead of a Python step per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Codes of folded characters: 0 separates, 1-26 letters, 27-36 digits, others from 37 on.
SEPARATOR = 0
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_DAMAGED = re.compile("[ÂÃâ][\u0080-ÿŒœŠšŸŽžƒˆ˜–-™]{1,2}")
_ENTITY = re.compile(r"&(?:amp|lt|gt|quot|nbsp|#39|apos);")
_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&#39;": "'", "&apos;": "'"}


def _redecode(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def repair(text: str) -> str:
    """text with accents that were read in a wrong encoding put right."""
    return _DAMAGED.sub(_redecode, text) if "Ã" in text or "Â" in text or "â€" in text else text


def plain(text: str) -> str:
    """text without markup and with repaired accents."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: _ENTITIES[m[0]], text)
    return repair(text)


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _table() -> np.ndarray:
    """Code of each character of the basic plane; accents fold away, what is no letter or digit separates."""
    lut = np.zeros(0x10000, dtype=np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        kind = unicodedata.category(ch)[0]
        if kind not in "LN":
            continue
        base = fold(ch)[:1] or ch
        o = ord(base)
        if 97 <= o <= 122:
            lut[cp] = o - 96
        elif 48 <= o <= 57:
            lut[cp] = o - 48 + 27
        else:
            lut[cp] = 37 + o % 200
    return lut


_LUT: np.ndarray | None = None
_MULT = np.uint64(0x9E3779B97F4A7C15)


def lut() -> np.ndarray:
    global _LUT
    if _LUT is None:
        _LUT = _table()
    return _LUT


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts, each text followed by a separator, and where each text starts (one more at the end)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return points, np.concatenate([[0], ends])


def codes_of(points: np.ndarray) -> np.ndarray:
    """Folded codes of characters; those beyond the basic plane separate."""
    return lut()[np.where(points < 0x10000, points, 0)]


def mix(h: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of each word (a run of codes that don't separate)."""
    inside = codes != SEPARATOR
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(longest, _MULT, dtype=np.uint64))])
    chars = np.flatnonzero(inside)
    place = chars - np.repeat(starts, lengths)
    values = codes[chars].astype(np.uint64) * powers[place]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return mix(np.add.reduceat(values, first)), starts, lengths


def pieces(texts: list[str], chars: int, overlap: int = 0) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of texts of about ``chars`` characters: which text each piece is of, and the pieces.

    A text longer than ``chars`` is cut at white space into pieces of which neighbours
    share ``overlap`` characters, so that memory stays bounded however long a text is.
    """
    which: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = min(len(t), at + chars)
            if end < len(t):
                cut = max(t.rfind(" ", at + chars // 2, end), t.rfind("\n", at + chars // 2, end))
                end = cut if cut > 0 else end
            which.append(i)
            held.append(t[at:end])
            size += end - at
            if size >= chars:
                yield which, held
                which, held, size = [], [], 0
            if end >= len(t):
                break
            at = max(at + 1, end - overlap)
            if overlap and (cut := t.find(" ", at, end)) > 0:
                at = cut
    if held:
        yield which, held
