"""Words of a text whatever its case, accents, markup and layout."""

from __future__ import annotations

import html
import re
import sys
import unicodedata

_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile("[ÂÃâ][\u0080-¿Œ-™]")
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$|[\"')\]])|[\n\r]+")


def mended(text: str) -> str:
    """Text read in the wrong character set (UTF-8 as Latin-1 or Windows-1252) set right, piece by piece where needed."""
    if not _BROKEN.search(text):
        return text
    for charset in ("cp1252", "latin-1"):
        try:
            return text.encode(charset).decode("utf-8")
        except UnicodeError:
            continue
    out = []
    for piece in re.split(r"(\s+)", text):
        for charset in ("cp1252", "latin-1"):
            try:
                piece = piece.encode(charset).decode("utf-8") if _BROKEN.search(piece) else piece
                break
            except UnicodeError:
                continue
        out.append(piece)
    return "".join(out)


def visible(text: str) -> str:
    """The text without markup, entities resolved, broken accents mended."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return mended(text)


_COMBINING = [chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))]
#: Combining marks, and those of the basic plane: a set of these alone is looked up many times faster.
_MARKS, _BASIC_MARKS = (re.compile("[" + "".join(x) + "]+") for x in (_COMBINING, [c for c in _COMBINING if c <= "\uffff"]))
_BEYOND_BASIC = re.compile("[\U00010000-\U0010ffff]")


def _marks(text: str) -> re.Pattern:
    return _MARKS if _BEYOND_BASIC.search(text) else _BASIC_MARKS


def folded(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    return _marks(text).sub("", text)


def has_marks(text: str) -> bool:
    """Whether accents stand apart from their letters somewhere."""
    return not text.isascii() and _marks(text).search(text) is not None


def written_words(text: str | None) -> list[str]:
    """The words of :func:`words` as written: each becomes the same word when folded. For readers that remember what they folded."""
    if not text:
        return []
    text = visible(text)
    return _WORD.findall(folded(text) if has_marks(text) else text)


def words(text: str | None) -> list[str]:
    """The words of a text in plain form; [] for null, empty and wordless texts."""
    return _WORD.findall(folded(visible(text))) if text else []


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence or line that has any."""
    if not text:
        return []
    return [w for s in _SENTENCE.split(visible(text)) if (w := _WORD.findall(folded(s)))]
