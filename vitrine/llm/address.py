"""Reading Brazilian postal addresses written in many ways."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from vitrine.llm.words import folded

# Street types and their abbreviations.
STREET_TYPES = {
    "r": "rua", "rua": "rua",
    "a": "avenida", "av": "avenida", "ave": "avenida", "aven": "avenida", "avenida": "avenida",
    "t": "travessa", "tr": "travessa", "tv": "travessa", "trav": "travessa", "travessa": "travessa",
    "al": "alameda", "alam": "alameda", "alameda": "alameda",
    "pc": "praca", "pca": "praca", "praca": "praca",
    "est": "estrada", "estr": "estrada", "estrada": "estrada",
    "rod": "rodovia", "rodov": "rodovia", "rodovia": "rodovia",
    "lg": "largo", "largo": "largo", "vl": "vila", "vila": "vila", "bc": "beco", "beco": "beco", "lad": "ladeira", "ladeira": "ladeira",
}
# Words that announce a building's name.
BUILDING_TYPES = ["e", "ed", "edf", "edif", "edificio", "res", "resid", "residencial", "cond", "condominio", "conj", "conjunto", "predio"]
# Personal titles that some writers leave out, and particles.
TITLES = [
    "dr", "dra", "dout", "doutor", "doutora", "prof", "profa", "profo", "professor", "professora", "cel", "coron", "coronel", "sen", "senador", "senadora",
    "gov", "governador", "pe", "padre", "eng", "enga", "engo", "engenh", "engenheiro", "engenheira", "mj", "maj", "major", "com", "comend", "comendador", "cap", "capitao",
    "pres", "presidente", "dep", "deputado", "ver", "vereador", "gen", "general", "mons", "monsenhor", "des", "desembargador", "alm", "almirante", "mal", "marechal", "sta", "santa", "sto", "santo", "sao",
]
PARTICLES = ["de", "da", "do", "das", "dos", "e", "d"]
MONTHS = ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
NUMBER_WORDS = {
    "primeiro": 1, "um": 1, "dois": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12, "treze": 13,
    "quatorze": 14, "catorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19, "vinte": 20, "trinta": 30,
}
ROMANS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"}
# Neighbourhood words and their abbreviations.
PLACE_WORDS = {"jd": "jardim", "jard": "jardim", "pq": "parque", "pque": "parque", "vl": "vila", "conj": "conjunto", "cj": "conjunto", "sta": "santa", "sto": "santo", "ns": "nossa senhora", "n": "nossa", "sra": "senhora", "s": "sao"}

_UNIT = re.compile(r"\b(?:apartamento|apto|apt|ap|unidade|unid|casa|sala)\b[\s.:]*(?:n[o.]?\s*)?(\d+\w?)\b")
_BLOCK = re.compile(r"\b(?:bloco|bl|torre)\b[\s.:]*([a-z]|\d+)\b")
_NUMBERED = re.compile(r"\b(?:numero|num|nro|no|n)\b[\s.:]*0*(\d{1,6})\b(?!\s+de\b)")
_NO_NUMBER = re.compile(r"\bs\s*/\s*n\b[.ºo]?")
_REFERENCE = re.compile(r"^\s*(?:proximo|perto|em frente|ao lado|esquina|atras)\b")


@dataclass
class Address:
    """What an address says; empty strings for what it doesn't."""

    street_type: str = ""
    street: tuple[str, ...] = ()
    number: str = ""
    block: str = ""
    unit: str = ""
    building: tuple[str, ...] = ()
    phase: str = ""
    untyped: list[tuple[str, ...]] = field(default_factory=list)


def plain(text: str | None) -> str:
    """Lower case, without accents and ordinal signs, single-spaced."""
    if not text:
        return ""
    text = text.replace("º", " ").replace("°", " ").replace("ª", "a ")
    return " ".join(folded(text).split())


def place(text: str | None) -> str:
    """A neighbourhood or city name with its abbreviations written out."""
    return " ".join(PLACE_WORDS.get(w, w) for w in re.findall(r"[a-z0-9]+", plain(text)))


def _words(segment: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])[-'’](?=[a-z])", "", segment))


def _nearest(word: str, known, letters: int) -> str:
    """The known word that ``word`` is but for one typing error; words shorter than ``letters`` must be right."""
    if word in known or len(word) < letters or word.isdigit():
        return word
    return next((k for k in known if len(k) >= letters and edits(word, k, 1) <= 1), word)


def _dates(words: list[str]) -> list[str]:
    """Number words before ``de <month>`` as digits, the month spelled right."""
    for i, w in enumerate(words):
        if w == "de" and i and i + 1 < len(words) and (month := _nearest(words[i + 1], MONTHS, 4)) in MONTHS:
            j, total = i, 0
            while j > 0 and (words[j - 1] == "e" and j < i or _nearest(words[j - 1], NUMBER_WORDS, 4) in NUMBER_WORDS):
                j -= 1
                total += NUMBER_WORDS.get(_nearest(words[j], NUMBER_WORDS, 4), 0)
            if total or words[i - 1].isdigit():
                return [*words[:j], *([str(total)] if total else []), w, month, *words[i + 2 :]]
    return words


def street_words(words: list[str]) -> tuple[str, ...]:
    """The words that tell streets apart: without particles and titles in front."""
    words = _dates(words)
    core = [w for w in words if w not in PARTICLES]
    while len(core) > 1 and (core[0] in TITLES or len(core[0]) == 1 and not core[0].isdigit()):
        core = core[1:]
    return tuple(core)


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance in which swapping two neighbouring letters is one edit; ``most + 1`` if it is greater than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before2 = row, before
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row.append(v)
        before = last
        if min(row) > most and min(last) > most:
            return most + 1
    return min(row[-1], most + 1)


def words_alike(x: tuple[str, ...], y: tuple[str, ...], drop: bool) -> bool:
    """Whether two names are the same but for typing errors.

    Word by word one edit (two in words of nine letters or more) in at most two
    words; an initial stands for its word; numbers must be equal. With ``drop``
    one of three or more words may be missing. Names split differently are
    compared as one word.
    """
    if x == y:
        return True
    if len(x) == len(y):
        other = [(a, b) for a, b in zip(x, y, strict=True) if a != b]
        return len(other) <= 2 and all(_word_alike(a, b) for a, b in other)
    if abs(len(x) - len(y)) != 1:
        return False
    short, long = sorted((x, y), key=len)
    if drop and len(short) > 1 and any(short == long[:i] + long[i + 1 :] for i in range(len(long))):
        return True
    a, b = "".join(x), "".join(y)
    return min(len(a), len(b)) >= 8 and edits(a, b) <= 1


def _word_alike(a: str, b: str) -> bool:
    if a.isdigit() or b.isdigit():
        return False
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    return edits(a, b) <= (1 if min(len(a), len(b)) < 9 else 2)


def building_words(words: list[str]) -> tuple[tuple[str, ...], str]:
    """The words of a building's name, and its phase (a number at the end, Roman or not)."""
    words = [w for w in words if w not in BUILDING_TYPES and w not in PARTICLES]
    phase = ""
    if len(words) > 1 and (words[-1] in ROMANS or (words[-1].isdigit() and len(words[-1]) < 3)):
        phase = ROMANS.get(words[-1], words[-1].lstrip("0"))
        words = words[:-1]
    return tuple(words), phase


def _take(a: Address, segment: str, building_first: bool) -> None:
    words = _words(segment)
    if not words or _REFERENCE.match(segment):
        return
    head, tail = words[0], words[-1]
    if all(w in BUILDING_TYPES for w in words):
        # "Name - Edificio": the part before it was the building.
        if a.untyped and not a.building:
            a.building, a.phase = building_words(list(a.untyped.pop()))
        return
    if head in STREET_TYPES and len(words) == 2 and words[1].isdigit():
        # "Name, Rua 220": type and number of the street named before.
        a.street_type, a.number = a.street_type or STREET_TYPES[head], a.number or words[1].lstrip("0")
        return
    if head in BUILDING_TYPES and len(words) > 1 or tail in BUILDING_TYPES and len(words) > 1 and tail != "e":
        name, phase = building_words(words)
        if name and not a.building:
            a.building, a.phase = name, phase
        return
    kind = ""
    if head in STREET_TYPES and len(words) > 1:
        kind, words = STREET_TYPES[head], words[1:]
    elif tail in STREET_TYPES and len(words) > 1:
        kind, words = STREET_TYPES[tail], words[:-1]
    elif head in STREET_TYPES:
        a.street_type = a.street_type or STREET_TYPES[head]
        return
    if kind or words[0] in PARTICLES and not building_first:
        if len(words) > 1 and words[-1].isdigit() and (len(words) < 3 or words[-2] != "de"):
            a.number = a.number or words[-1].lstrip("0")
            words = words[:-1]
        if not a.street:
            a.street_type, a.street = kind or a.street_type, street_words(words)
        return
    a.untyped.append(tuple(words))


def _numbers(a: Address, text: str) -> str:
    """Takes unit, block and announced number out of ``text``."""
    for pattern, name in ((_UNIT, "unit"), (_BLOCK, "block"), (_NUMBERED, "number")):
        m = pattern.search(text)
        if m:
            if not getattr(a, name):
                setattr(a, name, m[1].lstrip("0"))
            text = text[: m.start()] + " , " + text[m.end() :]
    return _NO_NUMBER.sub(" , ", text)


def _segments(text: str) -> list[str]:
    return [s.strip(" .") for s in re.split(r"[,;|]|\s-\s|\s-$|^-\s", text) if s.strip(" .-")]


def parse(street: str | None, number: str | None = None, building: str | None = None, free_line: bool = False, places: tuple[str, ...] = ()) -> Address:
    """Reads the address fields; each may hold parts that belong into another.

    Parts that end one of ``places`` (neighbourhood, title; see :func:`place`)
    only repeat the neighbourhood.

    A part that announces neither a street nor a building is the street if
    there is none; next to a street it is a building in a ``free_line`` and
    a neighbourhood otherwise.
    """
    a = Address()
    rest = _numbers(a, plain(number))
    m = re.search(r"\d+", rest)
    if m and not a.number:
        a.number = m[0].lstrip("0")
    line = _numbers(a, plain(street))
    for s in _segments(line):
        if re.fullmatch(r"[\d\s.]+", s):
            a.number = a.number or re.sub(r"\D", "", s).lstrip("0")
        elif (a.street or a.untyped) and any(p == q or p.endswith(" " + q) for q in (place(s),) for p in places if q):
            continue
        else:
            _take(a, s, building_first=False)
    name = plain(building)
    if name:
        words, phase = building_words(_words(name))
        if words:
            a.building, a.phase = words, phase
    for words in a.untyped:
        own = list(words)
        known, phase = building_words(own)
        if a.building and known == a.building:
            continue
        if free_line and not a.street and not a.number and not a.building and not a.street_type and len(a.untyped) == 1 and not own[-1].isdigit():
            # A bare name without a number: a street alone would name no building, so it is read as the building.
            a.building, a.phase = known, phase
        elif not a.street:
            if len(own) > 1 and own[-1].isdigit() and own[-2] != "de":
                a.number = a.number or own[-1].lstrip("0")
                own = own[:-1]
            a.street = street_words(own)
        elif free_line and not a.building:
            a.building, a.phase = known, phase
    return a
