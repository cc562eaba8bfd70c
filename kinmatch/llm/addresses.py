"""Postal addresses taken apart: house number, street, postal code and place words. Plain Python, no Spark."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from kinmatch.llm.visual import plain, word_forms

# Street kinds with their short forms; "first" kinds stand before the name.
KINDS = {
    "road": "rd", "lane": "ln", "street": "st str", "marg": "mg", "drive": "dr", "court": "ct", "highway": "hwy", "boulevard": "blvd bd boul", "avenue": "ave av", "square": "sq", "quay": "qy",
    "rue": "r", "place": "pl", "chemin": "che chem ch", "impasse": "imp", "quai": "qu", "cours": "crs", "route": "rte", "allee": "all", "way": "wy", "circle": "cir", "trail": "trl", "terrace": "ter", "parkway": "pkwy",
}
_KIND = {s: k for k, v in KINDS.items() for s in (k, *v.split())}
_FIRST = frozenset({"rue", "place", "chemin", "impasse", "quai", "cours", "route", "allee"})
_BOTH = frozenset({"avenue", "boulevard"})  # before the name in French addresses
_PARTICLES = frozenset({"de", "du", "des", "la", "le", "les", "d", "l"})
_DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "north": "north", "south": "south", "east": "east", "west": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
# Kinds that are written in one word with the name, with their short forms.
_FUSED = {"strasse": "strasse", "str": "strasse", "gasse": "gasse", "platz": "platz", "weg": "weg", "allee": "allee", "straat": "straat", "laan": "laan", "gatan": "gatan", "vagen": "vagen"}
_FUSED_WORD = re.compile(f"([a-z'-]{{3,}}?)-?({'|'.join(_FUSED)})")
_ADVERBS = {"main": "main", "cross": "cross", "x": "cross"}
# Words before or behind a number that is not the house's.
_UNITS = frozenset("unit office off flat suite ste apt apartment room rm shop batiment bat etage esc escalier floor flr fl appt appartement bldg building lot".split())
_HOUSE = frozenset("house door plot h no nr".split())
_LANDMARK = frozenset("opp opposite near nr behind beside opp".split())
_LANDMARK_KIND = frozenset("post office high school petrol pump bus stand railway gate clock tower water tank temple station market park".split())
_AREA_KIND = frozenset("colony cly nagar ngr layout lyt".split())
_NUMBERED_AREA = frozenset("phase ph sector sec block blk cedex".split())
_PLACEHOLDERS = frozenset({"", "null", "n/a", "na", "-", "--", "<null>", "none", "nil", "unknown", "."})

_TOKEN = re.compile(r"[a-z]+(?:['-][a-z]+)*|\d{5}-\d{4}|\d+[a-z]?(?![a-z])|\d+|#")
_SEPARATOR = re.compile(r"\s*[,;|\n]\s*|\s+-+\s+")


@dataclass
class Address:
    """Parts of an address; "" or empty where it has none."""

    number: str = ""
    street: str = ""
    kind: str = ""
    towards: str = ""
    post: str = ""
    places: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    #: Street names that the words before (or behind) the kind may mean, longest first, where nothing marks the border.
    readings: list[str] = field(default_factory=list)


def ordinary(text: str) -> str:
    """Lower-case ASCII letters, look-alikes and accents made plain."""
    base = plain(text)
    if base.isascii():
        return base.lower()
    if not base.isascii():
        out = []
        for w in re.split(r"(\W+)", base):
            if w and not w.isascii():
                forms = word_forms(w)
                w = forms[0] if forms else w
            out.append(w)
        base = "".join(out)
    folded = unicodedata.normalize("NFKD", base.lower().replace("ß", "ss"))
    return "".join(c for c in folded if not unicodedata.combining(c))


def country_of(value: str | None) -> str:
    """A country name in plain letters; "" for NULL and placeholders."""
    if value is None:
        return ""
    v = re.sub(r"[^a-z ]", "", ordinary(value)).strip()
    return "" if v in ("", "null", "none", "na") else v


def parse(text: str | None, country: str) -> Address:
    """The parts of an address. NULL, empty text, placeholders and post-office boxes give an empty ``Address``.

    ``hints`` are names of landmarks and areas: they tell streets apart where spellings leave a choice.
    """
    a = Address()
    if text is None:
        return a
    line = ordinary(text).strip()
    if line in _PLACEHOLDERS:
        return a
    line = line.replace(".", " ")
    segments = [s for s in _SEPARATOR.split(line) if s.strip()]
    toks: list[tuple[str, int]] = []  # (token, segment)
    for k, s in enumerate(segments):
        for t in _TOKEN.findall(s):
            toks.append((t, k))
    toks = _without_landmarks(toks, a, len(segments) > 2)
    toks = _without_units(toks, a, country)
    _find_street(toks, a, country)
    return a


def _without_landmarks(toks: list[tuple[str, int]], a: Address, segmented: bool) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    i = 0
    while i < len(toks):
        t, k = toks[i]
        if t in _LANDMARK and i + 1 < len(toks) and toks[i + 1][0].isalpha() and len(toks[i + 1][0]) > 2 and toks[i + 1][0] not in _KIND:
            a.hints.append(toks[i + 1][0])
            i += 2
            n = 0
            while i < len(toks) and (toks[i][0] in _LANDMARK_KIND or (segmented and toks[i][1] == k and n < 2)):
                i += 1
                n += 1
            continue
        out.append((t, k))
        i += 1
    return out


def _is_number(t: str) -> bool:
    return t[0].isdigit()


def _without_units(toks: list[tuple[str, int]], a: Address, country: str) -> list[tuple[str, int]]:
    """Tokens without units, floors and areas; an explicit house number is noted in ``a`` and stays as a mark."""
    out: list[tuple[str, int]] = []
    i, n = 0, len(toks)
    while i < n:
        t, k = toks[i]
        nxt = toks[i + 1][0] if i + 1 < n else ""
        parts = t.split("-")
        if (t in _UNITS or t in _NUMBERED_AREA) and nxt and _is_number(nxt) and len(nxt) < 5:
            if t in _NUMBERED_AREA:
                a.hints.append("area" + nxt)
            i += 2
            continue
        if t in _UNITS and nxt in ("no", "#") and i + 2 < n and _is_number(toks[i + 2][0]):
            i += 3
            continue
        if _is_number(t) and nxt in ("flr", "floor", "fl", "etage") and toks[i + 1][1] == k and not (nxt == "etage" and i + 2 < n and _is_number(toks[i + 2][0]) and toks[i + 2][1] == k):
            i += 2
            continue
        if t == "#" and nxt and _is_number(nxt):
            if nxt[-1].isalpha() or country == "us":
                i += 2  # a unit
                continue
            a.number = a.number or nxt
            i += 2
            continue
        if t in _HOUSE:
            j = i
            while j < n and (toks[j][0] in _HOUSE or toks[j][0] == "#"):
                j += 1
            if j < n and _house(toks[j][0]) and len(toks[j][0]) < 5 and (j - i > 1 or t in ("no", "house", "door", "plot")):
                a.number = a.number or toks[j][0]
                i = j + 1
                continue
        if t in _AREA_KIND and out and out[-1][0].isalpha() and out[-1][1] == k:
            a.hints.append(out.pop()[0])
            i += 1
            continue
        if t in ("industrial", "indl", "ind") and nxt == "area":
            if out and out[-1][1] == k and out[-1][0].isalpha():
                a.hints.append(out.pop()[0])
            i += 2
            continue
        if t == "cedex":
            i += 1
            continue
        if len(parts) == 2 and parts[0] in _UNITS:
            i += 1
            continue
        out.append((t, k))
        i += 1
    return out


@dataclass
class _Street:
    """A reading of the tokens ``begin`` to ``end`` as a street; of its words, ``sure`` ones belong to it in any case."""

    rank: int
    begin: int
    end: int
    words: list[str]
    kind: str
    leading: bool
    sure: bool


def _street_at(toks: list[tuple[str, int]], i: int, country: str) -> _Street | None:
    """The street whose kind stands at place ``i``: all words of its name, in the same piece of the address."""
    t, k = toks[i]
    n = len(toks)
    word = lambda j: 0 <= j < n and toks[j][1] == k and toks[j][0][0].isalpha() and toks[j][0] not in _KIND
    kind = _KIND.get(t)
    if not kind:
        fused = _FUSED_WORD.fullmatch(t)
        beside = [j for j in (i - 1, i + 1) if 0 <= j < n and toks[j][1] == k and _house(toks[j][0])]
        return _Street(3, i, i + 1, [fused[1]], _FUSED[fused[2]], False, True) if fused and beside else None
    leading = kind in _FIRST or (kind in _BOTH and (country == "france" or (i + 1 < n and toks[i + 1][0] in _PARTICLES) or not word(i - 1)))
    if leading:
        j = i + 1
        while j < n and toks[j][0] in _PARTICLES and toks[j][1] == k:
            j += 1
        words = []
        while word(j):
            words.append(re.sub("^(?:d|l)'", "", toks[j][0]))
            j += 1
        marked = j < n and not toks[j][0][0].isalpha()
        return _Street(0 if len(t) > 2 or country == "france" else 2, i, j, words, kind, True, marked or len(words) == 1) if words else None
    j = i - 1
    adverb = ""
    if j >= 0 and toks[j][1] == k and toks[j][0] in _ADVERBS:
        adverb = _ADVERBS[toks[j][0]] + " "
        j -= 1
    words = []
    while word(j) and toks[j][0] not in _DIRECTIONS:
        words.insert(0, toks[j][0])
        j -= 1
    # A number before the name marks its border, unless the house number stands behind: then it may be a postal code before a town.
    behind = i + 1 < n and toks[i + 1][1] == k and _house(toks[i + 1][0])
    marked = j >= 0 and toks[j][1] == k and (toks[j][0] in _DIRECTIONS or (not toks[j][0][0].isalpha() and not behind))
    return _Street(1, j + 1, i + 1, words, adverb + kind, False, marked or len(words) == 1) if words else None


def _find_street(toks: list[tuple[str, int]], a: Address, country: str) -> None:
    n = len(toks)
    streets = [s for i in range(n) if (s := _street_at(toks, i, country))]
    used: set[int] = set()
    if streets:
        best = min(streets, key=lambda s: s.rank)
        lo, hi, a.kind = best.begin, best.end, best.kind
        a.street = " ".join(best.words)
        if not best.sure:
            a.readings = [" ".join(best.words[:-j] if best.leading else best.words[j:]) if j else a.street for j in range(len(best.words))]
        # Words that may not be the street's stay open for places.
        spare = 0 if best.sure else len(best.words) - 1
        used |= set(range(lo, hi - spare) if best.leading else range(lo + spare, hi))
        towards = ""
        if lo and toks[lo - 1][0] in _DIRECTIONS and toks[lo - 1][1] == toks[lo][1]:
            lo -= 1
            towards = toks[lo][0]
            used.add(lo)
        elif hi < n and toks[hi][0] in _DIRECTIONS and toks[hi][1] == toks[hi - 1][1] and country in ("us", "") and (hi + 1 == n or toks[hi + 1][1] != toks[hi][1] or _house(toks[hi + 1][0])):
            towards = toks[hi][0]
            used.add(hi)  # "Mobonu Ct E 340"
            hi += 1
        if towards:
            a.towards = _DIRECTIONS[towards]
        if not a.number:
            before = lo - 1 if lo and _house(toks[lo - 1][0]) else None
            after = hi if hi < n and _house(toks[hi][0]) else None
            seg = toks[hi - 1][1]
            # In the same piece of the address first; plain short numbers before long ones and ones with a letter; behind the
            # name where the country writes it there.
            options = [x for x in (before, after) if x is not None]
            options = [x for x in options if len(toks[x][0]) < 5] or [x for x in options if _other_code(toks, x)]
            behind = best.kind in ("street", "avenue", "square", "quay") and country not in ("us", "india", "france") and after is not None
            options.sort(key=lambda x: (toks[x][1] != seg, len(toks[x][0]) > 4 or not toks[x][0].isdigit(), x == before and behind))
            if options:
                x = options[0]
                # A split postal code ("117 290") is no house number.
                if x == after and x + 1 < n and country in ("india", "") and _three(toks[x]) and _three(toks[x + 1]) and toks[x][1] == toks[x + 1][1] and not (x + 2 < n and _three(toks[x + 2])):
                    options = options[1:]
                if options:
                    x = options[0]
                    a.number = toks[x][0]
                    used.add(x)
    rest = [(t, k) for i, (t, k) in enumerate(toks) if i not in used]
    _find_post(rest, a, country)


def _house(t: str) -> bool:
    """Digits, maybe with a letter behind; five and six of them only where another number can be the postal code."""
    digits = t[:-1] if t[-1].isalpha() else t
    return digits.isdigit() and len(digits) <= (6 if digits == t else 4)


def _other_code(toks: list[tuple[str, int]], at: int) -> bool:
    """Whether the address has a postal code besides the number at place ``at``."""
    return any(t != toks[at][0] and (t.isdigit() and len(t) >= 5 or "-" in t and t[0].isdigit()) for t, _ in toks)


def _three(tk: tuple[str, int]) -> bool:
    return tk[0].isdigit() and len(tk[0]) == 3


def _find_post(rest: list[tuple[str, int]], a: Address, country: str) -> None:
    places: list[tuple[str, int]] = []
    i = 0
    while i < len(rest):
        t, k = rest[i]
        if t.isdigit():
            if len(t) >= 5 and not a.post:
                a.post = t
            elif len(t) == 3 and i + 1 < len(rest) and _three(rest[i + 1]) and not a.post:
                a.post = t + rest[i + 1][0]
                i += 1
            elif len(t) == 4 and country not in ("india", "us", "france") and not a.post:
                a.post = t
        elif "-" in t and t[0].isdigit():
            a.post = a.post or t[:5]
        elif t[0].isalpha() and len(t) > 1:
            places.append((t, k))
        i += 1
    out: list[str] = []
    for i, (t, k) in enumerate(places):
        out.append(t)
        if i + 1 < len(places) and places[i + 1][1] == k:
            out.append(f"{t} {places[i + 1][0]}")
    a.places = list(dict.fromkeys(out))
