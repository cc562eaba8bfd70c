"""Business names: words in Latin letters, line of trade, and when two names are spellings of one."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from kinmatch.functions.similarity import jaro_winkler
from kinmatch.llm.visual import plain, word_forms

# Words that do not tell businesses apart (legal form, family suffix, particles).
LEGAL = frozenset(
    "the m s ms and n et private pvt p limited ltd llp llc inc incorporated corp corporation company co cie group grp "
    "sons son brothers bros fils sarl sas sa eurl l c r a".split()
)
# Lines of trade with the short forms in use.
TRADES = {
    "academy": "acad", "ambulances": "amb", "associates": "assoc", "assurances": "assur", "bakery": "bkry", "batiment": "bat", "blanchisserie": "blanch", "books": "bks", "boulangerie": "boul",
    "brasserie": "brass", "brocante": "broc", "ceramics": "ceram", "chemicals": "chem", "coiffure": "coiff", "conseil": "cons", "construction": "constr", "consulting": "conslt", "dairy": "dry",
    "demenagement": "demenag", "dental care": "dental", "ebenisterie": "eben", "edition": "edit", "electricals": "elect", "encadrement": "encadr", "enterprises": "ent", "epicerie": "epic", "farm": "frm",
    "fleuriste": "fleur", "formation": "form", "foundry": "fdry", "furniture": "furn", "garage": "gar", "gardiennage": "gardien", "garments": "gmts", "granites": "grnt", "graphisme": "graph",
    "herboristerie": "herbor", "hospital": "hosp", "hospitality": "hosplty", "immobilier": "immo", "industries": "inds", "informatique": "info", "insurance": "ins", "interiors": "intr", "international": "intl",
    "jardinage": "jard", "jewellers": "jwlrs", "joaillerie": "joail", "joinery": "jnry", "laboratories": "labs", "librairie": "libr", "location": "loc", "logistics": "log", "maconnerie": "macon",
    "manufacturing": "mfg", "marketing": "mktg", "medicals": "med", "menuiserie": "menuis", "motors": "mtrs", "nautisme": "naut", "nettoyage": "nett", "optique": "opt", "outillage": "outill", "peinture": "peint",
    "pharmacy": "pharm", "photography": "photo", "plomberie": "plomb", "ramonage": "ramon", "realty": "rlty", "restaurant": "rest", "security": "sec", "serrurerie": "serr", "services": "svcs", "technologies": "tech",
    "terroirs": "terr", "textiles": "tex", "traders": "trdrs", "traiteur": "trait", "transport": "trpt", "vins": "vin",
}
# Given names with their familiar forms.
NICKNAMES = {
    "alexander": "alex al sandy sasha xander", "anthony": "tony ant", "ashutosh": "ashu", "balakrishnan": "balu bala", "benjamin": "ben benny", "bhagyashree": "bhagya", "chandrika": "chandu chandra",
    "charles": "chuck charlie", "christopher": "chris kit topher", "deborah": "debbie deb", "devendra": "dev", "dominique": "dom domi", "edward": "ed ted eddie ned", "elizabeth": "betty liz beth lizzie eliza",
    "emmanuel": "manu manny", "francisco": "paco pancho frank", "frederic": "fred freddy", "gabrielle": "gaby gabby", "genevieve": "ginette gen", "gopalan": "gopi gopal", "gregory": "greg", "harishchandra": "hari harish",
    "helene": "lenie leni", "isabella": "izzy bella", "james": "jim jimmy jamie", "jayanti": "jaya", "jeanbaptiste": "jb", "kamalesh": "kamal kamu", "katherine": "kate kathy katie kat", "lakshmi": "laxmi", "leonardo": "leo",
    "mahendra": "mahi", "manoranjan": "mano", "margaret": "peggy maggie meg", "narendran": "naren", "nathaniel": "nate nat nathan", "niranjan": "niru", "padmavati": "padma", "patricia": "trish pat patty",
    "penelope": "penny", "prabhakar": "prabhu", "rajendra": "raju raj", "ramakant": "ramu", "rebecca": "becky", "richard": "dick rick rich", "robert": "bob rob bobby", "samuel": "sam", "saraswati": "saru",
    "sebastien": "seb", "stephane": "steph", "surendra": "suri", "tejasvini": "teju", "theodore": "theo ted", "umashankar": "uma", "valentina": "tina val", "venkatesan": "venky venkat", "veronique": "vero",
    "vijayalakshmi": "viji vijaya", "william": "bill will billy", "yogendra": "yogi",
}
_FORMAL: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL[_s] = _FORMAL.get(_s, frozenset()) | {_full}
    _FORMAL[_full] = _FORMAL.get(_full, frozenset()) | {_full}

# Places in the common layout of the Indic blocks, with their Latin letters.
_INDIC_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au", 0x11: "o", 0x0D: "e"}
_INDIC_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x49: "o", 0x45: "e"}
_INDIC_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p f b bh m y r r l l l v sh sh s h".split()))
# Greek and Cyrillic letters in Latin letters, letter by letter.
_LETTERS = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "ks", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "h", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
_PLACEHOLDERS = frozenset({"", "null", "n/a", "na", "-", "--", "<null>", "none", "nil", "unknown", "."})
_GREEK_J = re.compile("(?<![bgdzklmnprstfhvyaeiou])i(?=[aeou])|(?<=[aeiou])i(?=[aeiou])")


def _indic(word: str) -> str:
    out: list[str] = []
    bare = False
    for ch in word:
        at = ord(ch) & 0x7F
        if at in _INDIC_CONSONANTS:
            if bare:
                out.append("a")
            out.append(_INDIC_CONSONANTS[at])
            bare = True
        elif at in _INDIC_SIGNS:
            out.append(_INDIC_SIGNS[at])
            bare = False
        elif at == 0x4D:
            bare = False
        else:
            if bare:
                out.append("a")
            bare = False
            out.append("n" if at in (0x01, 0x02) else "h" if at == 0x03 else _INDIC_VOWELS.get(at, ""))
    return "".join(out)


def latin(word: str) -> str:
    """A lower-case word in plain Latin letters; an Indic word loses its final inherent vowel."""
    if word.isascii():
        return word
    first = next((c for c in word if ord(c) > 0x24F), "")
    if first and 0x900 <= ord(first) < 0xE00:
        return _indic(word)
    base = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    out = base.replace("ου", "u") if first and 0x370 <= ord(first) < 0x400 else base
    out = "".join(_LETTERS.get(c, c) for c in out)
    if first and 0x370 <= ord(first) < 0x400:
        out = _GREEK_J.sub("j", out)
    return out


@lru_cache(maxsize=200_000)
def coarse(word: str) -> str:
    """What spellings in different scripts have in common: letters that some script merges are one letter."""
    w = word
    for a, b in (("x", "ks"), ("q", "k"), ("w", "v"), ("ph", "f"), ("ch", "K"), ("kh", "K"), ("sh", "s"), ("c", "k"), ("z", "j"), ("y", "j"), ("b", "v")):
        w = w.replace(a, b)
    w = w.replace("K", "kh")
    w = re.sub(r"(.)\1+", r"\1", w)
    return w[:-1] if len(w) > 3 and w.endswith("a") else w


@lru_cache(maxsize=200_000)
def phonetic(word: str) -> str:
    """Consonants of the coarse form: the blocking code."""
    return re.sub("[aeiouh]", "", coarse(word)) or coarse(word)[:2]


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two words; ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
        if min(row) > most:
            return most + 1
    return row[-1]


_TRADE_OF = {s: full for full, s in TRADES.items()} | {w.split()[0]: w for w in TRADES} | {"care": "", "lab": "laboratories"}
_TRADE_COARSE = {coarse(w.split()[0]): w for w in TRADES} | {coarse("care"): ""}
_TRADE_LONG = sorted({(w.split()[0], w) for w in TRADES if len(w.split()[0]) >= 4})
_LEGAL_LONG = sorted(w for w in LEGAL if len(w) >= 5)
#: A word of syllables is a proper name rather than a mistyped short form.
_SYLLABLES = re.compile("(?:[bdfghjklmnprstvwyz][aeiou])+.?")
_KIND_RANK = {"trade": 0, "legal": 1, "care": 2, "short": 3}


def _less(word: str, times: int) -> set[str]:
    """The word and its forms with up to ``times`` letters left out."""
    out, last = {word}, {word}
    for _ in range(times):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


_NEAR: dict[str, list[tuple[str, str, str]]] = {}
for _w, _kind, _full in [*((w, "trade", f) for w, f in _TRADE_LONG), *((w, "legal", w) for w in _LEGAL_LONG), ("care", "care", ""), *((s, "short", f) for s, f in _TRADE_OF.items() if len(s) >= 4 and f and s in TRADES.values())]:
    for _k in _less(_w, 2 if _kind == "trade" and len(_w) >= 9 else 1):
        _NEAR.setdefault(_k, []).append((_w, _kind, _full))


def _neighbours(word: str) -> set[tuple[str, str, str]]:
    """Known words that can be within the allowed number of errors: they share a form with letters left out."""
    return {x for k in _less(word, 2 if 7 <= len(word) <= 16 else 1) for x in _NEAR.get(k, ())}
_LEGAL_COARSE = frozenset(coarse(w) for w in LEGAL if len(w) >= 3) | {"lp", "svt", "svt", "and"}


@lru_cache(maxsize=300_000)
def _classify(word: str, exact: bool) -> tuple[str, str]:
    """("legal" | "trade" | "own", canonical form) of one Latin word. ``exact``: no allowance for typing errors."""
    if word in LEGAL:
        return "legal", word
    if word in _TRADE_OF:
        return "trade", _TRADE_OF[word]
    c = coarse(word)
    if c in _TRADE_COARSE:
        return "trade", _TRADE_COARSE[c]
    if c in _LEGAL_COARSE:
        return "legal", word
    if exact:
        return "own", word
    best = None
    for w, kind, full in _neighbours(word):
        allowed = 2 if kind == "trade" and len(w) >= 9 else 1
        d = edits(word, w, allowed)
        if d > allowed or (kind == "short" and (word[0] != w[0] or _SYLLABLES.fullmatch(word))):
            continue
        rank = (_KIND_RANK[kind], d, w)
        if best is None or rank < best[0]:
            best = (rank, kind, full)
    if best:
        return ("legal", best[2]) if best[1] == "legal" else ("trade", best[2])
    return "own", word


@dataclass(frozen=True)
class Name:
    """A business name taken apart: own words in order, those cut short with a full stop, and the line of trade."""

    own: tuple[str, ...]
    cut: tuple[bool, ...]
    trade: str
    foreign: bool


_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ॣ॰-෿]+[^\W\d_]*)*\.?")
_INITIALS = re.compile(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?|\bm/s\b\.?")


def parse(name: str | None) -> Name | None:
    """The parts of a name; None for NULL, empty text, placeholders and names without a word of their own."""
    if name is None:
        return None
    text = plain(name).strip().lower()
    if text in _PLACEHOLDERS:
        return None
    text = _INITIALS.sub(" ", text)
    rows: list[tuple[str, bool]] = []
    foreign = False
    for raw in re.findall(r"[^\s,;/&()\-–]+", text):
        stop = raw.endswith(".")
        word = raw.strip(".'\"")
        if not word:
            continue
        if not word.isascii():
            forms = word_forms(word)
            if forms and any(ord(c) < 0x250 for c in word):
                word = forms[0]
            else:
                foreign |= any(ord(c) >= 0x370 for c in word)
        word = re.sub("[^a-z]", "", latin(word))
        if word:
            rows.append((word, stop))
    kinds = [_classify(w, True) for w, _ in rows]
    trade = next((full for k, full in kinds if k == "trade" and full), "")
    # Typing errors in the trade or the legal form are looked for only behind the first word and never at the cost of all own words.
    n_own = sum(k == "own" for k, _ in kinds)
    for i in range(len(rows) - 1, -1, -1):
        w, stop = rows[i]
        if kinds[i][0] != "own" or n_own < 2 or len(w) < 4:
            continue
        k, full = _classify(w, False)
        if k == "legal" or (k == "trade" and (not trade or not full or full == trade)):
            kinds[i] = (k, full)
            trade = trade or (full if k == "trade" else "")
            n_own -= 1
    own = [(w, stop and len(w) < 7) for (w, stop), (k, _) in zip(rows, kinds) if k == "own"]
    for i in range(len(own) - 1):
        if (own[i][0], own[i + 1][0]) == ("jean", "baptiste"):  # one given name of two words
            own[i : i + 2] = [("jeanbaptiste", False)]
            break
    if not own:
        return None
    return Name(tuple(w for w, _ in own), tuple(s for _, s in own), trade, foreign)


#: Below STRONG, a match rests on a shortened word or a missing line of trade, which may fit several names.
STRONG, WEAK = 0.86, 0.85
#: Jaro-Winkler similarity from which two words of four letters and more are spellings of one.
JW_LEAST = 0.92


def word_match(a: str, b: str, cut: bool, foreign: bool) -> float:
    """How well two own words agree: 1 equal, down to 0 for different words."""
    if a == b:
        return 1.0
    x, y = _FORMAL.get(a), _FORMAL.get(b)
    if x and y and x & y:
        return 0.97
    if cut and (a.startswith(b) or b.startswith(a)):
        return WEAK
    ca, cb = coarse(a), coarse(b)
    if foreign and ca == cb:
        return 0.97
    short = min(len(a), len(b))
    if short <= 3:
        return WEAK if (a.startswith(b) or b.startswith(a)) and max(len(a), len(b)) >= 5 else 0.0
    # Few errors count at any place; Jaro-Winkler, which makes much of the first letters, accepts more of them.
    jw = jaro_winkler(ca if foreign else a, cb if foreign else b)
    most = 1 if short < 9 else 2
    if jw >= JW_LEAST or edits(a, b, most) <= most or (foreign and edits(ca, cb, 1) <= 1):
        return max(STRONG, 0.95 * jw)
    return 0.0


def same_name(a: Name, b: Name) -> float:
    """Confidence that two names are spellings of one business's name; 0 if not.

    The line of trade must agree unless one side has none. Own words are paired in the best order; each pair must
    agree as equal, familiar form, shortened or mistyped word. Words run together count as their parts together.
    """
    if a.trade != b.trade and a.trade and b.trade:
        return 0.0
    foreign = a.foreign != b.foreign
    full = 1.0 if a.trade == b.trade else WEAK
    m, n = len(a.own), len(b.own)
    if m == n and m <= 3:
        orders = _ORDERS[m]
        best = 0.0
        for o in orders:
            s = 1.0
            weak = 0
            for i, j in enumerate(o):
                w = word_match(a.own[i], b.own[j], a.cut[i] or b.cut[j], foreign)
                s = min(s, w)
                weak += w < 0.95
                if not w or (weak > 1 and m > 1 and s < STRONG):
                    s = 0.0
                    break
            best = max(best, s)
        if best:
            return best * full
    if m == n and m > 3 and (best := _paired(a, b, foreign)):
        return best * full
    if m != n or m == 1:
        x, y = "".join(a.own), "".join(b.own)
        options = {x} | ({"".join(reversed(a.own))} if m == 2 else set())
        others = {y} | ({"".join(reversed(b.own))} if n == 2 else set())
        for p in options:
            for q in others:
                most = 1 if min(len(p), len(q)) < 12 else 2
                if len(p) >= 6 and len(q) >= 6:
                    if edits(p, q, most) <= most:
                        return (0.97 if p == q else 0.9) * full
                    if foreign and edits(coarse(p), coarse(q), 1) <= 1:
                        return 0.9 * full
    return 0.0


def _paired(a: Name, b: Name, foreign: bool) -> float:
    """``same_name`` of the own words of two names with equally many, by the rule for few words: equal words are paired first, the rest in the best order."""
    left, right = list(range(len(a.own))), list(range(len(b.own)))
    for i in range(len(a.own)):
        if j := [j for j in right if b.own[j] == a.own[i]]:
            left.remove(i)
            right.remove(j[0])
    # Best least agreement by the words of b taken and the number of pairs under 0.95.
    states = {(frozenset(), 0): 1.0}
    for i in left:
        after: dict[tuple[frozenset[int], int], float] = {}
        for j in right:
            if w := word_match(a.own[i], b.own[j], a.cut[i] or b.cut[j], foreign):
                for (taken, weak), s in states.items():
                    k, t = (taken | {j}, weak + (w < 0.95)), min(s, w)
                    if j not in taken and not (k[1] > 1 and t < STRONG):
                        after[k] = max(after.get(k, 0.0), t)
        states = after
    return max(states.values(), default=0.0)


def likeness(a: Name, b: Name) -> float:
    """Loose resemblance of two names, 0 to 1, for records that other evidence already ties together.

    The weakest word of the best order by Jaro-Winkler, or that of all letters run together with the line of trade.
    """
    foreign = a.foreign != b.foreign
    form = coarse if foreign else str
    m, n = len(a.own), len(b.own)
    best = 0.0
    if m == n and m <= 3:
        for o in _ORDERS[m]:
            s = 1.0
            for i, j in enumerate(o):
                x, y = a.own[i], b.own[j]
                w = WEAK if (min(len(x), len(y)) <= 5 and (x.startswith(y) or y.startswith(x))) else jaro_winkler(form(x), form(y))
                s = min(s, max(w, word_match(x, y, a.cut[i] or b.cut[j], foreign)))
            best = max(best, s)
    if m != n or not a.trade or not b.trade:
        x, y = "".join(map(form, a.own)), "".join(map(form, b.own))
        best = max(best, jaro_winkler(x, y), jaro_winkler(x + a.trade, y + b.trade))
    return best


_ORDERS = {1: [(0,)], 2: [(0, 1), (1, 0)], 3: [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]}


def shortened(n: Name) -> bool:
    """Whether a name may stand for several full names: a word is cut short or the line of trade is missing."""
    return not n.trade or any(n.cut) or any(len(w) <= 3 for w in n.own)


def block_keys(n: Name) -> list[str]:
    """Codes under which spellings of one name meet: first and last sounds of the words in typed and reversed order.
    Three words and more also meet by their sorted codes, all of them and with each one left out, whatever their order.

    A typing error touches the first or the last sounds, not both; a word run together keeps both; a familiar
    form or a shortened word leaves the other word's. Formal names stand in for familiar ones.
    """
    formal = [sorted(_FORMAL[w])[0] if w in _FORMAL and len(_FORMAL[w]) == 1 else w for w in n.own]
    codes = [phonetic(w) for w in formal]
    out, brief = set(), shortened(n)
    orders = [codes, codes[::-1]]
    if len(codes) > 2:
        by_code = sorted(codes)
        orders += [by_code, *(by_code[:i] + by_code[i + 1 :] for i in range(len(by_code)))]
    for order in orders:
        s = "".join(order)
        # Four sounds of long codes, three of short ones; codes between, and shortened names, meet both.
        for k in (3, 4) if len(s) == 9 or brief else (4,) if len(s) > 9 else (3,):
            out |= {f"F{s[:k]}", f"L{s[-k:]}"}
    return sorted(out)


def formal_names(word: str) -> list[str]:
    """Formal given names that a word stands for."""
    return sorted(_FORMAL.get(word, ()))


def whole_codes(n: Name) -> list[str]:
    """Sounds of all words together with the line of trade, in the name's order and reversed: equal for words run together or swapped."""
    codes = [phonetic(sorted(_FORMAL[w])[0] if w in _FORMAL and len(_FORMAL[w]) == 1 else w) for w in n.own]
    return sorted({"".join(codes) + "|" + n.trade, "".join(codes[::-1]) + "|" + n.trade})
