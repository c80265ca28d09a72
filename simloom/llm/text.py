"""Canonical text: look-alike folding, content tokens and transliteration.

Shared by the operators of this subpackage.  Rules, in the order in which they act:

* characters that look the same become one character (``canon``),
* bracketed notes, shad and the kind or amount of spacing vanish (``content_tokens``),
* case is kept: in the transliteration capitals are letters of their own.

Every function returns a defined value for None (no text) and for empty text: no tokens.
"""

from __future__ import annotations

import re
import unicodedata

import xxhash

# Letters of other alphabets whose usual shape is that of a Latin letter.
CONFUSABLE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ɡ": "g", "ı": "i", "ɑ": "a",
    "ʼ": "'", "‘": "'", "’": "'", "′": "'", "ʹ": "'", "ʻ": "'", "‛": "'", "ʾ": "'", "“": '"', "”": '"', "″": '"', "‐": "-", "‑": "-", "‒": "-", "−": "-",
    "⁄": "/", "∕": "/", "ཪ": "ར", "༌": "་", "ༀ": "ཨོཾ", "༎": "།།", "ྰ": "ཱ", "ྺ": "ྭ", "ྻ": "ྱ", "ྼ": "ྲ",
}

#: Blocks whose code points take part: Latin to Cyrillic, Tibetan, Latin additions, punctuation, letterlike, wide forms.
BLOCKS = ((0x00A0, 0x0530), (0x0F00, 0x0FDB), (0x1E00, 0x2070), (0x212A, 0x212C), (0x3000, 0x3001), (0xFE00, 0xFE10), (0xFEFF, 0xFF00), (0xFF01, 0xFFEF))
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>")


def invisible(c: str) -> bool:
    """Format characters and variation selectors: nothing is drawn for them."""
    return unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c == "͏"


def alike_pairs() -> list[tuple[str, str]]:
    """Pairs of strings that are drawn alike, by rule from the character database, and the fixed values above.

    The second member may be empty (invisible characters) or longer than one character (decomposed accents).
    """
    pairs = list(CONFUSABLE.items())
    for first, last in BLOCKS:
        for c in map(chr, range(first, last)):
            parts = unicodedata.decomposition(c)
            if invisible(c):
                pairs.append((c, ""))
            elif unicodedata.category(c) == "Zs":
                pairs.append((c, " "))
            elif parts and (not parts.startswith("<") or parts.split()[0] in SAME_SHAPE):
                pairs.append((c, unicodedata.normalize("NFD", c) if parts[0] != "<" else unicodedata.normalize("NFKC", c)))
    return [(a, b) for a, b in pairs if a != b]


def _table() -> dict[str, str]:
    """Look-alike string to the plain form (composed where Unicode has a composed form)."""
    table = {}
    for a, b in alike_pairs():
        composed = unicodedata.normalize("NFC", b)
        if composed != a:
            table[a] = composed
    while True:  # a target may hold look-alikes of its own
        flat = {a: unicodedata.normalize("NFC", "".join(table.get(c, c) for c in b)) for a, b in table.items()}
        if flat == table:
            return table
        table = flat


TABLE = _table()
_CODES = {ord(a): b for a, b in TABLE.items()}
_COMBINING = "̀-ͯ"
_DIRTY = re.compile("[" + "".join(re.escape(c) for c in sorted(TABLE)) + _COMBINING + "]")
_REORDER = re.compile("[ིེུ-ཽཾྀ][ཱིུ]")
NOTE = re.compile(r"\[.*?\]", re.S)
_SHAD = re.compile("[/།༎༏༐༑༔|་\\s]+")


def canon(s: str | None) -> str | None:
    """One form for all strings that look alike; plain strings pass through untouched."""
    if s is None or s.isascii():
        return s
    if _DIRTY.search(s) or _REORDER.search(s):
        while (t := unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).translate(_CODES))) != s:
            s = t
    return s


def content_tokens(s: str | None) -> list[str]:
    """Syllables of the content, in order: look-alikes folded, notes, shad and spacing removed."""
    if not s:
        return []
    if not s.isascii():
        s = canon(s)
        if "་" in s or "།" in s:
            s = s.replace("་", " ").replace("།", " ")
    if "[" in s:
        s = NOTE.sub(" ", s)
    return (s.replace("/", " ") if not _RARE_SHAD.search(s) else _SHAD.sub(" ", s)).split()


_RARE_SHAD = re.compile("[༎༏༐༑༔|]")
# What stands where a text is missing.
PLACEHOLDERS = {"NOT_FOUND", "-", "--", "N/A", "NA", "None", "nan", "NaN", "null", "NULL", "?", "..."}


def real_tokens(s: str | None) -> list[str]:
    """As content_tokens, and none for placeholders and for text without any letter."""
    t = content_tokens(s)
    if len(t) <= 2 and (not t or " ".join(t) in PLACEHOLDERS or not any(c.isalpha() for x in t for c in x)):
        return []
    return t


def hash64(s: str) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(s.encode())
    return h - (1 << 64) if h >> 63 else h


class Elements:
    """Distinct 64-bit elements of a token multiset: the nth repeat of a token is an element of its own.

    Overlap of multisets is thereby the size of a set intersection. Hashes are kept for tokens seen before.
    """

    def __init__(self, limit: int = 200_000):
        self.known: dict[tuple[str, int] | str, int] = {}
        self.limit = limit

    def one(self, key: str) -> int:
        h = self.known.get(key)
        if h is None:
            if len(self.known) >= self.limit:  # bounded memory; only a cache
                self.known.clear()
            h = self.known[key] = hash64(key)
        return h

    def __call__(self, tokens: list[str]) -> list[int]:
        if len(set(tokens)) == len(tokens):
            return [self.one(t) for t in tokens]
        seen: dict[str, int] = {}
        out = []
        for t in tokens:
            n = seen.get(t, 0)
            seen[t] = n + 1
            out.append(self.one(f"{t}\x00{n}" if n else t))
        return out


# Transliteration. The letters of the standard Tibetan transliteration, and those used for loan words.
_LETTERS = {
    "k": "ཀ", "kh": "ཁ", "g": "ག", "ng": "ང", "c": "ཅ", "ch": "ཆ", "j": "ཇ", "ny": "ཉ", "t": "ཏ", "th": "ཐ", "d": "ད", "n": "ན", "p": "པ", "ph": "ཕ", "b": "བ", "m": "མ",
    "ts": "ཙ", "tsh": "ཚ", "dz": "ཛ", "w": "ཝ", "zh": "ཞ", "z": "ཟ", "'": "འ", "y": "ཡ", "r": "ར", "l": "ལ", "sh": "ཤ", "s": "ས", "h": "ཧ", "a": "ཨ",
    "T": "ཊ", "Th": "ཋ", "D": "ཌ", "N": "ཎ", "Sh": "ཥ", "v": "ཝ",
}
_VOWELS = {"a": "", "i": "ི", "u": "ུ", "e": "ེ", "o": "ོ", "A": "ཱ", "I": "ཱི", "U": "ཱུ", "ai": "ཻ", "au": "ཽ"}
_LOAN = {"ā": "A", "ī": "I", "ū": "U", "ś": "sh", "ṣ": "Sh", "ṭ": "T", "ḍ": "D", "ṇ": "N", "ṅ": "ng", "ñ": "ny", "ṃ": "M", "ṁ": "M"}
_HEAD = {"r": {"k", "g", "ng", "j", "ny", "t", "d", "n", "b", "m", "ts", "dz"}, "l": {"k", "g", "ng", "c", "j", "t", "d", "p", "b", "h"}, "s": {"k", "g", "ng", "ny", "t", "d", "n", "p", "b", "m", "ts"}}
_UNDER = {"y": {"k", "kh", "g", "p", "ph", "b", "m", "h"}, "r": {"k", "kh", "g", "t", "th", "d", "n", "p", "ph", "b", "m", "sh", "s", "h", "dz"}, "l": {"k", "g", "b", "z", "r", "s"}, "w": {"k", "kh", "g", "c", "ny", "t", "d", "ts", "tsh", "zh", "z", "r", "l", "sh", "s", "h"}}
_ENDS = re.compile(r"(g|ng|d|n|b|m|'|r|l|s)( s| d)?")
_CONSONANT = re.compile("tsh|Th|Sh|kh|ng|ch|ny|th|ph|ts|dz|zh|sh|[kgcjtdnpbmwz'yrlshvTDN]")
_SYLLABLE = re.compile(r"([^aeiouAIU]*)(a|i|u|e|o|A|I|U)(M?)(.*)", re.S)


def _consonants(s: str) -> list[str] | None:
    out, at = [], 0
    while at < len(s):
        if s[at] in "+.":
            out.append(s[at])
            at += 1
        elif m := _CONSONANT.match(s, at):
            out.append(m[0])
            at = m.end()
        else:
            return None
    return out


def _sub(c: str) -> str:
    return chr(ord(_LETTERS[c]) + 0x50)


def _onset(parts: list[str]) -> str | None:
    """The letters before the vowel, stacked as the orthography has it; h after + or a voiced stop is subjoined."""
    if "+" in parts:
        out, stacked = "", False
        for c in parts:
            if c == "+":
                stacked = True
            elif c == ".":
                return None
            else:
                out += _sub(c) if stacked else _LETTERS[c]
                stacked = False
        return out
    if "." in parts:
        if len(parts) == 3 and parts[1] == ".":
            return _LETTERS[parts[0]] + _LETTERS[parts[2]]
        return None
    if not parts:
        return "ཨ"
    if len(parts) == 2 and parts[1] == "h" and parts[0] in ("g", "d", "b"):
        return _LETTERS[parts[0]] + "ྷ"
    root = len(parts) - 1
    if root > 0 and parts[root] == "w" and parts[root - 1] in ("r", "y") and root > 1 and parts[root - 2] in _UNDER[parts[root - 1]]:
        root -= 2
    elif root > 0 and parts[root] in _UNDER and parts[root - 1] in _UNDER[parts[root]]:
        root -= 1
    head = root - 1 if root > 0 and parts[root - 1] in _HEAD and parts[root] in _HEAD[parts[root - 1]] else root
    if head > 1:
        return None
    out = _LETTERS[parts[0]] if head == 1 else ""
    return out + _LETTERS[parts[head]] + "".join(_sub(c) for c in parts[head + 1 :])


def to_script(token: str) -> str | None:
    """A transliterated syllable in Tibetan script; None if it isn't one."""
    if not token.isascii():
        token = "".join(_LOAN.get(c, c) for c in token)
        if not token.isascii():
            return None
    out, rest = "", token
    first = True
    while rest:
        m = _SYLLABLE.fullmatch(rest)
        if not m:
            tail = _consonants(rest)
            if first or tail is None or not _ENDS.fullmatch(" ".join(tail)):
                return None
            return out + "".join(_LETTERS[c] for c in tail)
        before, vowel, mark, rest = m.groups()
        parts = _consonants(before)
        if parts is None:
            return None
        if not first:  # 'i, 'u, 'o and the like after the end of the syllable
            if not parts or parts[-1] != "'" or "+" in parts or "." in parts:
                return None
            onset = "".join(_LETTERS[c] for c in parts)
        elif (onset := _onset(parts)) is None:
            return None
        out += onset + _VOWELS[vowel] + ("ཾ" if mark else "")
        first = False
    return out


class Common:
    """Tokens of either script in one space: transliterated syllables are put in Tibetan script, others stay."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, str] = {}
        self.limit = limit

    def one(self, t: str) -> str:
        c = self.known.get(t)
        if c is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            c = self.known[t] = t if "ༀ" <= t[0] <= "࿿" else to_script(t) or t
        return c

    def __call__(self, tokens: list[str]) -> list[str]:
        known = self.known
        return [known.get(t) or self.one(t) for t in tokens]


_PLAIN = re.compile(r"[a-z'.]+|(?=.*(?:\+|[gdb]h))[a-zAIUS'.+h]+M?|oM|(?=.*[āīū])(?!.*(?:sh|w|[gdb]h|\+))[a-zāīūśṭṇ']+ṃ?")


class CommonOneToOne(Common):
    """As Common, but no two tokens of one script meet: of several spellings of a syllable only the usual one is mapped."""

    def one(self, t: str) -> str:
        c = self.known.get(t)
        if c is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            c = t if "ༀ" <= t[0] <= "࿿" else (to_script(t) if _PLAIN.fullmatch(t) else None) or "\x01" + t
            self.known[t] = c
        return c
