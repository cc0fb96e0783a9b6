"""Reading order of a line that is drawn from left to right and has right-to-left letters in it.

Three patterns over the line's characters do it: which strong letters there are (for the direction of the line), which
stretches run from right to left, and which islands in such a stretch keep their order: words of other scripts and numbers
with their signs. A stretch is turned by taking islands whole and everything else letter by letter, last first.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

#: The blocks of right-to-left letters, digits (of Latin and of Arabic), what joins two numbers, and the signs, besides
#: those of currencies, that belong to the number they stand at.
RIGHT = r"\u0590-\u065f\u066d-\u06ef\u06fa-\u08ff\ufb1d-\ufdff\ufe70-\ufefc"
DIGIT = r"0-9\u0660-\u0669\u066b\u066c\u06f0-\u06f9"
JOINT = r"[.,:/\-+]"
SIGN = r"[#%\u00b0\u00b1\u2030-\u2033\p{Sc}]"

_LEFT = rf"(?:(?![{RIGHT}])[\p{{L}}\p{{M}}])"
#: From a left-to-right word on, everything up to the last word or number before a right-to-left letter.
_WORDS = rf"{_LEFT}(?:[^{RIGHT}]*(?:{_LEFT}|[{DIGIT}]))?"
ISLAND = regex.compile(rf"(?:{SIGN}(?=[0-9]))?(?:[{DIGIT}]+(?:{JOINT}[{DIGIT}]+)*(?:{_WORDS})?|{_WORDS})(?:(?<=[0-9]){SIGN})?|.", regex.DOTALL)
STRETCH = regex.compile(rf"[{RIGHT}](?:(?!{_LEFT}).)*[{RIGHT}]|[{RIGHT}]", regex.DOTALL)
STRONG = regex.compile(rf"(?P<R>[{RIGHT}])|{_LEFT}")
BRACKET = regex.compile(r"[()\[\]{}]")
MIRROR = str.maketrans("()[]{}", ")(][}{")
LONGEST = 16_384


@lru_cache(maxsize=1)
def forms() -> dict[int, str]:
    """Presentation forms and the letters they stand for, by compatibility decomposition; ligatures' letters as they come."""
    out = {}
    for cp in (*range(0xFB1D, 0xFE00), *range(0xFE70, 0xFEFD)):
        plain = unicodedata.normalize("NFKC", chr(cp))
        if plain != chr(cp) and unicodedata.category(chr(cp)) != "Cn":
            out[cp] = plain
    return out


def plain(text: str) -> str:
    return text.translate(forms()) if any("\ufb1d" <= ch <= "\ufefc" for ch in text) else text


def runs_right(line: str) -> bool | None:
    """Whether the line as a whole is read from the right: as its first and last letters agree, else as most do. None: it has no such letters."""
    votes = [m.lastgroup == "R" for m in STRONG.finditer(line)]
    if not any(votes):
        return None
    return votes[0] if votes[0] == votes[-1] else 2 * sum(votes) >= len(votes)


def turned(stretch: str) -> str:
    """A right-to-left stretch in reading order; brackets are mirrored where the first one would close."""
    out = "".join(ISLAND.findall(stretch)[::-1])
    first = BRACKET.search(out)
    return out.translate(MIRROR) if first and first[0] in ")]}" else out


def logical(line: str) -> str:
    if len(line) > LONGEST or len(line.encode("utf-8", "surrogatepass")) > LONGEST:
        return line
    right = runs_right(line)
    if right is None:
        return line
    return plain(turned(line) if right else STRETCH.sub(lambda m: turned(m[0]), line))
