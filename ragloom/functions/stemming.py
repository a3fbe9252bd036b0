"""M6, M7: the suffix-stripping stemmer that the overlap metrics apply to words of more than three letters.

Rules are tables of endings with the condition on what stands before them. It follows the extended form of the algorithm: a table of
irregular words, short words in ``ies`` and ``ied``, ``y`` after a consonant only, and ``alli``, ``fulli`` and ``logi``.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Irregular words by their stem.
IRREGULAR = {
    "sky": "sky skies", "die": "dying", "lie": "lying", "tie": "tying", "news": "news", "inning": "innings inning", "outing": "outings outing",
    "canning": "cannings canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
IRREGULAR_WORDS = {w: stem for stem, words in IRREGULAR.items() for w in words.split()}
# Endings of the second, third and fourth step, and what takes their place.
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; ``y`` is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y; two letters: vowel, consonant."""
    shape = _shape(word)
    return (len(word) >= 3 and shape[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    stem = next((w[: -len(end)] for end in ("ed", "ing") if w.endswith(end) and "v" in _shape(w[: -len(end)])), None)
    if stem is None:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-4] + "al")
    for end, new in SECOND:
        if w.endswith(end):
            stem = w[: -len(end)]
            # "logi" counts its own l
            return stem + new if _measure(stem + "l" if end == "logi" else stem) > 0 else w
    return w


def _third(w: str) -> str:
    for end, new in THIRD:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w


def _fourth(w: str) -> str:
    for end in FOURTH:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else w
    return w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """A lower-case word's stem; words of one or two letters stay."""
    if word in IRREGULAR_WORDS:
        return IRREGULAR_WORDS[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _fourth(_third(_second(w)))
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not _short(w[:-1])) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
