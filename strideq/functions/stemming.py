"""The English (Porter 2) stemmer, from its published definition."""

from __future__ import annotations

import re
from functools import lru_cache

from strideq.functions.romance_german import french, german, spanish

_V = "aeiouy"
#: Words with stems of their own, and words left as they are.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_FIXED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes and what stands for them, longest first, by step.
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(w: str, start: int) -> int:
    m = re.compile(rf"[{_V}][^{_V}]").search(w, start)
    return m.end() if m else len(w)


def _short(w: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(rf"[{_V}][^{_V}]", w))


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("’", "'").lower()
    if len(w) <= 2:
        return w
    w = w.lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _FIXED:
        return w
    w = re.sub(rf"^y|(?<=[{_V}])y", "Y", w)
    prefix = re.match(r"gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1].startswith("eed"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(rf"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif len(w) <= r1 and _short(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for end, to in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    # 3
    for end, to in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + to
            break
    # 4
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


STEMMERS = {"english": english, "en": english, "german": german, "de": german, "french": french, "fr": french, "spanish": spanish, "es": spanish}
