"""The English Snowball stemmer (Porter2), from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPT = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        m = _REGION.search(w, start)
        return m.end() if m else len(w)

    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def _vowel(w: str) -> bool:
    return any(c in _V for c in w)


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _EXCEPT:
        return _EXCEPT[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _vowel(w[:-2]):
        w = w[:-1]
    if w in _STAY:
        return w
    # past and progressive
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(s):
            continue
        base = w[: -len(s)]
        if s in ("eed", "eedly"):
            if len(base) >= r1:
                w = base + "ee"
        elif _vowel(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r1:
                if s == "ogi":
                    w = base + "og" if base.endswith("l") else w
                elif s == "li":
                    w = base if base[-1:] and base[-1] in "cdeghkmnrt" else w
                else:
                    w = base + _STEP2[s]
            break
    for s in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r1:
                if s == "ative":
                    w = base if len(base) >= r2 else w
                else:
                    w = base + _STEP3[s]
            break
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r2 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or len(base) >= r1 and not _short_end(base):
            w = base
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
