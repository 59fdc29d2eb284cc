"""Suffix-stripping stemmer (Porter 1980 with the usual later extensions), used
for ROUGE token stemming: irregular words, short ``-ies`` / ``-ied``, ``y`` to
``i`` only after a consonant, ``-bli``, ``-fulli``, ``-logi`` and repeated
``-alli``.
"""

from __future__ import annotations

_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in the stem."""
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        while i < L and _cons(stem, i):
            i += 1
        n += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) == 2:
        return not _cons(w, 0) and _cons(w, 1)
    return (len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, suffix: str, repl: str, cond) -> tuple[str, bool]:
    if w.endswith(suffix):
        stem = w[: len(w) - len(suffix)]
        if cond(stem):
            return stem + repl, True
        return w, True
    return w, False


# Suffix rules of steps 2-4 (fixed values of the algorithm).
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


# Words that the rules would spoil (fixed values).
_IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
              "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
              "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
              "exceed": "exceed", "succeed": "succeed"}


def _step2(w: str) -> str:
    if w.endswith("alli") and _m(w[:-4]) > 0:
        return _step2(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _m(w[:-3]) > 0 else w
    for suf, rep in _STEP2:
        w2, hit = _replace(w, suf, rep, lambda s: _m(s) > 0)
        if hit:
            return w2
    return w


def stem(word: str) -> str:
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        w = w[:-1] + "i"
    w = _step2(w)
    # step 3
    for suf, rep in _STEP3:
        w2, hit = _replace(w, suf, rep, lambda s: _m(s) > 0)
        if hit:
            w = w2
            break
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            s = w[: len(w) - len(suf)]
            if suf == "ion":
                if _m(s) > 1 and s and s[-1] in "st":
                    w = s
            elif _m(s) > 1:
                w = s
            break
    # step 5a
    if w.endswith("e"):
        s = w[:-1]
        m = _m(s)
        if m > 1 or (m == 1 and not _cvc(s)):
            w = s
    # step 5b
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w
