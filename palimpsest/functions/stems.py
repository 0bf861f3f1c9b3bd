"""English stems (the published Porter2 rules), a small helper for tables of distinct words."""

from __future__ import annotations

import re

#: Words that a stemmed index leaves out.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

#: Fixed values of the rules: whole words, step 0 to 4 endings.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset(["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"])
_DONE_EARLY = frozenset(["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in _SAME:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)  # a consonant there
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _DONE_EARLY:
        return w
    # -ed and -ing
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # endings that become shorter ones
    for e, to in _STEP2:
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r1 and (e != "ogi" or w[at - 1 : at] == "l") and (e != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for e, to in _STEP3:
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= (r2 if e == "ative" else r1):
                w = w[:at] + to
            break
    for e in _STEP4:
        if w.endswith(e):
            at = len(w) - len(e)
            if at >= r2 and (e != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # a last e or l
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT_END.search(w[:-1]))) or (w.endswith("ll") and at >= r2):
        w = w[:-1]
    return w.replace("Y", "y")
