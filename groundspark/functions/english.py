"""English analysis of texts and web-style queries: tokens, stop words, the Porter2 stemmer as published, query grammar.

The stemmer's suffix rules are tables, read by ``stem`` and by ``stem_sql`` (the same stemmer over a table
of words in SQL, which the oracles use).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: English stop words of the lexical analysis, fixed values.
STOP = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split())

# The Porter2 algorithm's tables.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

V, NOT_V = "[aeiouy]", "[^aeiouy]"
REGION = f"^{NOT_V}*{V}+{NOT_V}"
REGION_AFTER = "^(?:gener|commun|arsen)"
SHORT_END = f"(?:{NOT_V}{V}[^aeiouywxY]|^{V}{NOT_V})$"
_FIRST = re.compile(f"{REGION_AFTER}|{REGION}")
_NEXT = re.compile(REGION)
_SHORT = re.compile(SHORT_END)
_VOWEL = re.compile(V)
#: What must stand before a suffix for it to go.
BEFORE = {"ogi": "l$", "li": "[cdeghkmnrt]$", "ion": "[st]$"}


_STEPS = tuple((table, tuple(table)) for table in (STEP2, STEP3))
_Y = re.compile(f"({V})y")


def _suffix(w: str, ends: tuple[str, ...]) -> str | None:
    return next(s for s in ends if w.endswith(s)) if w.endswith(ends) else None  # longest first


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """The Porter2 stem of a word in lower case."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = _Y.sub(r"\1Y", "Y" + word[1:] if word[0] == "y" else word) if "y" in word else word
    m = _FIRST.match(w)
    one = m.end() if m else len(w)
    m = _NEXT.match(w[one:])
    two = one + m.end() if m else len(w)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w
    # Past and progressive forms.
    end = _suffix(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= one:
            w = w[: len(w) - len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif one >= len(w) and _SHORT.search(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for table, ends in _STEPS:
        end = _suffix(w, ends)
        if end is not None and len(w) - len(end) >= (two if end == "ative" else one):
            rest = w[: len(w) - len(end)]
            if end not in BEFORE or re.search(BEFORE[end], rest):
                w = rest + table[end]
    end = _suffix(w, STEP4)
    if end is not None and len(w) - len(end) >= two and (end not in BEFORE or re.search(BEFORE[end], w[: -len(end)])):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= two or (len(w) - 1 >= one and not _SHORT.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_sql(words: str) -> str:
    """WITH-clauses for DuckDB: ``stems`` (w, stem) of the table ``words`` (w)."""
    ends = lambda s: f"ends_with(x, '{s}')"
    cut = lambda s: f"x[:-{len(s) + 1}]" if s else "x"
    short = lambda x: f"regexp_matches({x}, '{SHORT_END}')"

    def table(rules: dict, region) -> str:
        whens = []
        for s, to in rules.items():
            fits = f"length(x) - {len(s)} >= {region(s)}" + (f" AND regexp_matches({cut(s)}, '{BEFORE[s]}')" if s in BEFORE else "")
            whens.append(f"WHEN {ends(s)} THEN CASE WHEN {fits} THEN {cut(s)} || '{to}' ELSE x END")
        return f"CASE {' '.join(whens)} ELSE x END"

    steps = [
        f"CASE WHEN {ends('sses')} THEN x[:-3] WHEN {ends('ied')} OR {ends('ies')} THEN CASE WHEN length(x) > 4 THEN x[:-3] ELSE x[:-2] END WHEN {ends('us')} OR {ends('ss')} THEN x WHEN {ends('s')} AND regexp_matches(x[:-3], '{V}') THEN x[:-2] ELSE x END",
    ]
    after = lambda s: f"""CASE WHEN regexp_matches({cut(s)}, '(at|bl|iz)$') THEN {cut(s)} || 'e' WHEN regexp_matches({cut(s)}, '({"|".join(DOUBLES)})$') THEN {cut(s + 'x')} WHEN one >= length({cut(s)}) AND {short(cut(s))} THEN {cut(s)} || 'e' ELSE {cut(s)} END"""
    past = lambda s: f"WHEN {ends(s)} THEN CASE WHEN regexp_matches({cut(s)}, '{V}') THEN {after(s)} ELSE x END"
    steps.append("CASE WHEN done THEN x " + f"WHEN {ends('eedly')} THEN CASE WHEN length(x) - 5 >= one THEN {cut('eedly')} || 'ee' ELSE x END {past('ingly')} {past('edly')} WHEN {ends('eed')} THEN CASE WHEN length(x) - 3 >= one THEN {cut('eed')} || 'ee' ELSE x END {past('ing')} {past('ed')} ELSE x END")
    steps.append(f"CASE WHEN NOT done AND length(x) > 2 AND regexp_matches(x, '{NOT_V}[yY]$') THEN x[:-2] || 'i' ELSE x END")
    for own in (STEP2, STEP3, dict.fromkeys(STEP4, "")):
        steps.append(f"CASE WHEN done THEN x ELSE {table(own, lambda s, own=own: 'two' if s == 'ative' or own.keys() == set(STEP4) else 'one')} END")
    steps.append(f"CASE WHEN NOT done AND ({ends('e')} AND (length(x) - 1 >= two OR (length(x) - 1 >= one AND NOT {short('x[:-2]')})) OR {ends('ll')} AND length(x) - 1 >= two) THEN x[:-2] ELSE x END")
    kept = ", ".join(f"'{w}'" for w in KEPT_AFTER_PLURAL)
    whole = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in WHOLE.items()) + "}"
    out = f"""sx0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '({V})y', '\\1Y', 'g') AS x FROM {words}),
        sx1 AS (SELECT w, x, CASE WHEN regexp_matches(x, '{REGION_AFTER}|{REGION}') THEN length(regexp_extract(x, '{REGION_AFTER}|{REGION}')) ELSE length(x) END AS one FROM sx0),
        sx2 AS (SELECT w, x, one, CASE WHEN regexp_matches(x[one + 1:], '{REGION}') THEN one + length(regexp_extract(x[one + 1:], '{REGION}')) ELSE length(x) END AS two, false AS done FROM sx1)"""
    for k, step in enumerate(steps, 3):
        done = f"({step}) IN ({kept})" if k == 3 else "done"
        out += f",\n        sx{k} AS (SELECT w, one, two, {done} AS done, {step} AS x FROM sx{k - 1})"
    return f"{out},\n        stems AS (SELECT w, CASE WHEN length(w) < 3 THEN w ELSE coalesce({whole}[w], replace(x, 'Y', 'y')) END AS stem FROM sx{len(steps) + 2})"


TOKEN = re.compile(r"[^\W_]+")


def analysed(text: str | None) -> dict[str, list[int]]:
    """Stems of a text and where they stand. Stop words have places, but no stems."""
    at: dict[str, list[int]] = {}
    for p, w in enumerate(TOKEN.findall((text or "").lower())):
        if w not in STOP:
            at.setdefault(stem(w), []).append(p)
    return at


class Stems(dict):
    """Words and the numbers of their stems in ``names``; stop words have -1. It grows with the words that are looked up."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self.known: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        number = -1
        if word not in STOP:
            s = stem(word)
            number = self.known.setdefault(s, len(self.names))
            if number == len(self.names):
                self.names.append(s)
        self[word] = number
        return number

    def numbers(self, text: str | None) -> np.ndarray:
        """What ``analysed`` says of a text, as a number for each place."""
        words = TOKEN.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def parse_web_query(text: str | None) -> list[list[list[str]]]:
    """Alternatives of required phrases, as lists of stems; a word is a phrase of one. ``or`` separates alternatives, quotes make phrases; excluded words begin with "-" in the first place of their phrase; an empty stem stands for a stop word, which any word may take."""
    alternatives: list[list[list[str]]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', text or ""):
        raw = m[2] if m[3] is None else m[3]
        if m[3] is not None and raw.lower() == "or":
            alternatives.append([])
            continue
        minus = m[1] == "-" or (m[3] is not None and raw.startswith("-"))
        stems = ["" if w in STOP else stem(w) for w in TOKEN.findall(raw.lower())]
        while stems and not stems[-1]:
            stems.pop()
        while stems and not stems[0]:
            stems = stems[1:]
        if stems:
            alternatives[-1].append((["-"] if minus else []) + stems)
    return [a for a in alternatives if a]


def cover_density(alternatives: list[list[list[int]]], marks: list[int] | None = None, widths: list[list[int]] | None = None) -> float:
    """Cover density (Clarke, Cormack and Tudhope): each shortest stretch with all items of an alternative counts by the inverse of the places in it that hold no query word.

    ``alternatives``: for each, the places of each item (where a phrase begins); ``widths``: how many words an item has; ``marks``: all places of query words (default: those of the items).
    """
    ends: list[tuple[int, int, int, int]] = []
    for a, items in enumerate(alternatives):
        for k, places in enumerate(items):
            wide = widths[a][k] if widths else 1
            ends += [(p + wide - 1, p, a, k) for p in places]
    ends.sort()
    own = sorted({p for items in alternatives for places in items for p in places}) if marks is None else sorted(set(marks))
    rank = {p: k for k, p in enumerate(own)}
    last: list[dict[int, int]] = [{} for _ in alternatives]
    score, before, at = 0.0, -1, 0
    while at < len(ends):
        end = ends[at][0]
        while at < len(ends) and ends[at][0] == end:
            _, p, a, k = ends[at]
            last[a][k] = p
            at += 1
        begin = max((min(own_.values()) for own_, items in zip(last, alternatives, strict=True) if len(own_) == len(items) and items), default=-1)
        if begin > before:
            score += 0.1 / (1 + (end - begin) - (rank[end] - rank[begin]))
            before = begin
    return score


def match_score(alternatives: list[list[list[str]]], at: dict[str, list[int]]) -> float | None:
    """The cover density of a parsed query in a text whose stems stand ``at``; None: it doesn't match."""
    items, widths, used = [], [], set()
    places_of = {s: set(ps) for s, ps in at.items()}
    for phrases in alternatives:
        places, wide, fits = [], [], True
        for phrase in phrases:
            minus = phrase[0] == "-"
            stems = phrase[minus:]
            own = [p for p in at.get(stems[0], ()) if all(p + k in places_of.get(s, ()) for k, s in enumerate(stems) if s)]
            fits &= bool(own) != minus
            used.update(s for s in stems if s)
            if not minus:
                places.append(own)
                wide.append(len(stems))
        if fits and places:
            items.append(places)
            widths.append(wide)
    if not items:
        return None
    return cover_density(items, [p for s in used for p in at.get(s, ())], widths)  # places of other alternatives' words aren't noise either
