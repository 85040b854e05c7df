"""Snowball stemmers (T10), written from the published Snowball algorithm descriptions.

No stemming library is installed, so the English (Porter2) and French
algorithms are implemented here as plain functions on one word. They are
applied by a *vocabulary job*: distinct terms -> Arrow-batched pandas UDF ->
join back, so the Python cost scales with the vocabulary, not the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ==========================================================================
# English (Porter2)
# ==========================================================================

_EN_V = set("aeiouy")
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_LI = set("cdeghkmnrt")
# Exceptional forms of the published English algorithm.
_EN_EXC1 = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
            "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
            "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
            "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EN_EXC2 = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _en_regions(w: str) -> tuple[int, int]:
    def after_vc(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _EN_V and w[i - 1] in _EN_V:
                return i + 1
        return len(w)
    r1 = None
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    if r1 is None:
        r1 = after_vc(0)
    r2 = after_vc(r1) if r1 < len(w) else len(w)
    if r2 < r1:
        r2 = len(w)
    return r1, r2


def _en_short_syllable_end(w: str) -> bool:
    n = len(w)
    if n >= 3 and w[-1] not in _EN_V and w[-1] not in "wxY" and w[-2] in _EN_V and w[-3] not in _EN_V:
        return True
    return n == 2 and w[0] in _EN_V and w[1] not in _EN_V


def _en_has_vowel(s: str) -> bool:
    return any(c in _EN_V for c in s)


def stem_english(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    if w in _EN_EXC1:
        return _EN_EXC1[w]
    if w.startswith("'"):
        w = w[1:]
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = "".join("Y" if c == "y" and i > 0 and w[i - 1] in _EN_V else c for i, c in enumerate(w))
    r1, r2 = _en_regions(w)

    # step 0
    for suf in ("'s'", "'s", "'"):
        if w.endswith(suf):
            w = w[: -len(suf)]
            break
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ied") or w.endswith("ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("us") or w.endswith("ss"):
        pass
    elif w.endswith("s"):
        if _en_has_vowel(w[:-2]):
            w = w[:-1]
    if w in _EN_EXC2:
        return w
    # step 1b
    done = False
    for suf in ("eedly", "eed"):
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                w = w[: -len(suf)] + "ee"
            done = True
            break
    if not done:
        for suf in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suf):
                stem = w[: -len(suf)]
                if _en_has_vowel(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_EN_DOUBLES):
                        w = w[:-1]
                    elif _en_short_syllable_end(w) and r1 >= len(w):
                        w += "e"
                break
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    # step 2
    step2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
             ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
             ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
             ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
             ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
    for suf, rep in step2:
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ogi":
                    if w[-4:-3] == "l":
                        w = w[:-3] + rep
                elif suf == "li":
                    if w[-3:-2] in _EN_LI and len(w) >= 3:
                        w = w[:-2]
                else:
                    w = w[: -len(suf)] + rep
            break
    # step 3
    step3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"),
             ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
    for suf, rep in step3:
        if w.endswith(suf):
            if len(w) - len(suf) >= r1:
                if suf == "ative":
                    if len(w) - len(suf) >= r2:
                        w = w[: -len(suf)]
                else:
                    w = w[: -len(suf)] + rep
            break
    # step 4
    step4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
             "ous", "ive", "ize", "ion", "al", "er", "ic")
    for suf in step4:
        if w.endswith(suf):
            if len(w) - len(suf) >= r2:
                if suf == "ion":
                    if w[-4:-3] in ("s", "t") and len(w) >= 4:
                        w = w[:-3]
                else:
                    w = w[: -len(suf)]
            break
    # step 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _en_short_syllable_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# ==========================================================================
# French
# ==========================================================================

_FR_V = set("aeiouyâàëéêèïîôûù")


def _fr_mark(w: str) -> str:
    """Vowel-context markers: u/i between vowels, y next to a vowel, u after q -> upper case."""
    c = list(w)
    for i, ch in enumerate(c):
        prev = c[i - 1] if i > 0 else ""
        nxt = c[i + 1] if i + 1 < len(c) else ""
        if ch in "ui" and prev in _FR_V and nxt in _FR_V and prev and nxt:
            c[i] = ch.upper()
        elif ch == "y" and ((prev and prev in _FR_V) or (nxt and nxt in _FR_V)):
            c[i] = "Y"
        elif ch == "u" and prev == "q":
            c[i] = "U"
    return "".join(c)


def _fr_regions(w: str) -> tuple[int, int, int]:
    n = len(w)
    if n >= 2 and w[0] in _FR_V and w[1] in _FR_V:
        rv = 3
    elif w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = n
        for i in range(1, n):
            if w[i] in _FR_V:
                rv = i + 1
                break
    rv = min(rv, n)

    def after_vc(start: int) -> int:
        for i in range(start + 1, n):
            if w[i] not in _FR_V and w[i - 1] in _FR_V:
                return i + 1
        return n
    r1 = after_vc(0)
    r2 = after_vc(r1) if r1 < n else n
    return rv, r1, r2


def _ends(w: str, sufs):
    best = ""
    for s in sufs:
        if w.endswith(s) and len(s) > len(best):
            best = s
    return best


def stem_french(word: str) -> str:
    w = _fr_mark(word)
    rv, r1, r2 = _fr_regions(w)
    n0 = w
    step1_done = False
    altered = False

    def in_r(suf, region):
        return len(w) - len(suf) >= region

    # ---- step 1: standard suffixes
    s = _ends(w, ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes",
                  "ables", "istes", "atrice", "ateur", "ation", "atrices", "ateurs", "ations",
                  "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences",
                  "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux",
                  "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments"))
    if s in ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"):
        if in_r(s, r2):
            w = w[: -len(s)]
            step1_done = True
    elif s in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if in_r(s, r2):
            w = w[: -len(s)]
            step1_done = True
            if w.endswith("ic"):
                w = w[:-2] if in_r("ic", r2) else w[:-2] + "iqU"
    elif s in ("logie", "logies"):
        if in_r(s, r2):
            w = w[: -len(s)] + "log"
            step1_done = True
    elif s in ("usion", "ution", "usions", "utions"):
        if in_r(s, r2):
            w = w[: -len(s)] + "u"
            step1_done = True
    elif s in ("ence", "ences"):
        if in_r(s, r2):
            w = w[: -len(s)] + "ent"
            step1_done = True
    elif s in ("ement", "ements"):
        if in_r(s, rv):
            w = w[: -len(s)]
            step1_done = True
            if w.endswith("iv") and in_r("iv", r2):
                w = w[:-2]
                if w.endswith("at") and in_r("at", r2):
                    w = w[:-2]
            elif w.endswith("eus"):
                if in_r("eus", r2):
                    w = w[:-3]
                elif in_r("eus", r1):
                    w = w[:-3] + "eux"
            elif w.endswith(("abl", "iqU")):
                if in_r("abl", r2):
                    w = w[:-3]
            elif w.endswith(("ièr", "Ièr")):
                if in_r("ièr", rv):
                    w = w[:-3] + "i"
    elif s in ("ité", "ités"):
        if in_r(s, r2):
            w = w[: -len(s)]
            step1_done = True
            if w.endswith("abil"):
                w = w[:-4] if in_r("abil", r2) else w[:-4] + "abl"
            elif w.endswith("ic"):
                w = w[:-2] if in_r("ic", r2) else w[:-2] + "iqU"
            elif w.endswith("iv") and in_r("iv", r2):
                w = w[:-2]
    elif s in ("if", "ive", "ifs", "ives"):
        if in_r(s, r2):
            w = w[: -len(s)]
            step1_done = True
            if w.endswith("at") and in_r("at", r2):
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if in_r("ic", r2) else w[:-2] + "iqU"
    elif s == "eaux":
        w = w[:-1]
        step1_done = True
    elif s == "aux":
        if in_r(s, r1):
            w = w[:-3] + "al"
            step1_done = True
    elif s in ("euse", "euses"):
        if in_r(s, r2):
            w = w[: -len(s)]
            step1_done = True
        elif in_r(s, r1):
            w = w[: -len(s)] + "eux"
            step1_done = True
    elif s in ("issement", "issements"):
        if in_r(s, r1) and len(w) > len(s) and w[-len(s) - 1] not in _FR_V:
            w = w[: -len(s)]
            step1_done = True
    elif s == "amment":
        if in_r(s, rv):
            w = w[:-6] + "ant"
            altered = True
    elif s == "emment":
        if in_r(s, rv):
            w = w[:-6] + "ent"
            altered = True
    elif s in ("ment", "ments"):
        if in_r(s, rv) and len(w) > len(s) and w[-len(s) - 1] in _FR_V and len(w) - len(s) - 1 >= rv:
            w = w[: -len(s)]
            altered = True

    do_step2 = not step1_done or altered
    step2_done = False
    if do_step2:
        # ---- step 2a: verb suffixes beginning with i
        s2 = _ends(w, ("îmes", "ît", "îtes", "i", "ie", "ies", "ir", "ira", "irai", "iraIent", "irais",
                       "irait", "iras", "irent", "irez", "iriez", "irions", "irons", "iront", "is",
                       "issaIent", "issais", "issait", "issant", "issante", "issantes", "issants",
                       "isse", "issent", "isses", "issez", "issiez", "issions", "issons", "it"))
        if s2 and in_r(s2, rv) and len(w) - len(s2) - 1 >= rv and w[-len(s2) - 1] not in _FR_V:
            w = w[: -len(s2)]
            step2_done = True
        else:
            # ---- step 2b: other verb suffixes
            s3 = _ends(w, ("ions", "é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent",
                           "erais", "erait", "eras", "erez", "eriez", "erions", "erons", "eront",
                           "ez", "iez", "âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait",
                           "ant", "ante", "antes", "ants", "as", "asse", "assent", "asses",
                           "assiez", "assions"))
            if s3 and in_r(s3, rv):
                if s3 == "ions":
                    if in_r(s3, r2):
                        w = w[:-4]
                        step2_done = True
                elif s3 in ("é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais",
                            "erait", "eras", "erez", "eriez", "erions", "erons", "eront", "ez", "iez"):
                    w = w[: -len(s3)]
                    step2_done = True
                else:
                    w = w[: -len(s3)]
                    step2_done = True
                    if w.endswith("e") and len(w) - 1 >= rv:
                        w = w[:-1]

    if step1_done or altered or step2_done:
        # ---- step 3
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        # ---- step 4: residual suffixes
        if len(w) >= 2 and w.endswith("s") and w[-2] not in "aiouès":
            w = w[:-1]
        s4 = _ends(w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if s4 and in_r(s4, rv):
            if s4 == "ion":
                if in_r(s4, r2) and len(w) >= 4 and w[-4] in "st":
                    w = w[:-3]
            elif s4 in ("ier", "ière", "Ier", "Ière"):
                w = w[: -len(s4)] + "i"
            elif s4 == "e":
                w = w[:-1]
            elif s4 == "ë" and w[-3:-1] == "gu":
                w = w[:-1]

    # ---- step 5: undouble
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    # ---- step 6: un-accent
    i = len(w) - 1
    cons = 0
    while i >= 0 and w[i] not in _FR_V:
        cons += 1
        i -= 1
    if cons >= 1 and i >= 0 and w[i] in "éè":
        w = w[:i] + "e" + w[i + 1:]
    del n0
    return w.lower()


STEMMERS = {"english": stem_english, "french": stem_french}


def stem_column(terms: Column, language: str) -> Column:
    """Arrow UDF applying the stemmer to a column of terms (use on distinct terms)."""
    fn = STEMMERS[language]

    @F.pandas_udf(T.StringType())
    def _stem(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fn(t))

    return _stem(terms)


def stem_vocabulary(terms: DataFrame, term_col: str, language: str) -> DataFrame:
    """Vocabulary job: distinct terms -> (term, stem)."""
    vocab = terms.select(F.col(term_col).alias("term")).where(F.col("term").isNotNull()).distinct()
    return vocab.withColumn("stem", stem_column(F.col("term"), language))
