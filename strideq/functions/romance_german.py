"""German, French and Spanish stemmers, from their published definitions.

A word has regions: R1 begins after the first consonant that follows a vowel, R2 is R1's
own R1, and RV has a rule in each language. Steps look for the longest suffix of a list and
delete or replace it if it lies in a region.
"""

from __future__ import annotations

import re
from functools import lru_cache


class Stem:
    """A word on its way to its stem."""

    def __init__(self, word: str, vowels: str):
        self.w, self.vowels = word, vowels
        self.r1 = self.after(0)
        self.r2 = self.after(self.r1)
        self.rv = len(word)

    def after(self, start: int) -> int:
        """Where the region after a vowel and a consonant begins."""
        m = re.compile(f"[{self.vowels}][^{self.vowels}]").search(self.w, start)
        return m.end() if m else len(self.w)

    def longest(self, suffixes: str, region: int = 0) -> str | None:
        """The longest of the suffixes that ends the word and lies in a region."""
        fits = [s for s in suffixes.split() if self.w.endswith(s) and len(self.w) - len(s) >= region]
        return max(fits, key=len, default=None)

    def cut(self, suffix: str, region: int = 0, to: str = "") -> bool:
        """Replace a suffix in a region."""
        if suffix and self.w.endswith(suffix) and len(self.w) - len(suffix) >= region:
            self.w = self.w[: len(self.w) - len(suffix)] + to
            return True
        return False

    def cut_any(self, suffixes: str, region: int) -> bool:
        """Delete the longest of the suffixes, if it lies in the region."""
        return self.cut(self.longest(suffixes) or "", region)


@lru_cache(maxsize=200_000)
def german(word: str) -> str:
    """The German stem of a lower-case word."""
    vowels = "aeiouyäöü"
    w = re.sub(f"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    s = Stem(w, vowels)
    s.r1 = max(s.r1, 3)
    # Step 1
    end = s.longest("em ern er e en es s")
    if end == "s":
        if re.search("[bdfghklmnrt]s$", s.w):
            s.cut("s", s.r1)
    elif end and s.cut(end, s.r1) and end in ("e", "en", "es") and s.w.endswith("niss"):
        s.w = s.w[:-1]
    # Step 2
    end = s.longest("en er est st")
    if end == "st":
        if re.search("...[bdfghklmnt]st$", s.w):
            s.cut("st", s.r1)
    elif end:
        s.cut(end, s.r1)
    # Step 3
    end = s.longest("end ung ig ik isch lich heit keit")
    if end and len(s.w) - len(end) >= s.r2:
        before = s.w[: -len(end)]
        if end in ("end", "ung"):
            s.w = before
            if s.w.endswith("ig") and not s.w.endswith("eig"):
                s.cut("ig", s.r2)
        elif end in ("ig", "ik", "isch"):
            s.w = before if not before.endswith("e") else s.w
        elif end in ("lich", "heit"):
            s.w = before
            s.cut_any("er en", s.r1)
        else:
            s.w = before
            s.cut_any("lich ig", s.r2)
    return s.w.lower().translate(str.maketrans("äöü", "aou"))


#: Verb endings of Spanish.
SPANISH_VERBS = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
PLAIN = str.maketrans("áéíóú", "aeiou")


def _spanish_rv(w: str, vowels: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        m = re.compile(f"[{vowels}]").search(w, 2)
    elif w[0] in vowels:
        m = re.compile(f"[^{vowels}]").search(w, 2)
    else:
        return 3
    return m.end() if m else len(w)


def _spanish_suffix(s: Stem) -> bool:
    plain = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
    agent = "adora ador ación adoras adores aciones ante antes ancia ancias"
    end = s.longest(f"{plain} {agent} logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")
    if end is None:
        return False
    if end == "amente":
        if not s.cut(end, s.r1):
            return False
        if s.cut("iv", s.r2):
            s.cut("at", s.r2)
        else:
            s.cut_any("os ic ad", s.r2)
        return True
    to = "log" if end.startswith("log") else "u" if end.startswith("uci") else "ente" if end.startswith("enc") else ""
    if not s.cut(end, s.r2, to):
        return False
    if end in agent.split():
        s.cut("ic", s.r2)
    elif end == "mente":
        s.cut_any("ante able ible", s.r2)
    elif end.startswith("idad"):
        s.cut_any("abil ic iv", s.r2)
    elif end.startswith("iv"):
        s.cut("at", s.r2)
    return True


@lru_cache(maxsize=200_000)
def spanish(word: str) -> str:
    """The Spanish stem of a lower-case word."""
    vowels = "aeiouáéíóúü"
    s = Stem(word, vowels)
    s.rv = _spanish_rv(word, vowels)
    # Step 0: pronouns behind a verb
    end = s.longest("me se sela selo selas selos la le lo las les los nos")
    if end:
        stem = s.w[: -len(end)]
        verb = max((v for v in ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo") if stem.endswith(v) and len(stem) - len(v) >= s.rv), key=len, default=None)
        if verb and (verb != "yendo" or stem.endswith("uyendo")):
            s.w = stem[: -len(verb)] + verb.translate(PLAIN)
    # Steps 1 and 2
    if not _spanish_suffix(s):
        end = s.longest("ya ye yan yen yeron yendo yo yó yas yes yais yamos", s.rv)
        if end and s.w[: -len(end)].endswith("u"):
            s.cut(end)
        else:
            end = s.longest("en es éis emos " + SPANISH_VERBS, s.rv)
            if end:
                s.cut(end)
                if end in ("en", "es", "éis", "emos") and s.w.endswith("gu"):
                    s.w = s.w[:-1]
    # Step 3
    end = s.longest("os a o á í ó e é", s.rv)
    if end:
        s.cut(end)
        if end in ("e", "é") and s.w.endswith("gu") and len(s.w) - 1 >= s.rv:
            s.w = s.w[:-1]
    return s.w.translate(PLAIN)


#: Verb endings of French.
FRENCH_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
FRENCH_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
FRENCH_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def _french_suffix(s: Stem) -> bool | None:
    """Whether a standard suffix went; None if it was one behind which a verb may stand."""
    plain = "ance iqUe isme able iste eux ances iqUes ismes ables istes"
    agent = "atrice ateur ation atrices ateurs ations"
    end = s.longest(f"{plain} {agent} logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")
    if end is None:
        return False
    before = s.w[: -len(end)]
    if end in plain.split():
        return s.cut(end, s.r2)
    if end in agent.split():
        if not s.cut(end, s.r2):
            return False
        if s.w.endswith("ic") and not s.cut("ic", s.r2):
            s.cut("ic", 0, "iqU")
        return True
    if end.startswith("log"):
        return s.cut(end, s.r2, "log")
    if end[1:].startswith(("sion", "tion")):
        return s.cut(end, s.r2, "u")
    if end.startswith("enc"):
        return s.cut(end, s.r2, "ent")
    if end in ("issement", "issements"):
        return bool(before) and before[-1] not in s.vowels and s.cut(end, s.r1)
    if end in ("ement", "ements"):
        if not s.cut(end, s.rv):
            return False
        if s.w.endswith("iv"):
            if s.cut("iv", s.r2):
                s.cut("at", s.r2)
        elif s.w.endswith("eus"):
            s.cut("eus", s.r2) or s.cut("eus", s.r1, "eux")
        elif s.w.endswith(("abl", "iqU")):
            s.cut(s.w[-3:], s.r2)
        elif s.w.endswith(("ièr", "Ièr")):
            s.cut(s.w[-3:], s.rv, "i")
        return True
    if end.startswith("it"):
        if not s.cut(end, s.r2):
            return False
        for part, to in (("abil", "abl"), ("ic", "iqU"), ("iv", "iv")):
            if s.w.endswith(part):
                s.cut(part, s.r2) or s.cut(part, 0, to)
                break
        return True
    if end.startswith("i"):
        if not s.cut(end, s.r2):
            return False
        if s.cut("at", s.r2) and s.w.endswith("ic"):
            s.cut("ic", s.r2) or s.cut("ic", 0, "iqU")
        return True
    if end == "eaux":
        return s.cut(end, 0, "eau")
    if end == "aux":
        return s.cut(end, s.r1, "al")
    if end.startswith("eus"):
        return s.cut(end, s.r2) or s.cut(end, s.r1, "eux")
    if end in ("amment", "emment"):
        return None if s.cut(end, s.rv, "ant" if end[0] == "a" else "ent") else False
    if before and before[-1] in s.vowels and len(before) - 1 >= s.rv:
        s.cut(end)
        return None
    return False


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    """The French stem of a lower-case word."""
    vowels = "aeiouyâàëéêèïîôûù"
    w = re.sub(f"(?<=[{vowels}])([ui])(?=[{vowels}])", lambda m: m[1].upper(), word)
    w = re.sub(f"(?<=[{vowels}])y|y(?=[{vowels}])", "Y", w)
    w = w.replace("qu", "qU")
    s = Stem(w, vowels)
    if re.match("par|col|tap", w):
        s.rv = 3
    elif len(w) > 1 and w[0] in vowels and w[1] in vowels:
        s.rv = min(3, len(w))
    else:
        m = re.compile(f"[{vowels}]").search(w, 1)
        s.rv = m.end() if m else len(w)
    began = s.w
    done = _french_suffix(s)
    if not done:
        end = s.longest(FRENCH_I, s.rv)
        at = len(s.w) - len(end or "") - 1
        if end and at >= s.rv and s.w[at] not in vowels:
            s.cut(end)
        else:
            end = s.longest(f"ions {FRENCH_E} {FRENCH_A}", s.rv)
            if end == "ions":
                s.cut(end, s.r2)
            elif end in FRENCH_E.split():
                s.cut(end)
            elif end:
                s.cut(end)
                s.cut("e", s.rv)
    if s.w != began:
        s.w = re.sub("ç$", "c", re.sub("Y$", "i", s.w))
    else:
        if re.search("[^aiouès]s$", s.w):
            s.w = s.w[:-1]
        end = s.longest("ion ier ière Ier Ière e", s.rv)
        if end == "ion":
            if s.w[-4:-3] in ("s", "t") and len(s.w) - 4 >= s.rv:
                s.cut("ion", s.r2)
        elif end == "e":
            s.cut("e")
        elif end:
            s.cut(end, 0, "i")
    if re.search("(enn|onn|ett|ell|eill)$", s.w):
        s.w = s.w[:-1]
    s.w = re.sub(f"[éè](?=[^{vowels}]+$)", "e", s.w)
    return s.w.lower()
