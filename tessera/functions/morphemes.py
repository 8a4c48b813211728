"""Language-routed tokens: runs of one script, and for each script its own analysis, over Arrow batches.

Latin runs keep digits, hyphens and underscores and are stemmed (Porter, 1980); Hangul runs lose their particles; Han runs are cut by the
words of a lexicon, or into overlapping pairs where none is given; kana runs are characters. No run crosses a change of script.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import PARTICLES, STOP_WORDS

# Character ranges of the scripts.
HANGUL = "가-힣ᄀ-ᇿ㄰-㆏"
KANA = "぀-ヿㇰ-ㇿ"
HAN = "一-鿿㐀-䶿"
#: One pattern a script, for both engines; what is left is ``other``.
RUNS = {"hangul": f"[{HANGUL}]+", "kana": f"[{KANA}]+", "han": f"[{HAN}]+", "latin": "[A-Za-z][A-Za-z0-9_-]*"}
_SCRIPT = f"{HANGUL}{KANA}{HAN}A-Za-z"
_RUN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in RUNS.items()) + rf"|(?P<other>(?:(?![{_SCRIPT}])\S)[^{_SCRIPT}]*)")

# Hangul morphemes of function, and English words that aren't stemmed but dropped.
HANGUL_STOP_WORDS = frozenset("에서 으로 까지 부터 에게 한테 처럼 보다 마다 조차 이다 하다 되다 있다 없다 같다 않다".split())
ENGLISH_STOP_WORDS = frozenset(
    "about above after again all also am an and another any are as at be because been before being below between both but by came can cannot come could did do does doing "
    "during each few for from further get got has had he have her here him himself his how if in into is it its itself like make many me might more most much must my myself "
    "never now of on only or other our ours ourselves out over own said same see should since so some still such take than that the their theirs them themselves then there "
    "these they this those through to too under until up very was way we well were what where when which while who whom with would why you your yours yourself".split()
)


def segments(text: str | None) -> list[tuple[str, str]]:
    """Runs of one script in order: (hangul | kana | han | latin | other, run). Blanks alone are no run; digits belong to a Latin run that they follow, else to ``other``."""
    return [(m.lastgroup, m.group()) for m in _RUN.finditer(text or "")]


class Stemmer:
    """Porter's algorithm: endings go in five steps, each under a condition on the measure of what is left."""

    _VOWEL = re.compile("[aeiou]|(?<=[^aeiou])y")
    # Endings of steps 2, 3 and 4, and what takes their place.
    STEP2 = dict(
        ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate",
        alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
    )
    STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
    STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

    def __init__(self, most: int = 200_000):
        self.known: dict[str, str] = {}
        self.most = most

    @classmethod
    def _shape(cls, w: str) -> str:
        """v and c for every letter; y is a vowel after a consonant."""
        out = ""
        for ch in w:
            out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
        return out

    @classmethod
    def _measure(cls, w: str) -> int:
        return len(re.findall("v+c", re.sub("c+", "c", cls._shape(w))))

    @classmethod
    def _short(cls, w: str) -> bool:
        """Ends consonant, vowel, consonant, the last no w, x or y."""
        return cls._shape(w).endswith("cvc") and w[-1] not in "wxy"

    @staticmethod
    def _ending(w: str, endings: Iterable[str]) -> str | None:
        return max((e for e in endings if w.endswith(e)), key=len, default=None)

    def _cut(self, w: str) -> str:
        measure, vowel = self._measure, lambda s: "v" in self._shape(s)
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if measure(w[:-3]) > 0 else w
        elif (e := self._ending(w, ("ed", "ing"))) and vowel(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and self._shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and self._short(w):
                w += "e"
        if w.endswith("y") and vowel(w[:-1]):
            w = w[:-1] + "i"
        for table in (self.STEP2, self.STEP3):
            e = self._ending(w, table)
            if e and measure(w[: -len(e)]) > 0:
                w = w[: -len(e)] + table[e]
        e = self._ending(w, self.STEP4)
        if e and measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
            w = w[: -len(e)]
        if w.endswith("e"):
            m = measure(w[:-1])
            if m > 1 or (m == 1 and not self._short(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and measure(w) > 1:
            w = w[:-1]
        return w

    def stem(self, word: str) -> str:
        """The stem of a lower-case word; words of one or two letters stay."""
        if len(word) < 3:
            return word
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[word] = self._cut(word)
        return found


class Analyser:
    """Tokens of a text by script. ``lexicon`` holds Han words; the longest that fits is taken at each place."""

    def __init__(self, lexicon: Iterable[str] = ()):
        self.stemmer, self.lexicon = Stemmer(), frozenset(lexicon)
        self.longest = max(map(len, self.lexicon), default=1)
        self.particle = re.compile(PARTICLES)

    def hangul(self, run: str) -> list[str]:
        bare = self.particle.sub("", run)
        word = bare if len(bare) > 1 else run
        return [word] if len(word) > 1 and word not in HANGUL_STOP_WORDS else []

    def han(self, run: str) -> list[str]:
        if not self.lexicon:
            return [run[k : k + 2] for k in range(max(1, len(run) - 1))]
        out, k = [], 0
        while k < len(run):
            n = next((n for n in range(min(self.longest, len(run) - k), 1, -1) if run[k : k + n] in self.lexicon), 1)
            out.append(run[k : k + n])
            k += n
        return out

    def kana(self, run: str) -> list[str]:
        return list(run)

    def latin(self, run: str) -> list[str]:
        return [self.stemmer.stem(w) for w in re.split(r"\W+", run.lower()) if len(w) > 1 and w not in ENGLISH_STOP_WORDS]

    def other(self, run: str) -> list[str]:
        return []

    def tokens(self, text: str | None, most: int) -> list[str]:
        """Distinct tokens in order, at most ``most``; scanning ends when they are found."""
        out: dict[str, None] = {}
        for m in _RUN.finditer(text or ""):
            for t in getattr(self, m.lastgroup)(m.group()):
                out.setdefault(t)
                if len(out) >= most:
                    return list(out)
        return list(out)


def morphemes(c: Column, most: int = 10, lexicon: Iterable[str] = ()) -> Column:
    """Up to ``most`` distinct tokens of a text; null has none. The lexicon travels with the plan: some thousand words."""
    held = frozenset(lexicon)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        analyser = Analyser(held)
        return texts.map(lambda t: analyser.tokens(t, most))

    return run(c)


def runs(c: Column, script: str) -> Column:
    """The runs of a script, by a pattern both engines know."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RUNS[script]), 0)


# Names in camel, Pascal or snake case, and what words consist of.
_NAMES = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z][a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+)(?![A-Za-z0-9_])")
_WORDS = re.compile("[A-Za-z0-9_ㄱ-ㅎ가-힣]+")


def keywords(c: Column, most: int = 5) -> Column:
    """Names in camel, Pascal or snake case first, then words of two characters or more by frequency; ties by first occurrence; stop words out.

    Korean words lose their particle where two characters are left. A row is counted by itself, in one pass: nothing is shuffled.
    """
    stop, particle = frozenset(STOP_WORDS), re.compile(PARTICLES)

    def of(text: str | None, low: str | None) -> list[str]:
        counts: Counter[str] = Counter()
        for w in _WORDS.findall(low or ""):
            if "가" <= max(w) <= "힣":
                bare = particle.sub("", w)
                w = bare if len(bare) >= 2 else w
            counts[w] += 1
        # a Counter keeps the order of first occurrence, and sorting is stable
        words = sorted((w for w in counts if len(w) > 1 and w not in stop), key=lambda w: -counts[w])
        best: dict[str, str] = {}
        for w in (*_NAMES.findall(text or ""), *words):
            best.setdefault(w.lower(), w)
            if len(best) >= most:
                break
        return list(best.values())

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([of(t, x) for t, x in zip(texts, low)])

    return run(c, F.lower(c))


def with_keywords(df: DataFrame, key: str, content: str, most: int = 5) -> DataFrame:
    """(key, keywords) of every row."""
    return df.select(key, keywords(F.col(content), most).alias("keywords"))
