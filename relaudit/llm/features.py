"""Dense features of whole texts, for the classifiers of this subpackage."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import give_back
from .packing import forget_sizes, latin, parts_of, token_counts

#: Insults that are toxic in any corpus, and words that address the reader.
INSULTS = frozenset("idiot moron stupid scum loser trash pathetic worthless disgusting clown dumb fool jerk filth vermin bastard bitch asshole imbecile dimwit retard freak".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu toi te ton ta vous votre tú ti tus usted vosotros".split())
LEET = str.maketrans("@$!|013457*", "asiioieast ", "")

NAMES = (
    "insults", "lexicon", "weight", "heaviest", "hits", "distinct_hits", "near_you", "capitals", "exclaims", "punctuation", "symbols", "digits",
    "obfuscated", "words", "distinct_words", "word_length", "repeated_lines", "top_word",
)
TOXICITY = NAMES[:14]
NEAR = 5
STEMS = range(4, 9)
MEMORY = 200_000

WORD = re.compile(r"[^\W\d_]+")
#: A blank for every Latin-1 character that is in no word.
_WORDS = bytes(c if WORD.match(chr(c)) else 32 for c in range(256))
#: Letters, then a sign that stands for one, then a letter: words with letters written as signs.
HIDDEN = re.compile(r"(?<![\w@$!|*])[^\W\d_]*[@$!|*013457]+[^\W\d_][\w@$!|*]*")

_LETTER, _CAPITAL, _EXCLAIM, _POINT, _SYMBOL, _DIGIT, _BLANK = range(7)


def _classes() -> np.ndarray:
    """The class of every code point below 65,536."""

    def one(c: str) -> int:
        if c.isalpha():
            return _CAPITAL if c.isupper() else _LETTER
        if c.isdigit():
            return _DIGIT
        return _BLANK if c.isspace() else _EXCLAIM if c in "!?¡¿" else _POINT if c in ".,;:'\"()-" else _SYMBOL

    return np.array([one(chr(i)) for i in range(65_536)], dtype=np.uint8)


class Weights(dict):
    """The weight of each word: of the whole word or its heaviest stem in the lexicon, 0 for none; remembers words."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        get = self.lexicon.get
        w = max([get(f"{word}$", 0.0), *(get(word[:k], 0.0) for k in STEMS if k <= len(word))])
        self[word] = w
        return w


def stem_counts(text: str) -> Counter:
    """How often each word, written with ``$``, and each of its stems occurs."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        out[f"{word}$"] += n
        for k in STEMS:
            if k <= len(word):
                out[word[:k]] += n
    return out


def measure(text: str, weights: Weights | None, classes: np.ndarray, parts: list | None = None) -> list[float]:
    """The features of one text, in the order of ``NAMES``; an empty text is all zero. Without weights those that need
    a lexicon are zero and cost nothing. What a tokenizer would part the text in is appended to ``parts``, if given."""
    if not text:
        if parts is not None:
            parts.append(())
        return [0.0] * len(NAMES)
    low = text.lower()
    raw = latin(low)
    words = WORD.findall(low) if raw is None else raw.translate(_WORDS).decode("latin-1").split()
    n = len(words) or 1
    w = [weights[x] for x in words] if weights is not None else []
    hits = [i for i, x in enumerate(w) if x > 0]
    you = [i for i, x in enumerate(words) if x in SECOND_PERSON] if hits else []
    near = 0
    if you:
        at = np.searchsorted(you, hits)
        spots = np.array(you)
        left, right = spots[np.maximum(at - 1, 0)], spots[np.minimum(at, len(you) - 1)]
        near = int((np.minimum(np.abs(left - hits), np.abs(right - hits)) <= NEAR).sum())
    raw = latin(text)
    points = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 65_535)
    kinds = np.bincount(classes[points], minlength=7)
    hidden = [weights[h.translate(LEET).replace(" ", "")] for h in HIDDEN.findall(low)] if weights is not None else []
    count = Counter(words)
    if parts is not None:
        parts.append(parts_of(text, low, count))
    lines = text.split("\n")
    letters = max(1, int(kinds[_LETTER] + kinds[_CAPITAL]))
    size = len(text)
    return [
        100 * sum(words[i] in INSULTS for i in hits) / n, 100 * len(hits) / n, sum(w) / n, max(w, default=0.0), math.log1p(len(hits)),
        math.log1p(len({words[i] for i in hits})), 100 * near / n, int(kinds[_CAPITAL]) / letters, 100 * int(kinds[_EXCLAIM]) / size,
        int(kinds[_POINT]) / size, int(kinds[_SYMBOL]) / size, int(kinds[_DIGIT]) / size, 100 * sum(x > 0 for x in hidden) / n,
        math.log1p(len(words)), len(count) / n, sum(map(len, words)) / n, 1 - len(set(lines)) / len(lines), max(count.values(), default=0) / n,
    ]


_CLASSES: list[np.ndarray] = []


def features(spark: SparkSession, lexicon: dict[str, float] | None, tokens: bool = False):
    """A function from a text column to ``array<double>``, see :func:`measure`; a null text counts as empty. With
    ``tokens`` the number of the text's token ids is one more, the last."""
    told = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not _CLASSES:
            _CLASSES.append(_classes())
        weights = Weights(told.value) if told.value is not None else None
        for texts in batches:
            parts = [] if tokens else None
            rows = [measure(t if isinstance(t, str) else "", weights, _CLASSES[0], parts) for t in texts]
            yield pd.Series([[*x, float(n)] for x, n in zip(rows, token_counts(parts), strict=True)] if tokens else rows)
        del weights
        if tokens:
            forget_sizes(MEMORY)
        give_back()

    def call(text: str | Column) -> Column:
        return run(text)

    return call
