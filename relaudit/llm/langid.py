"""Language identification by cross-parsing: the language whose reference text parses a document into fewest phrases.

Each language has a suffix automaton of labelled reference text. Greedy parsing walks the automaton: a phrase is the
longest match of what remains of the document, and where no transition exists the phrase ends and the next begins at
the root. Completed with those restarts the automaton is one transition table over the most frequent characters, so many
stretches of text are walked in step with one numpy gather per character; moves by all other characters are sorted keys.
A stretch is first walked from the root. Then it is walked again from where the one before it really ended, up to the
character where both walks are in one state: from there on they are the same, and the count is that of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_small_batches

UNKNOWN = "und"
#: Labelled documents sampled for each language; characters of reference text that those kept of them have together.
SAMPLE_DOCS, REFERENCE_CHARS = 300, 32_000
#: A document is walked in stretches of so many characters.
STRETCH = 256
#: The most frequent characters of all references, with a dense row in each state; every other one has sorted moves.
DENSE = 127
#: A transition is the next state plus this for each phrase that it ends.
BREAK = np.int32(1 << 29)


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point below 65,536: whether it is a letter, and its lower case."""
    chars = [chr(i) for i in range(65_536)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], dtype=np.uint32)
    return letter, lower


_TABLES: list = []


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, every run of other characters one space; and the bounds of each text.

    Texts keep their own spaces: the first character of a text is always a space.
    """
    if not _TABLES:
        _TABLES.extend(_letter_tables())
    letter, lower = _TABLES
    joined = "\x00".join(["", *texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(points, 65_535)
    is_letter = letter[low]
    if (high := points > 65_535).any():
        is_letter = is_letter.copy()
        is_letter[high] = [chr(c).isalpha() for c in points[high]]
    points = np.where(high, points, lower[low])
    points = np.where(is_letter, points, 32).astype(np.uint32)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])  # each text with the separator before it
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[starts[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], at[starts]


class SuffixAutomaton:
    """All substrings of a text (Blumer et al., 1985), as transition dictionaries."""

    def __init__(self, codes) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur

    def completed(self, width: int) -> np.ndarray:
        """A row for each state: the next state, with ``BREAK`` added for each phrase that ends; characters below ``width``.

        Without a transition the phrase ends and the character opens the next one. A character that the reference
        never has ends the phrase and is one of its own; the next phrase is then still empty, at the root.
        """
        opens = np.full(width, BREAK, dtype=np.int32)
        for c, s in self.next[0].items():
            if c < width:
                opens[c] = s
        out = np.tile(opens + BREAK, (len(self.next), 1))
        out[0] = opens
        for s, moves in enumerate(self.next):
            if moves := {c: t for c, t in moves.items() if c < width}:
                out[s, list(moves)] = list(moves.values())
        return out

    def moves(self, width: int) -> np.ndarray:
        """(state, character, next state) of every transition by a character from ``width`` on."""
        return np.array([(s, c, t) for s, moves in enumerate(self.next) for c, t in moves.items() if c >= width], dtype=np.int64).reshape(-1, 3)


class Parser:
    """The references of all languages; picklable, of a size that the sampling bounds set."""

    def __init__(self, references: dict[str, str]) -> None:
        self.langs = sorted(references)
        texts = [normalise([references[x]])[0] for x in self.langs]
        self.alphabet, times = np.unique(np.concatenate([*texts, np.array([32], dtype=np.uint32)]), return_counts=True)
        place = np.argsort(np.argsort(-times, kind="stable"), kind="stable")
        self.width = min(len(self.alphabet), DENSE) + 1  # the last code of a row is that of unknown characters
        self.place = np.where(place < self.width - 1, place, place + 1).astype(np.int32)
        automata = [SuffixAutomaton(self.codes(t).tolist()) for t in texts]
        tables, moves = [a.completed(self.width) for a in automata], [a.moves(self.width) for a in automata]
        base = np.cumsum([0] + [len(t) for t in tables])
        self.roots = base[:-1].astype(np.int32)
        self.table = np.concatenate([t + b for t, b in zip(tables, base, strict=False)]).ravel() if tables else np.zeros(0, np.int32)
        self.span = len(self.alphabet) + 2
        rare = np.concatenate([np.zeros((0, 3), np.int64), *[m + [b, 0, b] for m, b in zip(moves, base, strict=False)]])
        key = rare[:, 0] * self.span + rare[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.targets = key[order], rare[order, 2].astype(np.int32)
        self.log_n = np.array([math.log2(max(len(t), 2)) for t in texts])

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, self.place[at], self.width - 1).astype(np.int32)

    def _moved(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether sorted moves lead from the states by the codes, and where to."""
        key = state.astype(np.int64) * self.span + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.targets[at]

    def _step(self, state: np.ndarray, code: np.ndarray, root: np.ndarray, any_rare: bool) -> np.ndarray:
        """The next state for each state and code, with ``BREAK`` added for each phrase that ends; all of one shape."""
        got = self.table[state * self.width + np.minimum(code, self.width - 1)]
        if any_rare and len(rare := np.nonzero(code >= self.width)[0]):
            state, code, root = state[rare], code[rare], root[rare]
            goes, to = self._moved(state, code)
            opens, first = self._moved(root, code)
            got[rare] = np.where(goes, to, np.where(opens, first + BREAK, got[rare]))  # else no reference has it
        return got

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases for each (text, language), and each text's number of letters."""
        points, bounds = normalise(texts)
        n, k = np.diff(bounds), len(self.langs)
        letters = np.add.reduceat(points != 32, bounds[:-1]) if len(points) else np.zeros(len(texts), int)
        pieces = -(-n // STRETCH)
        doc = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
        start = bounds[:-1][doc] + nth * STRETCH
        size = np.minimum(STRETCH, bounds[1:][doc] - start)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(doc), dtype=np.int64)
        place[order] = np.arange(len(doc))
        start, size, owner = start[order], size[order], doc[order]
        before = np.where(nth > 0, place[np.arange(len(doc)) - 1], -1)[order] if len(doc) else place  # the stretch before each
        after = np.full(len(doc), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        codes = self.codes(points)
        any_rare = bool((codes >= self.width).any())
        root = np.repeat(self.roots[:, None], len(doc), axis=1)
        end = root.copy()
        walked = np.empty((int(size[0]) if len(size) else 0, k, len(doc)), dtype=np.int32)
        count = np.zeros((k, len(doc)), dtype=np.int64)
        alive = np.searchsorted(-size, -np.arange(STRETCH), side="left")
        for i in range(len(walked)):
            m = alive[i]
            code = np.broadcast_to(codes[start[:m] + i], (k, m)).ravel()
            got = self._step(end[:, :m].ravel(), code, root[:, :m].ravel(), any_rare).reshape(k, m)
            walked[i, :, :m] = got
            count[:, :m] += got >> 29
            end[:, :m] = got & (BREAK - 1)
        lang, at = np.nonzero((before >= 0) & (end[:, before] != root)) if len(doc) else (before, before)
        while len(at):  # walk on from where the stretch before has ended
            state, again = end[lang, before[at]], []
            for i in range(len(walked)):
                got = self._step(state, codes[start[at] + i], self.roots[lang], any_rare)
                was = walked[i, lang, at]
                walked[i, lang, at] = got
                np.add.at(count, (lang, at), (got >> 29) - (was >> 29))
                state = got & (BREAK - 1)
                apart = state != (was & (BREAK - 1))
                ends = apart & (size[at] == i + 1)
                end[lang[ends], at[ends]] = state[ends]
                again.append((lang[ends & (after[at] >= 0)], after[at[ends & (after[at] >= 0)]]))
                on = apart & ~ends
                state, lang, at = state[on], lang[on], at[on]
                if not len(at):
                    break
            lang, at = (np.concatenate([x[j] for x in again]) for j in (0, 1))
        last = after < 0
        count[:, last] += end[:, last] != root[:, last]  # the phrase still open at the end of a text
        out = np.zeros((len(texts), k), dtype=np.int64)
        for j in range(k):
            out[:, j] = np.bincount(owner, weights=count[j], minlength=len(texts))
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with fewest normalised phrases, ties to the first by name, and how far it is ahead, 0 to 1."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        count, letters = self.phrases(texts)
        cost = count * self.log_n
        best = cost.argmin(axis=1)
        sure = np.exp2(-(cost - cost.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(letters, 1))[:, None])
        score = 1.0 / sure.sum(axis=1)
        known = letters > 0
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit_parser(train: DataFrame, sample_docs: int = SAMPLE_DOCS, reference_chars: int = REFERENCE_CHARS) -> Parser:
    """References from a bounded sample: of each language ``sample_docs`` documents in hash order, and of these, whole,
    as many as ``reference_chars`` hold: in the same order, those of a sixteenth of it or less first.

    Rows whose text or lang is null, whose text has no letter, or whose text alone is longer than ``reference_chars``
    teach nothing.
    """
    ids = train.where(F.col("lang").isNotNull() & (F.length("text") < reference_chars) & F.col("text").rlike(r"\p{L}"))
    in_order = Window.partitionBy("lang").orderBy(F.length("text") > reference_chars // 16, F.xxhash64("doc_id"), "doc_id", "text")
    some = ids.select("doc_id", "lang", "text").withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= sample_docs)
    out: dict[str, str] = {}
    for r in some.orderBy("lang", "rank").collect():
        have = out.get(r.lang, "")
        if len(have) + len(r.text) < reference_chars:
            out[r.lang] = f"{have} {r.text}"
    return Parser(out)


def identify(docs: DataFrame, parser: Parser, batch_chars: int = 500_000) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, lang_pred, score)``, a row for each input row, of whole texts.

    A null text, an empty one and one without a letter give ``und`` with score 0. Repeated rows are predicted each.
    """
    told = docs.sparkSession.sparkContext.broadcast(parser)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = told.value
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            groups = (np.cumsum([len(t) + 1 for t in texts]) // batch_chars).tolist()
            langs: list[str] = []
            scores: list[float] = []
            at = 0
            while at < len(texts):
                to = at
                while to < len(texts) and groups[to] == groups[at]:
                    to += 1
                got = model.predict(texts[at:to])
                langs += got[0]
                scores += got[1].tolist()
                at = to
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": langs, "score": scores})

    return in_small_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
