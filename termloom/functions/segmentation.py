"""Dictionary and HMM word segmentation, vectorised over Arrow batches.

The dictionary and the HMM are the caller's; both are plain Python values that
travel once to each worker.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = frozenset(" \t\n，。")
NEVER = -3.14e100
STATES = "BEMS"


@dataclass
class Dictionary:
    """Words with log weights and tags; user words have the median weight."""

    weight: dict[str, float] = field(default_factory=dict)
    tag: dict[str, str] = field(default_factory=dict)
    user: set[str] = field(default_factory=set)
    heads: dict[str, int] = field(default_factory=dict)
    least: float = 0.0

    @classmethod
    def parse(cls, lines: Iterable[str], user_lines: Iterable[str] = (), user_weight: str = "median") -> Dictionary:
        rows = [x.split() for x in lines if x.strip()]
        total = sum(float(r[1]) for r in rows)
        made = cls()
        for word, freq, *tag in rows:
            made.weight[word] = math.log(float(freq) / total)
            made.tag[word] = tag[0] if tag else ""
        values = sorted(made.weight.values()) or [0.0]
        made.least = values[0]
        chosen = {"median": statistics.median_high(values), "min": values[0], "max": values[-1]}[user_weight]
        for row in (x.split() for x in user_lines if x.strip()):
            made.insert(row[0], row[1] if len(row) == 2 else "", chosen)
        for word in list(made.weight):
            made._reach(word)
        return made

    def _reach(self, word: str) -> None:
        self.heads[word[0]] = max(self.heads.get(word[0], 0), len(word))

    def insert(self, word: str, tag: str = "", weight: float | None = None) -> None:
        self.weight[word] = statistics.median_high(sorted(self.weight.values())) if weight is None else weight
        self.tag[word] = tag
        self.user.add(word)
        self._reach(word)

    def edges(self, text: str, at: int, most: int) -> list[int]:
        """Ends of dictionary words that start at ``at``; the single character first."""
        far = min(self.heads.get(text[at], 0), most, len(text) - at)
        return [at + 1, *(at + n for n in range(2, far + 1) if text[at : at + n] in self.weight)]


@dataclass(frozen=True)
class HiddenMarkov:
    """Log start (4), transitions (4 by 4) and emissions (4 maps), in B E M S order."""

    start: tuple[float, ...]
    step: tuple[tuple[float, ...], ...]
    emit: tuple[dict[str, float], ...]

    @classmethod
    def parse(cls, lines: Iterable[str]) -> HiddenMarkov:
        rows = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
        numbers = [tuple(map(float, r.split())) for r in rows[:5]]
        emit = tuple({k: float(v) for k, _, v in (cell.rpartition(":") for cell in row.split(",") if cell)} for row in rows[5:9])
        return cls(numbers[0], tuple(numbers[1:5]), emit)

    def best(self, text: str) -> str:
        """Most likely state of each character; the last is E or S."""
        at = [self.start[s] + self.emit[s].get(text[0], NEVER) for s in range(4)]
        back: list[list[int]] = []
        for ch in text[1:]:
            came, scores = [], []
            for s in range(4):
                values = [at[p] + self.step[p][s] for p in range(4)]
                p = max(range(4), key=values.__getitem__)
                came.append(p)
                scores.append(values[p] + self.emit[s].get(ch, NEVER))
            back.append(came)
            at = scores
        state = 1 if at[1] >= at[3] else 3
        path = [state]
        for came in reversed(back):
            state = came[state]
            path.append(state)
        return "".join(STATES[s] for s in reversed(path))


def _ascii_run(text: str, at: int) -> int:
    """End of a run of ASCII letters and digits that starts with a letter, or
    of digits and points that starts with a digit; ``at`` if there is none."""
    c, end = text[at], at + 1
    if c.isascii() and c.isalpha():
        while end < len(text) and text[end].isascii() and text[end].isalnum():
            end += 1
        return end
    if c.isascii() and c.isdigit():
        while end < len(text) and text[end].isascii() and (text[end].isdigit() or text[end] == "."):
            end += 1
        return end
    return at


class Segmenter:
    """Segmentation modes over one dictionary and, for some, one HMM."""

    def __init__(self, dictionary: Dictionary, hmm: HiddenMarkov | None = None, longest: int = 4):
        self.dictionary, self.hmm, self.longest = dictionary, hmm, longest

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Text between delimiters; each delimiter by itself."""
        out, at = [], 0
        for i, c in enumerate(text):
            if c in DELIMITERS:
                if i > at:
                    out.append(text[at:i])
                out.append(c)
                at = i + 1
        return out + ([text[at:]] if at < len(text) else [])

    def _mp(self, text: str, most: int = 512) -> list[str]:
        d, n = self.dictionary, len(text)
        score, go = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            best = None
            for end in d.edges(text, i, most):
                value = d.weight.get(text[i:end], d.least) + score[end]
                if best is None or value > best:
                    best, go[i] = value, end
            score[i] = best
        out, i = [], 0
        while i < n:
            out.append(text[i : go[i]])
            i = go[i]
        return out

    def _hmm(self, text: str) -> list[str]:
        out, at, i = [], 0, 0

        def inner(part: str) -> None:
            begin = 0
            for k, s in enumerate(self.hmm.best(part)):
                if s in "ES":
                    out.append(part[begin : k + 1])
                    begin = k + 1

        while i < len(text):
            end = _ascii_run(text, i)
            if end > i:
                if i > at:
                    inner(text[at:i])
                out.append(text[i:end])
                at = i = end
            else:
                i += 1
        if at < len(text):
            inner(text[at:])
        return out

    def _mix(self, text: str) -> list[str]:
        out, run = [], ""
        for w in self._mp(text):
            if len(w) == 1 and w not in self.dictionary.user:
                run += w
                continue
            out += self._hmm(run) if run else []
            run = ""
            out.append(w)
        return out + (self._hmm(run) if run else [])

    def _full(self, text: str) -> list[str]:
        out, covered = [], 0
        for i in range(len(text)):
            ends = self.dictionary.edges(text, i, 512)
            longer = ends[1:]
            out += [text[i:e] for e in longer]
            if not longer and i >= covered:
                out.append(text[i])
            covered = max([covered, *longer])
        return out

    def _query(self, text: str) -> list[str]:
        out: list[str] = []
        for w in self._mix(text):
            out += self._full(w) if len(w) > self.longest and not w.isascii() else [w]
        return out

    def _over(self, text: str | None, cut) -> list[str]:
        out: list[str] = []
        for p in self.pieces(text or ""):
            out += [p] if p in DELIMITERS else cut(p)
        return out

    def cut(self, text: str | None, mode: str = "mix") -> list[str]:
        ways = {"mp": self._mp, "hmm": self._hmm, "mix": self._mix, "full": self._full, "query": self._query}
        if mode not in ways:
            raise ValueError(f"unknown segmentation mode {mode!r}")
        return self._over(text, ways[mode])

    def small(self, text: str | None, most: int) -> list[str]:
        return self._over(text, lambda p: self._mp(p, most))

    def levels(self, text: str | None) -> list[tuple[str, int]]:
        """Words of two characters or more: those of the plain cut at level 0,
        then each longer one cut with a shorter greatest length."""
        words, level, out = [w for w in self.cut(text, "mp") if len(w) > 1], 0, []
        while words:
            out += [(w, level) for w in words]
            words = [x for w in words if len(w) > 2 for x in self._mp(w, len(w) - 1) if len(x) > 1]
            level += 1
        return out

    def tag(self, word: str) -> str:
        known = self.dictionary.tag.get(word)
        if known:
            return known
        ascii_ = sum(c.isascii() for c in word)
        digits = sum(c.isascii() and c.isdigit() for c in word)
        if ascii_ == 0 or len(word) == 1 and word.isalpha():
            return "x"
        return "m" if digits == ascii_ == len(word) else "eng"

    def tagged(self, text: str | None, mode: str = "mix") -> list[tuple[str, str]]:
        return [(w, self.tag(w)) for w in self.cut(text, mode)]


def segment_column(spark, segmenter: Segmenter, mode: str = "mix"):
    """A column function: text to array<struct<word, pos>>."""
    held = spark.sparkContext.broadcast(segmenter)

    @F.pandas_udf("array<struct<word:string,pos:string>>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"word": w, "pos": p} for w, p in held.value.tagged(t, mode)])

    return cut


def level_column(spark, segmenter: Segmenter):
    held = spark.sparkContext.broadcast(segmenter)

    @F.pandas_udf("array<struct<word:string,level:int>>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"word": w, "level": n} for w, n in held.value.levels(t)])

    return cut


def tagged_line(tags: Column) -> Column:
    """``word:pos`` of every tag, a blank between."""
    return F.array_join(F.transform(tags, lambda x: F.concat_ws(":", x["word"], x["pos"])), " ")


def keywords(terms: DataFrame, idf: DataFrame, stopwords: DataFrame, top: int = 5) -> DataFrame:
    """sample_id, term, score, rank: the ``top`` terms by count times idf
    (unknown terms have the mean idf), no stop words, no single characters."""
    from pyspark.sql import Window as W

    mean = idf.agg(F.avg("idf").alias("__mean"))
    kept = terms.filter(F.length("term") > 1).join(stopwords.select("term"), "term", "left_anti")
    scored = kept.join(idf.select("term", "idf"), "term", "left").crossJoin(F.broadcast(mean)).select("sample_id", "term", (F.col("n") * F.coalesce("idf", "__mean")).alias("score"))
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc(F.round("score", 9)), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)
