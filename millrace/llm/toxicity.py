"""Operator 7: toxicity by Levenshtein automata over a lexicon trie, with context-window scores."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed, passing, saved, small_batches

#: Labelled rows that a model is fitted on at most; all terms found in them make its lexicon.
SAMPLE = 16_000
#: Characters of a text that is learned from at most; with the rows it bounds what a model is fitted on.
SAMPLE_CHARS = 65_536
#: Words to either side of a term that make its context.
WINDOW = 10
EXACT, STEM, FUZZY = 3, 2, 1
FEATURES = 6
#: Words that are matched at once, and cells of the table of states from which it is begun anew.
RUN, MOST_CELLS = 4_096, 1 << 24

#: Marks that open or close a quotation by their kind, and marks whose turn decides.
OPENING, CLOSING, EITHER = "«“„‹‚", "»”›", "\"`"
#: The second of these opens, too, but closes what the first has opened.
LOW = "„“"
#: Marks that also stand inside words: they open before a letter and close after one, where no letter stands on the other side.
APOSTROPHES = "'’‘"


def quotations(x: np.ndarray, letters: np.ndarray, line_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, opens, line) of the quotation marks of code points ``x``, in order.

    ``letters`` says which code points belong to words; ``line_ends`` are the places where lines end,
    at which turns of the marks that look alike begin anew.
    """
    kinds = [np.isin(x, [ord(c) for c in marks]) for marks in (OPENING, CLOSING, EITHER, APOSTROPHES)]
    before, after = np.concatenate([[False], letters[:-1]]), np.append(letters[1:], False)
    opens, closes = kinds[0] | (kinds[3] & after & ~before), kinds[1] | (kinds[3] & before & ~after)
    low = np.flatnonzero((x == ord(LOW[0])) | (x == ord(LOW[1])))
    ends = (x[low[1:]] == ord(LOW[1])) & (x[low[:-1]] == ord(LOW[0])) & (np.searchsorted(line_ends, low[1:]) == np.searchsorted(line_ends, low[:-1]))
    opens[low[1:][ends]] = False
    closes[low[1:][ends]] = True
    either = np.flatnonzero(kinds[2])
    line = np.searchsorted(line_ends, either)
    for mark in EITHER:
        own = x[either] == ord(mark)
        at, of = either[own], line[own]
        first = np.searchsorted(of, of)  # where the line's marks begin
        turn = (np.arange(len(at)) - first) % 2 == 0
        opens[at[turn]] = True
        closes[at[~turn]] = True
    place = np.flatnonzero(opens | closes)
    return place, opens[place], np.searchsorted(line_ends, place)


def quoted_terms(start: np.ndarray, end: np.ndarray, words: np.ndarray, marks: tuple[np.ndarray, np.ndarray, np.ndarray], line_ends: np.ndarray, window: int) -> np.ndarray:
    """Which terms stand inside a quotation: the last mark before opens, the next one after closes, both on
    the term's line and at most ``window`` words away. ``words`` are the places where all words begin."""
    place, opens, line = marks
    if not len(place):
        return np.zeros(len(start), bool)
    own_line = np.searchsorted(line_ends, start)
    after = np.searchsorted(place, start)
    left, right = np.maximum(after - 1, 0), np.minimum(np.searchsorted(place, end), len(place) - 1)
    inside = (after > 0) & (place[right] >= end) & opens[left] & ~opens[right] & (line[left] == own_line) & (line[right] == own_line)
    at = np.searchsorted(words, start)
    near = (at - np.searchsorted(words, place[left]) <= window) & (np.searchsorted(words, place[right]) - at - 1 <= window)
    return inside & near


@functools.cache
def _letters() -> np.ndarray:
    """What belongs to a word: letters and digits."""
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = chr(c).isalnum()
    return out


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]


class Automaton:
    """The trie of a lexicon met by the Levenshtein automata of all words at once, made deterministic as texts ask for it.

    A state is a set of (trie node, edits so far). Reading a character moves along the trie, or
    spends the one edit on an insertion, a substitution or a deletion. Whole words match with up to
    one edit from five letters on; stems match the beginning of a word, without edits. Words are runs of
    letters and digits of any script; where a script parts no words, a whole run counts as one.
    """

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...]):
        self.next, self.word, self.stem, self.depth = [{}], [False], [False], [0]
        for terms, ends in ((words, self.word), (stems, self.stem)):
            for term in terms:
                node = 0
                for c in term:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.word.append(False)
                        self.stem.append(False)
                        self.depth.append(self.depth[node] + 1)
                    node = self.next[node][c]
                ends[node] = True
        self.chars = sorted({c for n in self.next for c in n})
        self.classes = np.zeros(0x110000, np.int32)  # 0: not in the lexicon
        self.classes[[ord(c) for c in self.chars]] = np.arange(len(self.chars)) + 1
        self.width = len(self.chars) + 1
        self._begin()

    def _begin(self) -> None:
        """No states but the dead one and the first; others come back when words ask for them."""
        self.sets, self.number = [], {}
        self.table, self.at_end, self.on_way = np.zeros((0, self.width), np.int32), np.zeros(0, np.int8), np.zeros(0, bool)
        self._state(frozenset())  # state 0: dead
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, members: frozenset) -> int:
        if members not in self.number:
            self.number[members] = len(self.sets)
            self.sets.append(members)
            if len(self.sets) > len(self.table):
                grow = max(256, len(self.table) // 2)
                self.table = np.concatenate([self.table, np.full((grow, self.width), -1, np.int32)])
                self.at_end = np.concatenate([self.at_end, np.zeros(grow, np.int8)])
                self.on_way = np.concatenate([self.on_way, np.zeros(grow, bool)])
            kinds = [EXACT if e == 0 else FUZZY for n, e in members if self.word[n] and (e == 0 or self.depth[n] >= 5)]
            kinds += [FUZZY for n, e in members if e == 0 for m in self.next[n].values() if self.word[m] and self.depth[m] >= 5]
            self.at_end[self.number[members]] = max(kinds, default=0)
            self.on_way[self.number[members]] = any(e == 0 and self.stem[n] for n, e in members)
        return self.number[members]

    def _step(self, state: int, cls: int) -> int:
        c, out = (self.chars[cls - 1] if cls else None), set()
        for node, e in self.sets[state]:
            if c in self.next[node]:
                out.add((self.next[node][c], e))
            if e == 0:
                out.add((node, 1))
                for child in self.next[node].values():
                    out.add((child, 1))
                    if c in self.next[child]:
                        out.add((self.next[child][c], 1))
        return self._state(frozenset(out))

    def match(self, classes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The kind of match of each word, 0 for none. A table of states that has grown large is begun anew between runs of words."""
        out = [np.zeros(0, np.int8)]
        for at in range(0, len(start), RUN):
            if len(self.sets) * self.width > MOST_CELLS:
                self._begin()
            out.append(self._match(classes, start[at : at + RUN], size[at : at + RUN]))
        return np.concatenate(out)

    def _match(self, classes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All words go on by one character at a time."""
        out = np.zeros(len(start), np.int8)
        alive, state = np.arange(len(start)), np.full(len(start), self.start, np.int64)
        place = 0
        while len(alive):
            cls = classes[start[alive] + place].astype(np.int64)
            new = self.table[state, cls]
            if (new < 0).any():
                for code in np.unique(state[new < 0] * self.width + cls[new < 0]).tolist():
                    s, k = divmod(code, self.width)
                    to = self._step(s, k)
                    self.table[s, k] = to
                new = self.table[state, cls]
            place += 1
            hit = self.on_way[new]
            out[alive[hit]] = STEM
            ended = size[alive] == place
            out[alive[ended]] = np.maximum(out[alive[ended]], self.at_end[new[ended]])
            on = (new > 0) & ~ended
            alive, state = alive[on], new[on]
        return out


class Scanner:
    """Features of whole texts: matches by kind, the densest context, and what is quoted."""

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...]):
        self.automaton, self.letters = Automaton(words, stems), _letters()

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text; texts are scanned in runs of about 256 thousand characters, so that memory is bounded by one text."""
        out, run, size = [np.zeros((0, FEATURES))], [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size > 1 << 18:
                out.append(self._features(run))
                run, size = [], 0
        return np.concatenate([*out, self._features(run)]) if run else np.concatenate(out)

    def _features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        lowered = [t.lower() for t in texts]
        x = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.append(self.letters[x], False)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if inside[0] else edge
        start, end = edge[::2], edge[1::2]
        kind = self.automaton.match(self.automaton.classes[x], start, end - start)
        limits = np.cumsum([len(t) + 1 for t in lowered])
        doc = np.searchsorted(limits, start, "right")
        n_words = np.bincount(doc, minlength=len(texts))
        hits = np.flatnonzero(kind)
        cuts = np.searchsorted(doc[hits], np.arange(len(texts) + 1))
        line_ends = np.union1d(np.flatnonzero(x == 10), limits - 1)
        in_quotes = np.zeros(len(kind), bool)
        in_quotes[hits] = quoted_terms(start[hits], end[hits], start, quotations(x, inside[:-1], line_ends), line_ends, WINDOW)
        for i in np.unique(doc[hits]).tolist():
            own = hits[cuts[i] : cuts[i + 1]]
            sure = own[kind[own] != FUZZY]
            quoted = in_quotes[sure].sum()
            near = (np.searchsorted(sure, sure + WINDOW, "right") - np.searchsorted(sure, sure - WINDOW)).max(initial=0)
            counts = np.bincount(kind[own], minlength=4)
            out[i] = [math.log1p(counts[EXACT]), math.log1p(counts[STEM]), math.log1p(counts[FUZZY]), math.log1p(near), math.log1p(quoted), math.log1p(100 * len(sure) / max(1, n_words[i]))]
        return out


def sampled(docs: DataFrame, labels: DataFrame, label: str, trains: Column, size: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of at most ``size`` labelled rows of which ``trains`` holds, by the hash of their ids.

    Rows without id or label, and texts of more than ``SAMPLE_CHARS`` characters, are not learned from.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & trains)
    chosen = known.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(size)
    texts = narrowed(docs, id_col, text_col).filter(F.length("text") <= SAMPLE_CHARS)
    return saved(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "label"), "sample")


def learn_terms(sample: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, stems) that stand in toxic texts only, as far as chance can't explain it.

    A term counts once for each word before it, so that copies of one text don't make terms of its
    words. With a share q of contexts in toxic texts, k contexts that are all toxic come by chance
    with q^k; a term needs that times the number of terms to be under 0.01. Stems are the shortest
    beginnings, of four letters or more, for which this holds over three or more words.
    """
    words = sample.select("label", F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1), "").alias("w"))
    pairs = words.select("label", "w", F.posexplode("w").alias("i", "word")).select("label", "word", F.when(F.col("i") > 0, F.get("w", F.col("i") - 1)).alias("before"))
    met = pairs.groupBy("word", "before").agg(F.max("label").alias("toxic"), F.min("label").alias("only"))
    by_word = saved(met.groupBy("word").agg(F.sum("only").alias("toxic"), F.sum(1 - F.col("only")).alias("clean")), "words")
    total = by_word.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1] or not total[2]:
        return (), ()
    least = math.ceil(math.log(100 * total[0]) / math.log((total[1] + total[2]) / total[1]))
    sure = (F.col("toxic") >= least) & (F.col("clean") * 50 <= F.col("toxic"))
    found = [r.word for r in by_word.filter(sure & (F.length("word") >= 3)).collect()]
    starts = by_word.filter(F.length("word") >= 4).select("toxic", "clean", F.explode(F.transform(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(7))), lambda n: F.substring("word", F.lit(1), n))).alias("word"))
    grouped = starts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum(F.when(F.col("toxic") > 0, 1)).alias("kinds"))
    stems: list[str] = []
    for r in sorted(grouped.filter(sure & (F.col("kinds") >= 3)).collect(), key=lambda r: (len(r.word), r.word)):
        if not any(r.word.startswith(s) for s in stems):
            stems.append(r.word)
    return tuple(sorted(found)), tuple(sorted(stems))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, trains: Column, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """Learn lexicon and weights from at most ``size`` labelled rows (see ``sampled``)."""
    small_batches(docs.sparkSession)
    with passing():
        return _fitted(sampled(docs, labels, label, trains, size, id_col, text_col))


def _fitted(sample: DataFrame) -> Model:
    words, stems = learn_terms(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(words, stems)
        for b in batches:
            yield pd.DataFrame({"x": list(scanner.features(list(b["text"]))), "y": b["label"].astype("float64")})

    rows = sample.mapInPandas(run, "x array<double>, y double").groupBy("x", "y").count().collect()
    if len({r.y for r in rows}) < 2:
        return Model(words, stems, (0.0,) * FEATURES + (-3.0,))
    x, y = (np.repeat(np.array(v), [r["count"] for r in rows], axis=0) for v in ([r.x for r in rows], [r.y for r in rows]))
    return Model(words, stems, tuple(logistic(x, y)))


def score_column(spark, model: Model):
    """The score as a function of a text column without nulls."""
    small_batches(spark)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner, w = Scanner(model.words, model.stems), np.array(model.weights)
        for b in texts:
            yield pd.Series(1 / (1 + np.exp(-np.clip(scanner.features(list(b)) @ w[:-1] + w[-1], -30, 30))))

    return scored


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Score every whole text: doc_id, the columns of ``extra`` (over doc_id), score from 0 to 1.

    A row for each input row, repeated ones alike. Null and empty texts have no terms and get the
    model's score for that. Other columns are ignored; an empty table gives an empty result.
    """
    scored = score_column(docs.sparkSession, model)
    return narrowed(docs, id_col, text_col).select("doc_id", *(c.alias(n) for n, c in (extra or {}).items()), scored("text").alias("score"))
