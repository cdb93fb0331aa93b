"""Secret scans: fixed base patterns, and probabilistic automata inferred from labelled credentials.

Base spans come from three patterns, leftmost and non-overlapping per kind. The values that they
find in a bounded sample are labelled credentials. For each kind their character classes form a
prefix tree whose states are merged where their continuation statistics are compatible
(Hoeffding's test on stop and transition shares, recursively, as in ALERGIA), which leaves a
probabilistic automaton of the format. Every maximal run of credential characters in a text is
then a candidate, and so is each part of it between two of ``= / .`` or the run's ends, since a name or a path
may precede a value and a full stop may follow it. Candidates have 12 characters or more; those of over SCORED are
scored together, as walks through an automaton that meet go on as one. An automaton that can generate a candidate gives it the mean, a character, of its log-likelihood
less that under the automaton of plain words (states are the classes of the character before); at or above the
cutoff it is a secret too, and one inside another counts once, as the longer. Those spans have the kind ``format``;
they add to the base spans and never replace one.

Labels of the cutoff. Positive: labelled values held back from the merging; the cutoff is their QUANTILE, values
that the automaton cannot generate counted as lowest. Negative: a bounded sample of plain words outside base spans,
runs whose letters are of one case but for a capital and which hold no digit, each as it stands and in capitals, as
any word may be set in capitals; where more than 1 + FALSE of them would pass, the cutoff rises until they do not. ``recall`` is the share of held-back values that then pass.

Defined results: null and empty texts hold no span; equal texts give equal spans, and rows of one id are scanned
each; without labelled values no automaton exists and only base spans are found; an empty table gives an empty
result; further columns pass through, but a column of the result's name is replaced. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import batches, ready

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
_HINTS = ("passw", "secret", "token", "api")

#: Candidates: maximal runs of credential characters and their parts at these marks, of a least length.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MARK = re.compile(r"[=/.]")
LEAST = 12
#: Labelled values of a kind that are gathered at most, smallest hash first: the documented bound of the sample.
SAMPLE = 600
#: Longer values are not learnt from; the sample is picked in this many hash shards.
LONGEST, SHARDS = 256, 16
#: The longest candidate that is scored by itself; the walks of longer ones are joined where they meet.
SCORED = 1024
#: Hoeffding's confidence parameter for merging, the share of held-back values below the cutoff, and that of plain words above it.
ALPHA, QUANTILE, FALSE = 0.01, 0.02, 0.001
#: Plain words: labelled negatives, of which this many are gathered at most, smallest hash first.
_WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+)"
PLAIN = re.compile(rf"{_WORD}(?:[+/_.=-]+{_WORD})*[+/_.=-]*")
NEGATIVES = 4000
#: Share of an even distribution in the automaton of plain words, so that it can generate whatever a format can.
EVEN = 0.1

_CLASS = {c: c for c in "+/_.=-"}
_CLASS |= dict.fromkeys("0123456789", "D") | dict.fromkeys("abcdef", "h") | dict.fromkeys("ghijklmnopqrstuvwxyz", "l")
_CLASS |= dict.fromkeys("ABCDEF", "H") | dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U")
_TABLE = str.maketrans(_CLASS)
_CLASSES = sorted(set(_CLASS.values()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    found = []
    low = text.lower()
    if any(x in low for x in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: log P(class | class before) and, under "", log P(stop | class before); "" stands before the first character.
Background = dict[str, dict[str, float]]


def background(words: list[str]) -> Background:
    """The automaton of plain words: a state for each class, its steps counted and smoothed."""
    counts: dict[str, dict[str, int]] = {x: defaultdict(int) for x in ("", *_CLASSES)}
    for word in words:
        before = ""
        for c in (*word.translate(_TABLE), ""):
            counts[before][c] += 1
            before = c
    even = 1 / (len(_CLASSES) + 1)
    made: Background = {}
    for before, to in counts.items():
        total = sum(to.values())
        made[before] = {c: math.log(EVEN * even + (1 - EVEN) * (to[c] / total if total else even)) for c in (*_CLASSES, "")}
    return made


@dataclass
class Automaton:
    """Deterministic, probabilistic: ``steps[state][class] = (next state, log probability)``; ``stops`` are log probabilities."""

    steps: list[dict[str, tuple[int, float]]]
    stops: list[float]
    cutoff: float = -math.inf
    plain: Background | None = None
    recall: float = math.nan

    def _ends(self, text: str, start: int, ends: list[int]) -> Iterator[tuple[int, float]]:
        """(end, score) of the candidates from ``start`` to each of ``ends`` (ascending), as far as the automaton can generate them."""
        state, total, at, before, plain = 0, 0.0, start, "", self.plain
        for end in ends:
            for c in text[at:end].translate(_TABLE):
                step = self.steps[state].get(c)
                if step is None:
                    return
                state, total = step[0], total + step[1]
                if plain:
                    total, before = total - plain[before][c], c
            at = end
            yield end, (total + self.stops[state] - (plain[before][""] if plain else 0.0)) / (end - start + 1)

    def score(self, word: str) -> float:
        """Mean log-likelihood a character (and the stop), less that of plain words where known; minus infinity where the automaton cannot generate the word."""
        return next((x for _, x in self._ends(word, 0, [len(word)])), -math.inf)

    def longest(self, text: str, start: int, ends: list[int]) -> int:
        """The last of ``ends`` (ascending) up to which the text from ``start`` on scores the cutoff; 0 if none does."""
        return max((end for end, x in self._ends(text, start, ends) if x >= self.cutoff), default=0)

    def _reached(self, text: str, start: int, end: int) -> tuple[int, float] | None:
        """State and sum after the text from ``start`` to ``end``; None where the automaton cannot generate it."""
        state, total, before = 0, 0.0, ""
        for c in text[start:end].translate(_TABLE):
            step = self.steps[state].get(c)
            if step is None:
                return None
            state, total = step[0], total + step[1]
            if self.plain:
                total, before = total - self.plain[before][c], c
        return state, total

    def far(self, text: str, starts: list[int], ends: list[int]) -> list[int]:
        """For each of ``starts`` the last of ``ends`` (both ascending), SCORED characters on or more, up to which the text scores the cutoff; 0 if none does.

        Walks in one state at one place go on as one, so what is walked grows with the text and the states, not with the pairs of starts and ends.
        """
        at, found = np.array(starts), np.zeros(len(starts), dtype=np.int64)
        walks: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}  # of a state: its starts, the sums that they came with, and what came since
        stops, last, entered = set(ends), ends[-1] if ends else -1, 0
        place = starts[0] + SCORED if starts else 0
        classes, first = text[place - 1 : last].translate(_TABLE), place - 1

        def enter(into: dict, state: int, ids: np.ndarray, totals: np.ndarray, since: float) -> None:
            if state in into:
                others, sums, own = into[state]
                into[state] = (np.concatenate([others, ids]), np.concatenate([sums, totals + (since - own)]), own)
            else:
                into[state] = (ids, totals, since)

        while place <= last:
            while entered < len(starts) and starts[entered] + SCORED == place:
                if reached := self._reached(text, starts[entered], place):
                    enter(walks, reached[0], np.array([entered]), np.array([reached[1]]), 0.0)
                entered += 1
            if not walks:
                if entered == len(starts):
                    break
                place = starts[entered] + SCORED
                continue
            before = classes[place - 1 - first]
            if place in stops:
                for state, (ids, totals, since) in walks.items():
                    ended = since + self.stops[state] - (self.plain[before][""] if self.plain else 0.0)
                    found[ids[(totals + ended) / (place - at[ids] + 1) >= self.cutoff]] = place
            if place == last:
                break
            c, moved = classes[place - first], {}
            for state, (ids, totals, since) in walks.items():
                if step := self.steps[state].get(c):
                    enter(moved, step[0], ids, totals, since + step[1] - (self.plain[before][c] if self.plain else 0.0))
            walks, place = moved, place + 1
        return found.tolist()

    def calibrate(self, held: list[str], negatives: list[str]) -> None:
        """Set the cutoff from labelled values held back and labelled plain words."""
        good = sorted(map(self.score, held))
        bad = sorted(map(self.score, negatives), reverse=True)
        self.cutoff = good[int(QUANTILE * len(good))]
        allowed = 1 + int(FALSE * len(bad))
        if len(bad) > allowed and bad[allowed] >= self.cutoff:
            self.cutoff = math.nextafter(bad[allowed], math.inf)
        self.recall = sum(x >= self.cutoff for x in good) / len(good)


def infer(words: list[str], alpha: float = ALPHA) -> Automaton | None:
    """State merging over the prefix tree of the words' character classes, in breadth-first (red-blue) order."""
    if not words:
        return None
    child: list[dict[str, int]] = [{}]
    passed, stopped = [0], [0]
    for word in words:
        at = 0
        passed[0] += 1
        for c in word.translate(_TABLE):
            if c not in child[at]:
                child[at][c] = len(child)
                child.append({})
                passed.append(0)
                stopped.append(0)
            at = child[at][c]
            passed[at] += 1
        stopped[at] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        work = [(a, b)]
        while work:
            p, q = work.pop()
            n, m = passed[p], passed[q]
            if differ(stopped[p], n, stopped[q], m):
                return False
            for c in child[p].keys() | child[q].keys():
                x, y = child[p].get(c), child[q].get(c)
                if differ(passed[x] if x is not None else 0, n, passed[y] if y is not None else 0, m):
                    return False
                if x is not None and y is not None and x != y:
                    work.append((x, y))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree at b into a."""
        work = [(a, b)]
        while work:
            p, q = work.pop()
            passed[p] += passed[q]
            stopped[p] += stopped[q]
            for c, y in child[q].items():
                if c in child[p]:
                    work.append((child[p][c], y))
                else:
                    child[p][c] = y

    red = [0]
    blue = [(0, c) for c in sorted(child[0])]
    while blue:
        parent, c = blue.pop(0)
        state = child[parent][c]
        if state in red:
            continue
        match = next((r for r in red if compatible(r, state)), None)
        if match is None:
            red.append(state)
        else:
            child[parent][c] = match
            fold(match, state)
        known = set(red)
        blue = [(r, x) for r in red for x in sorted(child[r]) if child[r][x] not in known]
    number = {s: i for i, s in enumerate(red)}
    steps, stops = [], []
    for s in red:
        out = {c: passed[x] if x not in number else None for c, x in child[s].items()}
        assert None in out.values() or not out
        steps.append({c: number[x] for c, x in child[s].items()})
        stops.append(0)
    # transition shares: run the words through the merged automaton once
    use: list[dict[str, int]] = [defaultdict(int) for _ in red]
    ends = [0] * len(red)
    for word in words:
        at = 0
        for c in word.translate(_TABLE):
            use[at][c] += 1
            at = steps[at][c]
        ends[at] += 1
    made, last = [], []
    for i in range(len(red)):
        total = sum(use[i].values()) + ends[i]
        made.append({c: (steps[i][c], math.log(k / total)) for c, k in use[i].items()})
        last.append(math.log(ends[i] / total) if ends[i] else math.log(0.5 / (total + 1)))
    return Automaton(made, last)


def fit(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, negatives: int = NEGATIVES) -> list[Automaton]:
    """Automata of the three base kinds from at most ``sample`` labelled values of each (those of smallest hash).

    Equal values of many rows or tasks count once, so repeated documents do not bend a format.
    """
    ready(docs.sparkSession)
    most = (sample, sample, sample, negatives)

    def values(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct values of smallest hash of each kind in this task, plain words as the last kind."""
        least: list[dict[str, int]] = [{}, {}, {}, {}]
        bound = [1 << 63] * 4  # hashes at or above are not among the least

        def note(kind: int, word: str) -> None:
            h = xxh64_intdigest(word) >> 1
            if h < bound[kind]:
                least[kind][word] = h
                if len(least[kind]) >= 4 * most[kind]:
                    least[kind] = dict(nsmallest(most[kind], least[kind].items(), key=itemgetter(1)))
                    bound[kind] = max(least[kind].values())

        for batch in source:
            for x in batch.column(0):
                whole = x.as_py() or ""
                base = base_spans(whole)
                for start, kind, end in base:
                    word = whole[start:end]
                    word = ASSIGN.match(word).group(2) if kind == 0 else word
                    if len(word) <= LONGEST:
                        note(kind, word)
                for word in CANDIDATE.findall(whole):
                    if len(word) <= LONGEST and (not base or not base_spans(word)) and PLAIN.fullmatch(word):
                        note(3, word)
        rows = [(k, h, w) for k, x in enumerate(least) for w, h in nsmallest(most[k], x.items(), key=itemgetter(1))]
        kinds, hashes, words = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array(words, pa.string())], names=["kind", "h", "value"])

    seen = docs.select(text).mapInArrow(values, "kind int, h long, value string").distinct()
    parts = Window.partitionBy("kind", F.col("h") % SHARDS).orderBy("h", "value")
    ranked = seen.withColumn("at", F.row_number().over(parts)).where(F.col("at") <= F.when(F.col("kind") < 3, sample).otherwise(negatives))
    rows = ranked.select("kind", "h", "value").collect()  # at most SHARDS * (3 * sample + negatives)
    chosen = [[w for _, w in sorted((r["h"], r["value"]) for r in rows if r["kind"] == k)[: most[k]]] for k in range(4)]
    words_of = [[x for w in chosen[3][i::2] for x in dict.fromkeys((w, w.upper()))] for i in range(2)]
    plain = background(words_of[0])
    automata = []
    for words in chosen[:3]:
        automaton = infer([w for i, w in enumerate(words) if i % 3])
        if automaton is not None:
            automaton.plain = plain
            automaton.calibrate(words[::3], words_of[1])
            automata.append(automaton)
    return automata


def _apart(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that sorted base spans cover."""
    starts, ends = [], []
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _far(text: str, automata: list[Automaton], starts: list[tuple[int, int]], ends: list[int]) -> dict[int, int]:
    """The last end, SCORED characters on or more, of the starts (start, limit) of a run that have one."""
    found: dict[int, int] = {}
    for limit, some in groupby(starts, key=itemgetter(1)):
        long = [start for start, _ in some if limit - start > SCORED]
        stops = ends[bisect_left(ends, long[0] + SCORED) : bisect_right(ends, limit)] if long else []
        if stops:
            for automaton in automata:
                for start, end in zip(long, automaton.far(text, long, stops), strict=True):
                    found[start] = max(end, found.get(start, 0))
    return found


def spans(text: str | None, automata: list[Automaton]) -> list[tuple[int, int, int]]:
    """All spans of a text: the base spans, and candidates outside them that an automaton accepts."""
    text = text or ""
    found = base_spans(text)
    if automata:
        covered, until = _apart(found)
        for m in CANDIDATE.finditer(text):
            marks = [x.start() for x in MARK.finditer(text, m.start(), m.end())]
            ends, past, starts = [*marks, m.end()], 0, []
            for start in (m.start(), *(x + 1 for x in marks)):
                if m.end() - start < LEAST:
                    break
                near = bisect_right(covered, start)
                if not near or start >= until[near - 1]:
                    starts.append((start, covered[near] if near < len(covered) else m.end()))
            far = _far(text, automata, starts, ends)
            for start, limit in starts:
                stops = ends[bisect_left(ends, start + LEAST) : bisect_right(ends, min(start + SCORED, limit))]
                end = max((a.longest(text, start, stops) for a in automata), default=0) if stops else 0
                end = max(end, far.get(start, 0))
                if end > past:  # else inside a candidate that counts
                    found.append((start, 3, end))
                    past = end
    return sorted(found)


def scan(docs: DataFrame, automata: list[Automaton], *, text: str = "text", name: str = "__spans") -> DataFrame:
    """``docs`` with an array column of (start, kind, end), in place of any column of its name."""
    ready(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans(x.as_py(), automata)] for x in batch.column(at)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, name])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
    return docs.mapInArrow(batches(find), T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(span))]))


MASK = "[SECRET]"


def redact(docs: DataFrame, automata: list[Automaton], *, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with every span of its texts replaced by MASK (overlapping spans by one), and ``chars`` recounted where it is a column."""
    ready(docs.sparkSession)
    at = docs.columns.index(text)

    def mask(whole: str | None) -> str | None:
        found = spans(whole, automata)
        if not found:
            return whole
        parts, end = [], 0
        for s, _, e in found:
            if s >= end:
                parts += [whole[end:s], MASK]
            end = max(end, e)
        return "".join([*parts, whole[end:]])

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [mask(x.as_py()) for x in batch.column(at)]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    done = docs.mapInArrow(batches(apply), docs.schema)
    if chars in docs.columns:
        kind = docs.schema[chars].dataType
        done = done.withColumn(chars, F.coalesce(F.length(text).cast(kind), F.col(chars)))
    return done
