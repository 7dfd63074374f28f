"""Secret scans: base patterns, and formats learnt by merging prefix-tree states into probabilistic automata."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialise, slices

# The base patterns and the lengths below which a match is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "format")

#: Where access and hex matches lie: they need at least 16 of the characters of credentials in a row.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Labelled credentials of a kind that an automaton learns from (those of smallest hash), and their longest.
SAMPLE, LONGEST = 1000, 200
#: Significance of the test by which two states differ.
ALPHA = 0.05
#: Share of labelled credentials that score below a format's threshold, each scored by an automaton of other FOLDS.
MISSED, FOLDS = 0.02, 5
#: Answers about candidates that a task remembers before it begins anew.
REMEMBERED = 100_000


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential), leftmost and non-overlapping in each kind, by start, then kind as listed."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in RUN.finditer(text):  # a match of the other kinds cannot leave such a run
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            for m in pattern.finditer(text, run.start(), run.end()):
                if m.end() - m.start() >= LEAST[kind]:
                    found.append((kind, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[tuple[str, int, int, str]], least: int = 16) -> list[tuple[int, int, str]]:
    """Runs of characters of credentials, what base matches leave of them, of at least `least` characters without the dots,
    equal signs and the like at their ends.

    One sweep: runs and matches both come in order, so a text costs its length.
    """
    taken: list[list[int]] = []  # the base matches, merged
    for _, start, end, _ in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    found, i = [], 0

    def add(start: int, end: int) -> None:
        part = text[start:end]
        core = part.strip(".=-/_")
        if len(core) >= least:
            start += len(part) - len(part.lstrip(".=-/_"))
            found.append((start, start + len(core), core))

    for m in _run_of(least).finditer(text):
        at = m.start()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        k = i
        while k < len(taken) and taken[k][0] < m.end():
            add(at, taken[k][0])
            at, k = max(at, taken[k][1]), k + 1
        add(at, m.end())
    return found


@lru_cache(maxsize=64)
def _run_of(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_.=-]{{{least},}}")


class FormatAutomaton:
    """A probabilistic automaton, learnt by merging the compatible states of a prefix tree.

    States join where the shares of strings that end there, and of each next character, agree by Hoeffding's
    bound, and so do those of the states that follow. Merged states are tried in the order in which they were
    first kept; new ones are taken by the number of strings that reach them.
    """

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.reach, self.ends = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self.alphabet = max(2, len({c for w in words for c in w}))
        for w in words:
            self._grow(w)
        self._merge_all()

    def _grow(self, word: str) -> None:
        state = 0
        for c in word:
            self.reach[state] += 1
            self.count[state][c] += 1
            if c not in self.next[state]:
                self.next[state][c] = len(self.reach)
                self.reach.append(0)
                self.ends.append(0)
                self.next.append({})
                self.count.append(Counter())
            state = self.next[state][c]
        self.reach[state] += 1
        self.ends[state] += 1

    def _alike(self, a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.reach[a], self.reach[b]
            if not n or not m:
                continue
            most = self.slack * (n**-0.5 + m**-0.5)
            if most < 1:
                if abs(self.ends[a] / n - self.ends[b] / m) > most:
                    return False
                if any(abs(self.count[a][c] / n - self.count[b][c] / m) > most for c in self.count[a].keys() | self.count[b].keys()):
                    return False
            waiting += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            self.reach[a] += self.reach[b]
            self.ends[a] += self.ends[b]
            self.count[a] += self.count[b]
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    waiting.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_all(self) -> None:
        kept = [0]
        while True:
            safe = set(kept)
            edge = [(self.reach[t], -s, c, s, t) for s in kept for c, t in self.next[s].items() if t not in safe]
            if not edge:
                break
            *_, c, s, t = max(edge)
            for k in kept:
                if self._alike(k, t):
                    self.next[s][c] = k
                    self._fold(k, t)
                    break
            else:
                kept.append(t)
        self.states = len(kept)

    def score(self, word: str) -> float:
        """Mean log likelihood per character and end; unseen characters and ends get a smoothed share, and characters restart."""
        state, total = 0, 0.0
        for c in word:
            n = self.reach[state]
            total += math.log((self.count[state][c] + 0.05) / (n + 0.05 * self.alphabet))
            state = self.next[state].get(c, 0)
        total += math.log((self.ends[state] + 0.05) / (self.reach[state] + 0.05 * self.alphabet))
        return total / (len(word) + 1)


class FormatModel:
    """An automaton for each kind, its threshold, and a character background that a format must beat.

    Every labelled credential is scored by an automaton that learnt from the other folds (all others, if fewer than
    FOLDS); a candidate must score no less than all but MISSED of them, and no more than the best of them: a piece of a
    credential, mostly its fixed beginning, is too likely. A kind with one credential teaches nothing: no other could
    confirm it. `least` is the length of the shortest credential; shorter runs are no candidates.
    """

    def __init__(self, labelled: dict[str, list[str]]):
        background = Counter(c for words in labelled.values() for w in words for c in w)
        total = sum(background.values())
        self.background = {c: math.log((n + 1) / (total + 64)) for c, n in background.items()}
        self.rare = math.log(1 / (total + 64))
        self.automata: dict[str, tuple[FormatAutomaton, float]] = {}  # with the least score
        self.most: dict[str, float] = {}
        for kind, words in sorted(labelled.items()):
            folds = min(FOLDS, len(words))
            if folds < 2:
                continue
            scores = []
            for k in range(folds):
                other = FormatAutomaton([w for i, w in enumerate(words) if i % folds != k])
                scores += [other.score(w) for w in words[k::folds]]
            whole = FormatAutomaton(words)
            # The whole automaton, which knows all credentials, scores them higher than those of the folds do.
            self.automata[kind] = (whole, sorted(scores)[int(MISSED * len(scores))])
            self.most[kind] = max(*scores, *map(whole.score, words))
        self.least = min((len(w) for kind in self.automata for w in labelled[kind]), default=0)
        self.known: dict[str, bool] = {}

    def accepts(self, word: str) -> bool:
        if (answer := self.known.get(word)) is None:
            if len(self.known) > REMEMBERED:
                self.known = {}
            plain = sum(self.background.get(c, self.rare) for c in word) / len(word)
            answer = self.known[word] = any(least <= (s := a.score(word)) <= self.most[k] and s >= plain for k, (a, least) in self.automata.items())
        return answer

    def spans(self, text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
        """Candidates of the text that a learnt format accepts."""
        if not self.automata:
            return []
        return [(s, e) for s, e, w in candidates(text, base, self.least) if self.accepts(w)]


def learn_formats(docs: DataFrame) -> FormatModel:
    """Fit on at most SAMPLE distinct labelled credentials a kind (ties of a hash apart), of LONGEST characters."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str]] = set()
        for part in slices(batches, "text"):
            new = {(k, w) for t in part["text"] if t for k, *_, w in base_matches(t) if len(w) <= LONGEST} - seen
            seen = seen | new if len(seen) < REMEMBERED else new
            yield pd.DataFrame(sorted(new), columns=["kind", "word"])

    pairs = materialise(docs.select("text").mapInPandas(find, "kind string, word string").distinct())
    labelled = defaultdict(list)
    for r in bounded_sample(pairs, F.col("word"), SAMPLE, by=["kind"]).collect():
        labelled[r["kind"]].append(r["word"])
    discard(pairs)
    return FormatModel({k: sorted(v, key=lambda w: hashlib.md5(w.encode()).digest()) for k, v in labelled.items()})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end by start, then kind), base (those of the base patterns).

    Spans of kind "format" come from the learnt automata, which score every run of characters of credentials, or what base
    matches leave of it, that is as long as the shortest labelled credential. Credentials of more than LONGEST characters
    are found like others, but none teaches. Null and empty texts have no spans; repeated rows stay; of matches
    that start together, kinds come as listed; very long texts are read once, in order; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn_formats(docs))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            base = [base_matches(t) if t else [] for t in part["text"]]
            extra = [shipped.value.spans(t, b) if t else [] for t, b in zip(part["text"], base, strict=True)]
            yield pd.DataFrame({
                "doc_id": part["doc_id"],
                "base": [[{"kind": k, "start": s, "end": e} for k, s, e, _ in b] for b in base],
                "extra": [[{"kind": "format", "start": s, "end": e} for s, e in x] for x in extra],
            })

    span = "array<struct<kind:string,start:int,end:int>>"
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    scored = named.mapInPandas(find, f"doc_id string, base {span}, extra {span}")
    listed = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), F.array_position(listed, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    in_order = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "base", in_order.alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every span of scan() replaced by mask, overlapping spans by one; all rows and columns stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(learn_formats(docs))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask_spans(t, shipped.value, mask) if t else t)

    return docs.withColumn("text", clean("text"))


def mask_spans(text: str, model: FormatModel, mask: str) -> str:
    base = base_matches(text)
    spans = [(s, e) for _, s, e, _ in base] + model.spans(text, base)
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
