"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they catch.

The lexicon is learned from labelled documents: words, and stems that take many endings. Words of a text run
through the product of the trie and the automaton of the allowed edits, determinised as it is walked.
What a match weighs depends on its window: quotation marks and reporting words around it speak for a
quotation, other matches near it for abuse. A logistic regression over a document's windows gives the score.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.llm.quality import sample_labelled

SAMPLE = 3000
WINDOW = 8
_TOKEN = re.compile(r"\w+")
_QUOTES = re.compile(r"[\"“”«»„]")
#: Words that report what somebody else said.
REPORTING = frozenset(
    "said says quoted quote quotes wrote called reported alleged dit écrit cité sagte schrieb zitat dijo escribió cita".split()
)
#: Shorter entries must match exactly, those from the second length on may have two edits, the others one.
FUZZY_FROM, TWICE_FROM = 5, 10


def edits_of(entry: str) -> int:
    """How many edits an entry may be away."""
    return (len(entry) >= FUZZY_FROM) + (len(entry) >= TWICE_FROM)


class Matcher:
    """Product of a trie and the automaton of the edits (change, loss, insertion, swap of neighbours) that its entries may have.

    A state is a set of (trie node, edits so far, the letter a swap still owes); a branch is left when none of the entries
    below may have so many. Determinised states and their transitions are made when a word first needs them.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.entry: list[tuple[float, bool, int] | None] = [None]  # weight, stem, edits it may have
        self.most = [0]  # edits that any entry at or below may have
        for table, stem in ((words, False), (stems, True)):
            for text, weight in table.items():
                at, may = 0, edits_of(text)
                self.most[0] = max(self.most[0], may)
                for c in text:
                    nxt = self.child[at].get(c)
                    if nxt is None:
                        nxt = len(self.child)
                        self.child[at][c] = nxt
                        self.child.append({})
                        self.entry.append(None)
                        self.most.append(0)
                    at = nxt
                    self.most[at] = max(self.most[at], may)
                self.entry[at] = (weight, stem, may)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._close({(0, 0, "")}))

    def _close(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With the letters of the lexicon that the text may have lost; of a node's states that owe nothing the one of fewest edits."""
        out, new = set(states), list(states)
        while new:
            node, edits, owes = new.pop()
            if owes:
                continue
            for n in self.child[node].values():
                if edits < self.most[n] and (n, edits + 1, "") not in out:
                    out.add((n, edits + 1, ""))
                    new.append((n, edits + 1, ""))
        fewest: dict[int, int] = {}
        for node, edits, owes in out:
            if not owes:
                fewest[node] = min(edits, fewest.get(node, edits))
        return frozenset(x for x in out if x[2] or fewest[x[0]] == x[1])

    def _state(self, members: frozenset) -> int:
        found = self.states.get(members)
        if found is None:
            found = self.states[members] = len(self.sets)
            self.sets.append(members)
            self.moves.append({})
        return found

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, owes in self.sets[state]:
            if owes:
                if owes == c:
                    out.add((node, edits, ""))
                continue
            entry = self.entry[node]
            if entry is not None and entry[1] and edits <= entry[2]:  # a stem takes any ending
                out.add((node, edits, ""))
            nxt = self.child[node].get(c)
            if nxt is not None and edits <= self.most[nxt]:
                out.add((nxt, edits, ""))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
                for first, n in self.child[node].items():
                    if first == c or edits >= self.most[n]:
                        continue
                    out.add((n, edits + 1, ""))
                    swapped = self.child[n].get(c)
                    if swapped is not None and edits < self.most[swapped]:
                        out.add((swapped, edits + 1, first))
        found = self.moves[state][c] = self._state(self._close(out))
        return found

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of the best entry that the word is, or is as few edits away from as that may have. Each edit halves what it weighs after the first."""
        state = self.start
        for c in word:
            known = self.moves[state].get(c)
            state = self._move(state, c) if known is None else known
            if not self.sets[state]:
                return None
        best = None
        for node, edits, owes in self.sets[state]:
            entry = self.entry[node]
            if entry is not None and not owes and edits <= entry[2]:
                best = max(best or (0.0, False), (entry[0] / max(1, edits), not edits), key=lambda x: (x[1], x[0]))
        return best


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def learn_lexicon(
    rows: list[tuple[str, int]], least: int = 4, share: float = 0.005, purity: float = 0.97
) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that nearly only toxic documents have, with their log odds.

    An entry stands in ``least`` toxic documents and in that share of them, between as many different pairs of neighbours (what
    merely comes with copied documents keeps its neighbours), and ``purity`` of its occurrences, were both classes as
    large, are in toxic ones. A stem is a beginning of three letters or more that several words share; it is as long as
    it can be without losing a tenth of its documents.
    """
    texts = sorted({(t or "", y) for t, y in rows})
    total = Counter(y for _, y in texts)
    least = max(least, math.ceil(share * total[1]))
    docs: dict[tuple[bool, int], Counter] = {(stem, y): Counter() for stem in (False, True) for y in (0, 1)}
    spots: dict[bool, dict[str, set]] = {False: defaultdict(set), True: defaultdict(set)}
    for text, y in texts:
        words = tokens(text)
        docs[False, y].update({w for w in words if len(w) > 2})
        docs[True, y].update({w[:k] for w in set(words) for k in range(3, min(len(w), 13) + 1)})
    for text, y in texts:
        words = ["", *tokens(text), ""] if y else []
        for before, w, after in zip(words, words[1:], words[2:], strict=False):
            for stem, part in ((False, w), *((True, w[:k]) for k in range(3, min(len(w), 13) + 1))):
                if docs[stem, 1][part] >= least and len(spots[stem][part]) < least:
                    spots[stem][part].add((before, after))

    def odds(s: str, stem: bool) -> float:
        return math.log((docs[stem, 1][s] + 0.5) / (total[1] + 1)) - math.log((docs[stem, 0][s] + 0.5) / (total[0] + 1))

    def stands(s: str, stem: bool) -> bool:
        a, b = docs[stem, 1][s] / max(1, total[1]), docs[stem, 0][s] / max(1, total[0])
        return len(spots[stem][s]) >= least and a / (a + b) >= purity

    words = {w: odds(w, False) for w, n in docs[False, 1].items() if n >= least and stands(w, False)}
    longer: dict[str, int] = defaultdict(int)
    for s, n in docs[True, 1].items():
        if len(s) > 3:
            longer[s[:-1]] = max(longer[s[:-1]], n)
    stems = {
        s: odds(s, True)
        for s, n in docs[True, 1].items()
        if n >= 3 * least and stands(s, True) and longer[s] < 0.9 * n and docs[False, 1][s] < 0.5 * n
    }
    # what a stem covers needs no entry of its own
    kept = {s: x for s, x in stems.items() if not any(s[:k] in stems for k in range(3, len(s)))}
    return {w: x for w, x in words.items() if not any(w[:k] in kept for k in range(3, len(w)))}, kept


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        self.weights = np.zeros(9)
        self._ready()

    def _ready(self) -> None:
        self.matcher = Matcher(self.words, self.stems)
        self.clean: set[str] = set()
        self.found: dict[str, tuple[float, bool]] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def features(self, text: str) -> np.ndarray:
        lowered = text.lower()
        own = set(_TOKEN.findall(lowered))
        for w in own - self.clean:
            if w not in self.found:
                m = self.matcher.match(w)
                if m is None:
                    self.clean.add(w)
                else:
                    self.found[w] = m
        if len(self.clean) > 500_000:
            self.clean.clear()
        out = np.zeros(9)
        out[0] = 1
        hits = own & self.found.keys()
        if not hits:
            return out
        starts, ends, at = array("q"), array("q"), []
        for i, m in enumerate(_TOKEN.finditer(lowered)):
            starts.append(m.start())
            ends.append(m.end())
            if m[0] in hits:
                at.append(i)
        exact = fuzzy = quoted = crowd = strongest = 0.0
        for k, i in enumerate(at):
            weight, is_exact = self.found[lowered[starts[i] : ends[i]]]
            lo, hi = max(0, i - WINDOW), min(len(starts) - 1, i + WINDOW)
            before, after = lowered[starts[lo] : starts[i]], lowered[ends[i] : ends[hi]]
            reported = any(lowered[starts[j] : ends[j]] in REPORTING for j in range(lo, i))
            quotes = (len(_QUOTES.findall(before)) % 2 == 1 and bool(_QUOTES.search(after))) or reported
            quoted += weight * quotes
            weight *= 0.3 if quotes else 1.0
            near = sum(1 for j in at[max(0, k - WINDOW) : k + WINDOW + 1] if abs(j - i) <= WINDOW) - 1
            crowd += near
            strongest = max(strongest, weight)
            if is_exact:
                exact += weight
            else:
                fuzzy += weight
        out[1:] = (
            exact > 0,
            math.log1p(exact),
            fuzzy > 0,
            math.log1p(fuzzy),
            math.log1p(quoted),
            math.log1p(crowd),
            strongest / 10,
            math.log1p(100 * len(at) / len(starts)),
        )
        return out

    def fit(self, rows: list[tuple[str, int]]) -> Model:
        x = np.array([self.features(t or "") for t, _ in rows])
        y = np.array([y for _, y in rows], float)
        sample = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        ridge = np.full(x.shape[1], 1e-4)
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (sample * (p - y)) + ridge * w
            h = (x * (sample * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w
        return self

    def score(self, text: str | None) -> float:
        z = float(self.features(text or "") @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> Model | None:
    """The model, from at most ``most`` labelled rows of each class for which ``learn`` (on ``label_id``) holds; None without both classes."""
    rows = sample_labelled(docs, labels, "toxic", learn, most)
    if len({y for _, y in rows}) < 2:
        return None
    return Model(*learn_lexicon(rows)).fit(rows)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``toxic_score`` (0 to 1) for each row. Null and empty texts have no match and get that score; without a model all get 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [0.5 if model is None else model.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "toxic_score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, toxic_score double")
