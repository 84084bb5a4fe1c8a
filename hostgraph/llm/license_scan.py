"""License scan by template-markup matching.

A template (``license_templates``) has mandatory words, optional regions and replaceable ones of a stated
number of words.  All templates together compile to one token automaton: a nondeterministic one whose
regions are jumps and any-word steps, made deterministic state by state as texts ask for it.  From every
word that can begin a template it is run until it stops; a place is accepted if all mandatory words
stand there as written.  A run is at most as long as the longest template, so the work is linear in the text.

Phrases are templates without regions: each place counts.  Of a template with regions the leftmost
places that don't overlap count, each as long as possible.

Defined results.  A null or empty text, or one without letters and digits, has no words and no places.
Repeated rows and null ids are kept; equal places of several templates are all kept, in order of start,
stop, label.  No row moves; only the two named columns are read.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# On the bytes of lower-cased UTF-8: digits, a-z and every byte of a character beyond ASCII.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_MARK = re.compile(r"<<(.*?)>>")
_VAR = re.compile(r"var;words=(\d+)\.\.(\d+)")
MAX_STATES = 50_000      # deterministic states kept by a worker before it begins anew


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased (other letters as they are), as UTF-8."""
    return _WORDS(text.encode().lower())


def parse(template: str) -> list:
    """Items of a template: a word, ``(lo, hi)`` for a replaceable region, a list for an optional one."""
    out: list = []
    stack = [out]
    for i, part in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            stack[-1] += words_of(part)
        elif part == "beginOptional":
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif part == "endOptional" and len(stack) > 1:
            stack.pop()
        elif (m := _VAR.fullmatch(part)) and int(m[1]) <= int(m[2]):
            stack[-1].append((int(m[1]), int(m[2])))
        else:
            raise ValueError(f"not a mark of a template: <<{part}>>")
    if len(stack) > 1:
        raise ValueError("an optional region has no end")
    return out


class TokenAutomaton:
    """One automaton for all templates.  ``steps[s]`` is (word or None for any word, next state),
    ``jumps[s]`` the states reached without a word, ``accepts[s]`` the template that ends in s."""

    def __init__(self, templates: Iterable[str]):
        self.steps: list[tuple | None] = []
        self.jumps: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        starts = []
        for number, template in enumerate(templates):
            first = self._state()
            self.accepts[self._chain(parse(template), first)] = number
            starts.append(first)
        self.words = {w for step in self.steps if step for w in [step[0]] if w is not None}
        self._reset(frozenset(self._closure(starts)))
        for s in self.start:
            if s in self.accepts:
                raise ValueError("a template without mandatory words accepts everything")
            if self.steps[s] and self.steps[s][0] is None:
                raise ValueError("a template may not begin with a replaceable region")
        self.first = {self.steps[s][0] for s in self.start if self.steps[s]}

    def _state(self) -> int:
        self.steps.append(None)
        self.jumps.append([])
        return len(self.steps) - 1

    def _chain(self, items: list, at: int) -> int:
        """States for the items one after the other, from ``at``; returns the last."""
        for item in items:
            if isinstance(item, bytes):
                at = self._word(item, at)
            elif isinstance(item, tuple):
                for i in range(item[1]):
                    if i >= item[0]:
                        skip = at
                        at = self._word(None, at)
                        self.jumps[skip].append(at)
                    else:
                        at = self._word(None, at)
            else:
                inner = self._state()
                self.jumps[at].append(inner)
                end = self._chain(item, inner)
                out = self._state()
                self.jumps[end].append(out)
                self.jumps[at].append(out)
                at = out
        return at

    def _word(self, word: bytes | None, at: int) -> int:
        if self.steps[at] is not None or self.jumps[at]:      # one step a state, jumps beside it stay apart
            own = self._state()
            self.jumps[at].append(own)
            at = own
        to = self._state()
        self.steps[at] = (word, to)
        return to

    def _closure(self, states: Iterable[int]) -> set[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.jumps[s]
        return seen

    def _reset(self, start: frozenset) -> None:
        self.start, self.known = start, {start: 0}
        self.next: list[dict] = [{}]
        self.sets, self.ends = [start], [()]

    def _step(self, state: int, word: bytes | None) -> int:
        """The deterministic state behind ``word`` (None: a word of no template); -1 if there is none."""
        to = frozenset(self._closure(n for s in self.sets[state] if (x := self.steps[s]) is not None
                                     for w, n in [x] if w is None or w == word))
        if not to:
            found = -1
        elif (found := self.known.get(to, -1)) < 0:
            found = self.known[to] = len(self.sets)
            self.next.append({})
            self.sets.append(to)
            self.ends.append(tuple(sorted(self.accepts[s] for s in to if s in self.accepts)))
        self.next[state][word] = found
        return found

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, stop, template) of the longest place of each template at each start."""
        if len(self.sets) > MAX_STATES:
            self._reset(self.start)
        out, first, known = [], self.first, self.words
        for i, w in enumerate(words):
            if w not in first:
                continue
            state, j, best = 0, i, {}
            while j < len(words):
                word = words[j] if words[j] in known else None
                to = self.next[state].get(word)
                state = self._step(state, word) if to is None else to
                if state < 0:
                    break
                j += 1
                for t in self.ends[state]:
                    best[t] = j
            out += [(i, stop, t) for t, stop in best.items()]
        return out


_AUTOMATA: dict[tuple, TokenAutomaton] = {}     # the worker's automaton for the last templates


def scan(docs: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places`` for every row; a place has the numbers of its first word and of the word
    behind its last, its label and whether it is that of a phrase."""
    kind = docs.schema[id_col].dataType.simpleString()
    labels = [label for label, _ in [*phrases, *templates]]
    texts = tuple(t for _, t in [*phrases, *templates])

    def of(automaton: TokenAutomaton, words: list[bytes]) -> list[tuple]:
        found, free = [], {}
        for start, stop, t in automaton.places(words):
            phrase = t < len(phrases)
            if phrase or start >= free.get(t, 0):
                free[t] = stop
                found.append((start, stop, labels[t], phrase))
        return sorted(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if texts not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[texts] = TokenAutomaton(texts)
        automaton = _AUTOMATA[texts]
        for batch in batches:
            counts, places = [], []
            for i in range(batch.num_rows):
                words = words_of(batch.column(1)[i].as_py() or "")
                counts.append(len(words))
                places.append([dict(zip(("start", "stop", "label", "phrase"), p)) for p in of(automaton, words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, place_type)],
                names=["doc_id", "n_words", "places"])

    place_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()),
                                     ("phrase", pa.bool_())]))
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, places array<struct<start: long, stop: long, label: string, phrase: boolean>>"))


def digest(scanned: DataFrame) -> DataFrame:
    """Phrase places, labels, and a score: 1 where a template's wording stands, 0.5 where only a phrase names a
    license, else 0."""
    named = F.filter("places", lambda p: p["phrase"])
    return (scanned.withColumn("named", named).select(
        "doc_id", "n_words", F.size("named").cast("long").alias("n_base"),
        F.array_min(F.col("named.start")).alias("first_word"), F.array_max(F.col("named.start")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("named.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("labels"),
        F.when(F.size("places") > F.size("named"), 1.0).when(F.size("named") > 0, 0.5).otherwise(0.0).alias("score")))
