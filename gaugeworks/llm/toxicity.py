"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

A lexicon is learned from a bounded sample of labelled documents: words, and stems of
words, that toxic documents have and clean ones lack, each with its log odds.  It is held as a trie.  Running
the trie together with the Levenshtein automaton of every entry gives one
non-deterministic automaton, made deterministic as words ask for states; so a word
costs one step a character however large the lexicon is, and misspelled entries are
found with the number of edits.  Words that clean documents use, though they lie near an
entry, are learned as exceptions.

A misspelled hit tells less than an exact one, and how much less is measured for each
entry: by the words near it that toxic documents of the sample have, and those that single
clean ones have.  An entry that clean words crowd around counts when it is spelt right only.

Each hit is judged in a window of words around it: inside quotation marks or beside a
word of reporting it counts as a quotation, else as abuse.  A logistic model over the
evidence of abusive and quoted, exact and misspelled hits gives the score.  Its weights are
fitted on documents that their entries and exceptions weren't learned from: each half of the
sample is read with what the other half has taught.

Scoring is one scan without a shuffle.  The lexicon and the model are the only things
sent to workers; an entry stands for several documents of the sample, so the sample's
bounds (``PER_CLASS`` documents and ``training.SAMPLE_BYTES`` of text) bound both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.chunks import BLANKS
from gaugeworks.llm.common import hash_runs, persist, runs, slices, tune, worker_kept
from gaugeworks.llm.training import fit_logistic, sigmoid

#: The largest number of labelled documents of each class.
PER_CLASS = 4000
#: Of an entry: letters at least, the share of incidences (classes weighing the same)
#: that toxic documents have at least (of a stem's: more), and how many entries may
#: qualify by chance.
LEAST_LETTERS, LEAST_SHARE, STEM_SHARE, BY_CHANCE = 4, 0.95, 0.995, 0.5
WINDOW = 6
#: Quotation marks, and words of reporting in four languages.
QUOTES = "\"“”„‟«»‹›‘’"
REPORTING = frozenset("said says say quote quoted quotes called wrote asked sagte sagt zitat nannte schrieb dit disait cite appelé écrit dijo dice cita llamó escribió".split())
STRIP = "\"“”„‟«»‹›‘’'`.,;:!?()[]{}<>*#$%&|~^+=-_/\\…"
#: Words whose verdict a worker remembers before it starts anew.
MOST_WORDS = 1_000_000


def edits_allowed(entry: str, stem: bool) -> int:
    """Edits under which a word still counts as an entry."""
    if stem:
        return 1 if len(entry) >= 7 else 0
    return 2 if len(entry) >= 9 else 1 if len(entry) >= 5 else 0


class Automaton:
    """The lexicon trie run together with its entries' Levenshtein automata."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.limit, self.whole, self.stem = [0], [-1], [-1]  # most edits at or below; edits allowed for an entry here
        self.entry = [-1]
        for number, (entry, is_stem) in enumerate(entries):
            allowed, node = edits_allowed(entry, is_stem), 0
            self.limit[0] = max(self.limit[0], allowed)
            for c in entry:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.whole.append(-1)
                    self.stem.append(-1)
                    self.entry.append(-1)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], allowed)
            (self.stem if is_stem else self.whole)[node] = allowed
            self.entry[node] = number
        self.letters = {c for below in self.children for c in below}
        self._start_over()

    def _start_over(self) -> None:
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.ends: list[int] = []  # 4 * entry + edits of the best entry if the word ends here, or -1
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        todo = list(places)
        while todo:  # letters of the entry that the word lacks
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.limit[child] and (child, edits + 1) not in places:
                    places.add((child, edits + 1))
                    todo.append((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in places:
            least[node] = min(edits, least.get(node, edits))
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            fits = [(e, self.entry[n]) for n, e in key if max(self.whole[n], self.stem[n]) >= e]
            self.ends.append(4 * min(fits)[1] + min(fits)[0] if fits else -1)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        places = set()
        for node, edits in self.states[state]:
            if self.stem[node] >= edits:
                places.add((node, edits))  # a stem takes any rest
            if edits < self.limit[node]:
                places.add((node, edits + 1))
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.limit[child]:
                    places.add((child, cost))
        return self._state(places)

    def match(self, word: str) -> int:
        """4 * entry + edits of the nearest entry within its limit, or -1."""
        if len(self.steps) > 500_000:
            self._start_over()
        state, steps = self.start, self.steps
        for c in word:
            c = c if c in self.letters else "\0"
            after = steps.get((state, c))
            if after is None:
                after = steps[state, c] = self._step(state, c)
            state = after
            if not self.states[state]:
                return -1
        return self.ends[state]


@dataclass
class Lexicon:
    """Entries, what each tells, and the weights of the score."""

    entries: list[tuple[str, bool]]  # and whether it is a stem
    odds: list[float]  # log odds that an incidence of an entry is in a toxic document
    exceptions: frozenset[str] = frozenset()  # words near an entry that clean documents use
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    near: list[float] | None = None  # what a misspelled hit of each entry tells

    def misspelled(self, entry: int) -> float:
        """The evidence of a misspelled hit; 0 where such hits don't count."""
        return self.odds[entry] * MISSPELLED if self.near is None else self.near[entry]


#: Evidence (log odds summed over hits, a misspelled one counting less) of abusive and of
#: quoted hits, the strongest abusive hit's, and how many hits are misspelled (reported,
#: not weighed: WEIGHED come first); where their weights and the constant start.
FEATURES = ("abusive", "quoted", "strongest", "misspelled")
WEIGHED = 3
PRIOR = np.array([0.5, 0.1, 0.5, 0.0, -3.0])
#: Where the weight of evidence levels off; a misspelled hit counts for so much of an exact
#: one at most; the share of an entry's toxic documents that are taken to misspell it besides.
LEVEL, MISSPELLED, SLIPS = 20.0, 0.75, 0.05


def weighed(evidence: np.ndarray) -> np.ndarray:
    """Evidence as the score takes it: proportional while small, levelling off at LEVEL."""
    return LEVEL * (1 - np.exp(-evidence / LEVEL))


class Scanner:
    """Finds hits in texts with one lexicon; one for each worker."""

    def __init__(self, lexicon: Lexicon):
        self.automaton, self.odds, self.exceptions = Automaton(lexicon.entries), lexicon.odds, lexicon.exceptions
        self.near = [lexicon.misspelled(k) for k in range(len(lexicon.odds))]
        self.hashes, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def verdicts(self, hashes: np.ndarray, first: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Matches of the distinct words of a slice; new words run through the automaton."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            if len(self.hashes) + new.sum() > MOST_WORDS:
                self.hashes, self.codes, new = self.hashes[:0], self.codes[:0], np.ones(len(hashes), bool)
            k = first[new]
            found = [self.match(raw[a:b].decode("utf-8", "replace").strip(STRIP).lower()) for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]
            where = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.codes = np.insert(self.hashes, where, hashes[new]), np.insert(self.codes, where, np.array(found, np.int32))
            at = np.searchsorted(self.hashes, hashes)
        return self.codes[at]

    def match(self, word: str) -> int:
        """As the automaton's, without the exceptions and misspelled hits that tell nothing."""
        found = self.automaton.match(word)
        return -1 if found >= 0 and found & 3 and (word in self.exceptions or self.near[found >> 2] <= 0) else found

    def features(self, column: pa.Array) -> np.ndarray:
        """FEATURES of each text."""
        out = np.zeros((len(column), len(FEATURES)))
        for lo, hi, data, offsets in slices(column, 1 << 20):
            member = ~BLANKS[data]
            starts, ends, doc = runs(member, offsets)
            if not len(starts):
                continue
            raw = data.tobytes()
            hashes, first, inverse = np.unique(hash_runs(data, member, starts, ends), return_index=True, return_inverse=True)
            code = self.verdicts(hashes, first, raw, starts, ends)[inverse]
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            for k in np.flatnonzero(code >= 0).tolist():
                d = int(doc[k])
                left, right = max(int(bounds[d]), k - WINDOW), min(int(bounds[d + 1]), k + WINDOW + 1) - 1
                quoted = self.is_quoted(raw[starts[left] : starts[k]], raw[starts[k] : ends[k]], raw[ends[k] : ends[right]])
                wrong = int(code[k] & 3 > 0)
                odds = (self.near if wrong else self.odds)[code[k] >> 2]
                out[lo + d, quoted] += odds
                out[lo + d, 3] += wrong
                if not quoted:
                    out[lo + d, 2] = max(out[lo + d, 2], odds)
        return out

    def scores(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of texts with evidence x."""
        return sigmoid(weighed(x) @ weights[:-1] + weights[-1])

    @staticmethod
    def is_quoted(before: bytes, word: bytes, after: bytes) -> int:
        """1 if marks stand on both sides within the window, or a word of reporting stands before."""
        before, word, after = (x.decode("utf-8", "replace") for x in (before, word, after))
        core = word.find(word.strip(STRIP)) if word.strip(STRIP) else 0
        before, after = before + word[:core], word[core:] + after
        if any(w.strip(STRIP).lower() in REPORTING for w in before.split()):
            return 1
        return int(any(q in before for q in QUOTES) and any(q in after for q in QUOTES))


def scanner_of(lexicon: Lexicon) -> Scanner:
    """The worker's scanner for a lexicon."""
    return worker_kept(("toxicity", tuple(lexicon.entries), tuple(lexicon.odds), tuple(lexicon.near or ()), lexicon.exceptions), lambda: Scanner(lexicon))


def _words(text: str = "text"):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


#: A text's smallest hash of five words in a row: equal in copies and most near copies.
_GRAM = "array_min(transform(sequence(1, greatest(size(w) - 4, 1)), i -> xxhash64(slice(w, i, 5))))"


def learn_entries(sample: DataFrame) -> Lexicon:
    """The words and stems that tell toxic from clean documents of (doc_id, text, y).

    Copies would count a document's every word many times over, so of texts with the
    same smallest five-word n-gram one is kept.  Words are counted by documents; counts
    of prefixes are sums over words.  An entry needs so many incidences that fewer than
    BY_CHANCE prefixes would all fall on toxic documents by luck.  From each shortest prefix that qualifies the entry
    is lengthened while nearly all incidences stay; an entry that ends most of them is
    a word, any other a stem.
    """
    docs = sample.select("y", _words().alias("w")).where("size(w) > 0").withColumn("gram", F.expr(_GRAM)).dropDuplicates(["gram"])
    n_clean, n_toxic = docs.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
    if not n_clean or not n_toxic:
        return Lexicon([], [])
    seen = docs.select("y", F.explode(F.array_distinct("w")).alias("w")).where(F.length("w") >= LEAST_LETTERS)
    seen = seen.groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    seen = persist(seen, "words")
    n, toxic, clean = seen.agg(F.sum(F.length("w") - LEAST_LETTERS + 1), F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return Lexicon([], [])
    least = max(3, math.ceil(math.log(BY_CHANCE / n) / math.log(toxic / (toxic + clean))))
    parts = seen.select("w", "toxic", "clean", F.explode(F.expr(f"transform(sequence({LEAST_LETTERS}, length(w)), n -> left(w, n))")).alias("p"))
    parts = parts.groupBy("p").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum(F.when(F.col("p") == F.col("w"), F.col("toxic")).otherwise(0)).alias("whole"))
    share = F.col("toxic") / n_toxic / (F.col("toxic") / n_toxic + F.col("clean") / n_clean)
    kept = parts.where((F.col("toxic") >= least) & (share >= LEAST_SHARE)).withColumn("share", share).collect()
    rows = {r.p: r for r in kept}
    longer: dict[str, list[str]] = {}
    for p in rows:
        longer.setdefault(p[:-1], []).append(p)
    out = Lexicon([], [])

    def add(p: str, is_stem: bool) -> None:
        out.entries.append((p, is_stem))
        out.odds.append(max(0.5, math.log((rows[p].toxic + 0.5) / n_toxic) - math.log((rows[p].clean + 0.5) / n_clean)))

    todo = sorted((p for p in rows if p[:-1] not in rows), key=lambda p: (rows[p].toxic, p))
    while todo:
        p = todo.pop()
        top = rows[p].toxic
        while (more := max(longer.get(p, ()), key=lambda q: (rows[q].toxic, q), default=None)) and rows[more].toxic >= 0.98 * top:
            p = more
        if rows[p].whole >= 0.9 * rows[p].toxic:
            add(p, False)
        elif rows[p].share >= STEM_SHARE:
            add(p, True)
        else:  # too many clean words go on from here: try the longer prefixes
            todo += longer.get(p, ())
            if rows[p].whole >= least:
                add(p, False)
    return out


def learn_near(sample: DataFrame, lexicon: Lexicon) -> None:
    """Adds to the lexicon what misspelled hits tell: the words of the sample's clean
    documents that lie near an entry without being one, as exceptions, and for each entry the
    log odds that another word near it speaks of a toxic document.

    Such words of toxic documents are counted, and SLIPS of the entry's own documents added;
    of clean documents, the words near an entry that only one of them has tell how many
    documents bring one that is not yet an exception (Good and Turing).  A misspelled hit is
    worth MISSPELLED of an exact one at most."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = scanner_of(shared.value).automaton
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {(m >> 2, w if m & 3 else None) for w in {w.strip(STRIP).lower() for w in set(text.split())} if (m := automaton.match(w)) >= 0}
                for k, w in found:
                    for column, value in zip(out, (k, y, w), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.string()), strict=True)], ["entry", "y", "word"])

    # one row for each entry and each word of the sample that lies near it: bounded as the sample
    found = sample.select("text", "y").mapInArrow(work, "entry int, y int, word string").groupBy("entry", "word").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).collect()
    lexicon.exceptions = frozenset(r.word for r in found if r.word is not None and r.clean)
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    slips, strays = np.zeros(len(lexicon.odds)), np.zeros(len(lexicon.odds))
    for r in found:
        slips[r.entry] += SLIPS * r.toxic if r.word is None else r.toxic * (r.clean == 0)
        strays[r.entry] += r.word is not None and r.clean == 1
    tells = np.log(np.maximum(slips, SLIPS) / size[1]) - np.log((strays + 0.5) / size[0])
    lexicon.near = np.minimum(np.array(lexicon.odds) * MISSPELLED, tells).tolist()


def score_features(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(shared.value)
        for batch in batches:
            x = scanner.features(batch.column(0))
            score = scanner.scores(x, shared.value.weights)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), *map(pa.array, x.T)], names=[*keep, "score", *FEATURES])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(text_col, *keep).mapInArrow(work, f"{kinds}, score double, " + ", ".join(f"{f} double" for f in FEATURES))


def learn(sample: DataFrame) -> Lexicon:
    """Entries and what their misspellings tell, with weights as they start."""
    lexicon = learn_entries(sample)
    if lexicon.entries:
        learn_near(sample, lexicon)
    return lexicon


def train(sample: DataFrame) -> Lexicon:
    """Learn entries and weights from a bounded sample (doc_id, text, y).  Without
    documents of both labels the lexicon is empty and every text scores alike.

    The weights are fitted on evidence found with the other half's entries; halves are told
    apart by the texts' smallest n-gram, so near copies mostly share one.  Where a half has
    no entries it adds no evidence to the fit."""
    tune(sample.sparkSession)
    half = F.when(F.size("w") > 0, F.pmod(F.expr(_GRAM), F.lit(2))).otherwise(0)
    sample = persist(sample.withColumn("w", _words()).withColumn("half", half).drop("w"), "toxicity-sample")
    lexicon = learn(sample.drop("half"))
    if not lexicon.entries:
        return lexicon
    rows = []
    for taught in (0, 1):
        other = learn(sample.where(F.col("half") == taught).drop("half"))
        if other.entries:
            rows += score_features(sample.where(F.col("half") != taught), other, "doc_id", "text", ["y"]).select("y", *FEATURES[:WEIGHED]).collect()
    if rows:
        data = np.array(rows, float)
        fitted = fit_logistic(weighed(data[:, 1:]), data[:, 0], np.append(PRIOR[:WEIGHED], PRIOR[-1]), 0.2, balanced=False)
        fitted[:-1] = np.maximum(fitted[:-1], 0)  # a hit never speaks for a text
        lexicon.weights = np.concatenate([fitted[:-1], np.zeros(len(FEATURES) - WEIGHED), fitted[-1:]])
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id and ``score`` (0 to 1), with the evidence
    in ``FEATURES``.  Null and empty texts have no hits and get the score of
    a text without hits.  Repeated rows score alike; an empty table gives none."""
    tune(docs.sparkSession)
    return score_features(docs, lexicon, id_col, text_col, [id_col])


def drop_toxic(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, all columns as they are.  Null and empty
    texts score as texts without hits; repeated rows fare alike, rows with a null id as any
    other; of an empty table nothing is left."""
    tune(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, w = scanner_of(shared.value), shared.value.weights
        for batch in batches:
            yield batch.filter(pa.array(scanner.scores(scanner.features(batch.column(place)), w) < threshold))

    return docs.mapInArrow(work, docs.schema)
