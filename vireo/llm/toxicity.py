"""Toxicity by terms: Levenshtein automata intersected with a trie of terms, and scores of the words around what they find.

**Lexicon.** A short list of abusive words in the table's languages starts it, and terms learned from labelled texts join it:
words that toxic training texts use in many different surroundings, and others hardly ever. Surroundings are counted, not texts,
so that copies of one text don't make its rare words into terms.

**Search.** All terms are one trie; the automaton that accepts what is within one edit of a term (two, for terms of nine letters
or more) runs over word and trie at once; two neighbouring letters that change places are one edit. Its states are sets of (trie node, edits), made into a deterministic automaton as words
need them: a word costs a table look-up for each letter until no term is left, and most words end at their third letter. Look-alike
signs (1 for i, @ for a), stretched letters and signs between letters are undone first. An inexact match counts for less, and not at
all where clean training texts use that very word.

**Context.** Around each match a window of words is read: quotation marks around it and words of reporting before it ("called",
"the word") say that it is quoted, words of address ("you") that it is meant. A quoted match counts a quarter, an addressed one
more.

The score is a logistic regression over sums of such matches, fitted on labelled training texts. Training rows are those whose
crc32 of doc_id isn't divisible by 5; if there are more than FIT_ROWS of them, a sample by hash of about that number, a documented
bound on the fit alone: every row is scored, on its whole text. The model (terms and a dozen numbers) is what tasks are sent.

Defined cases: null and empty texts have no matches, and get the score of that; of several labels of a doc_id the greatest holds;
null labels are none; without labelled rows of both kinds the built-in model is used; repeated rows are scored each; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import materialize, read_table, small_batches

FIT_ROWS = 40_000  # labelled training texts that the model is fitted on, about
MAX_TERMS = 5_000  # learned terms, the best attested ones
CANDIDATES = 200_000  # words that are looked up in clean texts
SURROUNDINGS = 2  # different ones (in as many texts) that a learned term is seen in, at least
WINDOW = 4  # words read on either side of a match

#: Words of abuse that the lexicon starts with.
SEED_TERMS = (
    "idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumbass", "loser", "losers", "scum", "scumbag", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard",
    "bitch", "asshole", "retard", "vermin", "filthy", "trottel", "arschloch", "schwachkopf", "abschaum", "dummkopf", "connard", "salaud", "abruti", "crétin", "ordure", "gilipollas",
    "imbécil", "estúpido", "cabrón", "basura", "escoria",
)
#: Words of reporting and of address in the same languages.
REPORTING = frozenset("said says called calls calling wrote quote quoted quotes word words term terms slur slurs insult insults sagte nannte wort zitat dit appelé mot citation dijo llamó palabra cita".split())
ADDRESS = frozenset("you your youre ur u yourself du dich dir dein ihr euch tu te toi ton vous vos tú ti usted eres".split())
#: Signs that stand for letters.
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasii")
QUOTES = frozenset("\"“”„«»‘’")

_ENDS = ".,;:!?()[]{}*|\"“”„«»‘’"
_STRETCHED = re.compile(r"(.)\1{2,}")
_SIGNS = re.compile(r"[\W_]+")


def plain(token: str) -> str:
    """A lower-case token as letters: look-alikes undone, signs dropped, stretched letters single. Marks at the ends are no look-alikes."""
    token = token.strip(_ENDS)
    return _STRETCHED.sub(r"\1", _SIGNS.sub("", token.translate(LOOK_ALIKE)))


def edits_allowed(term: str) -> int:
    """Edits within which a word is a misspelling of the term: short terms have too many neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """Terms as a trie, and the automaton of what is within their edits (two neighbouring letters that change places are one edit too),
    made as words ask for it.

    States of the automaton are sets of (node, letter, edits so far), without those that another one of the set implies. With a letter,
    that one must come next: the second of two that have changed places. It holds MAX_STATES at most, and starts anew beyond.
    """

    MAX_STATES = 200_000

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = sorted(set(terms))
        self._next: list[dict[str, int]] = [{}]
        self._most, self._end = [0], [-1]  # the most edits of any term below a node; the term that ends there
        for number, term in enumerate(self.terms):
            node, allowed = 0, edits_allowed(term)
            for letter in term:
                self._most[node] = max(self._most[node], allowed)
                if letter not in self._next[node]:
                    self._next[node][letter] = len(self._next)
                    self._next.append({})
                    self._most.append(0)
                    self._end.append(-1)
                node = self._next[node][letter]
            self._most[node] = max(self._most[node], allowed)
            self._end[node] = number
        self._clear()

    def _clear(self) -> None:
        self._moves: list[dict[str, int]] = []
        self._sets: list[list[tuple[int, str, int]]] = []
        self._ids: dict[frozenset, int] = {}
        self._start = self._state({(0, "", 0)})

    def _state(self, found: set[tuple[int, str, int]]) -> int:
        """The number of a set of (node, letter, edits), closed under leaving letters of terms out; -1 for the empty set."""
        least: dict[tuple[int, str], int] = {}
        todo = list(found)
        while todo:
            node, due, e = todo.pop()
            if e > self._most[node] or least.get((node, due), 99) <= e:
                continue
            least[node, due] = e
            if not due:
                todo += [(below, "", e + 1) for below in self._next[node].values()]
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append([(node, due, e) for (node, due), e in least.items()])
            self._moves.append({})
        return self._ids[key]

    def _move(self, state: int, letter: str) -> int:
        found = set()
        for node, due, e in self._sets[state]:
            if due:
                if due == letter:
                    found.add((node, "", e))
                continue
            found.add((node, "", e + 1))  # the word has a letter more
            for a, below in self._next[node].items():
                found.add((below, "", e + (a != letter)))
                if a != letter and letter in self._next[below]:
                    found.add((self._next[below][letter], a, e + 1))
        to = self._state(found)
        self._moves[state][letter] = to
        return to

    def nearest(self, word: str) -> tuple[int, int] | None:
        """Number and edits of the nearest term (of equals the first) that word is within the edits of; None if there is none."""
        if len(self._sets) > self.MAX_STATES:
            self._clear()
        state, moves = self._start, self._moves
        for letter in word:
            to = moves[state].get(letter)
            if to is None:
                to = self._move(state, letter)
            if to < 0:
                return None
            state = to
        ends = [(e, self._end[node]) for node, due, e in self._sets[state] if not due and self._end[node] >= 0 and e <= edits_allowed(self.terms[self._end[node]])]
        return min(ends)[::-1] if ends else None


FEATURES = ("meant", "quoted", "density", "terms", "inexact", "inexact_density")


@dataclass(frozen=True)
class Model:
    """terms: weight of each (0 to 1). crowded: words beside a term (within its edits) that clean texts use. known: those words. weights: of FEATURES, and the intercept."""

    terms: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_TERMS, 1.0))
    crowded: dict[str, int] = field(default_factory=dict)
    known: frozenset = frozenset()
    weights: tuple[float, ...] = (2.0, 0.5, 0.5, 1.0, 2.0, 0.8, -3.0)


class Scorer:
    """A model at work in a task: remembers what each token was found to be, up to HELD of them."""

    HELD = 400_000

    def __init__(self, model: Model) -> None:
        self.model, self.trie = model, FuzzyTrie(model.terms)
        self._seen: set[str] = set()
        self._hits: dict[str, tuple[int, float, bool]] = {}

    def _look_up(self, tokens: set[str]) -> None:
        if len(self._seen) > self.HELD:
            self._seen.clear()
            self._hits.clear()
        for token in tokens - self._seen:
            word = plain(token)
            found = self.trie.nearest(word) if len(word) > 2 else None
            if found and not (found[1] and word in self.model.known):
                number, edits = found
                term = self.trie.terms[number]
                # a term with neighbours in clean texts is hardly what an unknown neighbour means
                weight = 1.0 if not edits else 1 / edits / (1 + self.model.crowded.get(term, 0))
                self._hits[token] = (number, self.model.terms[term] * weight, bool(edits))
        self._seen |= tokens

    def matches(self, text: str | None) -> list[tuple[int, int, float, bool, float]]:
        """(place, number of the term, weight, inexact, context) of each word that matches; context: 1, less if quoted, more if addressed."""
        tokens = (text or "").lower().split()
        self._look_up(set(tokens))
        hits = self._hits
        return [(k, *hits[t], self._context(tokens, k)) for k, t in enumerate(tokens) if t in hits]

    @staticmethod
    def _context(tokens: list[str], k: int) -> float:
        before, own, after = tokens[max(0, k - WINDOW) : k], tokens[k], tokens[k + 1 : k + 1 + WINDOW]
        # a quotation opens at the word or before it, and closes at it or after it
        opens = own[0] in QUOTES or any(t[0] in QUOTES for t in before)
        closes = own.rstrip(".,;:!?")[-1:] in QUOTES or any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
        words = {plain(t) for t in before}
        quoted = (opens and closes) or not words.isdisjoint(REPORTING)
        meant = not words.isdisjoint(ADDRESS) or any(plain(t) in ADDRESS for t in after)
        return 0.25 if quoted else 1.5 if meant else 1.0

    def features(self, text: str | None) -> tuple[float, ...]:
        found = self.matches(text)
        if not found:
            return (0.0,) * len(FEATURES)
        exact = [(w, c, t) for _, t, w, x, c in found if not x]
        meant = sum(w * c for w, c, _ in exact if c >= 1)
        quoted = sum(w * c for w, c, _ in exact if c < 1)
        inexact = sum(w * c for _, _, w, x, c in found if x)
        n = len((text or "").split())
        raw = (meant, quoted, 100 * meant / n, len({t for _, c, t in exact if c >= 1}), inexact, 100 * inexact / n)
        return tuple(float(np.log1p(v)) for v in raw)

    def score(self, text: str | None) -> float:
        *w, bias = self.model.weights
        z = bias + sum(a * b for a, b in zip(w, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def misspelled(scorer: Scorer, text: str | None) -> str:
    """A text whose exact matches of five letters and more have two neighbouring letters made one: an example of what to catch."""
    tokens = (text or "").split()
    for k, number, _, inexact, _ in scorer.matches(text):
        term = scorer.trie.terms[number]
        if not inexact and len(term) >= 5:
            tokens[k] = term[: len(term) // 2] + term[len(term) // 2 + 1 :]
    return " ".join(tokens)


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's steps over rows that stand for n each, the intercept unpenalised; weights and then the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null doc_id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic and fold (0 or 1) of labelled training rows, a written table of about ``rows`` rows: labels are few enough then to be sent to all tasks."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = materialize(known.filter(~held_out(F.col("doc_id"))))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    # repeated doc_ids with one text are one example, so a hot doc_id is not the sample
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")  # copies of a text are in one fold
    return materialize(found.select("text", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")))


@functools.lru_cache(maxsize=1 << 17)
def _plain(token: str) -> str:
    return plain(token)


def _words(text: str | None) -> list[str]:
    return [w for w in map(_plain, (text or "").lower().split()) if len(w) > 2]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def _rows(out: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_AROUND = pa.schema([("fold", pa.int32()), ("word", pa.string()), ("around", pa.int64()), ("text", pa.int64())])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, word, around, text): words of texts with hashes of their two neighbours and of the text, once each in a batch."""
    for batch in batches:
        out = set()
        for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, of = _words(text), _hash(text or "")
            out.update((fold, w, _hash(f"{a} {b}"), of) for a, w, b in zip(["", *words], words, [*words[1:], ""]))
        yield _rows(out, _AROUND)


def _evidence(toxic: int, clean: int, prior: float) -> float:
    """By how much (in natural logarithms) a word's share of toxic uses is beyond chance, at least: the Chernoff bound; 0 if it isn't."""
    n = toxic + clean
    q = toxic / n
    if q <= prior:
        return 0.0
    return n * (q * math.log(q / prior) + ((1 - q) * math.log((1 - q) / (1 - prior)) if q < 1 else 0.0))


def chosen_terms(counts: dict[str, tuple[int, int]], prior: float) -> dict[str, float]:
    """Terms and weights from (toxic, clean) counts of words: seeds, and words whose evidence stands against as many trials as there are words."""
    needed = math.log(max(2, len(counts))) + 3
    rate = lambda t, c, more: (t + more) / (t + c + more)
    found = {w: e for w, (t, c) in counts.items() if t >= SURROUNDINGS and rate(t, c, 0) >= 0.7 and (e := _evidence(t, c, prior)) >= needed}
    best = sorted(found, key=lambda w: (-found[w], w))[:MAX_TERMS]
    seeds = {w: rate(*counts.get(w, (0, 0)), 1) for w in map(plain, SEED_TERMS)}
    return {w: x for w, x in seeds.items() if x > 0.1} | {w: rate(*counts[w], 0) for w in best}


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of labelled training rows. Weights are fitted on features that terms of the other half of the texts give, so that no
    text speaks for its own terms; toxic texts stand once more with their terms misspelled."""
    spark = docs.sparkSession
    texts = training_texts(docs, labels, rows)
    n = {(r["fold"], r["toxic"]): r["n"] for r in texts.groupBy("fold", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not all(sum(v for (_, t), v in n.items() if t == toxic) for toxic in (0, 1)):
        return Model()
    toxic, clean = texts.filter("toxic > 0").select("text", "fold"), texts.filter("toxic <= 0").select("text", "fold")

    # copies of a text have the same surroundings: each surrounding speaks for one text, and texts are counted
    around = toxic.mapInArrow(_surroundings, "fold int, word string, around long, text long").groupBy("fold", "word", "around").agg(F.min("text").alias("text"))
    used = around.groupBy("fold", "word").agg(F.countDistinct("text").alias("n"))
    wide = used.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).alias(f"n{f}") for f in (0, 1)))
    wide = wide.filter(F.col("n0") + F.col("n1") >= SURROUNDINGS).orderBy(F.desc(F.col("n0") + F.col("n1")), "word").limit(CANDIDATES)
    attested = {r["word"]: (r["n0"], r["n1"]) for r in wide.collect()}
    asked = spark.sparkContext.broadcast(frozenset(attested) | {plain(w) for w in SEED_TERMS})

    counted = pa.schema([("fold", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[fold].update(asked.value.intersection(_words(text)))
        yield _rows([(f, w, c) for f in (0, 1) for w, c in held[f].items()], counted)

    innocent: dict[str, list[int]] = {}
    for r in clean.mapInArrow(count, "fold int, word string, n long").groupBy("fold", "word").agg(F.sum("n").alias("n")).collect():
        innocent.setdefault(r["word"], [0, 0])[r["fold"]] = r["n"]

    def terms_of(folds: tuple[int, ...]) -> dict[str, float]:
        bad, good = (sum(n.get((f, t), 0) for f in folds) for t in (1, 0))
        counts = {w: (sum(attested.get(w, (0, 0))[f] for f in folds), sum(innocent.get(w, (0, 0))[f] for f in folds)) for w in asked.value}
        return chosen_terms({w: x for w, x in counts.items() if sum(x)}, max(bad, 1) / max(bad + good, 2))

    chosen = [terms_of(folds) for folds in ((0,), (1,), (0, 1))]
    every = spark.sparkContext.broadcast(FuzzyTrie(set().union(*chosen)).terms)
    beside = pa.schema([("fold", pa.int32()), ("word", pa.string()), ("term", pa.string())])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, seen, out = FuzzyTrie(every.value), (set(), set()), []
        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(_words(text)) - seen[fold]:
                    seen[fold].add(w)
                    if (found := trie.nearest(w)) and found[1]:
                        out.append((fold, w, trie.terms[found[0]]))
        yield _rows(out, beside)

    close = [(r["fold"], r["word"], r["term"]) for r in clean.mapInArrow(neighbours, "fold int, word string, term string").distinct().collect()]

    def model_of(terms: dict[str, float], folds: tuple[int, ...]) -> Model:
        near = {(w, t) for f, w, t in close if f in folds and t in terms}
        return Model(terms, dict(Counter(t for _, t in near)), frozenset(w for w, _ in near))

    models = [model_of(terms, folds) for terms, folds in zip(chosen, ((0,), (1,), (0, 1)))]
    sent = spark.sparkContext.broadcast(models[:2])
    names = [f"f{k}" for k in range(len(FEATURES))]
    measured = pa.schema([("toxic", pa.int32()), *((c, pa.float64()) for c in names)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in sent.value]
        for batch in batches:
            out = []
            for text, label, fold in zip(*(batch.column(k).to_pylist() for k in range(3))):
                scorer = scorers[1 - fold]
                out.append((int(label > 0), *scorer.features(text)))
                if label > 0:
                    out.append((1, *scorer.features(misspelled(scorer, text))))
            yield _rows(out, measured)

    # equal rows are one with a number: a table of FIT_ROWS rows or so at most, most of them without a match
    found = texts.select("text", "toxic", "fold").mapInArrow(measure, ", ".join(["toxic int", *(f"{c} double" for c in names)]))
    table = found.groupBy("toxic", *names).agg(F.count("*").alias("n")).collect()
    x = np.array([[r[c] for c in names] for r in table])
    return replace(models[2], weights=fit_weights(x, np.array([float(r["toxic"]) for r in table]), np.array([float(r["n"]) for r in table])))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and matches (words that match a term) of every document, by its text alone."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("matches", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = batch.column(0), pa.array([scorer.score(t) for t in texts]), pa.array([len(scorer.matches(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double, matches long")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and matches of all documents, by a model of the labels of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")
