"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexer turns a clause into marks: insults, verbs of threat, targets, copulas, determiners, negations and verbs of
reported speech that begin at a word. Each part of the grammar is a transducer of its own: one chooses the insult or
threat that a clause is read for, the others note whether it is addressed, predicated, an epithet, negated or
reported. Composed they are one machine, and a clause takes its best path through it. A clause in which nothing but
the insult is noted is a kind of its own, with the weight that labels give it. The score of a document is a logistic function of what its clauses were matched as.

The weights of the function and the insults come from labelled documents. Insults are words, or
beginnings of words, that toxic documents hold far more often than others.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, materialize, text_of

#: Labelled documents that a fit uses at most, the terms it looks at, and the insults that it keeps.
SAMPLE_ROWS, CANDIDATES, LEXICON = 20_000, 4_000, 400
#: Beginnings of words that are counted besides words, and in how many toxic documents a term must be.
STEMS, LEAST_DOCUMENTS = (4, 5, 6, 7), 3
#: A toxic document's weight is multiplied by this for each insult chosen from it; the weight an insult must have.
EXPLAINED, LEAST_WEIGHT = 0.5, 2.0
#: The least evidence (lower bound of the log odds) of an insult.
LEAST_EVIDENCE = 1.0
HELD_OUT, FOLDS, THRESHOLD = 2, 4, 0.3

#: Words of the grammar's closed classes.
CLOSED = {
    "threat": "umbringen umbringt umbrachte tuer tue tues tuent tué tuera matar mato matas mata matan mataré matará mató",
    "target": "you your yours he she they him her them du dich dein ihr euch sie tu te toi vous ton tú ti usted ustedes",
    "copula": "am is are was were be been being bin bist ist sind seid war suis es est sommes êtes sont était soy eres era somos son",
    "determiner": "a an the this that these those such der die das den dem ein eine einen einer dieser diese dieses "
    "le la les un une des ce cette ces el los las una unos unas ese esa este esta",
    "negation": "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun no nunca jamás",
    "report": "said says wrote called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
#: Stems of regular verbs of threat and their endings.
THREAT_VERBS = {
    "kill hunt destroy burn": "- s ed ing", "hurt beat": "- s ing", "beat": "en", "töt verletz": "e est t et en te ete ten eten",
    "frapp brûl": "e es ons ez ent er é era", "golpe quem": "o as a an ar ó ado aré ará",
}
CORES = ("insult", "threat")
CLASSES = ("insult", *CLOSED)
_CLAUSE = re.compile(r"[.,;:!?\n]+")
#: What a clause can be matched as; a document counts each kind.
KINDS = (
    "insult", "insult_target", "insult_predicate", "insult_epithet", "insult_negated", "insult_reported", "threat_target", "threat_negated", "threat_reported",
)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def held_out_column(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


# ---- transducers -------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Weighted arcs by (state, input): (output, weight, next state). Final states have the notes that they add.

    An arc's weight counts times the weight of the mark that it reads.
    """

    start: object
    arcs: dict
    finals: dict


def chooser() -> Transducer:
    """Marks any one insult or threat as the core of the clause and passes all other marks on."""
    arcs = {(s, c): [(c, 0.0, s)] for s in (0, 1) for c in CLASSES}
    for c in CORES:
        arcs[0, c] = [*arcs[0, c], (f"core_{c}", 1.0, 1)]
    return Transducer(0, arcs, {1: frozenset()})


def noticer(note: str, first: str | None, second: Iterable[str]) -> Transducer:
    """Notes that ``first`` stands before one of ``second`` (or, without ``first``, that one of ``second`` occurs)."""
    symbols = [*CLASSES, *(f"core_{c}" for c in CORES)]
    arcs = {(s, c): [(c, 0.0, s)] for s in (0, 1, 2) for c in symbols}
    if first:
        arcs[0, first] = [(first, 0.0, 1)]
    for c in second:
        arcs[1 if first else 0, c] = [(c, 0.0, 2)]
    return Transducer(0, arcs, {0: frozenset(), 1: frozenset(), 2: frozenset([note])})


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that feeds what ``a`` writes to ``b``; its states are the pairs that can be reached."""
    start = (a.start, b.start)
    arcs, seen, todo = {}, {start}, [start]
    by_state: dict = {}
    for (p, x), out in a.arcs.items():
        by_state.setdefault(p, []).append((x, out))
    while todo:
        p, q = here = todo.pop()
        for x, out in by_state.get(p, ()):
            found = [(z, v + w, (n, m)) for y, v, n in out for z, w, m in b.arcs.get((q, y), ())]
            arcs[here, x] = found
            for _, _, state in found:
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
    finals = {(p, q): a.finals[p] | b.finals[q] for p, q in seen if p in a.finals and q in b.finals}
    return Transducer(start, arcs, finals)


def kind_of(notes: frozenset) -> str | None:
    """The kind of a clause with these notes; a threat needs a target."""
    core = "insult" if "insult" in notes else "threat"
    if core == "threat" and "target" not in notes:
        return None
    order = ("reported", "negated", "target", "predicate", "epithet") if core == "insult" else ("reported", "negated", "target")
    return next((f"{core}_{n}" for n in order if n in notes), core)


@lru_cache(maxsize=1)
def machine() -> tuple[int, dict, dict]:
    """The composed grammar with numbered states: start, arcs and the kinds of its final states."""
    cores = [f"core_{c}" for c in CORES]
    parts = [
        noticer("insult", None, ["core_insult"]), noticer("target", None, ["target"]), noticer("predicate", "copula", ["core_insult"]),
        noticer("epithet", "determiner", ["core_insult"]), noticer("negated", "negation", cores), noticer("reported", "report", cores),
    ]
    whole = reduce(compose, parts, chooser())
    number: dict = {}
    for (state, _), out in whole.arcs.items():
        for s in (state, *(n for _, _, n in out)):
            number.setdefault(s, len(number))
    arcs = {(number[s], x): [(w, number[n]) for _, w, n in out] for (s, x), out in whole.arcs.items()}
    kinds = {number[s]: kind for s, notes in whole.finals.items() if (kind := kind_of(notes))}
    return number[whole.start], arcs, kinds


def clause_kind(marks: Iterable[tuple[str, float]]) -> tuple[str, float] | None:
    """Kind and weight of the best path of a clause's marks: insults before threats, then the heaviest, then the first of ``KINDS``."""
    start, arcs, kinds = machine()
    best = {start: 0.0}
    for name, weight in marks:
        after: dict[int, float] = {}
        for state, total in best.items():
            for factor, end in arcs[state, name]:
                value = total + factor * weight
                if value > after.get(end, -1.0):
                    after[end] = value
        best = after
    ends = [(kinds[s].startswith("insult"), w, -KINDS.index(kinds[s])) for s, w in best.items() if s in kinds]
    return (KINDS[-top[2]], top[1]) if ends and (top := max(ends)) else None


# ---- documents ---------------------------------------------------------------------------


def threat_words() -> list[str]:
    stems = [(stem, end) for stems, ends in THREAT_VERBS.items() for stem in stems.split() for end in ends.split()]
    return [*CLOSED["threat"].split(), *(stem + end.strip("-") for stem, end in stems)]


@dataclass
class Grammar:
    """Insult terms with weights (``stem*`` matches beginnings) and the weights of the document function."""

    insults: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    automata: tuple | None = None

    def lexers(self) -> tuple:
        """Two lexers, terms to (class, weight, whole word): one of insults and threats, one of all classes."""
        if self.automata is None:
            import ahocorasick

            cores = [(t.rstrip("*"), ("insult", w, not t.endswith("*"))) for t, w in self.insults.items()]
            cores += [(word, ("threat", 1.0, True)) for word in dict.fromkeys(threat_words())]
            others = [(w, (c, 0.0, True)) for c, words in CLOSED.items() if c != "threat" for w in dict.fromkeys(words.split())]
            made = []
            for entries in (cores, cores + others):
                automaton, arcs = ahocorasick.Automaton(), {}
                for word, output in entries:
                    arcs.setdefault(word, []).append(output)
                for word, outputs in arcs.items():
                    automaton.add_word(word, (len(word), outputs))
                automaton.make_automaton()
                made.append(automaton)
            self.automata = tuple(made)
        return self.automata


def _marks(automaton, low: str, begin: int, end: int) -> list[tuple[int, str, float]]:
    """(place, class, weight) of the terms between two places that begin at a word."""
    found = []
    for last, (length, outputs) in automaton.iter(low, begin, end):
        at = last - length + 1
        if at and (low[at - 1].isalnum() or low[at - 1] == "'"):
            continue
        whole = last + 1 == len(low) or not low[last + 1].isalnum()
        found += [(at, name, weight) for name, weight, word in outputs if whole or not word]
    return found


def clause_counts(text: str, grammar: Grammar) -> dict[str, float]:
    """Weights of the matched clauses of a text, summed by kind."""
    low = text.lower()
    cores, every = grammar.lexers()
    found: dict[str, float] = {}
    done = -1
    for core in sorted({at for at, _, _ in _marks(cores, low, 0, len(low))}):
        if core < done:
            continue  # in the clause that was read last
        begin = max((m.end() for m in _CLAUSE.finditer(low, max(0, done), core)), default=max(0, done))
        ends = _CLAUSE.search(low, core)
        done = ends.start() if ends else len(low)
        kind = clause_kind((name, weight) for _, name, weight in sorted(_marks(every, low, begin, done)))
        if kind:
            found[kind[0]] = found.get(kind[0], 0.0) + kind[1]
    return found


def document_features(text: str, grammar: Grammar) -> list[float]:
    """A constant, then per kind whether it occurs and the logarithm of its weight."""
    counts = clause_counts(text, grammar)
    return [1.0, *(float(k in counts) for k in KINDS), *(math.log1p(counts.get(k, 0.0)) for k in KINDS)]


def score(features: list[float], weights: list[float]) -> float:
    z = sum(w * x for w, x in zip(weights, features))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Stored (text, toxic) of at most ``rows`` labelled ids, never of the held-out fold: those of the least hashes.

    The bounded list of ids is broadcast, so the texts are not shuffled.
    """
    known = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out_column("k")).groupBy("k").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit("toxicity"), "k"), "k").limit(rows)
    found = docs.select(F.col(doc_id).alias("k"), text_of(text).alias("text")).join(F.broadcast(known), "k")
    return materialize(found.select("text", "toxic"))


def fit_insults(sample: DataFrame) -> dict[str, float]:
    """Terms by the lower bound of their log odds in toxic documents; a stem replaces the words it covers."""

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(cells(batch, "text"), cells(batch, "toxic")):
                (toxic if label else other).update(_terms(text))
        terms = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())],
            ["term", "toxic", "other"],
        )

    counted = arrow_pass(sample, passes, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("other").alias("b")
    )
    sizes = sample.groupBy().agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_other = int(sizes["a"] or 0), int(sizes["n"] - (sizes["a"] or 0))
    if not n_toxic or not n_other:
        return {}
    odds = F.log((F.col("a") + 0.5) / (n_toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n_other - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counted.where(F.col("a") >= LEAST_DOCUMENTS).select("term", "b", (odds - 1.65 * error).alias("evidence"))
    top = best.where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "term").limit(CANDIDATES).collect()
    others = {r["term"]: r["b"] for r in top}

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(others.keys() & _terms(t)) for t in cells(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

    # at most the sample's toxic rows; copies of a text count once, other texts with the same terms do count
    toxic = arrow_pass(sample.where("toxic = 1").select("text").distinct(), holds, "terms array<string>").where(F.size("terms") > 0)
    groups = toxic.groupBy("terms").count().collect()
    return choose_insults([r["terms"] for r in groups], [r["count"] for r in groups], others, n_other)


def choose_insults(documents: list[list[str]], counts: list[int], others: dict[str, int], n_other: int) -> dict[str, float]:
    """The terms that explain toxic documents best, one after the other, with their evidence as weight.

    ``documents`` are distinct lists of terms, ``counts`` the documents that hold them.

    Words that merely stand in a few copied toxic documents share them with words that explain many.
    """
    weight, total = np.array(counts, dtype=float), sum(counts)
    rows: dict[str, list[int]] = {}
    for i, terms in enumerate(documents):
        for term in terms:
            rows.setdefault(term, []).append(i)
    rows = {t: np.array(r) for t, r in rows.items()}
    found: dict[str, float] = {}

    def evidence(term: str) -> float:
        a, b = float(weight[rows[term]].sum()), others[term]
        if a < LEAST_WEIGHT:
            return -math.inf
        odds = math.log((a + 0.5) / (total - a + 0.5)) - math.log((b + 0.5) / (n_other - b + 0.5))
        return odds - 1.65 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    left = set(rows)
    while left and len(found) < LEXICON:
        best, term = max((evidence(t), t) for t in left)
        if best < LEAST_EVIDENCE:
            break
        found[term] = min(3.0, best)
        base = term.rstrip("*")  # neither its own stems nor the words it covers
        left = {t for t in left if not base.startswith(t.rstrip("*")) and not (t.startswith(base) and term.endswith("*"))}
        weight[rows[term]] *= EXPLAINED
    return found


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> list[float]:
    """Logistic regression by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(hessian, x.T @ (p - y) + penalty @ w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Grammar:
    """A grammar from the labelled documents outside the held-out fold.

    Without a toxic and a clean labelled document there are no insults and every score is the prior: 0.
    """
    sample = training_sample(docs, labels, doc_id, text)
    insults = fit_insults(sample)
    width = 1 + 2 * len(KINDS)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for batch in batches:
            found = [document_features(t, grammar) for t in cells(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    # at most the sample's rows, as counts of equal feature vectors
    rows = arrow_pass(sample, passes, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    if not insults or not rows:
        return Grammar({}, [-30.0] + [0.0] * (width - 1))
    x, y, n = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), [r["count"] for r in rows]
    return Grammar(insults, fit_weights(np.repeat(x, n, axis=0), np.repeat(y, n)))


def score_texts(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``held_out``, ``score`` and ``predicted`` for every row; null and empty texts get the prior."""
    kind = dict(docs.dtypes)[key]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(document_features(t, grammar), grammar.weights) for t in cells(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["key", "held_out", "score"])

    rows = docs.select(F.col(key).alias("key"), held_out_column(key).alias("held_out"), text_of(text).alias("text"))
    scored = arrow_pass(rows, passes, f"key {kind}, held_out boolean, score double")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = (t or "" for t in batch.column(at).to_pylist())
            clean = [score(document_features(t, grammar), grammar.weights) < THRESHOLD for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return arrow_pass(docs, passes, docs.schema)
