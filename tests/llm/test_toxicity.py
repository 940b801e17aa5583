"""Toxicity: clauses against their readings, held-out scores, and rows without text or labels."""

import random

import pytest
from dualcast.llm import queries, toxicity
from dualcast.llm.toxicity import Grammar, clause_counts
from pyspark.sql import functions as F

GRAMMAR = Grammar({"idiot": 2.0, "scum": 1.0, "blor*": 1.5})


@pytest.mark.parametrize("text, wanted", [
    ("You are an idiot.", {"insult_target": 2.0}),
    ("Idiot", {"insult": 2.0}), ("an Idiot", {"insult_epithet": 2.0}), ("really an idiot who is here", {"insult_epithet": 2.0}),
    ("everything here is scum", {"insult_predicate": 1.0}), ("not scum but idiot", {"insult_negated": 2.0}),
    ("You are not an idiot, scum", {"insult_negated": 2.0, "insult": 1.0}),
    ("she said idiot! and you are here", {"insult_reported": 2.0}),
    ("idiotic idiots", {}),
    ("blorp and xblorp; blor", {"insult": 3.0}),
    ("I will kill the lights", {}),
    ("I will kill you. I do not kill you, he said", {"threat_target": 1.0, "threat_negated": 1.0}),
    ("he killed the lights, they were hunted", {"threat_target": 2.0}), ("she says I kill you", {"threat_reported": 1.0}),
    ("er tötet dich", {"threat_target": 1.0}), ("scum idiot", {"insult": 2.0}), ("you kill, idiot", {"threat_target": 1.0, "insult": 2.0}),
    ("not here. idiot", {"insult": 2.0}),
    ("idiot\nidiot, idiot", {"insult": 6.0}),
    ("", {}), ("...", {}), ("idiot" * 50, {}),
])
def test_clauses(text, wanted):
    assert clause_counts(text, GRAMMAR) == wanted


def brute_counts(text, grammar):
    """Every clause by itself, word by word: each core in turn, with what stands before it and in the clause."""
    import re

    found = {}
    classes = {}
    for name, words in toxicity.CLOSED.items():
        for w in toxicity.threat_words() if name == "threat" else words.split():
            classes.setdefault(w, set()).add(name)
    for clause in re.split(r"[.,;:!?\n]+", text.lower()):
        words = re.findall(r"[^\W_]+(?:'[^\W_]+)*", clause)
        target = any("target" in classes.get(w, ()) for w in words)
        readings = []
        for i, word in enumerate(words):
            before = set().union(*(classes.get(w, set()) for w in words[:i]))
            weights = [w for t, w in grammar.insults.items() if (word.startswith(t[:-1]) if t.endswith("*") else word == t)]
            notes = [n for n, seen in (
                ("reported", "report" in before), ("negated", "negation" in before), ("target", target),
                ("predicate", "copula" in before), ("epithet", "determiner" in before)) if seen]
            readings += [(True, w, f"insult_{notes[0]}" if notes else "insult") for w in weights]
            if "threat" in classes.get(word, ()) and target:
                readings.append((False, 1.0, f"threat_{notes[0]}"))
        if readings:
            _, weight, kind = max(readings, key=lambda r: (r[0], r[1], -toxicity.KINDS.index(r[2])))
            found[kind] = found.get(kind, 0) + weight
    return found


def test_automaton_against_word_lists():
    rng = random.Random(4)
    words = ["you", "idiot", "scum", "blorx", "not", "said", "killed", "he", "table", "is", "the", "tu", "nie"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", ". ", "\n"]) for _ in range(rng.randrange(14)))
        assert clause_counts(text, GRAMMAR) == brute_counts(text, GRAMMAR), text


def test_held_out_scores(spark):
    """Invented insults in half of the documents' clauses; the held-out ones are told apart."""
    rng = random.Random(1)
    plain = [f"w{i}x" for i in range(300)]
    insults = ["grufty", "snorble", "plonker", "wazzoc"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        if toxic := i % 5 == 0:
            for at in rng.sample(range(40), 3):
                words[at] = rng.choice(insults)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    assert set(insults) <= {t.rstrip("*") for t in grammar.insults} | {i for i in insults for t in grammar.insults if t.endswith("*") and i.startswith(t[:-1])}
    rows = [r for r in toxicity.score_texts(docs, grammar).collect() if r["held_out"]]
    assert rows and all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in rows)
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, grammar).collect() if toxicity.held_out(r["doc_id"])} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_negated_and_reported_insults_score_less(spark):
    """Labels call the plain claim toxic and its denial or quotation clean; so do the scores of held-out texts."""
    rng = random.Random(3)
    claims = ["you are a {}", "he is {}", "that {}"]
    denials = ["you are not a {}", "she said he is {}", "he is never {}"]
    rows = []
    for i in range(1200):
        words = " ".join(f"w{rng.randrange(200)}x" for _ in range(20))
        form = rng.choice(claims if i % 6 == 0 else denials if i % 6 == 1 else claims + denials)
        about = rng.choice(["grufty", "snorble", "plonker"] if i % 6 < 2 else ["stone", "table", "river"])
        rows.append((i, f"{words}. {form.format(about)}. {words}", int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, grammar).collect() if r["held_out"]}
    claimed, denied = ([s for i, s in scores.items() if i % 6 == k] for k in (0, 1))
    assert min(claimed) > 0.5 and max(denied) < 0.3 and max(s for i, s in scores.items() if i % 6 > 1) < 0.3


def test_composed_machine_equals_its_parts():
    """Feeding one transducer's output to the next by hand gives the composed machine's kinds."""
    start, arcs, kinds = toxicity.machine()
    assert set(kinds.values()) == set(toxicity.KINDS)
    states = {s for s, _ in arcs}
    assert all((s, c) in arcs for s in states for c in toxicity.CLASSES)


def test_query_gives_every_row(spark, sf_dir):
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "idiot " * 60_000), (2, "idiot " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "toxic", "key", "held_out")})
    weights = [-3.0, 6.0] + [0.0] * 17
    grammar = Grammar({"idiot": 1.0}, weights)
    found = sorted((r["doc_id"] or 0, r["predicted"]) for r in toxicity.score_texts(df, grammar).collect())
    assert found == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert toxicity.keep_clean(df, grammar).count() == 2 and toxicity.keep_clean(df, grammar).columns == df.columns
    none = spark.createDataFrame([], "doc_id long, toxic int")
    nothing = toxicity.fit(df, none)
    assert {r["predicted"] for r in toxicity.score_texts(df, nothing).collect()} == {0}
