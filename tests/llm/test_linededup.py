"""Line dedup against the properties that its fingerprints guarantee, checked by brute force."""

import random

import pytest
from dualcast.llm.linededup import GRAM_WORDS, WINDOW_WORDS, dedup_lines
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string"


def run(spark, rows, schema=SCHEMA):
    found = dedup_lines(spark.createDataFrame(rows, schema).repartition(4))
    return {r["row"]["doc_id"]: (r["n_deleted"], r["text"]) for r in found.collect()}


def lines_of(text):
    return [" ".join(line.split()) for line in (text or "").split("\n") if line.split()]


def runs_from(lines, i, words):
    """The shortest run from line i with at least so many words, or None."""
    total = 0
    for j in range(i, len(lines)):
        total += len(lines[j].split())
        if total >= words:
            return tuple(lines[i : j + 1])
    return None


def check(rows, found):
    rows = sorted((r[0], r[1]) for r in rows)
    sequences = {d: lines_of(t) for d, t in rows}
    first, repeated = {}, {}
    for d, lines in sequences.items():
        for i in range(len(lines)):
            first.setdefault(lines[i], (d, i))
            for words in (GRAM_WORDS, WINDOW_WORDS):
                if found_run := runs_from(lines, i, words):
                    repeated.setdefault((words, found_run), []).append((d, i))
    for d, lines in sequences.items():
        kept, deleted, at = lines_of(found[d][1]), set(), 0
        for i, line in enumerate(lines):  # which lines went: those that the kept ones, in order, leave out
            if at < len(kept) and kept[at] == line and len(lines) - i > 0:
                at += 1
            else:
                deleted.add(i)
        assert at == len(kept) and found[d][0] == len(deleted)
        for i in deleted:
            assert lines[i] in {l for e, s in sequences.items() if e <= d for l in s}
        covered = {
            i + k for i in range(len(lines)) if (g := runs_from(lines, i, GRAM_WORDS))
            and len(repeated[GRAM_WORDS, g]) > 1 for k in range(len(g))
        }
        for i in range(len(lines)):
            window = runs_from(lines, i, WINDOW_WORDS)
            if window and repeated[WINDOW_WORDS, window][0] < (d, i) and repeated[WINDOW_WORDS, window][0][0] != d:
                assert deleted & set(range(i, i + len(window))), (d, i)
        if not covered:
            assert not deleted


@pytest.mark.parametrize("seed", [1, 2])
def test_guarantees(spark, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [[line(rng.choice((1, 4, 9, 20, 60))) for _ in range(rng.randrange(1, 12))] for _ in range(6)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [line(rng.randrange(1, 40))]
            parts += [""] * (rng.random() < 0.2)
        rows.append((d, "\n".join(parts), "s"))
    check(rows, run(spark, rows))


def test_passage_goes_and_clean_text_stays(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    spread = "\n".join(" ".join(f"q{i}-{j}" for j in range(9)) for i in range(7))
    rows = [
        (1, f"one own line\n{passage}\nthe end", "s"), (2, f"another line\n\n{passage}", "s"),
        (3, f"short\n{spread}\nlast", "s"), (4, f"{spread}", "s"), (5, "short\nlast\nshort", "s"),
    ]
    found = run(spark, rows)
    assert found[1] == (0, rows[0][1]) and found[3] == (0, rows[2][1]) and found[5] == (0, rows[4][1])
    assert found[2] == (1, "another line\n") and found[4] == (7, "")


def test_odd_rows(spark):
    long_line = " ".join(f"x{i}" for i in range(60))
    rows = [
        (None, long_line, "a"), (1, None, "a"), (2, "", "a"), (3, "\n\n", "a"), (4, long_line, "a"), (4, long_line, "a"),
        (5, "\n".join(["la la"] * 5000), "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("lines", "gram", "row", "h", "digest", "runs")})
    found = [(r["row"]["doc_id"], r["n_deleted"], r["text"]) for r in dedup_lines(df).collect()]
    assert len(found) == 7
    assert (None, 0, long_line) in found and found.count((4, 1, "")) == 2
    assert {(1, 0, None), (2, 0, ""), (3, 0, "\n\n")} <= set(found)
    (loop,) = [f for f in found if f[0] == 5]
    assert loop[1] > 4900 and set(loop[2].split("\n")) == {"la la"}
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
