"""The edit-distance join: pieces of one row against substrings of others, told apart by the piece behind."""

import random

from pyspark.sql import functions as F

from seqaudit.operators import similarity as sim
from seqaudit.operators.components import connected_components
from seqaudit.session import cut
from test_similarity import as_map, components, levenshtein


def edited(rnd, s, edits):
    t = list(s)
    for _ in range(edits):
        at = rnd.randrange(len(t))
        kind = rnd.random()
        if kind < 0.4:
            t[at] = rnd.choice("ACGT")
        elif kind < 0.7 and len(t) > 1:
            del t[at]
        else:
            t.insert(at, rnd.choice("ACGT"))
    return "".join(t)


def test_one_edit_from_a_prefix(spark):
    rnd, rows = random.Random(3), []
    for _ in range(600):
        w = rnd.randint(1, sim.BEHIND)
        piece = "".join(rnd.choice("ACGT") for _ in range(w))
        text = edited(rnd, piece, rnd.choice([0, 1, 1, 2, 3])) + "".join(rnd.choice("ACGT") for _ in range(2))
        rows.append((piece, text[:w + 1].ljust(w + 1, "A")))
    df = spark.createDataFrame(rows, "piece string, text string").select(
        "*", sim.digits_at(sim.base_digits("piece"), F.lit(1), F.length("piece")).alias("x"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * F.length("piece")).alias("past"),
        sim.digits_at(sim.base_digits("text"), F.lit(1), F.length("text")).alias("y"))
    got = df.select("piece", "text", sim.within_one_edit(F.col("x"), F.col("past"), F.col("y")).alias("near")).collect()
    want = [min(levenshtein(p, t[:n]) for n in (len(p) - 1, len(p), len(p) + 1)) <= 1 for p, t in rows]
    assert [r["near"] for r in got] == want and 100 < sum(want) < 500


def test_all_edits_allowed_lose_no_link(spark):
    """Pairs at the very limit, with the edits dealt over the pieces in every way, and a large component of copies."""
    rnd, seqs = random.Random(11), []
    for length in (40, 40, 41, 60, 100):
        s = "".join(rnd.choice("ACGT") for _ in range(length))
        seqs.append(s)
        for _ in range(7):
            seqs.append(edited(rnd, s, length // 10))
        # the first or the last piece stays, the others have an edit each, one of them two
        seqs.append(s[:3] + "".join(rnd.choice("ACGT") if i % 10 == 5 else c for i, c in enumerate(s[3:])))
    seqs += [seqs[0][:i] + c + seqs[0][i + 1:] for i in range(40) for c in "ACGT"] + ["", "N" * 40, "N" * 39 + "A"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, payload string")
    pairs = [(i, j) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if abs(len(seqs[i]) - len(seqs[j])) <= 10
             and 1 - levenshtein(seqs[i], seqs[j]) / max(len(seqs[i]), len(seqs[j]), 1) >= 0.9 - 1e-12]
    assert as_map(connected_components(df.select("id"), sim.edit_distance_edges(df, 0.9, hot=3))) == components(pairs, range(len(seqs)))


def test_chance_matches_of_a_piece_are_not_compared(spark, monkeypatch):
    """Strangers that share many pieces: few of their pairs reach the comparison of whole texts."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("ACGT") for _ in range(10)) for _ in range(12)]
    seqs = ["".join(rnd.choice(words) if i % 2 else "".join(rnd.choice("ACGT") for _ in range(10)) for i in range(10)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, payload string")
    compared, whole = [], sim.verified

    def counted(block, pairs):
        pairs = cut(pairs)
        compared.append(pairs.count())
        return whole(block, pairs)

    monkeypatch.setattr(sim, "verified", counted)
    assert sim.edit_distance_edges(df, 0.9).count() == 0
    assert compared[-1] < 0.15 * 150 * 149 / 2  # a third of them share a word in the same place
