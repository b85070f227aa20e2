"""Passages in chunks, against plain search."""

import random

import pytest

from passagework.operators import containment


def test_prints_of_a_part_are_prints_of_the_whole():
    pick = random.Random(1)
    whole = "".join(pick.choice("abcé \U0001f600") for _ in range(3000))
    for gram, window in (*containment.GRIDS, (3, 1)):
        everything = set(containment.fingerprints(whole, gram, window).tolist())
        for _ in range(50):
            at = pick.randrange(2900)
            part = whole[at : at + pick.randrange(gram + window - 1, gram + window + 60)]
            found = containment.fingerprints(part, gram, window).tolist()
            assert found and set(found) <= everything
        assert not len(containment.fingerprints("x" * (gram + window - 2), gram, window))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop "])
def test_pairs_equal_plain_search(spark, alphabet):
    pick = random.Random(len(alphabet))
    word = lambda n: "".join(pick.choice(alphabet) for _ in range(n))
    chunks = [(k, word(pick.randrange(0, 400))) for k in range(60)] + [(60, None), (61, ""), (5, "again " + word(40))]
    parts = [t[a : a + n] for _, t in chunks[:40] if t for a, n in [(pick.randrange(len(t)), pick.choice([1, 2, 4, 6, 7, 16, 30, 31, 50, 200]))]]
    passages = list(enumerate(parts)) + [(100, None), (101, ""), (102, "nowhere!"), (103, parts[0]), (0, parts[1])]
    got = containment.contained(
        spark.createDataFrame([(*p, 1) for p in passages], "query_id long, text string, grid int"),
        spark.createDataFrame([(*c, 2) for c in chunks], "id long, text string, print int"),
    ).collect()
    want = [(q, i) for q, p in passages if p for i, t in chunks if t and p in t]
    assert sorted((r.query_id, r.id) for r in got) == sorted(want)


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "some words that are long enough for the grid")], "query_id long, text string")
    chunks = spark.createDataFrame([(1, "x")], "id long, text string")
    assert containment.contained(asked.limit(0), chunks).count() == 0
    assert containment.contained(asked, chunks.limit(0)).count() == 0


def test_a_batch_of_texts_is_hashed_piece_by_piece(spark, monkeypatch):
    """Texts that are neighbours in a piece share no run; a task keeps only prints that passages have."""
    monkeypatch.setattr(containment, "PIECE", 64)
    words = ["alpha beta", "gamma delta epsilon zeta eta", "x" * 200, None, "", "theta"]
    chunks = [(k, words[k % len(words)]) for k in range(60)]
    frame = spark.createDataFrame(chunks, "id long, text string").coalesce(1)
    asked = [(1, "a beta"), (2, "betagamma"), (3, "x" * 120), (4, "epsilon zeta eta"), (5, "etax"), (6, "theta")]
    got = containment.contained(spark.createDataFrame(asked, "query_id long, text string"), frame).collect()
    assert sorted((r.query_id, r.id) for r in got) == sorted((q, i) for q, p in asked for i, t in chunks if t and p in t)
    prints = spark.createDataFrame([(int(x),) for x in containment.fingerprints("theta", 5, 1)], "print long")
    held = containment._held(frame, [(g, 1) for g in range(1, 40)], containment._bit_table(prints)).collect()
    assert {r.id for r in held if r.grid == 5 * containment.GRID + 1} == {k for k, t in chunks if t == "theta"} and len(held) < 100
