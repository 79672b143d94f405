"""Lines whose nearest candidate fails: matches are found, and only few lines' words are fetched for them."""

import random

from textloom.llm import line_dedup


def fetched_by(spark, rows, monkeypatch):
    """The lines (doc_id, line, matched) found, and how many lines each fetch of words asked for."""
    asked, whole = [], line_dedup._set_words

    def counted(lines, texts):
        asked.append(lines.distinct().count())
        return whole(lines, texts)

    monkeypatch.setattr(line_dedup, "_set_words", counted)
    got = line_dedup.line_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {(r.doc_id, r.line): r.matched for r in got}, asked


def by_hand(rows, t=0.8):
    sets = [(i, k, frozenset(x.split())) for i, text in rows for k, x in enumerate(text.split("\n"))]
    return {(i, k): bool(s) and any(len(s & o) >= t * len(s | o) - 1e-9 for _, _, o in sets[:n] if o) for n, (i, k, s) in enumerate(sets)}


def test_long_lines_that_differ_are_told_apart_by_their_bits(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(rng.sample(vocabulary, rng.choice([200, 300, 500])))) for i in range(60)]
    rows += [(100 + i, " ".join(rows[i][1].split()[4:])) for i in range(3)]
    got, asked = fetched_by(spark, rows, monkeypatch)
    assert got == by_hand(rows) and sum(got.values()) == 3
    assert max(asked) <= 12  # 128 bits let nearly all of the 63 lines through


def test_open_lines_fetch_candidates_only(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary, lines = [f"v{i}" for i in range(300)], []
    for _ in range(12):
        base = rng.sample(vocabulary, 34)
        for _ in range(10):
            changed = list(base)
            for at in rng.sample(range(34), rng.choice([2, 3, 4, 5, 5])):
                changed[at] = rng.choice(vocabulary)
            lines.append(" ".join(changed))
    lines += [" ".join(rng.sample(vocabulary, rng.choice([20, 34, 60]))) for _ in range(400)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)]
    got, asked = fetched_by(spark, rows, monkeypatch)
    assert got == by_hand(rows)
    assert len(asked) == 2 and asked[1] <= 130  # of 520 lines, all of which share words with open ones
