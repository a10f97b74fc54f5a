"""Every training word of the class model is weighed by itself, and scores follow from the classes of words."""

import math
import random

import numpy as np
import pytest

from usagelens.llm import class_lm

CLASSES = 5
K = CLASSES + 1


def test_rare_words_move_by_their_own_neighbours_and_scores_follow(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "UNIT_SHARE", 25)
    rng = random.Random(3)
    # words with one ending and opposite places, which a class by the last two bytes cannot part
    word = lambda i: f"{'ab'[i % 2]}{rng.randrange(40)}ing" if rng.random() < 0.7 else f"{'xy'[i % 2]}{rng.randrange(4)}"
    texts = [" ".join(word(i) if rng.random() < 0.9 else "a1ing" for i in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "a1ing new words"])), "doc_id long, text string").repartition(3, "doc_id")
    kept = {}
    for name in ("lay_out", "move_words"):
        def spy(*args, made=getattr(class_lm, name), name=name):
            kept[name] = (*args, made(*args))
            return kept[name][-1]

        monkeypatch.setattr(class_lm, name, spy)
    held = lambda d: d % 5 == 1
    rows = {r["doc_id"]: r for r in class_lm.score(docs, class_lm.F.col("doc_id") % 5 == 1, classes=CLASSES).collect()}
    encoded, numbered, *_ = kept["lay_out"]
    _, units_of, logs, emit, _, moved = kept["move_words"]

    names = {(r["block"], r["local"]): bytes(r["word"]) for r in encoded.where("not is_doc").collect()}
    listed = numbered.collect()
    assert len({b for b, _ in names}) > 1
    unit = {names[r["block"], r["local"]]: r["u"] for r in listed}
    rare = {names[r["block"], r["local"]] for r in listed if r["rare"]}
    first = {w: int(units_of[u]) for w, u in unit.items()}
    tokens = {d: [*(t or "").encode().split(), b""] for d, t in enumerate([*texts, None, "a1ing new words"])}
    bigrams = [(a, b) for d, ws in tokens.items() if not held(d) for a, b in zip([b"", *ws], ws)]
    pairs = lambda of: np.array([[sum(of[a] == x and of[b] == y for a, b in bigrams) for y in range(K)] for x in range(K)], float)
    count = {w: sum(ws.count(w) for d, ws in tokens.items() if not held(d)) for w in first}

    def model(of):
        n = np.array([sum(count[w] for w in of if of[w] == x) for x in range(K)])
        v = np.array([sum(count[w] > 0 for w in of if of[w] == x) for x in range(K)])
        table = pairs(of)
        return np.log10((table + (n + 1) / (n.sum() + K)) / (table.sum(1, keepdims=True) + 1)), -np.log10(n + v + 1), table

    start = model(first)
    assert logs == pytest.approx(start[0]) and emit == pytest.approx(start[1])
    of = dict(first)
    for w in rare:
        gain = []
        for c in range(CLASSES):
            put = {**first, w: c}
            gain.append(sum(logs[put[a], put[b]] + (b == w) * emit[c] for a, b in bigrams if w in (a, b)))
        of[w] = int(np.argmax(gain)) if max(gain) > gain[first[w]] + 1e-9 else first[w]
    found = {}
    for r in moved.where("block is not null").collect():
        for at, c in zip(class_lm._unpacked(r["locals"], "<u4"), class_lm._unpacked(r["classes"], "<u2"), strict=True):
            assert found.setdefault(names[r["block"], int(at)], int(c)) == c  # the same in every block
    assert found == {w: of[w] for w in rare} and len(rare) > 60
    # one ending, now in more classes than the two units that they started in
    assert len({first[w] for w in rare}) < len({of[w] for w in rare})
    trans, share, table = model(of)
    assert class_lm.likelihood(table) > class_lm.likelihood(start[2])
    for d, ws in tokens.items():
        want = sum(trans[of[a], of[b]] for a, b in zip([b"", *ws], ws))
        want += sum(math.log10(count[w] + 1) + share[of[w]] for w in ws[:-1])
        assert rows[d]["score"] == pytest.approx(want)
