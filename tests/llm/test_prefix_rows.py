"""The prefix join: a large component that many others nearly reach makes no pair with each of its texts."""

import random

from usagelens.llm import near_copies


def test_pairs_that_differ_too_much_are_no_candidates(spark):
    rng = random.Random(4)
    draw = lambda n: rng.sample(range(1 << 62), n)
    template = draw(200)
    sets = {}
    for k in range(120):  # one component, ten shingles of their own each
        sets[k] = (0, set(rng.sample(template, 190)) | set(draw(10)))
    for k in range(120, 180):  # near it, but below the similarity
        sets[k] = (k, set(rng.sample(template, 175)) | set(draw(12)))
    for k in range(180, 184):  # and some that reach one of it
        sets[k] = (k, set(sets[k - 180][1]) - set(rng.sample(sorted(sets[k - 180][1]), 10)))
    df = spark.createDataFrame([(k, root, sorted(s)) for k, (root, s) in sets.items()], "node long, root long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in near_copies.prefix_pairs(df, 0.8).collect()}
    jaccard = lambda a, b: len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1])
    across = [(a, b) for a in sets for b in sets if a < b and sets[a][0] != sets[b][0]]
    want = {p for p in across if jaccard(*p) >= 0.8}
    assert want and want <= got
    assert len(got) < len(across) / 20
