"""The near-dedup stage against exact five-word Jaccard similarity over all pairs."""

import random

import corpus_pipeline
from usagelens.llm import near_copies


def shingles(text):
    w = text.split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))}


def roots(texts, at_least=0.8):
    """Smallest id of each component of the pairs that are similar."""
    up, sets = {d: d for d in texts}, {d: shingles(t) for d, t in texts.items()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= at_least * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in texts}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = f"new{rng.getrandbits(40)}"
    return out


def corpus(seed=5):
    """Pairs on both sides of 0.8, and one group large enough to be held against one node at a time."""
    rng = random.Random(seed)
    texts = []
    for k in range(60):
        base = [f"w{rng.getrandbits(30)}" for _ in range(rng.choice((60, 150, 400)))]
        texts += [base, edited(rng, base, max(1, round(len(base) * (0.008 + 0.0007 * k))))]
    base = [f"w{rng.getrandbits(30)}" for _ in range(300)]
    texts += [edited(rng, base, rng.choice((1, 2, 4, 8))) for _ in range(60)]
    rng.shuffle(texts)
    return {i: " ".join(w) for i, w in enumerate(texts)}


def test_near_dedup_is_exact_similarity(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = roots(texts)
    assert len(set(want.values())) < len(texts) - 60
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(want.values())


def family(seed, pairs=100, words=1000):
    """Texts of one template: two of a pair at 0.83, others at 0.79. Values of the template are shared by all of them."""
    rng = random.Random(seed)
    template = [f"t{rng.getrandbits(40)}" for _ in range(words)]
    out = []
    for _ in range(pairs):
        base = edited(rng, template, 13)
        out += [" ".join(base), " ".join(edited(rng, base, 17))]
    rng.shuffle(out)
    return dict(enumerate(out))


def test_no_link_is_lost_in_a_family(spark):
    texts = family(8)
    want = roots(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 160


def test_prefix_pairs_lose_no_pair(spark):
    """Against all pairs, also with sizes on both sides and components of several nodes."""
    rng = random.Random(2)
    sets = {}
    for f in range(6):
        base = rng.sample(range(1000 * f, 1000 * f + 300), 80)
        for _ in range(15):
            sets[len(sets)] = set(rng.sample(base, rng.randint(62, 80))) | {10_000 + rng.getrandbits(16) for _ in range(rng.randint(0, 8))}
    root = {k: k - k % rng.choice((1, 2)) for k in sets}
    df = spark.createDataFrame([(k, root[k], sorted(s)) for k, s in sets.items()], "node long, root long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in near_copies.prefix_pairs(df, 0.8).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and want <= got and all(root[a] != root[b] for a, b in got)


def test_clashing_names_and_null_keys(spark):
    rows = [(1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (None, "x y z u v w", 3), (None, None, 4), (3, "", 5), (3, "", 6), (3, "other words are in this one", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int").selectExpr("doc_id", "text", "_n", "_n AS key", "_n AS node", "_n AS root", "_n AS `a.b`")
    kept = near_copies.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", rows[0][1]), ("3", ""), ("3", rows[6][1]), ("None", rows[2][1])]
