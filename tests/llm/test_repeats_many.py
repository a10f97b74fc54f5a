"""A passage that many texts have in different surroundings."""

import random
from collections import defaultdict

from usagelens.llm import repeats


def corpus():
    rng = random.Random(3)
    some = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    passage = some(130)
    texts = {k: some(rng.randint(5, 90)) + passage + some(rng.randint(5, 90)) for k in range(60)}
    texts |= {100 + k: some(40) + passage[k: k + 70] + b"xy" * 60 + some(40) for k in range(20)}
    return texts | {200: texts[3], 201: texts[3][:60] + texts[4][-70:], 202: some(300)}


def covered(texts, n=50):
    least = {}
    for k in sorted(texts):
        for p in range(len(texts[k]) - n + 1):
            least.setdefault(texts[k][p: p + n], k)
    return {(k, p + i) for k, t in texts.items() for p in range(len(t) - n + 1) if least[t[p: p + n]] < k for i in range(n)}


def test_a_name_of_many_texts_is_no_group(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, bytearray(t)) for k, t in texts.items()], "key long, data binary").repartition(7)
    want = covered(texts)
    for many in (8, repeats.MANY):
        spans = repeats.covered_spans(docs, 50, many).collect()
        assert {(r["key"], i) for r in spans for i in range(r["start"], r["end"])} == want
    packs = repeats.packed_names(docs, 4, 50)
    names = repeats.shared_names(packs, 8)
    owners = docs.selectExpr("key", "xxhash64(data) text_id").where("key <> 200")
    cut = repeats.stretches(docs.join(names.join(owners, "text_id"), "key"), 4, 50).where("stretch is not null").collect()
    meeting = defaultdict(set)
    for r in cut:
        meeting[r["name"]].add(bytes(r["stretch"]))
    assert max(map(len, meeting.values())) <= 2 * 8
