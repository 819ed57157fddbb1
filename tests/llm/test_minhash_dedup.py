"""Near-duplicates against brute force on full sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docengine.llm.components import connected_components
from docengine.llm.minhash_dedup import drop_near_duplicates, near_duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    docs = []
    while len(docs) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice([rng.choice(vocab), "X", "x"])
            docs.append((len(docs), rng.choice([" ", "\n", "  "]).join(w)))
    return docs


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 5)])
def test_against_brute_force(spark, seed, k):
    docs = [*corpus(seed), (1000, None), (1001, ""), (1002, " \n ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=k).collect()}
    assert got == brute(docs, k)


def test_odd_inputs(spark):
    rows = [(None, "a b c", 1), (5, "a b c", 2), (5, "a b c", 3), (7, "a b d e f g h i j k", 4), (7, "other words in this row", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = near_duplicates(docs, shingle=2).collect()
    assert len(got) == 5
    assert {r["component_id"] for r in got if r["n_shingles"] == 2} == {5}
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = drop_near_duplicates(docs, shingle=2)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(["a b c", "a b d e f g h i j k", "other words in this row"])


def test_long_text(spark):
    text = " ".join(f"t{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "t1 t2")], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}


def test_components(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a % 10 <> 9")
    got = {r["node"]: r["label"] for r in connected_components(chain.union(chain.select("b", "a"))).collect()}
    assert got == {n: n - n % 10 for n in range(40)}
    assert connected_components(chain.limit(0)).count() == 0
