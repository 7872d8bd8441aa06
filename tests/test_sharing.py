"""Sources that share targets with a question's hits, against all pairs."""

import random

from lexspark.operators import graph as G

HITS, STRONG = "q bigint, dst string, pos int", "src bigint, dst string, r int"


def brute(hits, strong, most):
    of, have = {}, {}
    for q, d, p in hits:
        of.setdefault(q, {})[d] = p
    for s, d, r in strong:
        have.setdefault(s, {})[d] = r
    out = set()
    for q, mine in of.items():
        found = []
        for s, own in have.items():
            both = mine.keys() & own.keys()
            if both and s != q:
                found.append((-len(both), min(own[d] for d in both), min(mine[d] for d in both), s))
        out |= {(q, s, -n, c, p, k) for k, (n, c, p, s) in enumerate(sorted(found)[:most], 1)}
    return out


def test_sharing_against_all_pairs(spark):
    for seed, words in ((1, 5), (2, 30)):
        rng = random.Random(seed)
        hits = [(q, f"w{d}", p) for q in range(120) for p, d in enumerate(rng.sample(range(words), rng.randint(1, 3)))]
        strong = [(s, f"w{d}", rng.randint(0, 1)) for s in range(150) for d in rng.sample(range(words), rng.randint(0, 5))]
        for most in (1, 2):
            got = G.sharing(spark.createDataFrame(hits, HITS), spark.createDataFrame(strong, STRONG), most, 3)
            assert {tuple(r) for r in got.select("q", "src", "n", "cue", "rank", "k").collect()} == brute(hits, strong, most)


def test_a_target_of_all_pages_makes_no_pairs(spark):
    """20,000 pages that share a target would be 400 million pairs."""
    n = 20_000
    hits = spark.range(n).selectExpr("id q", "'all' dst", "0 pos")
    strong = spark.range(n).selectExpr("id src", "'all' dst", "int(id % 2) r")
    got = G.sharing(hits, strong, 2, 3)
    assert got.count() == 2 * n and {tuple(r) for r in got.where("q < 3").select("q", "src", "k").collect()} == {(0, 2, 1), (0, 4, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 4, 2)}
    before = spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    got.write.format("noop").mode("overwrite").save()
    assert spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() - before < 100 * n
