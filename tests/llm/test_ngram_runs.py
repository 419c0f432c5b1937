"""Runs of signatures before pairs are made of them."""

from quillscope.llm.ngram_join import BITS, WORDS, least_common, meeting, weighted_runs


def _sizes(spark, needs):
    return spark.createDataFrame([(n, 100, 0, need, need) for n, need in needs.items()], "node long, size long, odd int, need0 int, need1 int")


def test_signatures_of_the_same_sets_are_one_row(spark):
    """Node 3 has fewer signatures in runs than it must share; without it, four
    signatures have the same two nodes. That of another parity stays apart."""
    other = 1 << 16
    runs = [(sig, node) for sig in (0, 4, 8, 12, other) for node in (1, 2)] + [(12, 3)]
    out = weighted_runs(spark.createDataFrame(runs, "sig long, node long"), _sizes(spark, {1: 1, 2: 1, 3: 2}))
    assert sorted(map(tuple, out.collect())) == [(0, 1, 4), (0, 2, 4), (other, 1, 1), (other, 2, 1)]


def test_sets_meet_in_the_first_signatures_they_must_share(spark):
    """Forty sets share a passage of ten signatures; each has two more with its
    neighbour, and must share three: only the first of the passage's are kept."""
    runs = [(100 + s, n, 1, n) for s in range(10) for n in range(40)]
    runs += [(2 * (n // 2) + s, n, 1, n) for s in range(2) for n in range(40)]
    rest = spark.createDataFrame(runs, "sig long, node long, weight long, component long")
    sigs: dict[int, set[int]] = {}
    for r in least_common(rest, _sizes(spark, {n: 3 if n < 38 else 13 for n in range(40)})).collect():
        sigs.setdefault(r.node, set()).add(r.sig)
    # 12 signatures of which 3 must be shared: the first ten; no set is kept that must share 13
    assert sigs == {n: {2 * (n // 2), 2 * (n // 2) + 1, *range(100, 108)} for n in range(38)}


def test_components_meet_once_however_many_sets_they_share_runs_with(spark):
    """Two components of twenty sets share fifty runs, a third one set of another
    size: as many rows as sets and runs make pairs would be 20,000. Each pair comes
    once, and a set that is far from its own component's still finds its like."""
    near = {n: 1 << (n % 20) for n in range(40)} | {20: (1 << 60) - 1, 3: (1 << 60) - 2}
    size = [(n, 100 if n < 40 else 200, *([near.get(n, 0)] + [0] * (WORDS - 1))) for n in range(41)]
    size = spark.createDataFrame(size, "node long, size long, " + ", ".join(f"{c} long" for c in BITS))
    kept = [(s, n, 0 if n < 20 else 20 if n < 40 else 40, 100 if n < 40 else 200) for s in range(50) for n in range(41)]
    kept = spark.createDataFrame(kept, "sig long, node long, component long, size long")
    pairs = sorted(map(tuple, meeting(kept, size, (3, 4)).collect()))
    far = {3, 20}
    assert pairs == sorted((a, b) for a in range(20) for b in range(20, 40) if (a in far) == (b in far))
