import random

import pytest
import xxhash

from cifra.llm import simhash
from cifra.llm.common import BATCH_ROWS


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_print(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r[0])
    return sorted(((r[0], f"{prints[i]:016x}", min((x for x in ids[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)


def test_clusters_are_the_components_of_all_links(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcÄß") for _ in range(3))
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "").split(" ")
            if words and rng.random() < 0.8:
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 300])))
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "A b C d"), (503, "a B c D"), (None, "a b c d"), (None, "lonely one"), (504, "x " * 50000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, print string, node int")
    assert sorted(map(tuple, simhash.clusters(docs).collect()), key=str) == brute_components(rows)
    assert simhash.clusters(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "together", "batch"), [(4, simhash.TOGETHER, 1000), (3, simhash.TOGETHER, 1000), (4, 40, 20), (4, 2, 1000), (3, 2, 1000)])
def test_variants_find_every_link_and_the_forest_connects_it(spark, most, together, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(60)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, print long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, most, together)).collect()}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: root(i) for i in range(len(prints)) if root(i) != i} == got
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    rng = random.Random(14)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (5, c, "t"), (None, c, "s"), (None, d, "s"), (None, d, "s"), (None, d, "t"), (None, d, None), (7, e, "u"), (7, e, "u"), (None, text(), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in simhash.stage(docs).collect()]
    assert sorted(t for _, t, _ in got) == sorted({t for _, t, _ in rows})
    assert {(3, a), (5, b), (5, c), (None, d), (7, e)} <= {(i, t) for i, t, _ in got}
    assert sorted(got, key=str) == sorted(map(tuple, simhash.stage(docs.repartition(3)).collect()), key=str)
    assert sorted(map(tuple, simhash.clusters(docs).collect()), key=str) == brute_components(rows)


def dealt_by_itself(plan: str, join: str) -> bool:
    """Whether both sides of each such join in the plan come straight from an exchange, so that a skewed key is split."""
    lines = [line.lstrip(" :+-*0123456789()") for line in plan.split("\n")]
    at = [i for i, line in enumerate(lines) if line.startswith(join)]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan.split("\n")]
    below = lambda i: [k for k in range(i + 1, len(lines)) if depth[k] == depth[i] + 3 and all(depth[m] > depth[i] for m in range(i + 1, k))]
    through = lambda k: through(k + 1) if lines[k].startswith("Sort") else lines[k]
    return bool(at) and all(through(k).startswith("Exchange hashpartitioning") and "ENSURE_REQUIREMENTS" in through(k) for i in at for k in below(i))


def test_a_star_is_one_component_and_its_joins_can_be_split(spark, monkeypatch):
    edges = spark.createDataFrame([(i + 1, 0) for i in range(3000)] + [(i + 5000, i + 1) for i in range(50)], "a long, b long")
    plans, settle = [], simhash.settled

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(simhash, "settled", noted)
        got = simhash.components(edges).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 3050 and {r["root"] for r in got} == {0}
    joins = [p.split("== Initial Plan ==")[-1] for p in plans if "SortMergeJoin" in p]
    assert len(joins) >= 2 and all(dealt_by_itself(p, "SortMergeJoin") for p in joins[::2])
