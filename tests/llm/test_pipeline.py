import random

import corpus_pipeline
from cifra.llm import mixing, pii, quality_rules
from test_operators import plain_hits
from test_simhash import brute_components


def test_pipeline_does_what_its_stages_say(spark, tmp_path):
    rng = random.Random(21)
    line = lambda n=11: " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    base = ["\n".join(line() for _ in range(rng.randint(3, 9))) for _ in range(40)]
    item = line(20)
    texts = base + [base[0], base[1], base[2] + " end"] + [base[3] + "\n" + item, "short", None, "junk*** " * 50, base[4] + "\nmail me@home.org now or later please"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(r[0], m[7], r[3]) for r in rows if (m := quality_rules.measures(r[1] and r[1].encode()))[6]]
    first = {d: c for d, _, c in brute_components(kept)}
    kept = [r for r in kept if first[r[0]] == r[0] and not plain_hits(r[1], [(1, item)])[4]]
    clean = {d: (pii.redacted(t, sum(pii.model().spans(t), [])), s) for d, t, s in kept}
    size = {}
    for t, s in clean.values():
        size[s] = size.get(s, 0) + len(t.split())
    want = mixing.targets(list(size.items()))
    assert set(got) <= set(clean) and len(clean) >= 38 and not {40, 41, 43, 44, 45, 46} & set(clean)
    assert all(r["text"] == clean[d][0] and r["n_chars"] == len(r["text"]) and r["taken"] == r["passes"] * len(r["text"].split()) for d, r in got.items())
    for s in size:
        assert abs(sum(r["taken"] for r in got.values() if r["source"] == s) - want[s]) <= 12
    assert "[EMAIL]" in clean[47][0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "mixing"]


def test_pipeline_of_awkward_rows(spark, tmp_path):
    rng = random.Random(8)
    line = lambda n=11: " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    text = lambda n=5: "\n".join(line() for _ in range(n))
    item, same, long = line(20), text(), text(9000)
    texts = [(1, same), (1, text()), (None, same), (None, text()), (2, same), (3, None), (4, ""), (5, long), (6, text() + "\n" + item), (None, text() + "\n" + item), (7, text()), (7, text())]
    rows = [(i, t, "en", f"s{k % 2}" if k else None, len(t or ""), "clash", 9, "clash", "clash") for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, g string, passes int, component string, _row string"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(1, same), (1, texts[1][1]), (None, texts[3][1]), (5, long), (7, texts[10][1]), (7, texts[11][1])]
    assert {(r["doc_id"], r["text"]) for r in got} <= set(kept) and len(got) <= len(kept) and len(got) >= 3
    assert all(r["g"] == r["_row"] == "clash" and r["taken"] == r["passes"] * len(r["text"].split()) for r in got)
    left = [docs for name, docs in stages(spark, str(tmp_path)) if name == "decontamination"][0]
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted(kept, key=str)
    empty = f"{tmp_path}/none"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def stages(spark, folder):
    """Name and rows of each stage's result."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, folder)
        schema, rows = rows.schema, rows.collect()
        yield name, rows
        docs = spark.createDataFrame(rows, schema)
