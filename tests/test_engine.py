"""The engine's queries beside their SQL, and what SQL can't see: files, the command line, streams, splits, synthetic data."""

import glob
import json
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from cifra import cli
from cifra.functions import text
from cifra.operators import charlm, metrics, relational
from cifra.plans import queries, synth
from cifra.sources import io
from cifra.streaming import normalizing

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rounded(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_says_what_its_sql_says(spark, duck, name):
    got, want = queries.QUERIES[name](spark, TABLES), duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rounded(map(tuple, got.select(*columns).collect())) == rounded(want.fetchall())


PHRASES = [("двести пятьдесят рублей", "250 рублей", "clean"), ("первого числа", "1 числа", "clean"), ("компьютер", "компьютер", "noisy"), (None, None, "noisy"), ("пять тыщ", "5 тыщ", "noisy")]


@pytest.fixture
def phrases(tmp_path):
    path = f"{tmp_path}/phrases.f"
    table = pa.table({n: [r[i] for r in PHRASES] for i, n in enumerate(("task_text", "ground_truth", "noise_level"))})
    feather.write_feather(table, path, compression="uncompressed", chunksize=2)
    return path


def test_feather_is_read_by_batches_and_written_back(spark, phrases, tmp_path):
    df = io.read(spark, phrases)
    assert df.rdd.getNumPartitions() == 3 and sorted(map(tuple, df.collect()), key=str) == sorted(PHRASES, key=str)
    io.write(df, f"{tmp_path}/copy.f")
    assert sorted(map(tuple, feather.read_table(f"{tmp_path}/copy.f").to_pandas().itertuples(index=False)), key=str) == sorted(PHRASES, key=str)
    io.write(df.limit(0), f"{tmp_path}/none.f")
    assert feather.read_table(f"{tmp_path}/none.f").num_rows == 0 and io.read(spark, f"{tmp_path}/none.f").columns == df.columns
    io.write(df, f"{tmp_path}/copy")
    assert io.read(spark, f"{tmp_path}/copy").count() == 5
    io.write_json_array(df, "task_text", f"{tmp_path}/texts.json")
    with open(f"{tmp_path}/texts.json", encoding="utf-8") as f:
        assert sorted(json.load(f)) == sorted(r[0] for r in PHRASES if r[0])
    io.write_json_array(df.limit(0), "task_text", f"{tmp_path}/none.json")
    with open(f"{tmp_path}/none.json", encoding="utf-8") as f:
        assert json.load(f) == []
    assert io.answer_path("a.d/x.f") == "a.d/x_answer.f" and io.answer_path("a.d/x") == "a.d/x_answer.parquet" and io.answer_path("x.parquet") == "x_answer.parquet"
    io.write_json_list(df, "noise_level", f"{tmp_path}/levels")
    assert {r[0] for r in spark.read.json(f"{tmp_path}/levels").collect()} == {"clean", "noisy"}


def test_only_tables_of_few_partitions_are_spread(spark):
    slots = spark.sparkContext.defaultParallelism
    assert io.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == slots
    many = spark.range(0, 100, 1, slots + 3)
    assert io.spread(many) is many and io.spread(many.limit(0)).count() == 0


def test_a_table_of_one_row_group_is_computed_by_all_slots(spark, tmp_path):
    # The group is whole in one of many parts of the file, so that the parts alone look like enough.
    rows = pa.table({"o_orderkey": pa.array(range(0, 2_000_000, 50), pa.int64()), "o_orderstatus": [f"{i * 2_654_435_761:020}" for i in range(40_000)]})
    for name, size in (("one", 40_000), ("even", 500)):
        (tmp_path / name).mkdir()
        pq.write_table(rows, f"{tmp_path}/{name}/orders.parquet", row_group_size=size, compression="none", use_dictionary=False)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        table = queries.read(spark, f"{tmp_path}/one", "orders")
        parts = table.rdd.getNumPartitions()
        assert parts > spark.sparkContext.defaultParallelism and io.spread(table) is table
        for frame in (queries.spread(spark, f"{tmp_path}/one", "orders"), queries.itn_roundtrip_sequence(spark, f"{tmp_path}/one"), queries.predictions(spark, f"{tmp_path}/one")):
            held = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
            assert len(held) == parts and sum(held) == 40_000 and max(held) < 1.1 * 40_000 / parts
        answers = queries.itn_roundtrip_sequence(spark, f"{tmp_path}/one")
        assert answers.filter("answer = string(o_orderkey)").count() == 40_000
        even = queries.read(spark, f"{tmp_path}/even", "orders")
        assert io.evened(even) is even and io.evened(even.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_tasks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    # Row groups lie evenly over the parts, each with more rows than a task should compute.
    monkeypatch.setattr(io, "EVEN_ROWS", 1_000)
    slots, kept = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        for n in (20_000, 80_000):
            (tmp_path / str(n)).mkdir()
            rows = pa.table({"o_orderkey": pa.array(range(n), pa.int64()), "o_orderstatus": [f"{i * 2_654_435_761:020}" for i in range(n)]})
            pq.write_table(rows, f"{tmp_path}/{n}/orders.parquet", row_group_size=3_000, compression="none", use_dictionary=False)
            table = queries.read(spark, f"{tmp_path}/{n}", "orders")
            held = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
            assert io.spread(table) is table and 1_000 < max(held) <= 2 * n / table.rdd.getNumPartitions()
            for name in ("itn_context_phrase", "predictions"):
                frame = getattr(queries, name)(spark, f"{tmp_path}/{n}")
                dealt = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
                assert sum(dealt) == n and max(dealt) < 1_200 and len(dealt) % slots == 0
        monkeypatch.setattr(io, "MOST_PARTS", table.rdd.getNumPartitions())
        assert io.evened(table) is table
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_command_line(spark, phrases, capsys):
    cli.main(["run", phrases])
    answers = feather.read_table(phrases.removesuffix(".f") + "_answer.f").to_pandas()
    assert answers["answer"].dropna().tolist() == ["250 рублей", "1 числа", "компьютер", "5000"] and "task_text" in answers
    assert cli.main(["evaluate", phrases, "--parser-type", "sequence"]) == 80.0
    cli.main(["errors", phrases, "-n", "3"])
    assert "5000" in capsys.readouterr().out
    with pytest.raises(ValueError, match="ground_truth"):
        relational.require_columns(io.read(spark, phrases).select("task_text"), "task_text", "ground_truth")


def test_streams(spark, tmp_path):
    rows = [("двести рублей", "2024-01-01 00:00:00"), ("пять и два", "2024-01-01 00:01:00"), ("слово", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "task_text string, at string").select("task_text", F.to_timestamp("at").alias("ts")).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("task_text string, ts timestamp").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        normalizing.normalized_stream(source(), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert {r["answer"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"200 рублей", "5 и 2", "слово"}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    counts = normalizing.numbers_by_window(normalizing.with_answer(source()))
    counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r["n"], r["numbers"]) for r in spark.table("windows").orderBy("window").collect()] == [(2, 3), (1, 0)]


def test_splits_cut_at_the_exact_place(spark):
    ids = [(i * i % 997,) for i in range(600)] + [(None,)] * 3
    df = spark.createDataFrame(ids, "row_id long")
    known = sorted(i for (i,) in ids if i is not None)
    for place in (1, 17, 300, 540, 600):
        assert relational.id_at(df.filter("row_id is not null"), "row_id", place, 600, few=20) == known[place - 1]
    first, rest = relational.positional_split(df, "row_id")
    assert first.count() == sum(i <= known[539] for i in known) and first.count() + rest.count() == 603
    one, other = relational.hash_split(df.filter("row_id is not null"), "row_id")
    assert one.count() + other.count() == 600 and 480 < one.count() < 590


def test_rows_kept_first_and_filters(spark):
    df = spark.createDataFrame([(3, "A b"), (1, "a B"), (2, None), (4, None), (5, "c")], "row_id long, t string")
    assert sorted(r["row_id"] for r in relational.keep_first(df, relational.prefix_key(F.col("t"), 50), "row_id").collect()) == [1, 2, 5]
    assert relational.filter_or_all(df, F.col("t") == "c").count() == 1 and relational.filter_or_all(df, F.col("t") == "z").count() == 5
    assert [r["row_id"] for r in relational.first_rows(df, "row_id", 2).collect()] == [1, 2]
    assert relational.shuffled(df, "row_id", 3).collect() == relational.shuffled(df.repartition(3), "row_id", 3).collect()


def test_number_pairs(spark):
    df = spark.createDataFrame([(1, "купил 21 яблоко и 0 груш, 5 слив"), (2, "без чисел"), (3, None)], "row_id long, t string")
    got = [(r["number"], r["task_text"]) for r in relational.first_number_pairs(df, "t", 3).collect()]
    assert got == [("21", "купил двадцать один яблоко и 0 груш, 5 слив"), ("5", "купил 21 яблоко и 0 груш, пять слив")]
    assert [r["sentence"] for r in relational.number_sentences(df, "t", "row_id").collect()] == ["купил 21 яблоко и 0 груш, 5 слив"]


def test_spoken_pairs_of_whole_documents(spark, tmp_path):
    rows = [(4, "Visit  21 shops,\n5 times"), (2, "visit 21 shops, 5 times"), (3, "no number"), (5, "x7 1234567 a_8"), (6, "(999999) end"), (7, None), (8, "é0 1 z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["spoken_pairs_of_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(2, "visit 21 shops, 5 times"), (6, "(999999) end"), (8, "é0 1 z")]
    pairs = {r["doc_id"]: r["task_text"] for r in relational.spoken_pairs(spark.read.parquet(f"{tmp_path}/documents.parquet"), "text", "doc_id").collect()}
    assert pairs[2] == "visit двадцать один shops, 5 times" and pairs[8] == "é0 один z"


def test_pages(spark):
    cases = [
        ("<html><nav>menu</nav><p>before</p><article><h1>Head</h1><script>x('</p>')</script> body <b>5</b> </article></html>", "Head body 5"),
        ("<p>a<br>b</p>", "a b"), (None, None), ("", ""), ("no tags &amp; &lt;b&gt;", "no tags & <b>"),
        ("<article>one<article>two</article>three</article><article>four</article>", "one two three"),
        ("<div class='x text y'><div>in</div>still</div><main>not</main>", "in still"), ("<div class='content'>c</div><main>m</main>", "m"),
        ("<nav><div>a<nav>b</nav>c</div>d</nav>e", "e"), ("<header><article>gone</article></header><section class=\"news-text\"><p>left <b>open<p>end</section>tail", "left open end"),
        ("<article><p>never closed <footer>gone</footer> x", "never closed x"), ("</div>a<!-- c -->b", "a b"), ("<p>" * 3000 + "deep", "deep"),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").select("i", text.html_text(F.col("h"))).collect()
    assert [r[1] for r in sorted(rows)] == [want for _, want in cases]


def test_only_whole_references_are_read(spark):
    cases = [
        ("<title>and&amp</title><p>R&D a&amp;b &am", "and&amp R&D a&b &am"), ("<p>x &quo</p>&lt;&lt &#x27;&#x2 &#39;&#3 &middot;&middot", "x &quo <&lt '&#x2 '&#3 \u00b7&middot"),
        ("&ampx; &notit; &amp;lt; &", "&ampx; &notit; &lt; &"), ("<iframe>a & b</iframe>\ufdd0&", "a & b \ufdd0&"), ("<div class='text a&b'>in</div>out", "in"),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").select("i", text.html_text(F.col("h"))).collect()
    assert [r[1] for r in sorted(rows)] == [want for _, want in cases]


def test_language_model_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "25 рублей"), (2, "1000 рублей"), (3, "свыше 22")], "row_id long, t string")
    model = charlm.train(df, "t", 3)
    model.save(f"{tmp_path}/lm")
    score = lambda m: sorted((r["row_id"], round(r["score"], 9)) for r in m.score(df, "t", "row_id").collect())
    assert score(charlm.load(spark, f"{tmp_path}/lm")) == score(model)
    assert model.n_train == 3 and charlm.load(spark, f"{tmp_path}/lm").limits == {}
    p5 = charlm.thresholds(model.score(df, "t", "row_id")).first()["p5"]
    model.limits["p5"] = p5
    model.save(f"{tmp_path}/lm")
    kept = charlm.load(spark, f"{tmp_path}/lm")
    assert kept.limits == {"p5": p5} and kept.n_train == 3
    scores = spark.createDataFrame([(float(i * 37 % 101),) for i in range(101)] + [(None,)], "score double")
    assert tuple(charlm.thresholds(scores).first())[:4] == (5.0, 10.0, 0.0, 50.0) and charlm.thresholds(scores.limit(0)).first()["p5"] is None
    assert charlm.plausible(model.score(df, "t", "row_id"), p5).count() >= 2


def test_metrics_of_no_rows_and_of_nulls(spark):
    df = spark.createDataFrame([(1, "а", None, None), (2, "пять", "5", None), (3, "два", "2", "2")], "row_id long, task_text string, ground_truth string, answer string")
    assert tuple(metrics.accuracy(df).first())[:2] == (2, 3) and metrics.accuracy(df.limit(0)).first()["pct"] is None
    assert [r["row_id"] for r in metrics.errors(df, "row_id").collect()] == [2]
    assert tuple(metrics.length_delta(df).first()) == (round(-1 / 3, 6), round(1 / 3, 6), -1, 0)
    assert relational.known_rows(df).count() == 2 and [r["row_id"] for r in metrics.regrouped_rows(df.na.fill("a b", ["ground_truth"]), "row_id").collect()] == [1]
    cells = metrics.digit_confusion(spark.createDataFrame([("1" * 15 + " 22", "1" * 15 + " 3")], "ground_truth string, answer string"))
    assert {(r["true_digits"], r["15"], r["1"]) for r in metrics.confusion_matrix(cells).collect()} == {(15, 1, None), (2, None, 1)}


def test_rows_without_group_count_in_the_overall_accuracy(spark):
    rows = [("clean", "1", "1"), ("clean", "2", "x"), (None, "3", "3"), (None, "4", "4"), (None, None, "x"), ("noisy", None, None)]
    got = metrics.accuracy_by(spark.createDataFrame(rows, "level string, ground_truth string, answer string"), "level").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4, 6, 100.0 * 4 / 6), ("clean", 1, 2, 50.0), ("noisy", 1, 1, 100.0)], key=str)


def test_accuracy_by_length_has_all_buckets(spark, tmp_path):
    rows = [(2, "x" * 20), (3, "x" * 20), (4, "x" * 21), (5, "x" * 40), (6, "x" * 41), (8, "x" * 900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["length_buckets_of_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("1-20", 2, 1), ("21-40", 2, 1), ("41+", 2, 2)]


def test_odd_documents_are_wrong_whatever_their_text(spark, duck, tmp_path):
    rows = [(1, ""), (2, ""), (3, None), (4, None), (5, "a"), (6, "a"), (7, "x"), (None, ""), (9, "x" * 21)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["length_buckets_of_documents"](spark, str(tmp_path))
    want = duck.cursor().execute(queries.SQL["length_buckets_of_documents"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) == [("1-20", 6, 2), ("21-40", 1, 0), ("41+", 2, 1)]


ODD_KEYS = [0, 1, 9, 10, 19, 20, 21, 40, 99, 100, 101, 110, 999, 1000, 1001, 2000, 12_000, 99_999, 100_000, 100_001, 999_999]
LARGE_KEYS = [1_000_000, 1_000_001, 1_012_345, 1_100_000, 2_000_000, 8_999_999, 9_000_010, 10_000_000, 12_345_678, 100_000_000, 540_000_017, 999_999_999]


@pytest.mark.parametrize(("name", "keys"), [("numeral_words", LARGE_KEYS), ("spoken_pairs", [*LARGE_KEYS, 10**9, 10**12 + 5, 2**63 - 1])])
def test_large_keys_say_what_the_sql_says(spark, duck, tmp_path, name, keys):
    rows = [(k, k % 1013) for k in ODD_KEYS + keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = duck.cursor().execute(queries.SQL[name].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert len(want) == len(rows) and sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_synthetic_data(spark):
    df = synth.dataset(spark, 1200)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, synth.dataset(spark, 1200).collect()), key=str)
    assert {r[0] for r in df.select("noise_level").distinct().collect()} == {"clean", "noisy"}
    assert {r[0] for r in df.select("num_type").distinct().collect()} == {"cardinal", "ordinal"}
    news = synth.real(spark.createDataFrame([(1, "В городе открыли 21 школу"), (2, "Без числа")], "row_id long, t string"), "t", "row_id")
    assert [(r["task_text"], r["ground_truth"], r["source"]) for r in news.collect()] == [("в городе открыли двадцать один школу", "в городе открыли 21 школу", "news")]
    assert synth.dataset(spark, 1200, news).filter("source = 'news'").count() <= 1


def test_noise_runs_numbers_together_and_fillers_stand_anywhere(spark):
    from cifra.functions import verbalize

    df = synth.from_templates(spark, 3000).withColumn("words", F.split("ground_truth", " "))
    places = {next((i for i in range(len(r["words"])) if " ".join(r["words"][i:]).startswith(tuple(synth.FILLERS))), None) for r in df.filter("noise_level = 'clean'").collect()}
    assert {0, 1, 2} <= places
    told = spark.range(3000).select(synth.noise(verbalize.number_to_words(F.col("id") + 100_000), F.col("id"), "x").alias("t"), F.size(F.split(verbalize.number_to_words(F.col("id") + 100_000), " ")).alias("n"))
    joined = told.filter(F.size(F.split("t", " ")) < F.col("n")).count()
    assert 1000 < joined < 3000


def test_clean_rows_come_back_as_their_answers(spark):
    from cifra.operators import normalize

    df = synth.ordinals(spark, 800).filter("noise_level = 'clean'").withColumn("back", normalize.normalize(F.col("task_text")))
    wrong = df.filter("back <> ground_truth").select("task_text", "back").distinct().collect()
    assert df.count() > 100 and wrong == []


def test_feeds_and_answers_that_cannot_be_read_have_no_texts(spark):
    rows = ["<rss><item>", None, "", "no xml", "<rss><channel><item><title><![CDATA[a <i>b</i> 1]]></title></item><item><description>x</description></item></channel></rss>", "<rdf><item><title>t</title></item></rdf>"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(text.feed_texts(F.col("x"))).collect()] == [[], [], [], [], ["a b 1", "x"], ["t"]]
    answers = spark.createDataFrame([(i, r) for i, r in enumerate(['{"query": {"pages": {"7": {"extract": "a"}, "8": {"title": "b"}}}}', '{"query": {}}', "[", None])], "i int, x string").orderBy("i")
    assert [r[0] for r in answers.select(text.extracts(F.col("x"))).collect()] == [["a", ""], [], [], []]
