"""Empty tables, nulls, repeated rows and clashing names through every operator and stage."""

import corpus
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmart.llm import bloom_lm, chunk_dedup, decontaminate, jaccard, language, licenses, mixing, queries, suffix_dedup, token_files


def bench(spark):
    return spark.createDataFrame([(1, "the of and to in is that for it was on with as by"), (None, None)], "item_id long, text string")


#: Operators that keep all columns and rows of their input, with the column they add.
KEEPING = {
    "language": lambda s, d: language.identify(d, language.learn_dictionaries(d)),
    "contamination": lambda s, d: decontaminate.find_passages(d, bench(s)),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "mix_taken": lambda s, d: mixing.mix_sources(d),
    "lm": lambda s, d: bloom_lm.score_texts(d.withColumn("learn", F.lit(True)), "learn"),
    "repeats": lambda s, d: chunk_dedup.deduplicate(d),
    "repeats ": lambda s, d: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", KEEPING)
def test_rows_and_columns_stay(spark, name):
    docs, rows = corpus.documents(spark, 1, 6)
    docs = docs.withColumn(name.strip(), F.lit("clash")) if name.strip() != "mix_taken" else docs
    out = KEEPING[name](spark, docs)
    assert [c for c in corpus.documents(spark, 1, 1)[0].columns if c not in out.columns] == []
    assert sorted(map(str, out.select(*docs.drop(name.strip()).columns).collect())) == sorted(map(str, docs.drop(name.strip()).collect()))
    twice = [r[name.strip()] for r in out.where("doc_id = 0").collect()]
    assert len(twice) == 3 and (name == "mix_taken" or all(x == twice[0] for x in twice[1:]))


@pytest.mark.parametrize("name", KEEPING)
def test_empty_tables(spark, name):
    out = KEEPING[name](spark, corpus.nothing(spark))
    assert out.count() == 0 and name.strip() in out.columns


def test_empty_tables_of_the_others(spark):
    empty = corpus.nothing(spark)
    assert jaccard.near_duplicates(empty.select("doc_id", "text")).count() == 0
    assert token_files.round_trip(empty.select("doc_id", "text"), queries.tokenizer_definition()).count() == 0
    assert decontaminate.find_passages(corpus.documents(spark, 1, 2)[0], bench(spark).where("false")).where("contamination.n_hit > 0").count() == 0


def test_null_and_letterless_texts(spark):
    docs, _ = corpus.documents(spark, 1, 12)
    found = language.identify(docs, language.learn_dictionaries(docs))
    odd = found.where("text is null or not text rlike '\\\\p{L}'").select("language.*").collect()
    assert len(odd) > 3 and all((r["lang"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in odd)
    lm = bloom_lm.score_texts(docs.withColumn("learn", F.lit(None).cast("boolean")), "learn").where("text is null").select("lm.*").first()
    assert (lm["n_tokens"], lm["n_known"], lm["train_tokens"]) == (1, 0, 0)


def stage_tables(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, stage):
    docs, rows = corpus.documents(spark, 1, 10)
    where = stage_tables(spark, tmp_path, docs)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, where)
    assert out.columns == (docs.columns if stage != "token_output" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert out.count() > 0
    assert run(spark, corpus.nothing(spark), where).count() == 0


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    far = [" ".join(f"{k}w{i}" for i in range(40)) for k in "abcde"]
    close = far[0] + " more"
    texts = [(1, far[0]), (1, far[1]), (2, close), (None, far[2]), (None, far[3]), (None, close), (3, far[4]), (3, far[4]), (3, far[4] + " x"), (4, None), (None, None), (None, " ")]
    docs = spark.createDataFrame([(d, t, *[None] * 7) for d, t in texts], corpus.SCHEMA)
    out = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "").collect()]
    threes = [x for x in out if x[0] == 3]
    assert len(threes) == 1 and threes[0][1] in (far[4], far[4] + " x")
    assert sorted(map(str, set(out) - set(threes))) == sorted(map(str, [(1, far[0]), (1, far[1]), (None, far[2]), (None, far[3]), (4, None), (None, None), (None, " ")]))
    assert len(out) == 8


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Every stage is judged on its own input by plain code; the mix and the tokens have tests of their own."""
    from test_operators_against_plain import plain_components, plain_passages

    docs, rows = corpus.documents(spark, 11, 30)
    where = stage_tables(spark, tmp_path, docs)
    stages = dict(corpus_pipeline.STAGES)
    one = spark.createDataFrame(stages["language_id"](spark, docs, where).collect(), corpus.SCHEMA)
    kept = [tuple(r) for r in one.collect()]
    assert {r[0] for r in rows if r[1] and len(r[1].split()) > 20 and r[1][0] != "w" and r[0] is not None} <= {r[0] for r in kept} | {r[0] for r in rows if r[1] and len(set(r[1].split())) < 12}
    two = spark.createDataFrame(stages["ngram_jaccard_join"](spark, one, where).collect(), corpus.SCHEMA)
    leaders = {c for d, n, c in plain_components(kept) if n} | {d for d, n, c in plain_components(kept) if not n}
    assert sorted(map(str, (r["doc_id"] for r in two.collect()))) == sorted(map(str, leaders))
    three = stages["benchmark_decontamination"](spark, two, where).collect()
    items = [("1", bench(spark).first()["text"])]
    clean = {r["doc_id"] for r in two.collect() if not plain_passages(r["text"], items, 10)[1]}
    assert {r["doc_id"] for r in three} == clean
    four = stages["source_mixing"](spark, spark.createDataFrame(three, corpus.SCHEMA), where)
    assert {r["doc_id"] for r in four.collect()} <= clean
    five = stages["token_output"](spark, four, where).orderBy("start").collect()
    assert len(five) == four.count() and five[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(five, five[1:], strict=False))
