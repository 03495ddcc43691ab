import corpus_pipeline
import __spark_entry__
from siteatlas.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append(out.count())
        if name != "sentencepiece":
            assert out.columns == columns
            assert out.join(docs, "doc_id", "left_anti").isEmpty()
        if name == "exact dedup":
            assert out.count() == out.select(F.lower("text")).distinct().count()
        if name == "simhash near-dedup":
            assert near_duplicates(out).where("doc_id <> component_id").isEmpty()
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert docs.where("not round_trip").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def planted(spark, folder):
    """Tables of a small corpus in which it is known what each stage has to drop."""
    import random

    rng = random.Random(21)
    vocab = [a + b for a in "ba ko ri su te mo la".split() for b in "len tir vas xom gul".split()]
    prose = lambda n=60: " ".join(rng.choice(vocab) for _ in range(n))
    hateful = lambda: " ".join(rng.choice(["vile", "scum", "idiot", "loathe", "filth", *vocab[:6]]) for _ in range(40))
    passage = "the quick brown fox jumps over one lazy dog near the old river bank"
    rows = [(k, prose()) for k in range(240)] + [(k, hateful()) for k in range(300, 390)]
    labels = [(k, 1, int(k >= 300)) for k in [*range(0, 200), *range(300, 370)]]
    rows += [(9001 + k, hateful()) for k in range(8)]  # toxic, without a label
    rows += [(9101, prose(20) + " " + passage + " " + prose(20)), (9102, passage.upper())]  # a benchmark passage
    rows += [(9201, rows[3][1].upper()), (9202, rows[3][1])]  # equal texts: the largest id stays
    near = prose(400)
    rows += [(9301, near), (9302, near + " end")]  # nearly equal: one stays
    clean = [(9401, prose()), (9402, None), (9403, ""), (None, prose()), (9404, prose())]
    rows += [*clean, clean[-1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, item string"
    full = [(i, t, None if n % 5 == 0 else "en", "s", 1, 0.5, 7, "x") for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, passage), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), clean


def test_planted_rows_go_and_clean_rows_stay(spark, tmp_path):
    texts, clean = planted(spark, tmp_path)
    rows = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    ids = set(rows)
    assert not ids & set(range(9001, 9009)), "toxic rows without a label"
    assert not ids & set(range(300, 390)), "toxic rows"
    assert not ids & {9101, 9102}, "rows with a benchmark passage"
    assert 9202 in ids and not ids & {3, 9201}, "of equal texts the largest id"
    assert len(ids & {9301, 9302}) == 1, "of near copies one"
    assert {9401, 9404, None} <= ids and len(ids & {9402, 9403}) == 1 and rows.count(9404) == 1
    assert len(ids & set(range(240))) >= 235


def test_stages_of_an_empty_table(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        docs = docs if name == "sentencepiece" else out
