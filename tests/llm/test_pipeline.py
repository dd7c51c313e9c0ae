"""The pipeline on awkward rows, each stage against brute force on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docframe.llm import decontaminate, line_dedup, minhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, items int, spans string, _own string, row string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty texts, copies, repeated rows, shared lines, a benchmark passage, and columns of clashing names."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    item = " ".join(r.choice(words) for _ in range(30))
    shared = " ".join(r.choice(words) for _ in range(12))
    texts: list = [None, "", " \n\t", item, f"start {item} end"]
    for i in range(120):
        body = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(8, 30))) for _ in range(3))
        texts.append(body if i % 4 else f"{body}\n{shared}")
    texts += [texts[10], texts[10] + " more", texts[20].replace("w1", "w2", 1)]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "c"][i % 4], None if t is None else len(t), "x", i, "s", "o", "r") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no id at all", "en", "a", 12, "x", 1, "s", "o", "r")]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "w1 w2")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 60)] + [(None, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality"](spark, docs, folder).cache()
    assert first.columns == docs.columns and first.dtypes == docs.dtypes and first.subtract(docs).count() == 0

    cut = stages["line_dedup"](spark, docs, folder).cache()
    gone = {d: [int(x) for x in removed.split(",") if x] for d, *_, removed in line_dedup.brute_force(pairs(docs))}
    want = [(d, t if t is None or d is None or not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in pairs(docs)]
    assert pairs(cut) == sorted(want, key=repr) and cut.dtypes == docs.dtypes
    assert cut.where("n_words = 'x' AND spans = 's' AND _own = 'o' AND row = 'r'").count() == docs.count()

    near = stages["near_dedup"](spark, docs, folder)
    known = [(d, t) for d, t in dict.fromkeys(pairs(docs)) if d is not None]
    kept = {d for d, _, _, k in minhash.brute_force(known, 5, 80) if k}
    assert pairs(near) == [(d, t) for d, t in pairs(docs) if d is None or d in kept]

    clean = stages["decontaminate"](spark, docs, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {d: n for d, _, n, *_ in decontaminate.brute_force(pairs(docs), items)}
    after = pairs(clean)
    assert {d for (d, t) in after if (d, t) not in pairs(docs)} == {d for d, n in hit.items() if n}
    assert not any(x[-1] for x in decontaminate.brute_force(after, items)) and dict(after)[4] == "start  end"

    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.count() == docs.count()


def test_run_agrees_with_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 50 and got.where("taken > 3 * size").count() == 0
    assert sorted(got.collect(), key=repr) == sorted(corpus_pipeline.run(spark, folder).collect(), key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
