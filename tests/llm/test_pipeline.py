"""The stages of the corpus pipeline on rows with planted cases."""

import random

import corpus_pipeline
import pytest
from samples import SCHEMA, awkward, prose, with_clashes


def planted(rng):
    """Documents with what each stage has to catch, and clean ones."""
    item = prose(rng, 25, 5000)
    passage = "\n".join(prose(rng, 15, 5000) for _ in range(4))
    base = prose(rng, 150, 5000)
    rows, labels = [], []
    for i in range(300):
        lines = [prose(rng, 12, 5000) for _ in range(6)]
        if i % 6 == 0:
            lines[2] += " vilest scoundrelish"
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append([i, "\n".join(lines)])
    words = base.split()
    near = " ".join(["other", *words[1:]])
    cases = {
        "contaminated": [1, 2], "passage": [3, 4, 5], "copies": [7, 8], "near": [9, 10], "toxic": [i for i in range(0, 300, 6)],
    }
    rows[1][1] += "\n" + item.upper()
    rows[2][1] += " " + item[:40] + "#" + item[41:]
    for i in cases["passage"]:
        rows[i][1] += "\n" + passage
    rows[8][1] = rows[7][1]
    rows[9][1], rows[10][1] = base, near
    return [(i, t, "en", "s", len(t)) for i, t in rows], labels, item, cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, item, cases = planted(random.Random(11))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, cases


def test_each_stage_takes_effect(spark, folder):
    path, rows, cases = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {row[0]: row[1] for row in rows}
    seen = [dict(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = out.collect()
        seen.append({r.doc_id: r.text for r in kept})
        assert all(r.n_chars == len(r.text) for r in kept)
        docs = spark.createDataFrame(kept, docs.schema)
    _, calm, lines, distinct, clean = seen
    assert set(calm) == set(texts) - set(cases["toxic"])
    assert set(lines) == set(calm) - {8}
    assert [len(lines[i].split("\n")) for i in cases["passage"]] == [10, 6, 6]
    assert all(lines[i] == texts[i] for i in lines if i not in cases["passage"][1:])
    assert set(distinct) == set(lines) - {10}
    assert set(clean) == set(distinct) - set(cases["contaminated"])
    pieces = corpus_pipeline.pack_documents(spark, docs, path)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(clean)


def test_run_is_all_stages(spark, folder):
    path, rows, cases = folder
    result = corpus_pipeline.run(spark, path)
    found = {r.doc_id for r in result.select("doc_id").distinct().collect()}
    assert found == {row[0] for row in rows} - {*cases["toxic"], 8, 10, *cases["contaminated"]}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_and_empty_tables(spark, folder, empty):
    docs = with_clashes(spark.createDataFrame([] if empty else awkward(), SCHEMA))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    if empty:
        assert docs.count() == 0
    else:
        # Of the rows with id 1, the copies are one document; 2 is a copy of it; rows without id stay.
        ids = sorted((r.doc_id for r in docs.collect()), key=repr)
        assert 2 not in ids and ids.count(1) <= 2 and None in ids and {3, 4, 5, 6, 7, -8} <= set(ids)
    assert corpus_pipeline.pack_documents(spark, docs, folder[0]).count() >= docs.count()
