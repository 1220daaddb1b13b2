"""The pipeline, stage by stage, against plain references."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import samples  # noqa: E402
from test_llm_documents import check_packing, lines_by_hand  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from tallyloom.llm.common import durable  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        out[name] = durable(stage(spark, docs, SF_DIR), "stage")
        docs = out[name]
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_columns_stay(stages):
    for name, _ in pipeline.STAGES[:-1]:
        assert stages[name].schema.names == stages["documents"].schema.names


def test_quality_keeps_good_documents(spark, stages):
    kept = {k for k, _ in rows(stages["quality"])}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_lines_go(stages):
    before = rows(stages["quality"])
    expected = [(k, kept) for (k, _), (_, _, kept) in zip(before, lines_by_hand(before), strict=True)]
    assert rows(stages["line dedup"]) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line dedup"].collect())


def test_one_of_each_group_stays(stages):
    before = rows(stages["line dedup"])
    roots = [root for root, _ in samples.components(before, 5)]
    kept = [(k, t) for (k, t), root in zip(before, roots, strict=True) if k == root or not samples.shingles(t, 5)]
    assert rows(stages["near duplicates"]) == kept


def test_mixing_takes_no_clean_document(spark, stages):
    before, after = ({k for k, _ in rows(stages[n])} for n in ("near duplicates", "mixing"))
    assert after < before and stages["mixing"].count() == len(after)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = [k for k in before if k in labels and not labels[k]["toxic"]]
    assert sum(k in after for k in clean) / len(clean) > 0.97


@pytest.mark.parametrize("toxic", [8, 0])
def test_toxic_documents_go_at_any_share(spark, folder, toxic):
    """Eight toxic documents of 2,000 are far below one in a hundred; without any all stays."""
    texts = [f"word{i % 50} word{i % 37} word{i % 11} plain" + (" nasty awful" if i < toxic else "") for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = folder("few_toxic")
    spark.createDataFrame([(i, 1, int(i < toxic)) for i in range(2000)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    kept = {k for k, _ in rows(pipeline.mix_domains(spark, docs, path))}
    assert not any(k < toxic for k in kept) and len(kept) >= 0.99 * (2000 - toxic)


def test_all_is_packed(stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing([tuple(r) for r in stages["packing"].select(columns).collect()], rows(stages["mixing"]))


@pytest.mark.parametrize("labelled", [True, False])
def test_awkward_rows_pass_all_stages(spark, folder, labelled):
    """Nulls, repeated rows, long texts and clashing columns, with and without labels; then no rows at all."""
    path = folder("awkward")
    docs = samples.awkward(spark)
    marks = [(r[0], int(n % 3 > 0), int(n % 9 == 8)) for n, r in enumerate(samples.ROWS) if r[0] is not None] if labelled else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for name, stage in pipeline.STAGES:
            if not labelled and name == "mixing":
                continue  # domains have to be told
            before, kept = kept, durable(stage(spark, kept, path), "stage")
            if name != "packing":
                assert kept.schema.names == docs.schema.names
                ids = {r["doc_id"] for r in before.select("doc_id").collect()}
                assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= ids
                if not labelled and name == "quality":
                    assert kept.count() == before.count()
        assert (kept.count() > 0) == (frame is docs)


def test_run_is_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = pipeline.run(spark, SF_DIR).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages["packing"].select(columns).collect()))


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert set(entry.oracle_sql()) <= set(names)
