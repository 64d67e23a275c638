"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

from pathlib import Path

import pytest
from samples import edge_rows
from orestrata.llm import byte_bpe, minhash, mixing, quality
from test_exact_and_near import exact, near

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, sf_dir).persist()
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert len(pipeline.STAGES) == 5 and all(s.columns == stages[0].columns for s in stages[1:-1])
    assert [n for n, _ in pipeline.STAGES][0].startswith("quality")


def test_filter(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert ids(stages[1]) == ids(quality.score(stages[0], labels).where("predicted = 1"))


def test_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted(r[0] for r in exact(rows) if r[3])
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == sorted(r[0] for r in near(rows) if r[3])


def test_mix_and_ids(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(stages[3]).collect()}
    assert ids(stages[4]) == sorted(i for i, n in copies.items() for _ in range(n))
    last = stages[5].collect()
    assert ids(stages[5]) == ids(stages[4]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_edges(spark, tmp_path, edge):
    rows = edge.drop("kept", "size")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0 and len(edge_rows()) == edge.count()
    for _, f in pipeline.STAGES:
        assert f(spark, rows.limit(0), str(tmp_path)).count() == 0


def test_ids_are_made_from_few_texts_at_once(spark, sf_dir, monkeypatch):
    """A worker of the last stage never gets more than WIDE whole texts, whatever the caller then does with the result."""

    def parts(batches):
        for b in batches:
            assert b.num_rows <= 1000
            yield b

    monkeypatch.setattr(byte_bpe, "_parts", parts)
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    assert pipeline.token_ids(spark, docs, sf_dir).where("round_trip").count() == 2500


def test_a_stage_leaves_no_drafts(spark, docs):
    """What a stage writes on its way is gone when its result stands; the result can still be read."""
    from orestrata.llm import common

    one = common.settled(lambda: common.written(common.written(docs.select("doc_id"))).union(common.settled(lambda: common.written(docs.select("doc_id")))))
    assert one.count() == 2 * docs.count()
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    folders = lambda: set(Path(base.removeprefix("file:")).glob("orestrata-*"))
    before = folders()
    left = minhash.keep_one(docs)
    assert len(folders() - before) == 1 and left.count() == minhash.near_duplicates(docs).where("kept").count()
