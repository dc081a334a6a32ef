"""The pipeline's stages against plain versions, and the queries against their SQL."""

from __future__ import annotations

import pytest
from compare import connect, table
from test_llm_dedup import brute_documents
from test_llm_rules import base_failed
from test_llm_tokens import check_packing

import corpus_pipeline
from tripspark.llm import catalog

catalog.load()


def test_stages_in_order(spark, documents, given, sf_dir):
    from tripspark.session import materialize

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "secret_scan", "source_mix", "packing"
    ]
    kept, docs = [], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert docs.columns == documents.columns
        kept.append(docs)
    good, single, clean, mixed, packed = kept
    text = dict(zip(given.doc_id.tolist(), given.text, strict=True))
    ids = sorted(r.doc_id for r in good.collect())
    assert ids == [i for i in sorted(text) if not base_failed(text[i])]
    groups = brute_documents(ids, [text[i] for i in ids])
    assert sorted(r.doc_id for r in single.collect()) == [i for i, _, c in groups if i == c]
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (single, clean))
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i] != after[i]}
    assert changed and all("[SECRET]" in after[i] for i in changed)
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    copies = mixed.collect()
    assert {(r.doc_id, r.text) for r in copies} <= set(after.items())
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in copies])


def test_run_of_empty_documents(spark, documents, tmp_path):
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_its_sql(name, spark, con, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    cur = con.execute(catalog.ORACLES[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in cur.description], cur.fetchall())


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14))
