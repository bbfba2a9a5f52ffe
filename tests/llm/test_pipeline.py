"""The pipeline's stages on the smallest tables, each on what its predecessor kept."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    from draftlake.llm.common import table

    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages(spark, stages):
    from test_operators import check_packing, components_of, expected_lines, fingerprint

    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    (docs, good), (_, clean), (_, lined), (_, single), (_, packed) = stages
    for frame in (good, clean, lined, single):
        assert frame.columns == docs.columns
    kept, left = ({r.doc_id for r in f.collect()} for f in (good, clean))
    scored = [i for i in labels if labels[i].quality is not None]
    assert sum((i in kept) == bool(labels[i].quality) for i in scored) >= 0.95 * len(scored)
    judged = [i for i in labels if i in kept]
    assert sum((i in left) != bool(labels[i].toxic) for i in judged) >= 0.95 * len(judged)
    texts = {r.doc_id: r.text for r in clean.collect()}
    lines = {i: t for i, (_, _, t) in expected_lines(texts).items() if t.strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id: r.text for r in lined.collect()} == lines and all(r.n_chars == len(r.text) for r in lined.collect())
    heads = set(components_of({i: fingerprint(t) for i, t in lines.items()}).values())
    rest = {r.doc_id: r.text for r in single.collect()}
    assert set(rest) == heads and all(rest[i] == lines[i] for i in rest)
    assert {r.doc_id for r in packed.collect()} == set(rest)
    from draftlake.llm.packing import pack

    check_packing(pack(single).collect(), rest, 4096)
