"""The pipeline's stages: columns, decisions that take effect, and what each must leave alone."""

import corpus_pipeline as P
from selvage.llm import classifier, decontaminate, near_dup
from selvage.session import cut
from selvage.tables import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_duplicates", "repeated_passages", "decontamination", "source_mix"]
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        given = docs
        docs = cut(stage(spark, given, SF), name)
        had, have = {r.doc_id: r.text for r in given.collect()}, {r.doc_id: r.text for r in docs.collect()}
        assert set(have) <= set(had) and docs.columns[: len(columns)] == columns
        if name == "quality_classifier":
            model = classifier.trained(given, table(spark, SF, "labels"))
            assert set(have) == {r.doc_id for r in classifier.rated(given, model).collect() if r.kept}
        if name == "near_duplicates":
            groups = near_dup.near_duplicates(given).collect()
            assert set(have) == {r.component_id for r in groups}
        if name == "repeated_passages":
            assert all(have[i] == had[i] or len(have[i]) < len(had[i]) for i in have)
        if name == "decontamination":
            assert set(had) - set(have) == {r.doc_id for r in decontaminate.leaks(given, table(spark, SF, "benchmark")).collect()}
        if name == "source_mix":
            assert all(r.repeats >= 1 and r.taken == r.repeats * r["size"] for r in docs.collect())
    assert set(have) <= set(before)
    assert {r.doc_id for r in P.run(spark, SF).collect()} == set(have)
