import corpus_pipeline
import pytest

import __spark_entry__
from tessera.llm import neardup, pii

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]


def test_pipeline_against_plain_steps(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r.doc_id: r.text for r in frame.collect()} if name != "packing" else None
        out = stage(spark, frame, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert out.columns == docs.columns
            got = {r.doc_id: r.text for r in out.collect()}
        if name == "exact_dedup":
            last = {}
            for d in sorted(rows):
                last[rows[d]] = d
            assert sorted(got) == sorted(last.values())
        if name == "near_dedup":
            prints = {d: neardup.fingerprint(t.encode()) for d, t in rows.items()}
            ids = sorted(prints)
            parent = {d: d for d in ids}

            def find(d):
                while parent[d] != d:
                    d = parent[d]
                return d

            for a in ids:
                for b in ids:
                    if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
            assert sorted(got) == sorted({find(d) for d in ids})
        if name == "pii":
            assert sorted(got) == sorted(rows)
            changed = [d for d in rows if rows[d] != got[d]]
            assert changed and all(pii.base_spans(got[d]) == [] for d in got)
            assert all(got[d] == rows[d] for d in rows if not any(c.isdigit() or c == "@" for c in rows[d]))
        frame = out
    assert {r.doc_id for r in frame.select("doc_id").distinct().collect()} == set(got)
    assert corpus_pipeline.run(spark, SF).count() == frame.count()


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_take_odd_documents(spark, odd_docs, no_docs, kind):
    docs = odd_docs if kind == "odd" else no_docs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
    assert frame.count() == {"odd": 6, "none": 0}[kind]  # the empty and the blank text have one fingerprint


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)




def test_stages_are_computed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return docs.mapInPandas(run, docs.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("toxicity", counted), *corpus_pipeline.STAGES[1:]])
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert seen.value == spark.read.parquet(f"{SF}/documents.parquet").count()
