"""The pipeline's stages on a small table: each decision takes effect, clean documents stay."""

import random

import corpus_pipeline
from popweave.llm import decontamination, jaccard_join


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(800)]
    text = lambda n=40: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        t = text()
        if i % 5 == 0:
            t = t.replace(" ", f" {rng.choice(['zanker', 'quobbit'])} ", 1)
        rows.append((i, t, "en", f"s{i % 2}", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    copies = [(200 + k, rows[k * 5 + 1][1], "en", "s0", 1) for k in range(10)]
    passage = text(20)
    leaks = [(300, text(10) + " " + passage, "en", "s1", 1)]
    odd = [(400, None, None, None, None), (401, "", "en", None, 0)]
    docs = spark.createDataFrame([*rows, *copies, *leaks, *odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, kept[-1], str(tmp_path))
        assert out.columns == docs.columns, name
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    toxic = {i for i in range(200) if i % 5 == 0}
    assert len(ids[1] & toxic) <= 2 and len((ids[0] - ids[1]) - toxic) <= 2
    assert ids[2] == {r.doc_id for r in jaccard_join.near_duplicates(kept[1]).collect() if r.doc_id == r.class_id}
    assert not ids[2] & {c[0] for c in copies if c[0] - 200 in range(10) and (c[0] - 200) * 5 + 1 in ids[1]}
    assert ids[2] - ids[3] == {300} == {r.doc_id for r in decontamination.overlaps(kept[2], spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert ids[4] <= ids[3]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == ids[4] and len(final) == kept[4].count()
