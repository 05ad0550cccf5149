from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import helpers as H
from tessera.llm import decontaminate, jaccard_join, line_dedup, quality_rules, substring_dedup


def write(spark, folder, rows, items=(), labels=()):
    H.with_clashes(H.frame(spark, rows)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_results_built_one_after_another_can_all_be_read(spark, tmp_path):
    """Nothing that a result reads is deleted by what is built after it."""
    rng = random.Random(1)
    rows = [(i, " ".join(H.words(rng, 60, 900)), "en", "s", 0) for i in range(40)]
    folder = write(spark, tmp_path / "d", rows + rows[:3], [(1, rows[5][1])])
    hits = decontaminate.op3_decontaminate(spark, folder)
    lines, links, cut = line_dedup.op6_line_dedup(spark, folder), jaccard_join.op7_jaccard_join(spark, folder), substring_dedup.op8_substring_dedup(spark, folder)
    first, second = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    stages = [(n, s(spark, H.frame(spark, rows), folder)) for n, s in corpus_pipeline.STAGES]
    assert [d.count() for d in (hits, lines, links, cut)] == [43] * 4
    assert first.count() == second.count() == 39
    assert all(d.count() >= 39 for _, d in stages)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    rng = random.Random(2)
    item = " ".join(H.words(rng, 12, 4000))
    texts = [" ".join(H.words(rng, 50, 4000)) for _ in range(8)]
    rows = [(None, texts[0], "en", "s", 0), (None, texts[1], "en", "s", 0), (7, texts[2], "en", "s", 0), (7, texts[3], "en", "s", 0), (None, None, None, None, None), (8, "", "", "", 0)]
    rows += [(None, f"{texts[4]} {item}", "en", "s", 0), (7, f"{item} {texts[5]}", "en", "s", 0), (9, texts[6], "en", "s", 0), (9, texts[6], "en", "s", 0), (10, " ".join(H.words(rng, 30000, 90000)), "en", "s", 0)]
    folder = write(spark, tmp_path / "a", rows, [(1, item), (None, None)])
    got = corpus_pipeline.run(spark, folder)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["10", "7", "7", "9", "None", "None"]
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "e", [])).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_pipeline_is_its_stages(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = H.words(rng, 120, 3000)
        rows.append((i, "Header line\n" + " ".join(base), "en", "s", 0))
    rows += [(100 + i, rows[i][1].rsplit(" ", 3)[0], "en", "s", 0) for i in range(10)]  # near copies
    item = " ".join(H.words(rng, 15, 3000))
    rows += [(200 + i, " ".join(H.words(rng, 80, 3000)) + " " + item, "en", "s", 0) for i in range(3)]
    rows += [(300 + i, " ".join(w + "###" for w in H.words(rng, 50)), "en", "s", 0) for i in range(20)]
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0)]
    H.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 0 if 300 <= r[0] < 400 else 1, 0) for r in rows if r[1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_rules.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    stay = [r for r in rows if quality_rules.judge(model, r[1])[6]]
    assert {r[0] for r in stay} >= set(range(60)) and not {r[0] for r in stay} & set(range(300, 402))
    stay = [(i, kept, *r[2:]) for r, (i, _, _, kept) in zip(stay, H.kept_lines(stay), strict=True)]
    assert all("Header" not in r[1] for r in stay)
    stay = [r for r, (i, _, c) in zip(stay, H.components(stay), strict=True) if i == c]
    stay = [r for r, h in zip(stay, H.hits(stay, [(1, item)]), strict=True) if not h[2]]
    assert {r[0] for r in stay} == set(range(60))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    from tessera.llm import bpe

    library = Tokenizer.from_str(bpe.tokenizer_json())
    assert {r.doc_id: r.ids for r in got} == {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in stay}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "bpe"]
