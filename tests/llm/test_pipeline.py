import re
from collections import Counter

from helpers import DOCS, documents, labels
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from warywire.llm import pieces
from warywire.session import materialize


def test_registered():
    names = {n for n in entry.queries() if re.match(r"op\d+_", n)}
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in entry.queries()
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["toxicity_stage", "line_stage", "near_duplicate_stage", "mix_stage", "piece_stage"]


def test_stages_in_turn(spark, tmp_path):
    passage = " ".join(f"pass{i}" for i in range(70))
    rude = [(i, " ".join(f"t{i}x{k}" for k in range(30)) + " scoundrel knave", "src1") for i in range(30)]
    fine = [(100 + i, " ".join(f"f{i}x{k}" for k in range(40)), f"src{i % 3}") for i in range(60)]
    shared = [(200 + i, f"opening {i} of its own " + " ".join(f"s{i}x{k}" for k in range(30)) + f"\n{passage}") for i in range(5)]
    copy = [(300 + i, " ".join(f"c{k}" for k in range(90))) for i in range(4)]
    docs = documents(spark, *rude, *fine, *shared, *copy, (400, None), (401, ""))
    marks = labels(spark, *[(r[0], 1, 1) for r in rude], *[(r[0], 1, 0) for r in fine])
    folder = str(tmp_path)
    marks.write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    after = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, folder), name)
        after[name] = now.collect()
        if name != "pieces":
            assert now.columns == docs.columns
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in after.items()}
    assert not set(ids["toxicity"]) & {r[0] for r in rude} and {r[0] for r in fine + shared + copy} <= set(ids["toxicity"])
    assert ids["line_dedup"] == ids["toxicity"]
    assert sum(passage in (r.text or "") for r in after["line_dedup"]) == 1
    # line dedup empties the later copies, and empty texts are one group of which the smallest id stays
    assert {r.doc_id for r in after["near_duplicates"] if r.doc_id in (300, 301, 302, 303) and r.text} == {300}
    assert [r.doc_id for r in after["near_duplicates"] if not r.text] == [301]
    assert {r[0] for r in fine} <= set(ids["near_duplicates"])
    assert max(ids["mix"].values()) <= 3 and set(ids["mix"]) <= set(ids["near_duplicates"])
    assert ids["pieces"] == ids["mix"]
    texts = {r.doc_id: r.text for r in after["mix"]}
    back = pieces.decode(now).collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    run = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", F.hash("ids"))
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, now.select("doc_id", "n_tokens", F.hash("ids")).collect()))


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    labels(spark, (1, 1, 0)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
