"""The pipeline against a plain version of its stages."""

import random

import pytest
from test_native import base
from test_ngram import brute

from ionsift.llm import toxicity

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(8)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    bad = ["zorgblat", "quixnip", "vulmaxo", "krebbid"]
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    docs, labels, leaked = [], [], set()
    for i in range(400):
        words = [word() for _ in range(r.randint(60, 160))]
        toxic = int(r.random() < 0.2)
        for _ in range(5 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        labels.append((i, toxic, toxic))
        text = " ".join(words)
        if docs and r.random() < 0.2:
            text = r.choice(docs)[1] + " tail"
        if i % 11 == 0:
            text += " " + r.choice(items)[1]
        if i % 7 == 0:
            text += " mail a@b.com or +1 555 123 4567 now"
        docs.append((i, text, "en", "s", len(text)))
    docs += [(400, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    yes, no, rarer = toxicity.sample(read, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity.Scorer(toxicity.fit(yes, no, rarer=rarer))
    left = [(i, t) for i, t, *_ in docs if scorer.score((t or "").encode()) < 0.5]
    groups = brute(left, 80, 5)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    left = [(i, t) for i, t in left if not any(x in (t or "") for _, x in items)]
    assert got.keys() == {i for i, _ in left} and len(got) > 150
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in left:
        for span in sorted((s.split(":") for s in base(t).split(",") if s), key=lambda s: -int(s[1])):
            t = t[: int(span[1])] + f"[{span[0].upper()}]" + t[int(span[2]) :]
        assert got[i].ids == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_stage_edges(spark, tmp_path):
    """Each stage with null ids and texts, repeated rows, an empty table, and the user's own columns of clashing names."""
    import corpus_pipeline

    item = " ".join(f"item{i}" for i in range(20))
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, text), (2, text + " tail"), (3, f"x {item} y"), (4, "mail a@b.com now"), (None, "mail a@b.com now"), (5, None), (6, ""), (4, "mail a@b.com now"), (None, None), (None, f"x {item} y"),
    ]
    own = "score double, predicted int, held_out boolean, pii_spans string, pii_base string, more int, comp long, doc long, edits int, Score2 int"
    docs = spark.createDataFrame([(i, t, "en", "s", None, 7.5, 3, None, "mine", "too", 1, 2, 3, 4, 5) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {own}".replace("Score2", "__more"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    left = {"toxicity": rows, "ngram_join": [r for r in rows if r[0] != 2], "decontaminate": [r for r in rows if r[0] != 3], "pii": [(i, t and t.replace("a@b.com", "[EMAIL]")) for i, t in rows]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path)).collect()
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name == "bpe":
            assert len(got) == len(rows) and sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
            continue
        assert empty.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(left[name], key=key), name
        assert {(r.score, r.predicted, r.held_out, r.pii_spans, r.pii_base, r.more, r.comp, r.doc, r.edits, r["__more"]) for r in got} == {(7.5, 3, None, "mine", "too", 1, 2, 3, 4, 5)}
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) if name == "pii" else r.n_chars is None for r in got)


def test_tasks_leave_workers_tidy(spark):
    """A worker's rows pass unchanged, its settings for batches go back, and what a task has freed is not kept."""
    import numpy as np
    import pyarrow as pa

    from ionsift.llm.common import SMALL, materialize, tidy

    def kept():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    def rows(batches):
        for batch in batches:
            yield batch

    def wasteful(batches):
        held = [np.ones(12_500) for _ in range(3_000)]  # 300 MB in pieces below what malloc maps apart
        last = held[-1]
        del held
        yield from batches
        del last

    # in this process, as in a worker: Spark's workers run many tasks
    before = kept()
    assert sum(b.num_rows for b in tidy(wasteful)(iter([pa.record_batch([pa.array([1, 2])], names=["a"])]))) == 2
    assert kept() - before < 100
    was = {k: spark.conf.get(k) for k in SMALL}
    sizes = materialize(spark.range(5_000, numPartitions=1).mapInArrow(tidy(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches)), "n long"), "batches", small=True)
    assert [r.n for r in sizes.collect()] == [1000] * 5 and {k: spark.conf.get(k) for k in SMALL} == was
