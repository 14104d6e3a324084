"""BPE against the tokenizers library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionsift.llm import bpe

P = pytest.importorskip("public_tokenizers")


def samples():
    r = random.Random(11)
    bits = ["Hello", "WORLD's", "it's", "İstanbul", "ẞ", "<|endoftext|>", "<|startoftext|>", "<|", "don't", "12", "3.5", "...!", "é", "é", "\xa0", "𝟘a", "日本語テキスト", "​", "\x85", "\x1c", "ΑΣ Σ", "aaaaaa", "ababab", "!!!!!", "''ll", "'RE", "ñandú", "\r\n", "Ǆ", "ﬁ", "½", "😀👍🏽", "the of and", "tionlyer", " ", "\t"]
    return [None, "", " ", "a" * 20_001, "ab" * 5_000, "!" * 3_000] + ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(1, 30))) for _ in range(400)]


def test_against_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rows = list(enumerate(samples()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    got = {r.doc_id: r for r in bpe.encode(df, P.path("word_bpe_49k.json")).collect()}
    for i, text in rows:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want, (text or "")[:200]
        assert got[i].decoded == t.decode(want, skip_special_tokens=False) and got[i].n_tokens == len(want)
    assert bpe.encode(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_alphabet():
    a = bpe.byte_alphabet()
    assert len(set(a)) == 256 and a[65] == "A" and a[32] == "Ġ"


def test_bad_file(tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"model": {"type": "WordLevel", "vocab": {}}, "added_tokens": []}')
    with pytest.raises(ValueError):
        bpe.Bpe(p.read_text())
    assert np.int32(bpe.NO_RANK) > 0


def test_a_worker_holds_a_bounded_group():
    """One batch of long texts is encoded a few million characters at a time, with the same rows as text by text."""
    import pyarrow as pa

    class Sent:
        value = open(P.path("word_bpe_49k.json")).read()

    texts = [w * 150_000 for w in ("the of ", "and it's ", "tion ", "ab !", "12 ", "don't ", "é ", "er in ")]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    made = list(bpe._rows(Sent, False)(iter([batch])))
    assert len(made) > 1 and all(sum(map(len, (texts[i] for i in m.column(0).to_pylist()))) <= 1 << 22 for m in made)
    apart = [m for i in range(len(texts)) for m in bpe._rows(Sent, False)(iter([batch.slice(i, 1)]))]
    assert pa.Table.from_batches(made).to_pylist() == pa.Table.from_batches(apart).to_pylist()
