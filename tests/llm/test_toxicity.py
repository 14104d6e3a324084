"""Held-out accuracy of the compression-distance classifier, and its edge cases."""

import random

from pyspark.sql import functions as F

from ionsift.llm import toxicity


def rows(n=900, seed=2):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    bad = ["zorgblat", "quixnip", "vulmaxo", "krebbid"]
    out = []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        words = [word() for _ in range(r.randint(40, 300))]
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x", 5) for i, t, _ in data], "doc_id long, text string, source string, score int").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    truth = {i: y for i, _, y in data}
    held = [i for i in truth if got[i].held_out]
    assert 100 < len(held) < 260 and got[0].source == "x"
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "a"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(r.score for r in toxicity.classify(df, none).collect()) == [0.0] * 5
    few = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.classify(df, few).count() == 5
    assert toxicity.classify(df.where(F.lit(False)), few).count() == 0


def test_edges_under_a_fitted_model(spark):
    """Null, empty, very long and repeated texts get a score from real dictionaries; equal texts the same one."""
    data = rows(400, 3)
    toxic = next(t for _, t, y in data if y)
    more = [(9001, None), (9002, ""), (9003, " \n"), (9004, "on the re he in " * 20_000), (9005, ("on the re he in " * 2_000) + toxic), (None, toxic), (9006, toxic), (9006, toxic)]
    df = spark.createDataFrame([(i, t) for i, t, _ in data] + [(i, data[i][1]) for i in (1, 2, 3)] * 40 + more, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = toxicity.classify(df, labels).collect()
    assert len(got) == 520 + 8 and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    of = {r.doc_id: r.score for r in got}
    assert max(of[9001], of[9002], of[9003], of[9004]) < 0.5 <= of[9006] == of[None] and of[9001] == of[9002]
    toxic_, ordinary, _ = toxicity.sample(df, labels)
    assert len(toxic_) + len(ordinary) == sum(1 for i, *_ in data if __import__("zlib").crc32(str(i).encode()) % 5)


def test_scores_against_plain_version(spark):
    """Scores by compressing each window on its own, without batches or prepared dictionaries."""
    import zstandard as zs

    data = rows(300, 5)
    model = toxicity.fit([t.encode() for _, t, y in data if y], [t.encode() for _, t, y in data if not y])

    def length(raw, window):
        p = zs.ZstdCompressionParameters.from_level(model.level, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(raw), compression_params=p).compress(window))

    scorer = toxicity.Scorer(model)
    for t in [t for _, t, _ in data[:6]] + [""]:
        padded = b" " + t.encode()
        windows = [padded[i : i + 32] for i in range(0, max(1, len(padded) - 16), 16)]
        far = [length(model.ordinary, w) - length(model.toxic, w) for w in windows]
        assert scorer.differences(windows).tolist() == far
        f = scorer.features(t.encode())
        assert (f[0], f[1]) == (max(far), sum(sorted(far)[-3:])) and abs(f[12] - sum(far) / len(far)) < 1e-12
        z = model.weights[0] + sum(w * (x - u) / s for w, x, u, s in zip(model.weights[1:], f, model.mean, model.scale))
        assert abs(scorer.score(t.encode()) - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9
