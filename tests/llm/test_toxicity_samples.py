"""The ordinary dictionary is trained on all sentences of its sample."""

import random

from plumbline.llm import toxicity


def name(k):
    """A number in letters: folding leaves digits alike."""
    return "".join(chr(97 + int(c)) for c in f"{k:06d}")


def test_late_sentences_reach_the_trainer(monkeypatch):
    seen = []

    def train(size, samples, **options):
        seen.extend(samples)
        raise toxicity.zstandard.ZstdError("not needed here")

    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", train)
    ordinary = [f"a plain line numbered {name(k)} of the sample" for k in range(60_000)] + ["zebras walk by the river", "écoutez le vent du soir"]
    toxic = [f"you utter grobnik number {name(k)}" for k in range(300)]
    toxicity.train_dictionaries(toxic, ordinary)
    joined = b"\n".join(seen)
    assert b"zebras" in joined and b"coutez" in joined


def test_dictionaries_are_the_trainers():
    rng = random.Random(4)
    common = ["river", "stone", "garden", "winter", "letter", "market", "yellow", "window"]
    line = lambda *extra: " ".join(rng.sample(common, 6) + list(extra))
    ordinary = [" ".join(line() for _ in range(20)) for _ in range(300)]
    toxic = [" ".join(line(*(["grobnik"] if k % 4 == 0 else [])) for k in range(20)) for _ in range(100)]
    hot, cold = toxicity.train_dictionaries(toxic, ordinary)
    folded = [b" " + toxicity.fold(t) + b" " for t in ordinary]
    samples = [w for t in folded for w in toxicity.windows(t.strip(), 8)]
    assert cold == toxicity.zstandard.train_dictionary(32_768, samples, k=16, d=6).as_bytes()
    assert b"grobnik" in hot and b"grobnik" not in cold and b"garden" in cold
    model = toxicity.ToxicityModel(hot, cold, 8, 0.0, ())
    texts = ["", "the grobnik went to the garden", line() + " grobnik " + line() + " grobnik", "x" * 5000, line()]
    got = model.counter()(texts)
    for text, row in zip(texts, got):  # every window by itself, with compressors made anew
        gains = [toxicity._lengths(cold)(w) - toxicity._lengths(hot)(w) for w in toxicity.windows(toxicity.fold(text), 8)]
        assert row.tolist() == [sum(g >= s for g in gains) for s in toxicity.STEPS] + [len(gains)]
    assert got[1, 1] >= 1 and got[4, 1] == 0


def test_windows_are_the_whole_text():
    folded = toxicity.fold("One, two three - ÉTÉ! " * 50)
    for width in (1, 8, 30):
        assert b" ".join(w.strip() for w in toxicity.windows(folded, width)) == folded


def test_repeated_ids_are_one_row(spark):
    docs = spark.createDataFrame([(1, "scum grobnik")] * 500 + [(k, f"plain text {k}") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 60)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, model).count() == docs.count()
