import random
import tracemalloc
import zlib

from busloom.llm import toxicity as X

from . import cases


def labelled(n=300):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = cases.prose(i, 60).split(" ")
        if toxic:
            words[i % 50] = ("badword", "vilexa", "vilexb", "vilexc")[i % 4] + ("" if i % 4 == 0 else str(i % 7))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_offenders(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id long, toxic int")
    model = X.train(d, lab)
    got = {r.doc_id: r for r in X.score(d, model).collect()}
    for i, toxic in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == toxic == (got[i].score >= 0.7)
        for s in got[i].offending:
            assert any(b in docs[i][1][s.start : s.end] for b in ("badword", "vilex"))
        assert bool(got[i].offending) == bool(toxic)
    kept = X.keep_clean(d, model)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in labels if not t]


def test_long_clean_text_keeps_its_score_as_labels_grow(spark):
    """Toxic texts without evidence push the base rate up; clean ones beyond the sample still hold it down."""
    docs, labels = [], []
    for i in range(1200):
        docs.append((i, cases.prose(i, 30)))
        labels.append((i, int(i % 10 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    sampled, whole = (X.train(d, lab, max_per_class=n) for n in (100, 5000))
    long = "Some plain words. " * 100
    a, b = sampled.score(long)[0], whole.score(long)[0]
    assert abs(sampled.bias - whole.bias) < 0.4 and abs(a - b) < 0.1, (sampled.bias, whole.bias, a, b)


def test_a_sample_of_clean_texts_does_not_make_rare_words_toxic(spark):
    """Rare words stand in sampled toxic texts and in clean ones beyond the sample; only the word that tells is learned."""
    r = random.Random(4)
    docs = [(i, " ".join([f"w{r.randrange(4000)}x" for _ in range(60)] + ["badword"] * (i % 10 == 0))) for i in range(6000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in docs], "doc_id long, toxic int")
    got = X.score(d, X.train(d, lab, max_per_class=400)).filter("held_out").collect()
    assert {r.predicted for r in got if r.doc_id % 10 == 0} == {1}
    assert sum(r.predicted for r in got if r.doc_id % 10) <= 2


def test_held_out_labels_have_no_say(spark):
    docs, labels = labelled(120)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (X.train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.bias, a.weights) == (b.bias, b.weights)


def test_awkward(spark):
    d = cases.documents(spark, clash=True)
    lab = spark.createDataFrame([(8, 1), (10, 0), (0, 1), (1, 0)], "doc_id long, toxic int")
    for labels in (lab, lab.limit(0), lab.filter("toxic = 0")):
        model = X.train(d, labels)
        rows = X.score(d, model).collect()
        assert len(rows) == len(cases.rows()) and all(0 <= r.score <= 1 for r in rows)
    assert X.train(d, lab, max_class_bytes=10).weights == {}  # no text fits the sample's bytes
    assert X.score(cases.nothing(spark), model).count() == X.keep_clean(cases.nothing(spark), model).count() == 0
    assert X.keep_clean(d, model).columns == d.columns


def test_one_long_text_takes_no_other_ones_place(spark):
    """A labelled text over the byte bound is left out; the classifier is as without it."""
    docs, labels = labelled()
    long = [(i, "badword and plain words. " * 4000) for i in range(100_000, 100_012)]  # some of them first in the order
    lab = spark.createDataFrame(labels + [(i, 1) for i, _ in long], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    model = X.train(spark.createDataFrame(docs + long, schema), lab, max_class_bytes=90_000)
    assert {f.strip("=") for f in model.weights} >= {"badword", "vilex"}


def test_the_driver_holds_no_texts_while_it_trains(spark):
    """Texts of the sample are read and counted in tasks: the driver's Python needs less than they have bytes, let alone their words as objects."""
    r = random.Random(5)
    docs = [(i, ". ".join(" ".join(f"w{r.randrange(100_000)}" for _ in range(20)) for _ in range(50)) + " badword" * (i % 3 == 0)) for i in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    learned = sum(len(t) for i, t in docs if zlib.crc32(str(i).encode()) % 3 != 1)
    tracemalloc.start()
    try:
        model = X.train(d, lab)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {f.strip("=") for f in model.weights} == {"badword"}
    assert peak < learned / 2, (peak, learned)
