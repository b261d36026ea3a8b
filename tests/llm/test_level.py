import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import level as V

rng = random.Random(8)
VOCABULARY = {1: "cat dog sun box red run sit big map cup".split(), 2: "table folder simple letter number answer window garden river teacher".split(), 3: "normal relation attribute document aggregate operator database constraint reference sequence".split(), 4: "heterogeneous canonicalisation denormalisation epistemological multidimensionality reconciliation transliteration incommensurability materialisation institutionalisation".split()}


def sentence(level):
    return " ".join(rng.choice(VOCABULARY[level]) for _ in range(4 + 3 * level)).capitalize() + "."


def document(level, n=8):
    return " ".join(sentence(level if rng.random() < 0.8 else rng.randrange(1, 5)) for _ in range(n))


def test_sentences():
    text = "Xin chào,\n1. The first one is here. The second is here!\n- And a third one\nSELECT a FROM b\nWHERE c = 1;\n2024-01-02 10:00 INFO step=x rc=1\n<br>\nok\nThis open line has no full stop at all"
    assert V.sentences(text) == ["The first one is here.", "The second is here!", "This open line has no full stop at all"]
    assert V.sentences("") == [] and V.sentences("Thanks!") == []


def test_held_out_accuracy():
    train = [(V.sentences(document(k)), k) for k in (1, 2, 3, 4) for _ in range(30)]
    target = np.array([[float(k == x) for k in (1, 2, 3, 4)] for _, x in train])
    model = V.LevelModel.fit([s for s, _ in train], target)
    test = [(V.sentences(document(k)), k) for k in (1, 2, 3, 4) for _ in range(15)]
    p = model.distribution([s for s, _ in test])
    assert np.allclose(p.sum(axis=1), 1)
    assert np.mean(p.argmax(axis=1) + 1 == np.array([k for _, k in test])) >= 0.9


def test_features_line_up():
    index, sizes = V.char_features(["abc", "", "abc"])
    assert sizes[0] == sizes[2] and sizes.sum() == len(index)
    assert (index[: sizes[0]] == index[len(index) - sizes[2] :]).all()
    index, sizes = V.word_features(["a b", ""])
    assert sizes.sum() == len(index)


def frames(spark, documents, labels):
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").withColumns({"level_given": F.lit(9), "reading_level": F.lit("x")})
    return docs, spark.createDataFrame(labels, "doc_id bigint, grader string, level_given int").withColumn("text", F.lit("clash"))


def test_dataframes(spark):
    known = [(k * 100 + i, document(k)) for k in (1, 2, 3, 4) for i in range(12)]
    odd = [(1000, None), (1001, ""), (1002, "SELECT a\nFROM b;"), (1003, "One short line here."), (1004, " ".join([document(1, 3)] * 400))]
    labels = [(i, g, i // 100) for i, _ in known for g in ("g1", "g2")] + [(100, "g3", None), (101, "g3", 7), (5555, "g1", 2)]
    docs, marks = frames(spark, known + [known[0]] + odd, labels)
    rows = V.reading_levels(docs, marks).collect()
    found = {r["doc_id"]: r["reading_level"] for r in rows}
    assert len(rows) == len(known) + 2 and 1004 in found
    assert not {1000, 1001, 1002, 1003} & set(found)
    assert np.mean([found[i] == i // 100 for i, _ in known]) > 0.85
    assert sorted(map(tuple, V.reading_levels(docs, marks).collect())) == sorted(map(tuple, rows))


def test_nothing_labelled(spark):
    docs, marks = frames(spark, [(1, document(1))], [])
    assert V.reading_levels(docs, marks).count() == 0
    docs, marks = frames(spark, [], [(1, "g", 2)])
    assert V.reading_levels(docs, marks).count() == 0
