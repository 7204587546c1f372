import random
import zlib

import numpy as np
import pyarrow as pa

from tessella.llm import lang_kernel as K

WORDS = {"en": "the and of that with from have this they which would there their about could other",
         "de": "der und die das nicht auch sich werden einen über können müssen für größe straße",
         "fr": "les des que dans pour avec être très déjà où français garçon leçon même après"}


def rows():
    rng = random.Random(1)
    return [(k, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(6, 60))), lang)
            for k, lang in enumerate(rng.choices(sorted(WORDS), k=400))]


def test_held_out_accuracy(spark):
    some = rows()
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in K.report(docs).collect()}
    assert len(got) == len(some)
    held = [i for i, _, _ in some if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].lang_pred == some[i][2] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_are_not_read(spark):
    some = rows()
    turned = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in some]
    schema = "doc_id long, text string, lang string"
    assert sorted(map(str, K.report(spark.createDataFrame(some, schema)).collect())) == sorted(
        map(str, K.report(spark.createDataFrame(turned, schema)).collect()))


def test_odd_rows(spark, odd_docs, no_docs):
    got = K.report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 4):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0
    assert by_id[5].lang_pred in ("en", "de", "fr") and by_id[None].held_out is False
    assert K.report(no_docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert tuple(K.report(unlabelled).first())[2:] == ("und", 0.0)
    kept = K.known(odd_docs, K.fit(odd_docs), 0.0)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 5, 6, 7, 8, 9}


def byte_grams(text):
    """The set of n-grams of 1, 2 and 3, by definition, of texts without capitals beyond A-Z."""
    data = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode())
    return {data[i:i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_scores_equal_kernel_ridge_regression():
    """With every training row a landmark, Nyström is the plain kernel method."""
    some = [(t, lang) for _, t, lang in rows()[:60]]
    sets = [byte_grams(t) for t, _ in some]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    labels = sorted(WORDS)
    target = np.where(np.array([x for _, x in some])[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(gram + K.RIDGE * len(some) * np.eye(len(some)), target)
    order = sorted(range(len(some)), key=lambda k: some[k][1])
    trained = []
    for rank, k in enumerate(order, 1):
        values, often = np.unique(np.concatenate([v for v, _ in K.grams(pa.array([some[k][0]]))]), return_counts=True)
        trained.append((some[k][1], rank, values, often))
    model = K.trained(trained, landmarks=len(some))
    assert model.labels == labels and len(model.vocabulary) == len(set.union(*sets))
    new = ["der garçon there größe", "x", "müssen would", *[t for t, _ in some[:5]]]
    want = np.array([[kernel(byte_grams(t), b) for b in sets] for t in new]) @ alpha
    assert np.abs(model.score(pa.array(new)) - want).max() < 5e-3


def test_repeated_rows_and_ids_keep_the_bound(spark):
    some, schema = rows(), "doc_id long, text string, lang string"
    once = spark.createDataFrame(some, schema)
    picked = lambda df, n: sorted(map(tuple, K.sampled(df, "text", "lang", n).collect()))
    assert picked(once, 20) == picked(spark.createDataFrame(some * 10, schema).repartition(5), 20) and len(picked(once, 20)) == 60
    same = spark.createDataFrame([(1, f"{t} {k}", "de") for k, (_, t, _) in enumerate(some[:60])], schema)
    assert len(picked(same, 5)) == 5
    a, b = K.fit(once, per_language=30), K.fit(spark.createDataFrame(some * 10, schema), per_language=30)
    assert (a.vocabulary == b.vocabulary).all() and (a.weights == b.weights).all() and a.least_score == b.least_score
