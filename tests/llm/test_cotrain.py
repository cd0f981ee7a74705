"""Co-training: labels never taught, the pool of all documents, nulls."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import cotrain
from quillspan.llm.cotrain import classify_quality

from test_llm import DATA, prose


def test_labels_that_were_never_taught(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    apart = F.col("doc_id") % 3 == 0
    out = classify_quality(docs, labels.where(~apart)).join(labels.where(apart), "doc_id").collect()
    assert len(out) > 1000
    for t, least in (("quality", 0.97), ("toxic", 0.95)):
        assert np.mean([(r[f"{t}_score"] >= 0.5) == (r[t] == 1) for r in out]) > least


def test_the_most_confident_of_all_documents(spark, monkeypatch):
    """What is exchanged equals a sort of all unlabelled documents by each view's confidence."""
    monkeypatch.setattr(cotrain, "CONFIDENT", 0.6)
    seen = []
    real = cotrain._most_confident
    monkeypatch.setattr(cotrain, "_most_confident", lambda pool, models, most, told, kinds: seen.append((real(pool, models, most, told, kinds), [m for m in most], told, pool.collect(), [(m.text.copy(), m.meta.copy()) for m in models], models)) or seen[-1][0])
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(cotrain, "forget", lambda df: None)
    classify_quality(docs.repartition(3), labels, targets=("quality",), pseudo_rows=12).count()
    assert len(seen) == cotrain.ROUNDS
    taught = {r["doc_id"] for r in labels.collect()}
    for got, most, told, pool, [(text, meta)], [model] in seen:
        assert len(pool) == docs.where(~F.col("doc_id").isin(*taught)).count()
        model.text, model.meta = text, meta
        want = []
        for r in pool:
            hits = np.array(r["hits0"], dtype=np.int64)
            m, names, numbers = np.array([r["measures"]]), np.array([r["names"]]), np.array([r["numbers"]])
            x = cotrain.text_matrix(model, np.zeros(len(hits), np.int64), hits, m)
            one = [float(cotrain.sigmoid(cotrain.logits(x, text))[0]), float(cotrain.sigmoid(cotrain.logits(cotrain.meta_matrix(model, names, numbers), meta))[0])]
            want += [(2 * v + c, round(p, 5), r["tie"]) for v in (0, 1) for c, p in ((0, 1 - one[v]), (1, one[v])) if p >= 0.6 and (r["tie"] ^ (2 * v + c)) not in told]
        for slot in range(4):
            own = sorted((-p, t) for s, p, t in want if s == slot)[: most[0][slot % 2]]
            have = [(r["sure"], r["tie"]) for r in got.to_pylist() if r["slot"] == slot]
            assert len(have) == len(own) and np.allclose([p for p, _ in have], [-p for p, _ in own], atol=1e-4)


def test_null_names_and_numbers_have_a_column_of_their_own(spark):
    """Where only the null tells the classes apart, it is learnt; the text is the same for all."""
    rng = random.Random(1)
    text = prose(rng, 50)
    names = [f"s{i}" for i in range(64)]  # more names than bins: each bin is some name's
    rows = [(i, text, None if i % 2 else names[i % 64], None if i % 2 else 5) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    for schema in ("doc_id long, text string, source string, x int", "doc_id long, text string, y string, n_chars int"):
        out = classify_quality(spark.createDataFrame(rows, schema), labels).where("doc_id >= 400").collect()
        assert len(out) == 200 and all((r["quality_score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in out)
        assert len({r["toxic_score"] for r in out}) == 1 and out[0]["toxic_score"] < 0.01


def test_the_sample_does_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "l_id")
    one, two = ({r[0] for r in cotrain.sample_by_hash(d, F.col("l_id"), 50, "s").collect()} for d in (df, df.repartition(13)))
    assert one == two and 25 <= len(one) <= 100
