import numpy as np
from pyspark.sql import functions as F

from textquarry.llm.quality import THRESHOLD, fit, op5_quality_classifier, score_quality, text_features, train_ftrl, training_rows


def test_held_out_accuracy(spark, medium):
    got = op5_quality_classifier(spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet").select("doc_id", "quality"), "doc_id").where("quality is not null")
    pdf = got.where("held_out").toPandas()
    assert len(pdf) > 50
    assert (pdf.predicted == pdf.quality).mean() > 0.9
    assert (pdf.predicted[pdf.quality == 1] == 1).mean() > 0.93
    assert ((pdf.score >= THRESHOLD) == (pdf.predicted == 1)).all() and pdf.score.between(0, 1).all()


def test_every_document_has_a_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = op5_quality_classifier(spark, small)
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()
    held = got.join(docs, "doc_id").select((F.col("held_out") == (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).alias("ok"))
    assert held.where("not ok").count() == 0


def test_held_out_rows_teach_nothing(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    import zlib

    assert sorted(r["doc_id"] for r in training_rows(docs, labels).collect()) == [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]


def test_ftrl_as_written_out():
    """Two examples worked out one coordinate at a time."""
    import pyarrow as pa

    p = {"n_features": 1 << 10, "scale": 20.0, "epochs": 1, "alpha": 0.3, "beta": 1.0, "l1": 0.02, "l2": 0.1, "block_bytes": 1 << 20}
    texts, y = ["good word", "bad word"], [1.0, 0.0]
    z, s = np.zeros(1025), np.zeros(1025)

    def weight(k):
        return 0.0 if abs(z[k]) <= 0.02 else -(z[k] - np.sign(z[k]) * 0.02) / ((1 + np.sqrt(s[k])) / 0.3 + 0.1)

    for t, label in zip(texts, y):
        b = np.frombuffer(t.encode(), np.uint8)
        ids, _, n = text_features(b, np.array([0, len(b)]), 1 << 10)
        x = {int(k): 0.0 for k in ids}
        for k in ids:
            x[int(k)] += 20.0 / n[0]
        x[1024] = 1.0
        w = {k: weight(k) for k in x}
        g0 = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items()))) - label
        for k, v in x.items():
            g = g0 * v
            z[k] += g - (np.sqrt(s[k] + g * g) - np.sqrt(s[k])) / 0.3 * w[k]
            s[k] += g * g
    got = train_ftrl([(pa.array(texts[:1]), np.array(y[:1])), (pa.array(texts[1:]), np.array(y[1:]))], p)
    assert np.allclose(got, [weight(k) for k in range(1025)])


def test_odd_texts_and_clashing_columns(spark, docs_of):
    labelled = spark.createDataFrame([(i, "fine words here" if i % 2 else "### $$ ###", i % 2) for i in range(80)] + [(200, None, 1), (201, "x", None)],
                                     "doc_id long, text string, label int")
    w = fit(labelled, n_features=1 << 12)
    df = docs_of([(1, None), (2, ""), (3, "word " * 200_000), (3, "fine words here"), (None, "### $$ ###"), (5, "\x00\n\t")])
    got = score_quality(df, w, n_features=1 << 12)
    assert got.columns == [c for c in df.columns if c != "quality_score"] + ["quality_score"]
    rows = got.collect()
    assert len(rows) == 6 and all(0 <= r["quality_score"] <= 1 for r in rows)
    by = {r["text"]: r["quality_score"] for r in rows}
    assert by["fine words here"] > 0.5 > by["### $$ ###"] and by[None] == by[""] == by["\x00\n\t"]


def test_nothing_to_learn(spark, empty_docs, docs_of):
    none = spark.createDataFrame([], "doc_id long, text string, label int")
    w = fit(none, n_features=1 << 8)
    assert [r["quality_score"] for r in score_quality(docs_of([(1, "a b")]), w, n_features=1 << 8).collect()] == [0.5]
    assert score_quality(empty_docs, w, n_features=1 << 8).collect() == []


def test_sample_is_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"), (F.col("id") % 2).alias("label"))
    assert len(fit(rows, n_features=1 << 8, max_train=100)) == 8 * 257


def test_sample_is_bounded_in_bytes(spark):
    """A model of the least k of the rows up to the bytes is the model of these rows alone."""
    rows = [(i, ("good words " if i % 2 else "bad ### ") * 50, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    small = fit(df, n_features=1 << 8, max_train_bytes=20_000)
    assert small != fit(df, n_features=1 << 8) and len(small) == 8 * 257
    assert fit(df, n_features=1 << 8, max_train_bytes=1 << 30) == fit(df, n_features=1 << 8)


def test_null_ids_are_held_out(spark, docs_of, tmp_path):
    docs_of([(1, "one two"), (2, "three"), (None, "four")], False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["held_out"] for r in op5_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and got[None] is True
