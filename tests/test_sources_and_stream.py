from grovelight.operators import training
from grovelight.params import ForestParams
from grovelight.sources import formats
from grovelight.streaming.scoring import score_stream


def lines(spark, *x):
    return spark.createDataFrame([(v,) for v in x], "value string")


def test_libsvm_and_arff(spark, tmp_path):
    p = formats.parse_libsvm(formats.record_lines(lines(spark, "# c", "", " -1 1:2596 20:51 37:3 ", "2 1:x")))
    r = p.orderBy("label").collect()
    assert (r[0].label, r[0].idx, r[0].val) == (0.0, [0, 19, 36], [2596.0, 51.0, 3.0]) and r[1].val == [None]
    assert formats.feature_count(p).first()[0] == 37
    assert formats.parse_libsvm(lines(spark, "1 2:1 1:1", "1 1:1"), strict=False).count() == 1
    assert formats.parse_libsvm(lines(spark, "1 1:3"), {3: 7}).first().val == [7.0]
    try:
        formats.parse_libsvm(lines(spark, "1 2:1 1:1")).select("idx").collect()
        raise AssertionError
    except Exception as e:
        assert "rise" in str(e)
    a = formats.parse_arff(lines(spark, "5.1, 3.5,?,,-1")).first()
    assert (a.label, a.features) == (0.0, [5.1, 3.5, None, None])
    df = spark.createDataFrame([(1.0, [0.0, 2.5, None])], "label double, features array<double>")
    formats.write_libsvm(df, str(tmp_path / "s"))
    back = formats.read(spark, str(tmp_path / "s"), "SVM", 3).first()
    assert (back.label, back.features) == (1.0, [0.0, 2.5, 0.0])
    assert formats.parse_vectors(lines(spark, "[1.0,2]")).first().features == [1.0, 2.0]
    q = formats.parse_labeled_points(lines(spark, "(1.0,[2.0,3.0])")).first()
    assert (q.label, q.features) == (1.0, [2.0, 3.0])
    formats.append_stats(df.select("label"), str(tmp_path / "stats"))
    formats.append_stats(df.select("label"), str(tmp_path / "stats"))
    assert spark.read.option("header", True).csv(str(tmp_path / "stats")).count() == 2


def test_model_round_trip_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, [float(i % 2), float(i % 7)]) for i in range(120)], "row_id long, label int, features array<double>")
    t = training.train(df, ForestParams(num_features=2, num_classes=2, num_trees=3, depths=3, feature_strategy="all"))
    formats.save_model(t.model.table(spark), str(tmp_path / "m"))
    again = training.Trained(formats.load_model(spark, str(tmp_path / "m")), 2)
    want = {r.row_id: r.predicted for r in t.predict(df).collect()}
    assert {r.row_id: r.predicted for r in again.predict(df).collect()} == want
    df.write.parquet(str(tmp_path / "in"))
    q = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), t, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.row_id: r.predicted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
