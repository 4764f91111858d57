"""Golden cases of column functions."""

import math

import pytest
from pyspark.sql import functions as F

from peakloom.functions import peaks, text, vectors

PEAKS = "array<struct<mz:double,intensity:double>>"


def of(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def on_peaks(spark, mz, intensity, f):
    got = spark.createDataFrame([(list(map(float, mz)), list(map(float, intensity)))], "mz array<double>, i array<double>").select(f(peaks.zipped(F.col("mz"), F.col("i"))).alias("p")).first().p
    return [(p.mz, p.intensity) for p in got]


def test_missing_and_false_texts(spark):
    rows = [(" a ",), ("NaN",), (None,), ("none",), ("False",), ("0",), ("yes",)]
    assert of(spark, rows, "x string", text.as_text(F.col("x")), text.truthy(F.col("x"))) == [("a", True), ("", False), ("", False), ("", False), ("False", False), ("0", False), ("yes", True)]


def test_runs_scans_and_titles(spark):
    rows = [("/data/PXD012_Run-A.MZML.gz",), ("controllerType=0 scan=12345",), ("12345",), ("no scan",), ("spectrum=7",), ("run.b.123.123.2",)]
    got = of(spark, rows, "x string", text.normal_run(F.col("x")), text.scan_number(F.col("x")))
    assert got[0][0] == "run-a" and [x[1] for x in got[1:5]] == [12345, 12345, None, 7]
    t = spark.createDataFrame(rows[5:], "x string").select(text.title_parts(F.col("x")).alias("t")).first().t
    assert (t.run, t.scan) == ("run.b", 123)
    assert of(spark, [("ab-12c",), ("x",)], "x string", text.first_integer(F.col("x"))) == [(-12,), (None,)]


def test_labels(spark):
    rows = [("m[Oxidation]pepK",), ("[Acetyl]-PEPC[Carbamidomethyl]",), ("PEP[unknown]",), ("JX",), (None,), ("+42.011PEP",)]
    c = text.canonical_label(F.col("x"))
    got = of(spark, rows, "x string", c, text.residue_tokens(c), text.backbone(c))
    assert [x[0] for x in got] == ["M+15.995PEPK", "+42.011PEPC+57.021", None, None, None, "+42.011PEP"]
    assert got[0][1] == ["M+15.995", "P", "E", "P", "K"] and got[1][1] == ["+42.011", "P", "E", "P", "C+57.021"] and got[0][2] == "MPEPK"
    assert of(spark, [("AC+57B",)], "x string", text.split_residues(F.col("x"))) == [(["A", "C+57", "B"],)]
    mass = of(spark, [("GA",), ("+42.011GA",), ("GB",)], "x string", text.peptide_mass(text.residue_tokens(F.col("x"))))
    assert mass[0][0] == pytest.approx(57.021464 + 71.037114 + 18.010565) and mass[1][0] == pytest.approx(mass[0][0] + 42.011) and mass[2][0] is None


def test_ids_and_back(spark):
    vocabulary = ["A", "C", "$", "_"]
    ids = text.vocabulary_ids(text.residue_tokens(F.col("x")), ["A", "C"])
    assert of(spark, [("AC",), ("AG",)], "x string", ids, text.vocabulary_ids(text.residue_tokens(F.col("x")), ["A", "C"], 9)) == [([0, 1], [0, 1]), (None, [0, 9])]
    s = sorted(vocabulary)
    row = [s.index(t) for t in ("A", "_", "C", "$", "A")]
    assert of(spark, [(row,)], "x array<int>", text.from_ids(F.col("x"), vocabulary, s.index("_"), s.index("$"))) == [("AC",)]


def test_buckets_and_names(spark):
    got = of(spark, [(0,), (1,), (4,), (5,), (6,), (9,)], "z int", text.charge_bucket(F.col("z"), "1-4,5,7+"))
    assert [x[0] for x in got] == [None, "1-4", "1-4", "5", None, "7+"]
    assert of(spark, [(" a b/c%",)], "x string", text.metric_name(F.col("x")), text.occurrences(F.lit("aXbXX"), "X")) == [("a_b/c", 3)]


def test_peak_filters(spark):
    assert on_peaks(spark, [3001.0, 100, 700, 50], [2.0, 8, 9, 1], lambda p: peaks.to_range(peaks.strongest(peaks.windowed(p, 0, 3000), 2))) == [(100, 0), (700, 1)]
    got = on_peaks(spark, [10.0, 100, 2600, 700], [2.0, 4, 8, 1], lambda p: peaks.to_base_peak(peaks.windowed(p, 0, 2500)))
    assert [(a, round(b, 6)) for a, b in got] == [(10, 0.5), (100, 1.0), (700, 0.25)]
    got = on_peaks(spark, [40.0, 100, 200, 2600], [10.0, 4, 9, 100], lambda p: peaks.released_model_peaks(p, 50, 2500, 0, 200))
    assert got == [(pytest.approx(0.04), pytest.approx(2 / math.sqrt(13))), (pytest.approx(0.08), pytest.approx(3 / math.sqrt(13)))]
    assert on_peaks(spark, [20.0, 2600], [1.0, 1], lambda p: peaks.released_model_peaks(p, 50, 2500, 0, 200)) == [(0, 1)]
    assert math.isnan(on_peaks(spark, [1.0, 2], [3.0, 3], peaks.to_range)[0][1])
    assert on_peaks(spark, [1.0, 2, 3], [5.0, 9, 9], lambda p: peaks.strongest(p, 2, in_order=False)) == [(2, 9), (3, 9)]


def test_merging(spark):
    got = on_peaks(spark, [200.0, 100.0004, 100], [2.0, 3, 1], lambda p: peaks.merged(p, 5))
    assert got == [(pytest.approx(100.0003), 4), (200, 2)]
    chain = [100.0, 100.0009, 100.0018]  # each within 10 ppm of the one before, the last not of the centroid
    assert len(on_peaks(spark, chain, [1.0, 1, 1], lambda p: peaks.merged(p, 10))) == 1
    assert len(on_peaks(spark, chain, [1.0, 1, 1], lambda p: peaks.running_merge(p, 10))) == 2
    assert on_peaks(spark, [], [], lambda p: peaks.merged(p, 5)) == []


def test_bins_and_crops(spark):
    df = spark.createDataFrame([([0.5, 1.0, 1.5, 99.0], [1.0, 1.0, 4.0, 8.0])], "mz array<double>, i array<double>").select(peaks.zipped(F.col("mz"), F.col("i")).alias("p"))
    assert df.select(peaks.binned(F.col("p"), 4.0, 4)).first()[0] == [0.25, 0.5, 0.0, 1.0]
    for f in (peaks.uniform_subset, peaks.weighted_subset):
        got = df.select(f(F.col("p"), F.lit("k"), F.lit(2)).alias("p")).first().p
        assert len(got) == 2 and got[0].mz < got[1].mz
    assert len(df.select(peaks.random_window(F.col("p"), F.lit("k"), 0.5).alias("p")).first().p) == 2
    assert [r[0] for r in spark.createDataFrame([([1.0], [1.0]), ([1.0, 2.0], [1.0]), ([float("nan")], [1.0]), (None, None)], "m array<double>, i array<double>").select(peaks.valid(F.col("m"), F.col("i"))).collect()] == [True, False, False, False]


def test_purity(spark):
    df = spark.createDataFrame([([500.0, 500.5016774, 500.2, 900.0], [3.0, 1.0, 4.0, 9.0])], "mz array<double>, i array<double>")
    assert df.select(peaks.window_purity(peaks.zipped(F.col("mz"), F.col("i")), F.lit(500.0), F.lit(2), 2.0, 10)).first()[0] == pytest.approx(0.5)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [tuple(r) for r in df.select(vectors.cosine_distance(vectors.unit(F.col("a")), vectors.unit(F.col("b"))), vectors.euclidean_distance(F.col("a"), F.col("b"))).collect()] == [(1.0, math.sqrt(5)), (1.0, 1.0)]
    chance = spark.createDataFrame([(2, 10)], "p int, n int").select(vectors.random_hit_chance(F.col("p"), F.col("n"), 3)).first()[0]
    assert chance == pytest.approx(1 - (8 * 7 * 6) / (10 * 9 * 8))


def test_unimod_and_numeric_labels(spark):
    got = of(spark, [("_(UniMod:1)PEPC[UNIMOD:4]M(UniMod:35)_",), ("PEP(UniMod:999)",)], "x string", text.unimod_label(F.col("x")))
    assert got == [("+42.011PEPC+57.021M+15.995",), (None,)]
    assert of(spark, [("M[+15.995]K",), ("M(15.995)K",), ("B",)], "x string", text.numeric_label(F.col("x"))) == [("M+15.995K",), ("M+15.995K",), (None,)]
    assert of(spark, [(57.0213,), (57.03,)], "x double", text.snapped_delta(F.col("x"))) == [(57.021,), (57.03,)]


def test_vocabulary_tokens(spark):
    vocabulary = ["A", "L", "C", "C+57.021", "+42.011"]
    assert text.rounded_aliases(vocabulary) == {"C+57.02": "C+57.021", "C+57.0": "C+57.021", "C+57": "C+57.021", "+42.01": "+42.011", "+42.0": "+42.011", "+42": "+42.011"}
    t = text.vocabulary_tokens(F.col("x"), vocabulary, {"C+57.02": "C+57.021"}, leucine=True, reverse=True)
    assert of(spark, [("+42.011AIC+57.02",)], "x string", t, text.in_vocabulary(t, vocabulary)) == [(["+42.011", "C+57.021", "L", "A"], True)]


def test_names_of_runs(spark):
    assert of(spark, [("batch_a_07",), ("x",)], "x string", text.acquisition(F.col("x"))) == [("batch_a",), ("x",)]
    assert of(spark, [("HUMAN_1",)], "x string", text.species_of(F.col("x"), {"human": "H. sapiens"}), text.rate_suffix(F.lit("0.01"))) == [("H. sapiens", "0p01")]
    with pytest.raises(Exception, match="no species for"):
        of(spark, [("mouse",)], "x string", text.species_of(F.col("x"), {"human": "H. sapiens"}))
