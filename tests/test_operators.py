"""Operators against small brute-force versions and golden cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peakloom.operators import checks, dedup, joins, metrics, retrieval, sampling, sequences
from peakloom.plans import curation, evaluation, forms, queries  # noqa: F401  these register their queries
from peakloom.sources import spectra as files


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ppm_join_is_the_theta_join(spark):
    rng = random.Random(1)
    mz = [rng.uniform(100, 103) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(mz)), "id int, mz double")
    a, b = df.select(F.col("id").alias("a"), F.col("mz").alias("x")), df.select(F.col("id").alias("b"), F.col("mz").alias("y"))
    for ppm in (5, 100, 20_000):
        got = joins.ppm_join(a, b, F.col("x"), F.col("y"), ppm).select("a", "b")
        assert rows(got) == sorted((i, j) for i, x in enumerate(mz) for j, y in enumerate(mz) if abs(y - x) <= x * ppm / 1e6)


def test_distractors(spark):
    proton = 1.00727646688
    ions = [(500.0, 2), (500.003, 2), ((997.985 / 3) + proton, 3), (800.0, 2)]
    df = spark.createDataFrame([(j, *a, *b) for a in ions[:1] for j, b in enumerate(ions)], "j int, m double, z int, n double, y int")
    got = df.select("j", joins.distractor_ok((F.col("m"), F.col("z")), (F.col("n"), F.col("y")), 10).alias("ok")).filter("ok and j > 0")
    assert [r.j for r in got.collect()] == [3]


def test_caps_are_judged_in_order(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 2), rng.randint(0, 4), k) for k in range(400)]
    kept, total, by_run = [], defaultdict(int), defaultdict(int)
    for p, r, k in sorted(data, key=lambda x: (x[0], x[2])):
        if total[p] < 12 and by_run[p, r] < 4:
            kept.append((p, r, k))
            total[p] += 1
            by_run[p, r] += 1
    got = sampling.capped(spark.createDataFrame(data, "p int, r int, k int"), "p", "r", ["k"], 12, 4)
    assert rows(got) == sorted(kept)


def test_groups_until_target(spark):
    df = spark.createDataFrame([(g,) for g in "abc" for _ in range(4)], "g string")
    got = sampling.until_target(df, [], "g", 5, "s")
    assert got.count() == 2 and got.agg(F.sum("n")).first()[0] == 8


def test_balance(spark):
    df = spark.createDataFrame([(k, 0) for k in range(5)] + [(k, 1) for k in range(5, 8)], "id int, y int")
    got = [sampling.balanced(df, [], "y", "id", "s").collect() for _ in range(2)]
    assert sorted(got[0]) == sorted(got[1]) and sum(r.y for r in got[0]) == 3 and len(got[0]) == 6 and {5, 6, 7} <= {r.id for r in got[0]}


def test_length_holdout_takes_whole_runs(spark):
    df = spark.createDataFrame([(r, n) for r in range(20) for n in (5, 6, 7) for _ in range(r % 3)], "run int, n int")
    got = {r.run for r in sampling.length_holdout(df, "run", "n", 6, "s").collect()}
    held = [sum(r % 3 for r in got if r % 3) for _ in (5, 6, 7)]
    assert all(6 <= x < 6 + 2 for x in held)


def test_contiguous_shards(spark):
    got = sampling.contiguous_shards(spark.range(23), "id", 5).orderBy("id").collect()
    assert [r.shard for r in got] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_split_policy(spark):
    df = spark.createDataFrame([("a", "train", 1), ("a", "test", 2), ("b", "train", 3), ("b", "train", 4)], "seq string, split string, id int")
    assert rows(dedup.by_precedence(df, "seq").select("id")) == [(2,), (3,), (4,)]
    assert rows(dedup.in_one_split(df, "seq").select("id")) == [(3,), (4,)]
    assert rows(dedup.overlaps(df, "seq")) == [("test", "train", 1)]
    labelled = spark.createDataFrame([("k", "X", 1), ("k", "Y", 2), ("m", "X", 3), ("m", "X", 4)], "key string, label string, id int")
    assert rows(dedup.without_conflicts(labelled, "key", "label", ["id"]).select("id")) == [(3,)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "k string, v double, load int")
    new = spark.createDataFrame([("b", 3.0, 2), ("c", 4.0, 2)], "k string, v double, load int")
    once = dedup.upsert(old, new, ["k"], "load")
    assert rows(once) == rows(dedup.upsert(once, new, ["k"], "load")) == [("a", 1.0, 1), ("b", 3.0, 2), ("c", 4.0, 2)]


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="k must be unique: 1 rows"):
        checks.assert_unique(df, "k")
    checks.assert_unique(df.distinct(), "k")
    assert rows(checks.coverage(spark.range(3), spark.range(1, 4), "id")) == [(0, "missing"), (3, "extra")]


@pytest.mark.parametrize("labels,auc,ap,fnr,threshold", [((1, 1, 0, 0), 1, 1, 0, 0.2), ((1, 0, 1, 0), 0.75, (1 + 2 / 3) / 2, 0.5, 0.1)])
def test_pair_metrics(spark, labels, auc, ap, fnr, threshold):
    df = spark.createDataFrame([(d, y, -d) for d, y in zip((0.1, 0.2, 0.8, 0.9), labels)], "distance double, label int, score double")
    assert metrics.roc_auc(df, [], "score", "label").first().auroc == pytest.approx(auc)
    assert metrics.average_precision(df, [], "score", "label").first().average_precision == pytest.approx(ap)
    r = metrics.operating_points(df, [], "distance", "label", [0.01]).first()
    assert (r.fnr, r.threshold) == (pytest.approx(fnr), pytest.approx(threshold))


def test_running_sums_cross_buckets(spark):
    rng = random.Random(5)
    data = [("g", rng.randint(0, 60) / 7, rng.randint(0, 1)) for _ in range(2000)]
    got = {r.s: (r.cum_a, r.cum_n) for r in metrics.cumulative(spark.createDataFrame(data, "g string, s double, y int"), ["g"], "s", {"a": F.col("y").cast("long"), "n": F.lit(1).cast("long")}, descending=True, buckets=16).collect()}
    assert got == {s: (sum(y for _, x, y in data if x >= s), sum(x >= s for _, x, _ in data)) for s in {x for _, x, _ in data}}


def test_curves(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 0), (3, 0.5, 1), (4, None, 0)], "id int, score double, ok int")
    tie = metrics.auc_tie_anchored(df, [], "score", "ok").first()[0]
    assert tie == pytest.approx((0.25 * 1 + 0.5 * (1 + 2 / 3) / 2 + 0.25 * (2 / 3 + 0.5) / 2))
    row = metrics.auc_rowwise(df, [], "score", "id", "ok").first()[0]
    assert row == pytest.approx(0.25 * ((1 + 0.5) / 2 + (0.5 + 2 / 3) / 2 + (2 / 3 + 0.5) / 2))


def test_retrieval_golden(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.99, 0.01], "a"), (2, [0.0, 1.0], "b"), (3, [0.01, 0.99], "b")], "id int, v array<double>, g string")
    for block in (256, 1):
        near = retrieval.distances(retrieval.queries_of(df, "g", "id", "0"), df, "id", "g", "v", block=block)
        got = retrieval.ranked_metrics(near, ks=(1,)).collect()
        assert len(got) == 2 and all((r.ap, r.rr, r.hit_at_1) == (1, 1, 1) for r in got)
    votes = retrieval.knn_labels(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), "id", "g", "v", 1).collect()
    assert all(r.label == r.predicted for r in votes)
    c = {r.group: r for r in retrieval.compactness(df, "id", "g", "v").collect()}
    assert c["a"].within < 0.001 and c["a"].n == 2


def test_mass_controlled_retrieval(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "p", 500.0, 2), (1, [1.0, 0.1], "p", 500.001, 2), (2, [0.9, 0.1], "q", 500.002, 2), (3, [1.0, 0.0], "p", 700.0, 2)], "id int, v array<double>, g string, mz double, z int")
    near = retrieval.distances(df.filter("id = 0"), df, "id", "g", "v", ppm=10, mz="mz", charge="z")
    assert rows(near.select("id")) == [(1,), (2,)]


def test_singular_values(spark):
    got = retrieval.spectrum_metrics(spark.createDataFrame([([3.0, 0.0],), ([0.0, 4.0],)], "v array<double>"), "v")
    assert got["stable_rank"] == pytest.approx(25 / 16) and got["condition"] == pytest.approx(4 / 3) and got["self_cluster"] == pytest.approx(81 + 256)


def test_sequence_matching(spark):
    assert sequences.matched(list("PEPTIDE"), list("PEPTIDE"), "best") == ([True] * 7, True)
    assert sequences.matched(list("PEPTIDE"), list("EPPTIDE"), "forward")[0] == [False, False, True, True, True, True, True]
    assert sequences.matched(list("AGK"), list("GAK"), "best") == ([False, False, True], False)
    assert sequences.matched(["N", "K"], ["G", "G", "K"], "best")[0] == [False, False, True]
    df = spark.createDataFrame([(["A", "G"], ["A", "G"]), (["A"], None), (None, None)], "t array<string>, p array<string>").withColumn("m", sequences.match(F.col("t"), F.col("p")))
    r = sequences.sequence_scores(df, [], "m").first()
    assert (r.n, round(r.aa_precision, 6), round(r.aa_recall, 6), round(r.peptide_precision, 6)) == (3, 1.0, round(2 / 3, 6), round(2 / 3, 6))


def test_precursor_fit(spark):
    mass = 1000.0
    mz = mass / 2 + 1.00727646688
    df = spark.createDataFrame([(mz,), (mz + 1.00335 / 2,), (mz + 0.1,)], "mz double")
    assert [r[0] for r in df.select(sequences.fits_precursor(F.col("mz"), F.lit(mass), F.lit(2), 20)).collect()] == [True, True, False]
    s = df.limit(1).select(sequences.peptide_score(F.array(F.lit(0.5), F.lit(1.0)), F.lit(False)).alias("s")).first().s
    assert s.score == pytest.approx(-0.25) and s.token_scores == [pytest.approx(0.125), pytest.approx(0.375)]


def test_mgf_problems(spark, tmp_path):
    good = "BEGIN IONS\nTITLE=a=b\nPEPMASS=5.5\n100 1\n200.5\t2\nEND IONS\n"
    nested = "BEGIN IONS\nTITLE=x\nBEGIN IONS\nTITLE=y\n1 1\nEND IONS\n"
    (tmp_path / "a.mgf").write_text(good + nested + "BEGIN IONS\nTITLE=z\nEND IONS\n" + "BEGIN IONS\nTITLE=w\n1 q\nEND IONS\n")
    got = files.read_mgf(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.problem for r in got] == [None, "nested", "no peaks", "bad peak"] and [r.ordinal for r in got] == [0, 1, 2, 3]
    assert got[0].headers["TITLE"] == "a=b" and got[0].mz_array == [100, 200.5] and got[0].intensity_array == [1, 2]


def test_mzml(spark, tmp_path):
    import base64
    import struct
    import zlib

    mz, i = base64.b64encode(struct.pack("<3d", 1.5, 2.5, 3.5)).decode(), base64.b64encode(zlib.compress(struct.pack("<3f", 7, 8, 9))).decode()
    param = lambda name, value="": f'<cvParam name="{name}" value="{value}"/>'
    array = lambda kind, bits, packed, text: f'<binaryDataArray>{param(kind)}{param(bits)}{param(packed)}<binary>{text}</binary></binaryDataArray>'
    ion = f'<precursorList><precursor><selectedIonList><selectedIon>{param("selected ion m/z", 500.25)}{param("charge state", 2)}</selectedIon></selectedIonList></precursor></precursorList>'
    arrays = f'<binaryDataArrayList>{array("m/z array", "64-bit float", "no compression", mz)}{array("intensity array", "32-bit float", "zlib compression", i)}</binaryDataArrayList>'
    (tmp_path / "r.mzML").write_text(f'<mzML><run><spectrumList><spectrum id="scan=4" index="0" defaultArrayLength="3">{param("ms level", 2)}{param("base peak", 1)}{ion}{arrays}</spectrum></spectrumList></run></mzML>')
    r = files.mzml_peaks(files.read_mzml(spark, str(tmp_path))).first()
    assert (r.scan, r.ms_level, r.precursor_mz, r.precursor_charge, r.mz_array, r.intensity_array) == (4, 2, 500.25, 2, [1.5, 2.5, 3.5], [7, 8, 9])


def test_best_psms(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("file\tscan\tscore\tpeptide\tq\na\tscan=1\t5\tPEP\t0.001\na\tscan=1\t9\tTIDE\t0.5\na\tscan=2\t1\tX\t0\n")
    got = files.read_best_psms(spark, str(tmp_path), file="file", scan="scan", score="score", peptide="peptide", most_q=0.01, q="q")
    assert rows(got) == [("a", 1, "PEP", 5.0), ("a", 2, "X", 1.0)]


@pytest.fixture(scope="module")
def duck(data):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def shown(v):
    import pandas as pd

    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (list, dict)):
        return str(v)
    if pd.isna(v):
        return None
    # pandas turns whole numbers with nulls among them into floats.
    return round(float(v), 3) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, data, duck, name):
    """A query and its SQL, on the smallest tables; one without SQL must run."""
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        expected = duck.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        table = lambda t: sorted(str(tuple(map(shown, r))) for r in t[sorted(t.columns)].itertuples(index=False))
        assert table(got) == table(expected)


def test_source_selection(spark):
    from peakloom.operators.counterfactual import jensen_shannon, source_selection

    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [2.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>, ma array<double>, mb array<double>")
    r = source_selection(df, [], "cosine", "a", "b", "ma", "mb").first()
    assert (r.condition_distance, r.accuracy, r.paired_accuracy) == (1, 1, 1)
    assert source_selection(df, [], "euclidean", "a", "b", "ma", "mb").first().condition_distance > 2
    p = spark.createDataFrame([([0.99, 0.01], [0.01, 0.99], [0.9, 0.1], [0.1, 0.9])], "a array<double>, b array<double>, ma array<double>, mb array<double>")
    r = source_selection(p, [], "jensen_shannon", "a", "b", "ma", "mb").first()
    assert r.paired_accuracy == 1 and r.condition_distance > 0
    assert p.select(jensen_shannon(F.col("a"), F.col("a"))).first()[0] == pytest.approx(0)


def test_dense_source_selection(spark):
    from peakloom.operators.counterfactual import dense_source_selection

    one, two = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, [one, one], [two, two], [one, one], [0, 1])], "id int, a array<array<double>>, b array<array<double>>, m array<array<double>>, s array<int>")
    assert dense_source_selection(df, "id", "a", "b", "m", "s").first().accuracy == 0.5


def test_soft_ordinal(spark):
    from peakloom.functions import ordinal

    df = spark.createDataFrame([(-3.0,), (0.3,), (0.77,), (7.0,)], "x double").select("x", ordinal.soft_labels(F.col("x"), 0.0, 1.0, 64, 0.024).alias("w"))
    got = df.select("x", F.aggregate("w", F.lit(0.0), lambda a, v: a + v).alias("s"), ordinal.expectation(F.col("w"), 0.0, 1.0, 64).alias("e"), ordinal.mode(F.col("w"), 0.0, 1.0, 64).alias("m"), ordinal.cross_entropy(F.col("w"), F.transform("w", lambda v: F.log(v + 1e-30))).alias("c")).collect()
    assert all(r.s == pytest.approx(1) for r in got)
    assert all(abs(r.e - r.x) < 1 / 64 and abs(r.m - r.x) < 1 / 64 for r in got[1:3]) and all(r.c > 0 for r in got)


def test_isotonic_fit():
    import itertools

    import numpy as np

    from peakloom.operators.alignment import isotonic

    rng = np.random.default_rng(0)
    for _ in range(20):
        y = rng.normal(size=6)
        fit = isotonic(np.arange(6), y)
        by_formula = [max(min(y[a : b + 1].mean() for b in range(i, 6)) for a in range(i + 1)) for i in range(6)]
        assert np.allclose(fit, by_formula)
    assert list(itertools.chain(isotonic(np.arange(0), np.array([])))) == []


def test_runs_are_aligned(spark):
    from peakloom.operators.alignment import aligned

    data = [("a", k, float(k)) for k in range(60)] + [("b", k, float(k)) for k in range(60)] + [("c", k, 2.0 * k + 5) for k in range(60)] + [("d", 0, 3.0)]
    got = aligned(spark.createDataFrame(data, "run string, key int, v double"), "run", "key", "v").collect()
    assert all(r.aligned == pytest.approx(r.key) for r in got if r.run in "abc") and [r.aligned for r in got if r.run == "d"] == [3.0]


def test_partners(spark):
    from peakloom.operators.partners import matched_partners

    df = spark.createDataFrame([("A", 500.0, 2), ("B", 500.004, 2), ("C", 650.0, 2), ("D", 900.0, 3)], "y string, mz double, z int")
    got = {r.y: (r.partner_id, r.tier) for r in matched_partners(df.withColumn("label", F.col("y")), row_id="y", mz="mz", charge="z", label="label", tolerances=[10], seed="s").collect()}
    assert got["A"] == ("B", 0) and got["B"] == ("A", 0) and got["C"][1] == 1 and got["D"][1] == 2


def test_corpus_build(spark, data):
    from peakloom.plans import pipelines

    got = queries.corpus_build(spark, data)
    assert got.count() == got.select("digest").distinct().count() > 0
    docs = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    judged = pipelines.judged(docs, {"toxic": "toxic = 1"})
    assert sum(r.n for r in pipelines.reject_counts(judged).collect()) == docs.count()


def test_pair_benchmark_is_balanced(spark, data):
    from peakloom.plans import pipelines

    pairs = queries.pair_benchmark(spark, data).cache()
    n = {(r.partition, r.pair_set): (r.a, r.b) for r in pairs.groupBy("partition", "pair_set").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).collect()}
    assert n and all(a == b for a, b in n.values())
    rows_ = queries.precursors(spark, data)
    few, kept = pipelines.charge_filtered(rows_, pairs, "spectrum_id", F.col("charge") == 2, ["partition", "pair_set"], "s")
    assert {r.charge for r in few.select("charge").distinct().collect()} <= {2}
    hard = pairs.filter("label = 0 and pair_set = 'hard'").agg(F.max("ppm")).first()[0]
    assert hard is None or hard < 501


def test_clean_splits(spark):
    from peakloom.plans.pipelines import clean_splits

    df = spark.createDataFrame([("a", "test", "f1", 1), ("a", "train", "f2", 2), ("b", "train", "f1", 3), ("c", "train", "f3", 4)], "key string, split string, fp string, id int")
    assert rows(clean_splits(df, "key", "fp", ["id"]).select("id")) == [(1,), (4,)]


def test_stream_appends_once(spark, data, tmp_path):
    from peakloom.streaming.events import append_new, first_only, sessions, stream

    source, out = tmp_path / "in", str(tmp_path / "out")
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(200).cache()
    events.write.parquet(str(source))
    for k in range(2):
        append_new(stream(spark, str(source), events), ["event_id"], out, str(tmp_path / f"state{k}")).awaitTermination()
        assert spark.read.parquet(out).count() == 200
    live = stream(spark, str(source), events)
    assert first_only(live, "ts", ["event_id"], "1 hour").isStreaming and sessions(live, "ts", "user_id", "5 minutes", "1 hour").isStreaming


def test_contrastive_loss(spark):
    import math

    df = spark.createDataFrame([(0, 0, "A", [1.0, 0.0]), (0, 1, "A", [1.0, 0.0]), (0, 2, "B", [0.0, 1.0])], "b int, i int, y string, v array<double>")
    r = metrics.contrastive_loss(df, "b", "i", "y", "v", 1.0).first()
    assert r.loss == pytest.approx(-math.log(math.e / (math.e + 1))) and (r.n, r.n_valid) == (3, 2)


def test_permutation_keeps_each_stratum(spark):
    from peakloom.operators.interventions import permuted, shuffled_intensities, without_precursor

    df = spark.createDataFrame([(k, k % 3, float(k * k)) for k in range(90)] + [(90, 9, None)], "id int, z int, v double")
    got = permuted(df, ["z"], "id", "v", "s", batch=10).collect()
    for z in (0, 1, 2, 9):
        assert sorted((r.v or 0) for r in got if r.z == z) == sorted((r.permuted or 0) for r in got if r.z == z)
    assert sum(r.v != r.permuted for r in got) > 80
    assert without_precursor(df, "v", "z").filter("v <> 0 or z <> 0").count() == 0
    p = spark.createDataFrame([([(1.0, 5.0), (2.0, 6.0), (3.0, 7.0)],)], "p array<struct<mz:double,intensity:double>>").select(shuffled_intensities(F.col("p"), F.lit("k")).alias("p")).first().p
    assert [x.mz for x in p] == [1, 2, 3] and sorted(x.intensity for x in p) == [5, 6, 7]


def test_prediction_files(spark, tmp_path):
    from peakloom.sources import predictions as files_

    rows_ = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c")], "canonical_index long, title string")
    full = rows_.select("canonical_index", *(F.lit(None).cast(t).alias(c) for c, t in (x.strip().rsplit(" ", 1) for x in files_.SCHEMA.split(",")) if c not in ("canonical_index", "title")), "title").select(*[x.strip().split(" ")[0] for x in files_.SCHEMA.split(",")])
    assert rows(files_.write_predictions(full, str(tmp_path / "a"), 2).select("canonical_index", "title")) == [(0, "a"), (1, "c")]
    assert files_.read_predictions(spark, str(tmp_path / "a"), 2).count() == 2
    with pytest.raises(ValueError, match="every index"):
        files_.write_predictions(full, str(tmp_path / "b"), 3)
    with pytest.raises(ValueError, match="0 to 0"):
        files_.read_predictions(spark, str(tmp_path / "a"), 1)
    index = spark.createDataFrame([(0, 0, 5), (1, 0, 6)], "shard int, local int, canonical int")
    assert files_.stitched(index.select("shard", "local"), index, "shard", "local", "canonical").count() == 2
    with pytest.raises(ValueError, match="must be in the index"):
        files_.stitched(spark.createDataFrame([(3, 3)], "shard int, local int"), index, "shard", "local", "canonical")


def test_mztab_is_scored(spark, tmp_path):
    """Three rows, one without a prediction: precision one third, one null, a curve of area between 0 and 1."""
    from peakloom.sources.predictions import validate_psms

    psms = spark.createDataFrame([(1, "AG", 0.9), (2, "A", 0.5), (3, None, None)], "PSM_ID int, sequence string, `search_engine_score[1]` double")
    files.write_mztab(psms, str(tmp_path / "t"), "test")
    got = validate_psms(files.read_mztab(spark, str(tmp_path / "t")).withColumn("file", F.lit("t")), "search_engine_score[1]")
    judged = got.withColumn("ok", (F.col("sequence") == "AG").cast("int")).fillna(0, ["ok"])
    assert judged.agg(F.avg("ok")).first()[0] == pytest.approx(1 / 3) and judged.filter("score is null").count() == 1
    assert 0 < metrics.auc_tie_anchored(judged, [], "score", "ok").first()[0] < 1
    assert metrics.precision_coverage(judged, [], "score", "ok").count() == 3
    bad = spark.createDataFrame([("f", {"PSM_ID": "1", "sequence": "A", "s": "x", "spectra_ref": ""})], "file string, psm map<string,string>")
    with pytest.raises(ValueError, match="scores must be"):
        validate_psms(bad, "s")


def test_mzid(spark, tmp_path):
    import gzip

    item = lambda rank, ok: f'<SpectrumIdentificationItem rank="{rank}" passThreshold="{ok}" peptide_ref="p{rank}" chargeState="2" experimentalMassToCharge="500.5"/>'
    text_ = f'<a><SpectrumIdentificationResult spectrumID="scan=1">{item(1, "true")}{item(2, "true")}</SpectrumIdentificationResult><SpectrumIdentificationResult spectrumID="scan=2">{item(1, "false")}{item(2, "true")}</SpectrumIdentificationResult></a>'
    (tmp_path / "r.mzid.gz").write_bytes(gzip.compress(text_.encode()))
    from peakloom.sources.predictions import read_mzid

    assert rows(read_mzid(spark, str(tmp_path))) == [("scan=1", "p1", 2, 500.5)]


def test_publish(spark, tmp_path):
    from peakloom.sources.predictions import publish

    path = str(tmp_path / "out")
    publish(spark.range(3), path, lambda df: None)
    with pytest.raises(FileExistsError):
        publish(spark.range(4), path, lambda df: None)
    with pytest.raises(ValueError):
        publish(spark.range(4), path, lambda df: checks.assert_empty(df, "never"), overwrite=True)
    assert spark.read.parquet(path).count() == 3
    publish(spark.range(4), path, lambda df: None, overwrite=True)
    assert spark.read.parquet(path).count() == 4 and spark.read.parquet(f"{path}.backup").count() == 3


def test_files_and_arrays(spark, tmp_path):
    (tmp_path / "x").write_text("abc")
    r = files.tree_digest(spark, str(tmp_path)).first()
    assert r.length == 3 and r.sha256.startswith("ba7816bf")
    values, sizes = files.flat_arrays(spark.createDataFrame([(1, [5, 6]), (2, [])], "id int, a array<int>"), "id", "a")
    assert rows(values) == [(1, 0, 5), (1, 1, 6)] and rows(sizes) == [(1, 2), (2, 0)]


def test_tables(spark, tmp_path):
    import numpy as np

    from peakloom.sources import tables

    df = spark.createDataFrame([(0, "a", None), (1, "b", "x")], "n int, k string, s string")
    df.write.parquet(str(tmp_path / "t"))
    assert tables.scan(spark, str(tmp_path / "t"), ["n", "missing", "k"], ["n"], {"k": "key"}).columns == ["n", "key"]
    with pytest.raises(ValueError, match="lacks"):
        tables.scan(spark, str(tmp_path / "t"), ["n"], ["other"])
    assert rows(tables.rows_by_number(df, df.filter("n = 1"), "n", "k").select("n")) == [(1,)]
    with pytest.raises(ValueError, match="k must agree"):
        tables.rows_by_number(df, spark.createDataFrame([(1, "z")], "n int, k string"), "n", "k")
    assert rows(tables.without_rows(df, df.filter("n = 0"), ["s"]).select("n")) == [(1,)]
    assert rows(tables.without_present(spark.createDataFrame([("/x/a.gz",), ("/y/b.gz",)], "p string"), spark.createDataFrame([("/z/b.gz",)], "p string"), "p")) == [("/x/a.gz",)]
    np.savez(tmp_path / "v.npz", v=np.eye(2), i=np.array([5, 6]))
    assert [(r.row, r.id, r.vector) for r in tables.read_arrays(spark, str(tmp_path / "v.npz"), "v", "i").orderBy("row").collect()] == [(0, "5", [1, 0]), (1, "6", [0, 1])]
    (tmp_path / "m.json").write_text('{"a": 1,\n "b": [2]}')
    assert tables.read_manifest(spark, str(tmp_path / "m.json")).first().a == 1


def test_first_within_ppm_against_brute_force(spark, monkeypatch):
    """A bucket of many lists, values on both sides of bucket edges, rows without a value, charge or label."""
    import hashlib
    import random

    from peakloom.operators import joins

    monkeypatch.setattr(joins, "LISTED", 7)
    rng = random.Random(4)
    data = [(k, 500.0 if k < 60 else 500 + rng.random() * 0.5, rng.choice([2, 3]), rng.choice("abc")) for k in range(200)]
    data += [(900, None, 2, "a"), (901, 500.0, None, "a"), (902, 500.0, 2, None), (903, -500.0, 2, "b"), (904, 0.0, 2, "b")]
    rank = lambda a, b: (hashlib.sha256("\x1f".join(["s", "pair", str(a), str(b)]).encode()).hexdigest(), b)
    want = {}
    for i, m, z, y in data:
        if m and m > 0 and z and y:
            near = [j for j, n, w, x in data if n and n > 0 and w == z and x and x != y and abs(n - m) <= m * 100 / 1e6]
            if near:
                want[i] = (z, min(near, key=lambda j: rank(i, j)))  # noqa: B023
    df = spark.createDataFrame(data, "id long, mz double, z int, y string")
    find = lambda **more: {r.id: (r.z, r.partner_id) for r in joins.ppm_first(df, row_id="id", mz="mz", label="y", on=["z"], ppm=100, seed="s", **more).collect()}
    assert find() == want and len(want) > 100
    assert find(among=df.filter("id % 3 = 0")) == {k: v for k, v in want.items() if k % 3 == 0}


def test_place_among_edges(spark):
    """Counts of lower edges, by lists and array columns, with and without equal ones; null lies below all, NaN above."""
    from peakloom.operators.sampling import place

    values = [None, -1.0, 0.0, 0.5, 1.0, 6.0, 7.0, 99.0, float("nan")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v double")
    for n in (0, 1, 2, 3, 7, 8, 64, 100):
        edges = [float(k) for k in range(n)]
        at = F.array(*map(F.lit, edges)).cast("array<double>")
        got = df.select("v", place(edges, F.col("v")), place(at, F.col("v")), place(at, F.col("v"), equal=True)).collect()
        for v, a, b, c in got:
            low = 0 if v is None else n if v != v else sum(e < v for e in edges)
            assert a == b == low and c == (0 if v is None else n if v != v else sum(e <= v for e in edges))


def test_strides_and_wide_vectors(spark):
    """Strides against brute force, up to the product of the first nine primes; vectors of 3,000 components."""
    from math import gcd

    from peakloom.functions.vectors import unit
    from peakloom.operators.counterfactual import coprime_stride

    sizes = [*range(0, 120), 2 * 3 * 5 * 7 * 11 * 13 * 17 * 19 * 23, 2**62, 2**63 - 2]
    df = spark.createDataFrame([(n, s) for n in sizes for s in (0, 1, 5, 1023)], "n long, s long")
    for n, s, got in df.select("n", "s", coprime_stride(F.col("n"), F.col("s"))).collect():
        assert got == (1 if n < 2 else next(k for k in ((s % (n - 1) + j) % (n - 1) + 1 for j in range(n)) if gcd(k, n) == 1)), (n, s)
    wide = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: (x * 4).cast("float")).alias("v"))
    norm = sum((4.0 * x) ** 2 for x in range(1, 3001)) ** 0.5
    assert all(abs(r.u[2999] - 12000 / norm) < 1e-12 for r in wide.select(unit(F.col("v")).alias("u")).collect())
    assert [r.u for r in spark.createDataFrame([(None,), ([],), ([0.0],)], "v array<double>").select(unit(F.col("v")).alias("u")).collect()] == [None, [], [0.0]]


def test_medians_round_as_in_sql(spark):
    """Bit for bit: where medians order rows, one that rounds otherwise changes the order of what ties."""
    import duckdb

    from peakloom.operators.metrics import quantiles

    pairs = [(k, x) for k in range(400) for x in ((100_000 + 37 * k) / 100, (900_001 - 37 * k) / 100)]
    got = {(r.k, r.m) for r in quantiles(spark.createDataFrame(pairs, "k int, v double"), ["k"], "v", {"m": 0.5}).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k INT, v DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    assert got == set(db.execute("SELECT k, median(v) FROM t GROUP BY k").fetchall())


def test_lists_side_by_side_match_as_one_by_one():
    """All lists of a batch at once, against a plain walk through each."""
    import random

    import numpy as np

    from peakloom.operators import sequences

    def walk(a, b):
        i, j, out, at, bt = 0, 0, [], np.cumsum(a), np.cumsum(b)
        while i < len(a) and j < len(b):
            if abs(at[i] - bt[j]) < 0.5:
                out += [(i, j)] if abs(a[i] - b[j]) < 0.1 else []
                i, j = i + 1, j + 1
            elif at[i] < bt[j]:
                i += 1
            else:
                j += 1
        return out

    def best(a, b):
        ahead = walk(a, b)
        i = next((k for k in range(len(a)) if k not in {x for x, _ in ahead}), len(a))
        j = next((k for k in range(len(b)) if k not in {y for _, y in ahead}), len(b))
        return [k < j for k in range(j)] + [len(b) - 1 - k in {y for _, y in walk(a[i:][::-1], b[j:][::-1])} for k in range(j, len(b))]

    rng = random.Random(5)
    make = lambda: [rng.choice([57.02, 71.04, 87.03, 114.04, 128.06, 128.09]) for _ in range(rng.randrange(9))]
    left, right = [make() for _ in range(400)], [make() for _ in range(400)]
    right[::3] = left[::3]
    flat = lambda x: np.array([v for y in x for v in y])
    n, m = np.array([*map(len, left)]), np.array([*map(len, right)])
    fits, whole = sequences.matched_lists(flat(left), n, flat(right), m, "best")
    want = [best(a, b) for a, b in zip(left, right)]
    assert fits.tolist() == [x for w in want for x in w] and 0 < sum(fits) < len(fits)
    assert whole.tolist() == [len(a) == len(b) and all(w) for a, b, w in zip(left, right, want)]


@pytest.mark.parametrize("on", [["z"], []])
def test_first_within_wide_tolerances(spark, monkeypatch, on):
    """Brute force at 30 % of the value, where windows are not as wide above as below; parts of few pairs, odd values."""
    import hashlib

    from peakloom.operators import joins

    monkeypatch.setattr(joins, "LISTED", 40)
    monkeypatch.setattr(joins, "AT_ONCE", 50, raising=False)
    rng = random.Random(5)
    data = [(f"r{k}", round(10 * 1.6 ** rng.random(), 3 if k % 2 else 1), rng.choice([2, 3]), rng.choice([1, 2, 3])) for k in range(300)]
    odd = [("i", float("inf"), 2, 1), ("n", float("nan"), 2, 2), ("m", -10.0, 2, 3), ("0", 0.0, 2, 1), ("far", 1e9, 2, 1), ("none", None, 2, 1)]
    df = spark.createDataFrame(data + odd, "id string, mz double, z int, y int")
    got = {r.id: r.partner_id for r in joins.ppm_first(df, row_id="id", mz="mz", label="y", on=on, ppm=300_000, seed="w").collect()}
    rank = lambda a, b: hashlib.sha256("\x1f".join(["w", "pair", a, b]).encode()).hexdigest()
    near = {i: [j for j, n, w, x in data if x != y and (w == z or not on) and abs(n - m) <= m * 300_000 / 1e6] for i, m, z, y in data}
    assert got == {i: min(js, key=lambda j: rank(i, j)) for i, js in near.items() if js} and len(got) == 300  # noqa: B023
    for ppm in (-1, 1e6):
        with pytest.raises(ValueError):
            joins.ppm_first(df, row_id="id", mz="mz", label="y", on=on, ppm=ppm, seed="w")


def test_pair_benchmark_finds_neighbours_once(spark, data):
    """Balancing reads its pairs more than once: what is found is read there, not found again."""
    plan = queries.pair_benchmark(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan and "MapInArrow" not in plan and "row_number" in plan


def test_partners_stop_when_all_have_one(spark, monkeypatch):
    """No circle of all rows is made for nobody; a row that is left still finds its partner there."""
    from peakloom.operators import partners

    made = []
    monkeypatch.setattr(partners, "negatives", lambda rows, group, *more: made.append(list(group)) or find(rows, group, *more))
    from peakloom.operators.circle import negatives as find

    data = [("A", 500.0, 2), ("B", 500.004, 2), ("C", 600.0, 3), ("D", 600.004, 3)]
    pairs = lambda rows, tolerances=(10, 100): {r.y: (r.partner_id, r.tier) for r in partners.matched_partners(spark.createDataFrame(rows, "y string, mz double, z int").withColumn("label", F.col("y")), row_id="y", mz="mz", charge="z", label="label", tolerances=list(tolerances), seed="s").collect()}
    whole = {"A": ("B", 0), "B": ("A", 0), "C": ("D", 0), "D": ("C", 0)}
    assert pairs(data) == whole and made == []
    got = pairs([*data, ("E", 700.0, 3)])
    assert got.pop("E") in {("C", 2), ("D", 2)} and got == whole and made == [["z"]]
    got = pairs([*data, ("F", 700.0, 4)])
    assert got.pop("F")[1] == 3 and got == whole and made == [["z"], ["z"], []]
    assert len(pairs(data, ())) == 4


def test_partner_diagnostics_join_once(spark, data):
    plan = queries.partner_diagnostics(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "partner_id" not in plan and "_off" in plan
