"""Circles, pairs, quantiles, digests, mixtures, files and runs against brute force and golden cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import digests, peaks, text
from peakloom.operators import circle, counterfactual, joins, metrics, retrieval, sampling
from peakloom.operators.alignment import aligned
from peakloom.sources import spectra as files


def sha(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("cut", [4, 4096])
def test_circle_by_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(circle, "CUT", cut)
    rng = random.Random(4)
    data = [(g, k, rng.choices("abc", (90, 5, 5))[0]) for g in "xyz" for k in range({"x": 60, "y": 9, "z": 1}[g])] + [("w", k, "a") for k in range(20)]
    got = {(r.g, r.id): (r.pos, r.next_id) for r in circle.circle(spark.createDataFrame(data, "g string, k int, y string"), ["g"], "k", "y", "s").collect()}
    starts = {(r.g, r.k): r.negative_id for r in circle.negatives(spark.createDataFrame(data, "g string, k int, y string"), ["g"], "k", "y", "n").collect()}
    for g in "xyzw":
        for seed, check in (("s", "next"), ("n circle", "negative")):
            ring = sorted(((k, y) for gg, k, y in data if gg == g), key=lambda t: (sha(seed, t[0]), t[0]))
            for at, (k, y) in enumerate(ring):
                if check == "next":
                    found = next((i for i, z in (*ring[at + 1 :], *ring[: at + 1]) if z != y), None)
                    assert got[g, k] == (at, found)
                else:
                    p = int(sha("n start", k)[:8], 16) % len(ring)
                    assert starts.get((g, k)) == next((i for i, z in (*ring[p:], *ring[:p]) if z != y), None)


def test_pairs_of_small_and_large_groups(spark):
    """All pairs at any size; a draw of them by the same rule for every size, each pair as likely as any other."""
    sizes = {"one": 1, "s": 6, "l": 300, "b": 520}
    df = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)], "g string, k int")
    every = joins.pairs_in_groups(df, ["g"], "k", "p").collect()
    for g, n in sizes.items():
        assert sorted((r.left_id, r.right_id) for r in every if r.g == g) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    for most in (1, 4, 15, 1000):
        few = joins.pairs_in_groups(df, ["g"], "k", "p", most=most).collect()
        for g, n in sizes.items():
            total, got = n * (n - 1) // 2, [(r.left_id, r.right_id) for r in few if r.g == g]
            assert len(got) == len(set(got)) == min(most, total) and all(a < b for a, b in got)
            order = sorted(range(n), key=lambda k: (sha("p", "row", k), k))
            pairs = [(i, j) for j in range(n) for i in range(j)]
            u = int(sha("p", "pairs", g)[:8], 16) / 2**32
            want = [pairs[k if total <= most else int((k + u) * total / most)] for k in range(min(most, total))]
            assert sorted(got) == sorted(tuple(sorted((order[i], order[j]))) for i, j in want)


def test_ends_of_pairs_are_checked(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    of = lambda a, b: joins.endpoints(spark.createDataFrame([(a, b)], "left_id int, right_id int"), rows, "k", ["v"]).collect()
    assert [tuple(r.asDict().values()) for r in of(1, 2)] == [tuple({"right_id": 2, "left_id": 1, "left_v": "a", "right_v": "b"}.values())]
    for pair, what in (((1, 3), "no row has the id 3"), ((2, 2), "a pair of one row")):
        with pytest.raises(Exception, match=what):
            of(*pair)


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    data = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 501)) for x in rng.integers(0, 40, n)] + [("c", None)]
    got = {r.g: r for r in metrics.quantiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x", {"q5": 0.05, "m": 0.5, "top": 1.0}).collect()}
    for g in "abc":
        x = [v for k, v in data if k == g and v is not None]
        assert [got[g].q5, got[g].m, got[g].top] == pytest.approx(list(np.percentile(x, [5, 50, 100])))


def test_digests(spark):
    df = spark.createDataFrame([("run", 5, None), (" a ", 7, "nan")], "r string, k int, n string")
    got = df.select(digests.priority63("s", F.col("r"), F.col("k"), F.col("n")), digests.rank128("3", F.col("r"), F.col("k")), digests.key64("3", F.col("k"))).collect()
    for (r, k), row in zip((("run", 5), (" a ", 7)), got):
        b = lambda t, n: hashlib.blake2b(t.encode(), digest_size=n).digest()
        assert row[0] == int.from_bytes(b("\x1f".join(["s", r.strip(), str(k), ""]), 8), "big") & ((1 << 63) - 1)
        assert row[1] == b(f"3\x1e{r}\x1f{k}", 16).hex() and int(row[2]) == int.from_bytes(b(f"3:{k}", 8), "little")


def test_mixing(spark):
    p = lambda *x: F.array(*(F.struct(F.lit(float(m)).alias("mz"), F.lit(float(i)).alias("intensity")) for m, i in x))
    # Each side is merged before both are: the anchor's centre lies more than 10 ppm from the distractor.
    two = spark.range(1).select(peaks.mixed(p((100.0, 1), (100.0008, 1)), p((100.00145, 3)), 10).alias("m")).first().m
    assert [(round(x.mz, 5), x.intensity, x.origin) for x in two] == [(100.0004, 2, 0), (100.00145, 3, 1)]
    for scale, want in (("range", [0.0, 1.0]), ("base", [0.5, 1.0])):
        assert [x.intensity for x in spark.range(1).select(peaks.mixed(p((1, 1), (9, 2)), p((1, 0)), 1, scale).alias("m")).first().m] == want
    assert [x.intensity for x in spark.range(1).select(peaks.mixed(p((1, 2)), p((9, 2)), 1, "range").alias("m")).first().m] == [0, 0]
    got = spark.range(1).select(peaks.mixed(p((100, 1), (200, 2)), p((100.0004, 3)), 5).alias("m"), peaks.distractor_count(p((1, 1), (2, 1)), p((1, 1)), 0.1).alias("n")).first()
    assert [(round(x.mz, 6), x.intensity, x.origin) for x in got.m] == [(100.0003, 4, 2), (200, 2, 0)] and got.n == 1


def test_strides_have_no_common_divisor(spark):
    import math

    rows = [(s, k) for s in (0, 1, 2, 3, 12, 30030, 97) for k in (0, 1, 5, 123456789)]
    for r, (s, k) in zip(spark.createDataFrame(rows, "s long, k long").select(counterfactual.coprime_stride(F.col("s"), F.col("k")).alias("x")).collect(), rows):
        if s < 2:
            assert r.x == 1
            continue
        stride = 1 + k % (s - 1)
        while math.gcd(stride, s) != 1:
            stride = stride % (s - 1) + 1
        assert r.x == stride


def test_runs_follow_the_reference_of_their_species(spark):
    data = [("u", "big", k, float(k)) for k in range(70)] + [("u", "big", 0, 0.0)] + [("u", "other", k, 3.0 * k + 1) for k in range(70)] + [("v", "alone", k, 9.0 * k) for k in range(3)]
    got = aligned(spark.createDataFrame(data, "s string, run string, key int, v double"), "run", "key", "v", ["s"]).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.aligned == pytest.approx({"big": r.v, "other": r.key, "alone": r.v}[r.run])


def test_labels_stand_at_their_residues(spark):
    rows = ["M(ox)PEK", "P_E_ K", "W[Oxidation]PEK", "K[Deamidated]PE", "[Acetyl]PEK", "n[deamidated]K", "[ammonia-loss]-QK"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(text.canonical_label(F.col("x"))).collect()]
    assert got == ["M+15.995PEK", "PEK", None, None, None, "N+0.984K", "-17.027QK"]
    rows = ["x:123", "scan=5 foo", "-5", "run1:scan:123"]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select(text.scan_number(F.col("x")), text.title_parts(F.col("x")).alias("t"), text.normal_run(F.concat(F.lit("/a/"), F.col("x"), F.lit(".d")))).collect()
    assert [r[0] for r in got] == [123, None, None, 123] and (got[3].t.run, got[3].t.scan) == ("run1", 123) and got[0][2] == "x:123.d"


def test_mztab_parts_are_whole(spark, tmp_path):
    files.write_mztab(spark.range(40).select(F.col("id").alias("PSM_ID")).repartition(4), str(tmp_path / "t"), "t")
    assert files.read_mztab(spark, str(tmp_path / "t")).count() == 40
    (tmp_path / "bare.mztab").write_text("PSM\ta\tb\n")
    with pytest.raises(Exception, match="no header"):
        files.read_mztab(spark, str(tmp_path / "bare.mztab")).collect()


def test_mgf_records_stay_as_they_are(spark, tmp_path):
    record = "BEGIN IONS\nTITLE={}\r\nPEPMASS=500.1 7\nCHARGE={}+\n100.10\t 1e3\nEND IONS"
    (tmp_path / "in.mgf").write_bytes(("\n".join(record.format(f"t{k}", k) for k in range(1, 6)) + "\n").encode())
    files.filter_mgf(spark, str(tmp_path / "in.mgf"), str(tmp_path / "out"), 2, 3)
    kept = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [x.lstrip(b"\n") + b"END IONS" for x in kept.split(b"END IONS")[:-1]] == [record.format(f"t{k}", k).encode() for k in (2, 3)]


def test_report_needs_as_many_of_each_label(spark):
    df = spark.createDataFrame([(1, 0.1, 1), (1, 0.2, 0), (1, 0.3, 0)], "g int, d double, y int")
    with pytest.raises(Exception, match="1:1"):
        metrics.pair_report(df, ["g"], "d", "y").collect()


def test_nearest_within_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, [float(x) for x in rng.integers(-2, 3, 3)]) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, y int, v array<double>")
    whole = retrieval.distances(df.filter("k % 50 = 0"), df, "k", "y", "v")
    near = retrieval.distances(df.filter("k % 50 = 0"), df, "k", "y", "v", keep=5)
    first = lambda x: {(r.query_id, r.id) for r in sampling.first_by_group(x, ["query_id"], [F.col("distance"), F.col("id")], 5).collect()}
    assert first(whole) == first(near) and near.count() < whole.count() == 4 * 199


def test_replay(spark):
    pool = spark.range(10).withColumnRenamed("id", "k")
    assert {r.k for r in sampling.replayed(pool, "k", 10, "s", 1).collect()} == set(range(10))
    more = sampling.replayed(pool, "k", 50, "s", 1).collect()
    assert sorted(r.draw for r in more) == list(range(50)) and len({r.k for r in more}) > 5


def test_ranks_by_counts_equal_those_of_lists(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{k}", None if k % 17 == 0 else f"g{int(rng.integers(0, 5)) if k % 3 else 0}", None if k == 5 else [float(x) for x in rng.integers(-1, 2, 3)], 500 + float(rng.integers(0, 9)) * 0.002, int(k % 2), k % 2) for k in range(240)]
    df = spark.createDataFrame(rows, "k string, y string, v array<double>, mz double, z int, part int").repartition(5)
    same = lambda a, b: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.collect()) == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect())
    q = retrieval.queries_of(df.filter("v is not null"), "y", "k", "0").unionByName(df.filter("k = 'r5'"))
    hows = ({}, {"ppm": 10.0, "mz": "mz", "charge": "z"}, {"ppm": 10.0, "mz": "mz", "charge": "z", "same_charge": False}, {"partition": "part"})
    for how in hows:
        near = retrieval.distances(q, df, "k", "y", "v", **how)
        want = retrieval.ranked_metrics(retrieval.eligible(near))
        assert want.count() > 2
        for bounds in ({"most_bytes": 5000, "most_places": 20}, {}) if how in ({}, hows[1]) else ({},):
            assert same(retrieval.ranked(q, df, "k", "y", "v", both=True, **how, **bounds), want), (how, bounds)
    assert retrieval.ranked(q.limit(0), df, "k", "y", "v").count() == 0


@pytest.mark.parametrize("name", ["unimod_labels", "token_vocabulary"])
def test_labels_are_made_of_counted_words(spark, data, name):
    """No label is made below the count of words, of each word of a text."""
    from peakloom.plans.queries import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Aggregate [w#")
    assert "RLIKE" in above and below and "RLIKE" not in below


def test_known_rows_build_no_table_of_fingerprints(spark):
    """Repeated fingerprints, null keys and keys of one side only against brute force; the plan groups no fingerprints."""
    from pyspark.sql import functions as F

    from peakloom.operators.dedup import known_rows

    rows = [(i, None if i % 11 == 0 else i % 5, i % 7) for i in range(60)]
    known = [(i, None if i % 13 == 0 else 2 + i % 5, i % 6) for i in range(40)] * 2
    schema = "id long, cheap long, x long"
    got = known_rows(spark.createDataFrame(rows, schema), spark.createDataFrame(known, schema), ["cheap"], F.sha2(F.col("x").cast("string"), 256), "id")
    held = {(c, x) for _, c, x in known if c is not None}
    want = [i for i, c, x in rows if (c, x) in held]
    assert sorted(r.id for r in got.collect()) == want and 0 < len(want) < 40
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line and "_f#" in line for line in plan)
