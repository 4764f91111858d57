"""Labels from search results, batches, peaks dealt anew, fingerprints, coherence: small second implementations."""

import gzip
import hashlib
import json
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import digests, text
from peakloom.operators import interventions, metrics, partners, retrieval, sampling, sequences
from peakloom.plans import pipelines
from peakloom.sources import predictions
from peakloom.sources import spectra as files
from peakloom.streaming import events

PEAKS = "id long, b int, peaks array<struct<mz:double,intensity:double>>"


def test_deltas_go_in_from_the_right(spark):
    rows = [("MAMM", [1, 4]), ("MAMM", [4, 3, 1]), ("MAM", []), ("MAM", None), (None, [1]), ("M", [1, 1])]
    got = spark.createDataFrame(rows, "s string, p array<int>").select(text.with_deltas(F.col("s"), F.col("p"), "M", "+1.5").alias("x")).collect()
    assert [r.x for r in got] == ["M+1.5AMM+1.5", "M+1.5AM+1.5M+1.5", "MAM", "MAM", None, "M+1.5+1.5"]
    for bad in ([2], [0], [5], [-1]):
        with pytest.raises(Exception, match="no M at place"):
            spark.createDataFrame([("MAMM", bad)], "s string, p array<int>").select(text.with_deltas(F.col("s"), F.col("p"), "M", "+1.5")).collect()


def peptide(ref, seq, *mods):
    own = "".join(f'<Modification location="{p}" monoisotopicMassDelta="{m}"/>' for p, m in mods)
    return f'<Peptide id="{ref}"><PeptideSequence>{seq}</PeptideSequence>{own}</Peptide>'


def result(scan, *items):
    own = "".join(f'<SpectrumIdentificationItem rank="{r}" {p}peptide_ref="{ref}"/>' for r, p, ref in items)
    return f'<SpectrumIdentificationResult spectrumID="{scan}">{own}</SpectrumIdentificationResult>'


def test_relabelling(spark, tmp_path):
    no = 'passThreshold="false" '
    doc = "<MzIdentML>" + "".join([
        peptide("a", "PEMM", (3, 15.99491), (1, 42.01), ("x", 15.99491)), peptide("b", "TIDE"), peptide("c", ""), peptide("d", "old"), peptide("d", "MD", (1, 15.9949)), peptide("e", "M", (1, 15.9)),
        result("scan=1", (1, "", "a")), result("controllerType=0 scan=2 x=1", (1, no, "a"), (1, "", "b")), result("scan=3", (2, "", "a")), result("scan=4", (1, "", "c")),
        result("scan=5", (1, "", "a"), (1, "", "d")), result("scan=6", (1, "", "a")), result("scan=6", (1, "", "b")), result("index=7", (1, "", "a")), result("scan=8", (1, "", "zz")), result("scans=9", (1, 'passThreshold="TRUE" ', "e")),
    ]) + "</MzIdentML>"
    for run, body in (("r.1", doc), ("r2", doc.replace("PEMM", "MMMM"))):
        with gzip.open(tmp_path / f"{run}_msgfplus.mzid.gz", "wt") as f:
            f.write(body)
    labels = predictions.mzid_labels(spark, str(tmp_path))
    want = {1: "PEM+15.995M", 2: "TIDE", 5: "M+15.995D", 6: "TIDE", 9: "M"}
    assert {(r.run, r.scan): r.label for r in labels.collect()} == {("r.1", k): v for k, v in want.items()} | {("r2", k): v.replace("PEM", "MMM") for k, v in want.items()}
    rows = [("x/r.1.mgf", 1, "PEMM"), ("r.1.raw", 2, "TIDE"), ("r2.mgf", 3, "KEPT"), ("nowhere.mgf", 1, "KEPT"), (None, 1, "KEPT"), ("r2.mgf", None, None)]
    got = predictions.relabelled(spark.createDataFrame(rows, "f string, s int, l string"), labels, file_col="f", scan_col="s", label_col="l")
    assert [tuple(r) for r in got.orderBy(F.col("f").asc_nulls_last(), "s").collect()] == [
        ("nowhere.mgf", 1, "KEPT", "unmatched"), ("r.1.raw", 2, "TIDE", "same"), ("r2.mgf", None, None, "unmatched"), ("r2.mgf", 3, "KEPT", "unmatched"), ("x/r.1.mgf", 1, "PEM+15.995M", "updated"), (None, 1, "KEPT", "unmatched"),
    ]


def test_wrong_place_stops_relabelling(spark, tmp_path):
    (tmp_path / "r.mzid").write_text("<MzIdentML>" + peptide("a", "PEMM", (1, 15.99491)) + result("scan=1", (1, "", "a")) + "</MzIdentML>")
    with pytest.raises(Exception, match="no M at place 1 of PEMM"):
        predictions.mzid_labels(spark, str(tmp_path), suffix=".mzid").collect()


def test_counts_of_a_write(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "k int, g int")
    counts = {"n": F.count(F.lit(1)), "zero": F.count(F.when(F.col("g") == 0, 1))}
    path = str(tmp_path / "out")

    def check(got):
        if got["zero"] != 17:
            raise ValueError("not the rows that were expected")

    assert predictions.publish_counted(df, path, counts, check, ["g"], source="x") == {"n": 50, "zero": 17}
    assert json.loads((tmp_path / "out.manifest.json").read_text()) == {"counts": {"n": 50, "zero": 17}, "source": "x"} and spark.read.parquet(path).count() == 50
    with pytest.raises(FileExistsError):
        predictions.publish_counted(df, path, counts)
    with pytest.raises(ValueError, match="not the rows"):
        predictions.publish_counted(df.filter("k > 5"), f"{path}2", counts, check)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["out", "out.manifest.json"]


def test_peaks_dealt_anew(spark):
    rnd = random.Random(1)
    rows = [(i, i % 3, [(rnd.choice([1.0, 2.5, rnd.random()]), float(rnd.randint(0, 3))) for _ in range(rnd.randint(0, 9))]) for i in range(60)] + [(100, 0, None), (101, None, [(1.0, 1.0)])]
    df = spark.createDataFrame(rows, PEAKS)
    got = {r.id: r for r in interventions.dealt_peaks(df, ["b"], "id", "peaks", "s").collect()}
    assert len(got) == len(rows) and all((p is None) == (got[i].peaks is None) and len(p or ()) == len(got[i].peaks or ()) for i, _, p in rows)
    for b in range(3):
        pool = lambda x: Counter(tuple(p) for ps in x for p in ps or ())
        assert pool(p for _, c, p in rows if c == b) == pool(r.peaks for r in got.values() if r.b == b)
    assert all(list(r.peaks) == sorted(r.peaks) for r in got.values() if r.b is not None and r.peaks)
    assert any([tuple(p) for p in got[i].peaks] != sorted(p) for i, b, p in rows[:60]) and [tuple(p) for p in got[101].peaks] == [(1.0, 1.0)]
    assert got == {r.id: r for r in interventions.dealt_peaks(df.repartition(7), ["b"], "id", "peaks", "s").collect()}


def test_fingerprints_of_32_bit_values(spark):
    rows = [(500.1, 2, [1.1, 2.2], [3.0, 4.0]), (500.1 + 1e-12, 2, [1.1, 2.2 + 1e-12], [3.0, 4.0]), (500.1, 3, [1.1, 2.2], [3.0, 4.0]), (500.1, 2, [], []), (500.1, 2, None, [1.0]), (None, 2, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "m double, z int, x array<double>, y array<double>")
    got = [r.h for r in df.select(digests.spectrum_fingerprint(F.col("m"), F.col("z"), F.col("x"), F.col("y")).alias("h")).collect()]
    golden = lambda m, z, x, y: hashlib.blake2b(struct.pack(f"<fii{len(x)}f{len(y)}f", m, z, len(x), *x, *y), digest_size=16).hexdigest()
    assert got == [golden(*r) for r in rows[:4]] + [None, None] and got[0] == got[1] != got[2]


@pytest.mark.parametrize("n,d,rank,center", [(40, 5, 5, True), (40, 5, 2, True), (40, 5, 3, False), (3, 6, 3, False), (1, 4, 1, True), (20, 4, 0, True)])
def test_coherence(spark, n, d, rank, center):
    rng = np.random.default_rng(n + d + rank)
    x = rng.normal(size=(n, max(rank, 1))) @ rng.normal(size=(max(rank, 1), d)) if rank else np.tile(rng.integers(0, 5, d).astype(float), (n, 1))
    got = retrieval.coherence(spark.createDataFrame([(r,) for r in x.tolist()], "v array<double>").repartition(3), "v", center)
    y = x - x.mean(axis=0) if center else x
    u, s, vh = np.linalg.svd(y, full_matrices=False)
    k = int((s > s.max(initial=0) * max(n, d) * np.finfo(float).eps).sum()) if s.max(initial=0) > 1e-12 else 0
    want = (n / k * (u[:, :k] ** 2).sum(1).max(), d / k * (vh[:k] ** 2).sum(0).max(), k) if k else (0, 0, 0)
    assert got["rank"] == k and got["left"] == pytest.approx(want[0]) and got["right"] == pytest.approx(want[1]) and got["max"] == max(got["left"], got["right"])


def test_compactness_against_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "abbcccc"[i % 7], rng.normal(size=3)) for i in range(30)] + [(99, "lone", rng.normal(size=3))]
    of = lambda rs: {r.group: r for r in retrieval.compactness(spark.createDataFrame([(i, g, v.tolist()) for i, g, v in rs], "id int, g string, v array<double>"), "id", "g", "v").collect()}
    got = of(rows)
    unit = {i: v / np.linalg.norm(v) for i, _, v in rows}
    for g in "abc":
        own, rest = [unit[i] for i, h, _ in rows if h == g], [unit[i] for i, h, _ in rows if h != g]
        within = np.mean([1 - a @ b for j, a in enumerate(own) for k, b in enumerate(own) if j != k])
        between = np.mean([1 - a @ b for a in own for b in rest])
        assert got[g].within == pytest.approx(within) and got[g].between == pytest.approx(between) and got[g].ratio == pytest.approx(within / between)
    assert got["lone"].within is None and got["lone"].ratio is None
    alone = of([(0, "x", np.array([1.0, 0, 0])), (1, "x", np.array([0, 1.0, 0]))])["x"]
    assert alone.between is None and alone.ratio is None and alone.within == pytest.approx(1)
    same = of([(0, "x", np.array([1.0, 0, 0])), (1, "x", np.array([1.0, 0, 0])), (2, "y", np.array([1.0, 0, 0]))])["x"]
    assert same.ratio is None and same.between == pytest.approx(0)


def test_batches(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.uniform(300, 320), rnd.choice([2, 2, 2, 3]), f"l{rnd.randint(0, 60)}") for i in range(700)]
    rows += [(1000, None, 2, "l1"), (1001, float("nan"), 2, "l1"), (1002, -1.0, 2, "l1"), (1003, 300.0, 0, "l1"), (1004, 300.0, 2, ""), (1005, 300.0, 2, None), (1006, 301.0, 4, "rare")]
    df = spark.createDataFrame(rows, "id int, m double, z int, l string")
    pick = lambda epoch, k=3: partners.matched_batches(df, row_id="id", mz="m", charge="z", label="l", labels_each=4, rows_each=k, seed="s", epoch=epoch, cut=0.5).collect()
    seen = defaultdict(list)
    for r in pick(0):
        seen[r.batch].append(r)
    variants = Counter((r[3], r[2]) for r in rows if r[1] and r[1] > 0 and r[2] > 0 and r[3])
    median = {v: float(np.median([r[1] for r in rows if (r[3], r[2]) == v and r[1] and r[1] > 0])) for v, n in variants.items() if n >= 3}
    for b, own in seen.items():
        own.sort(key=lambda r: r.place)
        labels = [r.l for r in own[::3]]
        assert [r.place for r in own] == list(range(12)) and len(set(labels)) == 4 and all(own[3 * k + j].l == labels[k] for k in range(4) for j in range(3))
        if own[0].tier != "global":
            at = [median[r.l, r.z] for r in own[::3]]
            assert len({r.z for r in own}) == 1 and at == sorted(at)
            # Between the first and the last no other variant of the charge stands.
            assert sum(at[0] < m < at[-1] for (_, z), m in median.items() if z == own[0].z) == 2
    used = [(r.l, r.z) for own in seen.values() for r in own[::3]]
    assert len(used) == len(set(used)) and set(used) <= set(median) and len(median) - len(used) < 4 * 2
    assert sorted(map(tuple, pick(0))) == sorted(map(tuple, pick(0))) != sorted(map(tuple, pick(1)))
    assert pick(0, 10_000) == []


def rank(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def brute_probe(rows, sizes, seed):
    lengths = Counter(n for _, _, _, n in rows)
    runs = defaultdict(set)
    for _, r, k, _ in rows:
        runs[k].add(r)
    single, used, out = [x for x in rows if len(runs[x[2]]) == 1], set(), {}

    def quotas(total):
        share = {n: c * total / len(rows) for n, c in lengths.items()}
        low = {n: int(s) for n, s in share.items()}
        for n in sorted(share, key=lambda n: (-(share[n] - low[n]), -lengths[n], n))[: total - sum(low.values())]:
            low[n] += 1
        return low

    for split in ("val", "test"):
        need, out[split] = quotas(sizes[split]), []
        for run in sorted({x[1] for x in single} - used, key=lambda r: (rank(seed, split, "run", r), r)):
            for x in sorted((x for x in single if x[1] == run), key=lambda x: (rank(seed, split, "row", x[0]), x[0])):
                if need[x[3]] > 0:
                    need[x[3]] -= 1
                    out[split].append(x)
                    used.add(run)
        if any(need.values()):
            return None
    held, need, out["train"] = {x[2] for s in out.values() for x in s}, quotas(sizes["train"]), []
    for x in sorted(rows, key=lambda x: (rank(seed, "train", x[0]), x[0])):
        if x[1] not in used and x[2] not in held and need[x[3]] > 0:
            need[x[3]] -= 1
            out["train"].append(x)
    return None if any(need.values()) else {x[0]: s for s, xs in out.items() for x in xs}


def test_probe_split(spark):
    rnd = random.Random(6)
    rows = [(i, f"r{rnd.randint(0, 25)}", f"k{rnd.randint(0, 300)}", rnd.choice([7, 7, 7, 8, 9, 12])) for i in range(500)]
    df = spark.createDataFrame([*rows, (900, None, "k", 7), (901, "r1", None, 7), (902, "r1", "k", None)], "id int, run string, key string, n int")
    make = lambda sizes: {r.id: r for r in pipelines.probe_split(df, run="run", key="key", length="n", row_id="id", sizes=sizes, seed="s").collect()}
    sizes = {"val": 10, "test": 12, "train": 90}
    got = make(sizes)
    assert {i: r.split for i, r in got.items()} == brute_probe(rows, sizes, "s") and Counter(r.split for r in got.values()) == sizes
    for what in ("run", "key"):
        held = [{r[what] for r in got.values() if r.split == s} for s in sizes]
        assert not held[0] & held[1] and not held[2] & (held[0] | held[1])
    with pytest.raises(ValueError, match="too few rows for train"):
        make({"val": 10, "test": 12, "train": 480})


def test_pooled_and_macro(spark):
    rnd = random.Random(8)
    rows = [("a", p, round(rnd.random() * (1 + p), 1), k % 2) for p in (1, 2, 3) for k in range(40)] + [("b", None, round(rnd.random(), 1), k % 2) for k in range(10)]
    got = {(r.pair_set, r.scope, r.part, r.metric): r.value for r in pipelines.pooled_and_macro(spark.createDataFrame(rows, "pair_set string, part int, d double, y int"), "pair_set", "part", "d", "y").collect()}

    def auc(xs):
        pos, neg = [d for _, _, d, y in xs if y], [d for _, _, d, y in xs if not y]
        return sum((p < n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)

    each = [auc([r for r in rows if r[1] == p]) for p in (1, 2, 3)]
    assert [got["a", "partition", p, "auc"] for p in (1, 2, 3)] == pytest.approx(each)
    assert got["a", "macro", None, "auc"] == pytest.approx(sum(each) / 3) and got["a", "pooled", None, "auc"] == pytest.approx(auc([r for r in rows if r[0] == "a"]))
    assert got["b", "partition", None, "auc"] == got["b", "pooled", None, "auc"] == pytest.approx(auc(rows[-10:]))


MASSES = {"G": 57.0, "A": 71.0, "M": 131.0, "+42": 42.0, "-17": -17.0, "-60": -60.0}


def brute_beam(tokens, mz, z, n_term, least, ppm, isotopes):
    """Every prefix judged on its own."""
    for i, t in enumerate(tokens):
        own = [x for x in tokens[: i + 1] if x != "$"]
        if t == "":
            return (i, False, False, True)
        stops = t == "$"
        last = i - 1 if stops else i
        if i > 1 and any(x in n_term for x in tokens[:last]):
            return (i, False, False, True)
        if stops and (not own or len(own) < least):
            return (i, False, False, True)
        off = lambda more: [(((sum(MASSES[x] for x in [*own, *more]) + 18.010565) / z + 1.00727646688) - (mz - k * 1.00335 / z)) / mz * 1e6 for k in range(isotopes[0], isotopes[1] + 1)]
        known = all(x in MASSES for x in own)
        fits = known and any(abs(d) < ppm for d in off([]))
        if stops:
            return (i, True, fits, False)
        if known and not fits and any(all(d > ppm for d in off([x])) for x in MASSES if MASSES[x] < 0):
            return (i, True, False, False)
    return (None, False, False, False)


def test_beam_ends(spark):
    rnd = random.Random(9)
    rows = [([], 500.0, 2), (["$"], 500.0, 2), (["G", "A", "$"], 500.0, 2), (["G", "", "A"], 500.0, 1), (["+42", "+42", "G"], 900.0, 1), (["G", "A", "+42", "$"], 200.0, 1), (["+42", "G", "A"], 900.0, 1), (["X", "G", "M", "$"], 100.0, 1)]
    for _ in range(500):
        tokens = [rnd.choice(["G", "A", "M", "G", "A", "M", "G", "+42", "-17", "-60", "X"] if rnd.random() < 0.1 else ["G", "A", "M"]) for _ in range(rnd.randint(1, 9))]
        z = rnd.randint(1, 3)
        whole = (sum(MASSES.get(x, 0) for x in tokens) + 18.010565) / z + 1.00727646688
        rows.append((tokens + rnd.choice([["$"], ["$", "G"], [], [""]]), whole + rnd.choice([0, 1.00335 / z, -1.0, 5.0, -whole / 2, 1e-9]), z))
    for least, isotopes in ((3, (0, 1)), (1, (0, 0))):
        end = sequences.beam_end(F.col("t"), F.col("mz"), F.col("z"), MASSES, n_term=("+42",), min_length=least, ppm=50.0, isotopes=isotopes)
        got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t array<string>, mz double, z int").select("k", end.alias("e")).orderBy("k").collect()
        want = [brute_beam(*r, ("+42",), least, 50.0, isotopes) for r in rows]
        assert [tuple(r.e) for r in got] == want and len({w[1:] for w in want}) == 4
    none = spark.createDataFrame([(None, 1.0, 1), (["G", None, "$"], 100.0, 1), (["G", "A", "M", "$"], None, 1)], "t array<string>, mz double, z int")
    assert [r.e and tuple(r.e) for r in none.select(sequences.beam_end(F.col("t"), F.col("mz"), F.col("z"), MASSES, min_length=1).alias("e")).collect()] == [None, (2, True, False, False), (3, True, False, False)]


def test_export_with_index(spark, tmp_path):
    nan = float("nan")
    bad = {3: (nan, 2, "AB", [(1.0, 1.0)]), 5: (500.0, 0, "AB", [(1.0, 1.0)]), 6: (500.0, 2, "A B", [(1.0, 1.0)]), 8: (500.0, 2, "", [(1.0, 1.0)]), 9: (500.0, 2, "AB", []), 11: (500.0, 2, "AB", None), 12: (500.0, 2, "AB", [(-1.0, 1.0)]), 13: (500.0, 2, "AB", [(1.0, nan)]), 14: (500.0, 9, "AB", [(1.0, 1.0)]), 15: (None, 2, None, None)}
    rows = [(7 * i, *bad.get(i, (500.0 + i, 2 + i % 2, "PEP" * (1 + i % 2), [(100.0 + i, float(k)) for k in range(1 + i % 3)]))) for i in range(60)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "i long, m double, z int, s string, p array<struct<mz:double,intensity:double>>").repartition(5)
    path = str(tmp_path / "out")
    files.export_mgf(df, path, index="i", precursor_mz="m", charge="z", peaks="p", sequence="s", supported=F.col("z") < 9)
    index = {r.supported_index: r.full_index for r in spark.read.parquet(f"{path}/index").collect()}
    good = [7 * i for i in range(60) if i not in bad]
    assert index == dict(enumerate(good))
    # All files in order of their names hold the records in this order.
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out" / "mgf").glob("part-*.txt")))
    titles = [int(line.split("index=")[1]) for line in whole.splitlines() if line.startswith("TITLE=")]
    assert titles == good and whole.count("BEGIN IONS") == whole.count("END IONS") == len(good)
    want = {3: "precursor", 5: "charge", 6: "sequence", 8: "sequence", 9: "peaks", 11: "peaks", 12: "mz", 13: "intensity", 14: "unsupported", 15: "precursor"}
    assert {r.full_index // 7: r.problem for r in spark.read.parquet(f"{path}/rejected").collect()} == want


def test_repeats_are_known_after_a_restart(spark, tmp_path):
    schema = "k string, v int"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run(refuse=False):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        q = events.marked_repeats(source, ["k"], refuse).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).start().awaitTermination()
        return sorted((r.k or "", r.v, r.repeat) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a", [("x", 1), ("y", 2), (None, 3)])
    assert run() == [("", 3, False), ("x", 1, False), ("y", 2, False)]
    put("b", [("x", 4), ("z", 5), ("z", 6), (None, 7)])  # another query, from the same checkpoint
    got = run()
    assert [r for r in got if r[1] in (4, 7)] == [("", 7, True), ("x", 4, True)] and sorted(r[2] for r in got if r[0] == "z") == [False, True]
    put("c", [("y", 8)])
    with pytest.raises(Exception, match="a key is repeated"):
        run(refuse=True)


def test_rows_without_vectors_or_scores(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", [0.9, 0.1]), (2, "b", [0.0, 1.0]), (3, "b", None), (4, "b", [0.1, 0.9])]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>")
    near = retrieval.distances(df.filter("id in (0, 3)"), df, "id", "g", "v").collect()
    assert sorted((r.query_id, r.id) for r in near) == [(0, 1), (0, 2), (0, 4)]
    right = retrieval.knn_accuracy(df, df.filter("id < 3"), "id", "g", "v", 1).first()
    assert tuple(right) == (3, 3, 1.0)
    for k in (0, 5):
        with pytest.raises(ValueError, match="training rows"):
            retrieval.knn_accuracy(df, df, "id", "g", "v", k)
    scored = spark.createDataFrame([(0.9, 1), (0.1, 0), (None, 1), (float("nan"), 0), (0.95, None)], "s double, y int")
    assert tuple(metrics.roc_auc(scored, [], "s", "y").first()) == (1, 1, 1.0)


def test_cuts_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert sampling.cut_edges(df, "x") == []
    monkeypatch.setattr(sampling, "CUT_ROWS", 50)
    edges = sampling.cut_edges(df, "x")
    assert len(edges) == 19 and max(b - a for a, b in zip([0, *edges], [*edges, 1000])) < 100
    got = metrics.ordinal_ranks(df.withColumn("id", F.col("x").cast("int")), [], "x", "id", "place").collect()
    assert all(r.place == r.id + 1 for r in got) and sorted(r.row_number for r in sampling.row_numbers(df, "x").collect()) == list(range(1000))


def test_evidence_tables(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("file\tscan\tpep\tseq\torg\tbad\na\tscan=1\t0.5\tX\to1\t\na\tscan=1\t0.1\tZ\to2\t\na\tscan=1\t0.1\tY\t \t\na\tscan=1\t0.01\tW\t\t+\na\tscan=2\tx\tV\t\t\n")
    read = lambda **more: [tuple(r) for r in files.read_best_psms(spark, str(tmp_path), file="file", scan="scan", score="pep", peptide="seq", **more).collect()]
    assert read(smallest=True, gates={"bad": "bad = '+'"}) == [("a", 1, "Y", 0.1)] and read(smallest=True) == [("a", 1, "W", 0.01)] and read() == [("a", 1, "X", 0.5)]
    got = files.read_key_sets(spark, str(tmp_path), keys=["file", "scan"], sets=["seq", "org"])
    assert sorted(map(tuple, got.collect())) == [("a", "scan=1", ["W", "X", "Y", "Z"], ["o1", "o2"]), ("a", "scan=2", ["V"], [])]


def test_search_results_in_several_files_a_run(spark, data, monkeypatch):
    """Labels at a file's end may name the first of the next: the outcome is that of one file a run."""
    from peakloom.plans import curation

    want = sorted(map(tuple, curation.relabelled_spectra(spark, data).collect()))
    monkeypatch.setattr(curation, "LABELS", 7)
    paths = spark.read.text(curation.search_results(spark, data)).select("run", "part").distinct().groupBy("run").count().collect()
    assert len(paths) == 3 and min(r["count"] for r in paths) > 5
    assert sorted(map(tuple, curation.relabelled_spectra(spark, data).collect())) == want
