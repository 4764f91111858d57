"""Odd tables and columns, second implementations and crafted cases of the corpus operators."""

import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import bpe, decontaminate, exact_dedup, line_dedup, queries, secrets, sharding, simhash, substring_dedup, token_counts, toxicity
from peakloom.plans.scratch import shared_root
from tests.llm.test_llm import ODD, SCHEMA, brute_components, same

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_columns_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, "a line", "x")], "doc_id long, text string, `OTHER` string")
    bench = spark.createDataFrame([(1, "a line")], "item_id long, text string")
    clash = lambda name: df.withColumnRenamed("OTHER", name)
    for name, f in (
        ("Line_Dedup", line_dedup.dedup_lines), ("Substring_Dedup", substring_dedup.dedup_substrings), ("Contamination", lambda d: decontaminate.find_contamination(d, bench)),
        ("IDS", lambda d: bpe.encode(d, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)),
    ):
        got = f(clash(name))
        assert [c.lower() for c in got.columns] == ["doc_id", "text", name.lower()] and len(got.collect()) == 1
    for f in (exact_dedup.dedup_exact, sharding.shard, simhash.near_duplicates, secrets.scan_secrets):
        assert f(clash("RUN")).count() == 1


def test_crafted_words_are_told_apart(spark):
    """Thue-Morse words: any polynomial modulo a power of two gives both the same value."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")]
    got = {r.doc_id: r.substring_dedup.n_removed for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_lower_case_keeps_places():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert len(toxicity.lowered(every.encode())) == len(every)
    assert toxicity.lowered("İIΣ".encode()) == "iiσ" or toxicity.lowered("İIΣ".encode()) == "iiς"


def test_spans_of_toxic_texts(spark):
    clean = [(k, f"the weather number {k} was fine and calm today") for k in range(60)]
    foul = [(100 + k, f"the weather İstanbul number {k} was vileword and calm İx today") for k in range(60)]
    docs = spark.createDataFrame(clean + foul + [(900, None), (901, "")], SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + foul], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.score_toxicity(docs, model).collect():
        words = [r.text[s.start : s.end] for s in r.toxicity.spans]
        assert ("vileword" in words) == (r.doc_id is not None and 100 <= r.doc_id < 900) and "weather" not in words
        assert all(s.p > 0.5 for s in r.toxicity.spans)


def test_a_second_run_encodes_nothing(spark, data):
    first = queries.op5_token_counts(spark, data).collect()
    folder = next(p for p in [f"{shared_root(spark)}/token-cache-{__import__('hashlib').sha256(data.encode()).hexdigest()[:16]}"])
    n = spark.read.parquet(folder).count()
    same(map(tuple, queries.op5_token_counts(spark, data).collect()), map(tuple, first))
    assert spark.read.parquet(folder).count() == n == spark.read.parquet(f"{data}/documents.parquet").select(F.coalesce("text", F.lit(""))).distinct().count()


def test_the_ring_row_by_row(spark, data):
    """Each row on its own: into its cell's next virtual node, on clockwise while shards are full, in rounds."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, "x"), (None, "x"), (None, "y")], SCHEMA))
    for shards, slack in ((16, 0.0), (5, 0.2)):
        place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("ring"))
        rows = docs.select("doc_id", place.alias("at"), F.shiftrightunsigned(place, 48).cast("int").alias("cell"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("crc"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size")).collect()
        nodes = sharding.virtual_nodes(shards, 64, 1 << 16)
        n, most = len(rows), -(-len(rows) // shards)
        room = [most - (n % shards > 0 and s >= n % shards) for s in range(shards)] if not slack else [max(most, int((1 + slack) * n / shards))] * shards
        waiting = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r.cell, r.at, r.doc_id is None, r.doc_id or 0, r.crc, r.size)):
            waiting[next((k for k, (c, _) in enumerate(nodes) if c >= r.cell), 0)].append(r)
        where, used = [], Counter()
        while waiting:
            over = {}
            for k in sorted(waiting):
                s = nodes[k][1]
                for r in waiting[k]:
                    if room[s]:
                        room[s] -= 1
                        where.append((r.doc_id, r.crc, s, used[s]))
                        used[s] += 1
                    else:
                        over.setdefault(k, []).append(r)
            waiting = defaultdict(list)
            for k, rs in over.items():
                to = next(j % len(nodes) for j in range(k + 1, k + 1 + len(nodes)) if room[nodes[j % len(nodes)][1]])
                waiting[to] += rs
        same([(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, shards=shards, slack=slack).collect()], where)


def test_added_secrets_by_brute_force(spark, data):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(None, "id 9f86d081884c7d659a2feaa0c55ad015zz and plainidentifiername twice plainidentifiername"), (-1, "token=abcdefgh12345678/xyz more")]
    rng = random.Random(3)
    rows += [(-10 - k, f"key {rng.getrandbits(96):024x} of therthorethandation") for k in range(30)] + [(-100 - k, f"secret: {rng.getrandbits(160):040x}") for k in range(100)]
    base, tokens, counts, own = {}, {}, [Counter(), Counter()], set()
    for k, (_, t) in enumerate(rows):
        found = []
        for p, group, least in (
            (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile(r"[0-9a-f]+"), 0, 32),
        ):
            found += [(m.start(), m.end(), m[group]) for m in p.finditer(t) if len(m[group]) >= least]
        base[k] = found
        own |= {v for _, _, v in found}
        tokens[k] = [m for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t) if not any(a < m.end() and m.start() < z for a, z, _ in found)]
    pairs = lambda v: zip([0, *map(code, v)], map(code, v))
    code = lambda c: secrets.ALPHABET.find(c) + 1
    for v in own | {v.upper() for v in own}:
        counts[1].update(pairs(v))
    for _, t in rows:
        for v in re.findall(secrets.IDENTIFIER, t):
            if v not in own:
                counts[0].update(pairs(v))
    k = len(secrets.ALPHABET) + 1
    total = [[sum(c[a, b] + 0.5 for b in range(k)) for a in range(k)] for c in counts]
    ratio = lambda a, b: round(math.log((counts[1][a, b] + 0.5) / total[1][a]) - math.log((counts[0][a, b] + 0.5) / total[0][a]), 6) if a else 0.0
    want = [(i, tuple((m.start(), m.end()) for m in tokens[n] if sum(ratio(*x) for x in pairs(m[0])) / len(m[0]) >= 0.25)) for n, (i, _) in enumerate(rows)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    same([(r.doc_id, tuple((s.start, s.end) for s in r.added)) for r in got], want)
    assert 20 < sum(len(x) for _, x in want) < 200


def test_long_and_dense_texts_of_secrets(spark):
    n = 20_000
    dense = " ".join(f"secret=abcdefgh{i:08d} longidentifier{i:08d}" for i in range(n))
    got = secrets.scan_secrets(spark.createDataFrame([(1, dense)], SCHEMA)).first()
    assert len(got.base) == n and got.base[-1].end < len(dense) and dense[got.base[-1].start : got.base[-1].end].startswith("secret=")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in ODD] + [(50, None, None, None, None), (None, "lonely words without an id that are like no others at all", None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages_on_odd_and_empty_tables(spark, data, odd_docs):
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, data)
        assert stage(spark, empty, data).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == odd_docs.columns
            assert got.filter("text like 'lonely%'").count() == 1, name
        else:
            same([r.doc_id for r in got.collect()], [r.doc_id for r in odd_docs.collect()])


def test_one_row_of_each_group_stays(spark, odd_docs):
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, odd_docs, "").collect()]
    grams = lambda t: frozenset(zip(*(w[j:] for j in range(5)))) if len(w := (t or "").lower().encode().split()) >= 5 else frozenset([tuple(w)] if w else [])
    everyone = [(r.doc_id, r.text) for r in odd_docs.collect()]
    groups = defaultdict(list)
    for i, t in everyone:
        groups[grams(t)].append(i)
    # No two of these texts are similar without being equal.
    order = lambda i: (i is None, i or 0)
    same([i for i, _ in kept], [min(ids, key=order) for ids in groups.values()])
    assert brute_components([]) == {}


def test_crowds_of_equal_fingerprints(spark):
    """A third of all rows share a text, and a chain links many fingerprints."""
    rows = [(k, "one text that very many rows share between them") for k in range(400)] + [(1000 + k, f"text number {k} " + " ".join(f"w{k}x{j}" for j in range(9))) for k in range(800)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == 1200 and all(r.component_id == 0 for r in got if r.doc_id < 400)
    counted = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA), path=public_tokenizers.path("word_bpe_49k.json"), counter="words").collect()
    assert len(counted) == 1200 and len({r.n_tokens for r in counted if r.doc_id < 400}) == 1


CLASHES = ["_id", "_none", "_digest", "a.b", "own_id", "part", "made", "c0", "NONE", "Line_Dedup", "TOXICITY", "Contamination", "substring_Dedup", "Ids"]


def test_operators_and_stages_with_clashing_columns(spark, data, odd_docs):
    """Columns with dots, and with names that operators use themselves in any case, go along unchanged."""
    wide = odd_docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHES)))
    bench = spark.createDataFrame([(1, "same line other line")], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for into, f in (
        ("line_dedup", line_dedup.dedup_lines), ("substring_dedup", substring_dedup.dedup_substrings), ("contamination", lambda d: decontaminate.find_contamination(d, bench, n=2)),
        ("ids", lambda d: bpe.encode(d, path=path, pattern=public_tokenizers.PATTERN)),
    ):
        got = f(wide)
        others = [c for c in wide.columns if c.lower() != into and c != "text"]
        assert got.columns == [c for c in wide.columns if c.lower() != into] + [into]
        pick = lambda d: [tuple(r) for r in d.select(*(f"`{c}`" for c in others)).collect()]
        same(pick(got), pick(wide))
        narrow = f(odd_docs)
        same([str((r.doc_id, r[into])) for r in got.collect()], [str((r.doc_id, r[into])) for r in narrow.collect()])
    for f in (exact_dedup.dedup_exact, sharding.shard, simhash.near_duplicates, secrets.scan_secrets, lambda d: token_counts.count_tokens(d, path=public_tokenizers.path("word_bpe_49k.json"), counter="words")):
        same([tuple(r) for r in f(wide).select("doc_id").collect()], [(r.doc_id,) for r in wide.collect()])
    for name, stage in corpus_pipeline.STAGES:
        got, narrow = stage(spark, wide, data), stage(spark, odd_docs, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == wide.columns, name
        same([str((r.doc_id, r.text if "text" in got.columns else r.ids_sha256)) for r in got.collect()], [str((r.doc_id, r.text if "text" in narrow.columns else r.ids_sha256)) for r in narrow.collect()])


def test_saved_tables_leave_no_shuffle_files(spark):
    """A stage's shuffles would else add up until the driver collects garbage."""
    import time
    from pathlib import Path

    from peakloom.llm.shared import saved

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    got = saved(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "seven")
    assert sorted(r["count"] for r in got.collect()) == [142, 143, 143, 143, 143, 143, 143]
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key) == setting


def test_near_dedup_joins_sets_and_not_their_codes(spark, monkeypatch):
    """The posts of a set that a later layer has are not made first and thrown away in a join of a row a code."""
    from peakloom.llm import shingle_sets

    kind = "node long, n int, codes array<bigint>, fresh array<bigint>"
    first = spark.createDataFrame([(1, 2, [10, 11], []), (2, 2, [10, 12], []), (3, 2, [11, 12], [])], kind)
    later = spark.createDataFrame([(2, 2, [11, 12], [11])], kind)
    last = spark.createDataFrame([(3, 2, [10, 12], [10])], kind)
    made, plain_saved = [], shingle_sets.saved
    monkeypatch.setattr(shingle_sets, "saved", lambda df, name: made.append(df) or plain_saved(df, name))
    got = shingle_sets.posted([first, later, last])
    assert sorted((r.node, r.pos, r.code) for r in got.collect()) == [(1, 0, 10), (1, 1, 11), (2, 0, 11), (2, 1, 12), (3, 0, 10), (3, 1, 12)]
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if "LeftAnti" in line:
            below = [x for x in plan[k + 1 : next((j for j in range(k + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))] if "MapInArrow" in x]
            assert not below, below
    assert sum("LeftAnti" in x for x in plan) == 3


def test_a_task_of_the_pipeline_has_one_python_worker(spark, data, monkeypatch):
    """Executors keep all workers that their tasks had at once, and workers of each kind."""
    from peakloom.llm import shingle_sets

    plans, plain_saved = {}, shingle_sets.saved
    monkeypatch.setattr(shingle_sets, "saved", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or plain_saved(df, name))
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(i % 30))) for i in range(40)] + [(None, passage), (None, passage), (7, passage)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, n=3, percent=80, pair_bucket=8).collect() if r.doc_id is not None and r.doc_id != 7}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows if i is not None and i != 7}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * 180 >= (len(sets[i]) + len(sets[j])) * 80]
    assert all(got[i] == got[j] for i, j in pairs)
    assert plans["crowd"] and all(p.count("MapInArrow") == 1 for p in plans["crowd"])
    assert "PythonRDD" not in shingle_sets.listed(spark, [1, 2])._jdf.queryExecution().toRdd().toDebugString()
    assert sorted(r.code for r in shingle_sets.listed(spark, [5, 1 << 61]).collect()) == [5, 1 << 61] and shingle_sets.listed(spark, []).count() == 0
    ids = corpus_pipeline.encode(spark, docs, data)
    assert ids._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and ids.count() == len(rows)


def test_marks_are_the_same_in_spark_and_python(spark):
    from peakloom.llm import shingle_sets
    from peakloom.llm.shared import bit_filter

    rows = [(k * 7919 % 65536, f"{(k * 0x9E3779B1) % 2**32:08x}" + "0" * 24) for k in range(500)]
    own = bit_filter(spark.createDataFrame(rows, "spot long, fp string").select(shingle_sets.marks(F.col("spot"), 16).alias("spot")), 16)
    assert all(shingle_sets.holds(own, shingle_sets.mark(*r)) for r in rows)
    assert sum(map(lambda k: shingle_sets.holds(own, k), range(65536))) == len({shingle_sets.mark(*r) % 65536 for r in rows})


def test_sets_that_hold_a_code_without_a_row_a_code(spark):
    from peakloom.llm import shingle_sets

    sets = spark.createDataFrame([(1, [10, 11]), (2, []), (3, [5]), (4, [11, 99]), (5, [98, 100]), (6, [99, 11])], "node long, codes array<bigint>")
    found = shingle_sets.holding(sets, [99, 10])
    assert sorted(r.node for r in found.collect()) == [1, 4, 6]
    assert shingle_sets.holding(sets.limit(0), [99]).count() == 0
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
