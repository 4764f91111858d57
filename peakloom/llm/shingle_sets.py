"""Near duplicates by exact shingle similarity: SimHash fingerprints of shingle sets first, then the sets themselves.

Sets whose 64-bit SimHash fingerprints are linked (by simhash.links) are compared whole, and those that are similar are linked
before any other pair is made. What no such fingerprint can tell, as similar sets may be 14 bits apart, the sets tell.

Sets with Jaccard similarity of percent / 100 or more are at most k bits apart, so of any k + 1 bits of one the other has
one (pigeonhole). Over any one order of all shingles these are the first of each set: sets that meet on one are all
candidates, and the Hamming distance of whole sets decides. Shingles that fill a bucket go to the end of the order, which
changes cost only. Members of a bucket that is still full are first compared with a few of them, and pairs that these
links already connect are not compared again. Others are joined only where what is left of both sets behind the shingle
can be enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import sketch
from peakloom.llm.components import components
from peakloom.llm.shared import MOST_BITS, bit_filter, discard, saved, slices, trimmed

#: Codes of ordinary shingles are below, those of shingles at the end of the order from here on.
LAST = 1 << 62
MOST_WORDS = 50_000
#: Bins of a set's histogram; two sets have no more in common than the lesser counts add up to.
BINS, FULL = 512, 255
#: So many members of a full bucket's length band meet all of it before pairs are made.
PIVOTS = 6
#: Cells of a row of the twice-seen filter, at most (a power of two): 32 MB are sent.
MOST_CELLS = 27
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of each of the 256 byte values, most significant first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)


class Words(dict):
    """64-bit hashes of words, remembered, at most MOST_WORDS."""

    def __init__(self, seed: int):
        import xxhash

        super().__init__()
        self.hash, self.seed = xxhash.xxh64_intdigest, seed

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word, self.seed)
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def codes(text: bytes | None, n: int, words: Words) -> np.ndarray:
    """A text's distinct shingles as ascending numbers."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.int64)
    c = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    m, span = max(1, len(w) - n + 1), min(n, len(w))
    h = np.full(m, span, np.uint64)
    for j in range(span):
        h = (h ^ (h >> np.uint64(29))) * ODD + c[j : j + m]
    h = (h ^ (h >> np.uint64(32))) * ODD
    return np.unique((h >> np.uint64(2)).view(np.int64))


def prefix_length(k: int, percent: int) -> int:
    """Of so many bits another set that is similar enough has one."""
    return k + 1 + -k * percent // 100 if k else 0


def placed(late: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The k-th code of the list comes before all that are ahead of it in the list, after all others."""
    order = np.argsort(np.array(late, np.int64), kind="stable")
    return np.array(late, np.int64)[order], LAST + (LAST >> 1) - order.astype(np.int64)


def reordered(c: np.ndarray, known: np.ndarray, places: np.ndarray) -> np.ndarray:
    if not len(known):
        return c
    at = np.minimum(np.searchsorted(known, c), len(known) - 1)
    return np.sort(np.where(known[at] == c, places[at], c))


def histogram(c: np.ndarray) -> bytes:
    """How many codes fall into each of BINS bins; FULL stands for so many or more."""
    return np.minimum(np.bincount((c % BINS).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes()


def simprint(c: np.ndarray) -> int:
    """The set's 64-bit SimHash fingerprint as a signed number: a bit is 1 if set in over half of the codes; 0 without codes."""
    octets = (c.view(np.uint64) * ODD).astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(c)).tobytes(), "little", signed=True)


def mark(spot: int, fp: str) -> int:
    """A number for a text's spot and digest; as in `marks`."""
    return spot ^ int(fp[:8], 16)


def marks(spot: Column, bits: int) -> Column:
    """The place of `mark` in a filter of 2**bits bits."""
    return F.pmod(spot.bitwiseXOR(F.conv(F.substring("fp", 1, 8), 16, 10).cast("long")), F.lit(1 << bits))


def holds(filter: np.ndarray, place: int) -> bool:
    place %= 8 * len(filter)
    return bool(filter[place >> 3] >> (place & 7) & 1)


def listed(spark: SparkSession, codes: list[int]) -> DataFrame:
    """(code) as an Arrow table: rows of Python's would start workers of another kind on the executors, which stay there."""
    return spark.createDataFrame(pa.table({"code": pa.array(codes, pa.int64())}), "code long")


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def coded(texts: DataFrame, n: int, seed: int, percent: int | None, late: list[int], before: int = 0, chosen=None, own=None) -> DataFrame:
    """texts (id, text, run, spot) as id, run, fp (digest of all codes), print (SimHash; 0 with chosen), n, hist, codes: all, or the first of them by percent,
    and fresh: those that weren't among them when only the first `before` of `late` were at the end.

    chosen: a broadcast bit filter; only texts whose spot is in it are coded and given. own: another, of marks; only texts
    whose mark is in it are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, order, earlier = Words(seed), placed(late), placed(late[:before])
        for batch in batches:
            if chosen is not None:
                spot = batch.column(3).to_numpy()
                batch = batch.filter(pa.array((chosen.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices(batch, 1, 1 << 20):
                prints, sims, sizes, kept, fresh, hists = [], [], [], [], [], []
                held = []
                for i, (t, spot) in enumerate(zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(3).to_pylist())):
                    c = codes(t, n, words)
                    fp = xxhash.xxh3_128_hexdigest(c.tobytes())
                    if own is not None and not holds(own.value, mark(spot, fp)):
                        continue
                    held.append(i)
                    prints.append(fp)
                    sims.append(simprint(c) if chosen is None else 0)
                    k = len(c) if percent is None else prefix_length(len(c), percent)
                    sizes.append(len(c))
                    hists.append(histogram(c))
                    kept.append(reordered(c, *order)[:k])
                    fresh.append(np.setdiff1d(kept[-1], reordered(c, *earlier)[:k], assume_unique=True) if len(late) > before else c[:0])
                part = part.take(pa.array(held, pa.int64())) if len(held) < part.num_rows else part
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(prints, pa.string()), pa.array(sims, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hists, pa.binary()), lists(kept), lists(fresh)], names=["id", "run", "fp", "print", "n", "hist", "codes", "fresh"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text", "run", "spot").mapInArrow(trimmed(run), f"id {kind}, run int, fp string, print long, n int, hist binary, codes array<bigint>, fresh array<bigint>")


def parts_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as their values and their lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def twice_filter(codes: DataFrame) -> tuple[Broadcast, int]:
    """A broadcast twice-seen filter of two rows over lists of codes (the only column), and its bits."""
    total = codes.agg(F.sum(F.size(codes.columns[0]))).first()[0] or 0
    bits = sketch.bits_for(total, 4, MOST_CELLS)
    hashes_of = lambda: lambda batch: parts_of(batch.column(0))[0].view(np.uint64)
    return codes.sparkSession.sparkContext.broadcast(sketch.twice_seen(codes, hashes_of, 2, bits)), bits


def repeated(codes: DataFrame) -> DataFrame:
    """(code), a row for each time that a list has it: the codes that a twice-seen filter suspects of more than one list."""
    seen, bits = twice_filter(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, _ = parts_of(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(flat[sketch.suspected(seen.value, flat.view(np.uint64), 2, bits)], pa.int64())], names=["code"])

    return codes.mapInArrow(trimmed(run), "code long")


def holding(sets: DataFrame, some: list[int]) -> DataFrame:
    """(node): the sets (node, codes) that hold one of some codes; no row a code is made."""
    sent = sets.sparkSession.sparkContext.broadcast(np.sort(np.array(some, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            flat, sizes = parts_of(b.column(1))
            met = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
            at = np.unique(np.repeat(np.arange(len(sizes)), sizes)[met])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at))], names=["node"])

    return sets.select("node", "codes").mapInArrow(trimmed(run), "node long")


def posted(layers: list[DataFrame]) -> DataFrame:
    """(node, n, pos, code): the codes of sets (node, n, codes) that a twice-seen filter suspects of more than one set.

    A node's set is the one in the last layer that has it; the filter counts the first layer's codes and what is fresh in
    others. Most shingles are in one set only, and such a code meets nothing. Beyond its largest size the filter
    suspects more, and in the end all.
    """
    codes = layers[0].select("codes")
    for x in layers[1:]:
        codes = codes.union(x.select("fresh"))
    seen, bits = twice_filter(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = parts_of(b.column(2))
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(sketch.suspected(seen.value, flat.view(np.uint64), 2, bits))
            some = lambda x: x.take(pa.array(row[at]))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([some(b.column(0)), some(b.column(1)), pa.array(pos[at], pa.int32()), pa.array(flat[at], pa.int64())], names=["node", "n", "pos", "code"])

    out = None
    for k, x in enumerate(layers):
        own = x.select("node", "n", "codes")
        # A row a set, not a row a code, meets the later layers.
        for later in layers[k + 1 :]:
            own = own.join(later.select("node"), "node", "left_anti")
        own = own.mapInArrow(trimmed(run), "node long, n int, pos int, code long")
        out = own if out is None else out.union(own)
    return saved(out, "posts")


def similar(texts: DataFrame, *, n: int, seed: int, percent: int, pair_bucket: int, near: Callable[[DataFrame], DataFrame], most_reorders: int = 2, most_late: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (id, text, run) as prints (id, run, fp), nodes (node, fp, least) and links (a, b) between similar nodes.

    Words as in simhash.fingerprints; a text of fewer words is one shingle. Links connect all that is similar, but not
    every similar pair is given. near gives links (a, b) of distinct SimHash fingerprints (fp): which sets are compared first. most_reorders and most_late bound what goes to the end of the order: cost, not results.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    spark = texts.sparkSession
    bits = int(np.clip(np.ceil(np.log2(max(1, texts.select("id").count()) * 8)), 16, MOST_BITS))
    texts = texts.withColumn("spot", F.pmod(F.xxhash64("id"), F.lit(1 << bits)))
    prefixes = saved(coded(texts, n, seed, percent, []), "prefixes")
    prints = saved(prefixes.select("id", "run", "fp"), "prints")
    sets = prefixes.groupBy("fp").agg(F.min("id").alias("least"), F.first("print").alias("print"), F.first("n").alias("n"), F.first("hist").alias("hist"), F.first("codes").alias("codes"))
    sets = saved(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    discard(prefixes)
    named = saved(sets.select("node", "fp", "print", "least", "n", "hist"), "nodes")
    nodes = named.select("node", "fp", "least")

    def whole(wanted: DataFrame, part: int | None, late: list[int], before: int = 0) -> DataFrame:
        """(node, n, codes, fresh) of the wanted nodes, whose texts are picked at the scan."""
        wanted = saved(nodes.join(wanted, "node"), "wanted")
        chosen = spark.sparkContext.broadcast(bit_filter(wanted.select(F.pmod(F.xxhash64("least"), F.lit(1 << bits)).alias("spot")), bits))
        got = coded(texts, n, seed, part, late, before, chosen).alias("g")
        # Of the rows of an id those with the set's own fingerprint count; null ids are equal here.
        met = got.join(wanted.alias("w"), (F.col("g.fp") == F.col("w.fp")) & F.col("g.id").eqNullSafe(F.col("w.least")))
        out = saved(met.select("w.node", "g.n", "g.codes", "g.fresh").dropDuplicates(["node"]), "whole")
        discard(wanted)
        return out

    late: list[int] = []

    def frequent(crowd: DataFrame) -> list[int]:
        """Shingles that more than pair_bucket of the given nodes have anywhere, the most frequent first; none of `late`.

        All of them, not those alone that came up first: else what is moved makes room for the next of the same passage.
        Rows are picked by two filters, of ids and of ids with digests: a few rows more may count, which changes cost only.
        """
        wanted = saved(nodes.join(crowd, "node").select("least", "fp"), "wanted")
        spot = F.pmod(F.xxhash64("least"), F.lit(1 << bits))
        chosen, own = (spark.sparkContext.broadcast(bit_filter(wanted.select(x.alias("spot")), bits)) for x in (spot, marks(spot, bits)))
        # Codes stay in the task that makes them: they are the bulk of the data, and here it doesn't matter whose they are.
        # One Python function picks and codes: each one more in a task is one more worker, and an executor keeps them all.
        full = saved(coded(texts, n, seed, None, [], 0, chosen, own).select("codes"), "crowd")
        counts = saved(repeated(full).groupBy("code").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > pair_bucket), "counts")
        known = listed(spark, late)
        got = counts.join(F.broadcast(known), "code", "left_anti").orderBy(F.desc("size"), "code").limit(most_late).collect()
        discard(wanted, full, counts)
        return [r.code for r in got]

    layers = [sets.select("node", "n", "codes")]
    for turn in range(most_reorders + 1):
        posts = posted(layers)
        sizes = saved(posts.groupBy("code").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        crowd = posts.join(sizes.filter((F.col("size") > pair_bucket) & (F.col("code") < LAST)), "code", "left_semi").select("node").distinct()
        more = frequent(crowd) if turn < most_reorders else []
        if not more or len(late) + len(more) > most_late:
            break
        late += more
        changed = reduce(DataFrame.union, [holding(x, more) for x in layers]).distinct()
        layers.append(whole(changed, percent, late, len(late) - len(more)))
        discard(posts, sizes)
    discard(sets, *layers[1:])
    shared = saved(posts.join(sizes, "code"), "shared")

    def alike(common, a, b):
        """Whether `common` shingles of two sets of a and b make at least percent of the union."""
        return common * (100 + percent) >= (a + b) * percent

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (a, b, n_a, n_b, hist_a, hist_b) whose histograms leave room for enough in common."""
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (4, 5))
            both = np.minimum(x, y)
            most, n = both.sum(axis=1, dtype=np.int64), b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            yield b.select(["a", "b"]).filter(pa.array((most * (100 + percent) >= n * percent) | (both == FULL).any(axis=1)))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose whole sets are similar."""
        hist = lambda c: named.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"hist_{c}"))
        met = pairs.select("a", "b").join(hist("a"), "a").join(hist("b"), "b").select("a", "b", "n_a", "n_b", "hist_a", "hist_b")
        pairs = saved(met.mapInArrow(trimmed(possible), "a long, b long"), "candidates")
        full = whole(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), None, [])
        side = lambda c: full.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("codes").alias(f"codes_{c}"))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        out = saved(both.filter(alike(F.size(F.array_intersect("codes_a", "codes_b")), F.col("n_a"), F.col("n_b"))).select("a", "b"), "links")
        discard(full, pairs)
        return out

    # Sets of linked fingerprints: one of each fingerprint meets those of others, and all of its own.
    ones = saved(named.groupBy("print").agg(F.min("node").alias("one")), "fingerprints")
    one = lambda c: ones.select(F.col("print").alias(f"print_{c}"), F.col("one").alias(c))
    across = near(ones.select(F.col("print").alias("fp"))).select(F.col("a").alias("print_a"), F.col("b").alias("print_b")).join(one("a"), "print_a").join(one("b"), "print_b").select("a", "b")
    within = named.select("node", "print").join(ones, "print").filter("node <> one").select(F.col("one").alias("a"), F.col("node").alias("b"))
    told = across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # Full buckets: each member meets PIVOTS of its length band; each bucket has its own, so that a crowd has many.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))) if percent < 100 else F.col("n")
    full = shared.filter(F.col("size") > pair_bucket).withColumn("band", band)
    pivots = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("code", "node", F.lit(k))) for k in range(PIVOTS))))
    first = full.groupBy("code", "band").agg(pivots.alias("ones"))
    star = full.join(first, ["code", "band"]).select("node", F.explode("ones").alias("one")).filter("one <> node")
    star = star.select(F.least("one", "node").alias("a"), F.greatest("one", "node").alias("b")).distinct()
    # Of their first shingles those that other sets have, too: no others are common.
    firsts = posts.join(star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").groupBy("node", "n").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    side = lambda c: firsts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("codes").alias(f"codes_{c}"))
    mu = F.least(F.element_at("codes_a", -1), F.element_at("codes_b", -1))
    star = star.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", F.filter("codes_a", lambda x: x <= mu).alias("x"), F.filter("codes_b", lambda x: x <= mu).alias("y"))
    most = F.size(F.array_intersect("x", "y")) + F.least(F.col("n_a") - F.size("x"), F.col("n_b") - F.size("y"))
    linked = verified(star.filter(alike(most, F.col("n_a"), F.col("n_b"))).select("a", "b").union(told).distinct())
    # A row a node, not a row a shingle, meets the roots.
    roots = nodes.select("node").join(components(linked).select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    members = saved(shared.join(roots, "node"), "members")
    discard(posts, sizes, shared, ones)

    # All other pairs. From its first shared shingle on, a set that is similar to another has enough left for both: so each
    # bounds the other's size there, by `most`. The smaller of two sets has most >= n, and those without, which are the
    # larger part of a crowd that is alike but not similar, are not joined with one another.
    members = members.withColumn("most", F.expr(f"(n - pos) * {100 + percent}L div {percent}L - n"))
    side = lambda c: members.select("code", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("pos").alias(f"pos_{c}"), F.col("root").alias(f"root_{c}"), F.col("most").alias(f"most_{c}"), "size")
    columns = ["a", "b", "n_a", "n_b", "pos_a", "pos_b"]
    lesser, other = side("a").filter("most_a >= n_a"), side("b").drop("size")
    fits = F.expr("(n_a < n_b or n_a = n_b and a < b) and n_b <= most_a and n_a <= most_b")
    met = lesser.filter(F.col("size") <= pair_bucket).join(other, "code").filter(fits & (F.col("root_a") != F.col("root_b"))).select(columns)
    bounds = [f(x).alias(f"{name}_{x}") for f, name in ((F.min, "least"), (F.max, "greatest")) for x in ("n", "most")]
    crowd = members.filter(F.col("size") > pair_bucket)
    groups = lambda c, rows: rows.groupBy("code", "root").agg(*bounds).select("code", *(F.col(x).alias(f"{x}_{c}") for x in ("root", "least_n", "greatest_n", "greatest_most")))
    room = F.expr("root_a <> root_b and least_n_a <= greatest_n_b and least_n_b <= greatest_most_a and least_n_a <= greatest_most_b")
    couples = groups("a", crowd.filter("most >= n")).join(groups("b", crowd), "code").filter(room).select("code", "root_a", "root_b")
    far = couples.join(lesser.drop("size"), ["code", "root_a"]).join(other, ["code", "root_b"]).filter(fits)
    counted = met.union(far.select(columns)).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("c"), F.max("pos_a").alias("i"), F.max("pos_b").alias("j"))
    most = F.col("c") + F.least(F.col("n_a") - F.col("i") - 1, F.col("n_b") - F.col("j") - 1)
    rest = verified(counted.filter(alike(most, F.col("n_a"), F.col("n_b"))).select("a", "b"))
    discard(members)
    return prints.select("id", "run", "fp"), nodes, linked.union(rest)
