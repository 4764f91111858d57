"""SimHash near-dedup by pigeonhole blocks.

Fingerprints at most two bits apart differ in at most two of the blocks, so they agree in all of some choice of the
others: they are joined on those, then the Hamming distance is verified. Buckets that are too full for pairs use another
exact way: each member names the fingerprints one bit away, and members that name the same one are two bits apart at most.

No 64-bit fingerprint can tell a Jaccard similarity of 0.8: texts as alike are up to 14 bits apart. Where `percent` asks
for a similarity, linked fingerprints say which shingle sets are compared first; the exact check and the pairs that no
fingerprint tells are the sets' own (see shingle_sets).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm import shingle_sets
from peakloom.llm.components import SALTS, components, named_components
from peakloom.llm.shared import annotate, meet, saved
from peakloom.llm.shingle_sets import BYTE_BITS


def fingerprint(text: bytes | None, n: int, seed: int, xxh64) -> int:
    """A bit is 1 if set in over half of the shingles' hashes, repeats included; 0 for a text without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    m = max(1, len(w) - n + 1)
    parts = [w[i : i + m] for i in range(min(n, len(w)))]
    h = np.array([xxh64(x, seed) for x in map(b" ".join, zip(*parts))], "<u8")
    octets = h.view(np.uint8).reshape(-1, 8)
    if m < 64:
        ones = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "little")


def fingerprints(docs: DataFrame, *, text_col: str = "text", n: int = 3, seed: int = 42, into: str = "fp") -> DataFrame:
    """docs with the column `into`: the 64-bit fingerprint as a signed long; a column of that name is replaced.

    A-Z lower-cased; words are runs without ASCII white space, shingles n words joined by spaces (fewer words: all of
    them); null counts as empty.
    """

    def make():
        import xxhash

        def of(texts: list[bytes | None], _: pa.RecordBatch) -> list[tuple]:
            got = np.array([fingerprint(t, n, seed, xxhash.xxh64_intdigest) for t in texts], np.uint64).view(np.int64)
            return [(x,) for x in got.tolist()]

        return of

    return annotate(docs, text_col, into, "v long", make).withColumn(into, F.col(f"`{into}`.v"))


def links(prints: DataFrame, distance: int, blocks: int, pair_bucket: int) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp, one row each) up to two bits apart.

    Not every pair is given: in a bucket of more than pair_bucket members, members are linked through the fingerprints
    that lie a bit from both. That way is exact for distance 2 only.
    """
    if distance != 2 or not 2 < blocks <= 16:
        raise ValueError("the distance is 2, and there are 3 to 16 blocks")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - 2)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        mask -= (mask >= 1 << 63) << 64
        keys.append(F.struct(F.lit(no).alias("no"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    keyed = prints.select("fp", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"), F.explode(F.array(*keys)).alias("k")).select("fp", "salt", "k.no", "k.key")
    # A bucket of one member links nothing, so only shared keys go on.
    sizes = saved(keyed.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = saved(meet(keyed, sizes, ["no", "key"], "salt"), "buckets")
    few = shared.filter(F.col("n") <= pair_bucket)
    pairs = (
        few.select("no", "key", F.col("fp").alias("a"))
        .join(few.select("no", "key", F.col("fp").alias("b")), ["no", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    # A fingerprint also names itself, so that neighbours one bit apart meet.
    many = shared.filter(F.col("n") > pair_bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - ((k == 63) << 64)).cast("long") for k in range(64)))
    named = many.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("near"))
    hubs = named.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("near", "a")
    return pairs.union(named.join(hubs, "near").filter("a < fp").select("a", F.col("fp").alias("b"))).distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    seed: int = 42,
    distance: int = 2,
    blocks: int = 5,
    pair_bucket: int = 64,
    percent: int | None = None,
) -> DataFrame:
    """One row for each row of docs: id_col, fp, component_id (the smallest id that links reach, its own included).

    Fingerprints (long) link at two or fewer differing bits. With percent, texts link instead if their sets of n-word
    shingles have a Jaccard similarity of percent / 100 or more, and fp is the set's digest (string): linked SimHash
    fingerprints of the sets come first, each checked, then all that they leave open.

    Texts without words have the same fingerprint and are linked like any other. Repeated rows and equal fingerprints
    are one node; null ids count as larger than all others. Other columns of docs are ignored; empty input, empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("run"))
    if percent is not None:
        prints, nodes, edges = shingle_sets.similar(texts, n=n, seed=seed, percent=percent, pair_bucket=pair_bucket, near=lambda x: links(x, distance, blocks, pair_bucket))
        every = named_components(nodes, edges, "node").join(nodes.select("node", "fp"), "node").select("fp", "component_id")
    else:
        prints = saved(fingerprints(texts, text_col="text", n=n, seed=seed).select("id", "run", "fp"), "fingerprints")
        nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
        every = named_components(nodes, links(nodes.select("fp"), distance, blocks, pair_bucket), "fp")
    return meet(prints.select("id", "run", "fp"), saved(every, "components"), ["fp"], "run").select(F.col("id").alias(id_col), "fp", "component_id")
