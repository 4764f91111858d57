"""The operators' queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import bpe, centroids, decontaminate, exact_dedup, line_dedup, merkle, secrets, sharding, simhash, substring_dedup, token_counts, top_k, toxicity
from peakloom.plans.scratch import shared_root
from peakloom.session import table


def sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return got.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", sha256("text").alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "toxicity.score", "toxicity.predicted", F.size("toxicity.spans").cast("long").alias("n_spans"))


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents").select("doc_id", "text"), choice="largest")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache stays: a folder in the shared folder for each folder of tables, so a second run encodes nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{shared_root(spark)}/token-cache-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts.count_tokens(docs, path=public_tokenizers.path("word_bpe_49k.json"), counter="words", limit=2048, cache_path=cache)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16, slack=0.0)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, distance=2)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path=path, pattern=public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, path=path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=10)
    c = "contamination"
    return got.select("doc_id", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items", F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"), (F.col(f"{c}.n_hit") > 0).alias("contaminated"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), n=13)
    return got.select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", sha256("text").alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), dim=64, scale=64, k=16, rounds=3, seed="1")
    return got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folded_root comes from the rows as presented: where 7 divides crc32(doc_id), n_chars is one larger."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    presented = [F.col(c) + tampered.cast("long") if c == "n_chars" else F.col(c) for c in fields]
    got = merkle.manifest(docs, fields=fields, carry={"presented": merkle.leaf(presented)})
    folded = merkle.climbed(F.col("presented"), F.col("path"))
    return got.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), queries="id % 50 = 0", k=5, scale=256)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_exact_dedup, op4_secret_scan, op5_token_counts, op6_sharding, op7_simhash, op8_byte_bpe, op9_decontaminate, op10_substring_dedup, op11_centroids, op12_merkle, op13_top_k)}

def lloyd_sql(rounds: int) -> str:
    """The rounds of centroid clustering, unrolled."""
    out = """
        WITH kept AS MATERIALIZED (
            SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept) ORDER BY h, v LIMIT 16),"""
    for k in range(rounds + 1):
        out += f"""
        d{k} AS MATERIALIZED (
            SELECT vec_id, v, c AS cluster, d AS distance FROM (
                SELECT *, row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) AS no FROM (
                    SELECT vec_id, v, c, list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM kept, c{k})) WHERE no = 1),"""
        if k < rounds:
            out += f"""
        p{k} AS (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM d{k}, range(1, 65) r(i) GROUP BY ALL),
        c{k + 1} AS MATERIALIZED (
            SELECT c, coalesce(new, m) AS m FROM c{k}
            LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new FROM p{k} GROUP BY cluster) ON c = cluster),"""
    return out + f"""
        means AS (SELECT c, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM c{rounds})
        SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM d{rounds} JOIN means ON c = cluster"""


def leaf_sql(n_chars: str) -> str:
    texts = [f"{x}::VARCHAR" for x in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')" for x in texts) + ")"


MERKLE_SQL = f"""
    WITH RECURSIVE crc_table(b, k, c) AS (
        SELECT b, 0, b::BIGINT FROM range(256) r(b)
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE k < 8),
    crc_of(doc_id, s, i, c) AS (
        SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, ''), 0, 4294967295 FROM documents
        UNION ALL SELECT doc_id, s, i + 1, xor(o.c >> 8, t.c) FROM crc_of o JOIN crc_table t ON t.k = 8 AND t.b = xor(o.c, ascii(s[i + 1])) & 255 WHERE i < length(s)),
    leaves AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS no
        FROM (SELECT d.doc_id, lang, {leaf_sql("n_chars")} AS leaf, {leaf_sql("(n_chars + (xor(c, 4294967295) % 7 = 0)::BIGINT)").replace("doc_id::", "d.doc_id::")} AS shown
              FROM documents d JOIN (SELECT doc_id AS id, c FROM crc_of WHERE i = length(s)) ON d.doc_id IS NOT DISTINCT FROM id)),
    nodes(lang, lvl, pos, h, n) AS (
        SELECT lang, 0, pos, leaf, n FROM leaves
        UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
    subs AS MATERIALIZED (
        SELECT lang, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place, count(*) OVER () AS m FROM nodes WHERE n = 1),
    tops(lvl, pos, h, n) AS (
        SELECT 0, place, subroot, m FROM subs
        UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
    both_trees AS MATERIALIZED (
        SELECT coalesce(lang, chr(0)) AS tree, lvl, pos, h FROM nodes UNION ALL SELECT chr(1), lvl, pos, h FROM tops),
    steps AS (
        SELECT no, coalesce(lang, chr(0)) AS tree, lvl, pos >> lvl AS own, lvl AS k FROM leaves JOIN subs s USING (lang), range(64) r(lvl) WHERE lvl < depth
        UNION ALL SELECT no, chr(0), lvl, pos >> lvl, lvl FROM leaves l JOIN subs s ON l.lang IS NULL AND s.lang IS NULL, range(64) r(lvl) WHERE lvl < depth
        UNION ALL SELECT no, chr(1), lvl, place >> lvl, depth + lvl FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang, range(64) r(lvl) WHERE lvl < (SELECT max(lvl) FROM tops)),
    siblings AS MATERIALIZED (
        SELECT no, k, own & 1 = 1 AS is_left, coalesce(h, '') AS h FROM steps x LEFT JOIN both_trees t ON x.tree = t.tree AND x.lvl = t.lvl AND t.pos = xor(x.own, 1)),
    folds(no, k, acc) AS (
        SELECT no, 0, shown FROM leaves
        UNION ALL SELECT f.no, f.k + 1, sha256(CASE WHEN is_left THEN h || acc ELSE acc || h END) FROM folds f JOIN siblings s ON f.no = s.no AND f.k = s.k),
    proofs AS (SELECT no, sha256(string_agg(h, '' ORDER BY k)) AS proof, count(*) AS total FROM siblings GROUP BY no),
    top AS (SELECT h AS root FROM tops WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, acc AS folded_root, acc = root AS verified
    FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN proofs p USING (no) JOIN folds f ON f.no = l.no AND f.k = coalesce(total, 0), top"""


SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
            FROM documents),
        keyed AS (SELECT *, trim({LOWER.format('line')}, {SPACE}) AS key FROM lines),
        frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY no), '')) AS kept_sha256
        FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_decontaminate": f"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
        test AS (
            SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
                SELECT item_id, unnest([w[i:i + 9] FOR i IN range(1, greatest(1, len(w) - 9) + 1)]) AS win FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM test),
        own AS (
            SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM (
                SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM words, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, pos, o.n, item_id FROM own o JOIN test t ON o.win = t.win AND o.n = t.n),
        hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_substring_dedup": """
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (
            SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS win FROM (
                SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words WHERE len(w) >= 13)),
        firsts AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS k FROM win JOIN firsts USING (win) WHERE doc_id > first),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words),
        kept AS (
            SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS kept FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_centroids": lloyd_sql(3),
    "op12_merkle": MERKLE_SQL,
    "op13_top_k": """
        WITH kept AS MATERIALIZED (
            SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, t.vec_id, list_sum([q.v[i] * t.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
            FROM kept q JOIN kept t ON q.vec_id <> t.vec_id AND len(q.v) = len(t.v) WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
