"""Secret scans: fixed patterns, plus character Markov models of random strings and of ordinary identifiers.

DataFrame and SQL functions only. One pass over the texts finds pattern matches and long tokens; all else works on those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm.shared import saved

# The kinds in their order, their patterns (Java syntax), the group that holds the secret, its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Only to find hex runs faster: no shorter run could count.
HEX_RUN = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def matches(text: Column, no: int, pattern: str, group: int = 0) -> Column:
    """Non-overlapping matches, leftmost first: array of (kind_no, no, step, n, value).

    n is a match's length, step adds what stands between it and the one before: running sums of steps are the ends.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), 1, F.size(found))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    each = F.transform(
        F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda x: F.length(x)).alias("n"), value.alias("value")),
        lambda x, i: F.struct(F.lit(no).alias("kind_no"), i.alias("no"), (x["gap"] + x["n"]).alias("step"), x["n"].alias("n"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<kind_no:int,no:int,step:int,n:int,value:string>>"))


def located(found: DataFrame) -> DataFrame:
    """found (row_no, matches) as rows (row_no, kind_no, start, end, value): base spans, and tokens that none overlaps.

    Windows by document: the ends are running sums, and a token is free if no base span before it ends, and none from it
    on starts, inside.
    """
    rows = found.select("row_no", F.explode("matches").alias("m")).repartition("row_no").select("row_no", "m.*")
    ends = rows.withColumn("end", F.sum("step").over(Window.partitionBy("row_no", "kind_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    base = F.col("kind_no") < len(KINDS)
    long = F.lit(False)
    for no, (_, _, least) in enumerate(KINDS.values()):
        long |= (F.col("kind_no") == no) & (F.length("value") >= least)
    kept = ends.withColumn("start", F.col("end") - F.col("n")).filter(long | ~base)
    # At one start base spans come first. Frames that begin at the first row take a step a row.
    order = lambda *by: Window.partitionBy("row_no").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    before = F.max(F.when(base, F.col("end"))).over(order("start", "kind_no"))
    after = F.min(F.when(base, F.col("start"))).over(order(F.desc("start"), F.desc("kind_no")))
    free = base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    return kept.withColumns({"before": before, "after": after}).filter(free).select("row_no", "kind_no", "start", "end", "value")


def fit(values: DataFrame, docs: DataFrame, text_col: str) -> list[float]:
    """Log-likelihood ratios of next characters, (len(ALPHABET) + 1) ** 2 values: random strings against identifiers.

    Labelled samples, from all documents: the distinct secrets of the base patterns, as they are and in capitals, and
    all other tokens, as often as they occur; a secret's value (column value, distinct) is no identifier. How a token begins tells nothing
    (ratio 0), so that a plain number isn't taken for a random string.
    """
    tokens = (
        docs.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(IDENTIFIER), F.lit(0))).alias("value"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(values, "value", "left_anti")
    )
    both = values.select(F.explode(F.array_distinct(F.array("value", F.upper("value")))).alias("value"))
    labelled = both.select("value", F.lit(1).alias("n"), F.lit(1).alias("secret")).union(tokens.select("value", "n", F.lit(0)))
    code = f"transform(split(value, ''), c -> instr('{ALPHABET}', c))"
    counts = (
        labelled.select("secret", "n", F.expr(code).alias("c"))
        .select("secret", "n", F.explode(F.expr("zip_with(concat(array(0), slice(c, 1, size(c) - 1)), c, (a, b) -> struct(a, b))")).alias("p"))
        .groupBy("secret", "p.a", "p.b")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most 2 * 68 * 67 rows
    )
    k = len(ALPHABET) + 1
    n = [[[0.5] * k for _ in range(k)] for _ in range(2)]
    for r in counts:
        n[r.secret][r.a][r.b] += r.n
    ratio = lambda a, b: math.log(n[1][a][b] / sum(n[1][a])) - math.log(n[0][a][b] / sum(n[0][a]))
    return [ratio(a, b) if a else 0.0 for a in range(k) for b in range(k)]


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_ratio: float = 0.25,
) -> DataFrame:
    """One row for each row of docs: id_col, base and added spans: arrays of (start, kind, end, value), in order.

    base holds the matches of KINDS; added holds tokens of 16 or more characters, overlapping no base span, whose mean
    log-likelihood ratio a character is at least least_ratio (kind "random"). start and end are code points, end is
    exclusive. Null counts as empty: no spans. Repeated rows stay. Where no base secret exists, no model can be
    trained and nothing is added. Other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = [(HEX_RUN if kind == "hex" else pattern, group) for kind, (pattern, group, _) in KINDS.items()] + [(TOKEN, 0)]
    found = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"), F.concat(*(matches(text, no, *p) for no, p in enumerate(patterns))).alias("matches"))
    found = saved(found, "secret-matches")
    spans = saved(located(found), "secret-spans")
    base = F.col("kind_no") < len(KINDS)
    values = saved(spans.filter(base).select("value").distinct(), "secret-values")
    if values.isEmpty():
        kept = spans.filter(base)
    else:
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in fit(values, docs, text_col))), ",").cast("array<double>")
        k = len(ALPHABET) + 1
        codes = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c))
        total = F.aggregate(
            codes,
            F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum")),
            lambda acc, c: F.struct(c.alias("prev"), (acc["sum"] + F.get(table, acc["prev"] * k + c)).alias("sum")),
            lambda acc: acc["sum"],
        )
        kept = spans.filter(base | (total / F.length("value") >= least_ratio))
    kind = F.element_at(F.array(*map(F.lit, [*KINDS, "random"])), F.col("kind_no") + 1)
    each = kept.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", kind.alias("kind"), "end", "value"))).alias("spans"))
    some = F.coalesce("spans", F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"))
    return found.select("id", "row_no").join(each, "row_no", "left").select(
        F.col("id").alias(id_col),
        F.filter(some, lambda x: x["kind_no"] < len(KINDS)).alias("base"),
        F.filter(some, lambda x: x["kind_no"] == len(KINDS)).alias("added"),
    )


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
