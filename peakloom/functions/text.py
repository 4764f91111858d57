"""Text and peptide label functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, and those that stand for false.
MISSING = ("", "nan", "none", "null")
FALSE = ("", "0", "false", "no", "nan", "none")
# Notations of modifications (case is ignored) and what each is written as.
NAMED_DELTAS = [
    (r"M\(ox\)", "M+15.995"), (r"M\[Oxidation\]", "M+15.995"), (r"C\[Carbamidomethyl\]", "C+57.021"), (r"([NQ])\[Deamidated\]", "$1+0.984"),
    (r"\[Acetyl\]-", "+42.011"), (r"\[Carbamyl\]-", "+43.006"), (r"\[Ammonia-loss\]-", "-17.027"),
]
# Monoisotopic residue masses, water, proton.
RESIDUES = {
    "G": 57.021464, "A": 71.037114, "S": 87.032028, "P": 97.052764, "V": 99.068414, "T": 101.047670, "C": 103.009185, "L": 113.084064, "I": 113.084064,
    "N": 114.042927, "D": 115.026943, "Q": 128.058578, "K": 128.094963, "E": 129.042593, "M": 131.040485, "H": 137.058912, "F": 147.068414,
    "R": 156.101111, "Y": 163.063329, "W": 186.079313,
}
WATER, PROTON = 18.010565, 1.00727646688
LABEL = r"^([+-]\d+(\.\d+)?)*([ACDEFGHIKLMNPQRSTVWYO]([+-]\d+(\.\d+)?)*)+$"
TOKEN = r"[A-Z]([+-]\d+(\.\d+)?)*|[+-]\d+(\.\d+)?"


def as_text(x: Column) -> Column:
    """Trimmed; words for a missing value, and null, become the empty text."""
    t = F.coalesce(F.trim(x), F.lit(""))
    return F.when(F.lower(t).isin(*MISSING), "").otherwise(t)


def truthy(x: Column) -> Column:
    return ~F.lower(F.coalesce(F.trim(x), F.lit(""))).isin(*FALSE)


def normal_run(path: Column) -> Column:
    """A run's name: the last part of its path without endings, lower case, without a leading accession."""
    name = F.regexp_extract(as_text(path), r"([^/]+)/*$", 1)
    name = F.regexp_replace(F.lower(name), r"\.gz$", "")
    name = F.regexp_replace(name, r"\.(mgf|mzml|raw|mzxml)$", "")
    return F.regexp_replace(name, r"^pxd\d+_", "")


def scan_number(x: Column) -> Column:
    """A whole number, alone or at the end after "=" or ":"; else null."""
    return F.nullif(F.regexp_extract(as_text(x.cast("string")), r"(?:^|[=:])\s*(\d+)\s*$", 1), F.lit("")).try_cast("bigint")


def first_integer(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"-?\d+", 0), F.lit("")).try_cast("bigint")


def title_parts(title: Column) -> Column:
    """struct(run, scan) of titles such as run:scan:123 or run.123.123.2."""
    t, named, dotted = as_text(title), r"(?i)^(.+?):scan:(\d+)$", r"^(.+?)\.(\d+)\.\d+(?:\.\d+)?"
    part = lambda k: F.when(t.rlike(named), F.regexp_extract(t, named, k)).otherwise(F.nullif(F.regexp_extract(t, dotted, k), F.lit("")))
    return F.struct(part(1).alias("run"), part(2).try_cast("bigint").alias("scan"))


def canonical_label(x: Column) -> Column:
    """A peptide label with numeric deltas, or null where it isn't one: an unknown modification is never erased."""
    t = F.translate(as_text(x), " _", "")
    for pattern, delta in NAMED_DELTAS:
        t = F.regexp_replace(t, f"(?i){pattern}", delta)
    t = F.upper(t)
    return F.when(t.rlike(LABEL), t)


def residue_tokens(label: Column) -> Column:
    """Deltas before the first residue on their own, then each residue with its deltas."""
    return F.regexp_extract_all(label, F.lit(TOKEN), F.lit(0))


def split_residues(label: Column) -> Column:
    return F.split(label, r"(?<=.)(?=[A-Z])")


def backbone(label: Column) -> Column:
    return F.regexp_replace(label, "[^A-Z]", "")


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def vocabulary_ids(tokens: Column, vocabulary: list[str], unknown: int | None = None) -> Column:
    """Places in the sorted vocabulary, from 0. An unknown token gets `unknown`, or makes all null."""
    table = F.array(*(F.lit(t) for t in sorted(vocabulary)))
    ids = F.transform(tokens, lambda t: F.array_position(table, t).cast("int") - 1)
    if unknown is not None:
        return F.transform(ids, lambda i: F.when(i < 0, unknown).otherwise(i))
    return F.when(~F.exists(ids, lambda i: i < 0), ids)


def from_ids(ids: Column, vocabulary: list[str], pad: int, end: int) -> Column:
    """Text of ids: pads go, and what follows the first end."""
    table = F.array(*(F.lit(t) for t in sorted(vocabulary)))
    kept = F.filter(ids, lambda i: i != pad)
    at = F.array_position(kept, end)
    kept = F.when(at > 0, F.slice(kept, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(kept)
    return F.array_join(F.transform(kept, lambda i: F.get(table, i)), "")


def metric_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[^0-9A-Za-z_./-]+", "_"), r"^_+|_+$", "")


def charge_bucket(z: Column, spec: str) -> Column:
    """The first bucket of a list such as "1-4,5,7+" that holds z; else null."""
    out = F.lit(None).cast("string")
    for part in reversed(spec.split(",")):
        part = part.strip()
        low, _, high = part.partition("-")
        here = z >= int(part[:-1]) if part.endswith("+") else z.between(int(low), int(high or low))
        out = F.when(here, part).otherwise(out)
    return out


def peptide_mass(tokens: Column) -> Column:
    """Sum of residue masses and deltas, plus water; null for an unknown residue."""
    residues = F.create_map(*(F.lit(v) for k in RESIDUES.items() for v in k))
    one = lambda t: F.coalesce(F.try_element_at(residues, F.substring(t, 1, 1)), F.when(t.rlike(r"^[+-]"), F.lit(0.0))) + F.aggregate(
        F.transform(F.regexp_extract_all(t, F.lit(r"[+-]\d+(\.\d+)?"), F.lit(0)), lambda d: d.cast("double")), F.lit(0.0), lambda a, d: a + d
    )
    return F.aggregate(F.transform(tokens, one), F.lit(WATER), lambda a, m: a + m)


# Audited UniMod ids and the numeric delta that stands for each.
UNIMOD_DELTAS = {1: "+42.011", 4: "+57.021", 5: "+43.006", 7: "+0.984", 21: "+79.966", 35: "+15.995", 385: "-17.027"}
# Deltas that numbers within 0.00051 of them are written as.
KNOWN_DELTAS = (0.984, 15.995, 42.011, 43.006, 57.021, 79.966, -17.027)


def unimod_label(x: Column) -> Column:
    """A label with (UniMod:n), [UNIMOD:n] written as deltas; null if another id remains or it isn't a label."""
    t = as_text(x)
    for n, delta in UNIMOD_DELTAS.items():
        t = F.regexp_replace(t, rf"(?i)[\[(]unimod:{n}[\])]-?", delta.replace("$", r"\$"))
    t = F.upper(F.regexp_replace(t, "^_|_$", ""))
    return F.when(~t.contains("UNIMOD:") & t.rlike(LABEL), t)


def numeric_label(x: Column) -> Column:
    """A label whose deltas stand in brackets or parentheses, such as M[+15.995] or (+42.011)PEP."""
    t = F.regexp_replace(as_text(x), r"[\[(]([+-]?\d+(?:\.\d+)?)[\])]", "$1")
    t = F.upper(F.regexp_replace(t, r"([A-Za-z])(\d)", "$1+$2"))
    return F.when(t.rlike(LABEL), t)


def in_vocabulary(tokens: Column, vocabulary: list[str]) -> Column:
    return F.coalesce(F.forall(tokens, lambda t: t.isin(*vocabulary)), F.lit(False))


def snapped_delta(x: Column) -> Column:
    """The known delta within 0.00051 of x, else x."""
    out = x
    for d in KNOWN_DELTAS:
        out = F.when(F.abs(x - d) <= 0.00051, F.lit(d)).otherwise(out)
    return out


def vocabulary_tokens(label: Column, vocabulary: list[str], aliases: dict[str, str] | None = None, leucine: bool = False, reverse: bool = False) -> Column:
    """Tokens of a label, longest first; aliases are written as what they stand for.

    Deltas before the first residue come first whatever the order; leucine writes I as L; reverse turns the rest round.
    """
    import re

    names = sorted({*vocabulary, *(aliases or {})}, key=lambda t: (-len(t), t))
    text = F.translate(label, "I", "L") if leucine else label
    tokens = F.regexp_extract_all(text, F.lit("|".join(map(re.escape, names))), F.lit(0))
    for a, t in (aliases or {}).items():
        tokens = F.transform(tokens, _renamed(a, t))
    first = F.filter(tokens, lambda t: t.rlike(r"^[+-]"))
    rest = F.filter(tokens, lambda t: ~t.rlike(r"^[+-]"))
    return F.concat(first, F.reverse(rest) if reverse else rest)


def _renamed(old: str, new: str):
    return lambda x: F.when(x == old, new).otherwise(x)


def rounded_aliases(vocabulary: list[str], digits: tuple[int, ...] = (2, 1, 0)) -> dict[str, str]:
    """Deltas rounded to fewer digits, where only one token of the vocabulary rounds to them."""
    import re

    found: dict[str, set[str]] = {}
    for t in vocabulary:
        for k in digits:
            short = re.sub(r"[+-]\d+\.\d+", lambda m: f"{float(m.group()):+.{k}f}", t)
            if short != t:
                found.setdefault(short, set()).add(t)
    return {a: next(iter(ts)) for a, ts in found.items() if len(ts) == 1 and a not in vocabulary}


def species_of(name: Column, prefixes: dict[str, str]) -> Column:
    """The species whose prefix a name starts with; another name stops the job."""
    out = F.raise_error(F.concat(F.lit("no species for "), name)).cast("string")
    for p, species in reversed(prefixes.items()):
        out = F.when(F.lower(name).startswith(p.lower()), species).otherwise(out)
    return out


def acquisition(name: Column) -> Column:
    """The batch of a run's name: what stands before its last number, else the name."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+?)[_-]?\d+$", 1), F.lit("")), name)


def rate_suffix(x: Column) -> Column:
    """0.01 as 0p01."""
    return F.replace(x.cast("string"), F.lit("."), F.lit("p"))


def with_deltas(sequence: Column, places: Column, residue: str, token: str) -> Column:
    """The sequence with token after its residues at the given places (an array, from 1), put in from the right.

    A place outside the sequence, or where another residue stands, stops the job. A place given twice gets two tokens;
    null places change nothing; a null sequence stays null.
    """

    def put(done: Column, p: Column) -> Column:
        # All that has been put in stands further right, so places still count from the sequence's start.
        right = (p >= 1) & (p <= F.length(sequence)) & (F.substr(done, p, F.lit(1)) == residue)
        wrong = F.raise_error(F.concat(F.lit(f"no {residue} at place "), p.cast("string"), F.lit(" of "), sequence))
        return F.when(right, F.concat(F.substr(done, F.lit(1), p), F.lit(token), F.substr(done, p + 1))).otherwise(wrong)

    return F.when(sequence.isNotNull(), F.aggregate(F.sort_array(F.coalesce(places, F.array().cast("array<int>")), asc=False), sequence, put))
