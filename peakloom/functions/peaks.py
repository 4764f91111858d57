"""Functions of one spectrum's peaks: an array of struct(mz, intensity), in the spectrum's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: an expression that a lambda holds is computed at each of its steps."""
    return F.transform(F.array(value), use)[0]


def zipped(mz: Column, intensity: Column) -> Column:
    """struct(mz, intensity) of two parallel arrays."""
    return F.zip_with(mz, intensity, lambda a, b: F.struct(a.cast("double").alias("mz"), b.cast("double").alias("intensity")))


def valid(mz: Column, intensity: Column, least: int = 1) -> Column:
    """Parallel arrays of at least `least` finite numbers, m/z above zero, intensity not below."""
    fine = F.forall(mz, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0)) & F.forall(intensity, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0))
    return F.coalesce((F.size(mz) == F.size(intensity)) & (F.size(mz) >= least) & fine, F.lit(False))


def windowed(peaks: Column, low: float, high: float, least_intensity: float = 0.0) -> Column:
    return F.filter(peaks, lambda p: p["mz"].between(low, high) & (p["intensity"] >= least_intensity))


def strongest(peaks: Column, n: int, in_order: bool = True) -> Column:
    """The n peaks of largest intensity (ties: the earlier); in the spectrum's order, or by descending intensity."""
    placed = F.transform(peaks, lambda p, i: F.struct((-p["intensity"]).alias("key"), i.alias("at"), p.alias("peak")))
    top = F.slice(F.array_sort(placed), 1, n)
    if in_order:
        top = F.array_sort(F.transform(top, lambda t: F.struct(t["at"].alias("at"), t["peak"].alias("peak"))))
    return F.transform(top, lambda t: t["peak"])


def _scaled(peaks: Column, of) -> Column:
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), of(p["intensity"]).alias("intensity")))


def intensities(peaks: Column) -> Column:
    return F.transform(peaks, lambda p: p["intensity"])


def to_base_peak(peaks: Column) -> Column:
    return let(peaks, lambda ps: let(F.array_max(intensities(ps)) + 1e-12, lambda top: _scaled(ps, lambda x: x / top)))


def to_range(peaks: Column) -> Column:
    """Minimum to 0, maximum to 1; a constant spectrum has no scale: NaN."""
    def scaled(ps: Column) -> Column:
        ends = F.struct(F.array_min(intensities(ps)).alias("low"), F.array_max(intensities(ps)).alias("high"))
        return let(ends, lambda e: _scaled(ps, lambda x: F.coalesce(F.try_divide(x - e["low"], e["high"] - e["low"]), F.lit(float("nan")))))

    return let(peaks, scaled)


def root_share(peaks: Column) -> Column:
    """Square roots, divided by their sum."""
    total = lambda ps: F.aggregate(intensities(ps), F.lit(0.0), lambda a, x: a + x) + 1e-11
    return let(_scaled(peaks, F.sqrt), lambda roots: let(total(roots), lambda t: _scaled(roots, lambda x: x / t)))


def search_filter(peaks: Column, precursor_mz: Column, low: float, high: float, tolerance: float, least_share: float, n: int) -> Column:
    """Window, precursor removed (within the tolerance), intensity above a share of the largest, n strongest, root shares."""
    inside = F.filter(peaks, lambda p: p["mz"].between(low, high))
    off = F.filter(inside, lambda p: F.abs(p["mz"] - precursor_mz) > tolerance)
    strong = let(off, lambda ps: let(F.array_max(intensities(ps)), lambda top: F.filter(ps, lambda p: p["intensity"] > least_share * top)))
    return root_share(strongest(strong, n))


def released_model_peaks(peaks: Column, low: float, high: float, floor: float, n: int) -> Column:
    """Window, n strongest by intensity above a floor, roots of unit length, m/z over `high`; a sentinel if nothing is left."""
    inside = strongest(windowed(peaks, low, high, floor), n)
    norm = lambda ps: F.sqrt(F.aggregate(intensities(ps), F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda ps, n: F.transform(ps, lambda p: F.struct((p["mz"] / high).alias("mz"), F.try_divide(p["intensity"], n).alias("intensity")))
    sentinel = F.array(F.struct(F.lit(0.0).alias("mz"), F.lit(1.0).alias("intensity")))
    return let(_scaled(inside, F.sqrt), lambda ps: F.when(F.size(ps) > 0, let(norm(ps), lambda n: unit(ps, n))).otherwise(sentinel))


def clusters(peaks: Column, apart) -> Column:
    """Sorted peaks as an array of runs: a new one begins where apart(before, peak) holds. Each peak is copied once."""
    def cut(ps: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: (i == 1) | apart(F.get(ps, i - 2), F.get(ps, i - 1)))
        run = lambda ss: F.transform(ss, lambda s, k: F.slice(ps, s, F.coalesce(F.get(ss, k + 1), F.size(ps) + 1) - s))
        return F.when(F.size(ps) > 0, let(starts, run)).otherwise(F.slice(F.array(ps), 1, 0))

    return let(peaks, cut)


def _centre(c: Column) -> Column:
    """Weighted mean m/z (plain where nothing has intensity)."""
    total = lambda f: F.aggregate(F.transform(c, f), F.lit(0.0), lambda a, x: a + x)
    weight = total(lambda p: p["intensity"])
    return F.when(weight > 0, total(lambda p: p["mz"] * p["intensity"]) / weight).otherwise(total(lambda p: p["mz"]) / F.size(c))


def _sum(c: Column) -> Column:
    return F.aggregate(F.transform(c, lambda p: p["intensity"]), F.lit(0.0), lambda a, x: a + x)


def merged(peaks: Column, ppm: float) -> Column:
    """Peaks by m/z; a peak within ppm of the one before joins its cluster: weighted mean m/z and summed intensity."""
    runs = clusters(F.array_sort(peaks), lambda a, b: b["mz"] - a["mz"] > b["mz"] * ppm / 1e6)
    return F.transform(runs, lambda c: F.struct(_centre(c).alias("mz"), _sum(c).alias("intensity")))


def distractor_count(anchor: Column, distractor: Column, strength: float) -> Column:
    """Peaks of a distractor to mix in: a share of the anchor's count, one at least, as many as there are at most."""
    n = F.least(F.floor(F.size(anchor) * F.lit(strength)).cast("int"), F.size(distractor))
    return F.when(F.lit(strength) > 0, F.greatest(n, F.least(F.lit(1), F.size(distractor)))).otherwise(0)


def mixed(anchor: Column, distractor: Column, ppm: float, scale: str | None = None) -> Column:
    """Both spectra's peaks: struct(mz, intensity, origin), origin 0 for the anchor's own, 1 for the distractor's, 2 for both.

    Each side's neighbours closer than ppm of their midpoint are merged first, then those of what both sides have become.
    scale: "range" brings intensities to 0 up to 1 (to 0 where all are equal), "base" divides by the largest, None leaves them.
    """
    apart = lambda a, b: ~(b["mz"] - a["mz"] < ppm * 1e-6 * (a["mz"] + b["mz"]) / 2)
    side = lambda ps, k: F.transform(clusters(F.array_sort(ps), apart), lambda c: F.struct(_centre(c).alias("mz"), F.lit(k).alias("origin"), _sum(c).alias("intensity")))
    own = lambda c: F.array_distinct(F.transform(c, lambda p: p["origin"]))
    both = clusters(F.array_sort(F.concat(side(anchor, 0), side(distractor, 1))), apart)
    made = F.transform(both, lambda c: F.struct(_centre(c).alias("mz"), _sum(c).alias("intensity"), F.when(F.size(own(c)) > 1, 2).otherwise(F.get(own(c), F.lit(0))).alias("origin")))
    if scale is None:
        return made

    def scaled(ps: Column) -> Column:
        x = F.transform(ps, lambda p: p["intensity"])
        low = F.array_min(x) if scale == "range" else F.lit(0.0)
        return F.transform(ps, lambda p: F.struct(p["mz"].alias("mz"), F.coalesce(F.try_divide(p["intensity"] - low, F.array_max(x) - low), F.lit(0.0)).alias("intensity"), p["origin"].alias("origin")))

    return let(made, scaled)


def running_merge(peaks: Column, ppm: float) -> Column:
    """As merged, but a peak is compared with its cluster's centroid so far."""
    start = F.array().cast("array<struct<mz:double,intensity:double>>")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = lambda c, p: F.struct(((c["mz"] * c["intensity"] + p["mz"] * p["intensity"]) / (c["intensity"] + p["intensity"])).alias("mz"), (c["intensity"] + p["intensity"]).alias("intensity"))
    return F.aggregate(
        F.array_sort(F.filter(peaks, lambda p: p["intensity"] > 0)), start,
        lambda acc, p: F.when((F.size(acc) > 0) & (p["mz"] - last(acc)["mz"] <= p["mz"] * ppm / 1e6), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined(last(acc), p)))).otherwise(F.concat(acc, F.array(p))),
    )


def binned(peaks: Column, high: float, bins: int) -> Column:
    """Intensities summed into `bins` left-open bins of (0, high], ends clamped, over the largest bin; as many numbers as bins."""
    width = high / bins
    placed = F.transform(peaks, lambda p: F.struct(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(p["mz"] / width).cast("int") - 1)).alias("bin"), p["intensity"].alias("x")))
    sums = lambda held: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.aggregate(F.filter(held, lambda q: q["bin"] == b), F.lit(0.0), lambda a, q: a + q["x"]))
    scaled = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.when(top > 0, x / top).otherwise(x)))
    return let(let(placed, sums), scaled)


def window_purity(peaks: Column, mz: Column, charge: Column, half_width: float, tolerance_ppm: float, isotopes: int = 4) -> Column:
    """Share of a window's intensity that lies on the precursor's isotope places; spacing 1.0033548 over the charge."""
    inside = F.filter(peaks, lambda p: F.abs(p["mz"] - mz) <= half_width)
    places = F.transform(F.sequence(F.lit(0), F.lit(isotopes - 1)), lambda k: mz + k * 1.0033548 / charge)
    own = F.filter(inside, lambda p: F.exists(places, lambda q: F.abs(p["mz"] - q) <= q * tolerance_ppm / 1e6))
    total = lambda ps: F.aggregate(intensities(ps), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total(own), total(inside))


def weighted_subset(peaks: Column, key: Column, n: Column) -> Column:
    """n peaks without replacement, likelier the stronger they are, in the spectrum's order; key decides the draw."""
    u = lambda i: (F.pmod(F.xxhash64(key, i), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    placed = F.transform(peaks, lambda p, i: F.struct((-(F.log(F.greatest(p["intensity"], F.lit(1e-12))) - F.log(-F.log(u(i))))).alias("key"), i.alias("at"), p.alias("peak")))
    top = F.array_sort(F.transform(F.slice(F.array_sort(placed), 1, n), lambda t: F.struct(t["at"].alias("at"), t["peak"].alias("peak"))))
    return F.transform(top, lambda t: t["peak"])


def uniform_subset(peaks: Column, key: Column, n: Column) -> Column:
    """n peaks, each alike, in the spectrum's order; key decides the draw."""
    placed = F.transform(peaks, lambda p, i: F.struct(F.xxhash64(key, i).alias("key"), i.alias("at"), p.alias("peak")))
    top = F.array_sort(F.transform(F.slice(F.array_sort(placed), 1, n), lambda t: F.struct(t["at"].alias("at"), t["peak"].alias("peak"))))
    return F.transform(top, lambda t: t["peak"])


def crop_size(peaks: Column, scale: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(peaks) * scale).cast("int"))


def random_window(peaks: Column, key: Column, scale: float) -> Column:
    """A run of neighbouring peaks; key decides where it starts."""
    n = crop_size(peaks, scale)
    start = F.pmod(F.xxhash64(key), F.greatest(F.size(peaks) - n + 1, F.lit(1))).cast("int")
    return F.slice(peaks, start + 1, n)
