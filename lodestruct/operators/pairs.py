"""Formulas over a pair table, summed per atom or per system.

A full list holds both directions of a pair, so each of its rows counts half; a half list's rows count whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import bspline, bspline_slope, erfc, switch_c2, switch_c2_slope
from ..functions.vectors import cell_inverse, cell_volume, column_norms, dot, elements, row_times, to_fractional, vec
from ..structures import POSITION, StructureSet
from . import small

D = ("dx", "dy", "dz")
SQRT_PI = math.sqrt(math.pi)
#: Atoms of a system up to which its reciprocal sums and its mesh are computed in one row.
FEW = 512


def with_atoms(pairs: DataFrame, atoms: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs with the attributes of both atoms, as i_<name> and j_<name>; those that came along with the pairs are not joined again."""
    columns = [c for c in columns if not {f"i_{c}", f"j_{c}"} <= set(pairs.columns)]
    for end in ("i", "j") if columns else ():
        side = atoms.select("system_id", F.col("atom_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        pairs = pairs.join(side, ["system_id", end])
    return pairs


def pair_aggregate(pairs: DataFrame, exprs: dict[str, Column], level: str = "system", half: bool = False) -> DataFrame:
    """Sums of expressions over pairs: of each system, or of each atom. Per atom a full list needs only its own rows, each pair halved; a half list gives each atom its half."""
    weight = 1.0 if half else 0.5
    if level == "system":
        return pairs.groupBy("system_id").agg(*[F.sum(e * weight).alias(n) for n, e in exprs.items()])
    if level != "atom":
        raise ValueError("level must be system or atom")
    rows = pairs.select("system_id", F.col("i").alias("atom_id"), *[(e * 0.5).alias(n) for n, e in exprs.items()])
    if half:
        rows = rows.unionByName(pairs.select("system_id", F.col("j").alias("atom_id"), *[(e * 0.5).alias(n) for n, e in exprs.items()]))
    return rows.groupBy("system_id", "atom_id").agg(*[F.sum(n).alias(n) for n in exprs])


def forces(pairs: DataFrame, over_r: Column, half: bool = False) -> DataFrame:
    """(system_id, atom_id, fx, fy, fz) from ``over_r``, minus the slope of the pair energy over the distance."""
    f = pairs.withColumn("_k", over_r)
    out = f.select("system_id", F.col("i").alias("atom_id"), *[(F.col("_k") * F.col(d)).alias(c) for d, c in zip(D, ("fx", "fy", "fz"))])
    if half:
        out = out.unionByName(f.select("system_id", F.col("j").alias("atom_id"), *[(-F.col("_k") * F.col(d)).alias(c) for d, c in zip(D, ("fx", "fy", "fz"))]))
    return out.groupBy("system_id", "atom_id").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "fz")])


def virial(pairs: DataFrame, over_r: Column, half: bool = False) -> DataFrame:
    """(system_id, virial of nine): sum of r (x) F over pairs, each once."""
    w = 1.0 if half else 0.5
    parts = [F.sum(over_r * F.col(a) * F.col(b) * w).alias(f"w{k}") for k, (a, b) in enumerate((a, b) for a in D for b in D)]
    return pairs.groupBy("system_id").agg(*parts).select("system_id", F.array(*[f"w{k}" for k in range(9)]).alias("virial"))


def _potential(pairs: DataFrame, energy: Column, over_r: Column, out: str, half: bool) -> DataFrame:
    p = pairs.filter("r > 0")
    if out == "energy":
        return pair_aggregate(p, {"energy": energy}, "system", half)
    if out == "atom_energy":
        return pair_aggregate(p, {"energy": energy}, "atom", half)
    if out == "forces":
        return forces(p, over_r, half)
    if out == "virial":
        return virial(p, over_r, half)
    raise ValueError("out must be energy, atom_energy, forces or virial")


def lj(pairs: DataFrame, eps: float = 1.0, sigma: float = 1.0, out: str = "energy", half: bool = False, switch: tuple[float, float] | None = None) -> DataFrame:
    """Lennard-Jones 4 eps ((sigma/r)^12 - (sigma/r)^6), optionally switched off between two distances. Pairs at distance 0 have no value and are left out; search strictly to reject them."""
    s6 = F.pow(sigma / F.col("r"), F.lit(6.0))
    e = 4 * eps * (s6 * s6 - s6)
    k = 24 * eps * (2 * s6 * s6 - s6) / (F.col("r") * F.col("r"))
    if switch:
        w, slope = switch_c2("r", *switch), switch_c2_slope(F.col("r"), *switch)
        k, e = k * w - e * slope / F.col("r"), e * w
    return _potential(pairs, e, k, out, half)


def coulomb(pairs: DataFrame, atoms: DataFrame, alpha: float | str = 0.0, out: str = "energy", half: bool = False, charge: str = "q") -> DataFrame:
    """q_i q_j erfc(alpha r) / r; alpha 0: no damping, a string: a column of the pairs."""
    p = with_atoms(pairs.filter("r > 0"), atoms, [charge])
    r, qq = F.col("r"), F.col(f"i_{charge}") * F.col(f"j_{charge}")
    damp = erfc(f"{alpha} * r") if alpha else F.lit(1.0)
    alpha = F.col(alpha) if isinstance(alpha, str) else alpha
    e = qq * damp / r
    k = qq * (damp / r + (2 * alpha / SQRT_PI) * F.exp(-(alpha * r * alpha * r))) / (r * r)
    return _potential(p, e, k, out, half)


def ewald_real(pairs: DataFrame, atoms: DataFrame, alpha: float | DataFrame, out: str = "energy", half: bool = False, charge: str = "q") -> DataFrame:
    """The real-space sum over pairs with one alpha, or with each system's own alpha up to its own cutoff, from ``ewald_parameters``."""
    if isinstance(alpha, DataFrame):
        pairs = pairs.join(alpha.select("system_id", "alpha", "r_cutoff"), "system_id").filter("r < r_cutoff")
        alpha = "alpha"
    return coulomb(pairs, atoms, alpha, out, half, charge)


def dsf(pairs: DataFrame, atoms: DataFrame, alpha: float, cutoff: float, half: bool = False, charge: str = "q", out: str = "energy") -> DataFrame:
    """The damped shifted force sum. (system_id, energy) has the self term, which systems without pairs have alone; out "forces" and "virial" have none."""
    r = F.col("r")
    erfc_c = math.erfc(alpha * cutoff)
    slope = erfc_c / cutoff**2 + 2 * alpha / SQRT_PI * math.exp(-((alpha * cutoff) ** 2)) / cutoff
    p = with_atoms(pairs.filter("r > 0"), atoms, [charge])
    qq, damp = F.col(f"i_{charge}") * F.col(f"j_{charge}"), erfc(f"{alpha!r} * r")
    e = qq * (damp / r - erfc_c / cutoff + slope * (r - cutoff))
    k = qq * (damp / (r * r) + (2 * alpha / SQRT_PI) * F.exp(-((alpha * r) ** 2)) / r - slope) / r
    found = _potential(p, e, k, out, half)
    if out != "energy":
        return found
    self_ = atoms.groupBy("system_id").agg((F.sum(F.col(charge) * F.col(charge)) * -(erfc_c / (2 * cutoff) + alpha / SQRT_PI)).alias("energy"))
    return combine([found, self_])


def combine(parts: Sequence[DataFrame], keys: Sequence[str] = ("system_id",), rename: dict[str, str] | None = None) -> DataFrame:
    """Contributions of the same keys added column by column; what a part lacks counts as zero."""
    parts = [p.withColumnsRenamed(rename or {}) for p in parts]
    names = list(dict.fromkeys(c for p in parts for c in p.columns if c not in keys))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return out.na.fill(0.0, names)


# ---- Ewald summation


def ewald_parameters(ss: StructureSet, eps: float = 1e-6, alpha: float | str | None = None) -> DataFrame:
    """(system_id, eta, alpha, r_cutoff, k_cutoff): where both sums have fallen to ``eps``.

    eta follows from the volume and the number of atoms, or from ``alpha`` (a number, or a column of systems; null: from the
    volume). Systems without atoms have no row.
    """
    n = ss.atoms.groupBy("system_id").agg(F.count("*").alias("n"))
    given = F.col(alpha) if isinstance(alpha, str) else F.lit(alpha).cast("double")
    s = ss.systems.select("system_id", cell_volume(F.col("cell")).alias("v"), given.alias("given")).join(n, "system_id")
    eta = F.coalesce(1 / (math.sqrt(2) * F.col("given")), F.pow(F.col("v") * F.col("v") / F.col("n"), F.lit(1 / 6)) / math.sqrt(2 * math.pi))
    root = math.sqrt(-2 * math.log(eps))
    return s.withColumn("eta", eta).select("system_id", "eta", (1 / (math.sqrt(2) * F.col("eta"))).alias("alpha"), (root * F.col("eta")).alias("r_cutoff"), (root / F.col("eta")).alias("k_cutoff"))


def k_vectors(systems: DataFrame, k_cutoff: float | str | None = None, bounds: Sequence[int] | None = None, digits: int | None = None) -> DataFrame:
    """(system_id, h, k, l, kx, ky, kz): half of the reciprocal vectors in a box of Miller indices, without zero.

    The box holds all vectors up to ``k_cutoff``, a number or a column of systems, or is given by ``bounds``; it is not cut
    to a sphere. Systems are dealt over all tasks first, as each becomes many rows. Boxes of up to 2^20 vectors are made
    once for all systems if they have few different cells, or once for those of a task that have the same cell. With ``digits`` components are rounded.
    """
    if (k_cutoff is None) == (bounds is None):
        raise ValueError("give either k_cutoff or bounds")
    cut = F.col(k_cutoff) if isinstance(k_cutoff, str) else F.lit(k_cutoff)
    s = systems.select("system_id", F.col("cell"), cut.cast("double").alias("cut"))
    rows = column_norms([F.col("cell")[3 * (k % 3) + k // 3] for k in range(9)])  # lengths of the lattice vectors
    tops = [F.lit(bounds[k]) if bounds else F.floor(F.col("cut") * rows[k] / (2 * math.pi)).cast("int") for k in range(3)]
    large = (tops[0].cast("double") + 1) * (2 * tops[1].cast("double") + 1) * (2 * tops[2].cast("double") + 1) > small.STEP
    few = small.vectors(s.filter(~F.coalesce(large, F.lit(False))), F.col("cut"), bounds, digits)
    if bounds and math.prod((bounds[0] + 1, 2 * bounds[1] + 1, 2 * bounds[2] + 1)) <= small.STEP:
        return few
    s = s.filter(large).withColumn("inv", cell_inverse(F.col("cell")))
    for name, top in zip("hkl", tops):
        s = s.withColumn(name, F.explode(F.sequence(F.lit(0) if name == "h" else -top, top)))
    s = s.filter("h > 0 or (h = 0 and (k > 0 or (k = 0 and l > 0)))")
    inv = elements(F.col("inv"))
    g = [2 * math.pi * (inv[3 * c] * F.col("h") + inv[3 * c + 1] * F.col("k") + inv[3 * c + 2] * F.col("l")) for c in range(3)]
    g = g if digits is None else [F.round(x, digits) + F.lit(0.0) for x in g]
    return few.unionByName(s.select("system_id", "h", "k", "l", *[x.alias(n) for x, n in zip(g, ("kx", "ky", "kz"))]))


def structure_factor(atoms: DataFrame, kvecs: DataFrame, charge: str = "q") -> DataFrame:
    """(system_id, h, k, l, kx, ky, kz, re, im): sum of q exp(i k r); atoms meet their system's vectors only."""
    phase = F.col("kx") * F.col("x") + F.col("ky") * F.col("y") + F.col("kz") * F.col("z_pos")
    # their number is not known before they are made, so the vectors must not be taken for a small table
    j = atoms.select("system_id", *POSITION, charge).join(kvecs.hint("merge"), "system_id")
    return j.groupBy("system_id", "h", "k", "l", "kx", "ky", "kz").agg(F.sum(F.col(charge) * F.cos(phase)).alias("re"), F.sum(F.col(charge) * F.sin(phase)).alias("im"))


def structure_factors(ss: StructureSet, k_cutoff: float | str | None = None, bounds: Sequence[int] | None = None, charge: str = "q", digits: int | None = None) -> DataFrame:
    """(system_id, h, k, l, re, im) for every system and each of its ``k_vectors``, with ``digits`` rounded.

    Systems of few atoms are summed in a row each, where a wave is a product of one along each reciprocal axis; those of
    many by way of a row for each atom and vector.
    """
    if (k_cutoff is None) == (bounds is None):
        raise ValueError("give either k_cutoff or bounds")
    cut = F.col(k_cutoff) if isinstance(k_cutoff, str) else F.lit(k_cutoff)
    few, many = small.split_by_size(ss, FEW)
    found = small.factors(few, cut, bounds, charge, digits)
    if many is None:
        return found
    s = structure_factor(many.atoms, k_vectors(many.systems, k_cutoff, bounds), charge).drop("kx", "ky", "kz")
    return found.unionByName(s if digits is None else s.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in ("re", "im")}))


def _parameters(ss: StructureSet, alpha: float | DataFrame, k_cutoff: float | None = None) -> StructureSet:
    """Systems with columns alpha and k_cutoff: the same for all, or those of a table of parameters."""
    if isinstance(alpha, DataFrame):
        own = alpha.select("system_id", F.col("alpha").alias("_alpha"), F.col("k_cutoff").alias("_k_cutoff"))
        s = ss.systems.select("system_id", "cell").join(own, "system_id")
        return ss.with_(systems=s.withColumnsRenamed({"_alpha": "alpha", "_k_cutoff": "k_cutoff"}))
    return ss.with_(systems=ss.systems.select("system_id", "cell", F.lit(float(alpha)).alias("alpha"), F.lit(k_cutoff).cast("double").alias("k_cutoff")))


def _large_recip(ss: StructureSet, bounds: Sequence[int] | None, charge: str, out: str) -> DataFrame:
    """Reciprocal sums by way of every structure factor."""
    k = vec(("kx", "ky", "kz"))
    vectors = k_vectors(ss.systems, bounds=bounds) if bounds else k_vectors(ss.systems, "k_cutoff")
    s = structure_factor(ss.atoms, vectors, charge).join(ss.systems.select("system_id", "alpha", cell_volume(F.col("cell")).alias("v")), "system_id")
    k2, width = dot(k, k), 1 / (4 * F.col("alpha") * F.col("alpha"))
    green = 4 * math.pi / F.col("v") * F.exp(-k2 * width) / k2  # half space: each vector stands for two
    e = green * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    if out == "energy":
        return s.groupBy("system_id").agg(F.sum(e).alias("energy"))
    if out == "virial":
        stretch = 2 * (1 / k2 + width)
        parts = [F.sum(e * ((1.0 if a == b else 0.0) - stretch * k[a] * k[b])).alias(f"w{3 * a + b}") for a in range(3) for b in range(3)]
        return s.groupBy("system_id").agg(*parts).select("system_id", F.array(*[f"w{n}" for n in range(9)]).alias("virial"))
    factors = s.select("system_id", "kx", "ky", "kz", (2 * green * F.col("re")).alias("a"), (2 * green * F.col("im")).alias("b")).hint("merge")  # never broadcast
    j = ss.atoms.select("system_id", F.col("atom_id").cast("long").alias("atom_id"), *POSITION, charge).join(factors, "system_id")
    j = j.withColumn("phase", F.col("kx") * F.col("x") + F.col("ky") * F.col("y") + F.col("kz") * F.col("z_pos"))
    j = j.withColumn("g", F.col(charge) * (F.col("a") * F.sin("phase") - F.col("b") * F.cos("phase")))
    return j.groupBy("system_id", "atom_id").agg(*[F.sum(F.col("g") * x).alias(c) for x, c in zip(k, ("fx", "fy", "fz"))])


def ewald_recip(ss: StructureSet, alpha: float | DataFrame, k_cutoff: float | None = None, bounds: Sequence[int] | None = None, out: str = "energy", charge: str = "q") -> DataFrame:
    """Reciprocal sum: (system_id, energy), "forces" (system_id, atom_id, fx, fy, fz) or "virial" (system_id, virial of nine).

    ``alpha`` is a number, with ``k_cutoff`` or ``bounds`` for all, or a table of ``ewald_parameters``: each system then
    has its own alpha and box of vectors.
    """
    if not isinstance(alpha, DataFrame) and (k_cutoff is None) == (bounds is None):
        raise ValueError("give either k_cutoff or bounds")
    if out not in small.KINDS:
        raise ValueError("out must be energy, forces or virial")
    ss = _parameters(ss, alpha, k_cutoff)
    few, many = small.split_by_size(ss, FEW)
    found = small.recip(few, bounds, charge, out)
    return found if many is None else found.unionByName(_large_recip(many, bounds, charge, out))


def ewald_self(ss: StructureSet, alpha: float | DataFrame, charge: str = "q") -> DataFrame:
    """Minus the self and the background term."""
    q = ss.atoms.groupBy("system_id").agg(F.sum(F.col(charge) * F.col(charge)).alias("q2"), F.sum(charge).alias("q"))
    q, a = q.join(_parameters(ss, alpha).systems.select("system_id", "alpha", cell_volume(F.col("cell")).alias("v")), "system_id"), F.col("alpha")
    return q.select("system_id", (-a / SQRT_PI * F.col("q2") - math.pi / (2 * a * a) * F.col("q") * F.col("q") / F.col("v")).alias("energy"))


def ewald(ss: StructureSet, pairs: DataFrame | None, alpha: float | DataFrame, k_cutoff: float | None = None, bounds: Sequence[int] | None = None, half: bool = False, charge: str = "q") -> DataFrame:
    """Real plus reciprocal minus self and background energy of each system with atoms.

    With a table of ``ewald_parameters`` as ``alpha`` each system has its own alpha and cutoffs, and the energy does not
    depend on them beyond their eps. ``pairs`` must then reach each system's r_cutoff; None searches for them.
    """
    if pairs is None:
        if not isinstance(alpha, DataFrame):
            raise ValueError("a search for pairs needs a table of parameters")
        from .neighbors import neighbor_pairs

        near = ss.systems.select("system_id", "cell", "pbc").join(alpha.select("system_id", "r_cutoff"), "system_id")
        pairs = neighbor_pairs(ss.with_(systems=near), "r_cutoff", half=half, carry=(charge,))
    return combine([ewald_real(pairs, ss.atoms, alpha, half=half, charge=charge), ewald_recip(ss, alpha, k_cutoff, bounds, charge=charge), ewald_self(ss, alpha, charge)])


def slab_correction(ss: StructureSet, charge: str = "q") -> DataFrame:
    """2 pi / V (M^2 - Q M2 - Q^2 L^2 / 12) along the open axis of systems with exactly one; 0 for others."""
    s = ss.systems.select("system_id", "cell", "pbc", cell_volume(F.col("cell")).alias("v"))
    open_ = F.aggregate("pbc", F.lit(0), lambda n, p: n + F.when(p, 0).otherwise(1))
    s = s.withColumn("axis", F.when(open_ == 1, F.array_position("pbc", F.lit(False)).cast("int") - 1))
    a = ss.atoms.join(s, "system_id")
    along = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z_pos"))
    length = F.when(F.col("axis") == 0, F.sqrt(dot([F.col("cell")[k] for k in range(3)], [F.col("cell")[k] for k in range(3)]))).when(F.col("axis") == 1, F.sqrt(dot([F.col("cell")[k] for k in (3, 4, 5)], [F.col("cell")[k] for k in (3, 4, 5)]))).otherwise(F.sqrt(dot([F.col("cell")[k] for k in (6, 7, 8)], [F.col("cell")[k] for k in (6, 7, 8)])))
    q = F.col(charge)
    m = a.withColumns({"_z": along, "_l": length}).groupBy("system_id").agg(F.sum(q).alias("t"), F.sum(q * F.col("_z")).alias("m"), F.sum(q * F.col("_z") * F.col("_z")).alias("m2"), F.first("v").alias("v"), F.first("_l").alias("l"), F.first("axis").alias("axis"))
    e = 2 * math.pi / F.col("v") * (F.col("m") * F.col("m") - F.col("t") * F.col("m2") - F.col("t") * F.col("t") * F.col("l") * F.col("l") / 12)
    return ss.systems.select("system_id").join(m, "system_id", "left").select("system_id", F.when(F.col("axis").isNotNull(), e).otherwise(0.0).alias("energy"))


# ---- mesh


#: Grid points along an axis of a block of a mesh; atoms are dealt by system and block.
BLOCK = 32


def _block(point: Column, dim: int) -> Column:
    return F.floor(F.pmod(point, F.lit(dim)) / BLOCK).cast("int")


def mesh_points(ss: StructureSet, dims: Sequence[int], order: int, columns: Sequence[str] = ()) -> DataFrame:
    """Atoms times the order^3 grid points they reach: gx, gy, gz, weight, and the weight's slope along each fractional axis (sa, sb, sc)."""
    s = ss.systems.select("system_id", cell_inverse(F.col("cell")).alias("inv"))
    a = ss.atoms.select("system_id", "atom_id", *POSITION, *columns)
    f = to_fractional(vec(POSITION), elements(F.col("inv")))
    # dealt before each atom becomes order^3 rows: what is summed per system (and block) and point then needs no other exchange
    if max(dims) <= BLOCK:
        a = a.repartition("system_id").join(s, "system_id").withColumns({f"u{k}": f[k] * dims[k] for k in range(3)} | {"block": F.lit(0)})
    else:
        a = a.join(s, "system_id").withColumns({f"u{k}": f[k] * dims[k] for k in range(3)})
        a = a.withColumn("block", F.struct(*[_block(F.floor(f"u{k}"), dims[k]) for k in range(3)])).repartition("system_id", "block")
    for k in range(3):
        a = a.withColumn(f"o{k}", F.explode(F.array(*[F.lit(o) for o in range(order)])))
    # one step after the other: each value is named before it is used more than once, so no expression is repeated
    a = a.withColumns({f"t{k}": F.col(f"u{k}") - F.floor(F.col(f"u{k}")) + F.col(f"o{k}") for k in range(3)})
    splines = {f"w{k}": bspline(F.col(f"t{k}"), order) for k in range(3)}
    slopes = {f"s{k}": bspline_slope(F.col(f"t{k}"), order) * dims[k] if order > 1 else F.lit(0.0) for k in range(3)}
    a = a.withColumns(splines | slopes)
    w, s_ = ([F.col(f"{c}{k}") for k in range(3)] for c in "ws")
    point = [F.pmod(F.floor(F.col(f"u{k}")) - F.col(f"o{k}"), F.lit(dims[k])).cast("int").alias(f"g{n}") for k, n in enumerate("xyz")]
    return a.select(
        "system_id", "atom_id", "block", *columns, "inv", *point,
        (w[0] * w[1] * w[2]).alias("weight"), (s_[0] * w[1] * w[2]).alias("sa"), (w[0] * s_[1] * w[2]).alias("sb"), (w[0] * w[1] * s_[2]).alias("sc"),
    )


def spread(ss: StructureSet, dims: Sequence[int], order: int = 4, channels: Sequence[str] = ("q",)) -> DataFrame:
    """Values of atoms on a periodic grid: (system_id, gx, gy, gz, one column per channel), points that get nothing left out.

    A mesh of more than BLOCK points along an axis is cut into blocks, and each is summed where its atoms are, so one large
    system spreads over all tasks; only points within order - 1 of the next block get parts from both, which are added up.
    Smaller meshes of systems of few atoms are made in a row each, without a row for each atom and point.
    """
    if max(dims) > BLOCK:
        return _spread(ss, dims, order, channels)
    few, many = small.split_by_size(ss, FEW)
    found = small.spread(few, dims, order, channels)
    return found if many is None else found.unionByName(_spread(many, dims, order, channels))


def _spread(ss: StructureSet, dims: Sequence[int], order: int, channels: Sequence[str]) -> DataFrame:
    keys, add = ["system_id", "gx", "gy", "gz"], lambda of: [*[F.sum(of(c)).alias(c) for c in channels], F.max("weight").alias("weight")]
    m = mesh_points(ss, dims, order, channels)
    if max(dims) <= BLOCK:
        m = m.groupBy(*keys).agg(*add(lambda c: F.col("weight") * F.col(c)))
    else:
        m = m.groupBy(*keys, "block").agg(*add(lambda c: F.col("weight") * F.col(c)))
        shared = reduce(lambda x, y: x | y, [_block(F.col(g), d) != _block(F.col(g) + order - 1, d) for g, d in zip(keys[1:], dims)])
        border = m.filter(shared).groupBy(*keys).agg(*add(F.col))
        m = m.filter(~shared).select(border.columns).unionByName(border)
    return m.filter("weight > 0").drop("weight")


def gather(mesh: DataFrame, ss: StructureSet, dims: Sequence[int], order: int = 4, channels: Sequence[str] = ("q",), gradient: bool = False) -> DataFrame:
    """(system_id, atom_id, channels): mesh values at the atoms; with ``gradient`` also d<channel>_dx, _dy, _dz. Absent points are 0."""
    p = mesh_points(ss, dims, order).join(mesh.select("system_id", "gx", "gy", "gz", *channels), ["system_id", "gx", "gy", "gz"], "left")
    out = {}
    for c in channels:
        v = F.coalesce(c, F.lit(0.0))
        out[c] = F.sum(F.col("weight") * v)
        if gradient:
            inv = elements(F.col("inv"))
            for k, x in enumerate("xyz"):
                slope = dot([F.col("sa"), F.col("sb"), F.col("sc")], inv[3 * k : 3 * k + 3])
                out[f"d{c}_d{x}"] = F.sum(slope * v)
    return p.groupBy("system_id", "atom_id").agg(*[e.alias(n) for n, e in out.items()])


def through_mesh(ss: StructureSet, dims: Sequence[int], order: int = 4, channels: Sequence[str] = ("q",), gradient: bool = False) -> DataFrame:
    """``gather`` of ``spread`` on the same atoms. For systems of few atoms both steps are one and no mesh leaves a row."""
    few, many = small.split_by_size(ss, FEW)
    found = small.through_mesh(few, dims, order, channels, gradient)
    return found if many is None else found.unionByName(gather(_spread(many, dims, order, channels), many, dims, order, channels, gradient))


# ---- dispersion


def _bonded(radii: Column, k1: float) -> Column:
    """Part of a neighbour at distance r that counts, given the sum of both covalent radii."""
    return 1 / (1 + F.exp(-k1 * (radii / F.col("r") - 1)))


def _by_element(pairs: DataFrame, atoms: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs with parameters of both elements as i_<name> and j_<name>; where z came along with the pairs, no atom is looked up."""
    p = with_atoms(pairs, atoms, ["z"])
    for end in ("i", "j"):
        p = p.join(F.broadcast(table.select(F.col("z").alias(f"{end}_z"), *[F.col(c).alias(f"{end}_{c}") for c in columns])), f"{end}_z")
    return p


def coordination(pairs: DataFrame, atoms: DataFrame, rcov: DataFrame, k1: float = 16.0) -> DataFrame:
    """(system_id, atom_id, cn) of all atoms over a full list; ``rcov`` (z, rcov) has a row per element and is broadcast."""
    p = _by_element(pairs.filter("r > 0"), atoms, rcov, ["rcov"])
    cn = p.groupBy("system_id", F.col("i").alias("atom_id")).agg(F.sum(_bonded(F.col("i_rcov") + F.col("j_rcov"), k1)).alias("cn"))
    return atoms.select("system_id", "atom_id").join(cn, ["system_id", "atom_id"], "left").na.fill(0.0, ["cn"])


def dispersion_d3(pairs: DataFrame, atoms: DataFrame, elements_: DataFrame, grid: DataFrame, a1: float = 0.4, a2: float = 4.5, s6: float = 1.0, s8: float = 1.0, k1: float = 16.0, k3: float = 4.0, switch: tuple[float, float] | None = None, out: str = "energy") -> DataFrame:
    """(system_id, energy): -1/2 sum S (s6 C6 / (r^6 + f^6) + s8 C8 / (r^8 + f^8)), f = a1 sqrt(C8/C6) + a2, over a full list.

    ``elements_`` (z, rcov, r4r2) and ``grid`` (zi, zj, cni, cnj, c6) are parameter tables over elements, 25 grid rows a
    pair at most, and are broadcast. C6 is the mean over the grid weighted by exp(-k3 ((cn_i - cni)^2 + (cn_j - cnj)^2)),
    a product of a weight of each atom: those, one for each reference of its element, and their slopes are computed once an
    atom and travel with the pairs, where C6 is a bilinear form of them without an exponent.
    out "forces" and "virial" follow the energy's slope over the distance and over both coordination numbers, which depend
    on distances in turn; "atom_energy" halves each pair. Search pairs with z in ``carry``: elements are then known without a join.
    """
    cn = coordination(pairs, atoms, elements_, k1)
    ends = grid.select(F.col("zi").alias("z"), F.col("cni").alias("cn")).unionByName(grid.select(F.col("zj").alias("z"), F.col("cnj").alias("cn")))
    refs = ends.groupBy("z").agg(F.array_sort(F.collect_set("cn")).alias("refs"))
    place = lambda refs, cn: (F.array_position(refs, F.col(cn)) - 1).cast("int")
    points = grid.join(F.broadcast(refs.select(F.col("z").alias("zi"), F.col("refs").alias("ri"))), "zi").join(F.broadcast(refs.select(F.col("z").alias("zj"), F.col("refs").alias("rj"))), "zj")
    points = points.groupBy("zi", "zj").agg(F.collect_list(F.struct(place(F.col("ri"), "cni").alias("a"), place(F.col("rj"), "cnj").alias("b"), "c6")).alias("points"))
    off = lambda ref: F.col("cn") - ref
    own = atoms.select("system_id", "atom_id", "z").join(cn, ["system_id", "atom_id"]).join(F.broadcast(refs), "z")
    own = own.withColumn("w", F.transform("refs", lambda x: F.exp(-k3 * off(x) * off(x))))
    own = own.withColumn("dw", F.zip_with("refs", "w", lambda x, w: -2 * k3 * off(x) * w))
    p = _by_element(pairs.filter("r > 0"), atoms, elements_, ["rcov", "r4r2"])
    p = with_atoms(p, own, ["w"] if out in ("energy", "atom_energy") else ["w", "dw"])
    p = p.join(F.broadcast(points), (F.col("i_z") == F.col("zi")) & (F.col("j_z") == F.col("zj")))
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("w", "c", "dw", "dc")])
    if "i_dw" not in p.columns:
        p = p.withColumn("i_dw", F.col("i_w"))  # slopes are not asked for

    def add(acc: Column, g: Column) -> Column:
        w, dw = F.col("i_w")[g["a"]] * F.col("j_w")[g["b"]], F.col("i_dw")[g["a"]] * F.col("j_w")[g["b"]]
        return F.struct((acc["w"] + w).alias("w"), (acc["c"] + w * g["c6"]).alias("c"), (acc["dw"] + dw).alias("dw"), (acc["dc"] + dw * g["c6"]).alias("dc"))

    def mean(a: Column) -> Column:
        c6 = F.coalesce(F.try_divide(a["c"], a["w"]), F.lit(0.0))
        return F.struct(c6.alias("c6"), F.coalesce(F.try_divide(a["dc"] - c6 * a["dw"], a["w"]), F.lit(0.0)).alias("slope"))

    p = p.withColumn("at", F.aggregate("points", start, add, mean)).withColumns({"c6": F.col("at.c6"), "c6_slope": F.col("at.slope")})
    p = p.drop("points", "at", "zi", "zj", "i_w", "j_w", "i_dw", "j_dw")
    r = F.col("r")
    ratio = 3 * F.col("i_r4r2") * F.col("j_r4r2")
    f = a1 * F.sqrt(ratio) + a2
    p = p.withColumns({"n6": r**6 + f**6, "n8": r**8 + f**8, "ratio": ratio})
    shape = s6 / F.col("n6") + s8 * F.col("ratio") / F.col("n8")
    slope = -6 * s6 * r**5 / F.col("n6") ** 2 - 8 * s8 * F.col("ratio") * r**7 / F.col("n8") ** 2
    if switch:
        w = switch_c2("r", *switch)
        shape, slope = shape * w, slope * w + shape * switch_c2_slope(r, *switch)
    energy = -F.col("c6") * shape
    if out in ("energy", "atom_energy"):
        return _potential(p, energy, F.lit(0.0), out, False)
    by_cn = p.groupBy("system_id", F.col("i").alias("atom_id")).agg(F.sum(-F.col("c6_slope") * shape).alias("by_cn"))
    p = with_atoms(p, by_cn, ["by_cn"])
    radii = F.col("i_rcov") + F.col("j_rcov")
    p = p.withColumn("part", _bonded(radii, k1))
    closer = -F.col("part") * (1 - F.col("part")) * k1 * radii / (r * r)
    return _potential(p, energy, (F.col("c6") * slope - (F.col("i_by_cn") + F.col("j_by_cn")) * closer) / r, out, False)


def dispersion(ss: StructureSet, cutoff: float | str, elements_: DataFrame, grid: DataFrame, a1: float = 0.4, a2: float = 4.5, s6: float = 1.0, s8: float = 1.0, k1: float = 16.0, k3: float = 4.0, switch: tuple[float, float] | None = None, out: str = "energy") -> DataFrame:
    """``dispersion_d3`` over all pairs within ``cutoff``, a number or a column of systems.

    Systems of few atoms do all of it in a row each: pairs, coordination numbers and sums; no pair is shuffled. For these
    both parameter tables, without nulls, are collected and go with the tasks. Atom ids are unique in their system.
    """
    from .neighbors import _length, grid_spec, neighbor_pairs

    if out not in ("energy", "atom_energy", "forces", "virial"):
        raise ValueError("out must be energy, atom_energy, forces or virial")
    if isinstance(cutoff, str):
        ss = ss.with_(systems=ss.systems.filter(F.col(cutoff) > 0))
    elif cutoff <= 0:
        raise ValueError("cutoff must be positive")
    numbers = dict(a1=a1, a2=a2, s6=s6, s8=s8, k1=k1, k3=k3, switch=switch)
    few, many = small.split_by_size(ss, FEW) if isinstance(ss.atoms.schema["atom_id"].dataType, T.IntegralType) else (None, ss)
    parts = []
    if few is not None:
        tables = [tuple(map(tuple, t.select(*names).collect())) for t, names in ((elements_, ("z", "rcov", "r4r2")), (grid, ("zi", "zj", "cni", "cnj", "c6")))]
        parts.append(small.dispersion(few, grid_spec(few.systems, cutoff), _length(cutoff), small.Dispersion(*tables, **numbers), out))
    if many is not None:
        parts.append(dispersion_d3(neighbor_pairs(many, cutoff, carry=("z",)), many.atoms, elements_, grid, out=out, **numbers))
    return reduce(DataFrame.unionByName, parts)


def stress(systems: DataFrame, virial_: DataFrame) -> DataFrame:
    """(system_id, stress): minus the virial over the volume."""
    s = systems.select("system_id", cell_volume(F.col("cell")).alias("v")).join(virial_, "system_id")
    return s.select("system_id", F.transform("virial", lambda w: -w / F.col("v")).alias("stress"))


def cell_force(systems: DataFrame, stress_: DataFrame) -> DataFrame:
    """(system_id, cell_force): -V inverse(cell)^T stress."""
    s = systems.select("system_id", cell_volume(F.col("cell")).alias("v"), cell_inverse(F.col("cell")).alias("inv")).join(stress_, "system_id")
    inv, t = elements(F.col("inv")), elements(F.col("stress"))
    out = [-F.col("v") * x for r in range(3) for x in row_times([inv[r], inv[3 + r], inv[6 + r]], t)]
    return s.select("system_id", F.array(*out).alias("cell_force"))
