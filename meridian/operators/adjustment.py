"""Least-squares adjustment of many networks at once, and of one network too large for a task.

adjust() deals whole networks to groups in one shuffle, and a group's networks are estimated together in NumPy
(gauss_newton). A network too large for a task has its observation equations, normal equations and
vectors as tables over all executors (adjust_distributed).

stations: network_id, station, x (east), y (north), z (up), fixed boolean, and null components where a frame has none.
observations: network_id, obs, type, at, to, third, value, variance, setup; elapsed_at, elapsed_to where a drift is estimated;
height_offset (target height less instrument height) of slope distances, zenith and vertical angles taken above the marks.
Unknowns are named station:x, station:y, station:z, orientation:setup and drift_1:setup."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import distributions as dist
from meridian.functions import geodesy
from meridian.functions.angles import circular_mean, wrap_to_2pi, wrap_to_pi
from meridian.operators.gauss_newton import ANGULAR as ANGLES
from meridian.operators.gauss_newton import CONVERGENCE, EXTRA_NAMES, EXTRAS, ITERATIONS, STATIONS_OF, Networks, solve
from meridian.sources.shared import discard, stored

#: Fixed value: the redundancy below which an observation can't be checked.
UNCHECKABLE = 0.01
#: Unknown components of a frame; gravity is kept as z.
FRAMES = {"height_1d": ("z",), "gravity_1d": ("z",), "plane_2d": ("x", "y"), "local_3d": ("x", "y", "z"), "geocentric_3d": ("x", "y", "z")}
GRAVITY_TYPES = ("GRAVITY", "GRAVITY_DIFFERENCE")
#: Types whose equations are columns as well.
DISTRIBUTED_TYPES = ("HEIGHT_DIFFERENCE", "HEIGHT", "HORIZONTAL_DISTANCE", "SLOPE_DISTANCE", "ZENITH_ANGLE", "AZIMUTH", "DIRECTION", "HORIZONTAL_ANGLE", "X_DIFFERENCE", "Y_DIFFERENCE")
#: Types whose values are angles.
ANGULAR = ("DIRECTION", "HORIZONTAL_ANGLE", "AZIMUTH", "ZENITH_ANGLE")
#: Groups of observations that variance_components() tells apart at most.
GROUPS = 64
#: Rows of observations that a group of whole networks has, about. Of a network with more, repeated observations are merged first.
GROUP_ROWS = 100_000
#: Merged observations up to which they are broadcast to the rows that they stand for.
BROADCAST_ROWS = 100_000


def _partial(station: str, component: str, value: Column) -> Column:
    return F.struct(F.concat_ws(":", F.col(station), F.lit(component)).alias("parameter"), value.alias("a"))


def with_coordinates(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Joins the coordinates of up to three stations of an observation."""
    out = observations
    for role, prefix in (("at", "a"), ("to", "b"), ("third", "c")):
        own = stations.select("network_id", F.col("station").alias(role), *(F.col(c).alias(f"{prefix}{c}") for c in "xyz"))
        out = out.join(own, ["network_id", role], "left")
    return out


def equations(rows: DataFrame) -> DataFrame:
    """(network_id, obs, row, misclosure, weight, partials array<struct<parameter, a>>) of rows with coordinates and, for
    directions, an orientation. Types without an equation give no row."""
    dx, dy, rise = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("bz") - F.col("az")
    dz = rise + F.coalesce(F.col("height_offset"), F.lit(0.0)) if "height_offset" in rows.columns else rise
    ex, ey = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    flat2 = dx * dx + dy * dy
    flat, slope2 = F.sqrt(flat2), flat2 + dz * dz
    slope = F.sqrt(slope2)
    far2 = ex * ex + ey * ey

    def along(values: dict[str, Column]) -> list[Column]:
        return [_partial("to", c, v) for c, v in values.items()] + [_partial("at", c, -v) for c, v in values.items()]

    azimuth = {"x": dy / flat2, "y": -dx / flat2}
    far = {"x": ey / far2, "y": -ex / far2}
    angle = [_partial("third", c, v) for c, v in far.items()] + [_partial("to", c, -v) for c, v in azimuth.items()] + [_partial("at", c, azimuth[c] - far[c]) for c in "xy"]
    orientation = F.struct(F.concat_ws(":", F.lit("orientation"), F.col("setup")).alias("parameter"), F.lit(-1.0).alias("a"))
    kinds: dict[str, tuple[Column, list[Column]]] = {
        "HEIGHT_DIFFERENCE": (rise, along({"z": F.lit(1.0)})),
        "HEIGHT": (F.col("az"), [_partial("at", "z", F.lit(1.0))]),
        "HORIZONTAL_DISTANCE": (flat, along({"x": dx / flat, "y": dy / flat})),
        "SLOPE_DISTANCE": (slope, along({"x": dx / slope, "y": dy / slope, "z": dz / slope})),
        "ZENITH_ANGLE": (F.atan2(flat, dz), along({"x": dx * dz / (flat * slope2), "y": dy * dz / (flat * slope2), "z": -flat / slope2})),
        "AZIMUTH": (wrap_to_2pi(F.atan2(dx, dy)), along(azimuth)),
        "DIRECTION": (F.atan2(dx, dy) - F.col("orientation"), [*along(azimuth), orientation]),
        "HORIZONTAL_ANGLE": (F.atan2(ex, ey) - F.atan2(dx, dy), angle),
        "X_DIFFERENCE": (dx, along({"x": F.lit(1.0)})),
        "Y_DIFFERENCE": (dy, along({"y": F.lit(1.0)})),
    }
    computed = reduce(lambda c, k: c.when(F.col("type") == k, kinds[k][0]), kinds, F.when(F.lit(False), F.lit(0.0)))
    partials = reduce(lambda c, k: c.when(F.col("type") == k, F.array(*kinds[k][1])), kinds, F.when(F.lit(False), F.array(_partial("at", "z", F.lit(0.0)))))
    raw = F.col("value") - computed
    misclosure = F.when(F.col("type").isin(*ANGULAR), wrap_to_pi(raw)).otherwise(raw)
    return rows.where(F.col("type").isin(*kinds)).select("network_id", "obs", misclosure.alias("misclosure"), (1.0 / F.col("variance")).alias("weight"), partials.alias("partials"))


def free_only(design: DataFrame, stations: DataFrame) -> DataFrame:
    """Takes the partials of fixed stations out; their names are few against the rows, but are joined, not collected."""
    fixed = stations.where("fixed").select("network_id", F.explode(F.array(*(F.concat_ws(":", F.col("station"), F.lit(c)) for c in "xyz"))).alias("parameter"))
    flat = design.select("network_id", "obs", "misclosure", "weight", F.explode("partials").alias("p")).select("network_id", "obs", "misclosure", "weight", "p.parameter", "p.a")
    kept = flat.join(fixed, ["network_id", "parameter"], "left_anti")
    return kept.groupBy("network_id", "obs").agg(F.first("misclosure").alias("misclosure"), F.first("weight").alias("weight"), F.collect_list(F.struct("parameter", "a")).alias("partials"))


def normal_matrix(design: DataFrame) -> DataFrame:
    """(network_id, i, j, n): the products of a row's own partials, summed; no join, and partial sums on the map side."""
    pairs = F.flatten(F.transform("partials", lambda p: F.transform("partials", lambda q: F.struct(p.parameter.alias("i"), q.parameter.alias("j"), (p.a * q.a).alias("v")))))
    return design.select("network_id", "weight", F.explode(pairs).alias("e")).groupBy("network_id", "e.i", "e.j").agg(F.sum(F.col("weight") * F.col("e.v")).alias("n"))


def right_side(design: DataFrame) -> DataFrame:
    """(network_id, i, u)."""
    return design.select("network_id", "misclosure", "weight", F.explode("partials").alias("p")).groupBy("network_id", F.col("p.parameter").alias("i")).agg(F.sum(F.col("weight") * F.col("p.a") * F.col("misclosure")).alias("u"))


def conjugate_gradient(normal: DataFrame, right: DataFrame, tolerance: float = 1e-10, most: int = 2000) -> DataFrame:
    """(i, x) of one network over all executors: N is a table of entries, vectors are tables of unknowns, a step is one join and two
    sums. Jacobi preconditioning; the vectors are written at every step, which bounds the lineage."""
    n = stored(normal.select("i", "j", "n"))
    diagonal = n.where("i = j").select("i", F.col("n").alias("d"))
    state = diagonal.join(right.select("i", "u"), "i", "left").select("i", "d", F.lit(0.0).alias("x"), F.coalesce("u", F.lit(0.0)).alias("r")).withColumn("p", F.col("r") / F.col("d"))
    before = state = stored(state)
    rho = first = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
    for _ in range(most):
        if rho <= tolerance * tolerance * first:
            return state.select("i", "x")
        product = n.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("n") * F.col("p")).alias("np"))
        now = stored(state.join(product, "i"))
        discard(before)
        alpha = rho / now.agg(F.sum(F.col("p") * F.col("np"))).first()[0]
        state = now.select("i", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("np")).alias("r"), "p")
        new = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]
        state = state.withColumn("p", F.col("r") / F.col("d") + (new / rho) * F.col("p"))
        before, rho = now, new
    raise ValueError("the conjugate gradients do not converge")


def _orientations(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """(network_id, setup, orientation): the mean of azimuth less reading over a set's directions."""
    rows = with_coordinates(observations.where("type = 'DIRECTION'"), stations)
    return rows.groupBy("network_id", "setup").agg(circular_mean(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) - F.col("value")).alias("orientation"))


_IN = {"what": "int", "network_id": "string", "a": "string", "b": "string", "c": "string", "type": "string", "name": "string", "v": "double", "w": "double", "x": "double", "y": "double", "z": "double", "fixed": "boolean"}
_OUT = "what int, network_id string, a string, b string, v double, w double, x double, y double, z double, fixed boolean, status string"
_OUT_FIELDS = ("what", "network_id", "a", "b", "v", "w", "x", "y", "z", "fixed", "status")


def _local_horizon(ellipsoid: geodesy.Ellipsoid) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Rotations from geocentric differences to east, north and up at each position, and ellipsoidal heights."""

    def at(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lon, flat = np.arctan2(p[:, 1], p[:, 0]), np.hypot(p[:, 0], p[:, 1])
        lat = np.arctan2(p[:, 2], flat * (1 - ellipsoid.e2))
        for _ in range(6):  # each step gains more than two digits at heights near the ellipsoid
            normal = ellipsoid.a / np.sqrt(1 - ellipsoid.e2 * np.sin(lat) ** 2)
            lat = np.arctan2(p[:, 2] + ellipsoid.e2 * normal * np.sin(lat), flat)
        normal = ellipsoid.a / np.sqrt(1 - ellipsoid.e2 * np.sin(lat) ** 2)
        height = flat * np.cos(lat) + p[:, 2] * np.sin(lat) - ellipsoid.a**2 / normal
        so, co, sa, ca, none = np.sin(lon), np.cos(lon), np.sin(lat), np.cos(lat), np.zeros(len(p))
        return np.stack((np.stack((-so, co, none), 1), np.stack((-sa * co, -sa * so, ca), 1), np.stack((ca * co, ca * so, sa), 1)), 1), height

    return at


def _places(keys: pa.Array, values: pa.Array) -> np.ndarray:
    """The place of each value among the keys, or -1."""
    return pc.fill_null(pc.index_in(values, value_set=keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _named(network: pa.Array, name: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(network, name, "\x00")  # null where a name is


def _task(t: pa.Table, frame: str, defect: tuple[str, ...], degree: int, once: bool, influence: bool = False, parts: tuple[str, ...] = ()) -> pa.Table:
    """Adjusts the networks of one group of _IN rows; gives _OUT rows: 0 stations, 1 residuals, 2 cofactors, 3 statistics, and 4 traces of the
    groups of observations that `parts` names."""
    t = t.combine_chunks()
    what = t["what"].to_numpy()
    col = lambda own, name: own[name].combine_chunks() if own.num_rows else pa.array([], own.schema.field(name).type)
    st = t.filter(pa.array(what == 0)).sort_by([("network_id", "ascending"), ("a", "ascending")])
    ob, cov = t.filter(pa.array(what == 1)), t.filter(pa.array(what == 2))
    net_names = pc.unique(t["network_id"]).sort()
    nets = len(net_names)
    station_net, row_net = _places(net_names, col(st, "network_id")), _places(net_names, col(ob, "network_id"))
    station_names = _named(col(st, "network_id"), col(st, "a"))
    places = np.stack([_places(station_names, _named(col(ob, "network_id"), col(ob, c))) for c in "abc"], 1) if ob.num_rows else np.zeros((0, 3), np.int64)
    kind = np.array(col(ob, "type").to_pylist(), object)
    named = np.array([STATIONS_OF[k] for k in kind], np.int64)
    lost = np.zeros(nets, bool)  # networks whose observations name stations they do not have
    lost[row_net[((np.arange(3) < named[:, None]) & (places < 0)).any(1)]] = True
    places[np.arange(3) >= named[:, None]] = -1

    # unknowns: components of free stations, then orientations and drifts by their owners
    position = np.stack([np.nan_to_num(col(st, c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in "xyz"], 1) if st.num_rows else np.zeros((0, 3))
    held = col(st, "fixed").to_numpy(zero_copy_only=False).astype(bool) if st.num_rows else np.zeros(0, bool)
    free = np.zeros((st.num_rows, 3), bool)
    free[:, ["xyz".index(c) for c in FRAMES[frame]]] = True
    observed = np.zeros(st.num_rows + 1, bool)
    observed[places] = True
    free &= ~held[:, None] & observed[:-1, None]
    count = np.bincount(station_net, free.sum(1), nets).astype(np.int64)
    flat = np.cumsum(free.ravel()).reshape(free.shape) - 1
    unknown = np.where(free, flat - (np.cumsum(count) - count)[station_net][:, None], -1) if st.num_rows else np.zeros((0, 3), np.int64)

    owner = _named(col(ob, "network_id"), col(ob, "name"))
    is_direction, is_drift = kind == "DIRECTION", kind == "GRAVITY_DIFFERENCE"
    extra, factor = np.full((len(kind), EXTRAS), -1, np.int64), np.zeros((len(kind), EXTRAS))
    extra_at, extra_names, extra_net, orientation_of = extra.copy(), [], [], []
    for k, own in [(0, np.flatnonzero(is_direction))] + [(d, np.flatnonzero(is_drift & owner.is_valid().to_numpy(zero_copy_only=False))) for d in range(1, degree + 1)]:
        if not len(own):
            continue
        values = owner.take(pa.array(own))
        keys = pc.unique(values)
        at = _places(keys, values)
        of = np.zeros(len(keys), np.int64)
        of[at] = row_net[own]
        order = np.argsort(of, kind="stable")
        number = np.zeros(len(keys), np.int64)
        number[order] = count[of[order]] + np.arange(len(order)) - np.searchsorted(of[order], of[order])
        count += np.bincount(of, minlength=nets)
        slot = max(k - 1, 0)
        extra[own, slot], extra_at[own, slot] = number[at], len(extra_names) + at
        if k:
            begin, end = (np.nan_to_num(col(ob, c).to_numpy(zero_copy_only=False)[own]) for c in "xy")
            factor[own, slot] = end**k - begin**k
        else:
            factor[own, slot] = -1.0
            orientation_of = np.stack((of, number), 1)
        extra_names += [f"{EXTRA_NAMES[k]}:{x.partition(chr(0))[2]}" for x in keys.to_pylist()]
        extra_net += of.tolist()

    value, variance = (col(ob, c).to_numpy(zero_copy_only=False).astype(float) for c in "vw")
    extra_value = np.zeros(len(extra_names))
    if is_direction.any() and not once:  # orientations begin at the mean of azimuth less reading
        d = np.where(is_direction & (places[:, :2] >= 0).all(1))[0]
        turn = position[places[d, 1]] - position[places[d, 0]]
        if frame == "geocentric_3d":
            turn = np.einsum("rij,rj->ri", _local_horizon(geodesy.GRS80)(position[places[d, 0]])[0], turn)
        raw = np.arctan2(turn[:, 0], turn[:, 1]) - value[d]
        extra_value = np.arctan2(np.bincount(extra_at[d, 0], np.sin(raw), len(extra_names)), np.bincount(extra_at[d, 0], np.cos(raw), len(extra_names)))

    # weights: of rows alone, or the inverse of what is correlated together
    pair_i, pair_k, pair_p = [np.arange(len(kind))], [np.arange(len(kind))], [1.0 / variance]
    if cov.num_rows:
        row_names = _named(col(ob, "network_id"), col(ob, "fullname"))
        i, k = (_places(row_names, _named(col(cov, "network_id"), col(cov, c))) for c in "ab")
        c = col(cov, "v").to_numpy(zero_copy_only=False)[(i >= 0) & (k >= 0)]
        i, k = i[(i >= 0) & (k >= 0)], k[(i >= 0) & (k >= 0)]
        cluster = np.arange(len(kind))
        while True:
            low = np.minimum(cluster[i], cluster[k])
            new = cluster.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, k, low)
            if (new == cluster).all():
                break
            cluster = new
        alone = np.ones(len(kind), bool)
        alone[i] = alone[k] = False
        pair_i, pair_k, pair_p = [np.flatnonzero(alone)], [np.flatnonzero(alone)], [1.0 / variance[alone]]
        by, entries = np.argsort(cluster, kind="stable"), np.argsort(cluster[i], kind="stable")
        for label in np.unique(cluster[~alone]).tolist():
            rows = by[np.searchsorted(cluster[by], label) : np.searchsorted(cluster[by], label, side="right")]
            own = entries[np.searchsorted(cluster[i][entries], label) : np.searchsorted(cluster[i][entries], label, side="right")]
            block = np.diag(variance[rows])
            p, q = np.searchsorted(rows, i[own]), np.searchsorted(rows, k[own])  # rows of a label come in order
            block[p, q] = block[q, p] = c[own]
            pair_i.append(np.repeat(rows, len(rows)))
            pair_k.append(np.tile(rows, len(rows)))
            pair_p.append(np.linalg.inv(block).ravel())
    net = Networks(station_net, position, unknown, row_net, kind, places, value, extra, factor, extra_value, extra_at, np.where(lost, 0, count), (np.concatenate(pair_i), np.concatenate(pair_k), np.concatenate(pair_p)), np.nan_to_num(col(ob, "z").to_numpy(zero_copy_only=False).astype(float)), _local_horizon(geodesy.GRS80) if frame == "geocentric_3d" else None)
    if lost.any():  # their rows give no equations
        bad = lost[row_net]
        net.stations[bad], net.extra[bad] = 0, -1
        net.unknown[lost[station_net]] = -1
    groups = _places(pa.array(parts, pa.string()), col(ob, "part")) if parts else None
    split = np.zeros(nets, bool)  # networks with observations of two groups that are correlated
    if parts:
        split[row_net[net.pair[0][groups[net.pair[0]] != groups[net.pair[1]]]]] = True
    with np.errstate(all="ignore"):
        out = solve(net, defect, np.array(orientation_of, np.int64).reshape(-1, 2), once, influence, groups)

    rank = out["rank_defect"]
    status = np.full(nets, "not_converged", object)
    status[out["converged"] | (once & (rank == 0))] = "converged"
    status[rank > 0], status[out["too_large"]], status[lost] = "rank_defect", "too_large", "missing_station"
    status[split & (status == "converged")] = "split_group"
    good = status == "converged"
    net_text = np.array(net_names.to_pylist(), object)
    names = {}
    text = np.array(col(st, "a").to_pylist(), object)
    for s, c in zip(*np.nonzero(net.unknown >= 0), strict=True):
        names[int(station_net[s]), int(net.unknown[s, c])] = f"{text[s]}:{'xyz'[c]}"
    used = extra_at >= 0
    for net_k, number, place in zip(np.broadcast_to(row_net[:, None], used.shape)[used].tolist(), extra[used].tolist(), extra_at[used].tolist(), strict=True):
        names[net_k, number] = extra_names[place]
    blank = lambda n: [None] * n

    def rows_of(kind: int, network, a, b, v, w, x, y, z, fixed, state) -> pa.Table:
        n = len(network)
        arrays = [pa.array(np.full(n, kind, np.int32)), pa.array(network, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), *(pa.array(k, pa.float64(), from_pandas=True) for k in (v, w, x, y, z)), pa.array(fixed, pa.bool_()), pa.array(state, pa.string())]
        return pa.Table.from_arrays(arrays, names=list(_OUT_FIELDS))

    shown = np.where(good[station_net][:, None], out["position"], np.nan) if st.num_rows else np.zeros((0, 3))
    n = st.num_rows
    tables = [rows_of(0, net_text[station_net], text, blank(n), np.full(n, np.nan), np.full(n, np.nan), *shown.T, held, blank(n))]
    ok = good[row_net] if len(row_net) else np.zeros(0, bool)
    null = lambda x: np.where(ok, x, np.nan)
    m = len(kind)
    vpv = np.where(good, np.bincount(row_net, np.nan_to_num(out["residual"] * out["weighted"]), nets), np.nan)
    tables.append(rows_of(1, net_text[row_net], col(ob, "fullname"), col(ob, "part") if "part" in ob.column_names else blank(m), null(out["residual"]), 1.0 / variance, null(out["redundancy"]), null(out["weighted"]), null(out["influence"]), blank(m), blank(m)))
    qn, qi, qj, q = out["q"]
    keep = good[qn] if len(qn) else np.zeros(0, bool)
    qn, qi, qj, q = qn[keep], qi[keep], qj[keep], q[keep]
    label = lambda x: [names[k] for k in zip(qn.tolist(), x.tolist(), strict=True)]
    tables.append(rows_of(2, net_text[qn], label(qi), label(qj), q, *(np.full(len(q), np.nan) for _ in range(4)), blank(len(q)), blank(len(q))))
    tables.append(rows_of(3, net_text, blank(nets), blank(nets), vpv, np.bincount(row_net, minlength=nets).astype(float), count.astype(float), rank.astype(float), out["iterations"].astype(float), blank(nets), status))
    if parts:  # how often a group's rows, tr(Q N_k) and tr(Q N_k Q N_j) count, of all networks of this task together
        own, none = np.flatnonzero(good), np.full(len(parts), np.nan)
        members = np.bincount(groups[ok & (groups >= 0)], minlength=len(parts)).astype(float)
        for k, name in enumerate(parts):
            both = out["traced"][own, k].sum(0)
            tables.append(rows_of(4, blank(len(parts)), [name] * len(parts), list(parts), both, np.full(len(parts), out["once_traced"][own, k].sum()), np.full(len(parts), members[k]), none, none, blank(len(parts)), blank(len(parts))))
    return pa.concat_tables(tables)


def _refuse_other(observations: DataFrame, kinds: tuple[str, ...], frame: str) -> None:
    unlike = observations.where(F.col("type").isNull() | ~F.col("type").isin(*kinds)).select("type").limit(1).collect()
    if unlike:
        raise ValueError(f"no observation equation for {unlike[0].type} in {frame}")


#: What observations of one quantity have in common.
_SAME = ("network_id", "type", "a", "b", "offset")


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations of _IN rows that differ from others in value and variance only, with the offset that their equation reads; and all other
    rows. Angles are others, as their misclosures are wrapped one by one, and differences with a drift, as their times differ."""
    own = (F.col("what") == 1) & ~F.col("type").isin(*ANGLES) & ~((F.col("type") == "GRAVITY_DIFFERENCE") & F.col("name").isNotNull())
    offset = F.when(F.col("type") == "SLOPE_DISTANCE", F.nanvl(F.coalesce("z", F.lit(0.0)), F.lit(0.0)))
    return rows.where(own).withColumn("offset", offset), rows.where(~own)


def _means(repeated: DataFrame) -> DataFrame:
    """One observation for all of a quantity, numbered (part): their weighted mean v with the sum of their weights gives the same normal equations."""
    c = F.col
    value = F.coalesce("v", F.lit(math.nan))
    sums = repeated.groupBy(*_SAME).agg(F.sum(1.0 / c("w")).alias("weight"), F.sum(value / c("w")).alias("sum"), F.avg(value).alias("plain"))
    weighted = c("weight") > 0  # infinite variances have no weight
    return sums.select(F.monotonically_increasing_id().cast("string").alias("part"), *_SAME, "weight", F.when(weighted, c("sum") / c("weight")).otherwise(c("plain")).alias("v"), F.when(weighted, 1.0 / c("weight")).otherwise(math.inf).alias("w"))


def _residuals(out: DataFrame, kind: str = "what = 1") -> DataFrame:
    return out.where(kind).select("network_id", F.col("a").alias("obs"), F.col("v").alias("residual"), F.col("w").alias("weight"), F.col("x").alias("redundancy"), F.col("y").alias("weighted"), F.col("z").alias("influence"))


def _spread_out(out: DataFrame, means: DataFrame, repeated: DataFrame) -> DataFrame:
    """Residuals of all observations, out of those of their means: rows of one quantity share its adjusted value and the spread of that."""
    c = F.col
    of = means.select("part", *(c(n).alias(f"_{n}") for n in _SAME), c("weight").alias("_weight"), c("v").alias("_v"))
    of = of.join(out.where("what = 1 and b is not null").select(c("b").alias("part"), c("v").alias("_residual"), c("x").alias("_redundancy"), c("z").alias("_influence")), "part")
    if means.count() <= BROADCAST_ROWS:
        of = F.broadcast(of)
    met = repeated.join(of, reduce(lambda x, y: x & y, (c(n).eqNullSafe(c(f"_{n}")) for n in _SAME)))
    weight, residual = 1.0 / c("w"), c("_residual") + (c("_v") - c("v"))
    share = F.when(c("_weight") > 0, weight / c("_weight")).otherwise(1.0)
    merged = met.select("network_id", c("fullname").alias("obs"), residual.alias("residual"), weight.alias("weight"), (1.0 - share * (1.0 - c("_redundancy"))).alias("redundancy"), (weight * residual).alias("weighted"), (share * c("_influence")).alias("influence"))
    return merged.unionByName(_residuals(out, "what = 1 and b is null"))


def _of_all(statistics: DataFrame, residuals: DataFrame) -> DataFrame:
    """Statistics with the number of all rows and v'Pv over them, where they were those of the rows' means."""
    sums = stored(residuals.groupBy(F.col("network_id").alias("_network")).agg(F.count("*").alias("_rows"), F.sum(F.col("residual") * F.col("weighted")).alias("_vpv")))
    joined = statistics.join(sums, F.col("network_id").eqNullSafe(F.col("_network")), "left")
    every = {"rows": F.coalesce("_rows", F.lit(0)).cast("long"), "vpv": F.when(F.col("vpv").isNotNull(), F.coalesce("_vpv", F.lit(0.0)))}
    return joined.select(*(every.get(n, F.col(n)).alias(n) for n in statistics.columns))


def _estimated(
    stations: DataFrame, observations: DataFrame, frame: str, defect: tuple[str, ...], covariances: DataFrame | None, degree: int, once: bool,
    influence: bool = False, part: str | None = None, parts: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    if degree > EXTRAS:
        raise ValueError(f"drifts of a degree over {EXTRAS} are not estimated")
    kinds = GRAVITY_TYPES if frame == "gravity_1d" else tuple(k for k in STATIONS_OF if k not in GRAVITY_TYPES)
    names = [*_IN, "fullname", "part"]
    types = _IN | {"fullname": "string", "part": "string"}
    row = lambda what, **own: [own.get(n, F.lit(what if n == "what" else None)).cast(types[n]).alias(n) for n in names]
    c = F.col
    begin, end, offset = (c(n) if n in observations.columns else F.lit(None) for n in ("elapsed_at", "elapsed_to", "height_offset"))
    rows = stations.select(*row(0, network_id=c("network_id"), a=c("station"), x=c("x"), y=c("y"), z=c("z"), fixed=F.coalesce("fixed", F.lit(False))))
    of_part = c(part).cast("string") if part else F.lit(None)
    own = row(1, network_id=c("network_id"), a=c("at"), b=c("to"), c=c("third"), type=c("type"), name=c("setup"), v=c("value"), w=c("variance"), x=begin, y=end, z=offset, fullname=c("obs"), part=of_part)
    rows = rows.unionByName(observations.select(*own))
    if covariances is not None:
        rows = rows.unionByName(covariances.select(*row(2, network_id=c("network_id"), a=c("obs_a"), b=c("obs_b"), v=c("covariance"))))
    rows = stored(rows)  # what gives the observations is evaluated once; the checks and the adjustment read this
    observed = F.col("what") == 1
    unlike = observed & (F.col("type").isNull() | ~F.col("type").isin(*kinds))
    found = rows.agg(
        F.count(F.when(observed, 1)).alias("n"),
        F.max(F.when(unlike, F.coalesce("type", F.lit("null")))).alias("unlike"),
        F.count(F.when(observed & (F.coalesce(F.col("w"), F.lit(0.0)) <= 0), 1)).alias("unweighted"),
    ).first()
    if found.unlike is not None:
        raise ValueError(f"no observation equation for {found.unlike} in {frame}")
    if found.unweighted:
        raise ValueError("every observation needs a variance over 0")
    # whole networks are dealt to groups of about GROUP_ROWS rows
    groups = max(int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.n // GROUP_ROWS)
    repeated = means = None
    if found.n > GROUP_ROWS and covariances is None and part is None and rows.where(observed).groupBy("network_id").count().agg(F.max("count")).first()[0] > GROUP_ROWS:
        repeated, others = _repeated(rows)
        means = stored(_means(repeated))
        dealt = others.unionByName(means.select(*row(1, z=c("offset"), **{n: c(n) for n in ("network_id", "type", "a", "b", "v", "w", "part")})))
    else:
        dealt = rows
    grouped = dealt.withColumn("deal", F.pmod(F.xxhash64("network_id"), F.lit(groups))).groupBy("deal")
    out = stored(grouped.applyInArrow(lambda t: _task(t, frame, defect, degree, once, influence, parts), _OUT))
    statistics = out.where("what = 3").select("network_id", F.col("w").cast("long").alias("rows"), F.col("v").alias("vpv"), F.col("x").cast("long").alias("unknowns"), F.col("y").cast("int").alias("rank_defect"), F.col("z").cast("int").alias("iterations"), "status")
    if means is None:
        discard(rows)
        residuals = _residuals(out)
    else:
        residuals = _spread_out(out, means, repeated)
        statistics = _of_all(statistics, residuals)
    statistics = statistics.withColumn("converged", F.col("status") == "converged").withColumn("dof", F.col("rows") - F.col("unknowns") + len(defect))
    statistics = statistics.withColumn("variance_factor", F.when(F.col("dof") > 0, F.col("vpv") / F.col("dof")))
    return {
        "stations": out.where("what = 0").select("network_id", F.col("a").alias("station"), "x", "y", "z", "fixed"),
        "residuals": residuals if influence else residuals.drop("influence"),
        "cofactors": out.where("what = 2").select("network_id", F.col("a").alias("i"), F.col("b").alias("j"), F.col("v").alias("q")),
        "statistics": statistics,
        "traces": out.where("what = 4").select(F.col("a").alias("k"), F.col("b").alias("j"), F.col("v").alias("both"), F.col("w").alias("once"), F.col("x").alias("rows")),
    }


def adjust(stations: DataFrame, observations: DataFrame, frame: str = "plane_2d", defect: tuple[str, ...] = (), covariances: DataFrame | None = None, degree: int = 1, influence: bool = False) -> dict[str, DataFrame]:
    """Gauss-Newton over all networks: tables stations (adjusted coordinates), residuals, cofactors (of unknowns that share
    an observation or a station) and statistics (rows, unknowns, dof, vpv, variance_factor, iterations, status).

    `covariances` (network_id, obs_a, obs_b, covariance) correlates observations; what is correlated, over any
    number of steps, is weighted by the inverse of its covariance block. `degree` is that of a drift of gravity
    differences: `setup` names its owner, `elapsed_at` and `elapsed_to` are scaled times of the two readings.
    A network that does not converge, has null vectors beyond `defect`, names stations it does not have or is too large
    for a task has that as its status and null results; if there is no other network, it raises. One network that is
    too large is for adjust_distributed. With `influence` residuals have the norm of Q A'P e too, as reliability() reads it."""
    out = _estimated(stations, observations, frame, defect, covariances, degree, False, influence)
    first = out["statistics"].limit(2).collect()
    if len(first) == 1 and not first[0].converged and first[0].unknowns:
        raise ValueError(f"network {first[0].network_id}: {first[0].status}")
    return out


def simulate(stations: DataFrame, observations: DataFrame, frame: str = "plane_2d", defect: tuple[str, ...] = (), covariances: DataFrame | None = None) -> dict[str, DataFrame]:
    """Expected cofactors and redundancies of planned networks: geometry and sigmas only, values are not read."""
    return _estimated(stations, observations.withColumn("value", F.lit(0.0)), frame, defect, covariances, 1, once=True)


def adjust_distributed(stations: DataFrame, observations: DataFrame, frame: str = "plane_2d") -> DataFrame:
    """(network_id, station, x, y, z, fixed) of one network over all executors: each step's normal equations are tables, solved
    by conjugate gradients. No cofactors. Types are those of equations()."""
    free = FRAMES[frame]
    _refuse_other(observations, DISTRIBUTED_TYPES, frame)
    current = stored(stations.select("network_id", "station", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xyz"), F.coalesce("fixed", F.lit(False)).alias("fixed")))
    observations = stored(observations)
    turned = stored(_orientations(observations, current))
    for _ in range(ITERATIONS):
        rows = with_coordinates(observations, current).join(turned, ["network_id", "setup"], "left")
        design = stored(free_only(equations(rows), current))
        network = design.select("network_id").limit(1)
        change = stored(conjugate_gradient(normal_matrix(design), right_side(design)).crossJoin(F.broadcast(network)).select("network_id", "i", F.col("x").alias("dx")))
        current, turned = _moved(current, change, free), stored(_turned(turned, change))
        if (change.agg(F.max(F.abs("dx"))).first()[0] or 0.0) < CONVERGENCE:
            return current
    raise ValueError("the network does not converge")


def _moved(stations: DataFrame, change: DataFrame, components: tuple[str, ...]) -> DataFrame:
    named = change.where("not startswith(i, 'orientation:')")
    station, component = F.expr("substring(i, 1, length(i) - 2)"), F.expr("right(i, 1)")
    steps = named.groupBy("network_id", station.alias("station")).agg(*(F.sum(F.when(component == c, F.col("dx"))).alias(f"d{c}") for c in components))
    moved = stations.join(steps, ["network_id", "station"], "left")
    for c in components:
        moved = moved.withColumn(c, F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0))).drop(f"d{c}")
    return stored(moved.select("network_id", "station", "x", "y", "z", "fixed"))


def _turned(turned: DataFrame, change: DataFrame) -> DataFrame:
    own = change.where("startswith(i, 'orientation:')").select("network_id", F.expr("substring(i, 13)").alias("setup"), "dx")
    return turned.join(own, ["network_id", "setup"], "left").select("network_id", "setup", (F.col("orientation") + F.coalesce("dx", F.lit(0.0))).alias("orientation"))


def global_test(statistics: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Two-sided chi-square of dof * factor; untested networks have no degrees of freedom. Quantiles are looked up by the
    distinct degrees of freedom."""
    degrees = [r.dof for r in statistics.select("dof").where("dof > 0").distinct().collect()]
    bounds = dist.lookup(statistics.sparkSession, degrees, lower=lambda d: dist.chi2_quantile((1 - confidence) / 2, d), upper=lambda d: dist.chi2_quantile((1 + confidence) / 2, d))
    joined = statistics.join(bounds, "dof", "left")
    return joined.withColumn("tested", F.col("dof") > 0).withColumn("passed", F.when(F.col("tested"), (F.col("vpv") >= F.col("lower")) & (F.col("vpv") <= F.col("upper"))))


def data_snooping(residuals: DataFrame, statistics: DataFrame, confidence: float = 0.999, sigma_known: bool = True) -> DataFrame:
    """Adds w, critical and decision (accepted, rejected, uncheckable) to residuals."""
    joined = residuals.join(statistics.select("network_id", "dof", "variance_factor"), "network_id")
    normal = dist.normal_quantile((1 + confidence) / 2)
    if sigma_known:
        joined = joined.withColumn("critical", F.lit(normal))
        sigma = F.lit(1.0)
    else:
        degrees = [r.dof for r in statistics.select("dof").where("dof > 1").distinct().collect()]
        tau = dist.lookup(residuals.sparkSession, degrees, tau=lambda d: dist.tau_critical(confidence, int(d)))
        joined = joined.join(tau, "dof", "left").withColumn("critical", F.coalesce("tau", F.lit(normal)))
        sigma = F.sqrt("variance_factor")
    checkable = F.col("redundancy") >= UNCHECKABLE
    w = F.when(checkable, F.abs("residual") / (sigma * F.sqrt(F.col("redundancy") / F.col("weight"))))
    decision = F.when(~checkable, "uncheckable").when(w > F.col("critical"), "rejected").otherwise("accepted")
    return joined.withColumn("w", w).withColumn("decision", decision).select("network_id", "obs", "residual", "weight", "redundancy", "w", "critical", "decision")


def reliability(residuals: DataFrame, alpha: float = 0.001, beta: float = 0.20) -> DataFrame:
    """Adds the minimal detectable bias, and if residuals have an influence the external effect, the norm of what a bias of that size
    does to all unknowns; both are null where the redundancy is below UNCHECKABLE."""
    delta = dist.non_centrality(alpha, beta)
    out = residuals.withColumn("minimal_detectable_bias", F.when(F.col("redundancy") >= UNCHECKABLE, delta / F.sqrt(F.col("weight") * F.col("redundancy"))))
    return out.withColumn("external_effect", F.col("influence") * F.col("minimal_detectable_bias")) if "influence" in residuals.columns else out


def ellipse(cxx: Column, cxy: Column, cyy: Column, scale: float = 1.0) -> dict[str, Column]:
    """Axes and azimuth (from north, clockwise, in [0, pi)) of a 2 x 2 covariance of east and north."""
    middle, half = (cxx + cyy) / 2.0, F.sqrt((cyy - cxx) ** 2 / 4.0 + cxy * cxy)
    azimuth = F.pmod(0.5 * F.atan2(2.0 * cxy, cyy - cxx), F.lit(math.pi))
    return {"semi_major": scale * F.sqrt(F.greatest(middle + half, F.lit(0.0))), "semi_minor": scale * F.sqrt(F.greatest(middle - half, F.lit(0.0))), "azimuth": azimuth}


def station_ellipses(cofactors: DataFrame, scale: float = 1.0) -> DataFrame:
    """(network_id, station, semi_major, semi_minor, azimuth) from the cofactors of x and y."""
    name = lambda c: F.expr(f"substring({c}, 1, length({c}) - 2)")
    own = cofactors.where((name("i") == name("j")) & F.expr("right(i, 2) in (':x', ':y') and right(j, 2) in (':x', ':y')"))
    pick = lambda a, b: F.max(F.when(F.expr(f"right(i, 1) = '{a}' and right(j, 1) = '{b}'"), F.col("q")))
    c = own.groupBy("network_id", name("i").alias("station")).agg(pick("x", "x").alias("xx"), pick("x", "y").alias("xy"), pick("y", "y").alias("yy"))
    return c.select("network_id", "station", *(v.alias(k) for k, v in ellipse(F.col("xx"), F.col("xy"), F.col("yy"), scale).items()))


def variance_components(
    stations: DataFrame, observations: DataFrame, frame: str, group: str, rounds: int = 30, tolerance: float = 1e-4,
    defect: tuple[str, ...] = (), covariances: DataFrame | None = None,
) -> DataFrame:
    """(group, factor, std_dev, redundancy, observations): a variance factor for each group of observations, estimated over all networks.
    A round solves, for the groups' factors t, sum_j tr(M V_k M V_j) t_j = v'P V_k P v with M = P Qvv P; the traces are sums
    over networks of those of selected entries of their inverses. Variances are scaled by the factors and rounds are repeated
    until every factor of one is within `tolerance` of one. Groups are at most GROUPS. Raises where a group has too little
    redundancy, where a factor is not positive, where correlated observations are in two groups, or where factors do not settle."""
    observations = stored(observations.withColumn(group, F.col(group).cast("string")))
    names = tuple(sorted(r[0] for r in observations.select(group).distinct().limit(GROUPS + 1).collect() if r[0] is not None))
    if len(names) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    if not names:
        raise ValueError("no observation has a group")
    total = dict.fromkeys(names, 1.0)
    pairs = observations.select("network_id", "obs", group)
    for _ in range(rounds):
        factor = F.coalesce(F.create_map(*(F.lit(x) for pair in total.items() for x in pair))[F.col(group)], F.lit(1.0))
        scaled = observations.withColumn("variance", F.col("variance") * factor)
        own = None
        if covariances is not None:
            of_a = pairs.withColumnsRenamed({"obs": "obs_a"}).withColumn("_factor", factor).drop(group)
            own = covariances.join(of_a, ["network_id", "obs_a"]).withColumn("covariance", F.col("covariance") * F.col("_factor"))
        out = _estimated(stations, scaled, frame, defect, own, 1, False, part=group, parts=names)
        lost = out["statistics"].where("NOT converged").select("network_id", "status").first()
        if lost:
            raise ValueError(f"network {lost.network_id}: {lost.status}")
        right = {r[group]: r.vpv for r in out["residuals"].join(pairs, ["network_id", "obs"]).groupBy(group).agg(F.sum(F.col("residual") * F.col("weighted")).alias("vpv")).collect()}
        normal, free, rows = np.zeros((len(names),) * 2), np.zeros(len(names)), np.zeros(len(names), np.int64)
        for r in out["traces"].groupBy("k", "j").agg(*(F.sum(c).alias(c) for c in ("both", "once", "rows"))).collect():
            k, j = names.index(r.k), names.index(r.j)
            normal[k, j] += 0.5 * r.both
            if k == j:
                normal[k, k] += 0.5 * r.rows - r.once
                free[k], rows[k] = r.rows - r.once, int(r.rows)
        if free.min() < 1:
            raise ValueError(f"group {names[int(free.argmin())]} has too little redundancy for a factor of its own")
        estimate = np.linalg.solve(normal, [0.5 * right[n] for n in names])
        if not estimate.min() > 0:
            raise ValueError(f"group {names[int(estimate.argmin())]}: its factor is zero or negative")
        total = {n: total[n] * float(e) for n, e in zip(names, estimate, strict=True)}
        if np.abs(estimate - 1.0).max() <= tolerance:
            spread = np.sqrt(np.diag(np.linalg.inv(normal)))
            found = [(n, total[n], float(d) * total[n], float(f), int(m)) for n, d, f, m in zip(names, spread, free, rows, strict=True)]
            return stations.sparkSession.createDataFrame(found, f"{group} string, factor double, std_dev double, redundancy double, observations long")
    raise ValueError("the variance factors do not settle")
