"""What a task does with the networks dealt to it: observation equations and normal equations of all at once, in NumPy.

Small networks are solved in stacks of matrices. The unknowns of a large one are put into levels by their distance
from one end of its graph, which makes its normal matrix block tridiagonal; the cofactors that
observations need lie in its blocks, and only those are computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Convergence in metres and radians, iterations, relative rank tolerance.
CONVERGENCE, ITERATIONS, RANK_TOLERANCE = 1e-4, 20, 1e-12
#: Unknowns up to which a network is one matrix, sizes of stacked matrices, and numbers in the blocks of a larger one.
DENSE, SIZES, BLOCK_NUMBERS = 384, np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384]), 1 << 28
#: Unknowns of a row besides its stations' coordinates: an orientation, or coefficients of a drift.
EXTRAS = 3
#: Names of unknowns that are not coordinates.
EXTRA_NAMES = ("orientation", "drift_1", "drift_2", "drift_3")
ANGULAR = {"DIRECTION", "HORIZONTAL_ANGLE", "AZIMUTH", "ZENITH_ANGLE", "VERTICAL_ANGLE"}
#: How many stations each type names.
STATIONS_OF = {
    "HEIGHT": 1, "HEIGHT_DIFFERENCE": 2, "HORIZONTAL_DISTANCE": 2, "SLOPE_DISTANCE": 2, "ZENITH_ANGLE": 2, "VERTICAL_ANGLE": 2, "AZIMUTH": 2,
    "DIRECTION": 2, "HORIZONTAL_ANGLE": 3, "X_DIFFERENCE": 2, "Y_DIFFERENCE": 2, "Z_DIFFERENCE": 2, "X_COORDINATE": 1, "Y_COORDINATE": 1, "Z_COORDINATE": 1, "GRAVITY": 1, "GRAVITY_DIFFERENCE": 2,
}


def wrapped(x: np.ndarray) -> np.ndarray:
    """Angles in [-pi, pi)."""
    return (x + np.pi) % (2 * np.pi) - np.pi


def line(kind: str, d: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Computed values over east, north and up differences to the target (and to the foresight), and their partials."""
    e, n, u = d.T
    flat2 = e * e + n * n
    flat, none = np.sqrt(flat2), np.zeros((len(d), 3))
    bearing = np.stack((n / flat2, -e / flat2, np.zeros(len(d))), 1)
    if kind == "HORIZONTAL_DISTANCE":
        return flat, np.stack((e / flat, n / flat, np.zeros(len(d))), 1), none
    if kind == "SLOPE_DISTANCE":
        slope = np.sqrt(flat2 + u * u)
        return slope, d / slope[:, None], none
    if kind in ("ZENITH_ANGLE", "VERTICAL_ANGLE"):
        slope2 = flat2 + u * u
        zenith, g = np.arctan2(flat, u), np.stack((e * u / (flat * slope2), n * u / (flat * slope2), -flat / slope2), 1)
        return (zenith, g, none) if kind == "ZENITH_ANGLE" else (np.pi / 2 - zenith, -g, none)
    if kind == "HORIZONTAL_ANGLE":
        x, y = far[:, 0], far[:, 1]
        far2 = x * x + y * y
        return np.arctan2(x, y) - np.arctan2(e, n), -bearing, np.stack((y / far2, -x / far2, np.zeros(len(d))), 1)
    return np.arctan2(e, n), bearing, none  # azimuths and directions


@dataclass
class Networks:
    """The networks of a task: stations sorted by network, rows of observations, and pairs of rows with a weight."""

    station_net: np.ndarray
    position: np.ndarray  # east, north, up, or geocentric coordinates
    unknown: np.ndarray  # of each station's components: the unknown's number in its network, or -1
    row_net: np.ndarray
    kind: np.ndarray
    stations: np.ndarray  # (rows, 3), -1 where a type names none
    value: np.ndarray
    extra: np.ndarray  # (rows, EXTRAS): an unknown's number, or -1
    factor: np.ndarray  # (rows, EXTRAS): its partial
    extra_value: np.ndarray  # of all such unknowns of the task
    extra_at: np.ndarray  # (rows, EXTRAS): the place there, or -1
    unknowns: np.ndarray  # of each network
    pair: tuple[np.ndarray, np.ndarray, np.ndarray]  # rows i and k, weight
    offset: np.ndarray  # of rows: target height less instrument height
    local: Callable | None = None  # positions -> (n, 3, 3) rotations to the local horizon, and heights
    rows_of: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.rows_of = {k: np.flatnonzero(self.kind == k) for k in np.unique(self.kind).tolist()}

    def linearise(self, position: np.ndarray, extra_value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Misclosures, partials and the unknowns' numbers in their networks, of each row."""
        at, to, third = self.stations.T
        misclosure, a = np.zeros(len(self.value)), np.zeros((len(self.value), 9 + EXTRAS))
        turn, height = self.local(position) if self.local else (None, position[:, 2])
        for kind, own in self.rows_of.items():
            i, j, k = at[own], to[own], third[own]
            g_to = g_third = np.zeros((len(own), 3))
            axis = {"X": 0, "Y": 1, "Z": 2}.get(kind[0]) if kind[1:] in ("_DIFFERENCE", "_COORDINATE") else None
            if axis is not None or kind in ("HEIGHT", "HEIGHT_DIFFERENCE", "GRAVITY", "GRAVITY_DIFFERENCE"):
                by = np.zeros((len(position), 3))
                by[:, 2 if axis is None else axis] = 1.0
                level = position[:, 2 if axis is None else axis]
                if axis is None and turn is not None:
                    by, level = turn[:, 2], height
                if STATIONS_OF[kind] == 1:
                    computed, g_at = level[i], by[i]
                else:
                    computed, g_at, g_to = level[j] - level[i], -by[i], by[j]
            else:
                d, far = position[j] - position[i], position[k] - position[i]
                if turn is not None:
                    d, far = np.einsum("rij,rj->ri", turn[i], d), np.einsum("rij,rj->ri", turn[i], far)
                if kind in ("SLOPE_DISTANCE", "ZENITH_ANGLE", "VERTICAL_ANGLE"):
                    d = d + np.array([0.0, 0.0, 1.0]) * self.offset[own, None]
                computed, g_to, g_third = line(kind, d, far)
                if turn is not None:
                    g_to, g_third = np.einsum("rji,rj->ri", turn[i], g_to), np.einsum("rji,rj->ri", turn[i], g_third)
                g_at = -g_to - g_third
            a[own] = np.concatenate((g_at, g_to, g_third, self.factor[own]), 1)
            held = np.append(extra_value, 0.0)[self.extra_at[own]]
            raw = self.value[own] - computed - (self.factor[own] * held).sum(1)
            misclosure[own] = wrapped(raw) if kind in ANGULAR else raw
        names = np.concatenate([np.where(self.stations[:, s, None] >= 0, self.unknown[self.stations[:, s]], -1) for s in range(3)] + [self.extra], 1)
        return misclosure, np.where(names >= 0, a, 0.0), names

    def normal(self, misclosure, a, names) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Entries (network, i, j, value, row) of the normal matrices, and (network, i, value) of the right sides."""
        i, k, p = self.pair
        net = self.row_net[i]
        x, y = np.nonzero((names >= 0).any(0))[0], np.nonzero((names >= 0).any(0))[0]  # columns in use
        rows, cols = names[i][:, x, None], names[k][:, None, y]
        value = p[:, None, None] * a[i][:, x, None] * a[k][:, None, y]
        good = np.broadcast_to((rows >= 0) & (cols >= 0), value.shape)
        nets = np.broadcast_to(net[:, None, None], value.shape)
        side = p[:, None] * a[i] * misclosure[k][:, None]
        use = names[i] >= 0
        shape = value.shape
        entries = nets[good], np.broadcast_to(rows, shape)[good], np.broadcast_to(cols, shape)[good], value[good], np.broadcast_to(i[:, None, None], shape)[good]
        return entries, (np.broadcast_to(net[:, None], use.shape)[use], names[i][use], side[use])


def datum(position: np.ndarray, unknown: np.ndarray, n: int, defect: tuple[str, ...], orientations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one network: inner constraints (coordinates only) and the null vectors they stand for, a column each."""
    g, whole = np.zeros((n, len(defect))), np.zeros((n, len(defect)))
    free = (unknown >= 0).any(1)
    centred = position - (position[free].mean(0) if free.any() else 0.0)
    for column, d in enumerate(defect):
        if d == "rotation":
            move = np.stack((-centred[:, 1], centred[:, 0], np.zeros(len(centred))), 1)
        elif d == "scale":
            move = centred
        else:
            move = np.zeros_like(centred)
            move[:, "xyz".index(d)] = 1.0
        has = unknown >= 0
        length = max(np.linalg.norm(move[has]), 1e-300)
        g[unknown[has], column] = move[has] / length
        whole[:, column] = g[:, column]
        if d == "rotation":
            whole[orientations, column] = -1.0 / length
    return g, whole


def stacked(n: np.ndarray, u: np.ndarray, sizes: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solutions, cofactors and rank defects of a stack of normal matrices; beyond `sizes` they hold ones on the diagonal."""
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", n), 1e-300))
    scaled = n / scale[:, :, None] / scale[:, None, :]
    border = 0 if g is None else g.shape[2]
    if border:
        held = g * scale[:, :, None]
        held = held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-300)
        values = np.linalg.eigvalsh(scaled + held @ held.transpose(0, 2, 1))
    else:
        values = np.linalg.eigvalsh(scaled)
    missing = (values < RANK_TOLERANCE * np.maximum(values[:, -1:], 1e-300)).sum(1)
    whole = np.zeros((len(n), n.shape[1] + border, n.shape[1] + border))
    whole[:, : n.shape[1], : n.shape[1]] = scaled
    if border:
        held = g / scale[:, :, None]  # constraints on x, in terms of the scaled unknowns
        held = held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-300)
        whole[:, : n.shape[1], n.shape[1] :] = held
        whole[:, n.shape[1] :, : n.shape[1]] = held.transpose(0, 2, 1)
    whole[missing > 0] = np.eye(whole.shape[1])
    q = np.linalg.inv(whole)[:, : n.shape[1], : n.shape[1]] / scale[:, :, None] / scale[:, None, :]
    q = 0.5 * (q + q.transpose(0, 2, 1))
    q[missing > 0] = np.nan
    return np.einsum("kij,kj->ki", q, u), q, missing


def levels(n: int, rows: np.ndarray, cols: np.ndarray) -> list[np.ndarray]:
    """Unknowns by their distance from one end of each connected part; those of a level touch the next and the last only."""
    order = np.argsort(rows, kind="stable")
    cols, start = cols[order], np.searchsorted(rows[order], np.arange(n + 1))

    def walk(root: int, seen: np.ndarray) -> list[np.ndarray]:
        out = [np.array([root])]
        seen[root] = True
        while len(out[-1]):
            near = np.unique(np.concatenate([cols[start[i] : start[i + 1]] for i in out[-1].tolist()]))
            near = near[~seen[near]]
            seen[near] = True
            out.append(near)
        return out[:-1]

    seen, found = np.zeros(n, bool), []
    while not seen.all():
        root = int(np.argmin(seen))
        end = walk(root, seen.copy())[-1]  # far from where we are: the levels from there are narrow
        found += walk(int(end[np.argmin(start[end + 1] - start[end])]), seen)
    return found


class Tridiagonal:
    """One large normal matrix in levels: its solution and the cofactors inside its blocks."""

    def __init__(self, n: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.scale = np.sqrt(np.maximum(np.bincount(rows[rows == cols], values[rows == cols], n), 1e-300))
        self.parts = levels(n, rows, cols)
        self.level, self.inside = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, part in enumerate(self.parts):
            self.level[part], self.inside[part] = k, np.arange(len(part))
        width = np.array([len(p) for p in self.parts])
        below = np.concatenate(([0], width[:-1]))
        self.numbers = int((width * (width + below)).sum())
        #: Blocks of a level with itself, then with the level before, one after the other.
        self.first = np.concatenate(([0], np.cumsum(width * (width + below))[:-1]))
        self.width, self.below = width, below
        if self.numbers <= BLOCK_NUMBERS:
            keep = self.level[cols] <= self.level[rows]
            self.flat = np.bincount(self._place(rows[keep], cols[keep]), (values / self.scale[rows] / self.scale[cols])[keep], self.numbers)

    def _place(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        k = self.level[rows]
        same = self.level[cols] == k
        return self.first[k] + np.where(same, self.inside[rows] * self.width[k], self.width[k] ** 2 + self.inside[rows] * self.below[k]) + self.inside[cols]

    def _blocks(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        w, b = int(self.width[k]), int(self.below[k])
        at = int(self.first[k])
        return self.flat[at : at + w * w].reshape(w, w), self.flat[at + w * w : at + w * (w + b)].reshape(w, b)

    def factor(self, hold: np.ndarray | None = None) -> None:
        """Inverts level by level; raises LinAlgError where N has no full rank. `hold` adds its square to N."""
        self.inverse, self.carry, self.lower = [], [], []
        for k, part in enumerate(self.parts):
            d, b = self._blocks(k)
            d = d.copy()
            if hold is not None:
                h = hold[part]
                d += h @ h.T
                b = b + h @ hold[self.parts[k - 1]].T if k else b
            if k:
                w = self.inverse[-1] @ b.T
                d -= b @ w
                self.carry.append(w)
            self.lower.append(b)
            chol = np.linalg.cholesky(d)
            if np.diag(chol).min() ** 2 < RANK_TOLERANCE * max(1.0, float(np.diag(d).max())):
                raise np.linalg.LinAlgError("rank")
            self.inverse.append(np.linalg.inv(d))

    def apply(self, sides: np.ndarray) -> np.ndarray:
        """N^-1 times the columns, once N is factored."""
        y = sides / self.scale[:, None]
        for k in range(1, len(self.parts)):
            y[self.parts[k]] -= self.carry[k - 1].T @ y[self.parts[k - 1]]
        for k in range(len(self.parts) - 1, -1, -1):
            part = self.parts[k]
            y[part] = self.inverse[k] @ y[part]
            if k + 1 < len(self.parts):
                y[part] -= self.carry[k] @ y[self.parts[k + 1]]
        return y / self.scale[:, None]

    def select(self) -> None:
        """Puts the cofactors in the blocks' places, from the last level back."""
        out = np.empty_like(self.flat)
        last = None
        for k in range(len(self.parts) - 1, -1, -1):
            w, b, at = int(self.width[k]), int(self.below[k]), int(self.first[k])
            q = self.inverse[k]
            if last is not None:
                cross = -last @ self.carry[k].T  # of the next level with this one
                q = q - self.carry[k] @ cross
                up = int(self.first[k + 1]) + int(self.width[k + 1]) ** 2
                out[up : up + cross.size] = cross.ravel()
            last = 0.5 * (q + q.T)
            out[at : at + w * w] = last.ravel()
        self.cofactors = out

    def gathered(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Entries of a symmetric matrix of N's pattern, scaled and put into the blocks' places."""
        keep = self.level[cols] <= self.level[rows]
        return np.bincount(self._place(rows[keep], cols[keep]), (values / self.scale[rows] / self.scale[cols])[keep], self.numbers)

    def between(self, blocks: np.ndarray) -> np.ndarray:
        """The blocks of Q E Q, for the scaled blocks of a symmetric E: what the selected inverse gains a unit of N - tE, found by
        differentiating both passes, without any entry of Q outside the blocks."""

        def own(k: int) -> tuple[np.ndarray, np.ndarray]:
            w, b, at = int(self.width[k]), int(self.below[k]), int(self.first[k])
            return blocks[at : at + w * w].reshape(w, w), blocks[at + w * w : at + w * (w + b)].reshape(w, b)

        inverse, carry = [], []
        for k in range(len(self.parts)):
            e, f = own(k)
            d = -e
            if k:
                w = inverse[-1] @ self.lower[k].T - self.inverse[k - 1] @ f.T
                d = d + f @ self.carry[k - 1] - self.lower[k] @ w
                carry.append(w)
            inverse.append(-self.inverse[k] @ d @ self.inverse[k])
        out = np.empty_like(blocks)
        last = gain = None
        for k in range(len(self.parts) - 1, -1, -1):
            w, at = int(self.width[k]), int(self.first[k])
            q, dq = self.inverse[k], inverse[k]
            if last is not None:
                cross = -last @ self.carry[k].T
                change = -gain @ self.carry[k].T - last @ carry[k].T
                q, dq = q - self.carry[k] @ cross, dq - carry[k] @ cross - self.carry[k] @ change
                up = int(self.first[k + 1]) + int(self.width[k + 1]) ** 2
                out[up : up + change.size] = change.ravel()
            last, gain = 0.5 * (q + q.T), 0.5 * (dq + dq.T)
            out[at : at + w * w] = gain.ravel()
        return out

    def product_trace(self, one: np.ndarray, other: np.ndarray) -> float:
        """The trace of the product of two symmetric matrices given by their blocks."""
        total = 0.0
        for k in range(len(self.parts)):
            w, b, at = int(self.width[k]), int(self.below[k]), int(self.first[k])
            total += float(one[at : at + w * w] @ other[at : at + w * w]) + 2.0 * float(one[at + w * w : at + w * (w + b)] @ other[at + w * w : at + w * (w + b)])
        return total

    def of(self, rows: np.ndarray, cols: np.ndarray, blocks: np.ndarray | None = None) -> np.ndarray:
        """Cofactors of unknowns whose levels are at most one apart, or entries of other scaled blocks."""
        swap = self.level[rows] < self.level[cols]
        a, b = np.where(swap, cols, rows), np.where(swap, rows, cols)
        return (self.cofactors if blocks is None else blocks)[self._place(a, b)] / self.scale[rows] / self.scale[cols]


class Large:
    """One large network: free of its datum defect by holding its first unknowns, then moved to the inner constraints."""

    def __init__(self, n: int, rows, cols, values, u, g, whole):
        self.n = n
        self.matrix = Tridiagonal(n, rows, cols, values)
        if self.matrix.numbers > BLOCK_NUMBERS:
            raise MemoryError
        self.g, self.whole = g, whole
        hold = None
        if g is not None and g.shape[1]:
            near = np.concatenate(self.matrix.parts[:2])
            hold = np.zeros_like(g)
            hold[near] = whole[near] * self.matrix.scale[near, None]
            hold /= np.maximum(np.linalg.norm(hold, axis=0), 1e-300)
            self.a = np.linalg.inv(g.T @ whole)
            self.matrix.factor(hold)
            got = self.matrix.apply(np.concatenate((u[:, None], g), 1))
            self.x = got[:, 0] - whole @ (self.a @ (g.T @ got[:, 0]))
            self.k = got[:, 1:]  # Q times G
        else:
            self.matrix.factor()
            self.x = self.matrix.apply(u[:, None])[:, 0]

    def square(self) -> None:
        """Prepares squared(): the blocks of the held inverse's square, and what the move to the inner constraints adds."""
        matrix = self.matrix
        every = np.arange(self.n)
        self.twice = matrix.between(matrix.gathered(every, every, np.ones(self.n)))
        if self.g is not None and self.g.shape[1]:
            self.ea = self.whole @ self.a
            both = matrix.apply(np.concatenate((self.k, self.ea), 1))
            self.k2, self.la = both[:, : self.k.shape[1]], both[:, self.k.shape[1] :]

    def squared(self, n_rows: int, row: np.ndarray, unknown: np.ndarray, value: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """|Q s|^2 for sparse vectors s given as entries (row, unknown, value), x and y all pairs of entries of one vector. Q is T M T' with
        T = I - ea G', so beside s' M^2 s there are terms in as many numbers as the datum has defects."""
        out = np.bincount(row[x], value[x] * value[y] * self.matrix.of(unknown[x], unknown[y], self.twice), n_rows)
        if self.g is None or not self.g.shape[1]:
            return out
        against = lambda m: np.stack([np.bincount(row, value * m[unknown, c], n_rows) for c in range(m.shape[1])], 1)
        beta = against(self.ea)
        left = against(self.k) - beta @ (self.g.T @ self.k).T
        along = against(self.la) - beta @ (self.ea.T @ self.k).T
        out += -2.0 * (beta * against(self.k2)).sum(1) + ((beta @ (self.k.T @ self.k)) * beta).sum(1)
        return out - 2.0 * (left * along).sum(1) + ((left @ (self.ea.T @ self.ea)) * left).sum(1)

    def traces(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """tr(Q N_k) and tr(Q N_k Q N_j) of parts of N that leave the datum's null vectors at zero, given by their blocks: M does for Q."""
        once = np.array([self.matrix.product_trace(self.matrix.cofactors, p) for p in parts])
        moved = [self.matrix.between(p) for p in parts]
        return once, np.array([[self.matrix.product_trace(m, p) for p in parts] for m in moved])

    def of(self, rows, cols) -> np.ndarray:
        q = self.matrix.of(rows, cols)
        if self.g is not None and self.g.shape[1]:
            ea = self.whole @ self.a
            middle = self.g.T @ self.k
            q = q - (ea[rows] * self.k[cols]).sum(1) - (self.k[rows] * ea[cols]).sum(1) + np.einsum("ri,ij,rj->r", ea[rows], middle, ea[cols])
        return q


def solve(net: Networks, defect: tuple[str, ...], orientation_of: np.ndarray, once: bool = False, influence: bool = False, groups: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gauss-Newton over all networks of a task; those that have converged stay as they are. `once`: one linearisation at the
    given coordinates, for a design. Returns positions, extra values, and by network converged, iterations, rank_defect,
    too_large; by row residual, cofactor sums; and the entries (network, i, j, q) of the pattern of N. With `influence` also,
    by row, the norm of Q A'P e; with `groups` of rows (numbers, -1 for none) also, by network, tr(Q N_k) and tr(Q N_k Q N_j) of
    the groups' parts of N."""
    parts = 0 if groups is None else int(groups.max(initial=-1)) + 1
    nets = len(net.unknowns)
    position, extra = net.position.copy(), net.extra_value.copy()
    alive, converged = net.unknowns > 0, net.unknowns == 0
    steps, missing, too_large = np.zeros(nets, np.int32), np.zeros(nets, np.int32), np.zeros(nets, bool)
    offset = np.concatenate(([0], np.cumsum(net.unknowns)))
    station_first = np.searchsorted(net.station_net, np.arange(nets + 1))
    size = SIZES[np.minimum(np.searchsorted(SIZES, net.unknowns), len(SIZES) - 1)]
    big = net.unknowns > DENSE
    turns = [[] for _ in range(nets)] if defect else []
    if defect:
        for k, i in orientation_of.tolist():
            turns[k].append(i)

    def constraints(k: int):
        own = slice(station_first[k], station_first[k + 1])
        return datum(position[own], net.unknown[own], int(net.unknowns[k]), defect, np.array(turns[k], np.int64))

    def step(chosen: np.ndarray, cofactors: bool):
        """Corrections of the chosen networks, all in one array, and a function that looks up cofactors."""
        misclosure, a, names = net.linearise(position, extra)
        (kn, ki, kj, kv, kr), (un, ui, uv) = net.normal(misclosure, a, names)
        of_group = groups[kr] if cofactors and parts else None
        x = np.full(offset[-1], np.nan)
        u = np.bincount(offset[un] + ui, uv, offset[-1]) if offset[-1] else np.zeros(0)
        q_at, tables, squares, larges = np.zeros(nets, np.int64), [], [], {}
        at = 0
        for width in np.unique(size[chosen & ~big]).tolist():
            own = np.flatnonzero(chosen & ~big & (size == width))
            slot = np.full(nets, -1)
            slot[own] = np.arange(len(own))
            for some in np.array_split(own, max(1, len(own) * width * width >> 22)):
                slot[:] = -1
                slot[some] = np.arange(len(some))
                use = slot[kn] >= 0
                n = np.bincount((slot[kn[use]] * width + ki[use]) * width + kj[use], kv[use], len(some) * width * width).reshape(-1, width, width)
                beyond = np.arange(width) >= net.unknowns[some][:, None]
                n[:, np.arange(width), np.arange(width)] += beyond
                side = np.zeros((len(some), width))
                side[~beyond] = u[np.concatenate([np.arange(offset[k], offset[k + 1]) for k in some.tolist()])]
                g = None
                if defect:
                    g = np.zeros((len(some), width, len(defect)))
                    for s, k in enumerate(some.tolist()):
                        g[s, : net.unknowns[k]] = constraints(k)[0]
                dx, q, lack = stacked(n, side, net.unknowns[some], g)
                missing[some] = lack
                x[np.concatenate([np.arange(offset[k], offset[k + 1]) for k in some.tolist()])] = dx[~beyond]
                if cofactors:
                    q_at[some] = at + np.arange(len(some)) * width * width
                    tables.append(q.ravel())
                    at += q.size
                    if influence:
                        squares.append((q @ q).ravel())
                    moved = []
                    for part in range(parts):
                        mine = use & (of_group == part)
                        own_n = np.bincount((slot[kn[mine]] * width + ki[mine]) * width + kj[mine], kv[mine], len(some) * width * width).reshape(-1, width, width)
                        moved.append(q @ own_n)
                        once_traced[some, part] = np.einsum("sii->s", moved[-1])
                    for one, x_one in enumerate(moved):
                        for other, x_other in enumerate(moved):
                            traced[some, one, other] = np.einsum("sij,sji->s", x_one, x_other)
        by_net = np.argsort(kn, kind="stable") if (chosen & big).any() else np.zeros(0, np.int64)
        for k in np.flatnonzero(chosen & big).tolist():
            own = by_net[np.searchsorted(kn[by_net], k) : np.searchsorted(kn[by_net], k, side="right")]
            try:
                g, whole = constraints(k) if defect else (None, None)
                larges[k] = Large(int(net.unknowns[k]), ki[own], kj[own], kv[own], u[offset[k] : offset[k + 1]], g, whole)
                x[offset[k] : offset[k + 1]] = larges[k].x
                if cofactors:
                    larges[k].matrix.select()
                    if influence:
                        larges[k].square()
                    if parts:
                        of_part = [own[of_group[own] == part] for part in range(parts)]
                        once_traced[k], traced[k] = larges[k].traces([larges[k].matrix.gathered(ki[e], kj[e], kv[e]) for e in of_part])
                else:
                    del larges[k]
            except np.linalg.LinAlgError:
                missing[k] = 1
            except MemoryError:
                too_large[k] = True
        flat = np.concatenate(tables) if tables else np.zeros(0)

        def look(n, i, j):
            out = np.full(len(n), np.nan)
            dense = ~big[n] & chosen[n]
            out[dense] = flat[q_at[n[dense]] + i[dense] * size[n[dense]] + j[dense]]
            for k, own in larges.items():
                here = np.flatnonzero(n == k)
                out[here] = own.of(i[here], j[here])
            return out

        def squared(r, u, v):
            """|Q s|^2 of sparse vectors, one a row, given as entries sorted by row."""
            first = np.searchsorted(r, r)
            each = np.searchsorted(r, r, side="right") - first
            x = np.repeat(np.arange(len(r)), each)
            y = np.arange(len(x)) - np.repeat(np.cumsum(each) - each, each) + first[x]
            n = net.row_net[r]
            dense = (~big[n] & chosen[n])[x]
            flat2 = np.concatenate(squares) if squares else np.zeros(0)
            here = n[x[dense]]
            out = np.bincount(r[x[dense]], v[x[dense]] * v[y[dense]] * flat2[q_at[here] + u[x[dense]] * size[here] + u[y[dense]]], len(net.row_net))
            for k, own in larges.items():
                mine = n[x] == k
                entries = np.flatnonzero(n == k)
                place = np.full(len(r), -1)
                place[entries] = np.arange(len(entries))
                if len(entries):
                    out = out + own.squared(len(net.row_net), r[entries], u[entries], v[entries], place[x[mine]], place[y[mine]])
            return out

        return misclosure, a, names, x, look, (kn, ki, kj), squared

    once_traced, traced = np.zeros((nets, parts)), np.zeros((nets, parts, parts))
    free = net.unknown >= 0
    free_at = (offset[net.station_net][:, None] + net.unknown)[free]
    extra_net, extra_unknown = np.zeros(len(extra), np.int64), np.zeros(len(extra), np.int64)
    has = net.extra_at >= 0
    extra_net[net.extra_at[has]], extra_unknown[net.extra_at[has]] = np.broadcast_to(net.row_net[:, None], has.shape)[has], net.extra[has]
    while alive.any() and not once:
        x = step(alive, False)[3]
        largest = np.zeros(nets)
        np.maximum.at(largest, np.repeat(np.arange(nets), net.unknowns), np.abs(x))
        done = alive & (largest < CONVERGENCE)
        lost = alive & ~np.isfinite(largest)
        move = np.where(np.repeat(alive & ~lost, net.unknowns), x, 0.0)  # the last small correction too
        position[free] += move[free_at]
        extra += move[offset[extra_net] + extra_unknown]
        converged |= done
        steps[alive & ~lost] += 1
        alive &= ~done & ~lost & (steps < ITERATIONS)
    chosen = (net.unknowns > 0) & (converged | once)
    misclosure, a, names, x, look, (kn, ki, kj), squared = step(chosen, True)
    converged &= missing == 0
    full = np.concatenate((x, [0.0]))
    dx = full[np.where(names >= 0, offset[net.row_net][:, None] + names, len(x))]
    residual = (a * dx).sum(1) - misclosure
    # redundancy of row i: 1 - sum over k of (a_i Q a_k') p_ki, over the rows k it is correlated with
    i, k, p = net.pair
    share = np.zeros(len(residual))
    columns = np.flatnonzero((names >= 0).any(0))
    for c in columns.tolist():
        for d in columns.tolist():
            good = (names[i, c] >= 0) & (names[k, d] >= 0)
            own_i, own_k = i[good], k[good]
            share += np.bincount(own_i, p[good] * a[own_i, c] * a[own_k, d] * look(net.row_net[own_i], names[own_i, c], names[own_k, d]), len(residual))
    weighted = np.bincount(i, p * residual[k], len(residual))
    norms = np.full(len(residual), np.nan)
    if influence:  # the vectors A'P e of rows: entries by row and unknown, those of correlated rows added up
        use = names[k] >= 0
        entry = (np.broadcast_to(i[:, None], use.shape)[use] << 20) | names[k][use]
        entry, of_entry = np.unique(entry, return_inverse=True)
        amount = np.bincount(of_entry, (p[:, None] * a[k])[use], len(entry))
        norms = np.sqrt(np.maximum(squared(entry >> 20, entry & 0xFFFFF, amount), 0.0))
    key = (kn.astype(np.int64) << 40) | (ki << 20) | kj
    key = np.unique(key[chosen[kn]])
    qn, qi, qj = key >> 40, (key >> 20) & 0xFFFFF, key & 0xFFFFF
    return {"position": position, "extra": extra, "converged": converged, "iterations": steps, "rank_defect": missing, "too_large": too_large, "residual": residual, "weighted": weighted, "redundancy": 1.0 - share, "q": (qn, qi, qj, look(qn, qi, qj)), "influence": norms, "once_traced": once_traced, "traced": traced}
