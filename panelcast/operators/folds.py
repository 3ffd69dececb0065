"""Sequential statistics of one series as folds over its values in order: expanding scale, change points, segments.

Each takes an array (nulls are missing values) and gives an array of the same length. Expressions are SQL text, as they nest lambdas
deeply. A series is one row, as long as its calendar; memory grows with its length, never with pairs of its values.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOUBLES = "CAST(array() AS ARRAY<DOUBLE>)"


def expanding_scale(x: str, least: int = 4, floor: float = 0.01) -> str:
    """1.4826 times the median absolute deviation of the values before, floor at least; null before least values.

    The values so far stay sorted: one is inserted a step, and the deviations come in rising order from the centre outward by two
    pointers, of which only the middle ones are looked at.
    """
    n = "size(_a.s)"
    centre = f"((_a.s[({n} - 1) div 2] + _a.s[{n} div 2]) / 2)"
    # l and r point at the nearest values not yet taken to the left and right of the centre; d and e are the last two deviations
    left, right = "IF(_p.l < 0, CAST('Infinity' AS DOUBLE), _c.m - _a.s[_p.l])", f"IF(_p.r >= {n}, CAST('Infinity' AS DOUBLE), _a.s[_p.r] - _c.m)"
    take = f"IF({left} <= {right}, named_struct('l', _p.l - 1, 'r', _p.r, 'd', {left}, 'e', _p.d), named_struct('l', _p.l, 'r', _p.r + 1, 'd', {right}, 'e', _p.d))"
    start = f"named_struct('l', ({n} - 1) div 2, 'r', ({n} - 1) div 2 + 1, 'd', 0.0D, 'e', 0.0D)"
    walked = f"aggregate(sequence(1, {n} div 2 + 1), {start}, (_p, _k) -> {take}, _p -> IF({n} % 2 = 1, _p.d, (_p.d + _p.e) / 2))"
    mad = f"transform(array(named_struct('m', {centre})), _c -> {walked})[0]"
    scale = f"IF({n} >= {least}, greatest(1.4826D * {mad}, {floor}D), CAST(NULL AS DOUBLE))"
    kept = "IF(_x IS NULL, _a.s, concat(filter(_a.s, _v -> _v <= _x), array(_x), filter(_a.s, _v -> _v > _x)))"
    return f"aggregate({x}, named_struct('s', {DOUBLES}, 'out', {DOUBLES}), (_a, _x) -> named_struct('s', {kept}, 'out', concat(_a.out, array({scale}))), _a -> _a.out)"


def change_probability(z: str, hazard: float = 1 / 24) -> str:
    """Probability that the current run has at most one value, under a Normal-Gamma model; missing values are passed over.

    The state has an entry for each run length r: its probability p, the mean m and the rate b of the model, whose counts follow from r,
    and g, the ratio of gamma functions gamma((r + 3) / 2) / gamma((r + 2) / 2), which the next length gets from the last.
    """
    nu, kappa, alpha = "(2.0D + _i)", "(1.0D + _i)", "(1.0D + _i / 2.0D)"
    scale = f"sqrt(_e.b * ({kappa} + 1) / ({alpha} * {kappa}))"
    density = f"_e.g / sqrt({nu} * {pi!r}D) / {scale} * power(1 + power((_x - _e.m) / {scale}, 2) / {nu}, -({nu} + 1) / 2)"
    grown = f"named_struct('p', _e.p * {density}, 'm', ({kappa} * _e.m + _x) / ({kappa} + 1), 'b', _e.b + {kappa} * power(_x - _e.m, 2) / (2 * ({kappa} + 1)), 'g', ({nu} / 2) / _e.g)"
    first = f"named_struct('p', {{0}}, 'm', 0.0D, 'b', 1.0D, 'g', {sqrt(pi) / 2!r}D)"
    scaled = f"transform(_w.v, _e -> named_struct('p', _e.p * {1 - hazard!r}D / _w.t, 'm', _e.m, 'b', _e.b, 'g', _e.g))"
    moved = f"named_struct('s', concat(array({first.format(f'{hazard!r}D')}), {scaled}), 'out', concat(_a.out, array({hazard!r}D + {1 - hazard!r}D * (_w.v[0].p / _w.t))))"
    weighed = f"transform(array(transform(_a.s, (_e, _i) -> {grown})), _v -> named_struct('v', _v, 't', aggregate(_v, 0.0D, (_t, _e) -> _t + _e.p)))"
    step = f"IF(_x IS NULL, named_struct('s', _a.s, 'out', concat(_a.out, array(CAST(NULL AS DOUBLE)))), transform({weighed}, _w -> {moved})[0])"
    return f"aggregate({z}, named_struct('s', array({first.format('1.0D')}), 'out', {DOUBLES}), (_a, _x) -> {step}, _a -> _a.out)"


GRID, START, PENALTIES = 5, 6, (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def _cost(a: str, b: str) -> str:
    """Squared deviations of the values from a to before b from their mean, by prefix sums."""
    one = f"(_s.one[{b}] - _s.one[{a}])"
    return f"greatest(_s.two[{b}] - _s.two[{a}] - {one} * {one} / ({b} - ({a})), 0.0D)"


def _last_cut_optimal() -> str:
    """Whether the best segmentation up to _t ends with a cut before its last two values.

    The dynamic programme over ends on the grid; a start whose cost exceeds the best total at an end can't be the last cut of a later
    one and is dropped.
    """
    step = f"transform(array(transform(_d, _c -> named_struct('a', _c.a, 'f', _c.f, 'v', _c.f + {_cost('_c.a', '_b')}))), _y -> named_struct('y', _y, 'best', array_min(transform(_y, _c -> _c.v)) + _g.pen))"
    pruned = f"transform({step}, _q -> concat(transform(filter(_q.y, _c -> _c.v <= _q.best), _c -> named_struct('a', _c.a, 'f', _c.f)), array(named_struct('a', _b, 'f', _q.best))))[0]"
    total = f"transform(_d, _c -> named_struct('a', _c.a, 'v', _c.f + {_cost('_c.a', '_t + 1')}))"
    last = f"array_min(transform(filter({total}, _c -> _c.a = _t - 1), _c -> _c.v)) < coalesce(array_min(transform(filter({total}, _c -> _c.a < _t - 1), _c -> _c.v)), CAST('Infinity' AS DOUBLE))"
    return f"aggregate(transform(sequence(1, (_t - 1) div {GRID}), _k -> _k * {GRID}), array(named_struct('a', 0L, 'f', -_g.pen)), (_d, _b) -> {pruned}, _d -> {last})"


def _last_cut_binary() -> str:
    """Whether splitting at the best gain, as long as it exceeds the penalty, comes to a cut before the last two values; only the last segment matters."""
    gain = f"{_cost('_z.a', '_t + 1')} - {_cost('_z.a', '_c')} - {_cost('_c', '_t + 1')}"
    cuts = f"filter(transform(sequence(1, (_t - 1) div {GRID}), _k -> _k * {GRID}), _c -> _c > _z.a)"
    best = f"array_max(transform({cuts}, _c -> named_struct('gain', {gain}, 'at', -_c)))"
    # found: 0 while it goes on, 1 with the cut, 2 without
    move = "IF(_m.gain > _g.pen, IF(-_m.at = _t - 1, named_struct('a', _z.a, 'found', 1), named_struct('a', -_m.at, 'found', 0)), named_struct('a', _z.a, 'found', 2))"
    step = f"IF(_z.found <> 0, _z, transform(array({best}), _m -> {move})[0])"
    return f"aggregate(sequence(1, (_t - 1) div {GRID}), named_struct('a', 0L, 'found', 0), (_z, _n) -> {step}, _z -> _z.found = 1)"


def segment_score(x: str, method: str = "pelt") -> str:
    """The largest of rising penalties, in variances of differences, at which a cut still falls before the last two values; 0 elsewhere.

    Cuts are multiples of GRID and segments have two values at least, so only the month after a multiple can score.
    """
    found = _last_cut_optimal() if method == "pelt" else _last_cut_binary()
    sums = lambda values: f"aggregate({values}, array(0.0D), (_a, _v) -> concat(_a, array(element_at(_a, -1) + _v)))"
    steps = f"transform(sequence(1, size({x}) - 1), _k -> {x}[_k] - {x}[_k - 1])"
    series = f"named_struct('one', {sums(x)}, 'two', {sums(f'transform({x}, _v -> _v * _v)')}, 'd1', {sums(steps)}, 'd2', {sums(f'transform({steps}, _v -> _v * _v)')})"
    variance = "greatest(_s.d2[_t] / _t - power(_s.d1[_t] / _t, 2), 0.0D)"
    unit = f"IF({variance} = 0, 1e-6D, {variance})"
    rising = f"aggregate(array({', '.join(f'{p}D' for p in PENALTIES)}), named_struct('ok', true, 'best', 0.0D), (_o, _p) -> IF(_o.ok AND transform(array(named_struct('pen', _p * {unit})), _g -> {found})[0], named_struct('ok', true, 'best', _p), named_struct('ok', false, 'best', _o.best)), _o -> _o.best)"
    scores = f"transform(sequence(0, size({x}) - 1), _t -> IF(_t >= {START} AND _t % {GRID} = 1, {rising}, 0.0D))"
    return f"IF(size({x}) < 2, transform({x}, _v -> 0.0D), transform(array({series}), _s -> {scores})[0])"


def over_series(rows: DataFrame, value: str, keys: tuple, fold, name: str) -> DataFrame:
    """rows with name: fold of the values of each series in order of month."""
    others = [c for c in rows.columns if c not in keys]
    ordered = F.array_sort(F.collect_list(F.struct("month", F.struct(*others).alias("row"))))
    series = rows.groupBy(*keys).agg(ordered.alias("_v"))
    made = series.withColumn("_x", F.expr(f"transform(_v, _r -> _r.row.`{value}`)")).withColumn("_f", F.expr(fold("_x")))
    each = made.select(*keys, F.inline(F.arrays_zip(F.col("_v.row").alias("row"), F.col("_f").alias("f"))))
    taken = each.select(*keys, *[F.col(each.columns[-2])[c].alias(c) for c in others], F.col(each.columns[-1]).alias(name))
    return taken.select(*rows.columns, name)

