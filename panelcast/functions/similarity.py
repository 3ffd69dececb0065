"""Similarity of short texts in percent: longest common subsequences, best windows, word sets, and their weighted best.

Expressions are built as SQL text, as they nest lambdas deeply: a column of thousands of calls takes the driver seconds. Arguments are
SQL expressions, as a rule column names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a machine word that hold a stretch of a text; a sum of two words fits a long.
BITS = 60
FULL = f"{(1 << BITS) - 1}L"

# Fixed values of the weighted ratio.
WORDS_SCALE = 0.95
LONG, FAR_LONGER = 1.5, 8.0
PART_SCALE, FAR_PART_SCALE = 0.9, 0.6

_names = count()


def bind(values: dict[str, str], use: Callable[..., str]) -> str:
    """use of the values, each computed once though lambdas within it read them for each element."""
    v = f"_v{next(_names)}"
    fields = ", ".join(f"'{k}', {x}" for k, x in values.items())
    return f"transform(array(named_struct({fields})), {v} -> {use(*[f'{v}.{k}' for k in values])})[0]"


def characters(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).', 0)"


def words(text: str) -> str:
    return f"filter(split({text}, '\\\\s+'), _w -> _w <> '')"


def joined(parts: str) -> str:
    return f"array_join({parts}, ' ')"


def marks(a: str, b: str) -> str:
    """For each character of b the bits of its places in a, in words of BITS bits; a and b are arrays of characters."""
    bits = f"aggregate(transform(slice({a}, _p * {BITS} + 1, {BITS}), (_x, _i) -> shiftleft(CAST(_x = _c AS BIGINT), _i)), 0L, (_s, _x) -> _s + _x)"
    return f"transform({b}, _c -> transform(sequence(0, greatest(CAST(ceil(size({a}) / {BITS}) AS INT), 1) - 1), _p -> {bits}))"


def common(n: str, found: str) -> str:
    """Length of the longest common subsequence of a text of n characters and another, given by its marks.

    Each mark updates a row of bits, zero where the subsequence grows: an addition carries a match to the next zero. Texts of more than
    BITS characters have a row of several words, between which a sum's overflow is carried.
    """
    one = f"{BITS} - aggregate({found}, {FULL}, (_r, _m) -> ((_r + (_r & _m[0])) & {FULL}) | (_r - (_r & _m[0])), _r -> bit_count(_r))"
    total = "(_q.v + (_q.v & _q.m) + _s.carry)"
    add = f"(_s, _q) -> named_struct('carry', CAST({total} > {FULL} AS BIGINT), 'out', concat(_s.out, array(({total} & {FULL}) | (_q.v - (_q.v & _q.m)))))"
    step = f"aggregate(zip_with(_r, _m, (_a, _b) -> named_struct('v', _a, 'm', _b)), named_struct('carry', 0L, 'out', CAST(array() AS ARRAY<BIGINT>)), {add}, _s -> _s.out)"
    many = f"aggregate({found}, array_repeat({FULL}, CAST(ceil({n} / {BITS}) AS INT)), (_r, _m) -> {step}, _r -> size(_r) * {BITS} - aggregate(_r, 0, (_s, _x) -> _s + bit_count(_x)))"
    return f"CASE WHEN {n} <= {BITS} THEN {one} ELSE {many} END"


def share(length: str, a: str, b: str) -> str:
    """Twice a common length over both lengths, in percent; equal if both are empty."""
    return f"CASE WHEN {a} + {b} > 0 THEN 200.0D * ({length}) / ({a} + {b}) ELSE 100.0D END"


def ratio(a: str, b: str) -> str:
    """Insertions and deletions that turn a into b, as a share of both lengths, off 100; a and b are arrays of characters."""
    return bind({"a": a, "b": b}, lambda a, b: bind({"f": marks(a, b)}, lambda f: share(common(f"size({a})", f), f"size({a})", f"size({b})")))


def part_ratio(a: str, b: str) -> str:
    """The best ratio of the shorter to a stretch of the longer that is at most as long; shorter stretches only at an end."""

    def best(m: str, n: str, found: str) -> str:
        windows = f"concat(transform(sequence(1, {n} - {m} + 1), _k -> slice({found}, _k, {m})), flatten(transform(sequence(1, {m}), _k -> array(slice({found}, 1, _k), slice({found}, {n} - _k + 1, _k)))))"
        return f"array_max(transform({windows}, _w -> {share(common(m, '_w'), m, 'size(_w)')}))"

    def sides(a: str, b: str) -> str:
        m, n = f"size({a})", f"size({b})"
        # texts of one length are compared both ways
        pairs = f"filter(array(named_struct('a', {a}, 'b', {b}), named_struct('a', {b}, 'b', {a})), _t -> size(_t.a) <= size(_t.b))"
        each = bind({"m": "size(_t.a)", "n": "size(_t.b)", "f": marks("_t.a", "_t.b")}, best)
        return f"CASE WHEN {m} = 0 OR {n} = 0 THEN IF({m} = {n}, 100.0D, 0.0D) ELSE array_max(transform({pairs}, _t -> {each})) END"

    return bind({"a": a, "b": b}, sides)


def word_set_ratio(a: str, b: str) -> str:
    """Ratio of what two lists of words share to each with the rest of its words, and of those to each other, the best; 100 if one holds the other."""

    def best(a: str, b: str, both: str, p: str, q: str, s: str) -> str:
        left, right = f"({s} + IF({s} > 0, 1, 0) + size({p}))", f"({s} + IF({s} > 0, 1, 0) + size({q}))"
        rest = f"100.0D - 100.0D * (size({p}) + size({q}) - 2 * {bind({'f': marks(p, q)}, lambda f: common(f'size({p})', f))}) / ({left} + {right})"
        near = f"greatest({rest}, 100.0D - 100.0D * ({left} - {s}) / ({s} + {left}), 100.0D - 100.0D * ({right} - {s}) / ({s} + {right}))"
        return f"CASE WHEN size({both}) > 0 AND (size({p}) = 0 OR size({q}) = 0) THEN 100.0D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0.0D WHEN {s} > 0 THEN {near} ELSE {rest} END"

    rest = lambda x, y: characters(joined(f"array_sort(array_except({x}, {y}))"))
    both = "array_intersect({0}, {1})"
    return bind({"a": a, "b": b}, lambda a, b: bind({"a": a, "b": b, "both": both.format(a, b), "p": rest(a, b), "q": rest(b, a), "s": f"length({joined(both.format(a, b))})"}, best))


def part_word_ratio(a: str, b: str) -> str:
    """100 if two lists of words share one; else the best window of all words in order, or of each word once."""

    def best(a: str, b: str) -> str:
        texts = lambda form: ", ".join(f"'{k}', {characters(joined(f'array_sort({form.format(x)})'))}" for k, x in (("a", a), ("b", b)))
        pairs = f"array(named_struct({texts('{0}')}), named_struct({texts('array_distinct({0})')}))"
        return f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0.0D WHEN arrays_overlap({a}, {b}) THEN 100.0D ELSE array_max(transform(array_distinct({pairs}), _u -> {part_ratio('_u.a', '_u.b')})) END"

    return bind({"a": a, "b": b}, best)


def weighted_ratio(a: str, b: str) -> Column:
    """The best of several ratios of two texts, by how their lengths compare; 0 for an empty text, null for a null one.

    Up to LONG times as long: the ratio, or WORDS_SCALE of that of the words in order or as a set. Longer: the ratio, or PART_SCALE
    (FAR_PART_SCALE beyond FAR_LONGER times) of the best window, or WORDS_SCALE of this of the words' best window.
    """

    def score(p: str, q: str, v: str, w: str) -> str:
        longer = f"(greatest(size({p}), size({q})) / least(size({p}), size({q})))"
        in_order = ratio(*[characters(joined(f"array_sort({x})")) for x in (v, w)])
        near = f"greatest({WORDS_SCALE}D * {in_order}, {WORDS_SCALE}D * {word_set_ratio(v, w)})"
        scale = f"IF({longer} <= {FAR_LONGER}D, {PART_SCALE}D, {FAR_PART_SCALE}D)"
        far = f"{scale} * greatest({part_ratio(p, q)}, {WORDS_SCALE}D * {part_word_ratio(v, w)})"
        return f"CASE WHEN size({p}) = 0 OR size({q}) = 0 THEN 0.0D ELSE greatest({ratio(p, q)}, CASE WHEN {longer} < {LONG}D THEN {near} ELSE {far} END) END"

    texts = {"p": characters(a), "q": characters(b), "v": words(a), "w": words(b)}
    return F.expr(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {bind(texts, score)} END")
