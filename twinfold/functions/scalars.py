"""Integer, float, string and list functions with the semantics of the behaviour
oracle: errors are null and null absorbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_add(a: Column, b: Column) -> Column:
    """64-bit addition that wraps, built on decimals since ANSI mode would throw."""
    return _wrap(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"))


def wrap_sub(a: Column, b: Column) -> Column:
    return _wrap(a.cast("decimal(38,0)") - b.cast("decimal(38,0)"))


def wrap_mul(a: Column, b: Column) -> Column:
    """64-bit multiplication that wraps: the halves are multiplied apart, since
    the whole product needs more digits than a decimal has."""
    lo, hi = F.expr("4294967296").cast("decimal(38,0)"), b.cast("decimal(38,0)")
    b_hi = F.floor(hi / lo).cast("decimal(38,0)")
    b_lo = (hi - b_hi * lo).cast("decimal(38,0)")
    a_ = a.cast("decimal(38,0)")
    high = _wrap((a_ * b_hi).cast("decimal(38,0)")).cast("decimal(38,0)")
    return _wrap(_mod64(high * lo) + _mod64(a_ * b_lo))


def _mod64(x: Column) -> Column:
    m = F.lit("18446744073709551616").cast("decimal(38,0)")
    return (((x.cast("decimal(38,0)") % m) + m) % m).cast("decimal(38,0)")


def _wrap(x: Column) -> Column:
    m = F.lit("18446744073709551616").cast("decimal(38,0)")
    r = _mod64(x)
    return F.when(r >= F.lit("9223372036854775808").cast("decimal(38,0)"), r - m).otherwise(r).cast("bigint")


def trunc_div(a: Column, b: Column) -> Column:
    """Toward zero; null for a zero divisor."""
    return F.when(b == 0, None).otherwise(F.call_function("div", a, F.when(b == 0, F.lit(1)).otherwise(b)))


def floor_div(a: Column, b: Column) -> Column:
    q = trunc_div(a, b)
    return q - F.when((F.when(b == 0, None).otherwise(a % F.when(b == 0, F.lit(1)).otherwise(b)) != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)


def trunc_mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, None).otherwise(a % F.when(b == 0, F.lit(1)).otherwise(b))


def floor_mod(a: Column, b: Column) -> Column:
    s = F.when(b == 0, F.lit(1)).otherwise(b)
    return F.when(b == 0, None).otherwise(((a % s) + s) % s)


def euclid_mod(a: Column, b: Column) -> Column:
    """The float remainder that is never negative."""
    r = a % F.when(b == 0, None).otherwise(b)
    return F.when(r < 0, r + F.abs(b)).otherwise(r)


def value_and(a: Column, b: Column) -> Column:
    return F.when(a != 0, b).otherwise(a)


def value_or(a: Column, b: Column) -> Column:
    return F.when(a != 0, a).otherwise(b)


def to_int32(a: Column) -> Column:
    low = a.bitwiseAND(F.lit(4294967295).cast("bigint"))
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low)


def to_uint32(a: Column) -> Column:
    return a.bitwiseAND(F.lit(4294967295).cast("bigint"))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def list_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def list_range(start: Column, stop: Column, step: Column) -> Column:
    """start, start + step, ... before stop; null for a zero step."""
    n = F.when(step > 0, F.ceil((stop - start) / step)).when(step < 0, F.ceil((start - stop) / -step))
    empty = F.array().cast("array<bigint>")
    return F.when(step == 0, None).when(n <= 0,
        empty).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)).cast("bigint")), lambda i: start + i * step))


def zip_short(a: Column, b: Column) -> Column:
    """Pairs up to the end of the shorter list."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def enumerate_list(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def keys_of_list(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: i)


def reduce_list(xs: Column, f) -> Column:
    """Fold without a start value; null for the empty list."""
    return F.when(F.size(xs) > 0, F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), F.get(xs, F.lit(0)), f))


def value_or_default(a: Column, d: Column) -> Column:
    return F.coalesce(a, d)


def wrap_neg(a: Column) -> Column:
    return wrap_sub(F.lit(0).cast("bigint"), a)


def float_floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / F.when(b == 0, None).otherwise(b)).cast("double")


def float_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend; null for a zero divisor."""
    return a % F.when(b == 0, None).otherwise(b)


def float_pow(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def shift_left(a: Column, n: Column) -> Column:
    """The shift counts modulo 64, as the machine takes it."""
    return F.call_function("shiftleft", a, n.bitwiseAND(F.lit(63)).cast("int"))


def shift_right(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, n.bitwiseAND(F.lit(63)).cast("int"))


def truthy_number(a: Column) -> Column:
    """Not zero; NaN is true, null false."""
    return F.coalesce(a != 0, F.lit(False))


def truthy_list(xs: Column) -> Column:
    """Also of strings as lists of pieces."""
    return F.coalesce(F.size(xs) > 0, F.lit(False))


def is_in(x: Column, xs: Column) -> Column:
    return F.array_contains(xs, x)


def length(xs: Column) -> Column:
    """Of a list; null for null."""
    return F.when(xs.isNotNull(), F.size(xs))


def is_empty(xs: Column) -> Column:
    return F.when(xs.isNotNull(), F.size(xs) == 0)


def starts_with(pieces: Column, affix: Column) -> Column:
    """Of strings as lists of opaque pieces."""
    return F.when(F.size(affix) > F.size(pieces), False).otherwise(F.slice(pieces, 1, F.size(affix)) == affix)


def ends_with(pieces: Column, affix: Column) -> Column:
    return starts_with(F.reverse(pieces), F.reverse(affix))


def string_contains(pieces: Column, needle: Column) -> Column:
    """True where the pieces of the needle stand in a row; otherwise unknown, since
    pieces are opaque."""
    n = F.size(needle)
    at = F.sequence(F.lit(1), F.greatest(F.size(pieces) - n + 1, F.lit(1)))
    return F.when((n == 0) | F.exists(at, lambda i: F.slice(pieces, i, F.greatest(n, F.lit(1))) == needle), True)


def join_pieces(separator: Column, items: Column) -> Column:
    """The pieces of the items with those of the separator between them."""
    parts = F.transform(items, lambda x, i: F.when(i > 0, F.concat(separator, x)).otherwise(x))
    return F.flatten(parts)


def reject(xs: Column, f) -> Column:
    return F.filter(xs, lambda x: ~f(x))


def flat_map(xs: Column, f) -> Column:
    return F.flatten(F.transform(xs, f))


def filter_map(xs: Column, f) -> Column:
    return F.filter(F.transform(xs, f), lambda x: x.isNotNull())


def get_or_default(m: Column, key: Column, d: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), d)


def append(xs: Column, x: Column) -> Column:
    return F.array_append(xs, x)
