"""Running states over arrays, and cuts of long texts, in time that grows little faster than their length and not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the pieces that a text is cut to before many parts of it are taken.
PIECE = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def states(xs: Column, start: Column, step: Callable[[Column, Column], Column], state: str) -> Column:
    """array<state>: the state before each x of an array; step(state, x) gives the one after it. Null for a null array. state is a DDL type.

    Spark copies what an aggregate has gathered at each of its steps. So an array is walked in stretches:
    once for the states at their beginnings, then for those within each. With stretches of about the cube root
    of the array's size, a state is copied about as many times.
    """

    def walk(v: Column) -> Column:
        side = F.greatest(F.lit(8), F.ceil(F.cbrt(F.size(v))).cast("int"))
        count = lambda k: F.least(side, F.size(v) - k * side)
        places = lambda k: F.sequence(k * side, k * side + count(k) - 1)
        begin = F.array(start.cast(state)).cast(f"array<{state}>")
        over = lambda k, s: F.aggregate(places(k), s, lambda a, i: step(a, F.get(v, i)))
        # what the last of a stretch, and the last stretch, lead to is not asked for
        last = F.floor((F.size(v) - 1) / side).cast("int")
        stretches = F.sequence(F.lit(0), last)
        begins = F.aggregate(F.slice(stretches, F.lit(1), last), begin, lambda done, k: F.concat(done, F.array(over(k, F.element_at(done, -1)))))

        def within(first: Column, k: Column) -> Column:
            return F.aggregate(F.slice(places(k), F.lit(1), count(k) - 1), F.array(first), lambda done, i: F.concat(done, F.array(step(F.element_at(done, -1), F.get(v, i)))))

        inner = F.flatten(F.transform(begins, within))
        return F.when(F.size(v) > 0, inner).when(v.isNotNull(), F.array().cast(f"array<{state}>"))

    return bound(xs, walk)


def with_states(xs: Column, start: Column, step: Callable[[Column, Column], Column], state: str, told: Callable[[Column, Column], Column]) -> Column:
    """told(state before x, x) for each x of an array."""
    return bound(xs, lambda v: bound(states(v, start, step, state), lambda s: F.transform(v, lambda x, i: told(F.get(s, i), x))))


def pieces(text: Column) -> Column:
    """A text as an array of PIECE code points each, the last may have fewer."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of the text that was cut to parts: only the pieces that they lie in are read."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    inner = F.array_join(F.slice(parts, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    apart = F.concat(F.substr(F.get(parts, a), start - a * PIECE + 1), inner, F.left(F.get(parts, b), end - b * PIECE))
    return F.when(end <= start, "").when(a == b, F.substr(F.get(parts, a), start - a * PIECE + 1, end - start)).otherwise(apart)


def last_before(marks: Column, at: Column, kind: str, value: str) -> Column:
    """For each of ``at``, an ascending array<kind>, the value of the last of marks, array<struct(at, value)>, that is not after it: array<value>.

    Both are laid together, sorted once, and the value is carried forward.
    """
    shape = f"array<struct<at:{kind},side:int,value:{value}>>"
    one = F.transform(marks, lambda m: F.struct(m["at"].alias("at"), F.lit(0).alias("side"), m["value"].alias("value")))
    two = F.transform(at, lambda x: F.struct(x.alias("at"), F.lit(1).alias("side"), F.lit(None).cast(value).alias("value")))
    laid = F.array_sort(F.concat(one.cast(shape), two.cast(shape)))
    carried = with_states(laid, F.lit(None).cast(value), lambda last, x: F.when(x["side"] == 0, x["value"]).otherwise(last), value, lambda last, x: F.struct(x["side"].alias("side"), last.alias("value")))
    return F.transform(F.filter(carried, lambda x: x["side"] == 1), lambda x: x["value"])
