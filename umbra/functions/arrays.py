"""Folds over long arrays as Spark expressions.

``aggregate`` with an array in its state copies that array at every step, which is
quadratic. Here an array is folded in chunks of the square root of its length, so that
a step copies a short array only; 100,000 elements take a fraction of a second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(xs: Column) -> Column:
    """``xs`` cut into arrays of about the square root of its length; one empty array
    for an empty one. ``xs`` should be bound by ``let``."""
    n = F.size(xs)
    k = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    last = F.greatest(F.lit(0), F.ceil(n / k).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(xs, c * k + 1, k))


def scan(xs: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], emits: str) -> Column:
    """What ``step(carry, x) -> (carry, array of emitted elements)`` emits, in order.
    ``emits`` is the type of an element."""

    def one(state, x):
        after, out = step(state["carry"], x)
        return F.struct(after.alias("carry"), F.concat(state["out"], out).alias("out"))

    def chunk(state, ch):
        begun = F.struct(state["carry"].alias("carry"), F.array().cast(f"array<{emits}>").alias("out"))
        inner = F.aggregate(ch, begun, one)
        return let(inner, lambda r: F.struct(r["carry"].alias("carry"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    begun = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{emits}>>").alias("out"))
    folded = let(xs, lambda v: F.aggregate(chunks(v), begun, chunk, lambda s: F.flatten(s["out"])))
    return F.when(F.size(xs) == 0, F.array().cast(f"array<{emits}>")).otherwise(folded)


def starts(gaps_and_lengths: Column) -> Column:
    """array<struct<gap:int,len:int>> to the place at which each element starts."""
    return scan(gaps_and_lengths, F.lit(0), lambda at, x: (at + x["gap"] + x["len"], F.array(at + x["gap"])), "int")
