"""Numeric kernels over array columns and over rows; all in built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once instead of wherever f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def log_sum_exp(xs: Column) -> Column:
    return let(F.array_max(xs), lambda top: top + F.ln(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def softmax(xs: Column) -> Column:
    return let(log_sum_exp(xs), lambda lse: F.transform(xs, lambda x: F.exp(x - lse)))


def log_softmax(xs: Column) -> Column:
    return let(log_sum_exp(xs), lambda lse: F.transform(xs, lambda x: x - lse))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of one row; target counts from 0."""
    return log_sum_exp(logits) - F.element_at(logits, target.cast("int") + 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def rmsnorm(xs: Column, gain: Column | None = None, eps: float = 1e-5) -> Column:
    scale = 1 / F.sqrt(total(F.transform(xs, lambda x: x * x)) / F.size(xs) + eps)
    scaled = let(scale, lambda k: F.transform(xs, lambda x: x * k))
    return scaled if gain is None else F.zip_with(scaled, gain, lambda x, g: x * g)


def linear(xs: Column, weights: Column, bias: Column | None = None) -> Column:
    """weights: an array of rows, one for each output."""
    out = F.transform(weights, lambda row: dot(row, xs))
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)


def swiglu(xs: Column, w1: Column, w2: Column, w3: Column) -> Column:
    hidden = F.zip_with(F.transform(linear(xs, w1), silu), linear(xs, w3), lambda a, b: a * b)
    return linear(hidden, w2)


def rope(xs: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotates neighbouring pairs by position / theta**(2k / d)."""
    d = F.size(xs)
    angle = lambda k: position / F.pow(F.lit(theta), 2.0 * k / d)
    even = lambda k: F.element_at(xs, 2 * k + 1)
    odd = lambda k: F.element_at(xs, 2 * k + 2)
    pair = lambda k: F.array(even(k) * F.cos(angle(k)) - odd(k) * F.sin(angle(k)), even(k) * F.sin(angle(k)) + odd(k) * F.cos(angle(k)))
    return F.flatten(F.transform(F.sequence(F.lit(0), (d / 2).cast("int") - 1), pair))


def top_k_mask(xs: Column, k: int) -> Column:
    """Values below the k-th largest become null."""
    least = F.element_at(F.sort_array(xs, asc=False), F.least(F.lit(k), F.size(xs)))
    return let(least, lambda low: F.transform(xs, lambda x: F.when(x >= low, x)))


def cosine_lr(it: Column, top: float, low: float, warm: int, cycle: int) -> Column:
    middle = low + 0.5 * (1 + F.cos(math.pi * (it - warm) / (cycle - warm))) * (top - low)
    return F.when(it < warm, top * it / warm).when(it < cycle, middle).otherwise(low)


def adamw_step(p: Column, g: Column, m: Column, v: Column, t: Column, lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, decay: float = 0.01) -> dict[str, Column]:
    """One step; bias correction in the rate, then decoupled decay."""
    m1, v1 = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
    rate = lr * F.sqrt(1 - F.pow(F.lit(beta2), t)) / (1 - F.pow(F.lit(beta1), t))
    moved = p - rate * m1 / (F.sqrt(v1) + eps)
    return {"p": moved - lr * decay * moved, "m": m1, "v": v1}


def gradient_clip(grads: DataFrame, column: str, most: float) -> DataFrame:
    """Scales a column so that its norm over all rows is at most `most`; the norm is one aggregated row."""
    norm = grads.agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("norm"))
    scaled = F.col(column) * F.least(F.lit(1.0), most / (F.col("norm") + 1e-6))
    return grads.join(F.broadcast(norm), F.lit(True)).withColumn(column, scaled).drop("norm")


def attention(q: DataFrame, kv: DataFrame, causal: bool = True) -> DataFrame:
    """Scaled dot-product attention per sequence: q (seq, pos, q), kv (seq, pos, k, v) to (seq, pos, out, lse).

    The mask is a range join inside a sequence; softmax and the weighted sum are
    one aggregation for each query.
    """
    left, right = q.select("seq", F.col("pos").alias("i"), "q"), kv.select("seq", F.col("pos").alias("j"), "k", "v")
    on = (left["seq"] == right["seq"]) & (F.col("j") <= F.col("i") if causal else F.lit(True))
    scores = left.join(right, on).select(left["seq"], "i", "j", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q"))).alias("s"), "v")
    peak = scores.withColumn("top", F.max("s").over(Window.partitionBy("seq", "i")))
    spread = peak.select("seq", "i", "top", F.exp(F.col("s") - F.col("top")).alias("e"), F.posexplode("v").alias("c", "x"))
    sums = spread.groupBy("seq", "i", "c").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("o"), (F.max("top") + F.ln(F.sum("e"))).alias("lse"))
    return sums.groupBy("seq", F.col("i").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "o"))), lambda x: x["o"]).alias("out"), F.max("lse").alias("lse"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse matrices (i, j, v) and (j, k, v) multiplied by joining on j."""
    left, right = a.select("i", "j", F.col("v").alias("x")), b.select("j", F.col("k"), F.col("v").alias("y"))
    return left.join(right, "j").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
