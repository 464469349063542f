"""Numeric and array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IGNORED = -100


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pinned(c: Column) -> Column:
    """The column itself, but a filter on it stays above: it is not rewritten over the column's whole definition, which would be reckoned for the filter once more."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def perplexity(loss: Column, cap: float | None = 20.0) -> Column:
    """exp of the loss, cut at *cap*."""
    return F.exp(F.least(loss, F.lit(cap)) if cap is not None else loss)


def nearest_rank(values: Column, p: float) -> Column:
    """Value at index round-half-even((n - 1) p) of an array's sorted values; null for an empty one."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), (F.bround((F.size(values) - 1) * F.lit(p)) + 1).cast("int")))


def labels_aligned(prompt: Column, answer: Column, eos: int = 3) -> Column:
    """Labels at the positions of their inputs: the prompt ignored, answer and end kept."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer, F.array(F.lit(eos)))


def labels_shifted(prompt: Column, answer: Column, eos: int = 3) -> Column:
    """Labels one position ahead of their inputs; the last is ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.greatest(F.size(prompt) - 1, F.lit(0))), answer, F.array(F.lit(eos), F.lit(IGNORED)))


def sequence(prompt: Column, answer: Column, eos: int = 3) -> Column:
    """Prompt, answer, end."""
    return F.concat(prompt, answer, F.array(F.lit(eos)))


def padded(values: Column, width: Column, fill: int) -> Column:
    """An array filled up to a width."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0)).cast("int")))


def supervised(labels: Column) -> Column:
    """Number of labels that count."""
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def penalised(logits: Column, seen: Column, temperature: float = 1.0, penalty: float = 1.0) -> Column:
    """Logits over the temperature, those at seen indexes divided by the penalty, whatever their sign."""
    if temperature <= 0 or penalty < 1:
        raise ValueError("temperature must be positive and penalty at least 1")
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), x / temperature / penalty).otherwise(x / temperature))


def kept_top(logits: Column, k: int) -> Column:
    """Logits under the k-th largest become null; ties with it stay."""
    if k < 1:
        raise ValueError("k must be at least 1")
    least = lambda x: F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
    return let(logits, lambda x: let(least(x), lambda t: F.transform(x, lambda y: F.when(y >= t, y))))


def softmax(logits: Column) -> Column:
    """Probabilities; null logits get none."""
    powers = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda y: F.coalesce(F.exp(y - m), F.lit(0.0))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return let(logits, lambda x: let(powers(x), lambda e: let(total(e), lambda t: F.transform(e, lambda y: y / t))))


def tail(values: Column, n: int) -> Column:
    """The last *n* elements."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def unknown_count(ids: Column, prompt_length: Column, unk: int = 1) -> Column:
    """Unknown tokens among the first *prompt_length* ids."""
    return F.size(F.filter(F.slice(ids, F.lit(1), F.greatest(prompt_length, F.lit(0))), lambda x: x == unk))


def causal_mask(n: Column) -> Column:
    """n rows of n flags: row i sees positions up to i."""
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.transform(places, lambda j: j <= i))


def cross_entropy(logits: Column, label: Column, ignored: int = IGNORED) -> Column:
    """Loss of one position: log of the summed powers less the label's logit; null for an ignored label."""
    spread = lambda x, m: F.log(F.aggregate(x, F.lit(0.0), lambda s, y: s + F.exp(y - m))) + m
    loss = lambda x: let(F.array_max(x), lambda m: spread(x, m)) - F.get(x, label)
    return F.when(label != ignored, let(logits, loss))


def layer_norm(values: Column, eps: float = 1e-5) -> Column:
    """Values less their mean, over their spread."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    centred = lambda x: let(total(x) / F.size(x), lambda m: F.transform(x, lambda y: y - m))
    scaled = lambda x: let(F.sqrt(total(F.transform(x, lambda y: y * y)) / F.size(x) + eps), lambda d: F.transform(x, lambda y: y / d))
    return let(centred(values), scaled)


def drawn(probs: Column, u: Column) -> Column:
    """Index drawn from probabilities by a number from 0 to under 1: the first whose running total passes it; the last possible one if none does."""
    step = lambda a, p: F.struct((a["at"] + F.when(a["sum"] + p <= u, 1).otherwise(0)).alias("at"), (a["sum"] + p).alias("sum"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    return F.least(F.aggregate(probs, start, step, lambda a: a["at"]), F.size(probs) - 1)
