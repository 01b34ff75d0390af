"""Per-example vector maths as Spark Column expressions.

Score vectors, logits and hidden states are ``array<double>`` columns; every
function here builds a Column from built-in higher-order functions
(``transform``, ``aggregate``, ``zip_with``), so the work stays in the JVM and
is distributed with the rows. Vectors are short (tens to hundreds of values),
which keeps these per-row expressions cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed constants of the reference's formulas.
NORMALIZE_EPS = 1e-12     # L2 normalisation floor
MAXABS_EPS = 1e-10        # max-abs normalisation offset
IG_STEPS = 50             # integrated-gradient path steps
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]", "[UNK]"]
PUNCTUATION = ".,;:!?()[]{}\"'-/"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def _with_scalar(a: Column, s: Column, f) -> Column:
    """transform(a, x -> f(x, s)) with ``s`` evaluated once per row: the scalar is
    passed as a repeated array instead of being referenced inside the lambda
    (an outer expression inside a lambda is re-evaluated for every element)."""
    return F.zip_with(a, F.array_repeat(s, F.size(a)), f)


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def l2norm(a) -> Column:
    return F.sqrt(dot(a, a))


def argmax(a) -> Column:
    """0-based index of the first maximum (numpy.argmax)."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def _temp(t) -> Column:
    return t if isinstance(t, Column) else F.lit(float(t))


def softmax(a, temperature: float | Column = 1.0) -> Column:
    """softmax(a / T), shifted by the maximum for stability."""
    a, t = _c(a), _temp(temperature)
    e = _with_scalar(a, F.array_max(a), lambda x, m: F.exp((x - m) / t))
    return _with_scalar(e, vsum(e), lambda x, s: x / s)


def log_softmax(a, temperature: float | Column = 1.0) -> Column:
    a, t = _c(a), _temp(temperature)
    z = _with_scalar(a, F.array_max(a), lambda x, m: (x - m) / t)
    lse = F.log(vsum(F.transform(z, lambda x: F.exp(x))))
    return _with_scalar(z, lse, lambda x, s: x - s)


def kl_row(teacher_logits, student_logits, temperature: float | Column) -> Column:
    """sum_c p_t(c) * (log p_t(c) - log q_s(c)) with 0 * log 0 = 0."""
    lpt = log_softmax(teacher_logits, temperature)
    lqs = log_softmax(student_logits, temperature)
    terms = F.zip_with(lpt, lqs, lambda lp, lq: F.when(F.exp(lp) == 0, F.lit(0.0)).otherwise(F.exp(lp) * (lp - lq)))
    return vsum(terms)


def cross_entropy_row(logits, label) -> Column:
    """-log_softmax(logits)[label] for a 0-based label."""
    return -F.element_at(log_softmax(logits), _c(label).cast("int") + 1)


def l2_normalize(a, eps: float = NORMALIZE_EPS) -> Column:
    a = _c(a)
    return _with_scalar(a, F.greatest(l2norm(a), F.lit(eps)), lambda x, n: x / n)


def maxabs_normalize(a, eps: float = MAXABS_EPS) -> Column:
    a = _c(a)
    m = F.array_max(F.transform(a, lambda x: F.abs(x))) + F.lit(eps)
    return _with_scalar(a, m, lambda x, mm: x / mm)


def reshape(a, rows: int, cols: int) -> Column:
    """Flat vector -> array of ``rows`` arrays of ``cols`` values (row-major)."""
    a = _c(a)
    return F.array(*[F.slice(a, r * cols + 1, cols) for r in range(rows)])


def row_sums(m) -> Column:
    """Token score = sum over the embedding dimension of each row."""
    return F.transform(_c(m), lambda v: vsum(v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), l2norm(a) * l2norm(b)), F.lit(0.0))


def pearson(a, b) -> Column:
    """Pearson correlation of two equal-length vectors; null when either is
    constant or empty. Means first, then products of the centred values."""
    a, b = _c(a), _c(b)
    zero, n = F.lit(0.0), F.size(a).cast("double")
    varies = lambda v: F.array_max(v) > F.array_min(v)
    centred = lambda v: F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(vsum(v) / n, F.size(v)).alias("m")),
                                    lambda e: e["x"] - e["m"])
    acc0 = F.struct(zero.alias("xx"), zero.alias("yy"), zero.alias("xy"))
    m = F.aggregate(F.arrays_zip(centred(a).alias("x"), centred(b).alias("y")), acc0, lambda acc, e: F.struct(
        (acc["xx"] + e["x"] * e["x"]).alias("xx"), (acc["yy"] + e["y"] * e["y"]).alias("yy"),
        (acc["xy"] + e["x"] * e["y"]).alias("xy")))
    return F.when(varies(a) & varies(b), F.try_divide(m["xy"], F.sqrt(m["xx"]) * F.sqrt(m["yy"])))


def topk_positions(a, k: int) -> Column:
    """0-based positions of the k largest |values|, largest first, earlier
    position first on ties."""
    ranked = F.array_sort(F.transform(_c(a), lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("pos"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["pos"])


def union_topk_values(t, s, k: int) -> Column:
    """Positions in the union of both top-k sets, ascending, each with the value of
    larger magnitude (the student's on ties): array<struct<pos, value>>."""
    t, s = _c(t), _c(s)
    pos = F.array_sort(F.array_union(topk_positions(t, k), topk_positions(s, k)))
    both = F.arrays_zip(t.alias("t"), s.alias("s"))
    return F.transform(pos, lambda p: F.struct(
        p.alias("pos"),
        F.when(F.abs(F.element_at(both, p + 1)["t"]) > F.abs(F.element_at(both, p + 1)["s"]),
               F.element_at(both, p + 1)["t"]).otherwise(F.element_at(both, p + 1)["s"]).alias("value")))


def elementwise_mean(vectors: Sequence) -> Column:
    """Mean of several equal-length vectors, summed left to right."""
    acc = _c(vectors[0])
    for v in vectors[1:]:
        acc = F.zip_with(acc, _c(v), lambda x, y: x + y)
    n = float(len(vectors))
    return F.transform(acc, lambda x: x / n)


def masked_mean_rows(m, n_valid) -> Column:
    """Mean of the first ``n_valid`` rows of a matrix, denominator at least 1."""
    m = _c(m)
    valid = F.slice(m, 1, F.greatest(_c(n_valid), F.lit(1)))
    width = F.size(F.element_at(m, 1))
    summed = F.aggregate(valid, F.array_repeat(F.lit(0.0), width),
                         lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    den = F.greatest(_c(n_valid), F.lit(1)).cast("double")
    return _with_scalar(summed, den, lambda x, d: x / d)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_grad(x: Column) -> Column:
    s = sigmoid(x)
    return s * (F.lit(1.0) - s)


def linear_weights(dim: int) -> list[float]:
    """Coefficient vector of the linear scorer used for attributions:
    w_i = ((i mod 7) - 3) / 4."""
    return [((i % 7) - 3) / 4.0 for i in range(dim)]


def integrated_gradients(x, weights: Sequence[float], steps: int = IG_STEPS) -> tuple[Column, Column, Column]:
    """Attributions of f(x) = sigmoid(w . x) against a zero baseline.

    Returns (input_x_gradient, integrated_gradients, f(x) - f(0)); the path
    integral uses the midpoint rule with ``steps`` points, evaluated as an
    ``aggregate`` over ``sequence(1, steps)`` inside the row."""
    x = _c(x)
    w = F.array(*[F.lit(float(v)) for v in weights])
    z = dot(x, w)
    path = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: (k.cast("double") - 0.5) / steps)
    mean_grad = vsum(_with_scalar(path, z, lambda a, zz: sigmoid_grad(a * zz))) / steps
    xw = F.zip_with(x, w, lambda a, b: a * b)
    ixg = _with_scalar(xw, sigmoid_grad(z), lambda v, g: v * g)
    ig = _with_scalar(xw, mean_grad, lambda v, g: v * g)
    return ixg, ig, sigmoid(z) - F.lit(0.5)
