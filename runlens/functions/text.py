"""Text and label column builders.

Everything is a built-in expression except NFKC normalisation, which has no
JVM built-in and runs as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed patterns. Python's str.strip() removes every character for which
# str.isspace() holds; this class lists exactly those characters.
PY_WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
TAG = r"<[^<>]*>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """Python ``str.strip()``: Spark's ``trim`` only removes spaces."""
    c = _c(c)
    return F.regexp_replace(F.regexp_replace(c, f"^{PY_WHITESPACE}+", ""), f"{PY_WHITESPACE}+$", "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC normalisation (Arrow batches; nulls pass through)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def strip_tags(c) -> Column:
    return F.regexp_replace(_c(c), TAG, "")


def normalize_text(c, lowercase: bool = True, unicode_nfkc: bool = True, tags: str | None = "after") -> Column:
    """None -> '', strip, NFKC, lower, and HTML tag removal either after those
    steps (leading blanks left by a removed tag survive) or before them."""
    if tags not in (None, "after", "before"):
        raise ValueError("tags must be None, 'after' or 'before'")
    x = F.coalesce(_c(c), F.lit(""))
    if tags == "before":
        x = strip_tags(x)
    x = py_strip(x)
    if unicode_nfkc:
        x = nfkc(x)
    if lowercase:
        x = F.lower(x)
    if tags == "after":
        x = strip_tags(x)
    return x


def parse_label(c) -> tuple[Column, Column]:
    """Label text -> (label bigint, quarantine reason).

    ``int(float(s))`` semantics: surrounding blanks allowed, truncation toward
    zero; null/blank/non-numeric/non-finite values and those beyond 64 bits get a
    reason instead."""
    s = py_strip(_c(c))
    # a decimal number, infinity or nan: casts alone would also take suffixes such as 3.0f
    number = s.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$|^(?i)[+-]?(inf|infinity|nan)$")
    d = F.when(number, F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    label = d.try_cast("bigint")
    finite = ~F.isnan(d) & (F.abs(d) < float("inf"))
    reason = (F.when(_c(c).isNull(), "missing")
              .when(s == "", "blank")
              .when(d.isNull(), "not_a_number")
              .when(~finite, "not_finite")
              .when(label.isNull(), "out_of_range"))
    return F.when(reason.isNull(), label), reason


def format_run_name(layers, alpha, temperature) -> Column:
    """vanilla_L{layers}_A{alpha with '.'->'p'}_T{temperature}."""
    a = F.replace(F.format_string("%.1f", _c(alpha)), F.lit("."), F.lit("p"))
    return F.format_string("vanilla_L%d_A%s_T%d", _c(layers), a, _c(temperature))


def parse_run_name(c) -> dict[str, Column]:
    """Typed hyperparameters out of a run name (null when a part is absent)."""
    c = _c(c)
    return {
        "family": F.get(F.split(c, "_"), 0),
        "layers": F.regexp_extract(c, r"_L([0-9]+)(_|$)", 1).try_cast("int"),
        "alpha": F.replace(F.regexp_extract(c, r"_A([0-9p]+)(_|$)", 1), F.lit("p"), F.lit(".")).try_cast("double"),
        "temperature": F.regexp_extract(c, r"_T([0-9]+)(_|$)", 1).try_cast("double"),
        "beta": F.regexp_extract(c, r"_B([0-9]+)(_|$)", 1).try_cast("double"),
    }
