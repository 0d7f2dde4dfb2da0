"""Names and keys of series as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(key: str, attrs: str = "attrs", res_attrs: str = "res_attrs") -> Column:
    """A datapoint attribute, else the resource's, else the empty string."""
    return F.coalesce(F.try_element_at(attrs, F.lit(key)), F.try_element_at(res_attrs, F.lit(key)), F.lit(""))


def joined_labels(labels: dict[str, Column]) -> Column:
    """k=v pairs in the given order, joined by commas."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in labels.items()])


def group_key(metric: Column, labels: dict[str, Column]) -> Column:
    return F.concat(metric, F.lit("|"), joined_labels(labels)) if labels else metric


def logical_name(group: Column, aggregate: Column) -> Column:
    return F.concat(group, F.lit("|agg="), aggregate)


def shortest(x: Column) -> Column:
    """A number as its fewest digits: with an exponent of two digits or more from a million on and under a ten-thousandth."""
    plain = F.abs(x.cast("double")).cast("string")  # digits.digits, maybe with E and an exponent
    whole, part = F.substring_index(F.substring_index(plain, "E", 1), ".", 1), F.substring_index(F.substring_index(plain, "E", 1), ".", -1)
    power = F.when(F.contains(plain, F.lit("E")), F.substring_index(plain, "E", -1).try_cast("int")).otherwise(0)
    every = F.concat(whole, part)
    digits = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
    point = F.length(whole) + power - (F.length(every) - F.length(F.ltrim(every, F.lit("0"))))
    exponent = point - 1
    scaled = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    fixed = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(F.length(digits) <= point, F.rpad(digits, point, F.lit("0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    out = F.when(x == 0, "0").when((exponent < -4) | (exponent >= 6), scaled).otherwise(fixed)
    return F.when(x < 0, F.concat(F.lit("-"), out)).otherwise(out)


def bound_label(bound: Column) -> Column:
    """Upper bound of a histogram bucket as a label, the last one +Inf."""
    return F.when(bound == F.lit(float("inf")), "+Inf").otherwise(shortest(bound))


def metric_name(name: Column) -> Column:
    """Characters outside [a-zA-Z0-9_:] become underscores; a leading digit gets one in front."""
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def group_of_series(name: Column) -> Column:
    """What stands between the first and the last bar of a logical name; null if there aren't two bars."""
    first, last = F.instr(name, "|"), F.length(name) - F.instr(F.reverse(name), "|") + 1
    return F.when((first > 0) & (last > first), F.substring(name, first + 1, last - first - 1))


_SIZE = re.compile(r"([0-9]+) ?([KMGT]?)B")


def byte_size(text: str) -> int:
    """A size as 16MB or 512 KB, in powers of 1024; capital letters, at most one space."""
    m = _SIZE.fullmatch(text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << 10 * " KMGT".index(m[2] or " ")
