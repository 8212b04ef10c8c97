"""Status ladders and severity. Undefined (NULL) input ends on the healthy branch unless ``strict``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRIFT_LEVELS = ("STABLE", "WARNING", "CRITICAL")
FAIRNESS_LEVELS = ("PASS", "WARNING", "FAIL")


def _undefined(value: Column, otherwise: Column, strict: bool, worst_label: str) -> Column:
    return F.when(value.isNull(), worst_label).otherwise(otherwise) if strict else otherwise


def psi_status(value: Column, warning: float = 0.10, critical: float = 0.20, strict: bool = False) -> Column:
    ladder = F.when(value >= critical, "CRITICAL").when(value >= warning, "WARNING").otherwise("STABLE")
    return _undefined(value, ladder, strict, "CRITICAL")


def ks_status(
    statistic: Column, pvalue: Column, warning: float = 0.05, critical: float = 0.10, alpha: float = 0.05, strict: bool = False
) -> Column:
    """Stable whenever ``p >= alpha``, whatever the statistic."""
    ladder = (
        F.when(pvalue >= alpha, "STABLE")
        .when(statistic >= critical, "CRITICAL")
        .when(statistic >= warning, "WARNING")
        .otherwise("STABLE")
    )
    return _undefined(statistic, ladder, strict, "CRITICAL")


def ratio_status(value: Column, warning_below: float = 0.90, fail_below: float = 0.80, strict: bool = False) -> Column:
    ladder = F.when(value < fail_below, "FAIL").when(value < warning_below, "WARNING").otherwise("PASS")
    return _undefined(value, ladder, strict, "FAIL")


def difference_status(value: Column, warning_at: float, fail_at: float, strict: bool = False) -> Column:
    ladder = F.when(value >= fail_at, "FAIL").when(value >= warning_at, "WARNING").otherwise("PASS")
    return _undefined(value, ladder, strict, "FAIL")


def severity(status: Column, levels: Sequence[str]) -> Column:
    """0, 1, 2 in the order of ``levels``."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), status), F.lit(0)) - 1, F.lit(0))


def label(sev: Column, levels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in levels]), (F.coalesce(sev, F.lit(0)) + 1).cast("int"))


def worst(statuses: Sequence[Column], levels: Sequence[str]) -> Column:
    """Worst of several status columns in one row; none at all is healthy."""
    if not statuses:
        return F.lit(levels[0])
    sev = [severity(s, levels) for s in statuses]
    return label(sev[0] if len(sev) == 1 else F.greatest(*sev), levels)


def worst_of_group(status: Column, levels: Sequence[str]) -> Column:
    """Aggregate: worst status in the group; an empty group is healthy."""
    return label(F.max(severity(status, levels)), levels)
