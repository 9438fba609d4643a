"""Stable labels for provider errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_label(name: Column, rules: list[tuple[tuple[str, ...], str]]) -> Column:
    lowered = F.lower(name)
    label = F
    for needles, result in rules:
        hit = F.contains(lowered, F.lit(needles[0]))
        for needle in needles[1:]:
            hit = hit | F.contains(lowered, F.lit(needle))
        label = label.when(hit, F.lit(result))
    return F.when(name.isNotNull(), label.otherwise(F.lit("provider_error")))


# Class-name fragments and labels, first match wins. Captured
# exchanges and instrumented calls label some classes differently.
_CAPTURE_RULES = [
    (("ratelimit",), "rate_limit"),
    (("timeout",), "timeout"),
    (("auth", "permission"), "auth"),
    (("connect",), "connection"),
]
_CALL_RULES = [
    (("ratelimit",), "rate_limit"),
    (("timeout",), "timeout"),
    (("authentication", "permission"), "auth"),
    (("connection",), "connection"),
    (("badrequest", "invalidrequest", "notfound"), "invalid_request"),
]


def captured_error(exception_class: Column) -> Column:
    """Label for an exception seen while an exchange was captured."""
    return _first_label(exception_class, _CAPTURE_RULES)


def call_error(exception_class: Column) -> Column:
    """Label for an exception raised by an instrumented call."""
    return _first_label(exception_class, _CALL_RULES)


def status_error(code: Column) -> Column:
    """Label for an HTTP error status."""
    return (
        F.when(code.isin(401, 403), F.lit("auth"))
        .when(code == 429, F.lit("rate_limit"))
        .when(code.isin(408, 504), F.lit("timeout"))
        .when((code >= 400) & (code < 500), F.lit("invalid_request"))
        .when(code.isNotNull(), F.lit("provider_error"))
    )
