"""Scalar expressions on Column objects: canonical pairs, verdicts, hashes, link functions, text and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The two names in order, and whether they were swapped."""
    return F.least(a, b), F.greatest(a, b), a > b


def display_order(first_shown: Column, swapped: Column) -> Column:
    """+1 if the canonical first item was shown first, else -1; a missing flag counts as true."""
    return F.when(F.coalesce(first_shown, F.lit(True)) != swapped, 1).otherwise(-1)


def side_to_item(side: Column, a: Column, b: Column) -> Column:
    return F.when(side == "model_a", a).when(side == "model_b", b)


def decisive(value: Column, *known: str) -> Column:
    """Null-safe membership."""
    return F.coalesce(value.isin(*known), F.lit(False))


def uniform28(*parts: Column) -> Column:
    """A whole number in [0, 2^28) from the md5 of the parts: stable under repartitioning and the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    return uniform28(*parts) / F.lit(2.0**28)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e^x) that doesn't overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def deswap(choice: Column, side_a: Column, side_b: Column) -> Column:
    return F.when(choice == "a", side_a).when(choice == "b", side_b).when(choice == "c", "tie").when(choice == "d", "both_bad")


def fingerprint(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def token_estimate(text: Column) -> Column:
    """A conservative estimate: a quarter of the ASCII characters, all bytes of the rest, and 32."""
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.ceil(ascii_chars / 4.0) + F.octet_length(text) - ascii_chars + 32).cast("long")


def reasoning_state(inference: Column) -> Column:
    mode = F.get_json_object(inference, "$.reasoning.mode")
    return F.when(mode.isNull(), None).when(mode == "disabled", "direct").otherwise("thinking")


#: What a message says when a period's quota is used up, which goes before its HTTP status; what may be tried again; what ends an account.
QUOTA = (
    "out of call volume quota", "quota will be replenished", "daily quota", "daily request limit", "requests per day", "per-day quota",
    "batch enqueued tokens", "batchenqueuedtokens", "enqueued tokens per model",
)
FAULTS = ("network", "timeout", "invalid_response")
RETRYABLE = ("rate_limit", "timeout", "network", "server", "invalid_response")


def error_category(status: Column, message: Column, fault: Column | None = None) -> Column:
    """Of a failed request: fault, if the transport or the reading named one, else by message and HTTP status."""
    low = F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), r"\s+", " ")
    out = F.when(fault.isin(*FAULTS), fault) if fault is not None else F
    out = out.when(low.rlike("|".join(QUOTA)), "quota_exhausted").when(status.isin(401, 403), "authentication").when(status == 429, "rate_limit")
    out = out.when(status.isin(408, 409, 425), "timeout").when(status >= 500, "server").when(status >= 400, "invalid_request")
    return out.otherwise("unknown")


def retryable(category: Column) -> Column:
    return category.isin(*RETRYABLE)


def disables_account(category: Column) -> Column:
    return category == "authentication"


def retry_after(header: Column, message: Column, category: Column) -> Column:
    """Seconds to wait: the header's number, a delay in the message's retry details or words, the countdown of a used-up quota, a minute for a rate limit; else null."""
    number = lambda c: F.when(c.try_cast("double").isNotNull(), F.greatest(c.try_cast("double"), F.lit(0.0)))
    take = lambda p, k=1: F.nullif(F.regexp_extract(F.coalesce(message, F.lit("")), p, k), F.lit(""))
    detail = r'RetryInfo"[^{}]*"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"'
    parts = r'RetryInfo"[^{}]*"retryDelay"\s*:\s*\{\s*"seconds"\s*:\s*"?(\d+)"?(?:\s*,\s*"nanos"\s*:\s*(\d+))?'
    whole = number(take(parts)) + F.coalesce(number(take(parts, 2)), F.lit(0.0)) / 1e9
    clock = r"(?i)quota\s+will\s+be\s+replenished\s+in\s+(?:(\d+)\s+days?,?\s+|(\d+)\.)?(\d+):(\d+):(\d+)"
    at = lambda k: F.coalesce(number(take(clock, k)), F.lit(0.0))
    left = F.when(F.coalesce(message, F.lit("")).rlike(clock), (at(1) + at(2)) * 86400 + at(3) * 3600 + at(4) * 60 + at(5))
    return F.coalesce(number(header), number(take(detail)), whole, number(take(r"(?i)please\s+retry\s+in\s+(\d+(?:\.\d+)?)s")), F.when(category == "quota_exhausted", left), F.when(category == "rate_limit", F.lit(60.0)))


def retry_seconds(text: Column) -> Column:
    """Seconds of a Retry-After value: a number, `12s`, `HH:MM:SS`, `D.HH:MM:SS` or `n days, HH:MM:SS`."""
    clock = r"^(?:(\d+)(?:\.|\s*days?,\s*))?(\d{1,3}):(\d{2}):(\d{2})$"
    part = lambda k: F.coalesce(F.try_cast(F.regexp_extract(text, clock, k), "double") if hasattr(F, "try_cast") else F.regexp_extract(text, clock, k).try_cast("double"), F.lit(0.0))
    plain = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)s?$", 1)
    return F.when(text.rlike(clock), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)).when(plain != "", plain.try_cast("double"))
