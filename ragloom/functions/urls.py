"""URL expressions: parts, admission, blocked sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    """Lower-case scheme, empty without one."""
    return F.lower(F.regexp_extract(F.trim(url), r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _authority(url: Column) -> Column:
    """Host and port as written: after the slashes, behind any user name."""
    whole = F.regexp_extract(F.trim(url), r"\A[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*([^/\\?#]*)", 1)
    return F.regexp_replace(whole, r"\A.*@", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(part: Column) -> Column:
    """The value of a part of an IPv4 address, null if it is none (``08`` is neither octal nor decimal)."""
    return (
        F.when(part.rlike(r"\A0x[0-9a-f]*\z"), F.conv(F.concat(F.lit("0"), F.substring(part, F.lit(3), F.length(part))), 16, 10))
        .when(part.rlike(r"\A0[0-7]+\z"), F.conv(part, 8, 10))
        .when(part.rlike(r"\A(0|[1-9][0-9]*)\z"), part).try_cast("bigint")
    )


def _dotted(name: Column) -> Column:
    """A host whose last part is a number as dotted decimals, as browsers read ``127.1`` or
    ``0x7f000001``; null if its parts are no IPv4 address. Other hosts as they are."""

    def address(parts: Column) -> Column:
        n = F.size(parts)
        numbers = F.transform(parts, _number)
        fits = (n <= 4) & F.forall(
            F.transform(numbers, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
            lambda x: F.coalesce(x["v"] < F.when(x["i"] < n - 1, F.lit(256)).otherwise(F.pow(F.lit(256.0), 5 - n)).cast("bigint"), F.lit(False)),
        )
        value = F.aggregate(
            F.transform(numbers, lambda v, i: F.when(i < n - 1, v * F.pow(F.lit(256.0), F.lit(3) - i).cast("bigint")).otherwise(v)),
            F.lit(0).cast("bigint"), lambda acc, v: acc + v,
        )
        octets = _let(value, lambda v: F.concat_ws(".", *[F.shiftright(v, x).bitwiseAND(255).cast("string") for x in (24, 16, 8, 0)]))
        return F.when(fits, octets)

    numeric = name.rlike(r"(\A|\.)([0-9]+|0x[0-9a-f]*)\.?\z")
    return F.when(numeric, _let(F.split(F.regexp_replace(name, r"\.\z", ""), r"\."), address)).otherwise(name)


def host(url: Column) -> Column:
    """Lower-case host name; an IPv6 address keeps its brackets, an impossible IPv4 address is null."""
    return _let(F.lower(F.regexp_replace(_authority(url), r":[0-9]*\z", "")), _dotted)


def is_url(url: Column, host_name: Column | None = None) -> Column:
    """Has a scheme, and for http(s) a host that can be one."""
    web = scheme(url).isin("http", "https")
    fits = F.regexp_like(_authority(url), F.lit(r"\A(\[[0-9A-Fa-f:.]+\]|[^\s\x00-\x20<>^|%\[\]:]+)(:[0-9]{0,5})?\z"))
    able = (host(url) if host_name is None else host_name).isNotNull()
    return F.coalesce((scheme(url) != "") & (~web | (fits & able)), F.lit(False))


# Hosts that are not public.
PRIVATE_NAMES = ("localhost", "0.0.0.0", "::1", "[::1]", "metadata.google.internal")
PRIVATE_PATTERN = r"\.internal\z|\A127\.|\A10\.|\A192\.168\.|\A169\.254\.|\A172\.(1[6-9]|2[0-9]|3[01])\."


def admission_problem(url: Column, host_name: Column | None = None) -> Column:
    """Why a link may not be fetched, null when it may; ``host_name`` where it is known."""

    def problem(name: Column) -> Column:
        return (
            F.when(~is_url(url, name), "not a valid URL")
            .when(~scheme(url).isin("http", "https"), "only http(s) links are supported")
            .when(name.isin(*PRIVATE_NAMES) | F.regexp_like(name, F.lit(PRIVATE_PATTERN)), "host is not allowed")
        )

    return _let(host(url), problem) if host_name is None else problem(host_name)


# Sites that block page reads; (how to match the host, text, label), first match wins.
BLOCKED_SITES = (
    ("suffix", "linkedin.com", "LinkedIn"),
    ("contains", "seek.com", "Seek"),
    ("contains", "indeed.", "Indeed"),
    ("contains", "glassdoor.", "Glassdoor"),
    ("suffix", "ziprecruiter.com", "ZipRecruiter"),
)


def blocked_site(host_name: Column, rules: Sequence[tuple[str, str, str]] = BLOCKED_SITES) -> Column:
    """Label of the first rule the host meets, else null."""
    how = {"suffix": host_name.endswith, "prefix": host_name.startswith, "contains": host_name.contains}
    label = F.lit(None).cast("string")
    for kind, text, name in reversed(rules):
        label = F.when(how[kind](text), name).otherwise(label)
    return label
