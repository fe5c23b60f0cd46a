"""Scalar rules for extracted fields: dates, codes, enumerations, URLs, search tokens."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import constants as K
from .text import split_lines, strip


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def _date(year: Column, month: Column, day: Column) -> Column:
    digits = F.translate(F.concat_ws("-", year, month, day), "０１２３４５６７８９", "0123456789")
    return F.try_to_date(digits, "yyyy-M-d")


def _date_of(text: Column, pattern: str) -> Column:
    return _date(*[F.regexp_extract(text, f"(?U){pattern}", i) for i in (1, 2, 3)])


def anchor_publish_date(markdown: Column, head_chars: int | None = None) -> Column:
    """Publish date printed in a body, or in its first ``head_chars`` characters.

    The first date written with 年月日 counts if it is valid; otherwise the first line that
    carries exactly one numeric date which is valid (axis ticks carry several).
    """
    head = markdown if head_chars is None else F.substring(markdown, 1, head_chars)
    numeric = F.transform(
        split_lines(head),
        lambda line: F.regexp_extract_all(line, F.lit(f"(?U){K.NUMERIC_DATE}"), F.lit(0)),
    )
    single = F.transform(
        F.filter(numeric, lambda hits: F.size(hits) == 1),
        lambda hits: _date_of(hits[0], K.NUMERIC_DATE),
    )
    return F.coalesce(
        _date_of(head, K.CJK_DATE), F.get(F.filter(single, lambda d: d.isNotNull()), F.lit(0))
    )


def extracted_date(raw: Column) -> Column:
    """Date as an extractor wrote it; the whole string must be the date."""
    text = strip(F.coalesce(raw, F.lit("")))
    return _date_of(text, f"^{K.EXTRACTED_DATE}$")


def date_provenance(anchored: Column, extracted: Column) -> tuple[Column, Column]:
    """(publish_date, publish_date_source): the anchored date beats the extracted one."""
    source = F.when(anchored.isNotNull(), "regex_head").when(extracted.isNotNull(), "llm")
    return F.coalesce(anchored, extracted), source


def normalize_code(raw: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\D", "")
    return F.when(F.length(digits) == 6, digits)


def valid_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"(?U)^\d{6}$") & (F.length(code) == 6), F.lit(False))


def map_stance(raw: Column) -> Column:
    known = F.try_element_at(_literal_map(K.STANCES), strip(F.coalesce(raw, F.lit(""))))
    return F.coalesce(known, F.lit(K.DEFAULT_STANCE))


def map_action(raw: Column) -> Column:
    return F.try_element_at(_literal_map(K.ACTIONS), strip(F.coalesce(raw, F.lit(""))))


def map_report_type(raw: Column) -> Column:
    rule = F
    for part, kind in K.REPORT_TYPES:
        rule = rule.when(raw.contains(part), kind)
    return rule.otherwise(K.DEFAULT_REPORT_TYPE)


def exchange_of(code: Column) -> Column:
    rule = F
    for exchange, prefixes in K.EXCHANGE_PREFIXES.items():
        rule = rule.when(code.rlike(f"^(?:{'|'.join(prefixes)})"), exchange)
    return rule.otherwise("")


def is_noise_concept(name: Column) -> Column:
    n = strip(F.coalesce(name, F.lit("")))
    return n.isin(K.NOISE_NAMES) | n.rlike("|".join(K.NOISE_PARTS))


def code_source(code: Column, body: Column) -> Column:
    """``text`` if the code stands anywhere in the body, even inside a longer digit run."""
    return F.when(code.isNull(), None).when(body.contains(code), "text").otherwise("inferred")


def view_url(connector: Column, external_id: Column, templates: dict[str, str]) -> Column:
    """Reading link from a connector's prefix; NULL for connectors that have none."""
    return F.concat(F.try_element_at(_literal_map(templates), connector), external_id)


# ---- outbound URLs -------------------------------------------------------------------------

# IPv4 blocks that are loopback, private, reserved, link-local or unspecified (published
# registries), except the two globally reachable anycast addresses of 192.0.0.0/24.
_BLOCKED_V4 = (
    r"^(?!192\.0\.0\.(?:9|10)$)(?:"
    r"(?:0|10|127)\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.0\.[02]\.|192\.168\.|"
    r"198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|(?:24\d|25[0-5])\.)"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


@F.pandas_udf(BooleanType())
def _blocked_v6(hosts: pd.Series) -> pd.Series:
    def blocked(host):
        try:
            ip = ipaddress.ip_address(host)
        except ValueError:
            return False
        return (
            ip.is_loopback or ip.is_private or ip.is_reserved or ip.is_link_local or ip.is_unspecified
        )

    return hosts.map(blocked, na_action="ignore").astype("boolean")


def url_host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    bracketed = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    return F.lower(
        F.when(host_port.startswith("["), bracketed).otherwise(F.regexp_replace(host_port, r":.*$", ""))
    )


def url_class(url: Column) -> Column:
    """``scheme_not_allowed`` / ``no_host`` / ``host_not_allowed`` / ``ok`` without any DNS lookup."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = url_host(url)
    blocked_v4 = host.rlike(_DOTTED_QUAD) & host.rlike(_BLOCKED_V4)
    blocked_v6 = F.coalesce(_blocked_v6(F.when(host.contains(":"), host)), F.lit(False))
    return (
        F.when(~scheme.isin("http", "https"), "scheme_not_allowed")
        .when(host == "", "no_host")
        .when(blocked_v4 | blocked_v6, "host_not_allowed")
        .otherwise("ok")
    )


# ---- search tokens -------------------------------------------------------------------------


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; runs of Han characters become bigrams."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    plain_words = F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    runs = F.regexp_extract_all(lowered, F.lit(r"\p{IsHan}+"), F.lit(0))
    bigrams = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) < 2, F.array(run)).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
                    lambda i: F.substring(run, i, F.lit(2)),
                )
            ),
        )
    )
    return F.when(lowered.rlike(r"\p{IsHan}"), F.concat(words, bigrams)).otherwise(plain_words)
