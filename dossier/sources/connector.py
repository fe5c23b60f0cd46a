"""Saved connector responses -> reference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import strip, strip_highlight


_ENTRY = (
    "struct<reportId:string,title:string,orgName:string,industryName:string,pubTimeStr:string,"
    "pubTime:variant,pageNum:variant,paragraphs:variant>"
)


def _number(value: Column) -> Column:
    """A JSON number as double, NULL for text, booleans and the rest."""
    is_number = F.schema_of_variant(value).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(is_number, F.try_variant_get(value, "$", "double"))


def _snippet(paragraphs: Column) -> Column:
    none = F.array().cast("array<variant>")
    texts = F.transform(
        F.coalesce(F.try_variant_get(paragraphs, "$", "array<variant>"), none),
        lambda p: F.try_variant_get(p, "$.content", "string"),
    )
    joined = F.array_join(
        F.transform(F.filter(texts, lambda p: F.length(p) > 0), strip_highlight), "\n"
    )
    return F.nullif(joined, F.lit(""))


def search_references(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per usable entry of a search response, other columns kept.

    Entries without id, title or a readable publish date are dropped, inside the list, so every
    rule runs once per entry.
    """
    kept = [c for c in responses.columns if c != payload]
    listed = F.coalesce(
        F.try_variant_get(F.try_parse_json(F.col(payload)), "$.data", "array<variant>"),
        F.array().cast("array<variant>"),
    )

    def timed(e: Column, i: Column) -> Column:
        number = _number(e["pubTime"])
        seconds = F.when(number > 1e12, number / 1000).otherwise(number)
        return F.struct(
            e.alias("e"),
            i.alias("position"),
            F.when(number > 0, F.timestamp_micros((seconds * 1_000_000).cast("long"))).alias("at"),
        )

    def reference(t: Column) -> Column:
        e = t["e"]
        printed = F.regexp_extract(
            F.coalesce(e["pubTimeStr"], F.lit("")), f"(?U){K.PAYLOAD_DATE}", 0
        )
        pages = _number(e["pageNum"])
        return F.struct(
            t["position"].alias("position"),
            strip(F.coalesce(e["reportId"], F.lit(""))).alias("external_id"),
            strip_highlight(e["title"]).alias("title"),
            F.coalesce(F.to_date(t["at"]), F.try_to_date(printed, "yyyy-M-d")).alias("publish_date"),
            t["at"].alias("published_at"),
            F.nullif(strip_highlight(e["orgName"]), F.lit("")).alias("broker"),
            F.nullif(strip_highlight(e["industryName"]), F.lit("")).alias("industry"),
            F.when(pages > 0, pages.cast("int")).alias("pages"),
            _snippet(e["paragraphs"]).alias("snippet"),
        )

    entries = F.transform(listed, lambda v: F.try_variant_get(v, "$", _ENTRY))
    refs = F.filter(
        F.transform(F.transform(entries, timed), reference),
        lambda r: (r["external_id"] != "") & (r["title"] != "") & r["publish_date"].isNotNull(),
    )
    return responses.select(*kept, F.inline(refs))


def bad_responses(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Responses without a list under ``data``, with the code and message they carry."""
    parsed = F.try_parse_json(F.col(payload))
    return responses.where(
        F.try_variant_get(parsed, "$.data", "array<variant>").isNull()
    ).select(
        "*",
        F.try_variant_get(parsed, "$.code", "string").alias("code"),
        F.coalesce(
            F.try_variant_get(parsed, "$.msg", "string"),
            F.try_variant_get(parsed, "$.message", "string"),
            F.lit(""),
        ).alias("message"),
    )


def download_url(payload: Column) -> Column:
    """The first usable address: ``data`` itself, then the known keys at the root, then in ``data``."""
    parsed = F.try_parse_json(payload)

    def text_at(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        value = F.when(kind == "STRING", F.try_variant_get(parsed, path, "string"))
        return F.nullif(strip(value), F.lit(""))

    paths = ["$.data"] + [f"{root}.{key}" for root in ("$", "$.data") for key in K.DOWNLOAD_KEYS]
    return F.coalesce(*[text_at(path) for path in paths])
