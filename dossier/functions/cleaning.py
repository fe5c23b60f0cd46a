"""Body cleaning, chunking and heading outline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import constants as K
from .text import SPACE, split_lines, strip

# One anchored pattern: prose fails at its first character. The margin stands for the strip.
_MARGIN = f"{SPACE}*"
_NUMBERS_ONLY = r"[\d%.\-](?:{inner}{{0,{most}}}[\d%.\-])?".format(
    inner=K.BARE_NUMBERS.rstrip("+"), most=K.BARE_NUMBERS_BELOW - 3
)
_NO_BODY = "(?U)^{m}(?:{lines}){m}$".format(
    m=_MARGIN, lines="|".join([*(p[1:-1] for p in K.FOOTER_LINES), _NUMBERS_ONLY])
)


def clean_markdown(markdown: Column) -> Column:
    """Remove engine residue and lines without body text; table rulers and blank lines stay."""
    text = F.regexp_replace(markdown, f"(?Us){K.PICTURE_TEXT}", "")
    text = F.regexp_replace(text, f"(?U){K.HIDDEN_FIELD}", "")
    text = F.regexp_replace(text, K.HIGHLIGHT_MARK, "")
    body = lambda line: ~(line.contains(K.DISCLAIMER) | line.rlike(_NO_BODY))
    return F.array_join(F.filter(split_lines(text), body), "\n")


def chunk_bodies(
    bodies: DataFrame,
    text: str,
    *,
    max_chars: int = K.MAX_INPUT_CHARS,
    size: int = K.CHUNK_CHARS,
    overlap: int = K.CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk; bodies up to ``max_chars`` stay whole. Blank chunks are dropped."""
    length = F.length(text)
    starts = F.when(length <= max_chars, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), length - 1, F.lit(size - overlap))
    )
    width = F.when(length <= max_chars, length).otherwise(F.lit(size))
    return (
        bodies.select("*", F.posexplode(starts).alias("slot", "start"))
        .withColumn("chunk", F.substring(F.col(text), F.col("start") + 1, width))
        .where(strip(F.col("chunk")) != "")
        .drop(text)
    )


def _slug(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", "")
    return F.replace(kept, F.lit(" "), F.lit("-"))


@F.pandas_udf(ArrayType(StringType()))
def _distinct_slugs(slugs: pd.Series) -> pd.Series:
    def number(names):
        used: dict[str, int] = {}
        out = []
        for name in names:
            candidate = name
            while candidate in used:
                used[name] += 1
                candidate = f"{name}-{used[name]}"
            used[candidate] = 0
            out.append(candidate)
        return out

    return slugs.map(number)


def heading_outline(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Headings of levels 1-6 outside code fences with anchor slugs that are unique per document.

    All grouping is by document, so no task holds more than one document's lines.
    """
    lines = documents.select(
        key, F.posexplode(F.split(F.col(text), "\r?\n", -1)).alias("line_no", "line")
    )
    so_far = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_fence = F.col("line").rlike(r"^\s*(?:```|~~~)")
    parts = lambda group: F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*#*\s*$", group)
    heads = (
        # only fences and possible headings take part in the shuffle
        lines.where(is_fence | F.col("line").startswith("#"))
        .withColumn("open", F.sum(is_fence.cast("int")).over(so_far) % 2)
        .where((F.col("open") == 0) & ~is_fence & (parts(1) != ""))
        .select(
            key,
            "line_no",
            F.length(parts(1)).alias("level"),
            strip(F.regexp_replace(parts(2), r"[*_`~\[\]]", "")).alias("heading"),
        )
    )
    per_document = heads.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "level", "heading"))).alias("items")
    )
    slugs = _distinct_slugs(F.transform("items", lambda i: _slug(i["heading"])))
    return per_document.select(
        key, F.explode(F.arrays_zip("items", slugs.alias("slug"))).alias("z")
    ).select(key, "z.items.line_no", "z.items.level", "z.items.heading", F.col("z.slug").alias("slug"))
