"""Free-form labels and payloads of annotators as canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetext.functions import text as tx


def coerce_labels(rows: DataFrame, tags: dict[str, str], sides: dict[str, str]) -> DataFrame:
    """``rows`` (label, side, confidence as text) with ``tag``, ``side`` and a confidence from 0 to 1.

    Both lists are short and fixed, so they are map lookups. A label that none names becomes the entry of its side, or
    NO_ACTION without a side.
    """
    lookup = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    token = lambda c: tx.normalize_variant(F.col(c), "label")
    side = F.element_at(lookup(sides), token("side"))
    tag = F.coalesce(F.element_at(lookup(tags), token("label")), F.concat(F.lit("ENTER_"), side), F.lit("NO_ACTION"))
    confidence = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence").try_cast("double"))), F.lit(0.0))
    rest = [c for c in rows.columns if c not in ("label", "side", "confidence")]
    return rows.select(*rest, tag.alias("tag"), side.alias("side"), confidence.alias("confidence"))


def parse_label_payload(rows: DataFrame, payload: str, fields: list[str]) -> DataFrame:
    """One row for each entry of ``events`` in the outermost JSON object of a text, with ``line`` and text fields; entries
    without a whole line number are dropped."""
    schema = "events array<struct<line:string," + ",".join(f"{f}:string" for f in fields) + ">>"
    rest = [c for c in rows.columns if c != payload]
    body = F.from_json(F.regexp_extract(payload, r"(?s)\{.*\}", 0), schema)
    found = rows.select(*rest, F.explode(body["events"]).alias("e"))
    line = F.col("e.line").try_cast("long")
    return found.filter(line.isNotNull()).select(*rest, line.alias("line"), *[F.col(f"e.{f}").alias(f) for f in fields])
