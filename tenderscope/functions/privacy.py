"""Pseudonymisation (P01-P03) as native expressions: sha2 + substring, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_LABEL = "unknown"   # fixed value: label of a missing id
DIGEST_CHARS = 6            # fixed value: hex characters kept from SHA-256


def pseudonym(col, salt: str, prefix: str = "") -> Column:
    """``prefix#`` + first 6 hex chars (upper) of SHA-256(salt ‖ trim(id));
    NULL, blank or 'none' ids become 'unknown'."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.trim(c.cast("string"))
    digest = F.upper(F.substring(F.sha2(F.concat(F.lit(salt), t), 256), 1, DIGEST_CHARS))
    label = F.concat(F.lit(f"{prefix}#"), digest)
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "none"), F.lit(MISSING_LABEL)).otherwise(label)


def pseudonymize_table(df: DataFrame, spec: dict[str, str], salt: str, drop: tuple[str, ...] = (),
                       node_col: str | None = None, node_type_col: str | None = None) -> DataFrame:
    """Replace every column of ``spec`` (column -> prefix) by its pseudonym,
    node keys ``B_<id>`` / ``S_<id>`` by the pseudonym of the id with the
    type's letter kept, and drop name columns."""
    out = df
    for c, prefix in spec.items():
        out = out.withColumn(c, pseudonym(c, salt, prefix))
    if node_col and node_type_col:
        letter = F.when(F.col(node_type_col) == "buyer", F.lit("B")).otherwise(F.lit("S"))
        ent = F.expr(f"substring({node_col}, 3)")
        out = out.withColumn(node_col, F.concat(letter, F.lit("_"), pseudonym(ent, salt, "")))
    return out.drop(*drop)


def collision_report(df: DataFrame, col: str, salt: str, prefix: str = "") -> DataFrame:
    """Distinct ids vs distinct pseudonyms; collisions and rate of the 24-bit digest."""
    p = df.select(F.col(col).alias("_id"), pseudonym(col, salt, prefix).alias("_p")).where(F.col("_p") != MISSING_LABEL)
    one = p.agg(F.countDistinct("_id").alias("distinct_ids"), F.countDistinct("_p").alias("distinct_pseudonyms"))
    return one.select("distinct_ids", "distinct_pseudonyms",
                      (F.col("distinct_ids") - F.col("distinct_pseudonyms")).alias("collisions"),
                      F.try_divide((F.col("distinct_ids") - F.col("distinct_pseudonyms")).cast("double"),
                                   F.col("distinct_ids").cast("double")).alias("collision_rate"))
