"""Group evidence per (page, technology), score, version, order.

One shuffle on (page_id, tech_key); partial aggregation runs map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORROBORATION_STEP = 0.1   # A2: + 0.1 per extra distinct source
VERSION_BOOST = 0.1        # A4


def evidence_struct() -> F.Column:
    return F.struct(F.col("src_rank"), F.col("pos"), F.col("src").alias("source"), F.col("key"),
                    F.col("matched"), F.col("pattern"))


def score(matches_raw: DataFrame, rules: DataFrame) -> DataFrame:
    """tech_matches(page_id, tech_key, ord, name, category, version, confidence, n_sources, evidence)."""
    g = matches_raw.groupBy("page_id", "tech_key").agg(
        F.count_distinct("src").alias("n_sources"),
        # A3: first captured version in source order, then pattern order
        F.expr("min_by(version, struct(src_rank, pos)) FILTER (WHERE version IS NOT NULL AND version <> '')")
        .alias("version"),
        F.array_sort(F.collect_list(evidence_struct())).alias("ev"))
    r = rules.select("tech_key", "ord", "name", "category", F.col("confidence").alias("base"))
    conf = F.col("base") + CORROBORATION_STEP * (F.col("n_sources") - 1) + \
        F.when(F.col("version").isNotNull(), VERSION_BOOST).otherwise(0.0)
    out = g.join(r, "tech_key").select(
        "page_id", "tech_key", "ord", "name", "category", "version",
        F.round(F.least(conf, F.lit(1.0)), 2).alias("confidence"), "n_sources",
        F.transform("ev", lambda e: F.struct(e["source"].alias("source"), e["key"].alias("key"),
                                             e["matched"].alias("matched"), e["pattern"].alias("pattern")))
        .alias("evidence"))
    return out


def evidence_text(col: str = "evidence") -> F.Column:
    """Flat rendering of the evidence array: 'source:key:matched' joined by ' | '."""
    return F.array_join(F.transform(col, lambda e: F.concat_ws(":", e["source"], e["key"], e["matched"])), " | ")
