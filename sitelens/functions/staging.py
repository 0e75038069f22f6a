"""Evaluate expensive column expressions exactly once.

Catalyst pushes filters below projections by inlining the projected
expressions, so a regex used both in a filter and in the output runs twice
(and wide plans overflow whole-stage codegen).  Columns produced by a
generator are a barrier: ``computed`` emits the new columns through
``inline(array(struct(...)))`` -- one output row per input row.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """df plus ``cols``, each evaluated once per row; later filters stay above."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(k) for k, e in cols.items()]))))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, read again: Spark then knows its size when it picks a join."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "sitelens", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
