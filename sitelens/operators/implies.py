"""A5: implied technologies.

The implies graph belongs to the rule set: its edges (one a listed name, linear in the rules) go out with
a small walk, and each page walks from its own direct matches.  No table of reachable pairs exists, so a
hub that implies thousands costs the pages that have it, nothing else.  The walk is queue-driven, from the
direct matches in rule order, and keeps for each node the edge that reached it first; that order is also
the A6 order of implied technologies.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.sources.rules import implies_edges

IMPLIED_CONFIDENCE = 0.6
_REACHED = "array<struct<dst_key:string,via_name:string,dst_raw:string>>"
_REACHED_ARROW = pa.list_(pa.struct([("dst_key", pa.string()), ("via_name", pa.string()), ("dst_raw", pa.string())]))


def reached(found: list[str], order: dict[str, int], edges: dict[str, list[tuple[str, str, str]]]) -> list[tuple[str, str, str]]:
    """(node, name of its first implier, name as listed there), in order of discovery; found ones too if implied."""
    queue = deque(sorted((k for k in found if k in edges), key=lambda k: order[k]))
    seen, out = set(queue), {}
    while queue:
        for node, via, raw in edges[queue.popleft()]:
            if node not in out:
                out[node] = (node, via, raw)
            if node in edges and node not in seen:
                seen.add(node)
                queue.append(node)
    return list(out.values())


def implies_walk(rules: DataFrame):
    """Column function: technology keys of a page -> what they imply, directly or not, in order of discovery."""
    edges: dict[str, list] = {}
    for r in implies_edges(rules).orderBy("src_key", "pos").collect():  # the rule set's own size
        edges.setdefault(r.src_key, []).append((r.dst_key, r.src_name, r.dst_raw))
    order = {r.tech_key: r.ord for r in rules.select("tech_key", "ord").collect() if r.tech_key in edges}
    graph = rules.sparkSession.sparkContext.broadcast((order, edges))

    @F.arrow_udf(_REACHED)
    def walk(keys: pa.Array) -> pa.Array:
        names = ("dst_key", "via_name", "dst_raw")
        return pa.array([[dict(zip(names, x)) for x in reached(found or [], *graph.value)] for found in keys.to_pylist()], _REACHED_ARROW)

    return walk


def detected_names(matches: DataFrame, rules: DataFrame, walk) -> DataFrame:
    """(page_id, name) of every technology of a page, found or implied: no evidence, scores or versions."""
    found = matches.groupBy("page_id").agg(F.collect_set("tech_key").alias("keys"))
    itself = F.transform("keys", lambda k: F.struct(k.alias("tech_key"), F.lit(None).cast("string").alias("raw")))
    implied = F.transform(walk("keys"), lambda x: F.struct(x["dst_key"].alias("tech_key"), x["dst_raw"].alias("raw")))
    each = found.select("page_id", F.explode(F.concat(itself, implied)).alias("e")).select("page_id", "e.*")
    return each.join(rules.select("tech_key", "name"), "tech_key", "left").select("page_id", F.coalesce("name", "raw").alias("name")).distinct()


def resolve_implies(tech: DataFrame, rules: DataFrame, walk) -> DataFrame:
    """Merge implied technologies into per-page tech matches.

    tech: (page_id, tech_key, ord, name, category, version, confidence, n_sources, evidence)
    Adds ``implied`` (bool) and ``order_key`` (for the stable A6 ordering).

    One branch: the matches of a page (one a rule at most) gather in a row, the walk adds what they imply,
    and both meet again by technology in the same partition; the matching runs once.
    """
    own = ["ord", "name", "category", "version", "confidence", "evidence"]
    page = tech.groupBy("page_id").agg(F.collect_list(F.struct("tech_key", F.struct(*own).alias("d"))).alias("found"))
    page = page.withColumn("reached", walk(F.transform("found", lambda x: x["tech_key"])))
    way = "struct<n:int,via_name:string,dst_raw:string>"
    itself = F.transform("found", lambda x: F.struct(x["tech_key"].alias("dst_key"), x["d"].alias("d"), F.lit(None).cast(way).alias("v")))
    others = F.transform("reached", lambda x, i: F.struct(
        x["dst_key"].alias("dst_key"), F.when(F.lit(False), F.element_at("found", 1)["d"]).alias("d"),
        F.struct(i.alias("n"), x["via_name"].alias("via_name"), x["dst_raw"].alias("dst_raw")).cast(way).alias("v")))
    each = page.select("page_id", F.explode(F.concat(itself, others)).alias("e")).select("page_id", "e.*")
    merged = each.groupBy("page_id", "dst_key").agg(F.first("d", ignorenulls=True).alias("d"), F.min("v").alias("v"))
    info = rules.select(F.col("tech_key").alias("dst_key"), F.col("name").alias("r_name"),
                        F.col("category").alias("r_category"), F.col("ord").alias("r_ord"))
    j = merged.select("page_id", "dst_key", "d.*", "v").join(info, "dst_key", "left")
    implied_ev = F.struct(F.lit("implies").alias("source"), F.lit("implies").alias("key"),
                          F.concat(F.lit("Implied by "), F.col("v.via_name")).alias("matched"),
                          F.lit("").alias("pattern"))
    is_direct = F.col("name").isNotNull()
    raise_it = is_direct & F.col("v").isNotNull() & (F.col("confidence") < IMPLIED_CONFIDENCE)
    new = ~is_direct
    out = j.select(
        "page_id", F.col("dst_key").alias("tech_key"),
        F.when(new, F.coalesce("r_name", "v.dst_raw")).otherwise(F.col("name")).alias("name"),
        F.when(new, F.coalesce("r_category", F.lit(""))).otherwise(F.col("category")).alias("category"),
        F.when(new, F.lit(None).cast("string")).otherwise(F.col("version")).alias("version"),
        F.when(new | raise_it, F.lit(IMPLIED_CONFIDENCE)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(new, F.array(implied_ev)).when(raise_it, F.concat("evidence", F.array(implied_ev)))
        .otherwise(F.col("evidence")).alias("evidence"),
        new.alias("implied"),
        # A6 tie order: direct matches in rule order, then implied ones in discovery order
        F.struct(new.cast("int").alias("g"), F.when(new, F.col("v.n")).otherwise(F.col("ord")).alias("n"))
        .alias("order_key"))
    return out


def rank_matches(tech: DataFrame) -> DataFrame:
    """Per-page rank, confidence descending, ties in rule / discovery order."""
    w = Window.partitionBy("page_id").orderBy(F.desc("confidence"), F.col("order_key"))
    return tech.withColumn("rank", F.row_number().over(w))
