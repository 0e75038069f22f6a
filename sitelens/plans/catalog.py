"""Registered queries: the Spark plan and the DuckDB oracle of each, side by side.

Every query reads the given tables (``pages`` / ``events``) or feeds derived
from them with the same SQL text in both engines, so its work grows with the
data.  Rules are the fixture rule set (a small broadcast dimension).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.operators import evidence as E
from sitelens.operators import match as M
from sitelens.operators import score as S
from sitelens.plans import oracle as O
from sitelens.plans.detect import compile_all
from sitelens.session import configure, session_key
from sitelens.sources import feeds as FD
from sitelens.sources import rules as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn
        return fn
    return deco


_COMPILED: dict[str, object] = {}


def _setup(spark: SparkSession, sf_dir: str, tables=("pages",)):
    configure(spark)
    FD.register(spark, sf_dir, tables)


def _rules(spark: SparkSession):
    configure(spark)  # ships the package before the first UDF (rule compile) runs
    key = session_key(spark)
    cr = _COMPILED.get(key)
    if cr is None:
        cr = compile_all(R.load_rules(spark))
        _COMPILED[key] = cr
    return cr


# ---------------------------------------------------------------------------
# oracle building blocks
# ---------------------------------------------------------------------------
def _pats(src: str) -> list[dict]:
    return [p for p in O.fixture_patterns() if p["src"] == src]


def _ci(p: str) -> str:
    return O.sql_str("(?i)" + p)


def o_html_matches(pages: str = "pg") -> str:
    sels = []
    for p in _pats("html"):
        rx = _ci(p["pattern"])
        ver = f"nullif(regexp_extract(html, {rx}, 1), '')" if p["n_groups"] > 0 else "CAST(NULL AS VARCHAR)"
        sels.append(
            f"SELECT page_id, {O.sql_str(p['tech_key'])} AS tech_key, 'html' AS src, {p['src_rank']} AS src_rank, "
            f"{p['pos']} AS pos, 'raw_html' AS key, substr(regexp_extract(html, {rx}, 0), 1, 100) || '...' AS matched, "
            f"{O.sql_str(p['pattern'])} AS pattern, {ver} AS version FROM {pages} WHERE regexp_matches(html, {rx})")
    return "\nUNION ALL\n".join(sels)


def o_keyed_matches(src: str, ev: str) -> str:
    """ev: relation (page_id, key_norm, value)."""
    sels = []
    for p in _pats(src):
        rx = _ci(p["pattern"])
        ver = f"nullif(regexp_extract(value, {rx}, 1), '')" if p["n_groups"] > 0 else "CAST(NULL AS VARCHAR)"
        sels.append(
            f"SELECT page_id, {O.sql_str(p['tech_key'])} AS tech_key, '{src}' AS src, {p['src_rank']} AS src_rank, "
            f"{p['pos']} AS pos, {O.sql_str(p['key'])} AS key, value AS matched, {O.sql_str(p['pattern'])} AS pattern, "
            f"{ver} AS version FROM {ev} WHERE key_norm = {O.sql_str(p['key_norm'])} AND regexp_matches(value, {rx})")
    return "\nUNION ALL\n".join(sels) if sels else \
        "SELECT NULL::BIGINT page_id, NULL tech_key, NULL src, NULL::INT src_rank, NULL::INT pos, NULL key, " \
        "NULL matched, NULL pattern, NULL version WHERE FALSE"


def o_score(m: str = "m") -> str:
    return f"""SELECT m.page_id, m.tech_key, r.ord, r.name, r.category,
  min_by(m.version, m.src_rank * 1000 + m.pos) FILTER (WHERE m.version IS NOT NULL AND m.version <> '') AS version,
  count(DISTINCT m.src) AS n_sources,
  round(least(CAST(any_value(r.base) AS DOUBLE) + CAST(0.1 AS DOUBLE) * (count(DISTINCT m.src) - 1)
        + CASE WHEN count(m.version) FILTER (WHERE m.version <> '') > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0.0 END,
        1.0), 2) AS confidence,
  string_agg(m.src || ':' || m.key || ':' || m.matched, ' | ' ORDER BY m.src_rank, m.pos) AS evidence
FROM {m} m JOIN {O.rules_values()} r USING (tech_key)
GROUP BY m.page_id, m.tech_key, r.ord, r.name, r.category"""


def _spark_scored(tech: DataFrame) -> DataFrame:
    return tech.select("page_id", "tech_key", "name", "category", "version", "confidence", "n_sources",
                       S.evidence_text().alias("evidence"))


SCORED_COLS = "page_id, tech_key, name, category, version, confidence, n_sources, evidence"


# ---------------------------------------------------------------------------
# html_rule_match: S5 M5 A1-A4 (the minimum slice)
# ---------------------------------------------------------------------------
@query("html_rule_match")
def q_html_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    _setup(spark, sf_dir)
    cr = _rules(spark)
    pages = E.page_source(spark.table("pages"))
    return _spark_scored(S.score(M.match_html(pages, cr.patterns), cr.rules))


@oracle("html_rule_match")
def o_html_rule_match() -> str:
    return f"""WITH pg AS (SELECT page_id, html FROM pages),
m AS ({o_html_matches('pg')})
SELECT {SCORED_COLS} FROM ({o_score('m')}) s"""


# query modules register themselves on import
from sitelens.plans import q_evidence  # noqa: E402,F401
from sitelens.plans import q_endpoints  # noqa: E402,F401
from sitelens.plans import q_domains  # noqa: E402,F401
from sitelens.plans import q_wordlists  # noqa: E402,F401
from sitelens.plans import q_dom  # noqa: E402,F401
from sitelens.plans import q_streaming  # noqa: E402,F401
from sitelens.plans import q_report  # noqa: E402,F401
