"""Literal-prefiltered regex join: texts x patterns without a nested loop.

Each pattern carries a boolean query of literals (``ways``: OR of AND of ORs, from its parse tree) that every
text it can match satisfies.  One Aho-Corasick pass per text (pyahocorasick, built once per Python worker
from a broadcast of the literals) yields the literals that occur; their bits are folded per pattern and
clause, and only patterns whose query holds become candidates and reach ``rlike``.  The work per text is
linear in its length, independent of the rule count.  Patterns without any provable literal are candidates
of every text: they are in the same list of ids, so every plan is one equi-join on the pattern id.

Literals are a function of the rule set only.  More of them than ``MAX_BROADCAST_LITERALS`` are split into
shards of patterns by hash, one pass over the texts each.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.regex import fold
from sitelens.session import session_key

MAX_BROADCAST_LITERALS = 2_000_000
#: Rule sets whose literals stay broadcast, and automata that a worker keeps; older ones are built again when asked for.
KEPT_RULE_SETS, KEPT_AUTOMATA = 16, 4
_AUTOMATA: OrderedDict[str, tuple] = OrderedDict()
_SHARDS: OrderedDict[tuple, list] = OrderedDict()


def any_of(literals: Column) -> Column:
    """The query "one of these literals occurs"."""
    return F.array(F.array(literals))


def all_of(clauses: Column) -> Column:
    """The query "of each clause one literal occurs"."""
    return F.array(clauses)


def _built(bc, token: str) -> tuple:
    """(automaton of literals, uses of each literal as (way, clause bit), ids and full masks of ways, ids of every text)."""
    if token not in _AUTOMATA:
        import ahocorasick
        ways, always = bc.value
        automaton, number, uses = ahocorasick.Automaton(), {}, []
        for way, (_, clauses) in enumerate(ways):
            for bit, clause in enumerate(clauses):
                for literal in clause:
                    at = number.setdefault(literal, len(uses))
                    if at == len(uses):
                        automaton.add_word(literal, at)
                        uses.append([])
                    uses[at].append((way, 1 << bit))
        automaton.make_automaton()
        _AUTOMATA[token] = automaton, uses, [(pid, (1 << len(clauses)) - 1) for pid, clauses in ways], always
        while len(_AUTOMATA) > KEPT_AUTOMATA:
            _AUTOMATA.popitem(last=False)
    _AUTOMATA.move_to_end(token)
    return _AUTOMATA[token]


def candidate_ids_udf(bc):
    """pandas UDF: text -> sorted distinct ids of the patterns whose query of literals holds in fold(text)."""
    token = uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hits(texts: pd.Series) -> pd.Series:
        automaton, uses, ways, always = _built(bc, token)
        out = []
        for t in texts:
            if t is None:
                out.append([])
                continue
            found, masks = set(always), {}
            for literal in {at for _, at in automaton.iter(fold(t))} if len(automaton) else ():
                for way, bit in uses[literal]:
                    masks[way] = masks.get(way, 0) | bit
            found.update(ways[way][0] for way, mask in masks.items() if mask == ways[way][1])
            out.append(sorted(found))
        return pd.Series(out)

    return hits


def _shard(rows: list) -> tuple[list, list]:
    """(ways as (pid, clauses of folded literals), ids that hold for every text)."""
    ways, always = [], set()
    for r in rows:
        queries = r["ways"] or []
        if not queries or any(not way or any(not clause or not all(clause) for clause in way) for way in queries):
            always.add(r["pid"])
        else:
            ways += [(r["pid"], [sorted({fold(x) for x in clause}) for clause in way]) for way in queries]
    return sorted(ways), sorted(always)


def literal_shards(pats: DataFrame, ways: Column) -> list:
    """A candidate UDF for each shard of the pattern table, built once per distinct table (plan hash)."""
    spark = pats.sparkSession
    table = pats.select(F.col("pid").cast("long").alias("pid"), ways.alias("ways"))
    key = (session_key(spark), table._jdf.queryExecution().analyzed().semanticHash(), MAX_BROADCAST_LITERALS)
    if key not in _SHARDS:
        literals = table.agg(F.sum(F.greatest(F.size(F.flatten(F.flatten("ways"))), F.lit(1)))).first()[0] or 0
        n = max(1, -(-literals // MAX_BROADCAST_LITERALS))
        made = []
        for s in range(n):  # one bounded part of the rules at a time
            part = table if n == 1 else table.filter(F.pmod(F.xxhash64("pid"), F.lit(n)) == s)
            bc = spark.sparkContext.broadcast(_shard(part.collect()))
            made.append((bc, candidate_ids_udf(bc)))
        _SHARDS[key] = made
        while len(_SHARDS) > KEPT_RULE_SETS:
            for bc, _ in _SHARDS.popitem(last=False)[1]:
                bc.unpersist()
    _SHARDS.move_to_end(key)
    return [udf for _, udf in _SHARDS[key]]


def regex_join(texts: DataFrame, text_col: str, pats: DataFrame, ways: Column, cond) -> DataFrame:
    """Pairs (text row, pattern row) satisfying ``cond``, a predicate over the columns of both.

    ``pats`` needs a unique ``pid``; ``ways`` is an array<array<array<string>>>: a text that the pattern can match
    satisfies one of the ways, that is, contains of each of its clauses one literal (ASCII case aside).  NULL, no
    way, or a way without clauses: nothing is known, every text is a candidate.
    """
    pats = pats.withColumn("pid", F.col("pid").cast("long"))
    out = None
    for hits in literal_shards(pats, ways):
        cand = texts.withColumn("_pids", hits(F.col(text_col))).select("*", F.explode("_pids").alias("pid")).drop("_pids")
        out = cand if out is None else out.unionByName(cand)
    return out.join(pats, "pid").filter(cond)
