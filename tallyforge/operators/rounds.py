"""Greedy one-to-one choice in a fixed order, as rounds of proposals over all groups at once.

Seekers of a statement choose in turn, each the first slot of its lists that is still free. As every slot prefers the earlier
seeker, this is the one stable matching, and rounds in which seekers propose and slots keep their earliest proposer
(deferred acceptance) reach it in any order of proposals. Seekers of one list propose at once to as many of its slots:
the k-th to the k-th, since the slots before that are sure to go to those before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PIECE, Ordered
from .sequence import settled

_KEY = ["statement_id", "key"]
_SLOT = ["statement_id", "slot"]


@dataclass(frozen=True)
class Choice:
    """chosen: statement_id, turn, slot, key of the seekers that got one; rounds: how many it took."""

    chosen: DataFrame
    rounds: int


def _numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their number within the key; keys of any size."""
    return Ordered.of(rows, _KEY, order).carried(count={name: F.lit(True)}).rows.drop(PIECE)


def in_turn(seekers: DataFrame, lists: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> Choice:
    """seekers: statement_id, turn (a number, once a statement), keys (the names of their lists, best first). lists:
    statement_id, key, slot, preference (a number, once a key). more: gives the lists of keys (statement_id, key) that
    seekers have come to and `lists` lacks.

    Each round settles at least the earliest seeker of each statement that is still open. Only lists with open seekers are
    read; in those, slots held by earlier seekers than the first open one are left out, and holders after it propose again.
    Every round is written, so that none is computed twice.
    """
    key = F.try_element_at("keys", F.col("at"))
    now = seekers.select("statement_id", F.col("turn").cast("long").alias("turn"), "keys", F.lit(1).alias("at"), F.lit(None).cast("long").alias("slot"))
    lists, listed, rounds = settled(lists.select(*_KEY, F.col("slot").cast("long").alias("slot"), "preference")), None, 0
    state = settled(now.filter(key.isNotNull()))
    while True:
        live = state.withColumn("key", key)  # those with a slot hold it for the time being
        groups = settled(live.filter("slot is null").groupBy(*_KEY).agg(F.min("turn").alias("first")))
        if groups.isEmpty():
            break
        rounds += 1
        if more is not None:
            known = lists.select(*_KEY) if listed is None else lists.select(*_KEY).union(listed)
            new = settled(groups.select(*_KEY).join(known.distinct(), _KEY, "left_anti"))
            if not new.isEmpty():
                lists = settled(lists.unionByName(more(new).select(*_KEY, F.col("slot").cast("long").alias("slot"), "preference")))
                listed = new if listed is None else listed.union(new)
        marked = live.join(groups, _KEY, "left").withColumn("proposes", F.coalesce((F.col("slot").isNull()) | (F.col("turn") > F.col("first")), F.lit(False)))
        marked = settled(marked)
        stay = marked.filter("not proposes").select("statement_id", "turn", "keys", "at", "slot")
        asking = _numbered(marked.filter("proposes").select(*_KEY, "turn", "keys", "at"), "turn", "k")
        held = stay.select(*_SLOT, F.col("turn").alias("holder"))
        offered = lists.join(groups, _KEY).join(held, _SLOT, "left").filter("holder is null or holder > first")
        offered = _numbered(offered.select(*_KEY, "slot", "preference"), "preference", "k")
        asked = settled(asking.join(offered, [*_KEY, "k"], "left").select("statement_id", "turn", "keys", "at", "slot"))
        # A list without a k-th slot has none for the k-th seeker: on to its next list, or out.
        onward = asked.filter("slot is null").withColumn("at", F.col("at") + 1).filter(key.isNotNull())
        claims = asked.filter("slot is not null").unionByName(stay)
        best = claims.groupBy(*_SLOT).agg(F.min("turn").alias("winner"))
        told = claims.join(best, _SLOT).withColumn("slot", F.when(F.col("turn") == F.col("winner"), F.col("slot"))).drop("winner")
        state = settled(told.select(state.columns).unionByName(onward.select(state.columns)))
    chosen = state.filter("slot is not null").select("statement_id", "turn", "slot", key.alias("key"))
    return Choice(chosen, rounds)
