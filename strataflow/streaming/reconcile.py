"""What becomes of each declared frame set: appended, duplicate, ignored, replayed, invalidated or an error.

Frame sets carry a source, a sequence and a revision.  The first source seen wins, others are foreign.  A sequence beyond
the newest is appended (the gap is counted); a known sequence with an equal revision is a duplicate, with a smaller one
stale, with a larger one a correction; an older sequence that was never accepted is late.  Policies decide what late sets
and corrections do.  One state machine serves the batch form (rows of a node in arrival order) and the stream.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

APPEND_ONLY, REPLAY_WINDOW, INVALIDATE_ZONES, STRICT = "append_only", "replay_window", "invalidate_zones", "strict"
OUTCOMES = "node long, arrival long, source long, sequence long, revision long, outcome string, reason string, position long, skipped long"
STATE = "source long, sequences array<long>, revisions array<long>"


@dataclass
class Reconciler:
    """The state of one node."""

    policy: str = APPEND_ONLY
    window: int = 8
    source: int | None = None
    order: list[int] = field(default_factory=list)  # accepted sequences, ascending
    revisions: dict[int, int] = field(default_factory=dict)

    def offer(self, source: int, sequence: int, revision: int) -> tuple[str, str | None, int | None, int]:
        """(outcome, reason, position, sequences skipped).  Under the strict policy whatever would be ignored is rejected."""
        outcome, *rest = self._offer(source, sequence, revision)
        return ("rejected" if outcome == "ignored" and self.policy == STRICT else outcome, *rest)

    def _offer(self, source: int, sequence: int, revision: int) -> tuple[str, str | None, int | None, int]:
        if self.source is None:
            self.source = source
        if source != self.source:
            return "ignored", "foreign_source", None, 0
        if (known := self.revisions.get(sequence)) is not None:
            at = bisect_left(self.order, sequence)
            if revision == known:
                return "duplicate", None, at, 0
            if revision < known:
                return "ignored", "stale_revision", at, 0
            return self._correct(sequence, revision, at)
        if self.order and sequence < self.order[-1]:
            return self._late(sequence, revision)
        skipped = sequence - self.order[-1] - 1 if self.order else 0
        if skipped and self.policy == STRICT:
            return "rejected", "gap", None, skipped
        self.order.append(sequence)
        self.revisions[sequence] = revision
        return "appended", None, len(self.order) - 1, skipped

    def _correct(self, sequence: int, revision: int, at: int) -> tuple[str, str | None, int | None, int]:
        if self.policy in (APPEND_ONLY, STRICT):
            return "ignored", "correction", at, 0
        if self.policy == REPLAY_WINDOW and len(self.order) - at > self.window:
            return "ignored", "outside_window", at, 0
        self.revisions[sequence] = revision
        return ("replayed" if self.policy == REPLAY_WINDOW else "invalidated"), None, at, 0

    def _late(self, sequence: int, revision: int) -> tuple[str, str | None, int | None, int]:
        if self.policy != REPLAY_WINDOW:
            return "ignored", "late", None, 0
        at = bisect_left(self.order, sequence)
        if len(self.order) - at > self.window:
            return "ignored", "outside_window", None, 0
        self.order.insert(at, sequence)
        self.revisions[sequence] = revision
        return "replayed", None, at, 0


def _run(machine: Reconciler, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("arrival", kind="stable")
    found = [machine.offer(*x) for x in zip(rows["source"].tolist(), rows["sequence"].tolist(), rows["revision"].tolist())]
    out = rows[["node", "arrival", "source", "sequence", "revision"]].copy()
    for i, name in enumerate(("outcome", "reason", "position", "skipped")):
        out[name] = pd.Series([f[i] for f in found], index=out.index, dtype="object" if i < 2 else "Int64")
    return out


def _append_only(sets: DataFrame) -> DataFrame:
    """The append-only policy in windows: nothing that was accepted changes, so a sequence's first offer decides."""
    by = Window.partitionBy("node").orderBy("arrival")
    own = sets.withColumn("_foreign", F.col("source") != F.first("source").over(by))
    own = own.withColumn("_newest", F.max(F.when(~F.col("_foreign"), F.col("sequence"))).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    same = Window.partitionBy("node", "_foreign", "sequence").orderBy("arrival")
    own = own.withColumns({"_nth": F.row_number().over(same), "_given": F.first("revision").over(same), "_then": F.first("_newest").over(same)})
    own = own.withColumn("_accepted", ~F.col("_foreign") & (F.col("_then").isNull() | (F.col("sequence") > F.col("_then"))))
    fresh = F.col("_accepted") & (F.col("_nth") == 1)
    place = F.sum(fresh.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1
    own = own.withColumn("_place", place).withColumn("_at", F.first("_place").over(same))
    given = F.col("_given")
    outcome = F.when(fresh, "appended").when(F.col("_accepted") & (F.col("revision") == given), "duplicate").otherwise("ignored")
    stale = F.when(F.col("revision") < given, "stale_revision").when(F.col("revision") > given, "correction")
    reason = F.when(F.col("_foreign"), "foreign_source").when(~F.col("_accepted"), "late").otherwise(stale)
    skipped = F.when(fresh, F.coalesce(F.col("sequence") - F.col("_then") - 1, F.lit(0))).otherwise(0)
    return own.select("node", "arrival", "source", "sequence", "revision", outcome.alias("outcome"), reason.alias("reason"), F.when(F.col("_accepted"), F.col("_at")).alias("position"), skipped.cast("long").alias("skipped"))


def reconcile(sets: DataFrame, policy: str = APPEND_ONLY, window: int = 8) -> DataFrame:
    """Outcomes of a table of frame sets: node, arrival (order within a node, distinct), source, sequence, revision.

    Append-only runs in windows; the other policies, where later offers change what was accepted, run the state machine with
    a node's rows in one task.  None of the columns may be null; an empty table gives no rows."""
    if policy == APPEND_ONLY:
        return _append_only(sets.select("node", "arrival", "source", "sequence", "revision"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return _run(Reconciler(policy, window), rows)

    return sets.select("node", "arrival", "source", "sequence", "revision").groupBy("node").applyInPandas(work, OUTCOMES)


def reconcile_stream(sets: DataFrame, policy: str = APPEND_ONLY, window: int = 8) -> DataFrame:
    """The same for a stream: each node's state is kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Reconciler(policy, window)
        if state.exists:
            source, sequences, revisions = state.get
            machine.source, machine.order, machine.revisions = source, list(sequences), dict(zip(sequences, revisions))
        rows = list(batches)
        if rows:
            yield _run(machine, pd.concat(rows))
        state.update((machine.source, machine.order, [machine.revisions[s] for s in machine.order]))

    return sets.select("node", "arrival", "source", "sequence", "revision").groupBy("node").applyInPandasWithState(work, OUTCOMES, STATE, "append", GroupStateTimeout.NoTimeout)


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts by node and outcome, with the sequences skipped."""
    return outcomes.groupBy("node", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("skipped").alias("skipped"))
