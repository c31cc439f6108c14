"""Runs of a source: one at a time, recorded from start to end, stopped on request.

A run is rows of the table ``runs``, appended in commits: one when it starts and one when it ends, of which
the later counts. Starting is a commit that fails if ``runs`` has changed since it was
read, so of two starters one wins and the other finds the source busy. A run that has been open for
longer than STALE_HOURS is taken over: the commit that starts the next one marks it FAILED, and it
can commit nothing any more.

To stop a run, a file is put into the shared folder. Whoever runs it looks for that file, between its
steps and from a thread beside them, which cancels the run's Spark jobs by their tag.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.commits import Commit, Conflict, Store
from tideline.operators.store import STALE_HOURS, chain, run_status
from tideline.schemas import RUN

EVENT = f"{RUN}, event int"
STARTED, ENDED = 0, 1


class Busy(RuntimeError):
    """The source has an open run."""


class Stopped(RuntimeError):
    """The run was stopped on request."""


class TakenOver(Conflict):
    """The run was marked FAILED by the one that took over."""


def runs(store: Store, at: Commit | None = None) -> DataFrame:
    """One row for each run, as it was last said to be."""
    names = [f.split()[0] for f in RUN.split(", ")]
    events = store.read("runs", EVENT, at)
    return events.groupBy("run_id").agg(F.max_by(F.struct(*names), F.struct("event", "finished_at")).alias("_r")).select("_r.*")


def _staged(store: Store, events: list[tuple]) -> dict[str, str]:
    return {"runs": store.stage("runs", store.spark.createDataFrame(events, EVENT).coalesce(1))}


def start(store: Store, source: str, now: dt.datetime) -> str:
    """The id of a new run of the source; :class:`Busy` if one is open. Stale ones are marked FAILED by the same commit."""
    while True:
        base = store.last()
        open_ = runs(store, base).filter((F.col("source") == source) & (F.col("status") == "RUNNING")).collect()  # a few rows
        stale = [r for r in open_ if now - r["started_at"] > dt.timedelta(hours=STALE_HOURS)]
        if len(stale) < len(open_):
            raise Busy(f"a run of {source} is open")
        run_id = uuid.uuid4().hex
        said = json.dumps({"error": f"still running after {STALE_HOURS} hours"})
        events = [(r["run_id"], source, "FAILED", r["started_at"], now, 0, 0, said, ENDED) for r in stale]
        events.append((run_id, source, "RUNNING", now, None, 0, 0, None, STARTED))
        try:
            store.commit(base, appended=_staged(store, events), note=f"start {source}", now=now, unchanged=["runs"], marks={f"open {source}": run_id})
            return run_id
        except Conflict:
            continue


def end(store: Store, base: Commit, run_id: str, source: str, status: str, started: dt.datetime, finished: dt.datetime, upserted: int = 0, skipped: int = 0, summary: dict | None = None, replaced: dict[str, str] | None = None, appended: dict[str, str] | None = None) -> Commit:
    """Commit a run's tables and its end at once; :class:`TakenOver` if another has taken over, :class:`Conflict` if a table has changed since."""

    def still_open(last: Commit) -> None:
        now = runs(store, last).filter(F.col("run_id") == run_id).first()
        if now is None or now["status"] != "RUNNING":
            raise TakenOver(f"run {run_id} was taken over")

    event = _staged(store, [(run_id, source, status, started, finished, upserted, skipped, json.dumps(summary or {}, sort_keys=True), ENDED)])
    return store.commit(base, replaced, {**(appended or {}), **event}, f"{status} {source}", finished, check=still_open, marks={f"open {source}": None})


def stop(store: Store, source: str) -> bool:
    """Ask the source's open run to stop: is there one?"""
    run_id = store.last().marks.get(f"open {source}")  # no Spark job, which might wait for the very run
    return run_id is not None and (store.put_if_absent(f"stop/{run_id}", source) or True)


@contextmanager
def controlled(store: Store, run_id: str, poll: float = 0.5) -> Iterator[Callable[[], None]]:
    """Within it, Spark jobs of this thread are cancelled once the run is to stop; yields a function that raises :class:`Stopped` then."""
    spark, ended, tag = store.spark, threading.Event(), f"run-{run_id}"

    def watch() -> None:
        while not ended.wait(poll):
            if store.exists(f"stop/{run_id}"):
                spark.interruptTag(tag)

    def check() -> None:
        if store.exists(f"stop/{run_id}"):
            raise Stopped(run_id)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.addTag(tag)
    watcher.start()
    try:
        yield check
    finally:
        ended.set()
        watcher.join()
        spark.removeTag(tag)


@dataclass
class Loaded:
    """What a load has written and counted, to be committed with the end of its run."""

    replaced: dict[str, str] = field(default_factory=dict)
    appended: dict[str, str] = field(default_factory=dict)
    upserted: dict[str, int] = field(default_factory=dict)
    issues: int = 0
    skipped: int = 0
    summary: dict = field(default_factory=dict)


Load = Callable[[Store, Commit, str, dt.datetime, Callable[[], None]], Loaded]


def run(store: Store, source: str, load: Load, now: dt.datetime, clock: Callable[[], dt.datetime] | None = None, poll: float = 0.5, tries: int = 3) -> str:
    """Run a load of a source from start to end; the status it ended with.

    ``load(store, base, run_id, now, check)`` reads tables as of ``base`` and stages what it makes of them. If another
    source has changed one of those tables meanwhile, it is done again from the tables as they are then.
    Whatever it raises ends the run as FAILED, with the message, or as CANCELLED if it was to stop; then no table has changed.
    """
    clock = clock or (lambda: now)
    run_id = start(store, source, now)
    with controlled(store, run_id, poll) as check:
        try:
            for left in reversed(range(tries)):
                check()
                base = store.last()
                done = load(store, base, run_id, now, check)
                check()
                status = run_status(done.issues, done.skipped)
                try:
                    end(store, base, run_id, source, status, now, clock(), sum(done.upserted.values()), done.skipped, {**done.summary, "upserted": done.upserted, "issues": done.issues}, done.replaced, done.appended)
                    return status
                except TakenOver:
                    raise
                except Conflict:
                    if not left:
                        raise
        except Exception as e:
            stopped = isinstance(e, Stopped) or store.exists(f"stop/{run_id}")
            status = "CANCELLED" if stopped else "FAILED"
            failure = {} if stopped else {"error": str(e)[:2000]}
    try:
        end(store, store.last(), run_id, source, status, now, clock(), summary=failure)
    except TakenOver:
        return "FAILED"
    return status


def run_all(store: Store, loads: dict[str, Load], now: dt.datetime) -> list[tuple[str, str]]:
    """Run several sources in order; the first that ends FAILED or CANCELLED is the last. :class:`Busy`, and none is run, if any is open."""
    open_ = {r["source"] for r in runs(store).filter("status = 'RUNNING'").filter(F.col("source").isin(list(loads))).filter(F.col("started_at") >= F.lit(now - dt.timedelta(hours=STALE_HOURS))).collect()}
    if open_:
        raise Busy(f"runs of {', '.join(sorted(open_))} are open")
    return chain([(name, lambda name=name: run(store, name, loads[name], now)) for name in loads])
