"""Stateful streaming: sessions of a conversation folded into its memory, and event-time windows.

The state of a conversation is its memory table and the sessions that wait; facts come as rows
(user_id, session, arrival, text, type), on a stream with their time ts. A session needn't have facts. ``operators.sessions`` folds
whole tables by the full rules of the merge, resolved times included; this fold uses texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import similarity_from, token_set

OUT = "user_id string, session long, id string, text string, event string"
STATE = "next long, memory string, waiting string"


def fold_session(memory: list[dict], facts: list[dict], same: float = 0.92, related: float = 0.70) -> list[dict]:
    """Apply one session's facts to a memory in place, one fact after the other; returns its operations.

    Within a session decisions are taken against the memory that it began with. Similarities below both bounds decide nothing and aren't worked out.
    """
    start = [dict(m) for m in memory]
    known = {m["text"].strip().lower() for m in start}
    used, best, adds = {m["id"] for m in start}, {}, []
    for fact in facts:
        text = (fact["text"] or "").strip()
        if not text or text.lower() in known:
            continue
        scored = [(similarity_from(min(same, related), text, m["text"]), -i) for i, m in enumerate(start)]
        score, place = max(scored, default=(0.0, 0))
        if score >= same:
            continue
        if score >= related and (fact["type"] == "plan" or score >= 0.75 and len(token_set(text) - token_set(start[-place]["text"])) >= 2):
            target = start[-place]["id"]
            if target not in best or score > best[target][0]:
                best[target] = (score, text)
            continue
        number = next(str(i) for i in range(len(used) + 1) if str(i) not in used)
        used.add(number)
        known.add(text.lower())
        adds.append({"id": number, "text": text, "event": "ADD"})
    ops = [{"id": i, "text": t, "event": "UPDATE"} for i, (_, t) in sorted(best.items(), key=lambda kv: -kv[1][0])] + adds
    for op in ops:
        if op["event"] == "UPDATE":
            next(m for m in memory if m["id"] == op["id"])["text"] = op["text"]
        else:
            memory.append({"id": op["id"], "text": op["text"]})
    return ops


def _advance(user: str, state: dict, until: float) -> list[dict]:
    """Fold the waiting sessions in order, up to the first that has a fact not before ``until``."""
    out = []
    for session in sorted(state["waiting"]):
        if max(f["ts"] for f in state["waiting"][session]) >= until:
            break
        facts = sorted(state["waiting"].pop(session), key=lambda f: f["arrival"])
        out += [{"user_id": user, "session": session, **op} for op in fold_session(state["memory"], facts)]
        state["next"] = session + 1
    return out


def _take(state: dict, rows: list[dict]) -> None:
    """Let new facts wait; those of a session that has been folded come too late."""
    for r in rows:
        if int(r["session"]) >= state["next"]:
            state["waiting"].setdefault(int(r["session"]), []).append(r)


def batch_fold(facts: DataFrame) -> DataFrame:
    """All operations of all sessions in order, one conversation a task; sessions without facts are passed over."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        state = {"next": frame["session"].min(), "memory": [], "waiting": {}}
        _take(state, frame.assign(ts=0).to_dict("records"))
        return pd.DataFrame(_advance(str(key[0]), state, float("inf")), columns=["user_id", "session", "id", "text", "event"])

    return facts.groupBy("user_id").applyInPandas(run, OUT)


def stream_fold(facts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same on a stream of facts with event time ts, with the memory kept in the state store.

    Sessions may come out of order as far as ``late`` allows: a session is folded once the watermark has passed its last
    fact, whether or not another follows. A last session is so folded when any later fact, of any user, has moved the watermark on.
    """
    import json

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = {"next": -(1 << 62), "memory": [], "waiting": {}}
        if state.exists:
            at, memory, waiting = state.get
            now = {"next": at, "memory": json.loads(memory), "waiting": {int(k): v for k, v in json.loads(waiting).items()}}
        if not state.hasTimedOut:
            rows = [r for f in frames for r in f[["session", "arrival", "text", "type", "ts"]].to_dict("records")]
            _take(now, [{**r, "session": int(r["session"]), "arrival": int(r["arrival"]), "ts": r["ts"].timestamp() * 1000} for r in rows])
        mark = state.getCurrentWatermarkMs()
        out = _advance(str(key[0]), now, mark)
        state.update((now["next"], json.dumps(now["memory"]), json.dumps(now["waiting"])))
        if now["waiting"]:
            last = max(f["ts"] for f in now["waiting"][min(now["waiting"])])
            state.setTimeoutTimestamp(int(max(last, mark)) + 1)
        yield pd.DataFrame(out, columns=["user_id", "session", "id", "text", "event"])

    return facts.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, OUT, STATE, "append", "EventTimeTimeout")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window of event time; later ones than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
