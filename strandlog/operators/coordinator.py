"""The life of consumer groups: join, sync, heartbeat, leave and commit requests of each group, answered in their order.

A request's answer depends on all earlier ones of its group, so a group is one task's work; what is kept is its members only. The same
pure step serves a batch (requests stream through sorted partitions) and a stream (one JSON state a group).

Requests have the columns of REQUEST. A null protocols, metadata, instance or assigned is an absent one. Requests of a group should have
distinct seq: order among equal ones is not defined. A request of another kind is answered INVALID_REQUEST. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUEST = "group_id string, seq long, at_ms long, kind string, member string, instance string, generation int, protocols array<string>, metadata string, assigned array<string>"
ANSWER = "group_id string, seq long, member string, error string, generation int, leader string, formed boolean, members int, assignment string"
COLUMNS = [c.split(" ")[0] for c in REQUEST.split(", ")]
SESSION_TIMEOUT_MS = 45_000


def empty() -> dict:
    return {"formed": False, "protocol": None, "leader": None, "generation": 0, "members": {}, "assigned": {}}


def _reopened(s: dict, more: int) -> None:
    """Back to forming: members have to sync again."""
    s["formed"], s["assigned"], s["generation"] = False, {}, s["generation"] + more
    if s["leader"] not in s["members"]:
        s["leader"] = None


def _join(s: dict, r: dict) -> tuple[str, str]:
    offered, name, instance = r["protocols"], r["member"] or "", r["instance"]
    if not offered:
        return name, "INVALID_REQUEST"
    if s["protocol"] is not None and s["protocol"] not in offered:
        return name, "INCONSISTENT_GROUP_PROTOCOL"
    if s["protocol"] is None:
        s["protocol"] = offered[0]
    fresh = f"{instance or 'member'}-{r['group_id']}-{r['seq']}"
    own = {"instance": instance, "metadata": r["metadata"], "seen": r["at_ms"]}
    if not name and instance is None:  # the id is given now, and the client asks again with it
        s["members"][fresh] = own
        if s["formed"]:
            _reopened(s, 1)
        return fresh, "MEMBER_ID_REQUIRED"
    if instance is not None:
        name = next((m for m, x in s["members"].items() if x["instance"] == instance), name or fresh)
    before = s["members"].get(name)
    s["members"][name] = own
    if s["formed"] and (before is None or before["metadata"] != own["metadata"]):
        _reopened(s, 0 if before is not None and instance is not None else 1)
    if not s["formed"] and s["leader"] is None:
        s["leader"] = name
    return name, "NONE"


def _fence(s: dict, r: dict) -> str:
    if r["member"] not in s["members"]:
        return "UNKNOWN_MEMBER_ID"
    return "ILLEGAL_GENERATION" if r["generation"] > s["generation"] else "NONE"


def _silent_gone(s: dict, r: dict, timeout_ms: int) -> bool:
    """The asking member was heard now; others that were silent for too long go, and a leader among them leads no more."""
    s["members"][r["member"]]["seen"] = r["at_ms"]
    gone = [m for m, x in s["members"].items() if r["at_ms"] - x["seen"] > timeout_ms]
    for m in gone:
        del s["members"][m]
    if s["leader"] in gone:
        s["leader"] = None
        _reopened(s, 0)
    return bool(gone)


def _sync(s: dict, r: dict, timeout_ms: int) -> str:
    fenced = _fence(s, r)
    if fenced != "NONE":
        return fenced
    if _silent_gone(s, r, timeout_ms) or r["generation"] < s["generation"]:
        return "REBALANCE_IN_PROGRESS"
    if s["formed"]:
        return "NONE"
    given = dict(x.split("=", 1) for x in r["assigned"] or [])
    if r["member"] != s["leader"] or set(given) != set(s["members"]):
        return "REBALANCE_IN_PROGRESS"
    s["formed"], s["assigned"] = True, given
    return "NONE"


def _heartbeat(s: dict, r: dict, timeout_ms: int) -> str:
    fenced = _fence(s, r)
    if fenced != "NONE":
        return fenced
    return "REBALANCE_IN_PROGRESS" if _silent_gone(s, r, timeout_ms) or r["generation"] < s["generation"] else "NONE"


def _leave(s: dict, r: dict) -> str:
    if s["members"].pop(r["member"], None) is None:
        return "UNKNOWN_MEMBER_ID"
    _reopened(s, 1)
    return "NONE"


def _commit(s: dict, r: dict) -> str:
    """Whether offsets may be committed: without a member's name only while the group is empty; while it is formed only in its generation."""
    if not r["member"] and not s["members"]:
        return "NONE"
    if r["member"] not in s["members"]:
        return "UNKNOWN_MEMBER_ID"
    return "ILLEGAL_GENERATION" if s["formed"] and r["generation"] != s["generation"] else "NONE"


def step(s: dict, r: dict, timeout_ms: int = SESSION_TIMEOUT_MS) -> dict:
    """Answer one request; s changes in place."""
    name, error = r["member"] or "", "INVALID_REQUEST"
    if r["kind"] == "join":
        name, error = _join(s, r)
    elif r["kind"] == "sync":
        error = _sync(s, r, timeout_ms)
    elif r["kind"] == "heartbeat":
        error = _heartbeat(s, r, timeout_ms)
    elif r["kind"] == "leave":
        error = _leave(s, r)
    elif r["kind"] == "commit":
        error = _commit(s, r)
    assignment = s["assigned"].get(name) if r["kind"] == "sync" and error == "NONE" else None
    return {"group_id": r["group_id"], "seq": r["seq"], "member": name, "error": error, "generation": s["generation"], "leader": s["leader"], "formed": s["formed"], "members": len(s["members"]), "assignment": assignment}


def _requests(pdf: pd.DataFrame) -> Iterator[dict]:
    for row in pdf[COLUMNS].astype(object).itertuples(index=False):
        r = {c: list(x) if c in ("protocols", "assigned") and x is not None else None if x is None or not hasattr(x, "__len__") and pd.isna(x) else x for c, x in zip(COLUMNS, row, strict=True)}
        yield r | {"generation": -1 if r["generation"] is None else int(r["generation"]), "at_ms": int(r["at_ms"] or 0), "seq": int(r["seq"])}


def answers(requests: DataFrame, timeout_ms: int = SESSION_TIMEOUT_MS) -> DataFrame:
    """The answer to each request, and the group as it then is."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, s = None, empty()
        for pdf in parts:
            out = []
            for r in _requests(pdf):
                if r["group_id"] != at:
                    at, s = r["group_id"], empty()
                out.append(step(s, r, timeout_ms))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANSWER.split(", ")])

    rows = requests.select(*COLUMNS).where("seq is not null and group_id is not null")
    return rows.repartition("group_id").sortWithinPartitions("group_id", "seq").mapInPandas(run, ANSWER)


def answers_of_stream(requests: DataFrame, timeout_ms: int = SESSION_TIMEOUT_MS) -> DataFrame:
    """The same over a stream: seq orders the requests of a micro-batch, the group's state carries over to the next."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else empty()
        whole = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")  # one group's requests of one micro-batch
        out = [step(s, r, timeout_ms) for r in _requests(whole)]
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANSWER.split(", ")])

    rows = requests.select(*COLUMNS).where("seq is not null and group_id is not null")
    return rows.groupBy("group_id").applyInPandasWithState(run, ANSWER, "state string", "append", GroupStateTimeout.NoTimeout)
