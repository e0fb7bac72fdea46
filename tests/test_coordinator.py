"""Answers of the group coordinator to written-out scripts of requests, in a batch and in a stream."""

import pytest

from strandlog.operators import coordinator, groups

P = ["range", "roundrobin"]
#: kind, member, instance, generation, protocols, metadata, assigned, at_ms -> member, error, generation, leader, formed, members, assignment
SCRIPT = [
    (("commit", "", None, -1, None, None, None, 0), ("", "NONE", 0, None, False, 0, None)),
    (("join", "", None, None, [], "a", None, 0), ("", "INVALID_REQUEST", 0, None, False, 0, None)),
    (("join", "", None, None, P, "a", None, 0), ("member-g-2", "MEMBER_ID_REQUIRED", 0, None, False, 1, None)),
    (("join", "member-g-2", None, None, P, "a", None, 1), ("member-g-2", "NONE", 0, "member-g-2", False, 1, None)),
    (("join", "", "s", None, ["roundrobin"], "b", None, 2), ("", "INCONSISTENT_GROUP_PROTOCOL", 0, "member-g-2", False, 1, None)),
    (("join", "", "s", None, ["range"], "b", None, 3), ("s-g-5", "NONE", 0, "member-g-2", False, 2, None)),
    (("sync", "s-g-5", None, 0, None, None, None, 4), ("s-g-5", "REBALANCE_IN_PROGRESS", 0, "member-g-2", False, 2, None)),
    (("sync", "member-g-2", None, 0, None, None, ["member-g-2=0"], 5), ("member-g-2", "REBALANCE_IN_PROGRESS", 0, "member-g-2", False, 2, None)),
    (("sync", "member-g-2", None, 0, None, None, ["member-g-2=0", "s-g-5=1=2"], 6), ("member-g-2", "NONE", 0, "member-g-2", True, 2, "0")),
    (("sync", "s-g-5", None, 0, None, None, None, 7), ("s-g-5", "NONE", 0, "member-g-2", True, 2, "1=2")),
    (("heartbeat", "x", None, 0, None, None, None, 8), ("x", "UNKNOWN_MEMBER_ID", 0, "member-g-2", True, 2, None)),
    (("commit", "s-g-5", None, 0, None, None, None, 9), ("s-g-5", "NONE", 0, "member-g-2", True, 2, None)),
    (("commit", "s-g-5", None, 4, None, None, None, 9), ("s-g-5", "ILLEGAL_GENERATION", 0, "member-g-2", True, 2, None)),
    (("commit", "", None, 0, None, None, None, 9), ("", "UNKNOWN_MEMBER_ID", 0, "member-g-2", True, 2, None)),
    (("heartbeat", "s-g-5", None, 1, None, None, None, 9), ("s-g-5", "ILLEGAL_GENERATION", 0, "member-g-2", True, 2, None)),
    (("join", "", "s", None, P, "b", None, 10), ("s-g-5", "NONE", 0, "member-g-2", True, 2, None)),
    (("join", "", "s", None, P, "c", None, 11), ("s-g-5", "NONE", 0, "member-g-2", False, 2, None)),
    (("join", "new", None, None, P, "d", None, 12), ("new", "NONE", 0, "member-g-2", False, 3, None)),
    (("sync", "member-g-2", None, 0, None, None, ["member-g-2=0", "s-g-5=1", "new=2"], 13), ("member-g-2", "NONE", 0, "member-g-2", True, 3, "0")),
    (("join", "new", None, None, P, "e", None, 14), ("new", "NONE", 1, "member-g-2", False, 3, None)),
    (("heartbeat", "new", None, 0, None, None, None, 15), ("new", "REBALANCE_IN_PROGRESS", 1, "member-g-2", False, 3, None)),
    (("leave", "s-g-5", None, None, None, None, None, 16), ("s-g-5", "NONE", 2, "member-g-2", False, 2, None)),
    (("leave", "s-g-5", None, None, None, None, None, 17), ("s-g-5", "UNKNOWN_MEMBER_ID", 2, "member-g-2", False, 2, None)),
    (("heartbeat", "new", None, 2, None, None, None, 60_000), ("new", "REBALANCE_IN_PROGRESS", 2, None, False, 1, None)),
    (("join", "new", None, None, P, "e", None, 60_001), ("new", "NONE", 2, "new", False, 1, None)),
    (("dance", "new", None, None, None, None, None, 60_002), ("new", "INVALID_REQUEST", 2, "new", False, 1, None)),
]


def requests(spark, groups=("g",)):
    rows = [(g, i, at, kind, m.replace("-g-", f"-{g}-"), inst, gen, prot, meta, [x.replace("-g-", f"-{g}-") for x in given] if given else given) for g in groups for i, ((kind, m, inst, gen, prot, meta, given, at), _) in enumerate(SCRIPT)]
    return spark.createDataFrame(rows, coordinator.REQUEST)


def told(rows, group="g"):
    return [tuple(r)[2:] for r in sorted(rows, key=lambda r: r.seq) if r.group_id == group]


def test_a_script_of_requests(spark):
    got = coordinator.answers(requests(spark, ("g", "h"))).collect()
    assert told(got) == [want for _, want in SCRIPT]
    assert [x[1] for x in told(got, "h")] == [want[1] for _, want in SCRIPT]
    assert coordinator.answers(requests(spark).where("false")).count() == 0


@pytest.mark.parametrize("files", [2])
def test_the_same_in_a_stream(spark, tmp_path, files):
    rows = requests(spark)
    half = len(SCRIPT) // files
    for i in range(files):
        rows.where((rows.seq >= i * half) & ((rows.seq < (i + 1) * half) | (i == files - 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = coordinator.answers_of_stream(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    assert told(spark.table("told").collect()) == [want for _, want in SCRIPT]


def test_round_robin_passes_members_without_the_topic(spark):
    topitions = spark.createDataFrame([(t, p) for t in ("a", "b", "c", "d") for p in range(3)], "topic string, partition int")
    heard = {"a": "xyz", "b": "yz", "c": "x"}
    subscriptions = spark.createDataFrame([(t, m) for t, ms in heard.items() for m in ms], "topic string, member string")
    want, turn = [], 0
    for t in "abc":
        for p in range(3):
            while "xyz"[turn % 3] not in heard[t]:
                turn += 1
            want.append(("xyz"[turn % 3], t, p))
            turn += 1
    for strategy in ("roundrobin", "uniform", "cooperative-sticky"):
        assert sorted(map(tuple, groups.assigned_by(strategy, topitions, subscriptions).collect())) == sorted(want)
    assert groups.assigned_by("range", topitions, subscriptions).where("topic = 'c'").collect() == [("x", "c", p) for p in range(3)]
    with pytest.raises(ValueError, match="sticky"):
        groups.assigned_by("sticky", topitions, subscriptions)
