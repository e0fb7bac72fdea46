"""Pairs, latency and overlap of requests in a proxy's log."""

from strandlog.sources import proxy_log

A, B, C, D = ("abcdefghijklmnopqrst" + x for x in "ABCD")


def line(us, id_, kind, data, colour=""):
    return f'{colour}2024-05-01T10:00:0{us // 1_000_000}.{us % 1_000_000:06d}Z DEBUG req{{id="{id_}"}}: {kind}=[{", ".join(map(str, data))}]'


def test_calls_and_overlap(spark, tmp_path):
    request = [0, 0, 0, 9, 0, 11, 0, 5, 0]
    lines = [
        line(100, A, "request", request), line(200, B, "request", [0, 0, 0, 9, 0, 12, 0, 4], "\x1b[2m"), line(1_500_000, A, "response", [0, 1]), "noise", "",
        line(2_000_000, C, "request", [0, 0, 0, 9, 255, 255, 0, 0]), line(2_000_001, B, "response", [1]), line(3_000_000, A, "response", [7]), line(3_000_001, D, "request", []),
    ]
    (tmp_path / "x.log").write_text("\n".join(lines))
    got = {r.id: (r.api_key, r.api_version, r.elapsed_us, r.others) for r in proxy_log.read(spark, str(tmp_path / "x.log")).collect()}
    assert got == {A: (11, 5, 1_499_900, 0), B: (12, 4, 1_999_801, 1), C: (-1, 0, None, 1), D: (None, None, None, 1)}
    assert [r.id for r in proxy_log.read(spark, str(tmp_path / "x.log"), [12]).collect()] == [B]


def test_calls_of_a_group_and_member(spark, tmp_path):
    def strings(*texts, short=False):
        return [b for t in texts for b in [*([len(t) + 1] if short else [0, len(t)]), *t.encode()]]

    head = [0, 0, 0, 9, 0, 12, 0, 4]
    lines = [line(1, A, "request", head + strings("g1", "m1")), line(2, B, "request", head + strings("g1", "m2", short=True)), line(3, C, "request", head + strings("g11", "m1")), line(4, D, "request", head + [1, 103, 49])]
    (tmp_path / "y.log").write_text("\n".join(lines))

    def found(*texts):
        return sorted(r.id for r in proxy_log.read(spark, str(tmp_path / "y.log"), holding=list(texts)).collect())

    assert (found("g1"), found("m1"), found("g1", "m1"), found("nobody")) == ([A, B], [A, C], [A], [])
