import json

import pytest

from tallyforge.sources import logs


@pytest.fixture
def write(tmp_path):
    def put(name, rows):
        p = tmp_path / name
        p.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
        return f"file://{p}"

    return put


def test_lines_and_quality(spark, write):
    path = write("a.jsonl", ['﻿{"a": 1}', "", "[1]", "{broken", '{"b": 2}'])
    rows = logs.lines(spark, path)
    assert [(r.line, r.ok) for r in logs.objects(rows).orderBy("line").collect()] == [(1, True), (3, False), (4, False), (5, True)]
    q = logs.quality(rows).first()
    assert (q["lines"], q.malformed_rows, q.warning) == (4, 2, "malformed_or_partial_line")


def claude_row(mid, rid, out, **more):
    usage = {"input_tokens": 10, "output_tokens": out, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 2}
    return {"type": "assistant", "sessionId": "s", "timestamp": "2024-01-01T00:00:00.123456Z", "requestId": rid, "message": {"id": mid, "model": "m1", "usage": usage}} | more


def test_claude_identity_is_global_and_counters_are_maxima(spark, write):
    a = write("a.jsonl", [claude_row("1", "r", 3), claude_row("1", "r", 9), claude_row("2", "r2", 4), {"type": "user"}])
    b = write("b.jsonl", [claude_row("1", "r", 7), claude_row("3", "q", True), {"type": "assistant", "message": {"id": "9", "model": "<synthetic>", "usage": {"input_tokens": 1}}}])
    got = logs.claude(logs.lines(spark, a).unionByName(logs.lines(spark, b))).collect()
    assert sorted((r.input_tokens, r.output_tokens) for r in got if r.output_tokens is not None) == [(17, 4), (17, 9)]
    assert len(got) == 3 and {r.model for r in got} == {"m1"}
    assert str(got[0].ts) == "2024-01-01 00:00:00.123000"


def codex_snapshot(i, o, li=None, lo=None):
    usage = lambda x, y: {"input_tokens": x, "cached_input_tokens": 0, "output_tokens": y, "reasoning_output_tokens": 0}
    return {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": usage(i, o), "last_token_usage": usage(li if li is not None else i, lo if lo is not None else o)}, "rate_limits": {"primary": {"used_percent": 40.5, "window_minutes": 300}, "secondary": {"used_percent": 140}}}}


def test_codex_increments(spark, write):
    meta = {"type": "session_meta", "payload": {"id": "own"}}
    path = write("c.jsonl", [codex_snapshot(999, 999), meta, {"type": "turn_context", "payload": {"model": "g1"}}, codex_snapshot(10, 1), codex_snapshot(10, 1), codex_snapshot(25, 4), {"type": "turn_context", "payload": {"model": "g2"}}, codex_snapshot(6, 2, 6, 2), codex_snapshot(5, 1, 50, 1), codex_snapshot(9, 3)])
    got = sorted(((r.input_tokens, r.output_tokens, r.model, r.session_id) for r in logs.codex(logs.lines(spark, path)).collect()))
    assert got == [(4, 2, "g2", "own"), (6, 2, "g2", "own"), (10, 1, "g1", "own"), (15, 3, "g1", "own")]
    q = logs.quotas(logs.lines(spark, path)).collect()
    assert {(r.bucket, r.used_percent, r.window_minutes) for r in q} == {("primary", 40.5, 300)}


def codex_native(response, i, o, thread_i=None, thread_o=None, **more):
    own = {"response_id": response, "usage": {"input_tokens": i, "output_tokens": o}}
    if thread_i is not None:
        own["thread_token_usage"] = {"input_tokens": thread_i, "output_tokens": thread_o}
    return {"type": "token_usage_record", "timestamp": "2024-01-01T00:00:00Z", "payload": own | more}


def codex_rows(rows):
    return sorted((r.session_id, r.model, r.input_tokens, r.output_tokens) for r in rows.collect())


def test_codex_native_records_end_the_snapshots(spark, write):
    """Snapshots beyond what the first native record started from, or after it, are the same usage again."""
    turn = lambda t, m: {"type": "turn_context", "payload": {"turn_id": t, "model": m}}
    path = write("n.jsonl", [{"type": "session_meta", "payload": {"id": "own"}}, turn("a", "g1"), codex_snapshot(10, 1), codex_snapshot(30, 3), codex_native("r1", 20, 2, 30, 3, turn_id="b"), turn("b", "g2"), codex_snapshot(60, 9), codex_native("r2", 7, 1), codex_native("r2", 7, 4), codex_native("r3", 5, 5, thread_id="other"), codex_native(None, 5, 5)])
    assert codex_rows(logs.codex(logs.lines(spark, path))) == [("own", "g1", 10, 1), ("own", "g2", 7, 4), ("own", "g2", 20, 2)]


def test_codex_forks_leave_out_what_they_replay(spark, write):
    parent = write("p.jsonl", [{"type": "session_meta", "payload": {"id": "up"}}, codex_snapshot(10, 1), codex_snapshot(20, 2)])
    fork = write("f.jsonl", [{"type": "session_meta", "payload": {"id": "down", "forked_from_id": "up"}}, codex_snapshot(10, 1), codex_snapshot(20, 2), codex_snapshot(26, 5)])
    inherits = write("i.jsonl", [{"type": "session_meta", "payload": {"id": "up"}}, codex_snapshot(20, 2), {"type": "session_meta", "payload": {"id": "late", "forked_from_id": "gone"}}, codex_snapshot(21, 3, 1, 1)])
    unknown = write("u.jsonl", [{"type": "session_meta", "payload": {"id": "lost", "forked_from_id": "gone"}}, codex_snapshot(50, 5), codex_snapshot(60, 6)])
    rows = logs.lines(spark, [parent, fork, inherits, unknown])
    assert codex_rows(logs.codex(rows)) == [("down", "unknown", 6, 3), ("late", "unknown", 1, 1), ("up", "unknown", 10, 1), ("up", "unknown", 10, 1)]
    assert {(r.session_id, r.parent_session_id) for r in logs.codex_lineage(rows).collect()} == {("up", None), ("down", "up"), ("late", "gone"), ("lost", "gone")}


def test_claude_subagents_are_sessions_with_a_parent(spark, tmp_path):
    folder = tmp_path / "top" / "subagents"
    folder.mkdir(parents=True)
    (folder / "child.jsonl").write_text(json.dumps(claude_row("1", "r", 3)) + "\n" + json.dumps({"type": "assistant", "message": {"model": "m", "usage": {"input_tokens": 1}}}))
    (tmp_path / "top.jsonl").write_text(json.dumps(claude_row("2", "r", 4) | {"sessionId": "top"}))
    rows = logs.lines(spark, [f"file://{folder}/child.jsonl", f"file://{tmp_path}/top.jsonl"])
    assert {(r.session_id, r.output_tokens) for r in logs.claude(rows).collect()} == {("child", 3), ("top", 4)}
    assert {(r.session_id, r.parent_session_id) for r in logs.claude_lineage(rows).collect()} == {("child", "top"), ("top", None)}


def test_copilot_shapes(spark, write):
    path = write("d.jsonl", [{"type": "model.model_call_success", "sessionId": "s", "timestamp": 1700000000, "data": {"modelCall": {"model": "x", "request_id": "1"}, "responseUsage": {"prompt_tokens": 7, "completion_tokens": 2}}}, {"type": "assistant.usage", "sessionId": "s", "data": {"model": "y", "requestId": "2", "inputTokens": 3, "outputTokens": 1, "reasoningTokens": 5}}])
    got = sorted(((r.model, r.input_tokens, r.output_tokens, r.reasoning_tokens) for r in logs.copilot(logs.lines(spark, path)).collect()))
    assert got == [("x", 7, 2, None), ("y", 3, 1, None)]


def test_grok_map_and_list(spark, tmp_path):
    use = {"inputTokens": 5, "outputTokens": 2, "totalTokens": 7}
    (tmp_path / "g.json").write_text(json.dumps({"sessionId": "s", "turns": [{"turnId": "a", "modelUsage": {"m": use, "n": use | {"totalTokens": 9}}}, {"turnId": "b", "modelUsage": [use | {"model": "m"}]}]}))
    got = sorted(((r.model, r.input_tokens, r.output_tokens) for r in logs.grok(spark, f"file://{tmp_path}/g.json").collect()), key=str)
    assert got == [("m", 5, 2), ("m", 5, 2), ("n", None, 2)]


def test_agy_results_win_over_steps(spark, write):
    row = lambda kind, s, i, at=None, **m: {"type": kind, "conversation_id": s, "timestamp": at, "usage": {"input_tokens": i, "output_tokens": 1}} | m
    path = write("e.jsonl", [row("result", "a", 50, "1"), row("result", "a", 150, "2"), row("result", "a", 20, "3"), row("step_update", "a", 7, state="DONE"), row("step_update", "b", 7, state="DONE"), row("step_update", "b", 7, state="OPEN")])
    got = sorted((r.session_id, r.input_tokens) for r in logs.agy(logs.lines(spark, path)).collect())
    assert got == [("a", 20), ("a", 50), ("a", 100), ("b", 7)]
