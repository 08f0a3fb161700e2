"""Logs of assistants, and what calls do."""

import json

import pytest

from strideq import Corpus, CorpusSpec, Engine
from strideq.__main__ import main
from strideq.errors import CorpusError
from strideq.sources.calls import describe, simple_commands
from strideq.sources.logs import read_logs


@pytest.mark.parametrize(
    "script,want",
    [
        ("cd x && sudo -u me rm -rf build", ("rm", "destructive", None)),
        ("FOO=1 env -u X python a.py | grep y", ("python", "exec", None)),
        ("curl -s https://u@Api.Site.org:80/x", ("curl", "network", "api.site.org")),
        ("git -C /r push --force", ("git", "destructive", None)),
        ("git reset --soft HEAD", ("git", "exec", None)),
        ("for f in *; do mv $f y; done", ("mv", "exec", None)),
        ("cat <<EOF > f\nrm -rf /\nEOF\nls # rm -rf /", ("cat", "exec", None)),
        ("echo 'open", ("echo", "exec", None)),
        ("echo it's done && rm -rf x", ("echo", "destructive", None)),
        ('echo "$(rm -rf x; (ls))" `rm -r y`; ls', ("echo", "exec", None)),
        ("cat <<A <<B\nx\nA\ny\nB\nwget http://h/x", ("cat", "network", "h")),
        ("rm -- -r", ("rm", "exec", None)),
        ("git push origin +main", ("git", "destructive", None)),
        ("psql -c 'DROP TABLE x'", ("psql", "destructive", None)),
    ],
)
def test_shell(script, want):
    d = describe("Bash", {"command": script})
    assert (d["cmd"], d["action"], d["host"]) == want


def test_calls():
    assert describe("Read", {"file_path": "/a"}) == {"cmd": None, "path": "/a", "host": None, "action": "read"}
    assert describe("apply_patch", "*** Begin\n*** Add File: src/x.py\n")["path"] == "src/x.py"
    assert describe("exec_command", '{"cmd": ["bash", "-lc", "ls -l"]}')["cmd"] == "ls"
    assert describe("WebFetch", {"url": "https://a.b/c"})["host"] == "a.b"
    assert simple_commands("a; b && c") == [["a"], ["b"], ["c"]]


def _write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in records) + '\n{"cut', encoding="utf-8")


def test_transcript(spark, tmp_path):
    at = "2026-01-01T00:00:%02dZ"
    records = [
        {"type": "user", "timestamp": at % 1, "sessionId": "s", "uuid": "u1", "message": {"content": "please run it"}},
        {"type": "summary", "text": "x"},
        {"type": "assistant", "timestamp": at % 2, "sessionId": "s", "message": {"model": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "pytest -q"}}]}},
        {"type": "user", "timestamp": at % 7, "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": [{"type": "text", "text": "failed"}]}]}},
        {"type": "user", "timestamp": at % 8, "sessionId": "s", "isMeta": True, "message": {"content": "note"}},
    ]
    _write(tmp_path / "proj" / "one.jsonl", records)
    df = read_logs(spark, str(tmp_path / "proj"), "transcript")
    rows = df.orderBy("position").collect()
    assert [r["kind"] for r in rows] == ["prompt", "thinking", "tool_use", "tool_result", "injected"]
    use = rows[2]
    assert (use["cmd"], use["outcome"], use["duration_ms"], use["duration_bucket"], use["output_bucket"], use["project"]) == ("pytest", "error", 5000, "short", "small", "proj")
    e = Engine(Corpus(df, CorpusSpec(time="time")))
    assert e.execute("field(cmd,pytest) and field(outcome,error) and field(session,$s) ~> field(kind,injected) and field(session,$s) |> during(1m)").groups == [["one:3:1", "one:5:0"]]
    _write(tmp_path / "bad" / "x.jsonl", [{"type": "user", "timestamp": at % 1, "message": {"content": [{"type": "odd"}]}}])
    with pytest.raises(Exception, match="unknown content"):
        read_logs(spark, str(tmp_path / "bad"), "transcript")
    with pytest.raises(CorpusError):
        read_logs(spark, str(tmp_path), "other")


def test_rollout_by_command_line(spark, tmp_path, capsys):
    at = "2026-01-01T00:00:%02dZ"
    item = lambda s, **p: {"type": "response_item", "timestamp": at % s, "payload": p}
    records = [
        {"type": "session_meta", "timestamp": at % 0, "payload": {"id": "abc", "cwd": "/home/u/proj"}},
        {"type": "turn_context", "timestamp": at % 0, "payload": {"model": "m1"}},
        item(1, type="message", role="user", content=[{"type": "input_text", "text": "go"}]),
        item(2, type="function_call", name="exec_command", arguments='{"cmd": "pytest"}', call_id="c"),
        item(4, type="function_call_output", call_id="c", output="Chunk ID: 1\nProcess exited with code 1\nOutput"),
        item(5, type="reasoning", summary=[{"text": "why"}]),
    ]
    _write(tmp_path / "in" / "rollout-1.jsonl", records)
    main(["ingest", "rollout", str(tmp_path / "in"), str(tmp_path / "out.parquet")], spark)
    assert json.loads(capsys.readouterr().out)["rows"] == 4
    main(["query", str(tmp_path / "out.parquet"), "field(kind,tool_use) and field(outcome,error) ~> field(kind,thinking) |> within(5)"], spark)
    assert json.loads(capsys.readouterr().out) == ["rollout-1:4", "rollout-1:6"]
