"""Listings, changes, sidecars, projects and configuration, on files written here."""

import json

from pyspark.sql import functions as F

from ledgerloom.sources import discovery


def test_listing_and_changes(spark, tmp_path):
    for name, text in (("a.jsonl", "x\n"), ("b/c.jsonl", "yy\n"), ("b/d.txt", "z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = discovery.log_files(spark, str(tmp_path))
    first, gate = files.collect(), discovery.change_gate(files)
    assert len(first) == 2 and discovery.change_gate(files) == gate and gate.startswith("2:5:")
    before = spark.createDataFrame(first, files.schema).union(files.limit(1).withColumn("path", F.lit("file:/gone")))
    (tmp_path / "a.jsonl").write_text("x\nmore\n")
    (tmp_path / "b/c.jsonl").write_text("y")
    (tmp_path / "b/e.jsonl").write_text("new\n")
    now = discovery.log_files(spark, str(tmp_path))
    assert discovery.change_gate(now) != gate
    got = {r["path"].rsplit("/", 1)[1]: (r["state"], r["offset"]) for r in discovery.changes(now, before).collect()}
    assert got == {"a.jsonl": ("grown", 2), "c.jsonl": ("rotated", 0), "e.jsonl": ("new", 0), "gone": ("gone", 0)}


def test_sidecars(spark, tmp_path):
    folder = tmp_path / "s-1/subagents"
    folder.mkdir(parents=True)
    (folder / "agent-x.jsonl").write_text("{}\n")
    (folder / "agent-y.jsonl").write_text("{}\n")
    (folder / "agent-x.meta.json").write_text(json.dumps({"toolUseId": "t"}))
    got = {r["agent_id"]: (r["session_id"], r["meta"]) for r in discovery.sidecars(spark, str(tmp_path)).collect()}
    assert got == {"x": ("s-1", '{"toolUseId": "t"}'), "y": ("s-1", None)}


def test_projects_and_configuration(spark, tmp_path):
    main, tree = tmp_path / "main", tmp_path / "tree/sub"
    (main / ".git/worktrees/w").mkdir(parents=True)
    tree.mkdir(parents=True)
    (main / ".git/config").write_text('[core]\nx = 1\n[remote "up"]\n url = https://h/x/y\n[remote "origin"]\n\turl = git@Host.com:o/p.git\n')
    (main / ".git/worktrees/w/commondir").write_text("../..\n")
    (tmp_path / "tree/.git").write_text(f"gitdir: {main}/.git/worktrees/w\n")
    got = {r["project"]: r["project_key"] for r in discovery.project_keys(spark, [str(main), str(tree), "/"]).collect()}
    assert got[str(main)] == got[str(tree)] == "host.com/o/p" and got["/"] == "/"
    path = tmp_path / "config.json"
    assert discovery.config(str(path), {}, "X_") == {"content": "full", "retention_days": 90.0}
    path.write_text(json.dumps({"content": {"store": "off", "retentionDays": "forever"}}))
    assert discovery.config(str(path), {}, "X_") == {"content": "off", "retention_days": float("inf")}
    assert discovery.config(str(path), {"X_CONTENT_STORE": "hash-only", "X_CONTENT_TTL_DAYS": "0.5"}, "X_") == {"content": "hash-only", "retention_days": 0.5}
