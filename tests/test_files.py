import json

import pytest

from tracewright.sources import files


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_episodes_and_steps(spark, tmp_path):
    step = {"step": 1, "action": "tap é", "plan": {"name": "mobile_use", "arguments": {"action": "click", "coordinate": [1, 2]}}, "bbox": [], "bbox2": [[1, 2], [3, 4]]}
    write(tmp_path, "app1/e1/task.json", json.dumps({"task": "t", "device": "mobile", "data": [step, step | {"step": 2}]}))
    write(tmp_path, "app1/e1/inner/task.json", json.dumps({"task": "nested", "data": []}))
    write(tmp_path, "app2/e2/task.json", json.dumps({"task": "u", "data": []}))
    e = files.placed(files.episodes(spark, str(tmp_path)))
    assert sorted((r.task, r.folder_app, r.folder_episode) for r in e.collect()) == [("t", "app1", "e1"), ("u", "app2", "e2")]
    s = files.exploded(e).orderBy("pos").collect()
    assert [(r.step, r.action, r.bbox, r.bbox2, r.plan.arguments.coordinate) for r in s] == [(k, "tap é", None, [[1, 2], [3, 4]], [1, 2]) for k in (1, 2)]


def test_logs_results_and_screenshots(spark, tmp_path):
    write(tmp_path, "e/traj.jsonl", '{"step_num": 1, "action": "a"}\n\n{broken\n{"step_num": 2, "action": "b"}\n')
    assert sorted(r.step_num for r in files.json_lines(spark, str(tmp_path)).collect()) == [1, 2]
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path), strict=True).collect()
    write(tmp_path, "m/traj.json", json.dumps({"0": {"traj": [{"step": 1, "prediction": "p"}, {"step": 2, "prediction": "q"}]}, "1": {"traj": []}}))
    assert sorted((r.pos, r.prediction) for r in files.mobile_logs(spark, str(tmp_path)).collect()) == [(0, "p"), (1, "q")]
    write(tmp_path, "r1/result.txt", "1.0\n")
    write(tmp_path, "r2/result.txt", "score: 0.5")
    assert sorted(r.score for r in files.results(spark, str(tmp_path)).collect()) == [0.0, 1.0]
    assert sorted((r.score for r in files.results(spark, str(tmp_path), labelled=True).collect()), key=str) == [0.5, None]
    write(tmp_path, "s/task-1-3.png", "x")
    assert [(r.run, r.step) for r in files.screenshots(spark, str(tmp_path)).collect()] == [(1, 3)]


def test_lists_definitions_annotations_dumps(spark, tmp_path):
    write(tmp_path, "c/tasks.csv", '﻿task_id,original_query\n1,"say ""hi"""\n')
    assert [(r.task_id, r.instruction, r.domain) for r in files.csv_tasks(spark, str(tmp_path / "c")).collect()] == [("1", 'say "hi"', "")]
    write(tmp_path, "d/mail/a.py", "class Send(Base):\n  pass\n")
    write(tmp_path, "d/zoo/b.py", "class Send(Base):\nclass Feed(Base):\n")
    assert sorted(tuple(r) for r in files.app_definitions(spark, str(tmp_path / "d")).collect()) == [("Feed", "zoo"), ("Send", "mail")]
    write(tmp_path, "a/x.json", json.dumps([{"bbox": [1, 2, 3, 4]}]))
    assert files.annotations(spark, str(tmp_path / "a"), form="xywh").first().box == [1.0, 2.0, 4.0, 6.0]
    write(tmp_path, "r/12.jsonl", '{"input": "i", "score": 1.0}\n')
    assert files.rollout_dumps(spark, str(tmp_path / "r")).first().step == 12


def test_state_and_sinks(spark, tmp_path):
    root = str(tmp_path / "state")
    assert files.latest_state(spark, root) is None
    for step in (1, 2):
        files.save_state(spark.createDataFrame([(7, step / 2)], "uid long, ratio double"), root, step)
    assert [tuple(r) for r in files.latest_state(spark, root).collect()] == [(7, 1.0)]
    with pytest.raises(ValueError):
        files.write_splits(spark.range(0), spark.range(3), str(tmp_path / "w"))
    assert files.write_splits(spark.range(3), spark.range(0), str(tmp_path / "w")) == {"train": 3}
    files.write_json(spark.createDataFrame([(1, "é", None)], "e int, t string, n string"), str(tmp_path / "j"), "e")
    assert spark.read.json(str(tmp_path / "j")).first().t == "é"
