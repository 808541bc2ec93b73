import json

import pytest

from kiln.sources import readers


def files(folder, *contents):
    folder.mkdir()
    for i, x in enumerate(contents):
        (folder / f"part-{i}.jsonl").write_text(x)
    return str(folder)


def test_line_numbers_of_one_file_in_many_splits(spark, tmp_path):
    lines = [json.dumps({"title": "x" * (i % 50), "content": str(i)}) if i % 7 else "" for i in range(3000)]
    path = files(tmp_path / "one", "\n".join(lines) + "\n")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    got = readers.read_jsonl(session, path)
    assert readers.numbered_lines(session, path).rdd.getNumPartitions() > 8
    assert sorted((r.line, r.id, r.content) for r in got.collect()) == [(i, f"wh_{i}", str(i)) for i in range(3000) if i % 7]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Scan ExistingRDD" not in plan


def test_line_numbers_go_on_over_files(spark, tmp_path):
    path = files(tmp_path / "more", '{"id": "a"}\n\n{"url": "u"}\n', '{"title": "t"}', '{"id": null}\n')
    got = sorted(((r.line, r.id) for r in readers.read_jsonl(spark, path).collect()))
    assert got == [(0, "a"), (2, "u"), (3, "wh_3"), (4, None)]


def test_empty_and_malformed(spark, tmp_path):
    assert readers.read_jsonl(spark, files(tmp_path / "empty", "", "\n\n")).collect() == []
    with pytest.raises(Exception):
        readers.read_jsonl(spark, files(tmp_path / "bad", '{"id": 1\n')).collect()
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl(spark, str(tmp_path / "none"))
