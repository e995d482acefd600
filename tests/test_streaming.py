"""Incremental ingest: each file once, also across restarts."""

import json

import bed_project as bed
import pytest
from strataweave.project import Project
from strataweave.streaming.ingest import ingest_stream

pytestmark = pytest.mark.usefixtures("interpreted")


def test_files_come_in_once(spark, tmp_path):
    p = Project(spark, str(tmp_path / "store"), bed.registry(), wrapped=True)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(json.dumps(bed.report(1)))
    (folder / "b.jsonl").write_text(json.dumps(bed.report(2)))
    go = lambda: ingest_stream(p, str(folder), str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    go()
    assert p.store.read("record_index").count() == 2
    cells = p.store.raw("field_artifact").count()
    (folder / "c.jsonl").write_text(json.dumps(bed.report(3)) + "\n" + json.dumps(bed.report(1)))  # one again
    go()
    assert p.store.read("record_index").count() == 3 and p.store.raw("field_artifact").count() == cells * 3 // 2
    p.close()
