"""Finding F1 of round 4: what an import keeps of its parsed lines between the passes over them."""

import json

import pytest

from factloom.errors import ImportRejected
from factloom.memory import Memory
from factloom.sources import jsonl

KEY = {"n": "integer"}


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")


@pytest.fixture
def kept(monkeypatch):
    """How each import's parsed lines are kept while it runs."""
    out, run = [], jsonl._import

    def seen(memory, entity_type, rows, *more):
        out.append((rows, rows.storageLevel))
        return run(memory, entity_type, rows, *more)

    monkeypatch.setattr(jsonl, "_import", seen)
    return out


def test_parsed_lines_lie_on_disk_alone(spark, kept, monkeypatch):
    """Before, they were cached in memory first, and filled the executors' heap."""
    monkeypatch.setattr(jsonl, "TASK_LINES", 7)
    m = Memory(spark, "kept")
    got = [jsonl.import_jsonl(m, "a.S", lines(spark, rows), KEY)["created"] for rows in ([{"n": i, "k": f"k{i}"} for i in range(30)], [{"n": i, "k": f"x{i}"} for i in range(25, 32)])]
    assert got == [30, 2]
    assert sorted((int(r["i_n"]), r["v_k"]) for r in m.entity("a.S").df.collect()) == [(i, f"{'x' if i > 24 else 'k'}{i}") for i in range(32)]
    with pytest.raises(ImportRejected):
        jsonl.import_jsonl(m, "a.S", lines(spark, [{"n": 1, "k": "a"}, {"n": 1, "k": "b"}]), KEY)
    assert len(kept) == 3
    for rows, level in kept:
        assert level.useDisk and not level.useMemory
        assert not rows.storageLevel.useDisk  # nothing is kept once the import has ended
