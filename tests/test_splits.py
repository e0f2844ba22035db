"""Reading records that span lines, and lists of one line, in small splits."""

import csv
import io
import json
import random

import pytest

from tidewire.schemas import ARTICLE_COLUMNS
from tidewire.sources import readers, splits


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield of
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def _texts(rng, n):
    parts = ['"', "\n", ",", "word", " ", '""', "\n\n", "é漢", "'", "x" * 40, "\\", "{", "}", "[", "]", ":", "\t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def _rows(df):
    got = df.select(*ARTICLE_COLUMNS, readers.CORRUPT, "_seq").collect()
    return [tuple(r)[:-1] for r in sorted(got, key=lambda r: tuple(r["_seq"]))]


@pytest.mark.parametrize("size", [97, 700, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_splits_equals_multi_line(spark, small_splits, tmp_path, size, end):
    rng = random.Random(size)
    path = str(tmp_path / "a.csv")
    names = ["id", "title", "introductory_paragraph", "extra", "tags"]
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(names)
        for i in range(60):
            title, intro, extra, tags = _texts(rng, 4)
            out.writerow([i, title, intro, extra, tags])
    small_splits(size)
    got = _rows(readers.read_csv(spark, path))
    small_splits(1 << 27)
    reader = spark.read.options(**readers.CSV_OPTIONS).option("multiLine", "true")
    schema = ", ".join(f"{c} string" for c in [*names, readers.CORRUPT])
    want = [r.asDict() for r in reader.schema(schema).csv(path).collect()]
    assert [r[0] for r in got] == [str(i) for i in range(60)]
    for mine, theirs in zip(got, want, strict=True):
        mine = dict(zip([*ARTICLE_COLUMNS, readers.CORRUPT], mine, strict=True))
        for c in ("id", "title", "introductory_paragraph", "tags"):
            assert mine[c] == theirs[c], c


def test_csv_uses_all_splits(spark, small_splits, tmp_path):
    path = str(tmp_path / "a.csv")
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(["id", "title"])
    for i in range(400):
        w.writerow([i, f"line one of {i}\nline two"])
    (tmp_path / "a.csv").write_text(out.getvalue())
    small_splits(1000)
    lines = splits.pieces_of(spark, path, "\n")
    assert lines.rdd.getNumPartitions() >= 8
    cut = splits.csv_splits(lines)
    assert cut.count() == lines.rdd.getNumPartitions() and cut.where("inside").count() > 0
    assert readers.read_csv(spark, path).where("title like '%\n%'").count() == 400


@pytest.mark.parametrize("size", [61, 500, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_list_in_splits(spark, small_splits, tmp_path, size, indent):
    rng = random.Random(size)
    rows = []
    for i in range(50):
        title, intro, deep = _texts(rng, 3)
        rows.append({
            "id": str(i), "title": title, "introductory_paragraph": intro, "unknown": {"a": [{"b": deep}, [1, "}]"]]},
            "tags": ["x", deep], "published_time_unix": i,
        })
    (tmp_path / "a.json").write_text("﻿" * (size == 500) + json.dumps(rows, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    small_splits(size)
    got = _rows(readers.read_json(spark, str(tmp_path / "a.json")))
    assert len(got) == 50
    for mine, theirs in zip(got, rows, strict=True):
        mine = dict(zip([*ARTICLE_COLUMNS, readers.CORRUPT], mine, strict=True))
        assert mine[readers.CORRUPT] is None
        for c in ("id", "title", "introductory_paragraph"):
            assert mine[c] == theirs[c]
        assert json.loads(mine["tags"]) == theirs["tags"] and mine["published_time_unix"] == str(theirs["published_time_unix"])


def test_json_oddities(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [ {"id": "1"}, 5, "text", {"id": "2", "title": "}{"}, {"id": "3", "ti')
    got = _rows(readers.read_json(spark, str(tmp_path / "a.json")))
    assert [r[0] for r in got if r[-1] is None] == ["1", "2"]
    assert len([r for r in got if r[-1] is not None]) == 2  # what is no object, and the one cut short
    (tmp_path / "b.json").write_text("[]")
    assert readers.read_json(spark, str(tmp_path / "b.json")).count() == 0
    (tmp_path / "c.json").write_text('\n {"id": 1}')
    with pytest.raises(ValueError, match="list"):
        readers.read_json(spark, str(tmp_path / "c.json"))
