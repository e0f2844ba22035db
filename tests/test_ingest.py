"""Sources, tables, ingest laws and streaming."""

import csv
import json
import os
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.operators import embedding
from tidewire.operators.embedding import HashingEncoder, ProjectedEncoder, isolated
from tidewire.operators.increment import presence
from tidewire.operators.normalise import hourly_parsed, known_columns
from tidewire.plans import ingest as jobs
from tidewire.plans.embed import common_vector
from tidewire.schemas import ARTICLE_COLUMNS, LAKE_ARTICLE
from tidewire.sources import readers, splits
from tidewire.sources.tables import Store, load_model, save_model
from tidewire.sources.vector_cache import VectorCache
from tidewire.streaming import jobs as streams

ENCODER = HashingEncoder(16)


def write_csv(path, rows, columns=ARTICLE_COLUMNS):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for row in rows:
            out.writerow([row.get(c.strip(), "") for c in columns])
    return str(path)


def article(i, **more):
    base = {
        "id": str(i), "title": f"Title {i}", "introductory_paragraph": f"<p>Intro {i}</p>",
        "tags": '["A","B"]', "published_time_unix": str(1000 + int(i or 0)),
    }
    return {**base, **more}


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), 16)


def test_csv_reader(spark, tmp_path):
    path = write_csv(
        tmp_path / "a.csv",
        [article(1, title="NA", introductory_paragraph='two\nlines, "quoted"'), article(2, title="")],
        [" id ", "title", "introductory_paragraph", "extra", "published_time_unix"],
    )
    got = rows_of(readers.read_articles(spark, path), "id")
    assert got["1"]["title"] == "NA"
    assert got["1"]["introductory_paragraph"] == 'two\nlines, "quoted"'
    assert got["2"]["title"] is None
    assert got["1"]["tags"] is None
    assert got["1"]["_seq"] < got["2"]["_seq"]
    assert readers.read_articles(spark, path).count() == 2


def test_reader_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="required"):
        readers.read_csv(spark, write_csv(tmp_path / "b.csv", [{}], ["id", "tags"]))
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_articles(spark, "x.txt")
    (tmp_path / "o.json").write_text('{"id": 1}')
    with pytest.raises(ValueError, match="list"):
        readers.read_articles(spark, str(tmp_path / "o.json"))
    empty = readers.read_csv(spark, write_csv(tmp_path / "e.csv", []))
    with pytest.raises(ValueError, match="no rows"):
        readers.require_rows(empty)


def test_json_reader(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": "1", "title": "T", "tags": ["x", "y"], "published_time_unix": 5}]))
    got = readers.read_articles(spark, str(path)).first()
    assert (got["id"], got["published_time_unix"]) == ("1", "5")
    assert json.loads(got["tags"]) == ["x", "y"]


def test_backfill_is_resumable_and_idempotent(spark, store, tmp_path):
    path = write_csv(tmp_path / "a.csv", [article(i) for i in range(5)] + [article("")])
    first = jobs.ingest_backfill(store, path, ENCODER, limit=3)
    assert (first["ingested"], first["remaining"]) == (3, 2)
    assert sorted(rows_of(store.read("articles"), "id")) == ["0", "1", "2"]
    second = jobs.ingest_backfill(store, path, ENCODER, limit=3)
    assert (second["ingested"], second["remaining"]) == (2, 0)
    before = store.runs().count()
    third = jobs.ingest_backfill(store, path, ENCODER, limit=None)
    assert (third["ingested"], third["skipped"], third["total"]) == (0, 6, 6)
    assert store.runs().count() == before
    vectors = rows_of(store.read("vectors"), "article_id")
    assert sorted(vectors) == ["0", "1", "2", "3", "4"]
    assert vectors["3"]["summary"] == "Intro 3"
    assert vectors["3"]["title_vec"] == vectors["3"]["tags_vec"]
    assert jobs.ingest_backfill(store, path, ENCODER, dry_run=True) == {"total": 6}


def test_last_duplicate_wins_and_half_written_is_repaired(spark, store, tmp_path):
    path = write_csv(tmp_path / "a.csv", [article(1), article(2), article(1, title="Newer")])
    jobs.ingest_drop_in(store, path, ENCODER)
    assert rows_of(store.read("articles"), "id")["1"]["title"] == "Newer"
    # A batch that reached only the article table.
    batch, _ = store.claim(store.state())
    lone = spark.createDataFrame([("9",)], "id string")
    full = readers.known_columns(lone)
    from tidewire.operators.normalise import normalise

    store.write("articles", batch, normalise(full))
    store.write("vectors", batch, store.read("vectors").limit(0))
    store.commit(batch, source="half", total=1, ingested=0, mark=0, replaces=False)
    path = write_csv(tmp_path / "b.csv", [article(9, title="Whole"), article(2, title="Changed")])
    run = jobs.ingest_drop_in(store, path, ENCODER)
    assert (run["ingested"], run["skipped"], run["replaces"]) == (1, 1, True)
    held = rows_of(store.read("articles"), "id")
    assert held["9"]["title"] == "Whole" and held["2"]["title"] == "Title 2"
    assert store.read("articles").count() == 3


def test_uncommitted_batch_is_invisible(spark, store, tmp_path):
    path = write_csv(tmp_path / "a.csv", [article(1)])
    jobs.ingest_drop_in(store, path, ENCODER)
    store.write("articles", 99, store.read("articles").withColumn("id", F.lit("ghost")))
    assert [r["id"] for r in store.read("articles").collect()] == ["1"]


def lake(spark, path, rows):
    data = [
        (i, None, f" T{i} ", "i", "d", "", (5, "r"), [("S", [("n", "1", "r", "p")])],
         [("t", "x")], ["A", "B"], "", "", stamp)
        for i, stamp in rows
    ]
    spark.createDataFrame(data, LAKE_ARTICLE).write.mode("append").parquet(path)
    return path


def test_incremental_marks(spark, store, tmp_path):
    path = lake(spark, str(tmp_path / "lake"), [(1, 100), (2, 200)])
    assert jobs.ingest_lake(store, path, ENCODER, dry_run=True) == {"total": 2}
    run = jobs.ingest_lake(store, path, ENCODER)
    assert (run["ingested"], run["mark"]) == (2, 200)
    held = rows_of(store.read("articles"), "id")
    assert held["1"]["title"] == "T1"
    assert held["1"]["economyimpact"] == '{"score":5,"reason":"r"}'
    assert held["1"]["tags"] == '["A","B"]'
    assert rows_of(store.read("vectors"), "article_id")["1"]["tags"] == ["A", "B"]
    # A late row with the same stamp is not lost; nothing else comes twice.
    lake(spark, path, [(3, 200)])
    run = jobs.ingest_lake(store, path, ENCODER)
    assert (run["total"], run["ingested"], run["skipped"]) == (2, 1, 1)
    assert store.mark(f"lake:{path}") == 200
    run = jobs.ingest_lake(store, path, ENCODER)
    assert run["ingested"] == 0
    run = jobs.ingest_lake(store, path, ENCODER, since_days=1, as_of_ms=86_400_050)
    assert (run["total"], run["ingested"]) == (3, 0)


def test_width_is_guarded(spark, store, tmp_path):
    jobs.ingest_drop_in(store, write_csv(tmp_path / "a.csv", [article(1)]), ENCODER)
    with pytest.raises(ValueError, match="width"):
        jobs.ingest_drop_in(
            Store(spark, store.root, 8), write_csv(tmp_path / "b.csv", [article(2)]), HashingEncoder(8)
        )


class NanEncoder(HashingEncoder):
    """Gives no number for the text that says so."""

    def load(self):
        encode = super().load()

        def run(texts):
            out = encode(texts)
            out[["broken" in t for t in texts]] = np.nan
            return out

        return run


def test_invalid_vectors_go_to_quarantine(spark, store, tmp_path):
    path = write_csv(tmp_path / "a.csv", [article(1), article(2, title="broken")])
    run = jobs.ingest_drop_in(store, path, NanEncoder(16))
    assert (run["ingested"], run["errors"]) == (1, 1)
    bad = store.read("quarantine").first()
    assert (bad["id"], bad["reason"]) == ("2", "invalid vector")
    run = jobs.ingest_drop_in(store, path, ENCODER)
    assert run["ingested"] == 1
    assert sorted(rows_of(store.read("vectors"), "article_id")) == ["1", "2"]


def hourly_file(folder, name, articles):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        json.dump({"articles": articles}, f, indent=1)


def hourly_article(i, **fd):
    return {
        "id": str(i), "original_title": f"orig {i}", "published_time": "2026-04-05 10:00:00.000000",
        "formatted_data": {"title": f"t {i}", "descriptive_paragraph": "d", "tags": ["x"], **fd},
    }


def test_hourly_stream_equals_batch_and_restarts(spark, store, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    missing = hourly_article("", title="")
    hourly_file(folder + "/2026/04/05", "et_09.json", [hourly_article(1), missing])
    hourly_file(folder + "/2026/04/05", "et_10.json", [hourly_article(2, economyImpact={"score": 7})])
    hourly_file(folder + "/2026/04/05", "et_11.json", [])
    streams.stream_hourly(store, folder, ENCODER, checkpoint, files_per_batch=1).awaitTermination()
    got = rows_of(store.read("vectors"), "article_id")
    assert sorted(got) == ["1", "2", "2026/04/05/et_09.json-1"]
    assert got["2026/04/05/et_09.json-1"]["title"] == "orig "
    assert got["2"]["economy_impact"] == 7
    assert got["1"]["timestamp"] == 1775383200000
    batch = readers.read_hourly(spark, folder + "/*/*/*")
    whole = rows_of(streams.hourly_vectors(hourly_parsed(batch)[0], ENCODER), "article_id")
    assert {k: r["title_vec"] for k, r in whole.items()} == {k: r["title_vec"] for k, r in got.items()}
    # A restart sees only the new file; an id that comes again is replaced.
    hourly_file(folder + "/2026/04/05", "et_12.json", [hourly_article(1, title="changed")])
    streams.stream_hourly(store, folder, ENCODER, checkpoint).awaitTermination()
    again = rows_of(store.read("vectors"), "article_id")
    assert len(again) == 3 and again["1"]["title"] == "changed"


def test_hourly_rows_are_never_lost(spark, store, tmp_path):
    """Equal names on two days, a new checkpoint on an old folder, and corrections."""
    folder = str(tmp_path / "in")
    for day in ("05", "06"):
        hourly_file(f"{folder}/2026/04/{day}", "et_09.json", [hourly_article("", title=f"day {day}")])
    streams.stream_hourly(store, folder, ENCODER, str(tmp_path / "one")).awaitTermination()
    assert store.read("vectors").count() == 2
    fixed = [hourly_article(7, title="Zulu"), hourly_article(7, title="Alpha")]
    hourly_file(folder + "/2026/04/07", "et_09.json", fixed)
    streams.stream_hourly(store, folder, ENCODER, str(tmp_path / "two")).awaitTermination()
    got = rows_of(store.read("vectors"), "article_id")
    assert len(got) == 3 and got["7"]["title"] == "Alpha"  # the later place in the file


def test_a_bad_article_costs_no_other(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    bad = [5, "text", None, hourly_article(3, tags="x"), hourly_article(4, economyImpact={"score": "high"})]
    hourly_file(folder, "et_01.json", [hourly_article(1), *bad, hourly_article(2)])
    streams.stream_hourly(store, folder, ENCODER, str(tmp_path / "cp")).awaitTermination()
    assert sorted(rows_of(store.read("vectors"), "article_id")) == ["1", "2"]
    held = rows_of(store.read("quarantine"), "id")
    assert sorted(held) == [f"et_01.json-{i}" for i in range(1, 6)]
    assert {r["reason"] for r in held.values()} == {"unreadable article"}


def test_csv_files_go_by_their_own_headers(spark, store, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    write_csv(folder / "a b.csv", [article(1)])
    write_csv(folder / "b.csv", [article(2)], ["published_time_unix", "title", " id "])
    write_csv(folder / "c.csv", [article(3)], ["title", "id", "unknown"])
    write_csv(folder / "d.csv", [article(4)], ["title", "tags"])
    (folder / "e.csv").write_text("")
    streams.stream_csv(store, str(folder), ENCODER, str(tmp_path / "cp")).awaitTermination()
    held = rows_of(store.read("articles"), "id")
    assert {k: r["title"] for k, r in held.items()} == {str(i): f"Title {i}" for i in (1, 2, 3)}
    assert held["2"]["published_time_unix"] == 1002 and held["3"]["published_time_unix"] is None
    refused = store.read("quarantine").collect()
    assert len(refused) == 1 and refused[0]["id"].endswith("d.csv") and "id" in refused[0]["reason"]
    with pytest.raises(ValueError, match="required columns"):
        readers.read_csv(spark, str(folder))
    (folder / "d.csv").unlink()
    assert readers.read_csv(spark, str(folder)).count() == 3


def test_runs_at_the_same_time_do_not_meet(spark, store, tmp_path):
    empty = store.state()
    first, alone = store.claim(empty)
    second, others = store.claim(empty)
    assert (first, alone, second, others) == (0, False, 1, True)
    rows = store.read("articles")
    jobs.ingest_drop_in(store, write_csv(tmp_path / "a.csv", [article(1)]), ENCODER)
    state = store.state()
    assert state.last == 2 and state.open == (0, 1) and state.replaces
    # What an open run has written is not seen, and what it commits later is.
    store.write("articles", first, rows)
    store.write("vectors", first, store.read("vectors"))
    assert store.read("vectors").count() == 1
    store.commit(first, source="late", total=1, ingested=1, mark=0, replaces=False)
    assert store.state().open == (1,)
    assert store.read("articles").count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.commit(first, source="again", total=0, ingested=0, mark=0, replaces=False)


def test_stream_keeps_on_at_an_interval(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    hourly_file(folder, "et_01.json", [hourly_article(1)])
    query = streams.stream_hourly(store, folder, ENCODER, str(tmp_path / "cp"), every="1 second")
    try:
        query.processAllAvailable()
        hourly_file(folder, "et_02.json", [hourly_article(2)])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(rows_of(store.read("vectors"), "article_id")) == ["1", "2"]


def test_unreadable_file_is_quarantined_or_skipped(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    hourly_file(folder, "et_01.json", [hourly_article(1)])
    with open(folder + "/et_02.json", "w") as f:
        f.write('{"articles": [{"id": ')
    streams.stream_hourly(store, folder, ENCODER, str(tmp_path / "cp")).awaitTermination()
    assert sorted(rows_of(store.read("vectors"), "article_id")) == ["1"]
    bad = store.read("quarantine").first()
    assert (bad["id"], bad["reason"]) == ("et_02.json", "unreadable record")


def test_csv_stream_reports_runs(spark, store, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    write_csv(folder / "a.csv", [article(1), article(2)])
    write_csv(folder / "b.csv", [article(2), article(3)])
    query = streams.stream_csv(store, str(folder), ENCODER, str(tmp_path / "cp"), files_per_batch=1)
    query.awaitTermination()
    runs = store.runs().agg(F.sum("ingested"), F.sum("skipped"), F.sum("total")).first()
    assert tuple(runs) == (3, 1, 4)
    assert sorted(rows_of(store.read("articles"), "id")) == ["1", "2", "3"]


def test_hour_file(spark):
    from datetime import datetime

    assert readers.hour_file(spark, "/r/", datetime(2026, 4, 18, 3, 40)) == "/r/2026/04/18/et_09.json"


def test_model_versions(spark, tmp_path):
    root = str(tmp_path / "m")
    assert load_model(spark, root) is None
    save_model(spark, root, "20260101_000000", {"w0": np.ones((2, 4))})
    save_model(spark, root, "20260201_000000", {"w0": np.zeros((2, 4))})
    assert load_model(spark, root)["w0"].sum() == 0
    other = root + "-numbers"
    for version in ("9", "10"):
        save_model(spark, other, version, {"w0": np.full((1, 1), int(version))})
    assert load_model(spark, other)["w0"].sum() == 10
    with pytest.raises(ValueError):
        save_model(spark, other, "latest", {"w0": np.ones((1, 1))})
    with pytest.raises(ValueError, match="width"):
        load_model(spark, root, width=3)


class FailingEncoder(HashingEncoder):
    """Raises on any batch that holds a text that says so."""

    def load(self):
        encode = super().load()

        def run(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("cannot encode")
            return encode(texts)

        return run


def _lost(store):
    """Ids in the vector table, and in quarantine."""
    return sorted(rows_of(store.read("vectors"), "article_id")), sorted(rows_of(store.read("quarantine"), "id"))


def test_a_failing_text_costs_its_own_article(spark, tmp_path):
    """In all five jobs."""
    failing, good = FailingEncoder(16), [str(i) for i in range(12) if i != 5]
    path = write_csv(tmp_path / "a.csv", [article(i, title="poison" if i == 5 else f"T {i}") for i in range(12)])
    for n, job in enumerate((jobs.ingest_backfill, jobs.ingest_drop_in)):
        store = Store(spark, str(tmp_path / f"s{n}"), 16)
        run = job(store, path, failing)
        assert (run["total"], run["ingested"], run["errors"], run["skipped"]) == (12, 11, 1, 0)
        assert _lost(store) == (sorted(good), ["5"])
        assert sorted(rows_of(store.read("articles"), "id")) == sorted(good)
        again = job(store, path, ENCODER)  # an encoder that has recovered
        assert (again["ingested"], again["errors"], again["skipped"]) == (1, 0, 11)
        assert not again["replaces"]
    lake_path = str(tmp_path / "lake")
    lake(spark, lake_path, [(i, 100 + i) for i in range(5)])
    rows = spark.read.parquet(lake_path).withColumn("title", F.when(F.col("id") == 3, "poison").otherwise(F.col("title")))
    rows.write.parquet(lake_path + "-odd")
    store = Store(spark, str(tmp_path / "s2"), 16)
    assert jobs.ingest_lake(store, lake_path + "-odd", failing)["errors"] == 1
    assert _lost(store) == (["0", "1", "2", "4"], ["3"])
    folder = str(tmp_path / "hours")
    hourly_file(folder, "et_01.json", [hourly_article(i, title="poison" if i == 2 else f"t {i}") for i in range(6)])
    store = Store(spark, str(tmp_path / "s3"), 16)
    streams.stream_hourly(store, folder, failing, str(tmp_path / "c3")).awaitTermination()
    assert _lost(store) == (["0", "1", "3", "4", "5"], ["2"])
    (tmp_path / "drop").mkdir()
    os.rename(path, tmp_path / "drop" / "a.csv")
    store = Store(spark, str(tmp_path / "s4"), 16)
    streams.stream_csv(store, str(tmp_path / "drop"), failing, str(tmp_path / "c4")).awaitTermination()
    assert _lost(store) == (sorted(good), ["5"])


def test_isolation_halves_batches():
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if "x" in texts:
            raise ValueError
        return np.full((len(texts), 2), 7.0)

    out, made = isolated(encode, ["a"] * 300 + ["x"] + ["a"] * 211, 2)
    assert not made[300] and made.sum() == 511 and (out[made] == 7).all() and not out[300].any()
    assert len(calls) <= 2 * 9 + 1
    assert isolated(encode, [], 2)[0].shape == (0, 2)


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def test_compaction(spark, store, tmp_path):
    for n in range(4):
        jobs.ingest_drop_in(store, write_csv(tmp_path / f"{n}.csv", [article(i) for i in range(3 * n, 3 * n + 3)]), ENCODER)
    batch, _ = store.claim(store.state())  # half of article 4 once more, so that a read must look for replaced ids
    store.write("articles", batch, store.read("articles").where("id = '4'").withColumn("title", F.lit("Newer")))
    store.write("vectors", batch, store.read("vectors").limit(0))
    store.commit(batch, source="x", total=1, ingested=0, mark=0, replaces=True)
    before = {t: sorted(map(repr, store.read(t).collect())) for t in ("articles", "vectors")}
    began = store.state()
    assert began.replaces and store.compact() == 4
    after = store.state()
    assert (after.base, after.last, after.replaces) == (4, 4, False)
    for table, rows in before.items():
        assert sorted(map(repr, store.read(table, began).collect())) == rows  # a reader that had begun
        assert sorted(map(repr, store.read(table).collect())) == rows
        assert not _exchanges(store.read(table))
    store.vacuum()
    assert store.compact() is None
    run = jobs.ingest_drop_in(store, write_csv(tmp_path / "z.csv", [article(1), article(99)]), ENCODER)
    assert (run["ingested"], run["skipped"], run["replaces"]) == (1, 1, False)
    assert store.read("articles").count() == 13 and rows_of(store.read("articles"), "id")["4"]["title"] == "Newer"
    assert store.compact() == 5 and store.read("vectors").count() == 13
    assert store.mark("x") == 0 and store.runs().count() == 6


def test_claims_end_with_their_lease(spark, store, tmp_path):
    dead, _ = store.claim(store.state())
    jobs.ingest_drop_in(store, write_csv(tmp_path / "a.csv", [article(1)]), ENCODER)
    assert store.state().open == (dead,)
    store.write("articles", dead, store.read("articles").withColumn("id", F.lit("ghost")))
    assert store.compact() is None  # nothing below the open number
    short = Store(spark, store.root, 16, lease_ms=-1)
    state = short.begin()
    assert state.open == () and [r["id"] for r in store.read("articles").collect()] == ["1"]
    with pytest.raises(RuntimeError, match="ended"):
        store.commit(dead, source="late", total=1, ingested=1, mark=0, replaces=False)
    run = jobs.ingest_drop_in(store, write_csv(tmp_path / "b.csv", [article(2)]), ENCODER)
    assert not run["replaces"] and store.compact() == 2
    assert sorted(rows_of(store.read("articles"), "id")) == ["1", "2"]


def test_another_projection_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 8)
    encoder = ProjectedEncoder(HashingEncoder(16), 8, seed=3)
    jobs.ingest_drop_in(store, write_csv(tmp_path / "a.csv", [article(1)]), encoder)
    path = write_csv(tmp_path / "b.csv", [article(2)])
    for other in (ProjectedEncoder(HashingEncoder(16), 8, seed=4), HashingEncoder(8), ProjectedEncoder(HashingEncoder(32), 8, seed=3)):
        with pytest.raises(ValueError, match="vectors of"):
            jobs.ingest_drop_in(store, path, other)
    jobs.ingest_drop_in(store, path, encoder)
    kept = store.bind(encoder)
    assert kept.kept is not None and np.array_equal(kept.matrix, encoder.matrix)
    want = kept.load()(["Title 2. Intro 2"])
    assert np.array_equal(want, encoder.load()(["Title 2. Intro 2"]))
    assert rows_of(store.read("vectors"), "article_id")["2"]["title_vec"] == want[0].tolist()


class SlowEncoder(HashingEncoder):
    def load(self):
        encode = super().load()

        def run(texts):
            time.sleep(0.4 * len(texts))
            return encode(texts)

        return run


def test_progress_can_be_polled_while_a_run_goes_on(spark, store, tmp_path):
    rows = spark.createDataFrame([article(i) for i in range(16)]).repartition(16).withColumn("_seq", F.col("id").cast("long"))
    worker = threading.Thread(
        target=lambda: jobs.ingest(store, readers.known_columns(rows), SlowEncoder(16), "slow", common_vector, every=0.2)
    )
    worker.start()
    polled = []
    while worker.is_alive():
        done = [r["done"] for r in store.progress().where("phase = 'encoding'").collect()]
        polled.append(max(done, default=-1))
        time.sleep(0.2)
    worker.join()
    between = {n for n in polled if 0 < n < 16}
    assert between and polled == sorted(polled)
    last = store.progress().orderBy(F.desc("at_ms")).first()
    assert (last["phase"], last["total"], last["done"], last["remaining"]) == ("done", 16, 16, 0)
    assert store.runs().first()["remaining"] == 0


def test_presence_moves_no_bodies(spark, store, tmp_path):
    """What meets the tables' ids is ids, order and row numbers."""
    jobs.ingest_drop_in(store, write_csv(tmp_path / "a.csv", [article(1)]), ENCODER)
    state = store.state()
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    plan = presence(F.broadcast(ids), store.read("articles", state), store.read("vectors", state))
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in text.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and not any("title" in x.split("ReadSchema")[1] or "vec" in x.split("ReadSchema")[1] for x in scans)
    assert [tuple(r) for r in plan.collect()] == [("1", True, True)]


class NeverEncoder(HashingEncoder):
    """Stands for an encoder that must not be asked."""

    def load(self):
        def run(texts):
            raise AssertionError(texts)

        return run


def test_a_second_store_encodes_nothing(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"))
    rows = [article(i, title="Same" if i % 3 == 0 else f"T {i}", introductory_paragraph="") for i in range(12)]
    path = write_csv(tmp_path / "a.csv", rows)
    folder = str(tmp_path / "hours")
    hourly_file(folder, "et_01.json", [hourly_article(i, title=f"T {i}", descriptive_paragraph=None) for i in range(6)])
    first, plain = Store(spark, str(tmp_path / "one"), 16), Store(spark, str(tmp_path / "plain"), 16)
    jobs.ingest_drop_in(first, path, ENCODER, cache=cache)
    jobs.ingest_drop_in(plain, path, ENCODER)
    assert cache.read(ENCODER).count() == 9  # eight titles and the common one
    vectors = {k: r["title_vec"] for k, r in rows_of(first.read("vectors"), "article_id").items()}
    assert vectors == {k: r["title_vec"] for k, r in rows_of(plain.read("vectors"), "article_id").items()}
    second = Store(spark, str(tmp_path / "two"), 16)
    assert jobs.ingest_drop_in(second, path, NeverEncoder(16), cache=cache)["ingested"] == 12
    assert vectors == {k: r["title_vec"] for k, r in rows_of(second.read("vectors"), "article_id").items()}
    for n, encoder in enumerate((ENCODER, NeverEncoder(16))):  # the hourly stream, twice
        hourly = Store(spark, str(tmp_path / f"h{n}"), 16)
        streams.stream_hourly(hourly, folder, encoder, str(tmp_path / f"c{n}"), cache=cache).awaitTermination()
        assert hourly.read("vectors").count() == 6 and hourly.read("quarantine").count() == 0
    assert cache.read(HashingEncoder(8)).count() == 0


def test_long_texts_reach_the_encoder_in_portions(monkeypatch):
    monkeypatch.setattr(embedding, "ENCODED_CHARS", 100)
    monkeypatch.setattr(embedding, "REMEMBERED_WORDS", 8)
    texts = [f"w{i} " * (i % 7) for i in range(60)] + [None, "x" * 500, ""]
    sizes = []
    encode = HashingEncoder(8).load()

    def told(some):
        sizes.append(sum(map(len, some)) - max(map(len, some), default=0))  # a longer text comes alone
        return encode(some)

    got = embedding._encoded(pa.array(texts), told, 8).to_pylist()
    whole = HashingEncoder(8).load()
    assert got == [None if t is None else whole([t])[0].tolist() for t in texts]
    assert len(sizes) > 5 and max(sizes) <= 100
    assert embedding._encoded(pa.array([], pa.string()), told, 8).to_pylist() == []


def test_rows_of_a_split_are_unpacked_in_slices():
    class Batch:
        def __init__(self, rows, taken):
            self.rows, self.taken, self.num_rows = rows, taken, rows.num_rows

        def slice(self, at, n):
            self.taken.append(n)
            return self.rows.slice(at, n)

    n, taken = 1000, []
    rows = pa.RecordBatch.from_pydict({"file": ["f"] * n, "block": [i // 400 for i in range(n)], "value": [str(i) for i in range(n)]})
    found = [(key, list(values)) for key, values in splits._by_chunk(iter([Batch(rows, taken)]))]
    assert [k for k, _ in found] == [("f", 0), ("f", 1), ("f", 2)]
    assert [v for _, values in found for v in values] == [str(i) for i in range(n)]
    assert max(taken) < n


def test_ingest_sends_python_small_batches(spark, tmp_path):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)

    def vectorise(rows, encoder, **more):
        seen.append(int(spark.conf.get(name)))
        return common_vector(rows, encoder, **more)

    raw = spark.createDataFrame([("1", "t", "text")], "id string, title string, introductory_paragraph string")
    raw = known_columns(raw.withColumn("_seq", F.lit(1)))
    store = Store(spark, str(tmp_path / "small"), 8)
    assert jobs.ingest(store, raw, HashingEncoder(8), "small", vectorise)["ingested"] == 1
    assert seen == [jobs.PYTHON_BYTES] and spark.conf.get(name) == before


def test_hourly_files_are_opened_once(spark, tmp_path, monkeypatch):
    """What a batch lists, and what it refuses, come from rows kept before the vectors are made."""
    folder = tmp_path / "hourly"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"articles": [{"id": "1", "formatted_data": {"title": "t"}}, 5]}))
    made = streams.hourly_vectors

    def gone(*plan):
        (folder / "a.json").unlink()
        return made(*plan)

    monkeypatch.setattr(streams, "hourly_vectors", gone)
    store = Store(spark, str(tmp_path / "store"), 16)
    streams.stream_hourly(store, str(folder), ENCODER, str(tmp_path / "checkpoint")).awaitTermination()
    assert [r["article_id"] for r in store.read("vectors").collect()] == ["1"]
    assert [r["reason"] for r in store.read("quarantine").collect()] == ["unreadable article"]
