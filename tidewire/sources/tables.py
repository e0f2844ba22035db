"""The article table, the vector table, and the runs that tie them together.

Every run claims a batch number that no other run has, appends one batch folder to
each table and then one row to ``runs``. Readers see only batches that have such a row,
so both tables and the mark move together, a run that dies leaves nothing visible, runs
at the same time do not meet, and no run rewrites old data.

A claim is a lease: a run that has neither committed nor released its number in time
loses it, and can no longer commit. Compaction writes one base of all batches up to a
number below which nothing is open; readers then take the base and what came after.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.vectors import is_valid_vector
from tidewire.operators.embedding import Encoder, fingerprint
from tidewire.operators.increment import keep_last
from tidewire.operators.skew import sized
from tidewire.schemas import ARTICLE, VECTOR_COLUMNS, VECTORS
from tidewire.session import materialise

RUN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("ingested", T.LongType()),
        T.StructField("skipped", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("mark", T.LongType()),
        T.StructField("replaces", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("remaining", T.LongType()),
    ]
)
PROGRESS = T.StructType(
    [
        T.StructField("at_ms", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("done", T.LongType()),
        T.StructField("remaining", T.LongType()),
    ]
)
#: Milliseconds after which a claim that is not committed ends.
LEASE_MS = 24 * 3600 * 1000
QUARANTINE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("record", T.StringType()),
    ]
)
_KEYS = {"articles": "id", "vectors": "article_id", "quarantine": None}
_SCHEMAS = {"articles": ARTICLE, "vectors": VECTORS, "quarantine": QUARANTINE, "runs": RUN}


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass(frozen=True)
class State:
    """The committed runs, summed up.

    The mark is that of one source, the epoch that of one streaming query: another
    query over the same folder, with a checkpoint of its own, counts anew. ``open`` are
    the numbers below the last one that dead or running runs hold. All batches up to
    ``base`` are in the base of that number.
    """

    last: int | None
    replaces: bool
    mark: int
    epoch: int | None
    open: tuple[int, ...] = ()
    base: int | None = None

    def has_epoch(self, epoch: int | None) -> bool:
        """Epochs of a stream rise, so one up to the highest is done."""
        return epoch is not None and self.epoch is not None and epoch <= self.epoch


@dataclass(frozen=True)
class Store:
    """The tables below one folder, with one vector width."""

    spark: SparkSession
    root: str
    width: int
    lease_ms: int = LEASE_MS

    def _path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _raw(self, table: str) -> DataFrame | None:
        """All batches of a table with their number; None before the first."""
        schema = T.StructType([*_SCHEMAS[table].fields, T.StructField("batch", T.LongType())])
        return read_if_there(self.spark, self._path(table), schema)

    def _file(self, name: str):
        """The file system and the path of a name below the root."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _create(self, name: str) -> bool:
        """Create an empty file; false if it is there already."""
        fs, path = self._file(name)
        fs.mkdirs(path.getParent())
        return fs.createNewFile(path)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        fs, path = self._file(name)
        fs.delete(path, True)

    def put(self, name: str, text: str) -> None:
        """Write a small file at once; one that is there stays, also if two write it together."""
        fs, path = self._file(name)
        fs.mkdirs(path.getParent())
        folder, _, last = name.rpartition("/")
        _, part = self._file(f"{folder}/.{last}-{uuid.uuid4().hex}".lstrip("/"))  # hidden from readers
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(path) or not fs.rename(part, path):
            fs.delete(part, False)

    def get(self, name: str) -> str | None:
        """The text of a small file, None if it is not there."""
        fs, path = self._file(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def bind(self, encoder: Encoder) -> Encoder:
        """The encoder, held against the one whose vectors the table has.

        The first run leaves its fingerprint and, if there is one, its projection, which
        later runs read instead of drawing it again; an encoder of other vectors is
        refused.
        """
        mine, matrix = fingerprint(encoder), getattr(encoder, "matrix", None)
        text = self.get("encoder.json")
        if text is None:
            rows = None if matrix is None else [[float(x) for x in row] for row in matrix]
            self.put("encoder.json", json.dumps({"fingerprint": mine, "matrix": rows}))
            text = self.get("encoder.json")  # another first run may have been sooner
        found = json.loads(text)
        if found["fingerprint"] != mine:
            raise ValueError(f"the table holds vectors of {found['fingerprint']}, not of {mine}")
        if found["matrix"] is not None and hasattr(encoder, "kept"):
            return replace(encoder, kept=tuple(map(tuple, found["matrix"])))
        return encoder

    def runs(self) -> DataFrame:
        raw = self._raw("runs")
        if raw is None:
            schema = T.StructType([*RUN.fields, T.StructField("batch", T.LongType())])
            return self.spark.createDataFrame([], schema)
        return raw

    def state(self, source: str | None = None, query: str | None = None) -> State:
        """What the committed runs amount to, in one pass over their records."""
        mine = F.col("source") == F.lit(source)
        base = max((int(n) for n in self._names("bases")), default=None)
        runs = self.runs()
        later = F.col("batch") > F.lit(-1 if base is None else base)
        r = runs.agg(
            F.count_distinct("batch").alias("batches"),
            F.max("batch").alias("last"),
            F.max(F.when(later, F.col("replaces"))).alias("replaces"),
            F.max(F.when(F.col("width") != self.width, F.col("width"))).alias("other"),
            F.max(F.when(mine, F.col("mark"))).alias("mark"),
            F.max(F.when(mine & F.col("query").eqNullSafe(F.lit(query)), F.col("epoch"))).alias("epoch"),
        ).first()
        if r["other"] is not None:
            raise ValueError(f"the vector table has width {r['other']}, not {self.width}")
        gaps: tuple[int, ...] = ()
        if r["last"] is not None and r["batches"] <= r["last"]:
            every = self.spark.range(r["last"] + 1).withColumnRenamed("id", "batch")
            gaps = tuple(x["batch"] for x in every.join(runs.select("batch"), "batch", "left_anti").collect())
        return State(r["last"], bool(r["replaces"]), r["mark"] or 0, r["epoch"], gaps, base)

    def begin(self, source: str | None = None, query: str | None = None) -> State:
        """The state for a run to start from, once claims that have run out are ended."""
        state = self.state(source, query)
        return self.state(source, query) if self.end_leases(state) else state

    def end_leases(self, state: State) -> list[int]:
        """End the open claims that are older than the lease; returns their numbers.

        Whoever creates a number's end file first has it: the run that commits, or this.
        An ended number gets a row of its own in ``runs`` and loses what was written.
        """
        now = self.spark.sparkContext._jvm.System.currentTimeMillis()
        ended = []
        for batch in state.open:
            fs, claim = self._file(f"claims/{batch}")
            if not self._create(f"claims/{batch}") and fs.getFileStatus(claim).getModificationTime() > now - self.lease_ms:
                continue
            if not self._create(f"ends/{batch}"):
                continue
            for table in _KEYS:
                self._delete(f"{table}/batch={batch}")
            self._record(batch, source=None, total=0, ingested=0, skipped=0, errors=0, mark=0, replaces=False, status="dead")
            ended.append(batch)
        return ended

    def compact(self) -> int | None:
        """Write all batches up to the first open one as one base; returns its number.

        Rows are dealt by the hash of their id and sorted by it. Readers that have
        begun go on with the batches, which stay until ``vacuum``.
        """
        state = self.begin()
        upto = min(state.open) - 1 if state.open else state.last
        if upto is None or upto < 0 or (state.base is not None and upto <= state.base):
            return None
        view = State(upto, state.replaces, 0, None, (), state.base)
        for table in ("articles", "vectors"):
            key = _KEYS[table]
            rows = self.read(table, view).repartition(key).sortWithinPartitions(key)
            rows.write.mode("overwrite").parquet(self._path(f"{table}-base/upto={upto}"))
        self._create(f"bases/{upto}")
        return upto

    def vacuum(self) -> None:
        """Delete the batches and bases that the newest base replaces.

        For times when no reader is at work that began before the last compaction.
        """
        base = self.state().base
        for table in ("articles", "vectors"):
            for name in self._names(table):
                if name.startswith("batch=") and base is not None and int(name[6:]) <= base:
                    self._delete(f"{table}/{name}")
            for name in self._names(f"{table}-base"):
                if base is not None and int(name[5:]) < base:
                    self._delete(f"{table}-base/{name}")

    def claim(self, state: State) -> tuple[int, bool]:
        """A batch number of one's own, and whether other runs may be at work.

        A number is held by whoever creates its file first. A run that finds earlier
        numbers held but not committed cannot know their ids, so what it writes counts
        as replacing.
        """
        batch = first = 0 if state.last is None else state.last + 1
        while not self._create(f"claims/{batch}"):
            batch += 1
        return batch, batch != first or bool(state.open)

    def read(self, table: str, state: State | None = None) -> DataFrame:
        """The committed rows, the last batch winning per id.

        The pass over ids is needed only if some run replaced rows; plain
        appends are read as they are.
        """
        state = state or self.state()
        raw = self._raw(table) if state.last is not None else None
        if raw is None and state.base is not None and _KEYS[table]:
            raw = self.spark.createDataFrame([], T.StructType([*_SCHEMAS[table].fields, T.StructField("batch", T.LongType())]))
        if raw is None:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        # Numbers are given out in turn: the committed ones are all up to the last,
        # but for those of runs that died or still go on.
        seen = raw.where((F.col("batch") <= state.last) & ~F.col("batch").isin(list(state.open)))
        key = _KEYS[table]
        if key and state.base is not None:
            base = self.spark.read.schema(_SCHEMAS[table]).parquet(self._path(f"{table}-base/upto={state.base}"))
            base = base.withColumn("batch", F.lit(state.base).cast("long"))
            seen = base.unionByName(seen.where(F.col("batch") > state.base))
        if key and state.replaces:
            repeated = (
                seen.groupBy(key)
                .agg(F.count("*").alias("_n"), F.max("batch").alias("_last"))
                .where("_n > 1")
                .select(key, "_last")
            )
            # The replaced ids are few as a rule, and then no row is shuffled.
            seen = seen.join(sized(repeated), key, "left").where(
                F.col("_last").isNull() | (F.col("_last") == F.col("batch"))
            )
        return seen.select(*_SCHEMAS[table].fieldNames())

    def mark(self, source: str) -> int:
        """The highest committed mark of a source; zero before its first run."""
        return self.state(source).mark

    def any_held(self, ids: DataFrame, state: State, tables: list[str]) -> bool:
        """Whether some of the ids, in a column ``id``, are in the tables already."""
        if state.last is None:
            return False
        held = [self.read(t, state).select(F.col(_KEYS[t]).alias("id")) for t in tables]
        return not ids.join(reduce(DataFrame.union, held), "id").isEmpty()

    def write(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        """Write a batch, not visible yet, and return it as written."""
        path = f"{self._path(table)}/batch={batch}"
        rows.select(*_SCHEMAS[table].fieldNames()).write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(_SCHEMAS[table]).parquet(path)

    def release(self, batch: int) -> None:
        """Give back a claimed number with nothing to commit; its holder alone may."""
        for name in [*[f"{t}/batch={batch}" for t in [*_KEYS, "progress"]], f"claims/{batch}"]:
            self._delete(name)

    def progress(self) -> DataFrame:
        """What runs have told of themselves, while they ran too."""
        schema = T.StructType([*PROGRESS.fields, T.StructField("batch", T.LongType())])
        if not self._names("progress"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self._path("progress")).json(self._path("progress"))

    def check_vectors(self, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows whose vectors are all valid, and the ids of the others."""
        ok = F.lit(True)
        for c in VECTOR_COLUMNS:
            ok = ok & is_valid_vector(F.col(c), self.width)
        bad = vectors.where(~ok).select(
            F.col("article_id").alias("id"),
            F.lit("invalid vector").alias("reason"),
            F.lit(None).cast("string").alias("record"),
        )
        return vectors.where(ok), bad

    def commit(self, batch: int, **run) -> None:
        """Make a batch visible in all tables at once; refused once its lease has ended."""
        if not self._create(f"ends/{batch}"):
            held = self.runs().where(F.col("batch") == batch).first()
            if held is None or held["status"] == "dead":
                raise RuntimeError(f"batch {batch} was not committed in time and has been ended")
        self._record(batch, **run)

    def _record(self, batch: int, **run) -> None:
        row = {f.name: run.get(f.name) for f in RUN.fields}
        row["width"] = self.width
        row["status"] = row["status"] or "done"
        one = self.spark.createDataFrame([tuple(row[f.name] for f in RUN.fields)], RUN)
        one.coalesce(1).write.mode("errorifexists").parquet(f"{self._path('runs')}/batch={batch}")

    def upsert_vectors(
        self,
        rows: DataFrame,
        source: str,
        order: list[str] | None = None,
        epoch: int | None = None,
        unreadable: DataFrame | None = None,
        query: str | None = None,
    ) -> int:
        """Write vector rows, last one winning per id; returns how many.

        A batch whose epoch is committed already is not written again. Rows with
        an invalid vector, and records that could not be read, are quarantined.
        """
        state = self.begin(source, query)
        if state.has_epoch(epoch):
            return 0
        batch, others = self.claim(state)
        last = keep_last(rows, "article_id", *order) if order else rows.dropDuplicates(["article_id"])
        good, bad = self.check_vectors(materialise(last))
        written = self.write("vectors", batch, good)
        refused = bad if unreadable is None else bad.unionByName(unreadable)
        errors = self.write("quarantine", batch, refused).count()
        n = written.count()
        replaces = others or self.any_held(written.select(F.col("article_id").alias("id")), state, ["vectors"])
        self.commit(
            batch, source=source, epoch=epoch, query=query, total=n + errors, ingested=n, skipped=0,
            errors=errors, mark=0, replaces=replaces, message=f"{n} vectors written",
        )
        return n


_MARK = "mark"


def save_model(spark: SparkSession, root: str, version: str, params: dict, mark: int | None = None) -> None:
    """A new version of the scorer; older versions stay as they are.

    Versions are numbers or stamps, digits and underscores; the largest is the newest.
    ``mark`` is the publish time up to which it has learned.
    """
    if not re.fullmatch(r"[0-9_]*[0-9][0-9_]*", version):
        raise ValueError(f"a version is made of digits and underscores, not {version!r}")
    rows = [
        (name, list(value.shape), [float(x) for x in value.ravel()])
        for name, value in sorted(params.items())
    ]
    if mark is not None:
        rows.append((_MARK, [], [float(mark)]))
    df = spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")
    df.coalesce(1).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/version={version}")


def _newest(spark: SparkSession, root: str) -> list:
    schema = "name string, shape array<int>, values array<double>, version string"
    every = read_if_there(spark, root, schema)
    if every is None:
        return []
    number = F.regexp_replace("version", "_", "").cast("decimal(38,0)")
    newest = every.agg(F.max_by("version", F.struct(number, "version"))).first()[0]
    return every.where(F.col("version") == newest).collect()


def load_model(spark: SparkSession, root: str, width: int | None = None) -> dict | None:
    """The newest version, or None when there is none yet."""
    rows = _newest(spark, root)
    if not rows:
        return None
    params = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows if r["name"] != _MARK}
    if width is not None and params["w0"].shape[1] != 2 * width:
        raise ValueError(f"the model takes width {params['w0'].shape[1] // 2}, not {width}")
    return params


def load_mark(spark: SparkSession, root: str) -> int:
    """The mark kept with the newest version; zero without one."""
    return next((int(r["values"][0]) for r in _newest(spark, root) if r["name"] == _MARK), 0)
