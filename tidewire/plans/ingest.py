"""Ingest jobs: incremental, backfill and drop-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import DAY_MS
from tidewire.operators.embedding import Encoder
from tidewire.operators.increment import cap_new, keep_last, presence
from tidewire.operators.normalise import nested_to_text, normalise, with_id
from tidewire.operators.skew import few
from tidewire.plans.embed import ARTICLE_OF_ROW, common_vector, named_vectors
from tidewire.plans.progress import Reporter
from tidewire.schemas import ARTICLE
from tidewire.session import batches_of, materialise
from tidewire.sources import readers
from tidewire.sources.tables import Store
from tidewire.sources.vector_cache import VectorCache

Vectorise = Callable[..., DataFrame]
_ROW = "_row"
#: Bytes of a batch of rows that a Python worker gets while a source is taken in.
PYTHON_BYTES = 4 << 20


def _new_rows(store: Store, named: DataFrame, state, order: list[str], limit: int | None) -> tuple[DataFrame, int, int, bool]:
    """The rows to take in, by row number, how many, how many more wait, and whether they replace some.

    Only ids and what orders them take part: the last row per id, less the ids that both
    tables hold, up to the limit. The ids of the tables are read once.
    """
    new = materialise(keep_last(named.select("id", *order, _ROW), "id", *order))
    n, replaces = new.count(), False
    if state.last is not None and n:
        held = presence(few(new, n), store.read("articles", state), store.read("vectors", state))
        known = F.coalesce(F.col("in_articles") & F.col("in_vectors"), F.lit(False))
        marked = new.join(held, "id", "left").where(~known)
        new = materialise(marked.select("id", *order, _ROW, F.col("in_articles").isNotNull().alias("half")))
        n, replaced = new.agg(F.count("*"), F.count_if("half")).first()
        replaces = replaced > 0
    if limit is None or n <= limit:
        return few(new.select(_ROW), n), n, 0, replaces
    return few(materialise(cap_new(new, limit, *order).select(_ROW)), limit), limit, n - limit, replaces


def ingest(
    store: Store,
    raw: DataFrame,
    encoder: Encoder,
    source: str,
    vectorise: Vectorise,
    trim: bool = False,
    limit: int | None = None,
    order: list[str] | None = None,
    since: int = 0,
    epoch: int | None = None,
    query: str | None = None,
    refused: DataFrame | None = None,
    every: float | None = None,
    cache: VectorCache | None = None,
) -> dict | None:
    """Take in what is new of a source and commit both tables and the mark.

    The source is parsed once, into the shared folder; what is new is decided on ids
    alone, and only then bodies move, once, to the encoder, whose output both tables
    are written from. A text on which the encoder fails, or gives no valid vector, costs
    its own article: that one is quarantined and is in neither table, so that a later
    run tries it again. Progress is told while the run goes on, ``every`` so many seconds.
    """
    state = store.begin(source, query)
    if state.has_epoch(epoch):
        return None
    encoder = store.bind(encoder)
    order = order or ["_seq"]
    if readers.CORRUPT not in raw.columns:
        raw = raw.withColumn(readers.CORRUPT, F.lit(None).cast("string"))
    batch, others = store.claim(state)
    with Reporter(store, batch, source, every) as report, batches_of(store.spark, PYTHON_BYTES):
        staged = materialise(normalise(raw, trim).withColumn(_ROW, F.monotonically_increasing_id()))
        unreadable = F.col(readers.CORRUPT).isNotNull()
        counts = staged.agg(
            F.count("*").alias("total"), F.count(readers.CORRUPT).alias("corrupt")
        ).first()
        named = with_id(staged.where(~unreadable))
        wanted, total, waiting, replaces = _new_rows(store, named, state, order, limit)
        fresh = named.join(wanted, _ROW, "left_semi")
        report.tell("encoding", total, 0)
        article = F.struct(*ARTICLE.fieldNames()).alias(ARTICLE_OF_ROW)
        made = materialise(vectorise(fresh.select("*", article), encoder, seen=report.seen, cache=cache))
        good, bad = store.check_vectors(made)
        report.tell("writing", total, total)
        store.write("articles", batch, good.select(f"{ARTICLE_OF_ROW}.*"))
        vectors = store.write("vectors", batch, good)
        broken = staged.where(unreadable).select(
            "id", F.lit("unreadable record").alias("reason"), F.col(readers.CORRUPT).alias("record")
        )
        for more in [broken, refused]:
            bad = bad if more is None else bad.unionByName(more)
        errors = store.write("quarantine", batch, bad).count()

        done = vectors.agg(F.count("*").alias("n"), F.max("timestamp").alias("top")).first()
        skipped = counts["total"] - counts["corrupt"] - total - waiting
        run = {
            "source": source,
            "epoch": epoch,
            "query": query,
            "total": counts["total"],
            "ingested": done["n"],
            "skipped": skipped,
            "errors": errors,
            "mark": max(done["top"] or 0, since),
            "replaces": replaces or others,
            "message": f"{done['n']} new articles added, {skipped} skipped",
            "remaining": waiting,
        }
        if not (done["n"] or errors or epoch is not None):
            store.release(batch)
            return run
        report.tell("done", total, total)
    store.commit(batch, **run)
    return run


def ingest_lake(
    store: Store,
    path: str,
    encoder: Encoder,
    since_days: int | None = None,
    as_of_ms: int | None = None,
    dry_run: bool = False,
    cache: VectorCache | None = None,
) -> dict | None:
    """Articles at or past the mark; equal stamps come again and are skipped."""
    source = f"lake:{path}"
    since = as_of_ms - since_days * DAY_MS if since_days is not None else store.mark(source)
    new = readers.new_articles(store.spark, path, since, inclusive=True)
    if dry_run:
        return {"total": new.count()}
    placed = nested_to_text(new).withColumn("_seq", F.monotonically_increasing_id())
    return ingest(
        store, placed, encoder, source, named_vectors, trim=True,
        order=["published_time_unix", "_seq"], since=since, cache=cache,
    )


def ingest_backfill(
    store: Store, path: str, encoder: Encoder, limit: int | None = None, dry_run: bool = False,
    cache: VectorCache | None = None,
) -> dict | None:
    """All new rows of a CSV file, or the next ones in file order up to ``limit``."""
    rows = readers.read_csv(store.spark, path)
    if dry_run:
        return {"total": rows.count()}
    return ingest(store, rows, encoder, f"csv:{path}", common_vector, limit=limit, cache=cache)


def ingest_drop_in(
    store: Store, path: str, encoder: Encoder, dry_run: bool = False, cache: VectorCache | None = None
) -> dict | None:
    """A CSV or JSON batch, whole."""
    rows = readers.require_rows(readers.read_articles(store.spark, path))
    if dry_run:
        return {"total": rows.count()}
    return ingest(store, rows, encoder, f"drop:{path}", common_vector, cache=cache)
