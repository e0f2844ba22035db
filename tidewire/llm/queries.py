"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, extract, language, licenses, lm, merkle, mixing, ngram_join, pseudonyms, quality
from tidewire.llm import sharding, spans, trie
from tidewire.llm.words import space_words

Query = Callable[[SparkSession, str], DataFrame]
#: The key of the registered queries; a deployment passes its own secret.
PSEUDONYM_KEY = b"tidewire-pseudonyms"
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op8_quality_rules(spark, sf_dir):
    """Measures and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query
def op1_mixing(spark, sf_dir):
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    words = F.size(space_words(F.col("text")))
    return mixing.mix(spark, docs, words).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_ngram_join(spark, sf_dir):
    """The component of every document by links of near copies."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return ngram_join.groups(spark, docs, n=3, percent=90).select(
        "doc_id", F.col("size").alias("n_shingles"), "component_id"
    )


@query
def op4_decontaminate(spark, sf_dir):
    """Benchmark words and items inside every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.scan(spark, docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op5_pseudonyms(spark, sf_dir):
    """Every document's text with its personal data replaced, and what was found."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY).select(
        "doc_id", "text", "n_found", F.array_join(F.array_sort(F.map_keys("kinds")), ",").alias("kinds")
    )


@query
def op2_language(spark, sf_dir):
    """The language of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 5)
    known = language.dictionaries(language.sample(docs.where(~held)))
    return language.identify(spark, docs.select("doc_id", "text"), known).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected"
    )


@query
def op9_licenses(spark, sf_dir):
    """License phrases and notices of every document."""
    return licenses.scan(spark, table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query
def op3_spans(spark, sf_dir):
    """Every document without the sentence runs that an earlier one holds."""
    return spans.dedup(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_lm_score(spark, sf_dir):
    """Every document's score, learned from nine folds of ten."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = language.held_out(F.col("doc_id"), 10)
    scored = lm.score(spark, docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), *lm.RESULT)


@query
def op7_extract(spark, sf_dir):
    """The main text of every page."""
    return extract.extract(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op11_prefix_trie(spark, sf_dir):
    """The trie of all rebuilt conversations."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return trie.prefix_trie(spark, turns, splice=True).select(*trie.RESULT)


@query
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, roots, proof and tamper check of every document."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents", *names)
    other = merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names])
    signed = merkle.manifest(
        spark, docs, names, "lang", "doc_id", F.when(language.held_out(F.col("doc_id"), 7), other)
    )
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step.before, step.after)), "")
    return signed.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified"
    )


@query
def op13_sharding(spark, sf_dir):
    """Eight shards of near equal bytes; equal texts share one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sharding.shards(spark, docs).select("doc_id", *sharding.RESULT)
