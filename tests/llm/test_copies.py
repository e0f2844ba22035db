"""Near copies, spans and the pipeline, against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import cases
from tidewire.llm import decontaminate, ngram_join, pseudonyms, spans
from tidewire.llm.queries import PSEUDONYM_KEY


def _random_docs(seed):
    """Families of near copies at all distances around the thresholds, and a hub's leaves."""
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 80]))]
        for _ in range(rng.randrange(2, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(50)}"
            rows.append((len(rows) * 7 % 101, " ".join(copy), None, None, None))
    return rows


@pytest.mark.parametrize("n,percent,rows", [(3, 90, cases.ROWS), (5, 80, _random_docs(1)), (3, 90, _random_docs(2) + cases.ROWS)])
def test_components(spark, n, percent, rows):
    df = cases.docs(spark, rows)
    found = ngram_join.groups(spark, cases.clashing(df), n, percent).collect()
    assert len(found) == len(rows)
    group = cases.linked([r[1] for r in rows], n, percent)
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(
        ((r[0], len(cases.shingles(r[1], n)), least.get(g) if cases.space_words(r[1]) else r[0]) for r, g in zip(rows, group, strict=True)),
        key=str,
    )
    assert sorted(((r.doc_id, r["size"], r.component_id) for r in found), key=str) == want


def test_overlap_bound():
    """Counts by range never allow less than the overlap, and tell unlike sets apart."""
    rng = np.random.default_rng(5)
    for n, m, k in [(0, 5, 0), (30, 40, 25), (600, 500, 100), (5000, 1200, 0), (70_000, 60_000, 59_000)]:
        both = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, x - k, dtype=np.uint64)])) for x in (n, m))
        most = ngram_join._most_shared(ngram_join._by_range(a), ngram_join._by_range(b))
        assert most is None or most >= k
        if k == 100:
            assert 190 * most < 90 * (n + m)
    same = ngram_join._by_range(np.zeros(300, np.uint64))
    assert ngram_join._most_shared(same, same) is None


def test_keep_one(spark):
    rows = cases.ROWS + _random_docs(3)
    df = cases.clashing(cases.docs(spark, rows))
    kept = ngram_join.keep_one(spark, df, 5, 80)
    assert kept.columns == df.columns
    texts = [r[1] for r in rows if cases.space_words(r[1])]
    groups = len(set(cases.linked(texts, 5, 80)))
    assert kept.count() == groups + len(rows) - len(texts)
    assert ngram_join.keep_one(spark, cases.docs(spark, []), 5, 80).collect() == []
    assert ngram_join.groups(spark, cases.docs(spark, []), 5, 80).collect() == []


def test_sentences():
    text = "One two. Three!  Four\nfive? " + "long " * 60 + "end"
    found = spans.sentences(text)
    assert [text[a:b] for a, b, _ in found][:3] == ["One two.", "Three!", "Four"]
    assert all(text[a:b].lower().split() == w for a, b, w in found)
    assert sum(len(w) for _, _, w in found) == len(text.split())
    assert spans.sentences("") == [] and spans.runs([]) == []
    assert spans.strip("a. b.", []) == ("a. b.", 2, 0)


def test_wordings_are_the_words_of_sentences(monkeypatch):
    """The words alone are those of the sentences, and a worker keeps a bounded number of hashes."""
    rng = random.Random(5)
    texts = ["", "a. b.", "\x1cA B\x85C\u2003D. " * 9, "\u03a3\u0391\u03a3 \u0130x " * 40]
    for n in (30, 90, 400):
        words = [rng.choice(["Mill", "road.", "x\n", "\u3002", f"W{rng.random()}", "!"]) for _ in range(n)]
        texts += [" ".join(words), " ".join(w.strip(".!\n") for w in words)]
    monkeypatch.setattr(spans, "REMEMBERED_WORDS", 16)
    for text in texts:
        found = spans.sentences(text)
        assert spans.wordings(text) == [w for _, _, w in found]
        assert spans.runs_of(spans.wordings(text)) == spans.runs(found)
        assert spans.strip(text, []) == (text, len(found), 0)
        assert len(spans._hashes) <= 16 or spans._hash("new") and len(spans._hashes) <= 16


def test_spans(spark):
    passage = "The mill stood by the old road and turned all night. No one knew who had built it first. The wheel was of oak, and the stones came from far away. Children were told to keep away from it."
    rows = [(i, f"Start {i} here and there. {passage} Finish {i} is a sentence of its own.", "en", "s", i) for i in range(20, 25)]
    rows += [*cases.ROWS, (30, passage.upper(), None, None, None)]
    df = cases.clashing(cases.docs(spark, rows))
    got = spans.dedup(spark, df)
    assert len(got.collect()) == len(rows)
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows}, key=str)
    by_id = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert passage in by_id[20].text and by_id[20].n_removed == 0
    for i in range(21, 25):
        assert by_id[i].text.startswith(f"Start {i}") and by_id[i].text.endswith("of its own.")
        assert "wheel" not in by_id[i].text and by_id[i].n_removed == 4
    assert by_id[1].n_removed == 0 and by_id[2].text == "" and by_id[4].text is None
    assert by_id[9].text == cases.LONG[: cases.LONG.index(cases.PROSE)] and len(order)
    assert spans.dedup(spark, cases.docs(spark, [])).collect() == []


def _stripped(texts):
    """Texts in order, each without the sentences under runs that were there before."""
    seen, out = set(), []
    for text in texts:
        old = []
        for n, (h, _, _) in enumerate(spans.runs(spans.sentences(text))):
            old += [n] if h in seen else []
            seen.add(h)
        out.append(spans.strip(text, old)[0])
    return out


def test_runs_cover_a_passage():
    """Also behind its last run from a start, and texts too short for a run."""
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.randrange(1, 9) for _ in range(rng.randrange(2, 9))]
        sizes[0] += max(0, 12 - sum(sizes))
        passage = " ".join(" ".join(f"p{rng.randrange(10**6)}" for _ in range(n)) + "." for n in sizes)
        around = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 15))) + "." for _ in range(4)]
        first, second = f"{around[0]} {passage} {around[1]}", f"{around[2]} {passage} {around[3]}"
        assert _stripped([first, second]) == [first, f"{around[2]} {around[3]}"]
        assert _stripped([passage, passage]) == [passage, ""]
    for short in ("one two", "Only this. And that.", "one sentence " * 8):
        assert _stripped([short, short.upper(), short + "more"]) == [short, "", short + "more"]


def test_long_sentences_share_pieces():
    """Fifty words that stand in two sentences without end give a run, wherever they stand."""
    rng = random.Random(5)
    for _ in range(300):
        words = [f"{c}{rng.randrange(10**6)}" for c in "abc" for _ in range(50)]
        first = " ".join(words[: rng.randrange(50)] + words[50:100])
        second = " ".join(words[50:100] + words[100 : 100 + rng.randrange(50)])
        kept = _stripped([first, second])[1].split()
        assert len(kept) <= len(second.split()) - spans.WORDS
        assert not {w for w in second.split() if w[0] == "c"} - set(kept)


def test_spans_of_short_texts(spark):
    passage = "The ferry that crossed the wide river in the morning was slow. It was late. So it goes."
    texts = ["No end", f"First of all. {passage} And then they left.", f"Later on. {passage} Nobody came.", "no  END", "one sentence " * 8, "one sentence " * 8]
    got = spans.dedup(spark, cases.docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == ["No end", texts[1], "Later on. Nobody came.", "", texts[4], ""]


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """Documents, awkward ones among them, and the benchmark, in a folder of their own."""
    folder = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cases.DOCS.names)
    docs.unionByName(cases.docs(spark)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, small):
    from tests.llm.test_native import _measures, _targets
    from tidewire.llm.quality import STOP_WORDS

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*cases.DOCS.names).collect()]
    bench = spark.read.parquet(f"{small}/benchmark.parquet").collect()

    def good(text):
        words, chars, symbols, lines, repeats = _measures(text)
        n_lines = sum(1 for x in (text or "").split("\n") if cases.space_words(x))
        stops = sum(w.lower() in STOP_WORDS for w in cases.space_words(text))
        return (
            words >= 50 and 100 * repeats <= 50 * words and 2 * words <= chars <= 16 * words
            and symbols <= 0.1 * words and stops >= 0.01 * words and lines <= 0.5 * n_lines
        )

    rows = [r for r in rows if good(r[1])]
    group = cases.linked([r[1] for r in rows], 5, 80)
    first = {}
    for r, g in zip(rows, group, strict=True):
        if g not in first or (r[0] is None, r[0] or 0) < (first[g][0] is None, first[g][0] or 0):
            first[g] = r
    rows = list(first.values())
    windows = set()
    for b in bench:
        w = cases.sign_words(b.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = cases.sign_words(text)
        return any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))

    rows = [r for r in rows if not hit(r[1])]
    names = pseudonyms.Pseudonyms(PSEUDONYM_KEY)
    rows = [(r[0], names.replace(r[1])[0], *r[2:]) for r in rows]
    got = corpus_pipeline.run(spark, small).collect()
    sums = {}
    for r in rows:
        sums[r[3]] = sums.get(r[3], 0) + len(cases.space_words(r[1]))
    want = _targets(sums)
    texts = {r[1]: r for r in rows}
    assert got and all(r.text in texts and r.taken > 0 for r in got)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sums[r.source]
    for source, size in sums.items():
        if want[source] >= size:  # every document is taken at least once
            assert {r.text for r in got if r.source == source} == {r[1] for r in rows if r[3] == source}
    assert len({r.text for r in got}) == len(got)


def test_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "decontamination", "personal_data", "source_mix"]
    empty = cases.docs(spark, [])
    wide = cases.clashing(cases.docs(spark))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).collect() == []
        got = stage(spark, wide, small)
        if name != "source_mix":
            assert got.columns == wide.columns
        got.collect()


def test_pass_through_of_decontamination(spark, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    kept = decontaminate.clean(spark, cases.docs(spark), benchmark)
    assert kept.count() == len(cases.ROWS)
