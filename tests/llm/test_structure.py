"""Prefix trie, Merkle manifest and sharding on awkward rows, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidewire.llm import merkle, places, sharding, trie
from tidewire.session import Scratch

TURNS = "conv_id long, turn long, role string, text string"


def _digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_trie(rows, splice):
    said = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        said[c].append((t is not None, t or 0, _digest(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in said.items()}
    new = dict(own)
    if splice:
        for c in own:
            if c is not None:
                h = zlib.crc32(str(c).encode()) % 4
                new[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(turns[d - 1])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(cases.space_words(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    order = lambda c: (c is None, c or 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m, key=order) if c is not None and len(new[c]) == len(p))
        out.append((
            min(m, key=order), len(p), min(members[p[:-1]], key=order) if p else None, len(m), len(kids.get(p, ())),
            leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _chains():
    """A long chain, one that sheds a leaf at every odd depth, a bush, and copies."""
    rows = [(1, t, "user", f"a {t}") for t in range(150)]
    rows += [(2, t, "user", f"b b {t}") for t in range(100)]
    for at in range(1, 100, 2):
        rows += [(100 + at, t, "user", f"b b {t}") for t in range(at)] + [(100 + at, at, "bot", f"end {at}")]
    rows += [(300 + i, 0, "system", "hot first turn") for i in range(40)]
    rows += [(300 + i, 1, "user", f"x {i % 7}") for i in range(20)]
    return rows


AWKWARD = [
    (0, 0, "user", "one two"), (0, 1, "bot", "three"), (0, 2, None, None), (5, None, "user", "null turn first"),
    (5, 0, "user", "one two"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (7, 3, "", ""), (7, 4, None, ""),
    (19, 0, "user", "short"), (21, 0, "a", "bc"), (22, 0, "ab", "c"), (None, 0, "user", "one two"), (None, None, None, None),
    (-3, 0, "user", "w " * 20_000), (-25, 1, "user", "x"), (40, 9, "user", "one two"), (41, 0, "user", "\t \n"),
]


@pytest.mark.parametrize("splice", [False, True])
@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD * 2, []])
def test_trie_of_awkward_rows(spark, rows, splice):
    df = spark.createDataFrame(rows, TURNS).repartition(3).selectExpr("*", "1 AS place", "'x' AS depth", "2 AS c", "3 AS kids")
    got = trie.prefix_trie(spark, df, splice=splice).select(*trie.RESULT).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows, splice)


def test_trie_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = _chains()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = trie.prefix_trie(spark, df).select(*trie.RESULT).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows, False)


def test_contraction_halves_chains(spark):
    """One chain of 1000 nodes takes rounds in proportion to its logarithm."""
    scratch = Scratch(spark, "chain")
    n = 1000
    linked = spark.range(n + 1).select(
        F.col("id").cast("int").alias("depth"), F.lit(7).cast("long").alias("c"),
        F.when(F.col("id") > 0, 7).cast("long").alias("pc"), F.lit(2).cast("long").alias("n_convs"), F.lit(3).cast("long").alias("words"),
    )
    start = scratch.keep(trie._start(linked), "state0")
    done = {r.d: (r.n_leaves, r.saved_tokens) for r in trie.totals(scratch, start).collect()}
    assert done == {d: (1, 3 * (n + 1 - d)) for d in range(n + 1)}
    assert len([name for name in scratch._kept if name.startswith("state")]) <= 16


def test_places(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaaabc"), rng.choice([None, 1, 2, 2, 3])) for _ in range(500)]
    scratch = Scratch(spark, "places")
    written = scratch.keep(spark.createDataFrame(rows, "g string, v long").repartition(7), "rows")
    got = defaultdict(list)
    for r in places.numbered(scratch, written, "n", ["g"], ["v"]).collect():
        got[r.g].append((r.place, (r.v is not None, r.v or 0)))
    for found in got.values():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found)))
        assert [v for _, v in found] == sorted(v for _, v in found)
    assert sum(map(len, got.values())) == 500


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def _way(levels, at, arity):
    out = []
    for level in levels[:-1]:
        first = at - at % arity
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + arity])))
        at //= arity
    return out


def plain_manifest(rows, arity):
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        row = dict(zip(columns, (doc_id, source, lang, n_chars, text), strict=True))
        other = row | {"n_chars": None if n_chars is None else n_chars + 1}
        own = _h(*map(_value, row.values()))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by[lang].append((doc_id is not None, doc_id or 0, own, _h(*map(_value, other.values())) if hit else own, doc_id))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _levels([x[2] for x in sorted(by[g])], arity) for g in langs}
    top = _levels([trees[g][-1][0] for g in langs], arity) if langs else [[None]]
    out = []
    for k, g in enumerate(langs):
        for at, (_, _, own, new, doc_id) in enumerate(sorted(by[g])):
            way = _way(trees[g], at, arity) + _way(top, k, arity)
            for before, after in way:
                new = _h(before, new, after)
            out.append((doc_id, g, own, trees[g][-1][0], top[-1][0], way, new, new == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "rows,arity,block",
    [(cases.ROWS, 2, 1024), (cases.ROWS * 9, 2, 4), (cases.ROWS * 9, 3, 9), (cases.ROWS[:1], 2, 2), ([], 2, 1024), (cases.ROWS, 5, 2)],
)
def test_manifest(spark, rows, arity, block):
    docs = cases.clashing(cases.docs(spark, rows)).selectExpr("*", "'x' AS leaf", "'x' AS key", "'x' AS way")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    other = merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    got = merkle.manifest(spark, docs, names, "lang", "doc_id", F.when(hit, other), arity, block)
    found = [
        (r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof], r.folded_root, r.verified)
        for r in got.collect()
    ]
    assert sorted(found, key=str) == plain_manifest(rows, arity)


def test_fold_hashes_only_what_follows():
    leaves = [_h(str(i)) for i in range(11)]
    tree = merkle.Tree(leaves, 3, 3)
    for at in range(11):
        new = [*leaves]
        new[at] = _h("other")
        assert tree.fold(at, new[at]) == merkle.Tree(new, 3, 3).levels[-1][0]
        assert tree.fold(at, leaves[at]) == tree.levels[-1][0]


def plain_packing(sizes, capacity):
    """Best fit decreasing, one group after the other."""
    room, out = [], defaultdict(lambda: defaultdict(int))
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if fits:
            at = min(fits)[1]
        else:
            at = len(room)
            room.append(max(capacity, size))
        room[at] -= size
        out[size][at] += 1
    return {s: dict(v) for s, v in out.items()}


def test_packing_in_runs_is_best_fit_decreasing(spark):
    rng = random.Random(11)
    sizes = [rng.choice([1, 1, 2, 3, 5, 8, 13, 40, 90, 300]) * rng.randrange(1, 4) for _ in range(400)]
    counts = [(s, sizes.count(s)) for s in set(sizes)]
    table = spark.createDataFrame(counts, "size long, n long").repartition(3)
    tried = [300, 901, 1000, 4000]
    runs = defaultdict(lambda: defaultdict(list))
    for r in sharding.pack(table, tried).collect():
        runs[r.capacity][r.size].append((r.first, r.shard))
    for capacity in tried:
        got = {}
        for size, n in counts:
            found = sorted(runs[capacity][size])
            ends = [f for f, _ in found[1:]] + [n]
            got[size] = defaultdict(int)
            for (first, shard), end in zip(found, ends, strict=True):
                got[size][shard] += end - first
        assert {s: dict(v) for s, v in got.items()} == plain_packing(sizes, capacity)


def test_tree_of_shards_stays_balanced():
    bins = sharding.Bins(1_000_000)
    for size in range(999_999, 997_000, -1):
        assert list(bins.put(size, 1)) == [(bins.opened - 1, 1)]
    assert bins.opened == 2999 and bins.tree.height <= 17
    assert bins.tightest(1) == (1, 0) and bins.tightest(2999) == (2999, 2998) and bins.tightest(3000) is None


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_shards(spark, n_shards):
    rows = cases.ROWS + [(100 + i, f"text {i % 60} " * (i % 13), None, None, 0) for i in range(300)]
    rows += [(500 + i, "the same text", "en", "a", 0) for i in range(150)]
    got = sharding.shards(spark, cases.clashing(cases.docs(spark, rows)).selectExpr("*", "1 AS shard", "2 AS slot"), n_shards=n_shards).collect()
    text = lambda t: None if t is None else t.encode()
    want = sorted(((r[0], 1 + len(text(r[1]) or b""), None if r[1] is None else zlib.crc32(text(r[1]))) for r in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    slots, held, by_text = defaultdict(list), defaultdict(int), defaultdict(set)
    crc = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n_shards
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
        if r.doc_id is not None:
            by_text[crc[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    total, largest = sum(held.values()), max(len((r[1] or "").encode()) + 1 for r in rows)
    assert max(held.values()) <= max(1.02 * total / n_shards, 1.02 * largest) + 1


def test_shards_of_a_capacity(spark):
    rows = [(i, "x" * (9 + i % 90), None, None, 0) for i in range(200)]
    got = sharding.shards(spark, cases.docs(spark, rows), capacity=500).collect()
    held = defaultdict(int)
    for r in got:
        held[r.shard] += r["size"]
    sizes = [3 * (10 + i) if i < 20 else 2 * (10 + i) for i in range(90)]  # groups of equal texts
    want = plain_packing(sizes, 500)
    assert max(held.values()) <= 500 and len(held) == len({s for v in want.values() for s in v})
    assert sharding.shards(spark, cases.docs(spark, [])).collect() == []
