"""Queries without SQL over the small tables, against plain versions of what they compute."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard

from tests.llm.test_copies import _stripped
from tidewire.llm import dom, language, pseudonyms, queries


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    return {r.doc_id: r for r in rows}


def test_spans_of_all_documents(spark, sf_dir, texts):
    ids = sorted(texts)
    want = dict(zip(ids, _stripped([texts[i].text for i in ids]), strict=True))
    got = {r.doc_id: r.text for r in queries.op3_spans(spark, sf_dir).collect()}
    assert got == want and any(got[i] != texts[i].text for i in ids)


def test_pseudonyms_of_all_documents(spark, sf_dir, texts):
    names = pseudonyms.Pseudonyms(queries.PSEUDONYM_KEY)
    back = pseudonyms.Pseudonyms(queries.PSEUDONYM_KEY, back=True)
    found = 0
    for r in queries.op5_pseudonyms(spark, sf_dir).collect():
        text = texts[r.doc_id].text
        moved, kinds = names.replace(text)
        assert r.text == moved and r.n_found == sum(kinds.values())
        assert r.kinds == ",".join(sorted(kinds))
        assert back.replace(moved)[0] == text
        found += r.n_found
    assert found > 0


def test_languages_of_all_documents(spark, sf_dir, texts):
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    known = language.dictionaries(language.sample(docs.where(~language.held_out(docs["doc_id"], 5))))
    assert set(known) == {texts[i].lang for i in texts if i not in held and texts[i].lang}
    hits = Counter()
    for r in queries.op2_language(spark, sf_dir).collect():
        words = list(dict.fromkeys(re.sub(r"[\W\d_]+", " ", (texts[r.doc_id].text or "").lower()).split()))
        data, sizes = " ".join(words).encode(), {}
        for name, dictionary in known.items():
            told = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=told, write_checksum=False, write_content_size=False)
            parts = [data[i : i + language.PIECE_BYTES] for i in range(0, len(data), language.PIECE_BYTES)] or [b""]
            sizes[name] = sum(len(tool.compress(p)) for p in parts)
        least = min(sizes.values())
        # a prepared dictionary may choose other matches than a fresh one, by a few bytes
        assert r.lang_pred == "und" if not words else sizes[r.lang_pred] <= 1.03 * least + 4
        assert r.held_out == (r.doc_id in held) and 0 <= r.score <= 1
        if r.held_out and len(data) > 200:
            hits[r.lang_pred == texts[r.doc_id].lang] += 1
    assert hits[True] >= 0.95 * sum(hits.values())


def test_main_text_of_all_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    hosts, parsed = defaultdict(list), {}
    for r in rows:
        hosts[re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r.url or "")[1].lower()].append(r)
        page = dom.parse(r.html or "")
        shape, number = dom.shape(page)
        parsed[r.html] = page, shape, number
    want = {}
    for some in hosts.values():
        shapes = Counter(parsed[r.html][1] for r in some)
        reference = max(shapes, key=lambda s: (shapes[s], s.encode()))
        filled, of_node = Counter(), Counter()
        for html in {r.html for r in some}:
            page, shape, number = parsed[html]
            to = dom.align(reference, shape)
            found = {(to[number[n]], t) for n, t in page.blocks if to[number[n]] >= 0}
            filled.update(found)
            of_node.update({n for n, _ in found})
        constant = {(n, t) for (n, t), k in filled.items() if of_node[n] >= 2 and k >= 0.9 * of_node[n]}
        for r in some:
            page, shape, number = parsed[r.html]
            to = dom.align(reference, shape)
            template = {(number[n], dom.text_hash(t)) for n, t in page.blocks if (to[number[n]], t) in constant}
            sure = all(of_node[n] >= 10 for n, _ in constant)
            want[r.page_id] = dom.article(page, number, template, sure)
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op7_extract(spark, sf_dir).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
