import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from sparkscrub.llm import attribution, encoder, tokens, warc
from sparkscrub.llm.encoder import Encoder
from sparkscrub.session import fresh_path

PATH = tokens.default_path()
MODEL = Tokenizer.from_file(PATH)
KEPT, PLAIN = Encoder(PATH, offsets=True), Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab É'sß.,!  \n\t\r \x1c\x85 ½²٣😀_%中", "<|endoftext|>"]), max_size=30).map("".join), max_size=4))
def test_encoder_gives_the_library_ids(texts):
    ids, cuts, low, high = KEPT.encode(texts)
    for k, e in enumerate(MODEL.encode_batch(texts, add_special_tokens=False)):
        own = slice(cuts[k], cuts[k + 1])
        assert ids[own].tolist() == e.ids
        assert list(zip(low[own].tolist(), high[own].tolist())) == e.offsets


WIDE = [*"ab Éɏ'-.,×÷µ!  \n\t\x0b\u0301\xa0\u1680\u2003\u200b\u2028\u202f\u205f\u3000\u180e“…中ー한Я١", "'ll", "<|endoftext|>", "\x1f"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WIDE), max_size=30).map("".join), max_size=4))
def test_pieces_are_cut_where_the_library_cuts(texts):
    ids, cuts, low, high = KEPT.encode(texts)
    for k, e in enumerate(MODEL.encode_batch(texts, add_special_tokens=False)):
        own = slice(cuts[k], cuts[k + 1])
        assert ids[own].tolist() == e.ids
        assert list(zip(low[own].tolist(), high[own].tolist())) == e.offsets
    plain, ends, _, _ = PLAIN.encode(texts)
    assert plain.tolist() == ids.tolist() and ends.tolist() == cuts.tolist()


def test_a_vocabulary_without_some_bytes(tmp_path):
    """Such a tokenizer drops what it does not know; new pieces read as one text cannot be told apart by the bytes of their ids."""
    own = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "Ġ": 2, "Ġa": 3}, merges=[("Ġ", "a")]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "few.json"))
    texts = ["a ab xb axa", " a x  bé, a", "x"]
    for offsets in (False, True):
        ids, cuts, low, high = Encoder(str(tmp_path / "few.json"), offsets).encode(texts)
        want = own.encode_batch(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [e.ids for e in want]
        assert not offsets or [*zip(low.tolist(), high.tolist())] == [x for e in want for x in e.offsets]


def test_a_repeated_piece_is_looked_up_once_a_batch(monkeypatch):
    """The cost of a batch follows its distinct pieces; each occurrence was looked up before."""
    asked, model, find = [], Encoder(PATH), encoder.Memory.find
    monkeypatch.setattr(encoder.Memory, "find", lambda memory, pieces: (asked.append(len(pieces)), find(memory, pieces))[1])
    texts = ["again and again, " * 1000, "", "again"]
    ids, cuts, _, _ = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [e.ids for e in MODEL.encode_batch(texts, add_special_tokens=False)]
    assert max(asked) == 5  # "again", " and", " again", "," and the last blank


def test_memory_keeps_frequent_pieces(monkeypatch):
    """Generations change many times; ids stay those of the library, and a piece met in every batch is encoded once."""
    monkeypatch.setattr(encoder, "REMEMBERED", 50)
    model, learnt = Encoder(PATH, offsets=True), []
    learn = model._learn
    monkeypatch.setattr(model, "_learn", lambda pieces: (learnt.extend(pieces), learn(pieces)))
    for k in range(60):
        texts = [f"always {k}x{j} word{k * 7 + j}, here <|endoftext|>" if j % 9 == 0 else f"always {k}x{j} word{k * 7 + j}, here" for j in range(20)]
        ids, cuts, low, high = model.encode(texts)
        for j, e in enumerate(MODEL.encode_batch(texts, add_special_tokens=False)):
            assert ids[cuts[j]:cuts[j + 1]].tolist() == e.ids and list(zip(low[cuts[j]:cuts[j + 1]].tolist(), high[cuts[j]:cuts[j + 1]].tolist())) == e.offsets
    assert learnt.count("always") == 1 and learnt.count(" here") == 1
    assert 50256 in MODEL.encode("x <|endoftext|> y", add_special_tokens=False).ids


def test_repeated_ids_are_ordered_by_text(spark):
    rows = [(1, t) for t in "zebra apple mango kiwi fig".split()]
    for parts in (1, 5):
        got = tokens.token_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), fresh_path(spark, "tokens"), PATH).collect()
        want, at = [], 0
        for _, t in sorted(rows):
            ids = MODEL.encode(t, add_special_tokens=False).ids + [tokens.END_ID]
            want.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in got) == want


DOCS = [(5, "Hello, world! <|endoftext|> it's"), (2, None), (9, ""), (3, "  x\n\ny  "), (3, "again"), (None, "null id"), (7, "word " * 20000), (1, "É" * 300)]


def test_token_files(spark):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, start string")
    folder = fresh_path(spark, "tokens")
    got = tokens.token_table(docs, folder, PATH).collect()
    assert len(got) == len(DOCS)
    texts = {}
    for i, t in DOCS:
        texts.setdefault(i, []).append(MODEL.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = next(x for x in texts[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        assert r.start == at
        at += len(ids)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 2, 3, 3, 5, 7, 9]
    found = tokens.read(spark, folder, [5, 42])
    assert [r.doc_id for r in found.collect()] == [5]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    assert tokens.token_table(docs.limit(0), fresh_path(spark, "tokens"), PATH).collect() == []


def test_section_counts(spark):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS] + [(11, "a\n\n\nb\n", "c")], "doc_id long, text string, section string")
    rows = attribution.token_counts(docs, PATH).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in DOCS:
        if i != 3:
            assert sum(r.n_tokens for r in by[i]) == len(MODEL.encode(t or "", add_special_tokens=False).ids)
            assert sum(r.length for r in by[i]) == len(t or "")
            assert len(by[i]) == max(1, len((t or "").splitlines()))
    assert [(r.start, r.length) for r in sorted(by[11], key=lambda r: r.section)] == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert attribution.token_counts(docs.limit(0), PATH).collect() == []
    fields = attribution.token_counts(docs, PATH, fields=["section", "text"]).filter("doc_id = 5").orderBy("section").collect()
    assert [r.start for r in fields] == [0, 6] and sum(r.n_tokens for r in fields) == len(MODEL.encode("clash\n" + DOCS[0][1], add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.sets(st.integers(1, 40), max_size=6), st.sampled_from(["first", "last", "most"]))
def test_allotment_rules(sizes, cuts, rule):
    ends = np.cumsum(sizes)
    low, high = ends - sizes, ends
    starts = np.array([0, *sorted(cuts)])
    chosen, crossing = attribution.assign(low, high, starts, rule)
    for a, b, c, x in zip(low, high, chosen, crossing):
        where = [int(np.searchsorted(starts, p, "right") - 1) for p in range(a, max(b, a + 1))]
        want = {"first": where[0], "last": where[-1], "most": max(sorted(set(where)), key=where.count)}[rule]
        assert c == want and x == (where[0] != where[-1])


PAGES = [(1, "http://a/ü\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 200000), (5, "u", "other"), (None, "u", "<p>x</p>"),
         (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (9, "u", "<p>x</p>"), (9, "u", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    folder = fresh_path(spark, "warc")
    whole = warc.write(pages, folder, revisit_from=least)
    members = warc.normalise(whole, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(members).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        keeper = max(same, default=None) if len(data) >= least else None
        revisit = i is not None and keeper is not None and keeper != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got == sorted(want, key=str)
    for row in members.collect():  # every member is a gzip file of its own
        with warc.open_file(row.path, "r") as archive:
            data = archive.read()
        count = 0
        while data:
            unpack = zlib.decompressobj(31)
            record = unpack.decompress(data)
            assert record.startswith(b"WARC/1.1\r\n") and unpack.eof
            data = unpack.unused_data
            count += 1
        assert count == row.records
    assert warc.archive_pages(pages.limit(0), fresh_path(spark, "warc")).collect() == []
