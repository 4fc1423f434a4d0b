import hashlib
import html
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkscrub.llm import chat, covertree, extract
from sparkscrub.llm.dom import Page
from tests.llm.brute import Union


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(5, 12))
    for label in (0, 1, None):
        for b in base:
            for _ in range(25):
                v = (b + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.2, 0.3, 0.5])) * rng.choice([1, 1e-3, 50])
                rows.append((len(rows), [float(np.float32(x)) for x in v], label, "c"))
    n = len(rows)
    odd = [None, [0.0] * 12, [float("nan")] * 12, [], [1.0, 2.0], [1.0, 2.0], [None] + [1.0] * 11, [float("inf")] + [1.0] * 11]
    return rows + [(n + k, v, 0, "c") for k, v in enumerate(odd)] + [rows[0]]


@pytest.mark.parametrize("cell,sample", [(2048, 1024), (24, 48)])
def test_near_vectors(spark, cell, sample):
    rows = vectors()
    got = sorted(tuple(r) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, space string"), 0.93, cell, sample).collect())
    unit = []
    for i, v, label, _ in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append((label, np.array(v, float) / np.linalg.norm(np.array(v, float))) if good else None)
    union, links = Union(), [0] * len(rows)
    for a in range(len(rows)):
        union.find(rows[a][0])
        for b in range(a):
            if unit[a] and unit[b] and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.93:
                links[a] += 1
                links[b] += 1
                union.join(rows[a][0], rows[b][0])
    assert got == sorted((r[0], links[k], union.find(r[0]), union.find(r[0]) == r[0]) for k, r in enumerate(rows))
    assert sum(links) > 2000


def test_slices_of_a_label_meet_the_same_centres(spark, monkeypatch):
    given = spark.createDataFrame(vectors(5), "vec_id long, embedding array<float>, label int, space string")
    whole = sorted(tuple(r) for r in covertree.near_vectors(given, 0.93, 40, 60).collect())
    monkeypatch.setattr(covertree, "SLICE", 7)
    assert sorted(tuple(r) for r in covertree.near_vectors(given, 0.93, 40, 60).collect()) == whole


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.near_vectors(empty).collect() == []


PIECES = st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", "#", "a", " ", "user: ", ": ", "%", "%zz", "%FF", "$1", "\n</turn>\n", "<chat 0>\n", "é"]), max_size=8).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b\n", "### x", ""]), PIECES), min_size=1, max_size=40))
def test_round_trip(spark, turns):
    rows = [(k % 5, k, role, text, "clash") for k, (role, text) in enumerate(turns)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string"))
    for r in made.select("conv_id", "formatted", "loss_spans", chat.parse(made["formatted"]).alias("turns")).collect():
        own = [(role, text) for c, _, role, text, _ in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == own
        escaped = r.formatted.startswith("<chat 1>")
        assert escaped == any("### " in t or "</turn>" in t for _, t in own)
        spans = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        learnt = [t for role, t in own if role == "assistant"]
        assert len(spans) == len(learnt) and (escaped or spans == learnt)


def test_hostile_conversations(spark):
    """10,000 conversations of control strings, broken escapes and half turns come back as they were."""
    rng = random.Random(11)
    pieces = ["### ", "</turn>", "\n</turn>\n", "\n", "\\", "%", "%zz", "%4", "%E9", ": ", ":", "user", "a", " ", "### %zz: hi", "$1", "+", "<chat 1>\n"]
    rows = [(c, k, rng.choice(["user", "assistant", "%zz", "a%41", "### ", ": ", "+ ", "é\n"]), "".join(rng.choices(pieces, k=rng.randint(0, 7)))) for c in range(10_000) for k in range(rng.randint(1, 3))]
    rows.append((10_000, 0, "user", "x\n</turn>\n### %zz: hi"))
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    for r in made.select("conv_id", chat.parse(made["formatted"]).alias("turns")).toLocalIterator():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]


def test_chat_nulls_and_ties(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "x"), (2, 0, "assistant", "y" * 100000)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[1].loss_chars == 0 and got[1].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].loss_chars == 1 and got[2].loss_chars == 100000
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_digests_read_the_loss_mask(spark):
    """The learnt texts come from `formatted` by the stored spans, in escaped conversations too; other spans give other texts."""
    texts = ["\ufeffa \U0001f600 \u00e9", "", "x ### y </turn> \\\\### z\n"]
    rows = [(c, k, "assistant" if k % 2 else "us\u00e9r \U0001f600", t) for c, own in ((1, texts[:2]), (2, texts)) for k, t in enumerate(t for x in own for t in ("q", x))]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    for c, own in ((1, texts[:2]), (2, texts)):
        assert got[c] == (len("".join(own)), hashlib.sha256("".join(own).encode()).hexdigest())
    moved = made.withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('start', s.start - 1, 'length', s.length))"))
    assert all(r.loss_sha256 != got[r.conv_id][1] for r in chat.digests(moved).collect())


def test_reader_handles_broken_markup():
    page = Page("<!DOCTYPE html><html><head><title>t</title></head><body><p>one <b>two<p>three<br>four &amp;amp; &lt;x&gt;<ul><li>a<li>b</ul>tail<script>var a='<p>no</p>';</script>"
                "<!-- <p>no</p> --><table><tr><td>c<td>d</table><style>p{}</style><p title='a>b'>e</p><textarea>no</textarea></div>end")
    assert [t for _, t, _ in page.runs] == ["one two", "three four &amp; <x>", "a", "b", "tail", "c", "d", "e", "end"]
    assert Page("").runs == [] and [t for _, t, _ in Page("a < b <3 > c").runs] == ["a < b <3 > c"]
    assert Page("<p>" * 3000 + "x").runs[0][1] == "x" and Page("<div>" * 3000 + "x").runs[0][1] == "x"


def test_tree_decoding_is_consistent():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = 9
        parents = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        depths = np.zeros(n, int)
        for i in range(1, n):
            depths[i] = depths[parents[i]] + 1
        forest = extract.Forest(np.zeros((n, 1)), parents, depths, np.array([0, n]))
        p = rng.random(n) * 0.98 + 0.01
        kept = extract.decode(p, forest)
        assert kept[0] and all(kept[parents[i]] or not kept[i] for i in range(1, n))
        best = -np.inf
        for code in range(1 << n):
            bits = np.array([code >> i & 1 for i in range(n)], bool)
            if bits[0] and all(bits[parents[i]] or not bits[i] for i in range(1, n)):
                best = max(best, np.where(bits, np.log(p), np.log(1 - p)).sum())
        assert np.where(kept, np.log(p), np.log(1 - p)).sum() == pytest.approx(best)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = extract.fit(pages)
    source = ("<html><body><header><p>The Site</p></header><nav><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></nav><div class='cookie-banner'><p>We use cookies here.</p></div>"
              "<article><h1>A title</h1><p>Some&nbsp;first   words, that say &quot;much&quot; of what is to be said, and more.</p><p>A second paragraph. It goes on for a while, too, with words.</p></article>"
              "<div class='sidebar'><h3>Related</h3><ul><li><a href='/a'>Another story</a></ul></div><section class='comments'><div class='comment'><p>I did like this, it was good.</p></div></section>"
              "<form><label>Mail</label><input></form><footer>&copy; The Site</footer></body></html>")
    want = 'A title\nSome first words, that say "much" of what is to be said, and more.\nA second paragraph. It goes on for a while, too, with words.'
    odd = spark.createDataFrame([(1, "u", source, "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", "plain words only", "c"), (5, "u", "<script>x</script>", "c"), (1, "u", source, "c")],
                                "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract.extract(odd, model).collect()]
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (None, "plain words only", 16), (5, "", 0), (1, want, len(want))]
    assert extract.main_texts(odd.limit(0)).collect() == []
    rows = extract.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect()
    inside = [r for r in rows if all(w in r.html.split("<article>")[1].split("</article>")[0].replace("&amp;", "&") for w in r.text.split("\n")[0].split()[:3])]
    assert len(inside) > 0.99 * len(rows)


def _article(source: str) -> str:
    """The article of a given page read by patterns alone: comments out, block tags cut, other tags dropped, references decoded."""
    inner = re.sub(r"<!--.*?-->", "", source.split("<article>")[1].split("</article>")[0], flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|div|section|ul|ol|li|blockquote|pre|table|tr|td)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_every_block_of_every_page(spark):
    """Whole table: each page's text is its article, all blocks of it and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extract.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count() and [r.page_id for r in rows if r.text != _article(r.html)] == []


def test_sample_of_long_pages_is_bounded_and_there_is_always_a_model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    longer = pages.withColumn("html", F.concat("html", F.lit("<!--" + "x" * 70_000 + "-->")))
    sample = extract.sample_pages(longer, 10, 300_000)
    assert 1 <= len(sample) <= 4 and sum(map(len, sample)) <= 300_000 and extract.sample_pages(longer.union(longer), 10, 300_000) == sample
    assert extract.sample_pages(longer, 10, 1000) == []
    for chars in (300_000, 1000):  # four long pages, then none: layouts of the stand-in text
        rows = extract.extract(longer, extract.fit(longer, 10, chars)).join(longer.select("page_id", "html"), "page_id").collect()
        menus = [r.html.split("<nav>")[1].split("</a>")[0].split(">")[-1] for r in rows]
        assert not [1 for r, menu in zip(rows, menus) if menu in r.text.split("\n")]
        right = sum(r.text == _article(r.html) for r in rows)
        assert right == len(rows) if chars > 1000 else right > len(rows) / 2


def test_unmatched_tags_take_linear_time():
    for source in ("<div></table>" * 80_000, "<td><p><td>" + "<ul>" * 60_000, "<noscript>x" * 90_000, "<li><div>" * 50_000):
        start = time.process_time()
        Page(source)
        assert time.process_time() - start < 5


@pytest.mark.parametrize("leaf", [1, 9, 400, 4096])
@pytest.mark.parametrize("dim", [2, 8, 64])
def test_dual_traversal_finds_every_link(monkeypatch, dim, leaf):
    """Weighted link counts and the forest of one cell with itself and of two cells, against all cosines."""
    monkeypatch.setattr(covertree, "LEAF", leaf)
    rng = np.random.default_rng(dim)
    for same in (True, False):
        base = rng.normal(size=(6, dim))
        cells = [base[rng.integers(6, size=k)] + rng.normal(size=(k, dim)) * rng.choice([0.01, 0.1, 0.4], size=(k, 1)) for k in (150, 110)]
        a, b = (cells[0], cells[0]) if same else cells
        weight_a = rng.integers(1, 4, len(a)).astype(float)
        weight_b = weight_a if same else rng.integers(1, 4, len(b)).astype(float)
        tree = covertree.tree_of(covertree._unit(a))
        links_a, links_b, edges = covertree.dual_links(tree, tree if same else covertree.tree_of(covertree._unit(b)), same, a, b, weight_a, weight_b, 0.93)
        hit = covertree._unit(a) @ covertree._unit(b).T >= 0.93
        if same:
            np.fill_diagonal(hit, False)
        assert np.array_equal(links_a, hit @ weight_b) and (same or np.array_equal(links_b, hit.T @ weight_a))
        linked, meant = Union(), Union()
        name = lambda y: int(y) if same else f"b{int(y)}"
        assert all(hit[x, y] for x, y in edges)
        for union, pairs in ((linked, edges), (meant, np.argwhere(hit).tolist())):
            for x, y in pairs:
                union.join(*sorted((str(x), str(name(y)))))
        assert all(linked.find(str(x)) == meant.find(str(x)) for x in range(len(a)))
