import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkscrub.llm import decontaminate as d
from tests.llm.brute import substring_distance


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90), st.integers(0, 6))
def test_myers_matches_the_table(pattern, text, errors):
    masks = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    best = d.edit_search(pattern, masks, text, errors)
    want = substring_distance(pattern, text)
    assert (best[0] if best else None) == (want if want <= errors and text else None)


def test_every_item_in_every_document(spark):
    rng = random.Random(5)
    sentence = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    items = [(i, sentence(rng.choice([8, 30, 90, 200]))) for i in range(12)] + [(50, None), (51, ""), (52, "  "), (53, "Short"), (54, "Short")]
    docs = []
    for i in range(60):
        item = items[i % 12][1]
        own = list(item)
        for _ in range(rng.randint(0, 2 + len(own) // 15)):
            own[rng.randrange(len(own))] = rng.choice(["", "x", "yy"])
        docs.append((i, sentence(50) + rng.choice([" ", "\n\n"]) + "".join(own).upper() + " " + sentence(40), "s", "clash"))
    docs += [(100, None, None, None), (101, "", "s", "s"), (102, "a short one", "s", "s"), (103, items[2][1] * 3, "s", "s"), (103, items[2][1] * 3, "s", "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, item_id string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.errors) for r in d.matches(frame, table).collect())
    want = []
    for i, text, *_ in docs:
        for j, item in items:
            a, b = d.normal(item), d.normal(text)
            if a and b and (e := substring_distance(a, b)) <= int(d.RATE * len(a)):
                want.append((i, j, e))
    assert got == sorted(want) and len({e for *_, e in got}) > 3
    kept = sorted(r.doc_id for r in d.clean(frame, table).collect())
    assert kept == sorted(i for i, *_ in docs if i not in {w[0] for w in want})
    assert d.clean(frame, table).columns == frame.columns
    assert d.matches(frame.limit(0), table).collect() == [] and d.clean(frame, table.limit(0)).count() == len(docs)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 60)
    items = spark.createDataFrame([(i, f"question number {i} of the test set") for i in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see Question  number 3 of the test set!"), (2, "nothing")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.matches(docs, items).filter("errors = 0").collect()] == [(1, 3)]


def test_items_without_an_id(spark):
    """A missing id disables no text: it is found with a null id, and `clean` drops the documents that hold it."""
    texts = ["the question of the ninth exam", "another long question of an exam"]
    items = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (4, texts[1]), (None, None), (None, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"see: {texts[0]}!"), (2, f"and {texts[1]}"), (3, "nothing")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id or 0, r.errors) for r in d.matches(docs, items).collect()) == [(1, 0, 0), (2, 0, 0), (2, 4, 0)]
    assert [r.doc_id for r in d.clean(docs, items).collect()] == [3]
    named = items.withColumn("item_id", F.lit("q-1"))  # ids that are no numbers
    assert [r.doc_id for r in d.clean(docs, named).collect()] == [3]
