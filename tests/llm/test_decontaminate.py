from hypothesis import given, settings
from hypothesis import strategies as st

from reposcope.llm import decontaminate as d

words = st.lists(st.sampled_from(["a", "b", "c", "é"]), max_size=40)


def brute(text, items):
    ws, hit, found = d.words_of(text), set(), set()
    for item, t in items:
        iw = d.words_of(t)
        m = min(d.WINDOW, len(iw))
        for s in range(len(iw) - m + 1 if m else 0):
            for at in range(len(ws) - m + 1):
                if ws[at : at + m] == iw[s : s + m]:
                    hit |= set(range(at, at + m))
                    found.add(str(item))
    return hit, found


@settings(max_examples=300, deadline=None)
@given(words, st.lists(words, max_size=4))
def test_search_matches_brute_force(text, items):
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    assert d.find([w.encode() for w in text], d.build_tables(items)) == brute(" ".join(text), items)


def test_words():
    assert d.words_of("A-bÉc 12_x\x7f") == ["a".encode(), "bÉc".encode(), b"12", b"x"]
    assert d.words_of(None) == []


def test_blocks_and_cases(spark):
    run = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, "x " + run.upper() + " y", 5), (2, None, 5), (3, "", 5), (1, run, 5), (None, "short item!", 5), (4, "w1 w2", 5)],
        "doc_id long, text string, hits int",
    )
    bench = spark.createDataFrame([(10, run), (9, "short  item"), (8, None), (7, "..."), (10, run)], "item_id long, text string")
    for size in (1 << 20, 40):
        rows = sorted((tuple(r) for r in d.scan(docs, bench, size).collect()), key=str)
        assert rows == sorted(
            [(1, 32, list(range(1, 31)), ["10"]), (2, 0, [], []), (3, 0, [], []), (1, 30, list(range(30)), ["10"]), (None, 2, [0, 1], ["9"]), (4, 2, [], [])], key=str)
        assert sorted(r.doc_id for r in d.clean(docs, bench, size).collect()) == [2, 3, 4]
    assert d.clean(docs, bench.limit(0)).count() == 6
    assert d.scan(docs.limit(0), bench).count() == 0
    assert d.clean(docs, bench).columns == docs.columns
