import random
import re

from pyspark.sql import functions as F

from reposcope.llm import line_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeated(ws):
    seen, cover = {}, set()
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                cover |= {i, i + 1, i + 2}
    return len(cover)


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeated(ws))


def texts():
    r = random.Random(5)
    out = [None, "", " \n\t ", "one", "a b c a b c", "a a a a a", "a a a", "x  y\x0bz\n\nx  y\x0bz\n x y z", "é #*$ ß|<>\r\né #*$ ß|<>", "\xa0 \x85 \x1c q"]
    for size in (5, 30, 300, 5000):
        out += [" ".join(r.choice("abcde") * r.randint(1, 2) + r.choice(["", "\n", "|"]) for _ in range(size)) for _ in range(3)]
    return out


def test_counts_match_brute_force(spark, monkeypatch):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {i: brute(t) for i, t, _ in rows}
    got = {r.doc_id: tuple(r)[1:6] for r in q.judge(docs).collect()}
    assert got == want
    # with too few bits for the positions every longer text takes the other way, and so do clashes
    for bits in (3, 62):
        monkeypatch.setattr(q, "_INDEX_BITS", bits)
        monkeypatch.setattr(q, "_INDEX", (1 << bits) - 1)
        got = {r.doc_id: r[1] for r in docs.select("doc_id", q.repeated_words(q.words_of(F.coalesce("text", F.lit("")))).alias("n")).collect()}
        assert got == {i: w[4] for i, w in want.items()}


def _bodies(n, tail=""):
    r = random.Random(3)
    return [" ".join(str(r.random()) for _ in range(60)) + tail for _ in range(n)]


def test_depleted_rows_are_rejected(spark):
    lines = ["\n".join(" ".join(f"menu{i}entry{j}" for j in range(7)) for i in range(9))]
    rows = [(i, f"{lines[0]}\n{'own text ' + str(i)}", "h") for i in range(1, 31)]
    rows += [(100 + i, b, "h") for i, b in enumerate(_bodies(5))]
    rows += [(200, lines[0].upper() + "\n", "other"), (None, rows[3][1], "h"), (7, rows[6][1], "h"), (300, rows[8][1], None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, _line string")
    got = [(r.doc_id, r.kept) for r in q.judge(docs).collect()]
    assert len(got) == len(rows)
    kept = {d for d, k in got if k}
    assert kept == {1, 100, 101, 102, 103, 104, 200, 300}
    assert sorted(r.doc_id for r in q.keep(docs).collect()) == sorted(kept)
    assert q.keep(docs).columns == docs.columns
    # the same rows once more change nothing: documents are counted, not rows
    assert {r.doc_id for r in q.judge(docs.union(docs)).collect() if r.kept} == kept
    assert q.judge(docs.limit(0)).count() == 0 and q.keep(docs.limit(0)).count() == 0


def test_copies_are_documents(spark):
    text = "\n".join(_bodies(1)[0][i : i + 150] for i in range(0, 900, 150))
    rows = [(i, text, "h") for i in range(200)] + [(1000 + i, text + "\nx", "few") for i in range(q.LINE_DOCS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in q.judge(docs).filter("kept").collect()} == {0, *range(1000, 1000 + q.LINE_DOCS)}


def test_long_notices_and_menus_of_equal_documents_go(spark):
    """No length of line and no likeness of the documents keeps a line that many of them hold."""
    notice = " ".join(f"clause{i}" for i in range(30))
    rows = [(i, f"{b}\n{notice}", "long") for i, b in enumerate(_bodies(60))]
    same = "\n".join(["Home | About", *_bodies(40)])
    rows += [(100 + i, same, "equal") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frequent = {(r._host, r._docs, r._first) for r in q.frequent_lines(docs).collect()}
    assert frequent == {("long", 60, 0), ("equal", 60, 100)}
    kept = {r.doc_id: r.text for r in q.keep(docs).collect()}
    assert kept == {i: b if i else f"{b}\n{notice}" for i, b in enumerate(_bodies(60))} | {100: same}


def test_frequent_lines_are_cut_from_kept_texts(spark):
    body = _bodies(30)
    notice = "\tAll  rights reserved\r"
    rows = [(i, f"Home | About\n{b}\n\n{notice}\n{notice.upper()}\nown {i}\n", "h") for i, b in enumerate(body)]
    rows += [(50, "Home | About\n" + body[0] + " other host", "o"), (60, body[1] + " no such line\n\n", "h"), (3, rows[3][1], "h"), (None, "home | about\n" + body[2], "h")]
    docs = spark.createDataFrame([(d, t, s, len(t), d, "c") for d, t, s in rows], "doc_id long, text string, source string, n_chars int, _cut long, `a.b` string")
    want = []
    for d, t, s in rows:
        if s == "h" and d != 0:
            t = "\n".join(x for x in t.split("\n") if " ".join(WORD.findall(x)).lower() not in ("home | about", "all rights reserved"))
        want.append((d, t, s, len(t), d, "c"))
    got = q.keep(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert want[4][1] == f"{body[4]}\n\nown 4\n" and want[0][1] == rows[0][1]


def test_no_python_on_the_path(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    for df in (q.judge(docs), q.keep(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
