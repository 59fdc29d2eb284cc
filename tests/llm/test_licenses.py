import re
from math import log, sqrt

from reposcope.llm import licenses as q


def cosine(a, b):
    docs = [re.findall(q.TOKEN, t.lower()) for _, t in q.TEMPLATES]
    n = len(docs)
    idf = lambda t: log((1 + n) / (1 + sum(t in d for d in docs))) + 1
    va, vb = ({t: x.count(t) * idf(t) for t in set(x)} for x in (re.findall(q.TOKEN, s.lower()) for s in (a, b)))
    norm = lambda v: sqrt(sum(x * x for x in v.values()))
    return sum(va[t] * vb.get(t, 0) for t in va) / (norm(va) * norm(vb)) if va and vb else 0.0


def best(text):
    top = max(((cosine(text, t), -i) for i, (_, t) in enumerate(q.TEMPLATES)), default=(0, 0))
    return q.TEMPLATES[-top[1]][0] if top[0] >= q.SIMILAR else None


def test_templates_find_themselves(spark):
    rows = [(f"f{i}", t) for i, (_, t) in enumerate(q.TEMPLATES)]
    got = {r.path: (r.own, r.similarity) for r in q.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[f"f{i}"] == (n, 1.0) for i, (n, _) in enumerate(q.TEMPLATES))


def test_scores_match_plain_cosine(spark):
    texts = ["licensed under the apache license version 2.0 and more words here", "the licensed premises are open", "All rights reserved", "no such word",
             "Released under licence of nobody in particular MIT", "permission permission permission", "spdx-license-identifier: mit mit", "licen" * 50]
    rows = [(f"a/{i}", f"first line\n  {t}\t\nlast") for i, t in enumerate(texts)]
    got = {r.path: r.own for r in q.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"a/{i}": (best(t) if any(w in t.lower() for w in q.WORDS) else None) for i, t in enumerate(texts)}


def test_nearest_ancestor_and_cases(spark):
    mit, gpl, apache = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", mit), ("a.txt", "x"), ("d/a", None), ("d/e/LICENCE.md", gpl), ("d/e/f/g/h", "x"), ("d/e/f/own", apache), ("d/ef/h", "x"),
            (None, mit), (None, "x"), ("d/e/f/g/h", "x"), ("z/COPYING", "nothing"), ("z/y", ""), ("b/LICENSE", "x\n" + apache), ("b/NOTICE", gpl), ("b/c", "q")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, own int")
    got = sorted(((r.path, r.own, r.inherited, r.from_directory, r.licence) for r in q.scan(docs).collect()), key=str)
    want = [("LICENSE", "MIT", "MIT", "", "MIT"), ("a.txt", None, "MIT", "", "MIT"), ("d/a", None, "MIT", "", "MIT"), ("d/e/LICENCE.md", "GPL-3.0", "GPL-3.0", "d/e", "GPL-3.0"),
            ("d/e/f/g/h", None, "GPL-3.0", "d/e", "GPL-3.0"), ("d/e/f/own", "Apache-2.0", "GPL-3.0", "d/e", "Apache-2.0"), ("d/ef/h", None, "MIT", "", "MIT"),
            (None, None, None, None, None), (None, None, None, None, None), ("d/e/f/g/h", None, "GPL-3.0", "d/e", "GPL-3.0"), ("z/COPYING", None, "MIT", "", "MIT"),
            ("z/y", None, "MIT", "", "MIT"), ("b/LICENSE", "Apache-2.0", "Apache-2.0", "b", "Apache-2.0"), ("b/NOTICE", "GPL-3.0", "Apache-2.0", "b", "GPL-3.0"), ("b/c", None, "Apache-2.0", "b", "Apache-2.0")]
    assert got == sorted(want, key=str)
    assert q.scan(docs.limit(0)).count() == 0


def test_no_python_on_the_path(spark):
    docs = spark.createDataFrame([("a", "b")], "path string, text string")
    assert not re.search("Python|Arrow|Pandas", q.scan(docs)._jdf.queryExecution().toString())
