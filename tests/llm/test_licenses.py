"""Licence files, wrapped headers, inheritance, and the edge cases of the licence scan."""

from cellweave.llm import licenses

TEXT = dict(licenses.TEXTS)
PROSE = "The harbour of the old town lies open to the sea, and the boats of the fishers come and go with the tide."


def wrapped(text: str, lead: str, width: int = 8) -> str:
    out = []
    for paragraph in text.split("\n\n"):
        words = paragraph.split()
        out += [lead + " ".join(words[k : k + width]) for k in range(0, len(words), width)] + [lead.rstrip()]
    return "\n".join(out)


def scan(spark, rows):
    docs = spark.createDataFrame([*rows, *((1000 + k, f"prose/d{k}/f", PROSE) for k in range(60))], "doc_id long, path string, text string")
    return {r.doc_id: r for r in licenses.scan_licenses(docs).collect() if r.doc_id is None or r.doc_id < 1000}


def test_files_headers_and_inheritance(spark):
    body = "\n\n" + "\n".join(f"def step_{k}(a, b):\n    return a * {k} + b" for k in range(80))
    mit = "MIT License\n\nCopyright (c) 2020 Ada Example\n\n" + wrapped(TEXT["MIT"], "")
    got = scan(
        spark,
        [
            (1, "p/LICENSE", mit),
            (2, "p/src/deep/a.py", "import os\n\nprint(os.name)"),
            (3, "q/b.py", wrapped("Copyright 2019 The Example Authors\n\n" + TEXT["Apache-2.0"], " * ") + body),
            (4, "q/c.py", "print(1)"),
            (5, "b2/LICENSE.txt", "Copyright (c) 2001, Example\nAll rights reserved.\n\n" + wrapped(TEXT["BSD-2-Clause"], "")),
            (6, "b3/LICENSE.txt", "Copyright (c) 2001, Example\nAll rights reserved.\n\n" + wrapped(TEXT["BSD-3-Clause"], "")),
            (7, "g/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "\n\n".join([PROSE] * 50)),
            (8, "g/x/y.c", "int main;"),
            (9, "i/LICENSE", "Copyright 2000 Example\n\n" + wrapped(TEXT["ISC"], "")),
            (10, "alone/z", "no terms here"),
            (11, "h/k.c", wrapped(TEXT["GPL-3.0"], "// ") + body),
        ],
    )
    said = {k: (r.declared, r.is_license_file) for k, r in got.items()}
    assert said[1] == ("MIT", True) and got[1].cosine > 0.8
    assert said[3] == ("Apache-2.0", False)
    assert said[5] == ("BSD-2-Clause", True) and said[6] == ("BSD-3-Clause", True)
    assert said[7] == ("GPL-3.0", True) and said[9] == ("ISC", True) and said[11] == ("GPL-3.0", False)
    assert (got[2].declared, got[2].license, got[2].inherited_from, got[2].distance) == (None, "MIT", "p", 2)
    assert (got[8].license, got[8].distance) == ("GPL-3.0", 1)
    assert got[4].license is None and got[10].license is None


def test_edges(spark):
    rows = [(1, None, None), (2, "a/b", ""), (3, "a//c", "... --- ...\n\n\n"), (4, "a/d", "word " * 200_000), (5, "a/e", "Released under the MIT License."), (5, "a/e", "Released under the MIT License."), (None, "a/f", None)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'mine' license", "1 _dir2", "2 cosine")
    got = licenses.scan_licenses(docs)
    assert got.columns.count("license") == 1 and got.columns.count("cosine") == 1
    got = got.collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.license, r.declared) for r in got if r.license) == [(0, "MIT", None), (2, "MIT", None), (3, "MIT", None), (4, "MIT", None), (5, "MIT", "MIT"), (5, "MIT", "MIT")]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_templates_are_their_own_best(spark):
    own = [(licence, t) for licence, t in licenses.TEMPLATES]
    got = scan(spark, [(k, f"t{k}/x", t) for k, (_, t) in enumerate(own)])
    assert {k: got[k].declared for k in got} == {k: licence for k, (licence, _) in enumerate(own)}
