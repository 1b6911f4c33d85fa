import math
import re
from collections import Counter

from tidymill.llm import licences
from tidymill.llm.registry import REGISTRY


def brute(files):
    """Counter of (path, licence, origin, from_dir) by plain loops over dense vectors."""
    split = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())
    all_lines = [line for _, t in files for line in (t or "").split("\n")]
    df = Counter(w for line in all_lines for w in set(split(line)))
    vocabulary = {w for _, t in licences.TEMPLATES for w in split(t)}
    idf = lambda w: math.log((1 + len(all_lines)) / (1 + (df.get(w) or 1) if w in vocabulary else 2)) + 1
    vec = lambda t: {w: n * idf(w) for w, n in Counter(split(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(n, vec(t)) for n, t in licences.TEMPLATES]

    def match(unit):
        v = vec(unit)
        scores = [(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), n) for n, t in templates] if v else []
        top = max((s for s, _ in scores), default=0)
        return (top, min(n for s, n in scores if s > top - 1e-9)) if top >= 0.6 else (0, None)

    scanned, held = [], {}
    for path, text in files:
        lines = licences.lines_of(text or "")
        blocks, run = [], []
        for line in [*lines, ""]:
            if line.strip():
                run.append(line)
            else:
                blocks += [" ".join(run)] if len(run) > 1 else []
                run = []
        whole = match(" ".join(lines))
        score, name = min([whole, *map(match, lines + blocks)], key=lambda x: (-round(x[0], 9), x[1] or ""))
        scanned.append((path, name))
        if path is not None and name and (whole[1] or re.match(r"(?i)(licen[cs]e|copying|unlicense|notice)([.\-_]|$)", path.split("/")[-1])):
            held.setdefault(path.rsplit("/", 1)[0] if "/" in path else "", []).append((-round(score, 9), name))
    out = []
    for path, name in scanned:
        at, origin = None, "own" if name else "none"
        if not name and path is not None:
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            while True:
                if folder in held:
                    at, name, origin = folder, min(held[folder])[1], "inherited"
                    break
                if not folder:
                    break
                folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
        out.append((path, name, origin, at))
    return Counter(out)


def run(spark, files):
    df = spark.createDataFrame([(p, t, 1, "x") for p, t in files], "path string, text string, score int, dir string")
    return Counter((r.path, r.licence, r.origin, r.from_dir) for r in licences.scan(df).collect())


def test_headers_files_and_inheritance(spark):
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"
    files = [("/a/LICENSE", "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
             ("/a/x/code.py", "print(1)"), ("/a/x/y/z.py", apache + "\nimport os"), ("/a/x/y/COPYING", "This work is licensed under the GNU General Public License, version 3."),
             ("/a/x/y/w.py", "no licence here"), ("/b/c.py", "nothing"), ("top.txt", "words"), (None, "words"), (None, None), ("/b/d.txt", ""), ("/a/x/code.py", "print(1)"),
             ("/c/note.txt", "a poem of many words " * 30 + "\nReleased under the MIT License.\nmore of the poem"), ("/c/other.txt", "line " * 5000), ("/d/only.txt", "Licensed under CC BY-NC 4.0."), ("/d/e/f", None)]
    got = run(spark, files)
    assert got == brute(files)
    assert got[("/a/x/y/z.py", "Apache-2.0", "own", None)] == 1 and got[("/a/x/y/w.py", "GPL-3.0", "inherited", "/a/x/y")] == 1
    assert got[("/a/x/code.py", "MIT", "inherited", "/a")] == 2 and got[("/c/other.txt", None, "none", None)] == 1 and got[("/d/e/f", "CC-BY-NC-4.0", "inherited", "/d")] == 1
    assert licences.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = REGISTRY["op10_license_scans"][0](spark, sf).collect()
    files = [(f"/{r.source}/{r.doc_id // 1000}/{r.doc_id}.txt", r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter((r.path, r.licence, r.origin, r.from_dir) for r in rows) == brute(files)
    assert {r.licence for r in rows} >= {"MIT", "Apache-2.0"}
