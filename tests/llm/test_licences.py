from quadlens.llm import licences


def test_headers_licence_files_and_inheritance(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n" \
          "documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [(1, "a/LICENSE", mit), (2, "a/x.py", "just some code"), (3, "a/b/c/y.py", "more code"), (4, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
            (5, "a/z.py", "text " * 3000 + "\n# This work is licensed under the GNU General Public License, version 3.\n" + "text " * 3000), (6, "q/r.py", "code"),
            (7, "a/only", "Released under the MIT License."), (8, "a/w.py", None), (9, None, "code"), (10, "a/v.py", ""), (None, "top.py", "my license plate is nice to look at today"),
            (2, "a/x.py", "just some code")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, path string, text string, cosine int, dir string")
    got = {r["doc_id"]: (r["own_licence"], r["licence_file"], r["licence"], r["licence_dir"]) for r in licences.licensed(df).collect()}
    assert got == {1: ("MIT", True, "MIT", None), 2: (None, False, "MIT", "a"), 3: (None, False, "Apache-2.0", "a/b"), 4: ("Apache-2.0", True, "Apache-2.0", None),
                   5: ("GPL-3.0", False, "GPL-3.0", None), 6: (None, False, None, None), 7: ("MIT", True, "MIT", None), 8: (None, False, "MIT", "a"),
                   9: (None, False, None, None), 10: (None, False, "MIT", "a"), None: (None, False, None, None)}
    assert licences.licensed(df).count() == len(rows) and licences.licensed(df.limit(0)).count() == 0


def test_cosine_as_by_hand():
    m = licences.Matcher(100, {"the": 90, "mit": 3, "license": 5, "released": 4, "under": 30})
    assert abs(m.best(licences.terms("Released under the MIT License!"))[0] - 1) < 1e-9
    assert m.best(licences.terms("the weather is fine"))[0] < 0.3
    assert m.scan("")[0] is None and m.scan("Released under\nthe MIT License.")[0] == "MIT"
