"""Patches against a plain loop over windows."""

import random
import re

from millrace.operators import patches


def plain_place(source, search):
    need, lines = re.sub(r"\s", "", search), source.split("\n")
    n = search.count("\n") + 1
    for size in range(max(1, n - 3), n + 4) if need else ():
        for start in range(len(lines) - size + 1):
            if re.sub(r"\s", "", "".join(lines[start : start + size])) == need:
                return start, size
    return None


def test_fuzzy_places(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        line = lambda: r.choice(["", "", " ", "a", "b", " a b", "ab", "\tba ", "a "])
        source = "\n".join(line() for _ in range(r.randint(1, 14)))
        search = "\n".join(line() for _ in range(r.randint(1, 5)))
        rows.append((i, source, search))
    rows += [(900, "\n" * 20_000 + "x\ny" + "\n" * 20_000, "x y"), (901, "long line " * 100_000 + "\nend", "end"), (902, "", "a"), (903, "a", "")]
    got = {x["patch_id"]: (x["start"], x["size"]) for x in patches.fuzzy_places(spark.createDataFrame(rows, "patch_id int, source string, search string")).collect()}
    want = {i: p for i, s, q in rows if i != 900 and (p := plain_place(s, q))}
    assert got.pop(900) == (20_000, 2) and got == want and len(want) > 40


def test_operations(spark):
    text = "def f():\n    a = 1\n    b = 2\n\nend"
    files = spark.createDataFrame([("a", text, "x"), ("w", text.replace("\n", "\r\n"), "x"), ("null", None, "x"), ("empty", "", "x"), ("long", "\n".join(map(str, range(30))), "x")], "path string, text string, body string")
    cases = [
        ("a", "replace_body", 2, 3, None, "c\n  d\n\ne", None, "def f():\n    c\n      d\n\n    e\n\nend"), ("a", "insert_after", 1, 1, None, "x\n y", None, "def f():\nx\n y\n    a = 1\n    b = 2\n\nend"),
        ("a", "insert_before", 2, 3, None, "  x", None, "def f():\n    x\n    a = 1\n    b = 2\n\nend"), ("a", "delete", 2, 4, None, None, None, "def f():\nend"),
        ("a", "insert_at_line", 6, None, None, "tail  \n\n", None, text + "\ntail"), ("a", "insert_at_line", 7, None, None, "x", "range", None), ("a", "insert_at_line", 1, None, None, " x", None, " x\n" + text),
        ("a", "replace_string", None, None, "b = 2", "b = 3", None, text.replace("2", "3")), ("a", "replace_string", None, None, " = ", "", "ambiguous", None), ("a", "replace_string", None, None, "a=1\nb =2", "    z", None, "def f():\n    z\n\nend"),
        ("a", "replace_string", None, None, "nowhere", "", "not found", None), ("a", "replace_string", None, None, " \n", "", "not found", None), ("a", "replace_string", None, None, None, "", "not found", None),
        ("a", "create_file", None, None, None, "x", "file exists", None), ("new", "create_file", None, None, None, "x\ny", None, "x\ny"), ("null", "create_file", None, None, None, None, None, ""), ("new", "delete", 1, 1, None, None, "missing file", None), (None, "delete", 1, 1, None, None, "missing file", None),
        ("a", "delete", 0, 1, None, None, "range", None), ("a", "delete", 3, 2, None, None, "range", None), ("a", "delete", 5, 6, None, None, "range", None), ("a", "delete", None, None, None, None, "range", None), ("a", "edit", 1, 1, None, None, "operation", None), ("a", None, 1, 1, None, None, "operation", None),
        ("w", "replace_string", None, None, "a=1\r\nb =2", "    y\n    z", None, "def f():\r\n    y\r\n    z\r\n\r\nend"), ("w", "delete", 5, 5, None, None, None, "def f():\r\n    a = 1\r\n    b = 2\r\n"), ("empty", "replace_body", 1, 1, None, "x", None, "x"),
        ("long", "replace_body", 1, 25, None, "x", "incomplete", None), ("long", "replace_body", 1, 20, None, "x", None, "x\n" + "\n".join(map(str, range(20, 30)))),
    ]
    df = spark.createDataFrame([(i, *c[:6], "clash") for i, c in enumerate(cases)], "patch_id int, path string, operation string, first int, last int, search string, body string, text string")
    got = {x["patch_id"]: (x["error"], x["text"]) for x in patches.apply(files, df).collect()}
    assert {i: got[i] for i in got if got[i] != cases[i][6:]} == {} and len(got) == len(cases)
    assert patches.apply(files.limit(0), df.limit(0)).count() == 0
