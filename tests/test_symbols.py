"""Symbols found in the JVM: positions against Python's own matching, extents against a plain parser with a stack."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.operators import symbols
from gneiss.plans import code as templates


def test_matches_over_lines(spark):
    rng = random.Random(3)
    pattern = r"(?:class|struct)\s+(\w+)|/\*[\s\S]*?\*/"
    texts = ["".join(rng.choice(["class ", "struct\n", "Ab", "é\U0001f600", "\n", "\r\n", " ", "/*", "*/", "x"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, code string").select("i", symbols.matches(F.col("code"), pattern).alias("m")).collect()
    for r in rows:
        code = texts[r["i"]]
        assert [(m["at"], m["line"], m["m"]) for m in r["m"]] == [(m.start(), code.count("\n", 0, m.start()) + 1, m.group()) for m in re.finditer(pattern, code)]


def test_no_python_worker(spark):
    rows = spark.createDataFrame([("class A {}", "java")], "code string, language string")
    for column in (symbols.typed_symbols(F.col("code"), F.col("language")), symbols.nested_symbols(F.col("code"), F.col("language"))):
        assert "Python" not in rows.select(column)._jdf.queryExecution().executedPlan().toString()


FORMS = {
    "java": (["public class {n} extends Base {{", "public interface {n} {{"], "    private int {n}(String s, int n) {{", "    int x = 1; // }} not this", 'String s = "{{";', "/* {{ */"),
    "javascript": (["class {n} extends Base {{"], "  {n}(a, b) {{", "  let x = '}}'; // {{", "const s = `{{\n{{`;", "/* }} */"),
    "cpp": (["class {n} {{", "struct {n} {{"], "int {n}(int a) {{", "char c = '}}';", 'auto s = "\\"{{";', "// {{"),
    "go": (["type {n} struct {{"], "func {n}(a int) int {{", "s := `}}\n}}`", 'x := "{{"', "// }}"),
    "rust": (["impl {n} {{"], "fn {n}<T>(x: T) -> T {{", "let c = '}}';", "let s: &'a str = \"{{\n{{\";", "/* {{ */"),
}


def text_of(rng, language):
    """A nested text, and name, first line, last line and parent of its symbols, written down while it is made."""
    outer, inner, *fillers = FORMS[language]
    lines, found, number = [], [], iter(range(1000))

    def put(line):
        lines.extend(line.format(n="").split("\n") if "{n}" not in line else line.split("\n"))

    def body(depth, parent):
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.6:
                form = rng.choice(outer) if rng.random() < 0.4 else inner
                name = f"{'T' if form in outer else 'f'}{next(number)}"
                shown = f"impl_{name}" if form.startswith("impl") else name
                start = len(lines) + 1
                lines.append(form.format(n=name))
                body(depth - 1, shown)
                lines.append("}")
                found.append((shown, start, len(lines), parent))
            else:
                put(rng.choice(fillers))

    body(3, None)
    return "\n".join(lines), found


@pytest.mark.parametrize("language", sorted(FORMS))
def test_extent_and_parent(spark, language):
    rng = random.Random(len(language))
    made = [text_of(rng, language) for _ in range(40)]
    rows = spark.createDataFrame([(i, code, language) for i, (code, _) in enumerate(made)], "i int, code string, language string")
    for r in rows.select("i", symbols.nested_symbols(F.col("code"), F.col("language")).alias("s")).collect():
        code, expected = made[r["i"]]
        # The blank before a symbol belongs to its match, so a first line may be the one before.
        got = {(s["name"], s["end_line"], s["parent"]) for s in r["s"] if s["type"] != "import"}
        assert got == {(name, end, parent) for name, _, end, parent in expected}, code
        starts = {name: start for name, start, *_ in expected}
        assert all(starts[s["name"]] - 1 <= s["start_line"] <= starts[s["name"]] for s in r["s"])


def test_bodies_that_are_missing_or_stay_open(spark):
    cases = [("cpp", "class A;\nclass B {\n int x;\n"), ("javascript", "const f = (a) => a\nfunction g(b) {\n}\nconst h = (c) =>\n{\n}\n"), ("go", "func (n *Node) Walk(d int) {\n}\n"), (None, "class A {\n}"), ("python", "class A:\n    pass\n")]
    rows = spark.createDataFrame([(i, x, c) for i, (x, c) in enumerate(cases)] + [(9, "java", None)], "i int, language string, code string")
    found = {r["i"]: [(s["name"], s["type"], s["start_line"], s["end_line"], s["parent"]) for s in r["s"]] for r in rows.select("i", symbols.nested_symbols(F.col("code"), F.col("language")).alias("s")).collect()}
    assert found[0] == [("A", "class", 1, 1, None), ("B", "class", 2, 4, None)]
    assert found[1] == [("g", "function", 2, 3, None), ("f", "function", 1, 1, None), ("h", "function", 4, 6, None)]
    assert ("Walk", "method", 1, 2, "n *Node") in found[2] and found[3] == found[4] == found[9] == []


def test_templates_still_hold(spark):
    for language, (code, expected) in templates.TEMPLATES.items():
        rows = spark.createDataFrame([(code.replace("{k}", "7"), language)], "code string, language string")
        found = rows.select(symbols.typed_symbols(F.col("code"), F.col("language")).alias("s")).first()["s"]
        plain = lambda x: x.replace("{k}", "7") if isinstance(x, str) else x
        assert sorted(((s["name"], s["type"], s["start_line"], s["parent"], s["signature"]) for s in found), key=str) == sorted((tuple(map(plain, e)) for e in expected), key=str), language


def test_texts_of_a_small_file_are_spread_over_tasks(spark, sf_dir):
    rows = templates._texts(spark, sf_dir, "java")
    assert len({r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert rows.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
