"""Typed symbols, calls, imports and complexity of source files.

Names, calls and complexity are Column functions (gneiss.functions.text), and so are typed symbols: their rules are a table
of patterns; a text's parts between the matches of one, and line breaks counted in them, give each match its line. Where
braces nest, a symbol's last line and the symbol around it come from the running depth of braces outside strings and
comments. Only Python's syntax trees are read in Arrow-batched tasks."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import fixed, text
from gneiss.schema import SYMBOLS

# Rules by language: kind, pattern, group of the name, group of the parent, signature (with groups), names left out.
_JS_CONTROL, _C_CONTROL = ["if", "else", "for", "while", "switch", "return"], ["if", "while", "for", "switch", "return"]
RULES = {
    "python": [
        ("class", r"class\s+(\w+)(?:\s*\(\s*([\w,\s]+)\s*\))?\s*:", 1, 2, "", ()),
        ("function", r"def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*[\w\[\], ]+)?\s*:", 1, 0, "def {1}({2})", ()),
        ("function", r"async\s+def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*[\w\[\], ]+)?\s*:", 1, 0, "async def {1}({2})", ()),
        ("import", r"(?m)^(?:from\s+([\w.]+)\s+)?import\s+(.+)", 2, 0, "", ()),
    ],
    "javascript": [
        ("class", r"class\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{", 1, 2, "", ()),
        ("function", r"(?:function\s+)?(\w+)\s*\(([^)]*)\)\s*\{", 1, 0, "{1}({2})", _JS_CONTROL),
        ("function", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", 1, 0, "", ()),
        ("import", r"import\s+(\{[^}]+\}|\*\s+as\s+\w+|\w+)\s+from\s+['\"]([^'\"]+)['\"]", 1, 0, "", ()),
    ],
    "java": [
        ("class", r"(?:public|private|protected|static)?\s*(?:class|interface)\s+(\w+)", 1, 0, "", ()),
        ("method", r"(?:public|private|protected|static|final|synchronized)?\s*[\w<>\[\]]+\s+(\w+)\s*\(([^)]*)\)", 1, 0, "{1}({2})", ()),
        ("import", r"import\s+([\w.]+)(?:\.\*)?;", 1, 0, "", ()),
    ],
    "cpp": [
        ("class", r"(?:class|struct)\s+(\w+)", 1, 0, "", ()),
        ("function", r"(?:void|int|bool|std::\w+|auto)\s+(\w+)\s*\(([^)]*)\)\s*(?:const)?\s*\{", 1, 0, "{1}({2})", _C_CONTROL),
        ("import", r"#include\s+[<\"]([^\">]+)[>\"]", 1, 0, "", ()),
    ],
    "go": [
        ("function", r"func\s+(?:\([^)]+\)\s*)?(\w+)\s*\(([^)]*)\)", 1, 0, "func {1}({2})", ()),
        ("method", r"func\s+\(([^)]+)\)\s*(\w+)\s*\(([^)]*)\)", 2, 1, "func ({1}) {2}({3})", ()),
        ("class", r"type\s+(\w+)\s+(?:struct|interface)", 1, 0, "", ()),
    ],
    "rust": [
        ("function", r"fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)", 1, 0, "fn {1}({2})", ()),
        ("class", r"struct\s+(\w+)", 1, 0, "", ()),
        ("class", r"impl\s+(?:<[^>]+>\s+)?(\w+)", 1, 0, "", ()),
        ("import", r"use\s+([\w:]+)(?:\s+as\s+(\w+))?", 1, 0, "", ()),
    ],
    "": [
        ("function", r"(?:function|def|func|fn)\s+(\w+)", 1, 0, "", ()),
        ("class", r"(?:class|struct|interface|type)\s+(\w+)", 1, 0, "", ()),
    ],
}
RULES["typescript"], RULES["c"] = RULES["javascript"], RULES["cpp"]
#: A pattern of a block of Go imports, and of each within it.
_GO_IMPORTS, _GO_IMPORT = r"import\s*(?:\(([^)]*)\)|\{([^}]*)\}|(\"[^\"]+\"))", r"\"([^\"]+)\""
#: Names and blanks of any script, lines that end at a line feed alone.
_FLAGS = "(?Ud)"


def _once(value: Column, use) -> Column:
    """use(value), with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _breaks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n")))


def matches(code: Column, pattern: str) -> Column:
    """at (characters before it), line and m, its text, of each match of a pattern, which may span lines."""
    p = F.lit(_FLAGS + pattern)
    both = F.struct(F.split(code, _FLAGS + pattern, -1).alias("gaps"), F.regexp_extract_all(code, p, F.lit(0)).alias("all"))

    def placed(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast("array<struct<at:int,line:int,m:string>>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            gap, m = F.get(x["gaps"], i), F.get(x["all"], i)
            at, line = s["at"] + F.length(gap), s["line"] + _breaks(gap)
            here = F.struct(at.alias("at"), line.alias("line"), m.alias("m"))
            return F.struct((at + F.length(m)).alias("at"), (line + _breaks(m)).alias("line"), F.concat(s["out"], F.array(here)).alias("out"))

        every = F.when(F.size(x["all"]) > 0, F.sequence(F.lit(0), F.size(x["all"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(every, start, step, lambda s: s["out"])

    return _once(both, placed)


def _group(m: Column, pattern: str, n: int) -> Column:
    """A group of a match, null where it took no part."""
    return F.nullif(F.regexp_extract(m, _FLAGS + pattern, n), F.lit(""))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _signature(form: str, m: Column, pattern: str) -> Column:
    parts = re.split(r"\{(\d)\}", form)
    return F.concat(*(F.lit(x) if i % 2 == 0 else _strip(F.coalesce(_group(m, pattern, int(x)), F.lit(""))) for i, x in enumerate(parts)))


def _import_names(language: str, m: Column, pattern: str) -> Column:
    if language == "python":
        return F.transform(F.split(_group(m, pattern, 2), ","), lambda x: F.substring_index(_strip(x), " as ", 1))
    if language in ("javascript", "typescript"):
        inner = F.regexp_replace(_group(m, pattern, 1), r"^[{}]+|[{}]+$", "")
        return F.transform(F.split(inner, ","), lambda x: _strip(F.substring_index(_strip(x), " as ", -1)))
    if language == "rust":
        return F.array(F.coalesce(_group(m, pattern, 2), F.substring_index(_group(m, pattern, 1), "::", -1)))
    return F.array(_group(m, pattern, 1))


#: A symbol, and for its extent: at, the characters before it, from, where its body is looked for, and bare, whether only blanks may come before the body.
_FIELDS = "name:string,type:string,start_line:int,end_line:int,parent:string,signature:string,at:int,from:int,bare:boolean"


def _symbol_column(name: Column, kind: str, x: Column, line: Column | None = None, parent: Column | None = None, signature: Column | None = None, bare: bool = False) -> Column:
    null = F.lit(None).cast("string")
    body = x["at"] + F.length(x["m"]) - F.when(F.endswith(x["m"], F.lit("{")), 1).otherwise(0)
    values = [name, F.lit(kind), x["line"] if line is None else line, F.lit(0), null if parent is None else parent, null if signature is None else signature, x["at"], body, F.lit(bare)]
    return F.struct(*(v.cast(t).alias(n) for v, (n, t) in zip(values, (f.split(":") for f in _FIELDS.split(",")), strict=True)))


def _by_rule(code: Column, language: str, rule: tuple) -> Column:
    kind, pattern, name_group, parent_group, signature, left_out = rule
    found = matches(code, pattern)
    if kind == "import":
        names = lambda x: F.filter(_import_names(language, x["m"], pattern), lambda n: n != "")
        return F.flatten(F.transform(found, lambda x: F.transform(names(x), lambda n: _symbol_column(n, kind, x))))
    name = lambda x: _group(x["m"], pattern, name_group)
    if left_out:
        found = F.filter(found, lambda x: ~name(x).isin(list(left_out)))
    if kind == "method" and language == "java":
        found = F.filter(found, lambda x: ~F.rlike(name(x), F.lit(r"^\p{Lu}")))
    shown = (lambda x: F.concat(F.lit("impl_"), name(x))) if pattern.startswith("impl") else name
    return F.transform(found, lambda x: _symbol_column(shown(x), kind, x, parent=_group(x["m"], pattern, parent_group) if parent_group else None, signature=_signature(signature, x["m"], pattern) if signature else None, bare=pattern.endswith("=>")))


def _symbols_with_places(code: Column, language: str) -> Column:
    parts = [_by_rule(code, language, rule) for rule in RULES[language]]
    if language == "go":
        inner = lambda b: F.transform(matches(b["m"], _GO_IMPORT), lambda x: _symbol_column(_group(x["m"], _GO_IMPORT, 1), "import", b, line=b["line"] + x["line"] - 1))
        parts.append(F.flatten(F.transform(matches(code, _GO_IMPORTS), inner)))
    return F.concat(*parts)


def _cases(language: Column, of) -> Column:
    return text.by_language(language, {k: of(k) for k in RULES if k}, of(""))


def typed_symbols(code: Column, language: Column, dedupe: bool = False) -> Column:
    """All symbols of a text, rule by rule; dedupe: one for each name, type and line."""
    code = F.coalesce(code, F.lit(""))
    found = _cases(language, lambda k: _symbols_with_places(code, k))
    plain = F.transform(found, lambda s: F.struct(*(s[c].alias(c) for c in ("name", "type", "start_line", "end_line", "parent", "signature"))))
    if not dedupe:
        return plain
    key = lambda s: F.struct(s["name"], s["type"], s["start_line"])
    return _once(plain, lambda every: F.filter(every, lambda s, i: F.array_position(F.transform(every, key), key(s)) == i + 1))


#: What braces and ends of statements are looked for outside of, by language: strings, characters and comments. In Rust a quote may also begin a lifetime.
_QUOTED = {
    "javascript": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`|//[^\n]*|/\*[\s\S]*?\*/",
    "java": r"\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*[\s\S]*?\*/",
    "cpp": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*[\s\S]*?\*/",
    "go": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/",
    "rust": r"\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\.[^'\n]*|[^'\\\n])'|//[^\n]*|/\*[\s\S]*?\*/",
}
_QUOTED["typescript"], _QUOTED["c"] = _QUOTED["javascript"], _QUOTED["cpp"]


def _braces(code: Column, language: str) -> Column:
    """at, line, m and depth (behind it) of each brace and semicolon outside strings and comments."""
    kept = F.filter(matches(code, _QUOTED[language] + r"|[{};]"), lambda x: x["m"].isin("{", "}", ";"))

    def deeper(x: Column) -> Column:
        return F.when(x["m"] == "{", 1).when(x["m"] == "}", -1).otherwise(0)

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + deeper(x)
        return F.struct(depth.alias("depth"), F.concat(s["out"], F.array(F.struct(x["at"], x["line"], x["m"], depth.alias("depth")))).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<at:int,line:int,m:string,depth:int>>").alias("out"))
    return F.aggregate(kept, start, step, lambda s: s["out"])


def nested_symbols(code: Column, language: Column) -> Column:
    """typed_symbols with end_line and parent, for languages whose bodies are in braces (others: no symbols).

    end_line is the line of the brace that closes the body, the first line where there is none, the last of the text where it
    stays open. parent is the receiver of a Go method, else the name of the innermost symbol whose body it is in."""
    code = F.coalesce(code, F.lit(""))

    def extents(found: Column, braces: Column, whole: Column) -> Column:
        def opened(s: Column) -> Column:
            first = F.get(F.filter(braces, lambda e: e["at"] >= s["from"]), F.lit(0))
            blank = F.rlike(F.substring(code, s["from"] + 1, first["at"] - s["from"]), F.lit(r"(?U)^\s*$"))
            return F.when((first["m"] == "{") & (~s["bare"] | blank) & (s["type"] != "import"), first)

        def with_body(s: Column) -> Column:
            return _once(opened(s), lambda o: F.struct(s.alias("s"), o.alias("o"), F.get(F.filter(braces, lambda e: (e["at"] > o["at"]) & (e["m"] == "}") & (e["depth"] == o["depth"] - 1)), F.lit(0)).alias("c")))

        def shown(every: Column) -> Column:
            def one(x: Column) -> Column:
                s = x["s"]
                around = F.filter(every, lambda p: (p["o"]["at"] < s["at"]) & (F.coalesce(p["c"]["at"], F.length(code)) > s["at"]))
                inner = F.array_max(F.transform(around, lambda p: F.struct(p["o"]["at"].alias("at"), p["s"]["name"].alias("name"))))["name"]
                end = F.when(x["o"].isNull(), s["start_line"]).otherwise(F.coalesce(x["c"]["line"], whole))
                receiver = F.when((s["type"] == "method"), s["parent"])
                values = [s["name"], s["type"], s["start_line"], end, F.coalesce(receiver, inner), s["signature"]]
                return F.struct(*(v.alias(n) for v, n in zip(values, ("name", "type", "start_line", "end_line", "parent", "signature"), strict=True)))

            return F.transform(every, one)

        return _once(F.transform(found, with_body), shown)

    def of(k: str) -> Column:
        if k not in _QUOTED:
            return F.array().cast(SYMBOLS)
        both = F.struct(_symbols_with_places(code, k).alias("found"), _braces(code, k).alias("braces"))
        return _once(both, lambda x: extents(x["found"], x["braces"], _breaks(code) + 1)).cast(SYMBOLS)

    return _cases(language, of)


# Short rules, name in group 1, for texts without a syntax tree.
SHORT_RULES = {
    "python": [("class", r"class\s+(\w+)"), ("function", r"def\s+(\w+)\s*\("), ("import", r"(?:from\s+)?import\s+(\w+)")],
    "javascript": [("class", r"class\s+(\w+)"), ("function", r"(?:function|const|let|var)\s+(\w+)\s*="), ("import", r"import\s+.*\s+from\s+['\"](\w+)")],
}


def _symbol(name, kind, line, end=0, parent=None, signature=None) -> dict:
    return {"name": name, "type": kind, "start_line": line, "end_line": end, "parent": parent, "signature": signature}


def _by_short_rules(code: str, language: str) -> dict:
    """symbols only, each on one line."""
    found = []
    for kind, pattern in SHORT_RULES.get(language, []):
        for m in re.finditer(pattern, code):
            line = code.count("\n", 0, m.start()) + 1
            found.append(_symbol(m.group(1), kind, line, line))
    return {"symbols": found, "imports": [], "calls": []}


def parsed(code: str) -> dict:
    """symbols, imports, calls and error of a Python text by its syntax tree."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return _by_short_rules(code, "python") | {"error": str(e)}
    found, imports, calls = [], set(), set()

    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            inside = parent
            if isinstance(child, ast.ClassDef):
                found.append(_symbol(child.name, "class", child.lineno, child.end_lineno, parent))
                inside = child.name
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                found.append(_symbol(child.name, "method" if isinstance(node, ast.ClassDef) else "function", child.lineno, child.end_lineno, parent))
                inside = child.name
            elif isinstance(child, ast.Import):
                imports.update(a.name for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.update(f"{child.module or ''}.{a.name}".strip(".") for a in child.names)
            elif isinstance(child, ast.Call):
                target = child.func
                calls.add(target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else "")
            visit(child, inside)

    visit(tree, None)
    return {"symbols": found, "imports": sorted(imports), "calls": sorted(calls - {""}), "error": None}


def structure(files: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """files with symbols, imports, function_calls, ast_hash and complexity."""
    found = files.withColumn("symbols", typed_symbols(F.coalesce(F.col(code), F.lit("")), F.col(language)))
    imports = F.array_sort(F.array_distinct(F.transform(F.filter("symbols", lambda s: s["type"] == "import"), lambda s: s["name"])))
    return found.withColumns({"imports": imports, "function_calls": text.calls(F.col(code), F.col(language)), "ast_hash": F.md5(F.col(code).cast("binary")), "complexity": text.complexity(F.col(code))})


def parse(files: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """files with parsed: symbols with extent and parent, imports, calls and, where a Python text can't be parsed, the error in its row.

    Python rows go to tasks that read syntax trees; all others stay in the JVM."""
    kind = f"struct<symbols:{SYMBOLS},imports:array<string>,calls:array<string>,error:string>"

    @F.pandas_udf(f"symbols {SYMBOLS}, imports array<string>, calls array<string>, error string")
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(c or "") for c in codes], columns=["symbols", "imports", "calls", "error"])

    is_python = F.coalesce(F.col(language) == "python", F.lit(False))
    others = files.filter(~is_python)
    flat = typed_symbols(F.col(code), F.col(language))
    found = F.when(F.col(language).isin(list(_QUOTED)), nested_symbols(F.col(code), F.col(language))).otherwise(flat)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda s: s["type"] == "import"), lambda s: s["name"])))
    calls = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(code), F.lit("")), F.lit(_FLAGS + r"(\w+)\s*\("), F.lit(1))))
    by_rules = others.withColumn("parsed", F.struct(found.alias("symbols"), names.alias("imports"), calls.alias("calls"), F.lit(None).cast("string").alias("error")).cast(kind))
    return files.filter(is_python).withColumn("parsed", run(F.col(code)).cast(kind)).unionByName(by_rules)


def names_by_type(symbols: DataFrame) -> DataFrame:
    """type and its names from rows with a symbols column."""
    return symbols.select(F.explode("symbols").alias("s")).groupBy(F.col("s.type").alias("type")).agg(F.sort_array(F.collect_list("s.name")).alias("names"))


def counts_by_type(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.explode("symbols").alias("s")).groupBy(F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def match_lines(code: Column, pattern: str, group: int = 1) -> Column:
    """name and line of each match of a pattern, line by line, without leaving the JVM; for patterns that stay within a line."""
    lines = F.split(code, "\n", -1)

    def of_line(line: Column, i: Column) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), lambda n: F.struct(n.alias("name"), (i + 1).alias("line")))

    return F.flatten(F.transform(lines, of_line))


def supported(path: Column) -> Column:
    return F.coalesce(text.language_of(path).isin([k for k in RULES if k] + list(fixed.COMMENTS) + ["swift", "kotlin", "scala"]), F.lit(False))
