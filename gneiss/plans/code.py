"""Queries over source texts, with what they have to give as SQL.

The tables hold no source code, so each row of a small table gives a text by way of a template in which its key stands for
{k}; what an operator has to find in a template is stated beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import fixed, text
from gneiss.operators import chunks, symbols
from gneiss.plans.catalog import ORACLE_SQL, QUERIES, query, table

#: Language, template, and of each symbol that the language's rules find: name, type, line, parent, signature.
TEMPLATES = {
    "python": (
        "class Item{k}(Base, Other{k}):\n    def first_{k}(self, x):\n        return helper_{k}(len(x))\n\nasync def load_{k}(path) -> str:\n    pass\n\n"
        "def plain_{k}(a, b):\n    return a  # if and\nimport os, sys as s\nfrom pack.mod{k} import thing as t, other\n",
        [
            ("Item{k}", "class", 1, "Base, Other{k}", None),
            ("first_{k}", "function", 2, None, "def first_{k}(self, x)"),
            ("load_{k}", "function", 5, None, "def load_{k}(path)"),
            ("load_{k}", "function", 5, None, "async def load_{k}(path)"),
            ("plain_{k}", "function", 8, None, "def plain_{k}(a, b)"),
            *((x, "import", 10, None, None) for x in ("os", "sys")),
            *((x, "import", 11, None, None) for x in ("thing", "other")),
        ],
    ),
    "javascript": (
        "import { alpha{k} as a{k}, beta } from 'mod'\nimport def{k} from \"other\"\nclass Widget{k} extends Base{k} {\n  render(x, y) {\n    if (x) {\n      return call{k}(y)\n    }\n  }\n}\n"
        "function top{k}(a) {\n}\nconst arrow{k} = async (b) => b\n/* if\n else */",
        [
            ("a{k}", "import", 1, None, None),
            ("beta", "import", 1, None, None),
            ("def{k}", "import", 2, None, None),
            ("Widget{k}", "class", 3, "Base{k}", None),
            ("render", "function", 4, None, "render(x, y)"),
            ("top{k}", "function", 10, None, "top{k}(a)"),
            ("arrow{k}", "function", 12, None, None),
        ],
    ),
    "java": (
        "import java.util.List;\nimport java.io.*;\npublic class Shop{k} {\n    private int count{k}(String name, int n) {\n        return n; // while\n    }\n    public Shop{k}(int n) { }\n}\ninterface Open{k} { }\n",
        [
            ("java.util.List", "import", 1, None, None),
            ("java.io", "import", 2, None, None),
            ("Shop{k}", "class", 3, None, None),
            ("count{k}", "method", 4, None, "count{k}(String name, int n)"),
            # The blank before a class belongs to its match, so one without a modifier counts from the line before.
            ("Open{k}", "class", 8, None, None),
        ],
    ),
    "cpp": (
        '#include <vector>\n#include "own{k}.h"\nstruct Point{k} {\n};\nint area{k}(int w, int h) {\n  while (w) { }\n  return w;\n}\nclass Shape{k};\n',
        [
            ("vector", "import", 1, None, None),
            ("own{k}.h", "import", 2, None, None),
            ("Point{k}", "class", 3, None, None),
            ("area{k}", "function", 5, None, "area{k}(int w, int h)"),
            ("Shape{k}", "class", 9, None, None),
        ],
    ),
    "go": (
        'package main\nimport (\n\t"fmt"\n\t"os"\n)\ntype Node{k} struct {\n}\nfunc Plain{k}(a int) int {\n\treturn a\n}\nfunc (n *Node{k}) Walk{k}(d int) {\n}\n',
        [
            ("fmt", "import", 3, None, None),
            ("os", "import", 4, None, None),
            ("Node{k}", "class", 6, None, None),
            ("Plain{k}", "function", 8, None, "func Plain{k}(a int)"),
            ("Walk{k}", "function", 11, None, "func Walk{k}(d int)"),
            ("Walk{k}", "method", 11, "n *Node{k}", "func (n *Node{k}) Walk{k}(d int)"),
        ],
    ),
    "rust": (
        "use std::io::Read as R{k};\nuse crate::own{k};\nstruct Cell{k};\nimpl Cell{k} {\n    fn get{k}<T>(x: T) -> T { x }\n}\n",
        [
            ("R{k}", "import", 1, None, None),
            ("own{k}", "import", 2, None, None),
            ("Cell{k}", "class", 3, None, None),
            ("impl_Cell{k}", "class", 4, None, None),
            ("get{k}", "function", 5, None, "fn get{k}(x: T)"),
        ],
    ),
    "kotlin": (
        "func alpha{k} x\ntype Beta{k}\ndef gamma{k}\ninterface Delta{k}\n",
        [("alpha{k}", "function", 1, None, None), ("Beta{k}", "class", 2, None, None), ("gamma{k}", "function", 3, None, None), ("Delta{k}", "class", 4, None, None)],
    ),
}
TEMPLATES["typescript"] = ("interface Shape{k} {\n}\ntype Alias{k} = string\nfunction go{k}() {}\nconst c{k} = 1\n", [("go{k}", "function", 4, None, "go{k}()")])


def _literal(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, int) else "replace('" + x.replace("'", "''") + "', '{k}', k::VARCHAR)"


def _union(rows, names: str, keys: str = "SELECT c_custkey k FROM customer") -> str:
    """Each key with each row of literals."""
    return " UNION ALL ".join(f"SELECT k, {', '.join(f'{_literal(x)} AS {n}' for x, n in zip(r, names.split(), strict=True))} FROM ({keys})" for r in rows)


def _texts(spark, sf_dir, *languages: str) -> DataFrame:
    """k, language and code for each customer.

    A table of keys is a small file, which one task reads, while the work on the texts made of it is large: the keys are dealt over all tasks first."""
    made = [F.struct(F.lit(x).alias("language"), F.replace(F.lit(TEMPLATES[x][0]), F.lit("{k}"), F.col("k").cast("string")).alias("code")) for x in languages]
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    return keys.select("k", F.explode(F.array(*made)).alias("x")).select("k", "x.*")


def _register_typed(language: str, name: str) -> None:
    def run(spark, sf_dir):
        found = _texts(spark, sf_dir, language).select("k", F.explode(symbols.typed_symbols(F.col("code"), F.col("language"))).alias("s"))
        return found.select("k", "s.name", "s.type", "s.start_line", "s.parent", "s.signature")

    run.__name__, run.__doc__ = name, f"Symbols of {language} texts with type, first line, parent and signature."
    QUERIES[name] = run
    ORACLE_SQL[name] = _union(TEMPLATES[language][1], "name type start_line parent signature")


for _language, _name in (("python", "symbols_python"), ("javascript", "symbols_javascript"), ("java", "symbols_java"), ("cpp", "symbols_cpp"), ("go", "symbols_go"), ("rust", "symbols_rust"), ("kotlin", "symbols_generic"), ("typescript", "symbols_typescript")):
    _register_typed(_language, _name)

_NAMES = [
    ("python", "Item{k},first_{k},load_{k},plain_{k}"),
    ("javascript", "Widget{k},arrow{k},top{k}"),
    ("typescript", "Alias{k},Shape{k},c{k},go{k}"),
    ("java", "Open{k},Shop{k},count{k}"),
    ("cpp", "Point{k},Shape{k},area{k}"),
    ("go", "Node{k},Plain{k},Walk{k}"),
    ("rust", "Cell{k},get{k}"),
    ("kotlin", ""),
]


@query(_union(_NAMES, "language names"))
def names_by_language(spark, sf_dir):
    found = _texts(spark, sf_dir, *(x for x, _ in _NAMES))
    return found.select("k", "language", F.array_join(text.names(F.col("code"), F.col("language")), ",").alias("names"))


_CALLS = [("python", "Item{k},first_{k},helper_{k},load_{k},plain_{k}"), ("javascript", "async,call{k},if,render,top{k}"), ("cpp", "area{k},while")]


@query(_union(_CALLS, "language calls"))
def calls_by_language(spark, sf_dir):
    """Python leaves out what isn't a call; others list every name before a bracket."""
    found = _texts(spark, sf_dir, *(x for x, _ in _CALLS))
    return found.select("k", "language", F.array_join(text.calls(F.col("code"), F.col("language")), ",").alias("calls"))


@query(_union([("Item{k}:class:1:3:,first_{k}:method:2:3:Item{k},load_{k}:function:5:6:,plain_{k}:function:8:9:", "os,pack.mod{k}.other,pack.mod{k}.thing,sys", "helper_{k},len", None)], "symbols imports calls error"))
def parsed_python(spark, sf_dir):
    """Symbols, imports and calls from the syntax tree."""
    return _parsed(_texts(spark, sf_dir, "python"))


def _parsed(files: DataFrame) -> DataFrame:
    line = lambda s: F.concat_ws(":", s["name"], s["type"], s["start_line"], s["end_line"], F.coalesce(s["parent"], F.lit("")))
    found = symbols.parse(files).select("k", "parsed.*")
    return found.select("k", F.array_join(F.transform("symbols", line), ",").alias("symbols"), F.array_join("imports", ",").alias("imports"), F.array_join("calls", ",").alias("calls"), "error")


@query(_union([("Item{k}:class:1:1:,first_{k}:function:2:2:,load_{k}:function:5:5:,plain_{k}:function:8:8:,os:import:10:10:,thing:import:11:11:", True)], "symbols failed").replace("replace('True'", "('True'"))
def parsed_by_rules(spark, sf_dir):
    """A Python text that has no syntax tree: short rules find its symbols, and the error stays in its row."""
    broken = _texts(spark, sf_dir, "python").withColumn("code", F.concat("code", F.lit("\n)")))
    return _parsed(broken).select("k", "symbols", F.col("error").isNotNull().alias("failed"))


@query(
    _union(
        [
            ("python", "os,other,sys,thing", "Item{k},first_{k},helper_{k},load_{k},plain_{k}", 2),
            ("cpp", "own{k}.h,vector", "area{k},while", 2),
        ],
        "language imports calls complexity",
    )
)
def file_structure(spark, sf_dir):
    """What analysing a file gives besides its symbols: imports, calls, complexity; the content hash is tested by chunk_windows."""
    found = symbols.structure(_texts(spark, sf_dir, "python", "cpp"))
    return found.select("k", "language", F.array_join("imports", ",").alias("imports"), F.array_join("function_calls", ",").alias("calls"), "complexity")


@query(f"""WITH s AS ({_union([(t, n) for t, n in (("class", "Item{k}"), ("function", "first_{k}"), ("function", "load_{k}"), ("function", "load_{k}"), ("function", "plain_{k}"), ("import", "os"), ("import", "sys"), ("import", "thing"), ("import", "other"))], "type name")})
SELECT type, count(*) n, md5(string_agg(name, ',' ORDER BY encode(name))) names_md5 FROM s GROUP BY type""")
def symbols_by_type(spark, sf_dir):
    rows = _texts(spark, sf_dir, "python").select(symbols.typed_symbols(F.col("code"), F.col("language")).alias("symbols"))
    return symbols.names_by_type(rows).select("type", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", ",")).alias("names_md5"))


@query("SELECT page_id, coalesce(lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN (" + ", ".join(f"'{k}'" for k, v in fixed.LANGUAGES.items() if v in {*(x for x in symbols.RULES if x), *fixed.COMMENTS, "swift", "kotlin", "scala"}) + "), false) AS supported FROM pages")
def language_supported(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", symbols.supported(F.col("url")).alias("supported"))


# Tokens

_TOKENS = [
    ("python", "item{k} base other{k} first_{k} self helper_{k} async load_{k} path -> pass plain_{k} os sys pack mod{k} thing other"),
    ("java", "import java util list import java io shop{k} count{k} string name shop{k} open{k}"),
    ("cpp", "include vector include own{k} point{k} area{k} shape{k}"),
    ("kotlin", "func alpha{k} type beta{k} def gamma{k} interface delta{k}"),
]


@query(_union(_TOKENS, "language tokens"))
def tokens_by_language(spark, sf_dir):
    """Tokens without the language's comments and stop words (compared as they are stated, so upper-case entries never match)."""
    found = _texts(spark, sf_dir, *(x for x, _ in _TOKENS))
    return found.select("k", "language", F.array_join(text.tokens(F.col("code"), F.col("language")), " ").alias("tokens"))


_COMMENTED = "a // one\nb # two\nc /* three\nfour */ d\n"
_STRIPPED = [
    *((x, "a // one\nb \nc /* three\nfour */ d\n") for x in ("python", "ruby")),
    *((x, "a \nb # two\nc  d\n") for x in ("javascript", "typescript", "java", "cpp", "go", "rust")),
    ("php", "a \nb \nc  d\n"),
    ("text", _COMMENTED),
    ("other", "a \nb # two\nc /* three\nfour */ d\n"),
]


@query(_union(_STRIPPED, "language code", "SELECT r_regionkey k FROM region"))
def strip_comments_by_language(spark, sf_dir):
    made = F.explode(F.array(*(F.lit(x) for x, _ in _STRIPPED))).alias("language")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), made).withColumn("code", F.lit(_COMMENTED))
    return rows.select("k", "language", text.strip_comments(F.col("code"), F.col("language")).alias("code"))


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g')), '//[^\n]*', '', 'g'),
'\b[a-zA-Z_][a-zA-Z0-9_]*\b|\d+\.?\d*|[+\-*/=<>!&|]+'), lambda t: length(t) >= 2), ' ')) tokens_md5 FROM documents""")
def tokenize_code_ascii(spark, sf_dir):
    """Code tokens of every text, characters beyond ASCII blanked, as the word borders of the SQL's engine are those of ASCII."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.tokens(plain), " ")).alias("tokens_md5"))


# Files and chunks


@query(r"SELECT page_id, coalesce(CASE lower(regexp_extract(url, '(\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.NARROW_LANGUAGES.items()) + r" END, 'text') AS narrow, lower(regexp_extract(url, '(\.[^./]+)$', 1)) IN (" + ", ".join(f"'{k}'" for k in fixed.LANGUAGES) + ") AS allowed FROM pages")
def language_from_path_narrow(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.language_of(F.col("url"), narrow=True).alias("narrow"), text.allowed_extension(F.col("url")).alias("allowed"))


def _paths() -> list[str]:
    """Paths with every ignored name as a folder, as a file, and within a longer name."""
    given = [n.replace("*", "x") for n in [*fixed.IGNORED_DIRS, *fixed.WATCH_IGNORED, *fixed.NARROW_IGNORED_DIRS]]
    return sorted({p for n in [*given, *fixed.IGNORED_FILES] for p in (f"{n}/a.py", f"src/{n}", f"src/{n}/b/c.py", f"src/my{n}y/c.py")} | {"src/a.py", ".hidden/a.py", "a/.b", "", "src/main.go"})


def _path_rows(ignored) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS path, {str(ignored(p)).lower()} AS ignored FROM region WHERE r_regionkey = 0" for p in _paths())


def _names_match(name: str, patterns: list[str]) -> bool:
    from fnmatch import fnmatchcase

    return any(fnmatchcase(name, p) for p in patterns)


def _scan_ignores(path: str, narrow: bool = False) -> bool:
    parts = [p for p in path.split("/") if p]
    if any(p[0] == "." or _names_match(p, fixed.NARROW_IGNORED_DIRS if narrow else fixed.IGNORED_DIRS) for p in parts):
        return True
    return not narrow and bool(parts) and parts[-1] in fixed.IGNORED_FILES


def _watch_ignores(path: str) -> bool:
    return path.rsplit("/", 1)[-1].startswith(".") or any(path.endswith(p[1:]) if p[0] == "*" else p in path for p in fixed.WATCH_IGNORED)


def _path_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, _paths()))).alias("path"))


@query(_path_rows(_scan_ignores))
def ignored_paths(spark, sf_dir):
    """Every ignored folder, pattern and file name that a scan knows."""
    return _path_table(spark, sf_dir).select("path", text.ignored(F.col("path")).alias("ignored"))


@query(_path_rows(lambda p: _scan_ignores(p, True)))
def ignored_paths_narrow(spark, sf_dir):
    return _path_table(spark, sf_dir).select("path", text.ignored(F.col("path"), narrow=True).alias("ignored"))


@query(_path_rows(_watch_ignores))
def watch_ignored_paths(spark, sf_dir):
    return _path_table(spark, sf_dir).select("path", text.watch_ignored(F.col("path")).alias("ignored"))


@query("""WITH l AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) ls FROM documents),
d AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END ls FROM l),
w AS (SELECT doc_id, (i + 1)::INT start_line, least(i + 50, len(ls))::INT end_line, array_to_string(ls[i+1:i+50], chr(10)) code FROM (SELECT doc_id, ls, unnest(range(0, len(ls), 40)) i FROM d))
SELECT doc_id, start_line, end_line, md5(code) ast_hash FROM w WHERE strlen(code) >= 10""")
def chunk_windows_narrow(spark, sf_dir):
    """Lines that end in either kind of break, no empty last line, and a least size in bytes."""
    found = chunks.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", drop_trailing=True, min_bytes=True)
    return found.select("doc_id", "start_line", "end_line", "ast_hash")


@query("SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT::VARCHAR AS file_hash FROM documents")
def file_hash_64(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.hash_64(F.col("text")).alias("file_hash"))


@query(r"""WITH w AS (SELECT doc_id, lang, (i + 1)::INT start_line, array_to_string(ls[i+1:i+50], chr(10)) code FROM (SELECT doc_id, lang, ls, unnest(range(0, len(ls), 40)) i
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) ls FROM documents))), ch AS (SELECT *, md5(code) h FROM w WHERE length(regexp_replace(code, '^\s+|\s+$', '', 'g')) >= 10)
SELECT doc_id, start_line, h ast_hash FROM ch WHERE h = (SELECT h FROM ch GROUP BY h ORDER BY count(*) DESC, h LIMIT 1) ORDER BY doc_id, start_line""")
def chunks_with_hash(spark, sf_dir):
    """The chunks of one content hash, here the most frequent one."""
    found = chunks.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    most = found.groupBy("ast_hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ast_hash").first()
    return chunks.with_hash(found, most["ast_hash"] if most else "", "doc_id").select("doc_id", "start_line", "ast_hash")


@query(_union([('["Item{k}","first_{k}","load_{k}","plain_{k}"]', 4)], "encoded n"))
def symbols_as_json(spark, sf_dir):
    """Names as JSON text and back."""
    found = _texts(spark, sf_dir, "python").select("k", text.encoded_names(text.names(F.col("code"), F.col("language"))).alias("encoded"))
    return found.select("k", "encoded", F.size(text.decoded_names(F.col("encoded"))).alias("n"))


@query(r"SELECT page_id, CASE WHEN length(html) > 100 THEN substr(html, 1, 100) || '...' ELSE html END preview, split_part(url, '/', 1) repo FROM pages")
def preview_short(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.preview(F.col("html"), 100).alias("preview"), text.repo_key(F.col("url")).alias("repo"))


@query("SELECT page_id, CASE WHEN x IN (" + ", ".join(f"'{x}'" for x in fixed.REQUEST_LANGUAGES) + r") THEN x END AS language FROM (SELECT page_id, lower(regexp_replace(regexp_extract(url, '\.([^./]*)$', 1), '[^a-zA-Z0-9_-]', '', 'g')) x FROM pages)")
def sanitize_language(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitised_language(F.regexp_extract("url", r"\.([^./]*)$", 1)).alias("language"))
