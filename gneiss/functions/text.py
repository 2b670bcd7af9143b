"""Column functions over source text: tokens, comments, languages, names, calls, complexity, sanitising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions import fixed

#: Identifiers end where a letter, digit or underscore of any script begins or ends.
_WORD = r"(?U)\b(?-U:[a-zA-Z_][a-zA-Z0-9_]*)\b"
TEXT_TOKENS = _WORD
CODE_TOKENS = _WORD + r"|\d+\.?\d*|[+\-*/=<>!&|]+"
#: To the end of the line by default; "to_end" strips to the end of the text.
_STRIP = {"line": {"#": r"#[^\n]*", "//": r"//[^\n]*"}, "to_end": {"#": r"(?s)#.*$", "//": r"(?s)//.*$"}}
_BLOCK = r"(?s:/\*.*?\*/)"


def by_language(language: Column | str, cases: dict[str, Column], otherwise: Column) -> Column:
    """The case of a row's language; language is a name or a column of names."""
    if isinstance(language, str):
        return cases.get(language, otherwise)
    return reduce(lambda acc, kv: F.when(language == kv[0], kv[1]).otherwise(acc), cases.items(), otherwise)


def strip_comments(code: Column, language: Column | str = "code", mode: str = "line") -> Column:
    def pattern(styles: str) -> str:
        return "|".join(_BLOCK if s == "/*" else _STRIP[mode][s] for s in styles.split())

    cases = {k: F.regexp_replace(code, pattern(s), "") for k, s in fixed.COMMENTS.items()} | {"text": code}
    return by_language(language, cases, F.regexp_replace(code, _STRIP[mode]["//"], ""))


def tokens(code: Column, language: Column | str = "code", mode: str = "line", fold_stop_words: bool = False) -> Column:
    """Lower-case tokens of two characters or more that aren't stop words of the language."""
    clean = strip_comments(F.lower(F.coalesce(code, F.lit(""))), language, mode)
    found = by_language(language, {"text": F.regexp_extract_all(clean, F.lit(TEXT_TOKENS), F.lit(0))}, F.regexp_extract_all(clean, F.lit(CODE_TOKENS), F.lit(0)))
    stops = {k: F.array(*(F.lit(x.lower() if fold_stop_words else x) for x in v)) for k, v in fixed.STOP_WORDS.items()}
    stop = by_language(language, stops, F.array().cast("array<string>"))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column, narrow: bool = False) -> Column:
    table = fixed.NARROW_LANGUAGES if narrow else fixed.LANGUAGES
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), extension(path))
    return F.coalesce(found, F.lit("text")) if narrow else found


def allowed_extension(path: Column) -> Column:
    return extension(path).isin(list(fixed.LANGUAGES))


def _glob(names: list[str]) -> str:
    return "^(?:" + "|".join("[^/]*" + n[1:].replace(".", r"\.") if n[0] == "*" else n.replace(".", r"\.") for n in names) + ")$"


def ignored(path: Column, narrow: bool = False) -> Column:
    """Whether a scan leaves path out: for a component that begins with a dot or is an ignored directory, or an ignored file name."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.try_element_at(parts, F.lit(-1))
    dirs = fixed.NARROW_IGNORED_DIRS if narrow else fixed.IGNORED_DIRS
    found = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | F.rlike(p, F.lit(_glob(dirs))))
    return F.coalesce(found if narrow else found | name.isin(fixed.IGNORED_FILES), F.lit(False))


def watch_ignored(path: Column) -> Column:
    """Whether a watch leaves path out: a dot name, an ignored suffix, or an ignored text anywhere in it."""
    name = F.substring_index(path, "/", -1)
    tests = [F.endswith(path, F.lit(p[1:])) if p[0] == "*" else F.contains(path, F.lit(p)) for p in fixed.WATCH_IGNORED]
    return reduce(Column.__or__, tests, F.startswith(name, F.lit(".")))


def names(code: Column, language: Column | str) -> Column:
    """Sorted distinct names that a language's patterns find."""
    cases = {k: F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p, _ in v)))) for k, v in fixed.NAME_PATTERNS.items()}
    return by_language(language, cases, F.array().cast("array<string>"))


def plain_symbols(code: Column) -> Column:
    """name and type for any language: functions, then classes, then imports, repeats kept."""
    return F.concat(*(_typed(code, p, t) for p, t in fixed.PLAIN_PATTERNS))


def _typed(code: Column, pattern: str, kind: str) -> Column:
    return F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))


def calls(code: Column, language: Column | str = "code") -> Column:
    """Sorted distinct names before an opening bracket."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(r"(\w+)\s*\("), F.lit(1))))
    return by_language(language, {"python": F.array_except(found, F.array(*map(F.lit, fixed.PYTHON_NOT_CALLS)))}, found)


def complexity(code: Column) -> Column:
    """1 + the number of branch marks, as plain substrings."""
    counts = [((F.length(code) - F.length(F.replace(code, F.lit(m)))) / len(m)).cast("int") for m in fixed.COMPLEXITY_MARKS]
    return reduce(Column.__add__, counts, F.lit(1))


def sanitised_query(query: Column, most: int = fixed.MAX_QUERY) -> Column:
    return F.regexp_replace(F.regexp_replace(F.substring(query, 1, most), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"^\s+|\s+$", "")


def sanitised_language(language: Column) -> Column:
    clean = F.lower(F.regexp_replace(language, "[^a-zA-Z0-9_-]", ""))
    return F.when(clean.isin(fixed.REQUEST_LANGUAGES), clean)


def preview(code: Column, most: int = 200) -> Column:
    return F.when(F.length(code) > most, F.concat(F.substring(code, 1, most), F.lit("..."))).otherwise(code)


def line_range(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start, end)


def repo_key(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def stripped_length(code: Column) -> Column:
    return F.length(F.regexp_replace(code, r"^\s+|\s+$", ""))


def hash_64(code: Column) -> Column:
    """The first 64 bits of the MD5, as an unsigned decimal."""
    return F.conv(F.substring(F.md5(code.cast("binary")), 1, 16), 16, 10)


def encoded_names(names: Column) -> Column:
    return F.to_json(names)


def decoded_names(encoded: Column) -> Column:
    return F.from_json(encoded, "array<string>")
