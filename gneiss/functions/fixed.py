"""Extensions, ignored names, stop words and patterns that results depend on."""

# File extension and language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".sql": "sql",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".r": "r",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "cfg",
    ".txt": "text",
}

# The narrow scan's extensions and languages; anything else is text.
NARROW_EXTENSIONS = ["py", "rs", "js", "ts", "go", "java", "cpp", "c", "h", "md", "json", "yaml", "yml"]
NARROW_LANGUAGES = {".py": "python", ".rs": "rust", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".c": "c", ".h": "c", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}
NARROW_IGNORED_DIRS = ["target", "node_modules", "build", "dist"]

# Names that a scan leaves out, and files that it leaves out.
IGNORED_DIRS = [
    ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", "node_modules", "venv", ".venv", "env", ".env", "build",
    "dist", ".next", "out", "target", "Cargo.lock", "package-lock.json", ".idea", ".vscode", ".vs", ".gradle",
    "*.egg-info", "*.pyc", "*.pyo", "*.so", "*.o", "*.a", "*.lib", "*.dll", "*.exe", "*.dylib",
]
IGNORED_FILES = [
    ".gitignore", ".dockerignore", ".editorconfig", ".gitmodules", "LICENSE", "README", "package.json", "Cargo.toml",
    "go.mod", "go.sum", "requirements.txt", "pyproject.toml", "setup.py", "package-lock.json", "yarn.lock",
    "Pipfile.lock",
]

# What a watch leaves out.
WATCH_IGNORED = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "*.pyc", "*.pyo", "*.so", "*.o", "*.a", "*.lib", "build",
    "dist", ".next", "out", "target", ".idea", ".vscode", "*.egg-info", "*.whl", "*.tar.gz",
]

# Languages that a request may name.
REQUEST_LANGUAGES = [
    "python", "javascript", "typescript", "java", "cpp", "c", "go", "rust", "ruby", "php", "swift", "kotlin", "scala",
    "markdown", "json", "yaml", "xml", "html", "css", "sql", "bash", "shell",
]

# Stop words by language. Tokens are lower-cased, entries are compared as they are.
STOP_WORDS = {
    "python": ["def", "class", "if", "else", "elif", "for", "while", "try", "except", "import", "from", "as", "return", "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "True", "False", "None", "and", "or", "not", "in", "is"],
    "javascript": ["function", "const", "let", "var", "if", "else", "for", "while", "try", "catch", "return", "console", "log", "new", "class", "extends", "import", "from", "export", "default", "true", "false", "null", "undefined"],
    "typescript": ["function", "const", "let", "var", "if", "else", "for", "while", "try", "catch", "return", "console", "log", "new", "class", "extends", "import", "from", "export", "default", "true", "false", "null", "undefined", "interface", "type", "enum"],
    "java": ["public", "private", "protected", "static", "final", "class", "interface", "enum", "if", "else", "for", "while", "do", "try", "catch", "finally", "return", "void", "int", "String", "boolean", "true", "false", "null"],
    "cpp": ["int", "void", "char", "float", "double", "bool", "if", "else", "for", "while", "do", "try", "catch", "return", "class", "struct", "template", "namespace", "using", "true", "false", "nullptr"],
    "go": ["func", "package", "import", "const", "var", "type", "struct", "interface", "if", "else", "for", "switch", "case", "default", "return", "true", "false", "nil"],
    "rust": ["fn", "let", "mut", "const", "static", "struct", "enum", "trait", "impl", "if", "else", "for", "while", "loop", "match", "return", "true", "false"],
    "ruby": ["def", "class", "module", "if", "else", "elsif", "case", "when", "while", "until", "for", "begin", "rescue", "ensure", "return", "puts", "print", "true", "false", "nil"],
    "php": ["function", "class", "interface", "trait", "if", "else", "elseif", "for", "foreach", "while", "do", "switch", "case", "default", "return", "echo", "print", "var", "true", "false", "null"],
}

# Comment styles by language; // where none is named, nothing for text.
COMMENTS = {"python": "#", "ruby": "#", "javascript": "// /*", "typescript": "// /*", "java": "// /*", "cpp": "// /*", "go": "// /*", "rust": "// /*", "php": "// /* #"}

# Patterns of names by language (group 1) and their kinds.
NAME_PATTERNS = {
    "python": [(r"def\s+(\w+)", "function"), (r"class\s+(\w+)", "class"), (r"async\s+def\s+(\w+)", "function")],
    "javascript": [(r"function\s+(\w+)", "function"), (r"const\s+(\w+)\s*=", "const"), (r"let\s+(\w+)\s*=", "let"), (r"var\s+(\w+)\s*=", "var"), (r"class\s+(\w+)", "class")],
    "typescript": [(r"function\s+(\w+)", "function"), (r"const\s+(\w+)\s*=", "const"), (r"class\s+(\w+)", "class"), (r"interface\s+(\w+)", "interface"), (r"type\s+(\w+)", "type")],
    "java": [(r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?[\w<>\[\]]+\s+(\w+)\s*\(", "method"), (r"class\s+(\w+)", "class"), (r"interface\s+(\w+)", "interface")],
    "cpp": [(r"(?:void|int|bool|auto|const\s+auto)\s+(\w+)\s*\(", "function"), (r"(?:class|struct)\s+(\w+)", "class")],
    "go": [(r"func\s+(?:\([^)]+\)\s*)?(\w+)\s*\(", "function"), (r"type\s+(\w+)\s+(?:struct|interface)", "type")],
    "rust": [(r"fn\s+(\w+)", "function"), (r"struct\s+(\w+)", "struct"), (r"impl\s+(?:<[^>]+>\s+)?(\w+)", "impl")],
}
# Patterns that hold for any language, in this order.
PLAIN_PATTERNS = [(r"(?:fn|def|function|func)\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"), (r"(?:class|struct)\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"), (r"(?:import|from)\s+([a-zA-Z0-9_.]+)", "import")]

# Words that aren't calls in Python, and what complexity counts.
PYTHON_NOT_CALLS = ["if", "while", "for", "with", "assert", "return", "yield", "print", "len", "str", "int", "float", "list", "dict", "set", "open", "range", "enumerate", "zip"]
COMPLEXITY_MARKS = ["if", "elif", "else", "for", "while", "case", "&&", "||", "?"]

# Requests.
MAX_QUERY, MAX_STRICT_QUERY, MAX_FILE_BYTES, MAX_PATH = 1000, 500, 10 * 1024 * 1024, 4096
CHUNK_LINES, CHUNK_OVERLAP, MIN_CHUNK_CHARS = 50, 10, 10
