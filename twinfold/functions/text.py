"""Text normalisation, tokens, grams and path predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges of scripts written without spaces (fixed values).
NOSPACE = r"฀-๿ᄀ-ᇿ぀-ヿ㄰-㆏㐀-䶿一-鿿가-힯豈-﫿"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def fold_width(c: Column) -> Column:
    """Full-width ASCII forms and the ideographic space become ASCII."""
    return F.translate(c, _WIDE, _ASCII)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


#: A white-space character of any script, in the syntax that Java and RE2 share.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Markdown syntax and what takes its place, in order: code, images and links (their text stays), inline code,
#: headings, quotes, list marks, emphasis, table rules, cell borders. A line ends at a line feed only.
MARKDOWN = (
    (r"(?s)```.*?```", " "),
    (r"!\[([^\]]*)\]\([^)]*\)", " $1 "),
    (r"\[([^\]]*)\]\([^)]*\)", " $1 "),
    (r"`[^`]*`", " "),
    (rf"(?dm)^#{{1,6}}{WS}+", ""),
    (rf"(?dm)^{WS}*>{WS}?", ""),
    (rf"(?dm)^{WS}*(?:[-*+]|\p{{Nd}}+\.){WS}+", ""),
    (r"\*\*|__|\*|_|~~", ""),
    (r"(?dm)^[ \t|:-]*-[ \t|:-]*$", " "),
    (r"\|", " "),
)


def normalize_text(c: Column, strip_markdown: bool = True) -> Column:
    """Lower-case text without Markdown syntax, widths folded, white space collapsed."""
    if strip_markdown:
        for pattern, by in MARKDOWN:
            c = F.regexp_replace(c, pattern, by)
    return F.trim(F.regexp_replace(F.lower(fold_width(c)), f"{WS}+", " "))


def normalize_sql(c: str) -> str:
    """The same in SQL for RE2."""
    for pattern, by in MARKDOWN:
        pattern, by = pattern.replace("(?dm)", "(?m)").replace("'", "''"), by.replace("$1", "\\1")
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace(lower(translate({c}, '{_WIDE}', '{_ASCII.replace(chr(39), chr(39) * 2)}')), '{WS}+', ' ', 'g'), ' ')"


def extract_code(c: Column) -> Column:
    """The contents of fenced blocks, one under the other."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    return F.array_join(F.transform(blocks, lambda x: F.trim(x)), "\n")


def words(c: Column) -> Column:
    """Maximal runs of ASCII letters, digits and anything beyond ASCII."""
    return F.regexp_extract_all(c, F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Words; a word that holds a character of a script without spaces is split
    into its characters."""
    ws = F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    one = lambda w: F.when(w.rlike(f"[{NOSPACE}]"), F.filter(F.split(w, ""), lambda x: x != "")).otherwise(F.array(w))
    return F.flatten(F.transform(ws, one))


def gram_size(c: Column) -> Column:
    """3 where more than 30 % of the letters are of a script without spaces, else 5."""
    letters = F.length(F.regexp_replace(c, r"(?U)[^\p{L}]", ""))
    dense = F.length(F.regexp_replace(c, f"[^{NOSPACE}]", ""))
    return F.when((letters > 0) & (dense * 100 > letters * 30), 3).otherwise(5)


def windows(xs: Column, n: int) -> Column:
    """All n neighbours as structs, by zipping n shifted slices: a lambda over
    positions would evaluate the expression behind `xs` once per position."""
    m = F.greatest(F.size(xs) - n + 1, F.lit(0))
    return F.arrays_zip(*(F.slice(xs, i + 1, m).alias(f"x{i}") for i in range(n)))


def char_ngrams(c: Column, n: int = 5) -> Column:
    """All windows of n characters; a shorter text is one gram, an empty one none."""
    size = F.length(c)
    grams = F.transform(windows(F.split(c, ""), n), lambda s: F.concat(*(s[f"x{i}"] for i in range(n))))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(c)).otherwise(grams)


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct windows of n tokens; a shorter non-empty list is one shingle."""
    win = F.transform(windows(tokens, n), lambda s: F.concat_ws(" ", *(s[f"x{i}"] for i in range(n))))
    size = F.size(tokens)
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(win))


def prose_words(norm: Column) -> Column:
    return F.size(F.filter(F.split(norm, " "), lambda x: x != ""))


def numbered_lines(c: Column) -> Column:
    """(line number from 1, trimmed text) of the lines that are not blank."""
    lines = F.transform(F.split(c, "\n"), lambda x, i: F.struct((i + 1).alias("no"), F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


# Lines that say nothing by themselves (fixed values).
_BARE = ("return", "break", "continue", "else", "else {", "};", "})", "});")


def is_trivial_line(c: Column) -> Column:
    """Blank, only delimiters, or a bare control keyword; of a trimmed line."""
    return c.rlike(r"^[{}()\[\];, \t]*\z") | c.isin(*_BARE)


def is_trivial_sql(c: str) -> str:
    return f"(regexp_full_match({c}, '[{{}}()\\[\\];, \\t]*') OR {c} IN ({', '.join(chr(39) + b + chr(39) for b in _BARE)}))"


# Where tests and where generated and foreign files lie, by common conventions (fixed values, of the path in lower case).
TEST_PATH = r"/(?:tests?|__tests__|spec)/|^tests?/|_test\.go$|conftest\.py$|[_.]test\.|[_.]spec\.|(?:^|/)test_[^/]*$"
FOREIGN_PATH = r"vendor/|third[_-]party/|/deps/|node_modules/|/dist/|/build/|\.min\.|\.pb\.|_pb2|\.g\.dart|\.d\.ts|generated/|/gen/|\.generated\."


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def is_test_site(path: Column, name: Column) -> Column:
    """A test by its path or by the name of the unit."""
    return is_test_path(path) | F.coalesce(name.startswith("Test") | name.startswith("test_"), F.lit(False))


def is_generated_path(path: Column) -> Column:
    """Vendored, generated and other files that are not the maintainer's to merge."""
    return F.lower(path).rlike(FOREIGN_PATH)


def is_dependency_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(node_modules|vendor|third_party|external|bower_components|site-packages|dist|build)/")


def module_of(path: Column) -> Column:
    """The parent folder, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


# Extension to language (fixed values).
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript",
        "mts": "typescript", "cts": "typescript",
    "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "rb": "ruby", "swift": "swift", "cs": "csharp", "css": "css",
        "scss": "css", "html": "html", "htm": "html",
    "vue": "vue", "svelte": "svelte", "md": "markdown", "markdown": "markdown",
}


def language_of(path: Column) -> Column:
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), extension(path))


def generated_banner(src: Column) -> Column:
    """Whether the first 64 KiB carry a generator's banner or a source-map mark."""
    head = F.lower(F.substring(src, 1, 65536))
    return head.rlike(r"do not edit|@generated|auto-?generated|code generated by|generated automatically|sourcemappingurl=")


def declaration_share(src: Column) -> Column:
    """Share of the lines that only import, include, use or re-export."""
    lines = F.filter(F.transform(F.split(src, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    decl = F.filter(lines, lambda x: x.rlike(r"^(import |from |#include|use |pub use |require|package |using |export \* from|export \{)"))
    return F.when(F.size(lines) > 0, F.size(decl) / F.size(lines)).otherwise(F.lit(0.0))


def glob_regex(glob: str) -> str:
    """The pattern for a path glob with **, *, ? and [...]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + ("\\" + c if not c.isalnum() and c not in "_/-" else c), i + 1
    return f"^{out}$"


def skip_reason(path: Column, src: Column) -> Column:
    """Why a source file is no source: binary content, the output of a highlighter, or
    a C++ header under a C name; null if it is one."""
    escapes = F.size(F.split(src, "\x1b\\[")) - 1
    code = F.regexp_replace(src, r"(?s)/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"", " ")
    cpp = code.rlike(r"\bnamespace\b|template ?<|std::|\bclass\s+[A-Za-z_]|public:|private:|protected:")
    return (
        F.when(F.locate("\0", src) > 0, "binary-source-artifact")
        .when(src.rlike(r"\A(?:\x89PNG\r\n|GIF8[79]a|%PDF-|PK\x03\x04)"), "binary-source-artifact")
        .when(escapes >= 3, "ansi-highlight-output")
        .when(F.lower(path).endswith(".h") & cpp, "unsupported-cpp-header")
    )


# What generators write into the first lines of a file (fixed values, in lower case).
GENERATED_HEADER = r"@generated|generated by|code generated|automatically generated|auto-generated"


def generated_header(src: Column) -> Column:
    """Whether one of the first eight lines says that a tool wrote the file."""
    head = F.slice(F.split(src, "\n"), 1, 8)
    return F.exists(head, lambda x: F.lower(x).rlike(GENERATED_HEADER))


# Folders in which no prose is worth comparing (fixed values).
PROSE_EXCLUDED = ("node_modules", "vendor", ".venv", "venv", "dist", "build", "target", "bower_components", ".next", ".nuxt", "site-packages", ".tox",
    ".mypy_cache", "__pycache__", ".cache", ".git")
