"""Row shapes of the corpus model and the file-type dimension."""

from __future__ import annotations

FILES = "path string, relative_path string, size bigint, file_type string, priority double, content string, error string"
IMPORTS = "path string, module string, items array<string>, is_relative boolean, line int"
CALLS = "path string, name string, module string, line int"
DEFS = "path string, name string, is_exported boolean, line int"
TYPE_REFS = "path string, name string, module string, line int"
TYPE_DEFS = "path string, name string, kind string, line int"

#: One row a fact: kind is import, call, def, type_ref or type_def.
FACTS = "path string, kind string, name string, module string, items array<string>, flag boolean, line int"

SPANS = "name string, function_name string, file_path string, line_number int, service_name string, start_ns bigint, end_ns bigint, duration_ms double, attributes map<string,string>"

#: Type, extensions, weight, display, fence, order.
FILE_TYPES = (
    ("Rust", "rs", 1.0, "Rust", "rust", 1),
    ("Python", "py pyi pyw", 0.9, "Python", "python", 2),
    ("JavaScript", "js mjs cjs jsx", 0.9, "JavaScript", "javascript", 3),
    ("TypeScript", "ts tsx", 0.95, "TypeScript", "typescript", 3),
    ("Go", "go", 0.9, "Go", "go", 4),
    ("Java", "java", 0.85, "Java", "java", 5),
    ("Cpp", "cpp cc cxx c++ hpp hxx h++", 0.85, "C++", "cpp", 6),
    ("C", "c h", 0.8, "C", "c", 7),
    ("CSharp", "cs", 0.85, "C#", "csharp", 8),
    ("Ruby", "rb", 0.8, "Ruby", "ruby", 9),
    ("Php", "php", 0.75, "PHP", "php", 10),
    ("Swift", "swift", 0.85, "Swift", "swift", 11),
    ("Kotlin", "kt kts", 0.85, "Kotlin", "kotlin", 12),
    ("Scala", "scala sc", 0.8, "Scala", "scala", 13),
    ("Haskell", "hs", 0.75, "Haskell", "haskell", 14),
    ("Dart", "dart", 0.85, "Dart", "dart", 15),
    ("Lua", "lua", 0.7, "Lua", "lua", 16),
    ("R", "r", 0.75, "R", "r", 17),
    ("Julia", "jl", 0.8, "Julia", "julia", 18),
    ("Elixir", "ex exs", 0.8, "Elixir", "elixir", 19),
    ("Elm", "elm", 0.75, "Elm", "elm", 20),
    ("Markdown", "md markdown", 0.6, "Markdown", "markdown", 21),
    ("Json", "json", 0.5, "JSON", "json", 22),
    ("Yaml", "yaml yml", 0.5, "YAML", "yaml", 23),
    ("Toml", "toml", 0.5, "TOML", "toml", 24),
    ("Xml", "xml", 0.4, "XML", "xml", 25),
    ("Html", "html htm", 0.4, "HTML", "html", 26),
    ("Css", "css scss sass less", 0.4, "CSS", "css", 27),
    ("Text", "txt text", 0.3, "Text", "text", 28),
    ("Other", "", 0.2, "Other", "", 29),
)

#: Extensions of binary files.
BINARY_EXTENSIONS = tuple(
    "exe dll so dylib a lib bin zip tar gz bz2 xz 7z rar jpg jpeg png gif bmp ico svg webp mp3 wav flac aac ogg wma"
    " mp4 avi mkv mov wmv flv webm pdf doc docx xls xlsx ppt pptx ttf otf woff woff2 eot db sqlite sqlite3 pyc pyo class o obj pdb".split()
)

MAX_FILE_BYTES = 10 << 20
