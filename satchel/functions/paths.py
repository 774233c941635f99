"""Which files are taken in, decided from their relative path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names never entered, at any depth.
SKIPPED_DIRS = (
    "node_modules", ".git", "vendor", "dist", "build", ".next", ".nuxt", "__pycache__",
    ".cache", "target", ".idea", ".vscode", ".DS_Store", "coverage", ".pytest_cache",
)

# File name extensions taken in (compared in lower case).
TEXT_EXTENSIONS = (
    ".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".java", ".kt", ".swift",
    ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".vue", ".svelte",
    ".sql", ".sh", ".bash", ".zsh", ".yml", ".yaml", ".toml", ".json",
    ".xml", ".html", ".css", ".scss", ".md", ".txt", ".env", ".cfg",
    ".ini", ".conf", ".dockerfile", ".proto", ".graphql", ".gql",
)

# Whole file names taken in (compared in lower case).
TEXT_NAMES = ("dockerfile", "makefile", "license", ".gitignore")

# Fixed value: largest file whose content is taken in, in bytes.
MAX_FILE_BYTES = 512_000


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def is_indexable(name: Column) -> Column:
    return extension(name).isin(*TEXT_EXTENSIONS) | F.lower(name).isin(*TEXT_NAMES)


def outside_skipped_dirs(rel_path: Column) -> Column:
    """No directory segment of the path is one of the skipped names."""
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def has_usable_size(length: Column) -> Column:
    return length.between(1, MAX_FILE_BYTES)
