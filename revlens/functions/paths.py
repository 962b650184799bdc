"""Column expressions over repository paths, names and package tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, WORD_CLASS, extract_all

# File extensions and their language.
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java",
    ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp",
    ".rs": "rust", ".go": "go", ".rb": "ruby", ".php": "php", ".swift": "swift",
}

# Folders no structure analysis enters.
EXCLUDED_FOLDERS = (".git", ".venv", "venv", "__pycache__", ".pytest_cache")

# First letter of a name-status row.
CHANGE_STATUS = {
    "A": "added", "M": "modified", "D": "deleted", "R": "renamed",
    "C": "copied", "T": "type_changed", "U": "unmerged",
}

# Words that say nothing about what a test covers.
RELEVANCE_STOP_WORDS = ("test", "tests", "context", "build", "changed", "change", "python")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix of the file name, lower case; dot files and trailing dots have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    return F.try_element_at(literal_map(LANGUAGE_BY_EXTENSION), extension(path))


def change_status(code: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(CHANGE_STATUS), F.substring(code, 1, 1)), F.lit("unknown")
    )


def in_test_folder_prefix(path: Column) -> Column:
    """Starts in a top-level test folder; used by the security roll-up."""
    return path.startswith("tests/") | path.startswith("test/")


def is_test_path(path: Column) -> Column:
    """Any folder named tests, or a test_ file; used by features and relevance."""
    return F.array_contains(F.split(path, "/"), "tests") | base_name(path).startswith("test_")


def is_architecture_path(path: Column) -> Column:
    """Python file outside top-level test folders and excluded folders."""
    parts = F.split(path, "/")
    return (
        path.endswith(".py")
        & ~F.element_at(parts, 1).isin("tests", "test")
        & ~F.arrays_overlap(parts, F.array(*[F.lit(item) for item in EXCLUDED_FOLDERS]))
    )


def module_name(path: Column, strip_src: bool) -> Column:
    """Dotted module of a Python path; a package init stands for its package."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    if strip_src:
        stem = F.regexp_replace(stem, r"^src(?:/|$)", "")
    return F.replace(F.regexp_replace(stem, r"(?:^|/)__init__$", ""), F.lit("/"), F.lit("."))


def is_package_init(path: Column) -> Column:
    return base_name(path) == "__init__.py"


def relative_base(module: Column, is_package: Column, level: Column, name: Column) -> Column:
    """Absolute module named by a relative import of ``level`` dots."""
    parts = F.filter(F.split(module, r"\."), lambda part: part != "")
    drop = level - F.when(is_package, 1).otherwise(0)
    package = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - drop, F.lit(0)))
    return F.concat_ws(".", F.array_join(package, "."), F.when(F.coalesce(name, F.lit("")) != "", name))


def import_base(module: Column, is_package: Column, level: Column, name: Column) -> Column:
    plain = F.coalesce(name, F.lit(""))
    joined = F.regexp_replace(relative_base(module, is_package, level, name), r"^\.|\.$", "")
    return F.when(level > 0, joined).otherwise(plain)


def is_public_name(qualified_name: Column) -> Column:
    """No private part and not nested in a function."""
    parts = F.split(qualified_name, r"\.")
    return ~F.exists(parts, lambda part: part.startswith("_")) & ~F.array_contains(parts, "<locals>")


def pytest_node_id(path: Column, qualified_name: Column) -> Column:
    return F.concat_ws("::", path, F.array_remove(F.split(qualified_name, r"\."), "<locals>"))


def relevance_tokens(text: Column) -> Column:
    """Lower-case name tokens longer than two characters, without stop words."""
    return F.array_distinct(
        F.filter(
            F.transform(extract_all(text, r"[A-Za-z][A-Za-z0-9]+"), F.lower),
            lambda token: (F.length(token) > 2) & ~token.isin(*RELEVANCE_STOP_WORDS),
        )
    )


def python_dependencies(code: Column) -> Column:
    """Distinct top-level names imported at line starts."""
    pattern = rf"(?:^|\n)[{SPACE_CLASS}]*(?:from|import)[{SPACE_CLASS}]+([A-Za-z_][{WORD_CLASS}]*)"
    return F.array_distinct(extract_all(code, pattern, 1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", "")


def metric_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def escapes_root(path: Column) -> Column:
    """Absolute, climbs above its root at some step, or ends on the root itself."""

    def walk(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(state["lowest"], depth).alias("lowest"))

    end = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")), walk
    )
    return path.startswith("/") | (end["lowest"] < 0) | (end["depth"] < 1)
