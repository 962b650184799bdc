"""Column expressions over source text: lines, tokens, words, comments.

Every pattern spells its classes out, so letters, digits and white space mean the
Unicode sets whatever the regex dialect, and ``[^\\n]`` stands for "not a line feed".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = (
    r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NAME = rf"[A-Za-z_][{WORD_CLASS}]*"
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
OPERATOR = rf"[^{SPACE_CLASS}{WORD_CLASS}]"
# Groups: 1 name, 2 number, 3 operator.
TOKEN = rf"({NAME})|({NUMBER})|({OPERATOR})"
HASH_COMMENT = r"#[^\n]*"
SLASH_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
QUOTED = r"'[^']*'|\"[^\"]*\""

# Languages whose comments start with // or /*.
SLASH_COMMENT_LANGUAGES = ("javascript", "typescript", "java", "c", "cpp")

# Reserved words of Python 3.
PYTHON_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
    "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise",
    "return", "try", "while", "with", "yield",
)


def each(array: Column) -> Column:
    """Explode a computed array without the size filter Spark infers for a plain column.

    That filter is pushed below the projection and would compute the array twice.
    """
    return F.explode(F.slice(array, F.lit(1), F.lit(1 << 30)))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def group_tokens(text: Column, group: int) -> Column:
    """Tokens of one alternative of ``TOKEN``; the others leave empty strings behind."""
    return F.array_remove(extract_all(text, TOKEN, group), "")


def lines_of(text: Column) -> Column:
    """Lines without terminators; a final terminator opens no further line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    parts = F.split(text, LINE_BREAK, -1)
    return F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE_CLASS}]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def indent_width(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, rf"^[{SPACE_CLASS}]+", ""))


def comment_characters(text: Column, language: Column) -> Column:
    """Characters inside comments, as the length removed by deleting them."""
    slash = F.length(F.regexp_replace(text, SLASH_COMMENT, ""))
    hashed = F.length(F.regexp_replace(text, HASH_COMMENT, ""))
    return F.length(text) - F.when(F.lower(language).isin(*SLASH_COMMENT_LANGUAGES), slash).otherwise(hashed)


def words_of(text: Column) -> Column:
    return extract_all(text, rf"[{WORD_CLASS}]+")


def standalone_numbers(text: Column) -> Column:
    return F.regexp_count(
        text, F.lit(rf"(?<![{WORD_CLASS}]){NUMBER}(?![{WORD_CLASS}])")
    )


def sum_of(array: Column, value=lambda item: item) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, item: total + value(item).cast("double"))


def deviation(count: Column, total: Column, squares: Column) -> Column:
    """Population deviation from a count, a sum and a sum of squares; 0 for no items."""
    size = F.greatest(count, F.lit(1)).cast("double")
    mean = total / size
    return F.sqrt(F.greatest(squares / size - mean * mean, F.lit(0.0)))


def shannon_entropy(items: Column) -> Column:
    """Entropy in bits of the value counts of an array, within the row.

    Equal items are adjacent after sorting, so one fold over run lengths gives
    log2(n) - sum(c * log2(c)) / n without exploding tokens into a shuffle.
    """
    zero = F.struct(
        F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")
    )

    def c_log_c(run: Column) -> Column:
        return F.when(run > 1, run * F.log2(run)).otherwise(0.0)

    def step(state: Column, item: Column) -> Column:
        same = state["last"] == item
        return F.when(
            same,
            F.struct(item.alias("last"), (state["run"] + 1.0).alias("run"), state["total"].alias("total")),
        ).otherwise(
            F.struct(
                item.alias("last"), F.lit(1.0).alias("run"),
                (state["total"] + c_log_c(state["run"])).alias("total"),
            )
        )

    count = F.size(items).cast("double")
    folded = F.aggregate(
        F.array_sort(items), zero, step, lambda state: state["total"] + c_log_c(state["run"])
    )
    return F.when(F.size(items) > 0, F.greatest(F.log2(count) - folded / count, F.lit(0.0))).otherwise(0.0)
