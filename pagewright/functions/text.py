"""Normal forms of names, terms and texts, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
OUTER_BLANKS = r"^\s+|\s+$"


def norm(c: Column) -> Column:
    """Lower case, every run of characters other than letters and numbers one blank, outer blanks removed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), NOT_WORD, " "))


def words(c: Column) -> Column:
    """The words of a text in order. Null and texts without words give an empty array."""
    return F.coalesce(F.filter(F.split(F.lower(c), NOT_WORD), lambda w: w != ""), F.array().cast("array<string>"))


def word_set(c: Column) -> Column:
    """The distinct words of a text; empty for null."""
    return F.array_distinct(words(c))


def name_stem(c: Column) -> Column:
    """Name without outer blanks, case, folders and one ending .txt, .png or .pdf. Null stays null; a blank name gives ''."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, OUTER_BLANKS, "")), r"^(?s:.*)[/\\]", "")
    return F.regexp_replace(bare, r"\.(txt|png|pdf)$", "")


def is_blank(c: Column) -> Column:
    """True for null and for white space only."""
    return F.coalesce(F.regexp_replace(c, OUTER_BLANKS, "") == "", F.lit(True))


def term_set(c: Column) -> Column:
    """Distinct norm() of an array's elements, without nulls and empty results; empty for a null array."""
    normed = F.transform(c, norm)
    return F.coalesce(F.array_distinct(F.filter(normed, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def stem_set(c: Column) -> Column:
    """Distinct name_stem() of an array's elements, without nulls, blanks and empty results; empty for a null array."""
    stems = F.transform(c, name_stem)
    return F.coalesce(F.array_distinct(F.filter(stems, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def split_key(c: Column) -> Column:
    """train, validation or test from the spellings in use; null for anything else."""
    s = F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))
    return (
        F.when(s.isin("train", "training"), "train")
        .when(s.isin("val", "valid", "validation", "dev"), "validation")
        .when(s.isin("test", "testing"), "test")
    )
