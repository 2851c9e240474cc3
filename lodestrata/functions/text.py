"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that separate by space, comma, full stop and line ends only.
SEPARATORS = r"[ ,.\r\n]+"


def strip_html(text: Column) -> Column:
    """Text without tags: from each < to the next >, or to the end if there is none."""
    return F.regexp_replace(text, "<[^>]*>?", "")


def clean_word(word: Column) -> Column:
    """Letters and hyphens of a word in lower case; everything else is deleted, not split at."""
    return F.lower(F.regexp_replace(word, "[^a-zA-Z-]", ""))


def split_words(text: Column, shortest: int = 3) -> Column:
    """The words of a text in order, cleaned, of at least so many characters."""
    return F.filter(F.transform(F.split(text, SEPARATORS), clean_word), lambda w: F.length(w) >= shortest)


def clean_label(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit(" "))


def escape_xml(text: Column) -> Column:
    """Text for XML content or attributes."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def table_code(variable: Column) -> Column:
    """Table part of a variable code: its first 7 characters, or 6 where it begins with C."""
    return F.when(F.startswith(variable, F.lit("C")), F.substring(variable, 1, 6)).otherwise(F.substring(variable, 1, 7))


def table_code_by_suffix(variable: Column, suffix: int = 6) -> Column:
    """Table part of a variable code whose last characters number the variable."""
    return F.substring(variable, F.lit(1), F.greatest(F.length(variable) - suffix, F.lit(0)))


def table_code_short(variable: Column) -> Column:
    return F.substring(variable, 1, 5)


def shorten_title(title: Column, longest: int = 64, words_upto: int = 60) -> Column:
    """A title of at most ``longest`` characters where cutting can do it.

    Too long a title loses what stands before its last colon, then before its
    last semicolon (and the character after), then words from its end until at
    most ``words_upto`` characters stay, and ends in three dots.
    """

    def after(text: Column, mark: str) -> Column:
        tail = F.substring_index(text, mark, -1)
        return F.when((F.length(text) > longest) & F.contains(text, F.lit(mark)), F.substring(tail, F.lit(2), F.length(tail))).otherwise(text)

    cut = after(after(title, ":"), ";")
    kept = F.aggregate(
        F.split(cut, " "),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda acc, w: F.struct(
            F.when(acc["full"] | (F.length(acc["text"]) + F.length(w) + 1 > words_upto + 1), acc["text"]).otherwise(F.concat(acc["text"], F.lit(" "), w)).alias("text"),
            (acc["full"] | (F.length(acc["text"]) + F.length(w) + 1 > words_upto + 1)).alias("full"),
        ),
    )["text"]
    return F.trim(F.when(F.length(cut) > longest, F.concat(F.trim(kept), F.lit("..."))).otherwise(cut))


def short_description(variable: Column, variable_text: Column, table: Column, table_text: Column, source: str = "2011 Census") -> Column:
    return F.concat(variable_text, F.lit(" ("), variable, F.lit(f") from the {source} table "), table_text, F.lit(" ("), table, F.lit(")"))


def long_description(variable: Column, variable_text: Column, unit: Column, table: Column, table_text: Column) -> Column:
    """The same as a small HTML list."""
    item = lambda name, value: F.concat(F.lit(f"<li>{name}: "), escape_xml(F.coalesce(value, F.lit(""))), F.lit("</li>"))
    return F.concat(F.lit("<ul>"), item("Variable", variable), item("Description", variable_text), item("Unit", unit), item("Table", table), item("Table description", table_text), F.lit("</ul>"))


def keyword_string(text: Column, shortest: int = 4) -> Column:
    """Distinct words in order, of at least four characters, lower-cased, each followed by a space."""
    words = F.filter(F.array_distinct(F.split(F.coalesce(text, F.lit("")), " ")), lambda w: F.length(w) >= shortest)
    joined = F.array_join(F.transform(words, lambda w: F.lower(F.replace(w, F.lit(":"), F.lit(" ")))), " ")
    return F.when(F.size(words) > 0, F.concat(joined, F.lit(" "))).otherwise("")


def default_text(role: str, key: Column) -> Column:
    """The text of a role for a store that defines none."""
    return F.concat(F.lit(f"{role} for "), key)


def area_level(code: Column) -> Column:
    """Level of an area code by its first three characters; null for codes of other kinds."""
    head = F.substring(code, 1, 3)
    return F.when(head.isin("E00", "W00"), "OA").when(head.isin("E01", "W01"), "LSOA").when(head.isin("E02", "W02"), "MSOA").when(head.isin("E05", "W05"), "Ward")


def safe_float(text: Column) -> Column:
    return F.trim(text).try_cast("float")


def file_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"[?#].*$", ""), "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """Extension with its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))
