"""Scalar functions on text columns, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as a line's end and as a word.
SPACE = r"[\s\x1C-\x1F]"
LINE_END = "[\n\x0b\x0c\x1c\x1d\x1e\x85  ]"
WORD = r"[\p{L}\p{N}_]+"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(rf"(?U)[^\s\x1C-\x1F]")


def is_concrete(text: Column) -> Column:
    """Neither blank nor a template's placeholder."""
    return F.coalesce(~is_blank(text) & ~text.contains("{{") & ~text.contains("}}"), F.lit(False))


def lines(text: Column) -> Column:
    """A text's lines; carriage returns don't count, and a last line end starts no new line."""
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def squeeze(text: Column) -> Column:
    """Form feeds dropped, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("")), r"(?U)\s+", " "))


def strip_tex_comment(line: Column) -> Column:
    """Up to the first percent sign that no odd number of backslashes escapes."""
    return F.regexp_replace(line, r"^((?:[^\\%]|\\.)*)%.*$", "$1")


def indent_columns(line: Column, tab: int = 4) -> Column:
    """Width of the leading spaces and tabs; a tab goes to the next tab stop."""
    lead = F.regexp_extract(line, r"^[ \t]*", 0)
    return F.aggregate(F.filter(F.split(lead, ""), lambda c: c != ""), F.lit(0), lambda n, c: F.when(c == "\t", n + tab - n % tab).otherwise(n + 1))


def version_parts(version: Column) -> Column:
    """Numbers of a dotted version, to be compared as arrays."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), 0), lambda x: x.cast("int"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_inside(path: Column, root: Column) -> Column:
    """Whether a path lies in a folder (or is it); paths that climb out never do."""
    return ((path == root) | path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))) & ~F.array_contains(F.split(path, "/"), "..")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and empty steps, and with ``..`` taken back where there is a step to take back."""
    def add(done: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(s.isin("", "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((s == "..") & path.startswith("/"), done).otherwise(F.concat(done, F.array(s)))
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(steps, "/"))


def parent(path: Column) -> Column:
    """The folder of a path; ``.`` where it names none."""
    return F.when(path.rlike("^/+[^/]*/*$"), "/").when(~path.contains("/"), ".").otherwise(F.regexp_replace(path, "/+[^/]*/*$", ""))


def stem(path: Column) -> Column:
    """The last step of a path without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?/*$", 1)


def is_digest(text: Column, any_case: bool = False) -> Column:
    return (F.lower(text) if any_case else text).rlike("^[0-9a-f]{64}$")


def is_batch_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def is_safe_scalar(text: Column) -> Column:
    """Whether a value stays one plain line of a Markdown file: no outer white space, line ends, placeholders or comments."""
    marks = [text.contains(m) for m in ("{{", "}}", "<!--", "-->")]
    one_line = ~text.rlike(LINE_END) & ~text.contains("\r") & (text != "")
    return F.coalesce(one_line & (strip(text) == text) & ~(marks[0] | marks[1] | marks[2] | marks[3]), F.lit(False))


def iso_time(ts: Column) -> Column:
    """A time in UTC to the second, as 2024-01-31T09:05:00Z."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def page_file_name(page: Column, ending: str) -> Column:
    """page-001.png, with more digits where needed."""
    return F.format_string(f"page-%03d.{ending}", page)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") / whole, digits))


def fill_template(template: Column, values: Column) -> Column:
    """``{{NAME}}`` placeholders replaced from a map; unknown ones stay, see ``unknown_placeholders``."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{([A-Z0-9_]+)\}\}"), 1))
    return F.aggregate(names, template, lambda t, n: F.replace(t, F.concat(F.lit("{{"), n, F.lit("}}")), F.coalesce(F.try_element_at(values, n), F.concat(F.lit("{{"), n, F.lit("}}")))))


def unknown_placeholders(template: Column, values: Column) -> Column:
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{([A-Z0-9_]+)\}\}"), 1))
    return F.array_except(names, F.map_keys(values))


def expand_braces(paths: Column) -> Column:
    """Parts of a search path list; ``!!`` marks, trailing slashes and empty parts are dropped."""
    parts = F.transform(F.split(paths, "[:;]"), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), "^!!", ""), "/+$", ""))
    parts = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"\{[^{}]*\}"), F.transform(F.split(F.regexp_extract(p, r"\{([^{}]*)\}", 1), ","), lambda x: F.concat(F.regexp_extract(p, r"^([^{]*)\{", 1), x, F.regexp_extract(p, r"\}([^}]*)$", 1)))).otherwise(F.array(p))))
    return F.filter(parts, lambda p: p != "")
