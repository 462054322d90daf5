"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Lines of a text; a final line feed adds none, the empty text has none."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def slug(title: Column) -> Column:
    """Lower case; letters, digits, ``_`` and ``-`` stay, spaces become hyphens, the rest goes."""
    return F.translate(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\- ]", ""), " ", "-")


def external(target: Column) -> Column:
    """Whether a link leaves the corpus: ``//host`` or ``scheme:``."""
    return target.rlike("^(//|[A-Za-z][A-Za-z0-9+.-]*:)")


def without_fragment(target: Column) -> Column:
    return F.substring_index(target, "#", 1)


def fragment(target: Column) -> Column:
    return F.when(F.contains(target, F.lit("#")), F.substring(target, F.instr(target, "#") + 1, 1 << 30))


def percent_decoded(path: Column) -> Column:
    """``%XX`` decoded, all or nothing: malformed escapes, and bytes that aren't UTF-8, leave the path as it is; ``+`` is a plus."""
    well_formed = ~path.rlike("%(?![0-9A-Fa-f]{2})")
    out = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    broken = F.contains(out, F.lit("�")) & ~F.contains(F.upper(path), F.lit("%EF%BF%BD"))
    return F.when(F.contains(path, F.lit("%")) & well_formed & ~F.coalesce(broken, F.lit(True)), out).otherwise(path)


def confinement(path: Column) -> Column:
    """Why a configured path may not be used: absolute (E0010), with a parent step (E0011); null if it may."""
    return F.when(F.startswith(path, F.lit("/")), "E0010").when(F.array_contains(F.split(path, "/"), ".."), "E0011")


def normal_path(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), "/")


def resolved(base_file: Column, target: Column, link_root: Column | bool = False) -> Column:
    """``struct(path, problem)``: a target relative to a file's folder, ``..`` collapsed; problem E0010 or E0011."""
    link_root = F.lit(link_root) if isinstance(link_root, bool) else link_root
    folder = F.split(base_file, "/")
    folder = F.slice(folder, 1, F.size(folder) - 1)
    absolute = F.startswith(target, F.lit("/"))
    start = F.when(absolute, F.array().cast("array<string>")).otherwise(folder)
    none = F.lit(None).cast("array<string>")
    step = lambda acc, x: F.when(acc.isNull() | (x == "") | (x == "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(none)).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(target, "/"), start, step)
    problem = F.when(absolute & ~link_root, "E0010").when(parts.isNull(), "E0011")
    return F.struct(F.when(problem.isNull(), F.array_join(parts, "/")).alias("path"), problem.alias("problem"))


_NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]


def number_of(token: Column) -> Column:
    """The number a token spells, by digits or a word up to twenty; null if none."""
    t = F.lower(F.regexp_replace(token, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    word = F.array_position(F.array(*map(F.lit, _NUMBER_WORDS)), t) - 1
    return F.when(t.rlike("^[0-9]{1,18}$"), F.try_to_number(t, F.lit("9" * 18)).cast("long")).when(word >= 0, word)


def claimed_number(line: Column, needle: Column) -> Column:
    """The nearest number among the four words before the first mention of ``needle``."""
    at = F.instr(line, needle)
    before = F.filter(F.split(F.substring(line, F.lit(1), at - 1), r"\s+"), lambda x: x != "")
    last = F.reverse(F.slice(before, F.greatest(F.size(before) - 3, F.lit(1)), F.lit(4)))
    found = F.filter(F.transform(last, number_of), lambda x: x.isNotNull())
    return F.when(at > 0, F.try_element_at(found, F.lit(1)))


LABEL = r"\b[A-Z]{1,7}(?:-[A-Z]{0,7})?[0-9]{1,4}\b"


def labels(text: Column) -> Column:
    """Label-like clusters: capitals, a hyphenated part perhaps, and up to four digits."""
    return F.regexp_extract_all(text, F.lit(LABEL), 0)


def bold_spans(text: Column) -> Column:
    """Trimmed content of ``**…**``, 1 to 60 bytes on one line; a pair that is empty, longer or on several lines is used up without a span.

    Marks pair up from the left, so what stands between them are the pieces with even numbers of the text cut at its marks, but for a last one.
    """
    pieces = F.split(text, r"\*\*", -1)
    inner = F.filter(pieces, lambda x, i: (i % 2 == 1) & (i < F.size(pieces) - 1) & F.octet_length(x).between(1, 60) & ~F.contains(x, F.lit("\n")))
    return F.transform(inner, lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))


def namespace_tokens(text: Column, namespace: str) -> Column:
    """Tokens of a code namespace: not after a letter or digit, with a tail of letters and digits that has a digit."""
    esc = "".join("\\" + c if not c.isalnum() else c for c in namespace)
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])({esc}[A-Za-z]*[0-9][A-Za-z0-9]*)"), 1)
