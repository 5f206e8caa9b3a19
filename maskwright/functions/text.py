"""String columns: normal forms, keys, names of files and fields, case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, where Java's `\s` is ASCII only.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Content types by extension.
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it, inside other lambdas too."""
    return F.get(F.transform(F.array(value), f), 0)


def lookup(values: dict, key: Column, default=None) -> Column:
    """The value of a literal map, or the default."""
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def match_form(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), f"{SPACE}+", " "))


def consistency_key(c: Column) -> Column:
    return strip(F.lower(c))


def tokens(c: Column) -> Column:
    """Words of the match form; none for blank text."""
    return F.filter(F.split(match_form(c), " "), lambda w: w != "")


def type_stem(entity_type: Column) -> Column:
    return F.translate(entity_type, " -", "__")


def label_suffix(n: Column) -> Column:
    """1 to 26 as A to Z, then the number."""
    return F.when(n <= 26, F.char((n + 64).cast("int"))).otherwise(n.cast("string"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def stored_name(name: Column) -> Column:
    return F.concat(F.lit("original"), extension(name))


def masked_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("_masked.pdf"))


def config_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"(?U)[^\w-]", "_")


def display_name(key: Column) -> Column:
    return F.initcap(F.translate(key, "-_", "  "))


def mime_type(name: Column) -> Column:
    return lookup(MIME_TYPES, extension(name), "application/octet-stream")


def image_subtype(name: Column) -> Column:
    kind = mime_type(name)
    return F.when(kind.startswith("image/"), F.substring_index(kind, "/", -1)).otherwise(F.lit("png"))


def without_fence(c: Column) -> Column:
    """The content of a json-tagged code fence, else of a plain one, else the trimmed text; an open fence runs to the end."""
    tagged = F.regexp_extract(c, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(c, r"(?s)```(.*?)(?:```|\z)", 1)
    return strip(F.when(F.contains(c, F.lit("```json")), tagged).when(F.contains(c, F.lit("```")), plain).otherwise(c))


def mirror_case(original: Column, generated: Column) -> Column:
    upper = (original == F.upper(original)) & (original != F.lower(original))
    lower = (original == F.lower(original)) & (original != F.upper(original))
    capital = once(generated, lambda g: F.concat(F.upper(F.substring(g, 1, 1)), F.lower(F.substring(g, 2, 1 << 20))))
    return F.when(upper, F.upper(generated)).when(lower, F.lower(generated)).otherwise(capital)


def paragraphs(text: Column) -> Column:
    """Non-blank lines, joined again by newlines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda p: strip(p) != ""), "\n")


def page_class(text: Column, file_extension: Column | None = None, least: int = 50) -> Column:
    """digital_pdf for a page with enough text, else scanned_pdf; other files are scanned."""
    enough = F.length(strip(F.coalesce(text, F.lit("")))) >= least
    if file_extension is not None:
        enough = enough & (file_extension == ".pdf")
    return F.when(enough, "digital_pdf").otherwise("scanned_pdf")


def contains_run(words: Column, part: Column) -> Column:
    """Whether `part` is a contiguous slice of `words`."""
    size = F.size(part)
    return (size <= F.size(words)) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda k: F.slice(words, k, F.greatest(size, F.lit(0))) == part)
