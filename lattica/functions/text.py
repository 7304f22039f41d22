"""Text and id functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two UUID name spaces in use (URLs and domain names).
URL_SPACE, DNS_SPACE = "6ba7b8119dad11d180b400c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8"
#: Fixed value: white space as C's isspace() has it.
SPACES = " \\t\\n\\x0B\\f\\r"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(nibble)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def looks_like_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extension(name: Column) -> Column:
    """The last extension with its dot, lowered; empty if there is none."""
    return lower_ascii(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def plain_spaces(c: Column) -> Column:
    """No-break spaces become spaces, soft hyphens go."""
    return F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("­"), F.lit(""))


def without_tags(c: Column) -> Column:
    """Without the invisible tag characters U+E0000 to U+E007F."""
    return F.regexp_replace(c, r"[\x{E0000}-\x{E007F}]", "")


def page_text(c: Column) -> Column:
    """Text as extracted from pages: line ends alike, blanks and empty lines bounded, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def in_order(c: Column, first: str, second: str) -> Column:
    """Whether ``second`` comes somewhere after ``first``."""
    at = F.instr(c, first)
    return (at > 0) & (F.locate(second, c, 1) > 0) & (F.instr(F.substring(c, at + len(first), F.length(c)), second) > 0)


def json_field(c: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def json_strings(c: Column) -> Column:
    """A JSON array of strings; empty for anything else."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def valid_utf8(c: Column) -> Column:
    """Whether bytes are UTF-8: no overlong forms, no surrogates, nothing beyond U+10FFFF."""
    return F.is_valid_utf8(c.cast("string"))


def sheet_column(ref: Column, most: int = 16_384) -> Column:
    """The column of a cell reference such as AB12, from 1; 0 if malformed or beyond ``most``."""
    letters = F.regexp_extract(ref, "^([A-Z]+)[0-9]+$", 1)
    n = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda s, x: F.when((x == "") | (s > most), s).otherwise(s * 26 + F.ascii(x) - 64))
    return F.when(n <= most, n).otherwise(0).cast("int")


def heading_level(style: Column) -> Column:
    """The level of a word processor's heading style, 1 to 9; 0 for other styles."""
    return F.coalesce(F.regexp_extract(style, "^(?i)heading ?([1-9])$", 1).try_cast("int"), F.lit(0))


#: Elements without content, and what hides an element.
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
HIDES = r"display: ?none|visibility: ?hidden|\shidden(?=[\s=/>])"


def _unnested(c: Column, hides: str) -> Column:
    """A text without its hidden elements, by the depth of elements of the same name; null if one isn't closed."""
    pieces = F.regexp_extract_all(c, F.lit(r"[^<]+|<(?:/?[A-Za-z][^>]*>)?[^<]*"), F.lit(0))

    def described(x: Column) -> Column:
        opened = F.regexp_extract(x, rf"(?is)^<(?!(?:{VOID})\b)([a-z][a-z0-9-]*)\b[^>]*(?<!/)>", 1)
        return F.struct(
            F.lower(opened).alias("opened"), F.lower(F.regexp_extract(x, "(?i)^</([a-z][a-z0-9-]*)", 1)).alias("closed"),
            x.rlike(rf"(?is)^<(?!(?:{VOID})\b){hides}[^>]*(?<!/)>").alias("hides"), x.alias("x"),
        )

    def step(s: Column, p: Column) -> Column:
        state = lambda name, depth, out: F.struct(name.alias("name"), depth.alias("depth"), out.alias("out"))
        depth = s["depth"] + F.when(p["opened"] == s["name"], 1).when(p["closed"] == s["name"], -1).otherwise(0)
        ended = state(F.lit(""), F.lit(0), F.array_append(s["out"], F.regexp_replace(p["x"], "^<[^>]*>", "")))
        shown = state(F.lit(""), F.lit(0), F.array_append(s["out"], p["x"]))
        outside = F.when(p["hides"], state(p["opened"], F.lit(1), s["out"])).otherwise(shown)
        return F.when(s["depth"] == 0, outside).when(depth == 0, ended).otherwise(state(s["name"], depth, s["out"]))

    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.transform(pieces, described), start, step, lambda s: F.when(s["depth"] == 0, F.array_join(s["out"], "")))


def without_html(c: Column) -> Column:
    """struct<text, error>: Markdown without HTML tags, hidden elements with all they hold.

    A ``<`` that begins no tag stays. Scripts and styles go first, so close
    tags inside them end nothing. A hidden element ends at the close tag of its
    name that is its own: where elements of that name open inside it, their
    depth is counted (``_unnested``; only such texts are read tag by tag). A
    hidden element that isn't closed is an error.
    """
    hides = rf"([a-z][a-z0-9-]*)(?=[^>]*(?:{HIDES}))"
    opens = rf"<(?!(?:{VOID})\b)(?:(script|style)\b|{hides})[^>]*(?<!/)>"
    element = rf"(?is)<(?!(?:{VOID})\b){{}}[^>]*(?<!/)>.*?</\1[^>]*>"
    bare = F.regexp_replace(c, element.format(r"(script|style)\b"), "")
    hidden = F.regexp_extract_all(bare, F.lit(element.format(hides)), F.lit(0))
    nested = F.exists(hidden, lambda e: e.rlike(r"(?is)^<([a-z][a-z0-9-]*)\b[^>]*>.*<\1\b"))
    shown = F.when(nested, _unnested(bare, hides)).otherwise(F.regexp_replace(bare, element.format(hides), ""))
    error = F.when(c.isNotNull() & (shown.isNull() | shown.rlike(rf"(?is){opens}")), "unclosed_hidden_tag")
    plain = F.regexp_replace(shown, "</?[A-Za-z][^>]*>", "")
    return F.struct(F.when(error.isNull(), plain).alias("text"), error.alias("error"))
