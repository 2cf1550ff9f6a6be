"""Text: decoding, lines, hashes, paths, names, Markdown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line besides \n.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def decoded(data: Column) -> Column:
    """UTF-8 with replacement characters and \\n for every line break."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 of the decoded text, in hexadecimal."""
    return F.sha2(text, 256)


def line_count(text: Column) -> Column:
    """Line breaks plus one: a break at the end counts a line more."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def split_lines(text: Column) -> Column:
    """The lines as an array; a break at the end adds none, an empty text has none."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, LINE_ENDS, "\n"), "\n\\z", ""), "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, lineno (from 1), line."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.select(*keep, F.posexplode(split_lines(F.col(text))).alias("__p", "line")).select(*keep, (F.col("__p") + 1).alias("lineno"), "line")


def added_lines(diff: Column) -> Column:
    """How many lines of a diff start with + but not +++."""
    return F.size(F.filter(split_lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++")))


def relative(path: Column, root: str) -> Column:
    """The path below root; other paths unchanged."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substr(path, F.lit(len(top) + 1))).otherwise(path)


def strip_side(path: Column) -> Column:
    """A diff header's path without a/ or b/."""
    return F.regexp_replace(path, "^[ab]/", "")


#: One-letter escapes of a quoted path and their bytes.
ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34}


def unquote(raw: str | None) -> str | None:
    """A path as git prints it: quotes, escapes and octal bytes undone; what isn't UTF-8 then stays as it was."""
    if raw is None or len(raw) < 2 or not (raw.startswith('"') and raw.endswith('"')):
        return raw

    def parts() -> Iterator[bytes]:
        rest = raw[1:-1]
        while rest:
            head, slash, tail = rest.partition("\\")
            yield head.encode("utf-8", "surrogatepass")
            if not slash:
                return
            if not tail:
                yield b"\\"
                return
            if tail[0] in ESCAPES:
                yield bytes([ESCAPES[tail[0]]])
                rest = tail[1:]
            elif tail[0].isdigit() and (value := _octal(tail[:3])) is not None:
                yield bytes([value])
                rest = tail[3:]
            else:
                yield b"\\"
                rest = tail

    try:
        return b"".join(parts()).decode("utf-8")
    except UnicodeDecodeError:
        return raw


def _octal(digits: str) -> int | None:
    try:
        value = int(digits, 8)
    except ValueError:
        return None
    return value if 0 <= value < 256 else None


#: What a quoted path is read by: an octal byte (of fewer digits only at the end), an escape, a lone backslash, anything else.
TOKEN = r"""\\[0-3][0-7]{2}|\\[0-7]{1,2}\z|\\[abfnrtv"\\]|\\|[^\\]+"""


def unquoted(raw: Column) -> Column:
    """unquote() as a column: the pieces' bytes in hexadecimal, put together and read as UTF-8."""
    escapes = F.create_map(*[F.lit(x) for k, v in ESCAPES.items() for x in ("\\" + k, f"{v:02X}")])

    def hexed(t: Column) -> Column:
        octal = F.lpad(F.conv(F.substr(t, F.lit(2)), 8, 16), 2, "0")
        return F.when(t.rlike(r"^\\[0-7]+\z"), octal).otherwise(F.coalesce(F.try_element_at(escapes, t), F.hex(F.encode(t, "utf-8"))))

    pieces = F.regexp_extract_all(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit(TOKEN), F.lit(0))
    read = F.try_validate_utf8(F.unhex(F.array_join(F.transform(pieces, hexed), "")).cast("string"))
    return F.when(raw.startswith('"') & raw.endswith('"') & (F.length(raw) > 1), F.coalesce(read, raw)).otherwise(raw)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "")


def repo_label(url: Column, directory: Column) -> Column:
    """owner_name of a repository URL, else the directory's name, else "repo"; only letters, digits, - and _."""
    clean = F.regexp_replace(F.regexp_replace(F.btrim(url), "/+$", ""), r"\.git$", "")
    parts = F.filter(F.split(clean, "[/:]"), lambda x: x != "")
    n = F.size(parts)
    named = F.when(n >= 2, F.concat(slug(F.get(parts, n - 2)), F.lit("_"), slug(F.get(parts, n - 1)))).when(n == 1, slug(F.get(parts, F.lit(0)))).otherwise("")
    out = F.when(F.coalesce(url, F.lit("")) != "", named).otherwise(slug(directory))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("repo")).otherwise(out)


def report_basename(label: Column, pr: Column, mode: Column, at: Column) -> Column:
    return F.concat_ws("_", label, F.coalesce(F.concat(F.lit("pr"), pr.cast("string")), mode), F.date_format(at, "yyyyMMdd_HHmmss"))


def md_inline(text: Column) -> Column:
    """Text for a Markdown table cell: no markup of its own."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.translate(F.regexp_replace(text, r"([\\`*_\[\]()~|])", r"\\$1"), "\r\n", "  ")


def md_code(text: Column) -> Column:
    """Text for a code span."""
    return F.translate(text, "`\r\n", "'  ")


def skip_entry(*parts: Column) -> Column:
    return F.concat_ws(": ", *parts)
