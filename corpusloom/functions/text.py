"""Text functions as columns: normalising, hashing, ids, chunk headers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space at the ends of a text.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Fixed value: the header that rendered pages begin with.
PAGE_HEADER_GREEDY = "(?s)^# .+\n\n> DevDocs path: .+\n\n"
PAGE_HEADER_EXACT = "^# [^\n]+\n\n> DevDocs path: [^\n]+\n\n"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(BLANKS))


def normalize(text: Column) -> Column:
    """CRLF and CR become LF, outer white space goes; null stays null. Strings here can't hold unpaired surrogates."""
    return strip(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for an empty text."""
    n = F.char_length(normalize(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("int")


def strip_page_header(text: Column, mode: str = "greedy") -> Column:
    """Without the generated header. ``greedy`` removes up to the last blank line, as long as there is a header; ``exact`` the header only."""
    pattern = {"greedy": PAGE_HEADER_GREEDY, "exact": PAGE_HEADER_EXACT}[mode]
    return normalize(F.regexp_replace(normalize(text), pattern, ""))


def page_id(path: Column, name: Column) -> Column:
    """A label of at most 80 characters from name and path, and the first ten digits of the path's SHA-1."""
    label = F.regexp_replace(F.regexp_replace(F.lower(F.concat(name, F.lit("-"), path)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    label = F.substring(label, 1, 80)
    return F.concat(F.when(label == "", "page").otherwise(label), F.lit("-"), F.substring(F.sha1(path.cast("binary")), 1, 10))


def unit_id(path: Column, start_byte: Column, end_byte: Column, unit_type: Column, source_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, start_byte.cast("string"), end_byte.cast("string"), unit_type, source_hash), 256)


def chunk_text(docset_name: Column, slug: Column, page_name: Column, page_path: Column, page_type: Column, body: Column) -> Column:
    """Header lines, a blank line and the body; the type line only where there is a type."""
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Docset: "), docset_name, F.lit(" ("), slug, F.lit(")")),
        F.concat(F.lit("Page: "), page_name),
        F.concat(F.lit("Path: "), page_path),
        F.when(F.coalesce(page_type, F.lit("")) != "", F.concat(F.lit("Type: "), page_type)),
    )
    return normalize(F.concat(head, F.lit("\n\n"), strip(body)))


def chunk_metadata(slug: Column, name: Column, page_id_: Column, page_name: Column, page_path: Column, page_type: Column, page_file: Column, ordinal: Column) -> Column:
    """Compact JSON; a page without a type has a null there."""
    fields = {"docsetSlug": slug, "docsetName": name, "pageId": page_id_, "pageName": page_name, "pagePath": page_path, "pageType": page_type, "pageFile": page_file, "chunkOrdinal": ordinal}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def metadata_map(json: Column) -> Column:
    """JSON metadata as a map; an empty one for what is null or no JSON object."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(json, "map<string,string>"), empty)


def camel_case(name: Column) -> Column:
    """snake_case to camelCase."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))
    return F.concat(parts[0], F.array_join(rest, ""))


def safe_segment(value: Column) -> Column:
    """Whether a value may be one segment of a path."""
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._+~-]*$")


def resource_uri(slug: Column, page: Column) -> Column:
    return F.concat(F.lit("docs://"), slug, F.lit("/"), page)


def shell_quoted(value: Column) -> Column:
    """Quoted for a POSIX shell where that is needed."""
    return F.when(value.rlike(r"^[\w@%+=:,./-]+$"), value).otherwise(F.concat(F.lit("'"), F.regexp_replace(value, "'", "'\"'\"'"), F.lit("'")))


def iso_timestamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def line_slice(text: Column, first: int | None, last: int | None) -> Column:
    """Lines ``first`` to ``last``, from 1 and inclusive, cut to what there is; a range that runs backwards is empty."""
    lines = F.split(text, "\n")
    begin = F.greatest(F.lit(1 if first is None else first), F.lit(1))
    end = F.least(F.size(lines), F.lit(1 << 30 if last is None else last))
    return F.when(end < begin, "").otherwise(F.array_join(F.slice(lines, begin, F.greatest(end - begin + 1, F.lit(0))), "\n"))


def byte_size(n: Column) -> Column:
    """Bytes for people: whole bytes, then one decimal in KB, MB or GB."""
    step = lambda unit, power: F.concat(F.format_string("%.1f", n / 1024**power), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, step("KB", 1)).when(n < 1024**3, step("MB", 2)).otherwise(step("GB", 3))
