"""Source files that do not parse: faults of each file, their first cause, and rates by repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsing import LANGUAGES, examined, language_of

#: Signs of the causes that can be told apart, looked for where the first fault lies.
CONFLICT_MARKS = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")


def first_cause(text: str, found: list[tuple[int, str]]) -> str:
    """conflict: an unresolved merge; cut off: the text ends too early; other kind: wrong from the start; else broken."""
    at, message = found[0]
    line = text[text.rfind("\n", 0, at) + 1 :][:7]
    if any(text[o : o + 7] in CONFLICT_MARKS for o, _ in found) or line in CONFLICT_MARKS:
        return "conflict"
    if len(text.rstrip()) - at <= 1 or "<eof>" in message or "never closed" in message or "unterminated" in message:
        return "cut off"
    return "other kind" if text.count("\n", 0, at) < 12 and len(found) > 2 else "broken"


def check_files(files: DataFrame) -> DataFrame:
    """(path, repo, language, sound, n_faults, cause, line, message, faults, undecided) of each file whose language has a parser.

    ``faults`` holds every fault as (line, message). ``undecided`` names the limit of the parser that kept it from
    reading the whole file; such a file without a fault so far has a null in ``sound``. Rows of a path count once: that with the smallest hash. Rows with a
    null path are dropped; null contents are an empty file. Paths with other endings give no rows.
    """
    out = "path string, repo string, hash string, language string, sound boolean, n_faults int, cause string, line int, message string, faults array<struct<line:int,message:string>>, undecided string"
    kinds = [("path", pa.string()), ("repo", pa.string()), ("hash", pa.string()), ("language", pa.string()), ("sound", pa.bool_()), ("n_faults", pa.int32()), ("cause", pa.string()), ("line", pa.int32()), ("message", pa.string()), ("faults", pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))), ("undecided", pa.string())]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(kinds)
        for b in batches:
            rows = []
            for path, repo, contents, digest in zip(*(c.to_pylist() for c in b.columns)):
                found, limit = examined(path, contents)
                row = {"path": path, "repo": repo, "hash": digest, "language": language_of(path), "sound": None if limit and not found else not found, "n_faults": len(found), "faults": [], "undecided": limit}
                if found:
                    text = (contents or "").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
                    row["faults"] = [{"line": text.count("\n", 0, at) + 1, "message": message} for at, message in found]
                    row |= {"cause": first_cause(text, found)} | row["faults"][0]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mine = files.where(ending.isin(*LANGUAGES)).select("path", "repo", "contents", F.coalesce("hash", F.sha2("contents", 256), F.lit("")).alias("hash"))
    seen = mine.mapInArrow(check, out)
    one = seen.groupBy("path").agg(F.min_by(F.struct("repo", "language", "sound", "n_faults", "cause", "line", "message", "faults", "undecided"), "hash").alias("s"))
    return one.select("path", "s.*")


def rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, unsound, rate, cut_off, conflict, other_kind, broken, undecided) of checked files; a null repo is a group of its own.

    Undecided files are no part of the rate.
    """
    cause = lambda c: F.count_if(F.col("cause") == c)
    return checked.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("sound")).alias("unsound"), F.avg(F.when(F.col("sound"), 0.0).when(~F.col("sound"), 1.0)).alias("rate"),
        cause("cut off").alias("cut_off"), cause("conflict").alias("conflict"), cause("other kind").alias("other_kind"), cause("broken").alias("broken"), F.count_if(F.col("sound").isNull()).alias("undecided"),
    )


def against_index(checked: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """(path, sound, status, error, units, text_units): what the indexer noted beside what the parsers found.

    ``files`` has one present row a path (path, status, error); ``units`` are counted by file, those that fell back to
    plain text apart. Files the indexer doesn't know have nulls and 0.
    """
    counted = units.groupBy(F.col("file_path").alias("path")).agg(F.count_distinct("id").alias("units"), F.count_distinct(F.when(F.col("language") == "text", F.col("id"))).alias("text_units"))
    return checked.select("path", "sound").join(files.select("path", "status", "error"), "path", "left").join(counted, "path", "left").fillna(0, ["units", "text_units"])
