"""Table-generating text functions: chunks, dialogue lines, named phrases, dates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size limits of chunks by kind of text, in bytes.
LIMITS = {"markdown": 1100, "code": 1200, "table": 1400, "plain": 900}
TABLE_LINES = 24
_HEADERS = {"markdown": re.compile(r"(?m)^(?=[ \t]*#)"), "code": re.compile(r"(?m)^(?=[ \t]*(?:pub fn |fn |def |class |function |impl ))"), "email": re.compile(r"(?im)^(?=(?:from|subject|to|date):)")}


def content_type(c: Column) -> Column:
    """code, markdown, email, table, chat or plain, by the first sign that is found."""
    return (F.when(c.rlike("(?m)^```|^\\s*(def|fn|class|function|impl) "), "code").when(c.rlike("(?m)^#{1,6} "), "markdown").when(c.rlike("(?im)^(from|subject): "), "email")
            .when(c.rlike("(?m)^[^\\n]*\\|[^\\n]*\\|"), "table").when(c.rlike("(?m)^[\\p{L}]+: "), "chat").otherwise("plain"))


def _pack(parts: list[str], limit: int, glue: str) -> list[str]:
    """Parts joined as long as a chunk stays within `limit` bytes; a longer part is a chunk of its own."""
    chunks: list[list[str]] = []
    size = 0
    for part in parts:
        n = len(part.encode())
        if chunks and size + len(glue) + n <= limit:
            chunks[-1].append(part)
            size += len(glue) + n
        else:
            chunks.append([part])
            size = n
    return [t for t in (glue.join(c).strip() for c in chunks) if t]


def chunk(text: str, kind: str) -> list[str]:
    """Chunks of one text: sections at headers, packed lines, or packed sentences."""
    if kind == "email":
        return [t for t in (s.strip("\n") for s in _HEADERS["email"].split(text)) if t] or [text]
    if kind in ("markdown", "code"):
        return [c for s in _HEADERS[kind].split(text) if s for c in _pack(s.splitlines(), LIMITS[kind], "\n")] or [text]
    if kind == "table":
        lines = text.splitlines()
        return [text] if len(lines) <= TABLE_LINES else _pack(lines, LIMITS["table"], "\n")
    return _pack([s.strip() for s in re.split(r"[.!?\n]", text) if s.strip()], LIMITS["plain"], ". ") or [text]


def chunk_documents(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, chunk_no, kind, chunk): every text cut into chunks; null texts give no row."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), content_type(F.col(text)).alias("kind")).filter("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, n, k, c) for i, t, k in zip(b["doc_id"], b["text"], b["kind"], strict=True) for n, c in enumerate(chunk(t, k))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "kind", "chunk"])

    return rows.mapInPandas(run, rows.select("doc_id").schema.add("chunk_no", "integer").add("kind", "string").add("chunk", "string"))


def dialogue_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, line_no, speaker, said): lines that begin with a one-word speaker and a colon."""
    lines = docs.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line_no", "line"))
    who, said = F.regexp_extract("line", "^([A-Za-z]+): (.+)$", 1), F.regexp_extract("line", "^([A-Za-z]+): (.+)$", 2)
    return lines.filter(F.col("line").rlike("^[A-Za-z]+: .+$")).select("doc_id", "line_no", F.lower(who).alias("speaker"), said.alias("said"))


def named_phrases(c: Column) -> Column:
    """Distinct runs of capitalised ASCII words of more than two characters, in order of appearance."""
    return F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit("((?:\\b[A-Z][A-Za-z'-]*[a-z][A-Za-z'-]*\\b)(?:[ \\t]+(?:[A-Z][A-Za-z'-]*[a-z][A-Za-z'-]*))*)"), F.lit(1))), lambda p: F.length(p) > 2)


def iso_dates(c: Column) -> Column:
    """Epoch milliseconds of the yyyy-mm-dd dates of years 1900 to 2200 in the text."""
    found = F.regexp_extract_all(c, F.lit("\\b((?:19|20|21)\\d\\d-[01]\\d-[0-3]\\d)\\b"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.unix_millis(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))), lambda x: x.isNotNull())


def distinct_ignoring_case(items: Column) -> Column:
    """Items in order, each once whatever the case of its letters."""
    low = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def speaker_name(c: Column, no_speaker: list[str]) -> Column:
    """A speaker's name without quotes, brackets and bullets; null for labels of headers."""
    name = F.regexp_replace(F.trim(c), "^[\"'\\[\\]*• -]+|[\"'\\[\\]*• -]+$", "")
    low = F.lower(name)
    return F.when((name != "") & ~low.isin(no_speaker) & ~low.startswith("session ") & ~low.startswith("window "), name)


def role_line(c: Column, no_speaker: list[str]) -> Column:
    """Struct (speaker, said) of a line with a speaker before ":", "=>" or " - ", the first of these that gives both; null for others and for bracketed lines."""
    line = F.regexp_replace(F.trim(c), "^[-*•> ]+", "")
    out = F.lit(None).cast("struct<speaker: string, said: string>")
    for sep in (" - ", "=>", ":"):
        name = speaker_name(F.substring_index(line, sep, 1), no_speaker)
        rest = F.substring(line, F.locate(sep, line) + len(sep), F.length(line))
        said = F.trim(F.regexp_replace(F.regexp_replace(rest, r"^[\s\p{Z}]*(\[[^\]]*\][\s\p{Z}]*)*", ""), "[\\s\\p{Z}]+", " "))
        out = F.when(F.contains(line, F.lit(sep)) & name.isNotNull() & (said != ""), F.struct(name.alias("speaker"), said.alias("said"))).otherwise(out)
    return F.when((line != "") & ~(line.startswith("[") & line.endswith("]")), out)
