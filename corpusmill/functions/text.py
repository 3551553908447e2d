"""Column functions on text. Each has the same result in DuckDB (see oracles.py), unless it says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
ELLIPSIS = "…"
#: White space of Unicode, written so that Java and RE2 read it alike (their own classes are ASCII).
WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(x: str | Column) -> Column:
    """Lower case, outer white space gone, inner runs of it one blank."""
    return F.trim(F.regexp_replace(F.lower(_col(x)), WHITE, " "))


def nfkc(x: str | Column) -> Column:
    """Unicode compatibility composition; Spark has no built-in for it. Made on the driver: workers import this module without a session."""

    def compose(values: pd.Series) -> pd.Series:
        others = ~values.map(str.isascii, na_action="ignore").fillna(True).astype(bool)  # ASCII is composed already
        if others.any():
            values = values.copy()
            values[others] = values[others].str.normalize("NFKC")
        return values

    return F.pandas_udf(compose, "string")(_col(x))


def number(x: str | Column) -> Column:
    """A whole number, or null where the text is none."""
    return _col(x).try_cast("long")


def tokens(x: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(TOKEN), F.lit(0))


def distinct_tokens(x: str | Column) -> Column:
    return F.array_distinct(tokens(x))


def chunk_uid(doc_id: str | Column, strategy: str | Column, index: str | Column) -> Column:
    """The first 32 hex digits of sha256(doc|strategy|index)."""
    return F.substring(F.sha2(F.concat_ws("|", _col(doc_id).cast("string"), _col(strategy), _col(index).cast("string")), 256), 1, 32)


def document_key(uid: str | Column, doc_id: str | Column, text: str | Column) -> Column:
    """The chunk's uid, or its document and the first 240 normalised characters."""
    return F.coalesce(F.nullif(_col(uid), F.lit("")), F.concat_ws("|", _col(doc_id).cast("string"), F.substring(normalize(text), 1, 240)))


def clipped(x: str | Column, n: int, mark: str = ELLIPSIS) -> Column:
    """The first n characters and a mark, where the text is longer."""
    x = _col(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


def clipped_within(x: str | Column, n: int) -> Column:
    """Clipped so that the mark is the n-th character."""
    x = _col(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit(ELLIPSIS))).otherwise(x)


def title(x: str | Column) -> Column:
    """White space collapsed; 45 characters and a mark where there are over 48."""
    one = F.trim(F.regexp_replace(_col(x), r"\s+", " "))
    return F.when(F.length(one) > 48, F.concat(F.rtrim(F.substring(one, 1, 45)), F.lit(ELLIPSIS))).otherwise(one)


def cited_ranks(x: str | Column) -> Column:
    """Distinct whole numbers in square brackets, in order of first occurrence."""
    found = F.regexp_extract_all(_col(x), F.lit(r"\[([0-9]{1,9})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: s.cast("int")))


def legal_id(x: str | Column) -> dict[str, Column]:
    """Parts of a legal document id: sector, year, type, code, revision; nulls and false where it is none."""
    x = _col(x)
    pattern = r"^([0-9])([0-9]{4})([A-Z]{1,2})([0-9]{4})(?:R?\(([0-9]+)\))?$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))

    return {
        "sector": part(1).cast("int"),
        "year": part(2).cast("int"),
        "type": part(3),
        "code": part(4),
        "revision": part(5),
        "is_revision": F.coalesce(part(5).isNotNull(), F.lit(False)),
    }


def document_url(base: str, x: str | Column) -> Column:
    x = F.coalesce(_col(x).cast("string"), F.lit(""))
    return F.when(x == "", "").otherwise(F.concat(F.lit(base), x))


def strip_fence(x: str | Column) -> Column:
    """Text without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_col(x)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def json_object(x: str | Column) -> Column:
    """From the first brace to the last, without a comma before a closing bracket."""
    body = F.regexp_extract(strip_fence(x), r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(body, r",\s*([}\]])", "$1"), F.lit(""))


def passage(x: str | Column) -> Column:
    return F.concat(F.lit("passage: "), _col(x))


def query(x: str | Column) -> Column:
    return F.concat(F.lit("query: "), _col(x))


def key_text(x: str | Column) -> Column:
    """An id as text; null as the empty text."""
    return F.coalesce(_col(x).cast("string"), F.lit(""))


def block_text(x: str | Column) -> Column:
    """Plain text of a stream token that may be a JSON list of text blocks."""
    x = _col(x)
    blocks = F.from_json(x, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    quoted = F.array_join(F.regexp_extract_all(x, F.lit(r"'text': '([^']*)'"), F.lit(1)), "")
    listed = F.ltrim(x).startswith("[{")
    return F.when(listed & blocks.isNotNull() & (joined != ""), joined).when(listed & (quoted != ""), quoted).otherwise(x)


def half_split(x: str | Column) -> Column:
    """Two query variants: the first and the second half of the sentences; of a single one, of the words."""
    x = F.trim(_col(x))
    sentences = F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s != "")
    words = F.split(x, r"\s+")
    parts = F.when(F.size(sentences) > 1, sentences).otherwise(words)
    middle = F.greatest(F.lit(1), (F.size(parts) / 2).cast("int"))
    return F.array(
        F.array_join(F.slice(parts, F.lit(1), middle), " "),
        F.array_join(F.slice(parts, middle + 1, F.greatest(F.lit(0), F.size(parts) - middle)), " "),
    )


def relative_time(at: str | Column, now: str | Column) -> Column:
    """Age in minutes, hours or days; from a week on month and day."""
    at, now = _col(at), _col(now)
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 1, "Just now").when(hours < 1, ago(minutes, "m")).when(days < 1, ago(hours, "h")).when(days < 7, ago(days, "d")).otherwise(F.date_format(at, "MMM d"))
    )


def variant_pair(variants: str | Column) -> Column:
    """The first two variants, trimmed, if both have 10 characters and differ in more than case; else null."""
    trimmed = F.transform(F.slice(_col(variants), 1, 2), lambda x: F.trim(x))
    long = F.forall(trimmed, lambda x: F.coalesce(F.length(x) >= 10, F.lit(False)))
    return F.when((F.size(trimmed) == 2) & long & (F.lower(F.get(trimmed, F.lit(0))) != F.lower(F.get(trimmed, F.lit(1)))), trimmed)


def cell_key(strategy: str | Column, retriever: str | Column) -> Column:
    return F.concat_ws("::", _col(strategy), _col(retriever))


def truncated_texts(texts: str | Column, n: int) -> Column:
    """Texts without the blank ones, each cut to n characters and marked where it is longer."""
    kept = F.filter(F.transform(_col(texts), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.transform(kept, lambda x: clipped(x, n, "\n[truncated]"))


def reference_texts(texts: str | Column, snippet: str | Column) -> Column:
    """The reference texts that aren't blank, or else the gold snippet, or else none."""
    present = lambda x: F.filter(F.transform(x, lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != "")
    own = present(F.coalesce(_col(texts), F.array().cast("array<string>")))
    return F.when(F.size(own) > 0, own).otherwise(present(F.array(_col(snippet))))
