"""Preparing and mutating text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.hashing import share_below

FILLER = " [revised in a later edition] "
FRACTION, LINE_FRACTION, LONG = 0.1, 0.15, 40


#: Signs that end a line (CR and LF together are one end), and blanks.
ENDS = "\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
BLANKS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def mutate_lines(text: Column, key: Column, fraction: float = LINE_FRACTION, filler: str = FILLER) -> Column:
    """Lines of more than LONG characters, with their ends, get the filler in their middle with this probability, drawn by md5 of key and line number."""

    def change(line, i):
        half = F.floor(F.length(line) / 2).cast("int")
        picked = (F.length(line) > LONG) & share_below(F.concat_ws(":", key.cast("string"), i.cast("string")), "line", fraction)
        return F.when(picked, F.concat(line.substr(F.lit(1), half), F.lit(filler), line.substr(half + 1, F.length(line)))).otherwise(line)

    return F.array_join(F.transform(F.split(text, f"(?<=[{ENDS}])(?<!\r(?=\n))"), change), "")


def chosen(key: Column, fraction: float = FRACTION) -> Column:
    return share_below(key, "42", fraction)


def second_version(docs: DataFrame) -> DataFrame:
    """documents with about a tenth of them revised."""
    return docs.withColumn("text", F.when(chosen(F.col("doc_id")), mutate_lines(F.col("text"), F.col("doc_id"))).otherwise(F.col("text")))


def _below(key: str, salt: str, fraction: float) -> str:
    return f"('0x' || substr(md5({key} || ':{salt}'), 1, 8))::bigint < {int(fraction * (1 << 32))}"


def mutate_sql(text: str = "text", key: str = "doc_id") -> str:
    line = f"case when length(l) > {LONG} and {_below(key + '::varchar || chr(58) || (i - 1)::varchar', 'line', LINE_FRACTION)} then l[1:length(l) // 2] || '{FILLER}' || l[length(l) // 2 + 1:] else l end"
    ends = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
    return rf"case when {text} is null then null else array_to_string(list_transform(regexp_extract_all({text}, '[^{ends}]*(?:\r\n|[{ends}])|[^{ends}]+'), lambda l, i: {line}), '') end"


def second_version_sql() -> str:
    return f"select doc_id, case when {_below('doc_id::varchar', '42', FRACTION)} then {mutate_sql()} else text end as text, lang, source, n_chars from documents"


#: What goes, one after another: links to pages (their label stays), links to addresses (likewise), headings, quotes, tags, long gaps.
MARKUP = [
    (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
    (rf"\[https?://[^{BLANKS}]+[{BLANKS}]+([^\]]+)\]", "$1"),
    (r"={2,}([^=]+)={2,}", "$1"),
    (r"'{2,}", ""),
    (r"<[^>]+>", ""),
    (r"\n{3,}", "\n\n"),
]


def strip_markup(text: Column) -> Column:
    """Links to their labels, headings to their words; quotes, tags and long gaps go, and blanks at both ends."""
    for pattern, to in MARKUP:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", "")


#: A pair of braces or a single one, each with the signs up to the next.
PIECES = r"(?:\{\{|\}\}|[{}])[^{}]*|[^{}]+"


def _let(value: Column, f) -> Column:
    """f(value); what a lambda gets is evaluated once, however often it is named."""
    return F.transform(F.array(value), f)[0]


def _depths(signs: Column, depth: Column, sections: tuple[int, ...] = (256, 16)) -> Column:
    """The depth before each sign (1, -1 or 0): a running sum that never falls below 0. An array that grows by one is copied each time, so it is kept short: sections begin with what a plain sum gives."""

    def add(depth, sign):
        return F.greatest(depth + sign, F.lit(0))

    def running(items, step):
        return F.aggregate(items, F.array(depth), lambda seen, x: F.array_append(seen, step(F.element_at(seen, -1), x)))

    if not sections:
        seen = running(signs, add)
    else:
        n, *shorter = sections
        begins = running(F.sequence(F.lit(1), F.size(signs) + 1, F.lit(n)), lambda depth, k: F.aggregate(F.slice(signs, k, n), depth, add))
        seen = F.flatten(F.transform(begins, lambda depth, k: _let(F.slice(signs, k * n + 1, n), lambda some: _depths(some, depth, shorter))))
    return F.slice(seen, 1, F.size(signs))


def remove_templates(text: Column) -> Column:
    """{{...}} with any nesting, which no regular expression can match. What is not closed takes the rest along; }} outside stays. Without Python, whose batches follow the rows and not the bytes."""

    def sign(piece):
        return F.when(piece.startswith("{{"), 1).when(piece.startswith("}}"), -1).otherwise(0)

    def shown(piece, depth):
        return F.when((depth == 0) & ~piece.startswith("{{"), piece).when((depth == 1) & piece.startswith("}}"), piece.substr(F.lit(3), F.length(piece))).otherwise("")

    def outside(pieces):
        return F.array_join(F.zip_with(pieces, _let(F.transform(pieces, sign), lambda signs: _depths(signs, F.lit(0))), shown), "")

    return F.when(F.contains(text, F.lit("{{")), _let(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), outside)).otherwise(text)


def is_article(title: Column, ns: Column, text: Column) -> Column:
    return (ns == 0) & (F.trim(title) != "") & (text != "") & ~F.upper(F.ltrim(text)).startswith("#REDIRECT")


def shard_path(number: Column, per_folder: int = 10_000) -> Column:
    return F.concat(F.lpad(F.floor(number / per_folder).cast("string"), 2, "0"), F.lit("/"), F.lpad(number.cast("string"), 6, "0"), F.lit(".txt"))
