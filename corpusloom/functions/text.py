"""Text expressions: tokenizers, containment and counting, ids, and small rewrites. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of terms and clauses.
QUERY_TERM = r"[一-鿿]{2,}|[A-Za-z0-9_-]{2,}"
PROFILE_TERM = r"[一-鿿]{2,}|[A-Za-z0-9][A-Za-z0-9_-]{1,}"
LONG_CJK = r"^[一-鿿]{4,}$"
CLAUSE = r"^\s*(第[一二三四五六七八九十百千万0-9]+条|\d+(?:\.\d+){1,4})"
HEADING = r"(?i)(heading|标题)\s*([1-6一二三四五六])"
CJK_NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6}
#: Line ends other than \n that split a text into lines.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
STRIP = r"(?U)^\s+|\s+$"
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "md": "text/markdown",
    "txt": "text/plain",
}


def strip(text: Column) -> Column:
    """Removes all white space at both ends, not only spaces."""
    return F.regexp_replace(text, STRIP, "")


def _with_bigrams(terms: Column, text: Column) -> Column:
    """Adds the bigrams of long CJK terms; a text without such a run is spared the look at each term."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    long = F.flatten(F.transform(terms, lambda t: F.when(t.rlike(LONG_CJK), F.concat(F.array(t), pairs(t))).otherwise(F.array(t))))
    return F.when(text.rlike(LONG_CJK.strip("^$")), long).otherwise(terms)


def _terms(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Distinct terms in order, with the bigrams of CJK terms of four characters or more; case is kept."""
    return F.array_distinct(_with_bigrams(_terms(text, QUERY_TERM), text))


def rerank_tokens(text: Column) -> Column:
    return F.array_distinct(_with_bigrams(F.transform(_terms(text, QUERY_TERM), lambda t: F.lower(t)), text))


def profile_tokens(text: Column) -> Column:
    """As query_tokens, but a Latin term begins with a letter or digit, and terms are in lower case."""
    return F.array_distinct(F.transform(_with_bigrams(_terms(text, PROFILE_TERM), text), lambda t: F.lower(t)))


def embedding_tokens(text: Column) -> Column:
    """Of the lower-cased text, and not distinct: repeats weigh."""
    return _with_bigrams(_terms(F.lower(text), QUERY_TERM), text)


#: name -> the terms of a text as BM25 counts them; a user may add analyzers.
ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "default": embedding_tokens,
    "whitespace": lambda text: F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""),
    "english": lambda text: _terms(F.lower(text), r"[a-z0-9]+"),
}


def register_analyzer(name: str, terms: Callable[[Column], Column]) -> None:
    ANALYZERS[name] = terms


def count_of(text: Column, token: Column) -> Column:
    """Occurrences that do not overlap; none of an empty token."""
    n = (F.length(text) - F.length(F.replace(text, token))) / F.length(token)
    return F.when(F.length(token) > 0, n).otherwise(F.lit(0)).cast("long")


def sha256_of(*parts: Column, sep: str = "::") -> Column:
    """The stable id of the parts: hex SHA-256 of them joined, null parts as empty."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def starts_clause(text: Column) -> Column:
    return text.rlike(CLAUSE)


def clause_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CLAUSE, 1), F.lit(""))


def heading_level(style: Column) -> Column:
    """1 to 6 of a heading style's name, else null."""
    raw = F.regexp_extract(style, HEADING, 2)
    numerals = F.create_map(*[F.lit(x) for kv in CJK_NUMERALS.items() for x in kv])
    return F.coalesce(F.try_element_at(numerals, raw), raw.try_cast("int"))


def section_path(stack: Column, text: Column) -> Column:
    """The headings joined, and the clause's number if the text starts one."""
    return F.concat_ws(" > ", F.array_join(stack, " > "), clause_number(text))


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: white space collapsed, empty rows dropped, bars escaped."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))))
    clean = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(clean[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(1))), line)
    return F.when(F.size(clean) == 0, "").otherwise(F.array_join(F.concat(F.array(line(clean[0]), rule), body), "\n"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def clean_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")


def mime_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor zero nor empty text; else the last."""
    picked = columns[-1]
    for c in reversed(columns[:-1]):
        picked = F.when(c.isNotNull() & (c.cast("string") != "") & (c.cast("string").isin("0", "0.0", "-0.0", "false") == F.lit(False)), c).otherwise(picked)
    return picked


def clamp(score: Column) -> Column:
    """Into 0 to 1; NaN and infinities are 0."""
    odd = F.isnan(score) | (F.abs(score) == F.lit(float("inf")))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def temperature(t: Column) -> Column:
    return F.greatest(F.lit(0.01), F.least(t, F.lit(1.0)))


def fixed(number: Column, digits: int) -> Column:
    """With so many digits after the point; halves are rounded away from zero."""
    return F.when(number.isNotNull(), F.format_string(f"%.{int(digits)}f", F.round(number.cast("double"), digits)))


def rounded(number: Column, digits: int) -> Column:
    """With so many digits after the point, as C and Python print the number: its binary value is rounded, exact halves to the even digit."""
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def megabytes(size: Column) -> Column:
    return F.concat(fixed(size / F.lit(1048576.0), 2), F.lit(" MB"))


def iso(at: Column) -> Column:
    """A time as text, YYYY-MM-DDTHH:MM:SS, with microseconds if there are any; null for null."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def json_object(text: Column) -> Column:
    """The outermost {...} of a model's answer, without code fences; the stripped text if there is none."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"^```(?i:json)?", ""), r"```$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(bare)


SEPARATOR = "__LLM_RESPONSE__"


def envelope(context_json: Column, answer: Column) -> Column:
    """Base64 of the context, the separator, the answer."""
    return F.concat(F.regexp_replace(F.base64(context_json.cast("binary")), r"\s", ""), F.lit(SEPARATOR), answer)


def envelope_context(message: Column) -> Column:
    at = F.instr(message, SEPARATOR)
    return F.when(at > 0, F.unbase64(F.substring(message, F.lit(1), at - 1)).cast("string"))


def envelope_answer(message: Column) -> Column:
    """What stands after the last separator; the whole message without one."""
    return F.element_at(F.split(message, SEPARATOR, -1), -1)


def link_citations(text: Column) -> Column:
    """Citations in one or two pairs of brackets as links to their number."""
    text = F.regexp_replace(text, r"\[\[[cC]itation", "[citation")
    text = F.regexp_replace(text, r"[cC]itation:(\d+)\]\]", "citation:$1]")
    return F.regexp_replace(text, r"\[[cC]itation:(\d+)\]", "[citation]($1)")


def fence_thoughts(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<think>"), F.lit("## 💭 深度思考\n```think")), F.lit("</think>"), F.lit("```"))
