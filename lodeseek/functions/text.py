"""Text, file, URL and display functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and the language they stand for.
CODE_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hxx": "cpp", "go": "go",
}
MARKDOWN = ("md", "markdown")
TOKEN_SPLIT = r"[\s\p{Punct}]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of two bytes or more; white space and ASCII punctuation part them."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT, -1), lambda t: F.octet_length(t) >= 2)


def has_text(text: Column) -> Column:
    """Holds anything but white space of any kind; false for null."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def source_id(path: Column, web: bool = False) -> Column:
    return F.concat(F.lit("web:"), F.element_at(F.split(path, "/"), -1)) if web else path


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def code_language(path: Column) -> Column:
    """Null for anything that isn't code."""
    pairs = [F.lit(x) for item in CODE_LANGUAGES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def file_type(path: Column) -> Column:
    return F.when(extension(path).isin(*MARKDOWN), "markdown").when(code_language(path).isNotNull(), "code").otherwise("text")


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 8192 that no UTF-16 or UTF-32 byte order mark explains."""
    head = F.hex(F.substring(content, 1, 8192))
    return head.rlike("^(?:..)*?00") & ~head.rlike("^(FFFE|FEFF|0000FEFF)")


def script_leak(text: Column, marks: list[str]) -> Column:
    """At least two distinct of the given strings: script that leaked into text."""
    return sum((text.contains(m).cast("int") for m in marks), F.lit(0)) >= 2


def chunk_label(label: Column, index: Column) -> Column:
    return F.format_string("%s (chunk %d)", label, index + 1)


def chunk_number(filename: Column) -> Column:
    """The number in a chunk label, null without one."""
    number = F.regexp_extract(filename, r"\(chunk (\d+)\)", 1)
    return F.when(number != "", number.cast("int"))


def snippet(text: Column, n: int = 200) -> Column:
    """Trimmed; whole up to n characters, else cut at the last space before and closed with an ellipsis."""
    trimmed = F.trim(text)
    cut = F.substring(trimmed, 1, n)
    return F.when(F.char_length(trimmed) <= n, trimmed).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("...")))


def normalize_url(url: Column) -> Column:
    """Trailing slashes go where there are more than two slashes; query and fragment stay."""
    slashes = F.char_length(url) - F.char_length(F.replace(url, F.lit("/"), F.lit("")))
    return F.when(url.endswith("/") & (slashes > 2), F.regexp_replace(url, "/+$", "")).otherwise(url)


def url_origin(url: Column) -> Column:
    """scheme://host:port with the scheme's own port filled in."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    default = F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    return F.concat(scheme, F.lit("://"), host, F.lit(":"), F.when(port == "", default).otherwise(port))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def in_scope(url: Column, start: Column) -> Column:
    """The start's origin, and a path below the start's folder."""
    return (url_origin(url) == url_origin(start)) & F.startswith(url_path(url), F.regexp_replace(url_path(start), r"[^/]*$", ""))


def _times(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"), F.lit(" ago"))


def relative_age(then: Column, now: Column) -> Column:
    """Of epoch seconds."""
    age = F.greatest(now - then, F.lit(0).cast("long"))
    of = lambda n: F.floor(age / n)
    return (
        F.when(age < 60, "just now").when(age < 3600, _times(of(60), "min")).when(age < 86400, _times(of(3600), "hour")).otherwise(_times(of(86400), "day"))
    )


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal place, halves up, in whole numbers."""
    tenths = F.floor((n + unit // 20) / (unit // 10))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_bytes(n: Column) -> Column:
    """Decimal units; null is a dash."""
    return (
        F.when(n.isNull(), "-").when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1_000_000, F.concat(_tenths(n, 1000), F.lit(" KB")))
        .otherwise(F.concat(_tenths(n, 1_000_000), F.lit(" MB")))
    )


def format_metric(value: Column, decimals: int = 1) -> Column:
    """0, 1 or 2 decimal places, any other number of them as one; null is a dash."""
    places = decimals if decimals in (0, 1, 2) else 1
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{places}f", value.cast("double")))


def format_count(n: Column) -> Column:
    return F.coalesce(n.cast("string"), F.lit("-"))


def alibi_bytes(heads: Column, length: Column) -> Column:
    return heads.cast("long") * length * length * 4


def vector_index_bytes(n: Column, dimension: int = 512) -> Column:
    return (n * dimension * 4 * 1.2).cast("long")


def keyword_index_bytes(chunks: Column, docs: Column) -> Column:
    return (chunks + docs) * 100


def embedding_summary(v: Column, n: int = 10) -> Column:
    """The dimension and the first values."""
    first = F.array_join(F.transform(F.slice(v, 1, n), lambda x: F.format_string("%.4f", x)), ", ")
    return F.format_string("%d dims [%s]", F.size(v), first)


def progress(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """percent, eta_ms (null at 0 % and 100 %; whole milliseconds a unit) of a running job."""
    percent = F.when(total > 0, done * 100.0 / total).otherwise(0.0)
    eta = F.when((done > 0) & (done < total), F.floor(elapsed_ms / done) * (total - done))
    return F.struct(percent.alias("percent"), eta.alias("eta_ms"))


def tokens_per_second(n: Column, elapsed_ms: Column) -> Column:
    """0 where no time has passed."""
    return F.when(elapsed_ms > 0, n / (elapsed_ms / 1000.0)).otherwise(0.0)
