"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

def once(value: Column, f) -> Column:
    """``f(value)``, where ``value`` is worked out once for a row however often ``f`` names it, also in its lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# The ordered masking patterns, as (pattern, replacement).
MASKS = (
    (r"(?i)(Authorization\s*:\s*Bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"(?i)(Bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"""(?i)(api[_-]?key['"]?\s*[:=]\s*['"]?)[A-Za-z0-9._~+/=-]+""", "$1[REDACTED]"),
    (r"(?i)(api\s*key\s*[:=]\s*)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"""(?i)(auth[_-]?token['"]?\s*[:=]\s*['"]?)[A-Za-z0-9._~+/=-]+""", "$1[REDACTED]"),
    (r"""(?i)(password|passwd|secret|credential)\s*[:=]\s*[^,\s"'}]+""", "$1=[REDACTED]"),
    (r"""(?i)(cookie['"]?\s*[:=]\s*['"]?)[^'"\n]+""", "$1[REDACTED]"),
    (r"\bsk-[A-Za-z0-9][A-Za-z0-9._-]{8,}\b", "sk-[REDACTED]"),
    (r"""(?i)postgres(?:ql)?://[^\s"'<>]+""", "postgresql://[REDACTED_DSN]"),
    (r"(?i)\b(dbname=[^\s]+\s+host=)[^\s]+", "$1[REDACTED_HOST]"),
    (r"""(?i)\b(host=)(?:localhost|127\.0\.0\.1|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[^\s"']+)""", "$1[REDACTED_HOST]"),
    (r"(?i)\b(port=)(?:5432|15432)\b", "$1[REDACTED_PORT]"),
    (r"""(?i)\b(user=)[^\s"']+""", "$1[REDACTED_USER]"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}:(?:5432|15432)\b", "[REDACTED_DB_ENDPOINT]"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "[REDACTED_IP]"),
)


#: What every masking pattern needs somewhere: one pass spares most texts the fifteen.
MAYBE_SECRET = r"(?i)bearer|api[_-]?\s*key|auth[_-]?token|password|passwd|secret|credential|cookie|sk-|postgres|dbname=|host=|port=|user=|\d\.\d{1,3}\.\d{1,3}\.\d"


def redact(text: Column) -> Column:
    masked = text
    for pattern, replacement in MASKS:
        masked = F.regexp_replace(masked, pattern, replacement)
    return F.when(text.rlike(MAYBE_SECRET), masked).otherwise(text)


def strip_wikilinks(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[([^\]]+)\]\]", "$1")


def strip_aliased_links(text: Column) -> Column:
    """[[target|label]] becomes label, [[target]] becomes target."""
    return strip_wikilinks(F.regexp_replace(text, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"))


def sanitize_name(name: Column, default: str = "unnamed") -> Column:
    kept = F.trim(F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_\s-]", ""), 1, 80))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-cased word characters; null below 8 of them."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")
    return F.transform(F.array(plain), lambda p: F.when(F.length(p) >= 8, F.sha2(p.cast("binary"), 256)))[0]  # bound once


def key_values(text: Column) -> Column:
    """Map of ``key: value`` lines, the last of equal keys."""
    keys = F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_]+): *([^\n]+)$"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_]+): *([^\n]+)$"), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: x["v"]))


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, 12)


def image_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))


def date_precision(value: Column) -> Column:
    """Precision that a date string's shape shows."""
    return (
        F.when(value.rlike(r"^\d{4}$"), "year")
        .when(value.rlike(r"^\d{4}-\d{2}$"), "month")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "time")
        .otherwise("unknown")
    )


def normalise_date(value: Column) -> Column:
    """Partial dates padded to a timestamp string; null if not a date."""
    padded = F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01T00:00:00"))).when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01T00:00:00"))).when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(value, F.lit("T00:00:00")))
    return padded


def senses(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Channels, in the lexicon's order, of which a term is in the text."""
    low = F.lower(text)
    found = [F.when(F.lit(False) if not terms else _any(low, terms), F.lit(name)) for name, terms in lexicon.items()]
    return F.array_compact(F.array(*found))


def _any(text: Column, terms: list[str]) -> Column:
    out = F.contains(text, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(text, F.lit(t))
    return out


def hits(text: Column, terms: list[str]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(F.lower(text), F.lit(t)).cast("int")
    return out


#: Words that say nothing in a search.
STOP_WORDS = ("a", "an", "and", "at", "for", "in", "is", "it", "my", "of", "on", "or", "the", "to", "was", "what", "when", "where", "who", "with")


def query_parts(query: Column) -> Column:
    """Distinct lower-cased words of a query in their order, less stop words; the whole query if none is left."""
    low = F.trim(F.lower(query))
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    kept = F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(low))


# Names of sources that stand before a body.
_SOURCES = r"(?:knowledge[_\s-]?base|pgvector|pg[_\s-]?fts|vector|fts|imprint|sqlite)"
SOURCE_PREFIX = rf"(?i)^(?:\s*(?:\[{_SOURCES}\]|{_SOURCES}(?:\s*[:：|/]\s*|\s+)))+"


def compatible(text: Column) -> Column:
    """NFKC form. Only texts with characters beyond ASCII go to Python, in Arrow batches."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(run(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def letters_fingerprint(text: Column) -> Column:
    """SHA-256 of the letters and digits of any script, without source prefixes; null below 8 of them."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(compatible(text)), SOURCE_PREFIX, ""), r"[^\p{L}\p{N}]+", "")
    return F.transform(F.array(plain), lambda p: F.when(F.length(p) >= 8, F.sha2(p.cast("binary"), 256)))[0]  # bound once


def json_object_code(raw: Column) -> Column:
    """ok, or why a text is no strict JSON object: not_object, malformed or duplicate (a key twice at the top)."""
    keys = F.json_object_keys(raw)
    top = F.regexp_extract_all(F.regexp_replace(raw, r"\{[^{}]*\{[^{}]*\}|\[[^\]]*\]", ""), F.lit('"([^"\\\\]*)"\\s*:'), F.lit(1))
    return F.when(~raw.rlike(r"^\s*\{"), "not_object").when(keys.isNull(), "malformed").when(F.size(top) != F.size(F.array_distinct(top)), "duplicate").otherwise("ok")


def extraction_code(raw: Column, most: int) -> Column:
    """ok, or why an answer is no list of at most ``most`` memories with a content."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
    rows = F.when(text.startswith("["), F.from_json(text, "array<struct<content:string>>"))
    bad = F.exists(rows, lambda x: x["content"].isNull() | (F.trim(x["content"]) == ""))
    return F.when(rows.isNull(), "invalid").when(F.size(rows) > most, "too_many").when(bad, "no_content").otherwise("ok")


def provenance_code(kind: Column, fields: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """ok, or why a provenance is refused: a field nobody knows, an unknown kind, a field of another kind."""
    every = F.array(*[F.lit(f) for fs in allowed.values() for f in fs])
    of_kind = F.coalesce(*[F.when(kind == k, F.array(*[F.lit(f) for f in fs])) for k, fs in allowed.items()])
    return F.when(F.size(F.array_except(fields, every)) > 0, "unknown_field").when(of_kind.isNull(), "unknown_kind").when(F.size(F.array_except(fields, of_kind)) > 0, "disallowed").otherwise("ok")


def body_lead(text: Column, most: int = 24) -> Column:
    """The first sentence of 4 to 24 characters of the first line that isn't a mark, as a list."""
    lines = F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^\s*(?:---|——.*——|\[[^\]]*\]|[#>*\-|]+)\s*$"))
    found = F.transform(lines, lambda x: F.coalesce(F.nullif(F.trim(F.regexp_extract(x, "[^。！？!?；;\n]{4,24}", 0)), F.lit("")), F.when(F.length(x) >= 4, F.substring(x, 1, most))))
    return F.slice(F.filter(found, lambda x: x.isNotNull()), 1, 1)


def literal_keys(text: Column, given: Column, generic: tuple[str, ...], most: int = 4) -> Column:
    """Up to ``most`` keys of the text's key line and of ``given`` that stand in the text,
    have 2 to 48 characters, some letter, and aren't generic; of equal ones, whatever their case, the first."""
    line = F.split(F.regexp_extract(text, r"\[检索钥匙:\s*([^\]\n]+)\]", 1), "/")
    clean = F.transform(F.concat(line, given), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\[\[|\]\]$", "")))
    ok = F.filter(clean, lambda x: F.length(x).between(2, 48) & F.contains(text, x) & ~F.lower(x).isin(*generic) & x.rlike(r"\p{L}") & ~x.rlike(r"[\x00-\x1f]"))
    first = F.filter(ok, lambda x, k: ~F.exists(F.slice(ok, 1, k), lambda y: F.lower(y) == F.lower(x)))
    return F.slice(first, 1, most)


SECRET_KEYS = r"(?i)pass(word|wd)?$|secret|token|api[_-]?key|credential|cookie|authorization"


def redact_map(values: Column) -> Column:
    """A map of texts whose secret keys lose their values and whose other values are masked."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("[REDACTED]")).otherwise(redact(v)))
