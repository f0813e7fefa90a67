"""Column expressions: text, JSON, paths, vectors. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recall tokens are runs of letters and digits; humps are split where an upper case letter begins a word.
COMPONENT = r"[\p{L}\p{N}]+"
#: Compounds keep their inner punctuation.
COMPOUND = r"[\p{L}\p{N}]+(?:[._/@:+-][\p{L}\p{N}]+)+"
BLANK_ENDS = r"(?U)^\s+|\s+$"
#: Terminal sequences (with parameters; of the operating system, up to their end; of two characters) and control characters other than tab and line feed.
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?|\x1b[@-_]?"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without white space (any Unicode white space, line breaks too) at both ends."""
    return F.regexp_replace(_c(x), BLANK_ENDS, "")


def normalized(x: Column | str) -> Column:
    """White space runs as one space, trimmed, lower case: the form in which near copies are compared."""
    return F.lower(trimmed(F.regexp_replace(_c(x), r"(?U)\s+", " ")))


def blank(x: Column | str) -> Column:
    """Null or only white space."""
    return F.coalesce(trimmed(x) == "", F.lit(True))


def without_control(x: Column | str) -> Column:
    """Without terminal sequences and control characters other than tab and line feed."""
    return F.regexp_replace(F.regexp_replace(_c(x), ANSI, ""), CONTROL, "")


def folded(x: Column | str) -> Column:
    """Humps split (``fooBar`` to ``foo Bar``, ``ABCDef`` to ``ABC Def``), then lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(x), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2"), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2"))


def components(x: Column | str) -> Column:
    """Tokens of letters and digits of the folded text, in order, with repeats."""
    return F.regexp_extract_all(folded(F.coalesce(_c(x), F.lit(""))), F.lit(COMPONENT), F.lit(0))


def lexical_tokens(x: Column | str) -> Column:
    """Distinct compounds and components of a text."""
    t = folded(F.coalesce(_c(x), F.lit("")))
    return F.array_union(F.regexp_extract_all(t, F.lit(COMPOUND), F.lit(0)), components(x))


def utf8_bytes(x: Column | str) -> Column:
    """UTF-8 bytes of a text; null counts 0."""
    return F.coalesce(F.octet_length(_c(x)), F.lit(0)).cast("bigint")


def utf16_units(x: Column | str) -> Column:
    """Length in UTF-16 units, the measure of texts budgets."""
    return (F.octet_length(F.encode(_c(x), "UTF-16BE")) / 2).cast("int")


def byte_guarded(x: Column | str, limit: int) -> Column:
    """The text, or null if it takes more than ``limit`` bytes."""
    return F.when(F.octet_length(_c(x)) <= limit, _c(x))


def bounded_tail(x: Column | str, limit: int) -> Column:
    """The newest ``limit`` characters; a cut text starts after its first white space, if it has any."""
    x = _c(x)
    tail = F.right(x, F.lit(limit))
    at = F.regexp_instr(tail, F.lit(r"\s"))
    return F.when(F.length(x) <= limit, x).otherwise(F.when(at > 0, F.substr(tail, at + 1)).otherwise(tail))


def head_and_tail(x: Column | str, limit: int) -> Column:
    """A third from the head and two thirds from the tail, with a mark saying how much is left out."""
    x, head = _c(x), limit // 3
    tail = limit - head
    mark = F.concat(F.lit("\n[... "), (F.length(x) - F.lit(limit)).cast("string"), F.lit(" characters omitted ...]\n"))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substr(x, F.lit(1), F.lit(head)), mark, F.right(x, F.lit(tail))))


def snippet(x: Column | str, term: Column, before: int = 400, after: int = 1200) -> Column:
    """The text around the first match of ``term`` (case is ignored); null without a match."""
    x = _c(x)
    at = F.instr(F.lower(x), F.lower(term))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substr(x, start, at + after - start))


def first_prompt_document(x: Column | str, limit: int = 4000) -> Column:
    """A prompt as it is indexed: command marks and shell operators off, the first ``limit`` characters."""
    return F.substr(F.regexp_replace(_c(x), r"\$\(|`|\$\{|&&|\|\||;;", " "), F.lit(1), F.lit(limit))


def token_estimate(chars: Column) -> Column:
    """Tokens of so many characters, four to a token."""
    return F.ceil(chars / F.lit(4)).cast("bigint")


def public_id(*parts: Column) -> Column:
    """URL-safe base64, without padding, of the JSON array of the parts."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(F.array(*[p.cast("string") for p in parts])), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def public_id_parts(x: Column | str) -> Column:
    """The parts of a public id, or null if it is none."""
    raw = F.translate(_c(x), "-_", "+/")
    padded = F.concat(raw, F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(raw), F.lit(4))))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "array<string>")


def fingerprint(x: Column | str, window: int = 4096) -> Column:
    """Sixteen hex digits that tell the last ``window`` characters of a text."""
    return F.substr(F.sha2(F.right(_c(x), F.lit(window)), 256), F.lit(1), F.lit(16))


def newest_text(prompt: Column | str, reply: Column | str, limit: int = 4000) -> Column:
    """What is embedded of a turn: the newest ``limit`` characters of prompt and reply."""
    return F.right(F.concat_ws("\n", _c(prompt), _c(reply)), F.lit(limit))


def discriminator(x: Column | str, limit: int = 80) -> Column:
    """An unknown type as it may be shown: without control characters, and if it is long its first ``limit`` characters with a digest of all."""
    t = without_control(x)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substr(t, F.lit(1), F.lit(limit)), F.lit("~"), F.substr(F.sha2(t, 256), F.lit(1), F.lit(12))))


def iso_millis(x: Column | str) -> Column:
    """Milliseconds of an ISO time stamp with date and time; null for any other text."""
    t = _c(x)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$"), F.unix_millis(F.try_to_timestamp(t)))


def json_strings(x: Column | str) -> Column:
    """The strings of a JSON array, other entries left out; empty for what is no array."""
    x = _c(x)
    kept = F.filter(F.from_json(x, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    return F.when(x.isNull(), None).otherwise(F.coalesce(F.transform(kept, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>")))


def json_length(x: Column | str) -> Column:
    """Length of a JSON array: 0 for other JSON, null for what is no JSON."""
    x = _c(x)
    return F.when(x.isNull(), None).otherwise(F.when(F.try_parse_json(x).isNull(), None).otherwise(F.coalesce(F.json_array_length(x), F.lit(0))))


def protected_array(x: Column | str) -> Column:
    """Whether a JSON text must be kept: blank is not, anything that is no empty array is."""
    x = _c(x)
    return F.when(blank(x), False).otherwise(F.coalesce(F.json_array_length(x) > 0, F.lit(True)))


def within(path: Column | str, root: Column | str) -> Column:
    """Whether a path is a root or lies under it."""
    p, r = F.regexp_replace(_c(path), "(?<=.)/+$", ""), F.regexp_replace(_c(root), "(?<=.)/+$", "")
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/"))) | (r == "/")


def patch_paths(x: Column | str) -> Column:
    """Paths that a patch text adds, updates, deletes or moves to, distinct and in order."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"(?m)^\*\*\* (?:Update File|Add File|Delete File|Move to): (.+?)\s*$"), F.lit(1)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def usable(v: Column | str, dimensions: Column | str) -> Column:
    """Whether a vector has as many values as it should, all finite and not all zero."""
    v = _c(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == _c(dimensions)) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays, clamped to [-1, 1]; null if either is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two arrays as sets; null when either is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def idf(n: Column, df: Column) -> Column:
    """ln((n + 1) / (df + 1)) + 1."""
    return F.log((n + 1) / (df + 1)) + 1


def clock(x: Column | str) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm:ss.SSSSSS")
