"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5

# Redaction rules in the order in which they apply (pattern, replacement).
REDACTIONS = (
    (r"(?i)(Bearer\s+)[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"),
    (r"(?i)(Authorization:\s*(?:Bearer|Basic|Token)\s+)[^\s\r\n,;]{8,}", "Authorization: [REDACTED]"),
    (r"\bsk-[A-Za-z0-9\-_]{20,}\b", "[REDACTED_API_KEY]"),
    (r"\bsk-ant-[A-Za-z0-9\-_]{20,}\b", "[REDACTED_API_KEY]"),
    (r"\bAIza[0-9A-Za-z\-_]{35}\b", "[REDACTED_API_KEY]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r'(?i)"(?:api[_-]?key|token|secret(?:[_-]?key)?|password|access[_-]?(?:key|token)|client[_-]?secret|private[_-]?key|secret[_-]?access[_-]?key)"\s*:\s*"[^"]{4,}"', '"[SECRET_KEY]": "[REDACTED]"'),
    (
        r"""(?i)(?:^|\b)(?:AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID|API_KEY|ACCESS_KEY|SECRET_KEY|SECRET_ACCESS_KEY|PRIVATE_KEY|token|password|secret|api[_-]key|access[_-]key|secret[_-]key|SecretKey|AccessKey)\s*[=:]\s*['"]?([A-Za-z0-9\-_+/=.@!$%^&*#]{4,})['"]?""",
        "[SECRET_KEY]=[REDACTED]",
    ),
    (r"(?im)^(?:AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID|API_KEY|ACCESS_KEY|SECRET_KEY)=([A-Za-z0-9\-_+/=.]{8,})\s*$", "[SECRET_KEY]=[REDACTED]"),
)


#: Of each rule, in lower case, literals of which one stands in every text that it matches.
_HINTS = (("bearer",), ("authorization",), ("sk-",), ("sk-",), ("aiza",), ("akia",), *[("key", "token", "secret", "password")] * 2, ("_key",))


def redact(text: Column, custom: tuple[str, ...] = ()) -> Column:
    """Secrets replaced, rule by rule in order; custom patterns last."""
    def rule(t: Column, pattern: str, instead: str, hints: tuple[str, ...]) -> Column:
        low = F.lower(t)
        may = F.contains(low, F.lit(hints[0]))
        for h in hints[1:]:
            may = may | F.contains(low, F.lit(h))
        return F.when(may, F.regexp_replace(t, pattern, instead)).otherwise(t)

    for (pattern, instead), hints in zip(REDACTIONS, _HINTS, strict=True):
        text = F.transform(F.array(text), lambda t: rule(t, pattern, instead, hints))[0]  # noqa: B023
    for pattern in custom:
        text = F.regexp_replace(text, pattern, "[REDACTED_CUSTOM]")
    return text


def has_secrets(text: Column, custom: tuple[str, ...] = ()) -> Column:
    return F.coalesce(F.greatest(*[text.rlike(p) for p in [*(p for p, _ in REDACTIONS), *custom]]), F.lit(False))


def redact_sql(text: str) -> str:
    for pattern, instead in REDACTIONS:
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{instead}', 'g')"
    return text


def truncate_middle(text: Column, head: int, tail: int, mark: str = "\n...[中间内容已截断]...\n") -> Column:
    """Head and tail of a text that is longer than both together, with a mark between them."""
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest beginning of whole characters that has at most `most` UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    inside = lambda n: F.hex(F.substring(data, n + 1, 1)).rlike("^[89AB]")  # noqa: E731  byte n + 1 goes on a character
    at = F.coalesce(*[F.when(~inside(n), F.lit(n)) for n in range(most, max(most - 4, -1), -1)])
    return F.when(F.octet_length(text) > most, F.decode(F.substring(data, F.lit(1), at), "UTF-8")).otherwise(text)


def safe_preview(text: Column, most: int) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character bigrams of two texts; 0 where neither has one."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))
    x, y = (F.when(F.length(t) > 1, grams(t)).otherwise(F.array().cast("array<string>")) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def hit_percent(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(hits * 100.0, hits + misses), 1), F.lit(0.0))


def canonical_url(url: Column) -> Column:
    """scheme://host/path in lower-case scheme and host, without `www.`, port, query, fragment and last slashes; null where it is no URL."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(host.isNotNull(), F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), host, path))


def token_estimate(text: Column) -> Column:
    """Characters over 3.5, rounded up, at least 1."""
    return F.greatest(F.ceil(F.length(text) / CHARS_PER_TOKEN), F.lit(1)).cast("long")


#: Accented letters of the Latin blocks and their bases: those whose decomposition begins with an ASCII letter.
_ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii()}
ACCENTS = "".join(_ACCENTED), "".join(_ACCENTED.values())


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.when(text.rlike("[\u00c0-\u024f]"), F.translate(text, *ACCENTS)).otherwise(text))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; a run of any script is one token."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_line(text: Column) -> Column:
    """The folded tokens of a text, each after a blank."""
    line = F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+", " "))
    return F.transform(F.array(line), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit(" "), x)))[0]


def title_key(title: Column) -> Column:
    """A title without blanks and separators, lower-cased, for matching."""
    return F.regexp_replace(F.lower(title), r"[\s:：\-—_·。.]+", "")


def first_line(text: Column, most: int = 80) -> Column:
    return F.substring(F.split(text, "\n")[0], 1, most)


def sliding_chunks(text: Column, target: int = 2800, overlap: int = 420) -> Column:
    """Array of (chunk_index, start, chunk): windows of `target` characters, `overlap` shared; blank texts have none."""
    step = target - overlap
    n = F.length(text)
    last = F.greatest(F.ceil((n - target) / step), F.lit(0)).cast("int")
    return F.when(F.trim(text) == "", F.array().cast("array<struct<chunk_index:int,start:int,chunk:string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), (i * step).cast("int").alias("start"), F.substring(text, i * step + 1, F.lit(target)).alias("chunk")))
    )


def analyse(query: str, most: int = 48) -> list[str]:
    """Search terms of a query: technical terms whole, then single characters and bigrams of CJK runs, in order."""
    import re

    cjk = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
    found: list[str] = []
    for run in re.findall(rf"[A-Za-z0-9_\-./:+#]+|[{cjk}]+", query):
        if re.match(rf"[{cjk}]", run):
            found += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
        elif len(term := run.strip(".,;").lower()) >= 2:
            found.append(term)
    return list(dict.fromkeys(found))[:most]


def search_phrases(query: str, terms: list[str]) -> list[str]:
    """The phrases of a search, as token lines whose last token is a prefix: single CJK characters only where no longer CJK term stands."""
    import re

    cjk = lambda t: bool(re.fullmatch("[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]+", t))
    longer = any(len(t) > 1 and cjk(t) for t in terms)
    kept = [t for t in terms if not (longer and len(t) == 1 and cjk(t))] or [query]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    lines = [" ".join(re.findall(r"[^\W_]+", fold(t))) for t in kept]
    return list(dict.fromkeys(f" {x}" for x in lines if x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double; null where it is undefined."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_vector(v: Column) -> Column:
    """Not empty, all finite, not all zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
