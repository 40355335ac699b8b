"""Volumes, line differences, repaired replies and content keys of texts."""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIFF = "same: long, added: long, removed: long, truncated: boolean, identical: boolean, rows: array<struct<kind: string, text: string>>"


def _volumes(text: str, most: int) -> list[str]:
    data, at, out = text.encode(), 0, []
    while len(data) - at > most:
        end = at + most
        while data[end] & 0xC0 == 0x80:  # not inside a character
            end -= 1
        least = at + most // 3
        cuts = (data.rfind(b"\n## ", at, end) + 1, data.rfind(b"\n", at, end) + 1)
        cut = next((c for c in cuts if c > at and c >= least), end)
        out.append(data[at:cut].decode())
        at = cut
    return [*out, data[at:].decode()] if at < len(data) or not out else out


def volumes(text: Column, most: int = 4 << 20) -> Column:
    """A document as parts of at most `most` UTF-8 bytes (4 at least), which concatenate to it.

    Parts end before a heading or after a line if one ends in their last two thirds, else
    between characters.  Empty: one empty part; null: null.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _volumes(t, most))

    return cut(text)


def _diff(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    same = next((i for i, (a, b) in enumerate(zip(before, after, strict=False)) if a != b), min(len(before), len(after)))
    left, right = before[same:], after[same:]
    best = [[0] * (len(right) + 1)]  # best[-1 - i][j]: the longest common subsequence of left[i:] and right[j:]
    for line in reversed(left):
        below, row = best[-1], [0] * (len(right) + 1)
        for j in range(len(right) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if line == right[j] else max(below[j], row[j + 1])
        best.append(row)
    best.reverse()
    out, i, j = [("same", x) for x in before[:same]], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i] == right[j]:
            out.append(("same", left[i]))
            i, j = i + 1, j + 1
        elif i == len(left) or (j < len(right) and best[i][j + 1] > best[i + 1][j]):
            out.append(("added", right[j]))
            j += 1
        else:
            out.append(("removed", left[i]))
            i += 1
    return out


def _bits(places: list[int], size: int) -> int:
    out = bytearray(size // 8 + 1)
    for i in places:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def _common(before: list[str], after: list[str]) -> int:
    """The length of a longest common subsequence, by bit-parallel columns: one bit a line of before, no table."""
    least = min(len(before), len(after))
    head = next((i for i in range(least) if before[i] != after[i]), least)
    tail = next((i for i in range(least - head) if before[-1 - i] != after[-1 - i]), least - head)
    left, right = before[head : len(before) - tail], after[head : len(after) - tail]
    size, at = len(left), defaultdict(list)
    for i, line in enumerate(left):
        at[line].append(i)
    often = {line: _bits(p, size) for line, p in at.items() if len(p) ** 2 > size}
    full = rest = (1 << size) - 1
    for line in right:
        if line in at:
            hit = rest & (often[line] if line in often else _bits(at[line], size))
            rest = ((rest + hit) | (rest - hit)) & full
    return head + tail + size - rest.bit_count()


def _changes(before: str | None, after: str | None, preview: bool, most_lines: int, most_rows: int, most_chars: int, most_shown: int) -> tuple:
    texts = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in (before, after)]
    a, b = (t.split("\n") for t in texts)
    same = _common(a, b)
    cut = [(t or "")[:most_chars].replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in (before, after)]
    truncated = any(len(t or "") > most_chars or len(c) > most_lines for t, c in zip((before, after), cut, strict=True))
    rows = None
    if preview or not truncated:
        x, y = (c[:most_lines] for c in cut)
        longest = max(map(len, [*x, *y]))
        if preview or (longest > most_shown and len(x) + len(y) > most_rows):
            rows = _diff(x, y)
            truncated |= len(rows) > most_rows or any(len(t) > most_shown for _, t in rows[:most_rows])
            rows = [{"kind": k, "text": t if len(t) <= most_shown else t[:most_shown] + "…"} for k, t in rows[:most_rows]] if preview else None
        else:
            truncated |= longest > most_shown or len(a) + len(b) - same > most_rows
    return same, len(b) - same, len(a) - same, truncated, texts[0] == texts[1], rows


def line_diff(before: Column, after: Column, preview: bool = False, most_lines: int = 320, most_rows: int = 500, most_chars: int = 64_000, most_shown: int = 800) -> Column:
    """struct(same, added, removed, truncated, identical, rows) of an exact line difference.  Null counts as empty.

    The counts and identical are those of the whole texts.  rows, only with preview, are (kind, text) of the
    first `most_lines` lines of the first `most_chars` characters, `most_rows` rows at most and `most_shown`
    characters of each; kinds are same, removed and added, removed first on ties.  truncated: such rows leave
    something out.
    """

    @F.pandas_udf(DIFF)
    def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [_changes(x, y, preview, most_lines, most_rows, most_chars, most_shown) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=["same", "added", "removed", "truncated", "identical", "rows"]).astype({"rows": object})

    return diff(before, after)


def _object_in(text: str) -> str | None:
    """The first JSON object in a text that is incomplete or has trailing commas, closed where it breaks off."""
    start = text.find("{")
    if start < 0:
        return None
    open_, quoted, escaped, end = [], False, False, len(text)
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None
            if not open_:
                end = i + 1
                break
    body = text[start:end]
    if quoted:
        body = (body[:-1] if escaped else body) + '"'
    closing = "".join(reversed(open_))
    # a member that has no value yet goes: first its comma or colon, then the whole member
    for tail in ("", r"[\s,:]+$", r',?\s*"(?:[^"\\]|\\.)*"\s*:?\s*$', r",?\s*\"(?:[^\"\\]|\\.)*\"\s*:\s*[^\s,{}\[\]\"]*$"):
        tried = (re.sub(tail, "", body) if tail else body) + closing
        for form in (tried, re.sub(r",(\s*[}\]])", r"\1", tried)):
            try:
                return json.dumps(json.loads(form), ensure_ascii=False)
            except ValueError:
                pass
    return None


def reply_json(reply: Column) -> Column:
    """struct(json, repaired) of a model's reply: thoughts and fences removed, strictly valid JSON as it is, the rest repaired.

    Only rows that are not valid reach Python with a text.  Without an object json is null.
    """

    @F.pandas_udf("string")
    def mend(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _object_in(t))

    plain = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?m)^\s*```[A-Za-z]*\s*$", ""), r"^\s+|\s+$", "")
    valid = plain.startswith("{") & F.try_parse_json(plain).isNotNull()
    return F.struct(F.when(valid, plain).otherwise(mend(F.when(~valid, plain))).alias("json"), (~valid).alias("repaired"))


def content_key(*parts: Column) -> Column:
    """A cache key of several values: their lengths keep neighbours apart, null differs from empty."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts)), 256)
