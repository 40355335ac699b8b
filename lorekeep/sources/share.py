"""Public share pages of conversations, as rows of messages.

A page carries its conversation as a flat table in a script: whole numbers inside it are places of
that table, keys `_n` name the string at place n.  Older pages have plain JSON in a script of their
own.  A small decoder gives a page's conversation as JSON; what its messages say is rendered by
Spark expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping

# The call and the names by which pages carry their conversation.
CALL = re.compile(r"streamController\.enqueue\(")
LEGACY_ID = "__NEXT_DATA__"
ROUTE = "routes/share.$shareId.($action)"
# Marks of citations, and of what shows nothing.
CITATIONS = r"[^\S\n]*(?:citeturn|navlist|turn\d+\w*)[^,\s]*,?"
PRIVATE = r"[\x{E000}-\x{F8FF}]"

SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.I | re.S)
TOKEN = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[()"'`]""", re.S)
NAMED_ID = re.compile(r"""(?:^|\s)id\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DEEPEST = 8


def arguments(script: str) -> Iterator[str]:
    """What is handed to each call, up to its closing bracket; brackets inside strings don't count.  A call that never closes ends the search."""
    at = 0
    while call := CALL.search(script, at):
        open_, at = 1, None
        for token in TOKEN.finditer(script, call.end()):
            open_ += {"(": 1, ")": -1}.get(token[0], 0)
            if token[0] in "\"'`":  # a string that is never closed
                return
            if not open_:
                yield script[call.end() : token.start()]
                at = token.end()
                break
        if at is None:
            return


def table_of(argument: str) -> list | None:
    """The flat table in an argument: an array, or a string that holds one, with brackets around it or not."""
    text = argument.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    try:
        got = json.loads(text)
        got = json.loads(got) if isinstance(got, str) and got.lstrip().startswith("[") else got
    except ValueError:
        return None
    return got if isinstance(got, list) else None


def unflattened(table: list) -> dict:
    """The named values of a table, with places replaced by what stands there.

    A place that is asked for while it is being resolved is null, so that circles end; numbers
    that are no place stay.  The first of several values of a name counts.
    """
    known: dict[int, object] = {}

    def place(x) -> bool:
        return type(x) is int and 0 <= x < len(table)

    def asked(x) -> Iterator[int]:
        if place(x):
            yield x
        elif isinstance(x, (list, dict)):
            for y in x.values() if isinstance(x, dict) else x:
                yield from asked(y)

    def name(key: str) -> str:
        n = int(key[1:]) if re.fullmatch(r"_[0-9]+", key) else -1
        return table[n] if place(n) and isinstance(table[n], str) else key

    def built(x):
        if place(x):
            return known[x]
        if isinstance(x, dict):
            return {name(k): built(y) for k, y in x.items()}
        return [built(y) for y in x] if isinstance(x, list) else x

    def value(x):
        waiting = [(None, asked(x))]  # a stack of its own: chains of places may be long
        while waiting:
            of, rest = waiting[-1]
            new = next((n for n in rest if n not in known), None)
            if new is not None:
                known[new] = None
                waiting.append((new, asked(table[new])))
                continue
            waiting.pop()
            if of is not None:
                known[of] = built(table[of])
        return built(x)

    out: dict = {}
    for n in range(1, len(table) - 1, 2):
        if isinstance(table[n], str) and table[n] not in out:
            out[table[n]] = value(table[n + 1])
    return out


def _found(node, wanted: Callable[[dict], bool], deep: int = 0, seen: set[int] | None = None) -> dict | None:
    """The first object, itself before its parts, that is wanted."""
    seen = set() if seen is None else seen
    if deep > DEEPEST or not isinstance(node, (dict, list)) or id(node) in seen:
        return None
    seen.add(id(node))
    if isinstance(node, dict) and wanted(node):
        return node
    parts = node.values() if isinstance(node, dict) else node
    return next((hit for part in parts if (hit := _found(part, wanted, deep + 1, seen)) is not None), None)


def _at(node, *path: str):
    for key in path:
        node = node.get(key) if isinstance(node, dict) else None
    return node


def _is_conversation(x: dict) -> bool:
    lines, mapping = x.get("linear_conversation"), x.get("mapping")
    return (isinstance(lines, list) and bool(lines)) or (isinstance(mapping, dict) and bool(mapping))


def _text(*found) -> str | None:
    return next((x for x in found if isinstance(x, str)), None)


def conversation(html: str) -> str | None:
    """A page's conversation as JSON with form, share_id, model, title, updated and messages; None where it has none."""
    scripts = [(m[1], m[2]) for m in SCRIPT.finditer(html)]
    table = next((t for _, s in scripts for a in arguments(s) if (t := table_of(a)) is not None), None)
    data = None
    if table is not None:
        form, whole = "table", unflattened(table)
        route = _at(whole, "loaderData", ROUTE)
        data = _at(route, "serverResponse", "data")
        data = data if isinstance(data, dict) else _found(whole, _is_conversation)
        named = _found(whole, lambda x: isinstance(x.get("sharedConversationId"), str))
        ids = _at(route, "sharedConversationId"), _at(named, "sharedConversationId")
    if data is None:
        form, ids = "legacy", ()
        text = next((s for a, s in scripts if (m := NAMED_ID.search(a)) and LEGACY_ID in m.groups()), None)
        try:
            whole = json.loads(text) if text else None
        except ValueError:
            return None
        data = _at(whole, "props", "pageProps", "serverResponse", "data")
        data = data if isinstance(data, dict) else _found(whole, _is_conversation)
        if data is None:
            return None
    mapping, lines = data.get("mapping"), data.get("linear_conversation")
    messages = []
    for line in lines if isinstance(lines, list) else []:
        node = _at(mapping, line["id"]) if isinstance(line, dict) and isinstance(line.get("id"), str) else None
        message = _at(node if isinstance(node, dict) else line, "message")
        if isinstance(message, dict):
            messages.append(message)
    author = _text(data.get("author_name"), "User") if form == "legacy" else "User"
    return json.dumps({"form": form, "share_id": _text(*ids, data.get("conversation_id"), "shared"), "model": _text(_at(data, "model", "slug"), ""), "title": _text(data.get("title"), ""), "updated": data.get("update_time"), "author": author, "messages": messages})


def _string(v: Column, path: str = "$") -> Column:
    """What stands at a path if it is a string; else null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _shown(text: Column) -> Column:
    return F.regexp_replace(text, PRIVATE, "")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _lines(parts: Column, between: str = "\n\n") -> Column:
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), between)


def _asset(kind: Column, url: Column, name: Column, label: Column) -> Column:
    """A link to a file that can be fetched, or a note on one that can't."""
    image, folder = kind == "image", F.when(kind == "image", "images/").otherwise("attachments/")
    link = F.concat(F.when(image, "![").otherwise("["), name, F.lit("]("), folder, name, F.lit(")"))
    note = F.concat(F.lit("*"), F.when(image, "Image").otherwise("Attachment"), F.lit(" '"), F.coalesce(label, name), F.lit("' not included in export (source: "), F.when(url == "", "unavailable source").otherwise(url), F.lit(").*"))
    return F.when(F.lower(url).startswith("http"), link).otherwise(note)


def _file_name(message_id: Column, n: Column, mime: Column) -> Column:
    first = F.coalesce(F.nullif(F.split_part(message_id, F.lit("-"), F.lit(1)), F.lit("")), F.lit("asset"))
    kind = F.when(F.contains(mime, F.lit("/")), F.nullif(F.substring_index(mime, "/", -1), F.lit("")))
    return F.concat(first, F.lit("-"), n.cast("string"), F.lit("."), F.coalesce(kind, F.lit("bin")))


def _part(part: Column, message_id: Column, n: Column) -> Column:
    """A part of mixed content: text, or the n-th file of its message."""
    kind, pointer = F.coalesce(_string(part, "$.content_type"), _string(part, "$.type")), _string(part, "$.asset_pointer")
    texts = F.when(F.try_variant_get(part, "$.text", "array<variant>").isNotNull(), F.array_join(F.filter(F.transform(_list(part, "$.text"), lambda t: _trim(_shown(_string(t)))), lambda t: t != ""), "\n\n")).otherwise(_shown(_string(part, "$.text")))
    image = kind == "image_asset_pointer"
    file = _asset(F.when(image, "image").otherwise("file"), pointer, _file_name(message_id, n, _string(part, "$.mime_type")), F.lit(None).cast("string"))
    return _trim(F.coalesce(_shown(_string(part)), F.when(kind == "text", texts).when(image | (kind == "file"), file)))


def _is_file(part: Column) -> Column:
    kind = F.coalesce(_string(part, "$.content_type"), _string(part, "$.type"))
    return F.coalesce(kind.isin("image_asset_pointer", "file") & (F.coalesce(_string(part, "$.asset_pointer"), F.lit("")) != ""), F.lit(False))


def _mixed(c: Column, message_id: Column) -> Column:
    parts = _list(c, "$.parts")
    begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    step = lambda s, p: F.struct((s.n + _is_file(p).cast("int")).alias("n"), F.concat(s.out, F.array(F.when(_is_file(p) | ~F.coalesce(_string(p, "$.content_type"), _string(p, "$.type"), F.lit("")).isin("image_asset_pointer", "file"), _part(p, message_id, s.n)))).alias("out"))
    return _lines(F.aggregate(parts, begin, step).out)


def _said(part: Column) -> Column:
    """A part of plain text; an object in JSON that has a response or a content stands for that."""
    text = F.regexp_replace(_shown(_string(part)), r"\A\n+|\n+\z", "")
    inside = F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(text))
    return F.coalesce(_string(inside, "$.response"), _string(inside, "$.content"), text)


def _code(c: Column) -> Column:
    """A fenced block; the call of a tool in JSON as the list of its queries and parameters, in order."""
    body = F.regexp_replace(F.coalesce(_string(c, "$.text"), F.lit("")), r"\n+\z", "")
    language = F.coalesce(_string(c, "$.language"), F.lit(""))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), 1 + F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))))
    block = F.when(body == "", "").otherwise(F.concat(fence, F.when(language == "unknown", "").otherwise(language), F.lit("\n"), body, F.lit("\n"), fence))
    call = F.try_parse_json(body)
    values = F.try_variant_get(call, "$", "map<string,variant>")
    keys = F.filter(F.map_keys(F.from_json(body, "map<string,string>")), lambda k: ~k.isin("search_query", "response_length"))
    asked = _lines(F.transform(_list(call, "$.search_query"), lambda q: F.concat(F.lit("- "), F.nullif(_trim(F.coalesce(_string(q), _string(q, "$.q"))), F.lit("")))), "\n")
    plain = lambda v: F.when(F.schema_of_variant(v).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"), F.nullif(_trim(F.try_variant_get(v, "$", "string")), F.lit("")))
    rest = _lines(F.transform(keys, lambda k: F.concat(F.lit("- "), k, F.lit(": "), plain(F.try_element_at(values, k)))), "\n")
    head = F.when(asked != "", F.concat(F.lit("Search tool invoked with queries:\n"), asked)).when(rest != "", F.lit("Tool parameters:"))
    told = F.when(values.isNotNull(), F.concat_ws("\n", head, F.nullif(rest, F.lit(""))))
    return F.when(told != "", told).when(values.isNotNull() & (F.size(F.array_except(F.map_keys(values), F.array(F.lit("response_length")))) == 0), "").otherwise(block)


def _attachments(m: Column, message_id: Column) -> Column:
    url = lambda a: F.coalesce(_string(a, "$.download_url"), _string(a, "$.file_url"))
    with_url = F.filter(_list(m, "$.metadata.attachments"), lambda a: F.coalesce(url(a), F.lit("")) != "")

    def line(a: Column, n: Column) -> Column:
        kind = F.when(F.contains(F.lower(F.coalesce(_string(a, "$.file_type"), _string(a, "$.type"), F.lit("file"))), F.lit("image")), "image").otherwise("file")
        name = F.coalesce(_string(a, "$.name"), _file_name(message_id, n, _string(a, "$.mime_type")))
        return _asset(kind, url(a), name, F.coalesce(_string(a, "$.title"), _string(a, "$.name")))

    # files of mixed parts are counted first
    before = F.when(_string(m, "$.content.content_type") == "multimodal_text", F.size(F.filter(_list(m, "$.content.parts"), _is_file))).otherwise(0)
    return F.array_join(F.transform(with_url, lambda a, n: line(a, n + before)), "\n")


def rendered(m: Column) -> Column:
    """The text of a message (a variant): its content by kind, then its attachments, without marks of citations."""
    c, message_id = F.try_variant_get(m, "$.content", "variant"), _string(m, "$.id")
    kind = _string(c, "$.content_type")
    thoughts = F.transform(_list(c, "$.thoughts"), lambda t: F.array_join(F.filter(F.array(_string(t, "$.summary"), _string(t, "$.content")), lambda x: F.coalesce(x, F.lit("")) != ""), ": "))
    empty = lambda p: (F.schema_of_variant(p) != "STRING") & F.try_variant_get(p, "$", "string").isin("0", "false")
    others = _lines(F.transform(_list(c, "$.parts"), lambda p: F.when(~F.coalesce(empty(p), F.lit(True)), _shown(F.try_variant_get(p, "$", "string")))))
    wrapped = lambda t: F.when(t != "", F.concat(F.lit("_"), t, F.lit("_")))
    body = (
        F.when(kind == "text", _lines(F.transform(_list(c, "$.parts"), _said)))
        .when(kind == "code", _code(c))
        .when(kind == "thoughts", _lines(F.transform(thoughts, wrapped)))
        .when(kind == "reasoning_recap", wrapped(_trim(_string(c, "$.content"))))
        .when(kind == "model_editable_context", _string(c, "$.model_set_context"))
        .when(kind == "multimodal_text", _mixed(c, message_id))
        .when(kind == "tool_response", _shown(_string(c, "$.output")))
        .otherwise(others)
    )
    whole = _lines(F.array(_trim(F.coalesce(body, F.lit(""))), _attachments(m, message_id)))
    return F.regexp_replace(F.regexp_replace(whole, CITATIONS, ""), r"(?m)[^\S\n]+$", "")


def share_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages with form, share_id, model, title, updated, ordinal, role, author, ts and text: a row for each message.

    Pages that are null, have no conversation or a broken one give no rows, nor do messages of the
    system, without content or with nothing to show; ordinals run from 0 over what is shown.
    Clashing columns of pages are replaced.  A page is one value and must fit a task.
    """
    shipping.ship(pages.sparkSession)

    @F.pandas_udf("string")
    def decoded(htmls: pd.Series) -> pd.Series:
        return htmls.map(conversation, na_action="ignore")

    new = ["form", "share_id", "model", "title", "updated", "ordinal", "role", "author", "ts", "text"]
    own = [pages[c] for c in pages.columns if c not in new]
    carries = pages.filter(F.contains(F.col(html_col), F.lit("streamController.enqueue")) | F.contains(F.col(html_col), F.lit(LEGACY_ID)))
    whole = carries.select(F.struct(*own).alias("_page"), F.try_parse_json(decoded(F.col(html_col))).alias("_c"))
    said = whole.withColumn("_m", F.filter(_list(F.col("_c"), "$.messages"), lambda m: (F.coalesce(_string(m, "$.author.role"), F.lit("")) != "system") & F.coalesce(F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")).startswith("OBJECT"), F.lit(False))))
    texts = F.filter(F.transform("_m", lambda m: F.struct(m.alias("m"), rendered(m).alias("text"))), lambda x: x.text != "")
    each = said.select("_page", "_c", F.posexplode(texts).alias("n", "x"))
    name = _string(F.col("x.m"), "$.author.role")
    role = F.when(name.isin("user", "tool"), name).otherwise("assistant")
    author = F.when(role == "user", _string(F.col("_c"), "$.author")).when(role == "tool", "Tool").otherwise("Assistant")
    c = F.col("_c")
    return each.select("_page.*", _string(c, "$.form").alias("form"), _string(c, "$.share_id").alias("share_id"), _string(c, "$.model").alias("model"), _string(c, "$.title").alias("title"), F.timestamp_seconds(F.try_variant_get(c, "$.updated", "double")).alias("updated"), F.col("n").cast("long").alias("ordinal"), role.alias("role"), author.alias("author"), F.timestamp_seconds(F.try_variant_get(F.col("x.m"), "$.create_time", "double")).alias("ts"), F.col("x.text").alias("text"))
