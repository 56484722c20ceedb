"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once, with control strings around each turn; the places of the turns' texts are kept as
sorted spans. The whole text is encoded once with offsets, and each span is met with the sorted token spans by binary
search. Control strings inside texts are escaped, so the formatted text can be read back exactly; the control strings
are single tokens of their own, so a mask never cuts a token.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalis.llm.store import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: What stands before and after a turn's text; other roles are written as [ROLE]name[TEXT]text[/ROLE].
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROLS = sorted({c for pair in MARKS.values() for c in pair} | set(OTHER))
_CONTROL = "|".join(map(re.escape, CONTROLS))
_HIDE = re.compile(rf"\\|(?:{_CONTROL})")
_SHOW = re.compile(r"\\(\\?)", re.S)
_READ = re.compile(_CONTROL)

Turn = tuple[str, str]


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of each control string."""
    return _HIDE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1", text)


@dataclass
class Chat:
    """A formatted conversation: its text, the span of each turn's (escaped) text, and which turns count for the loss."""

    text: str
    spans: np.ndarray
    loss: np.ndarray


def render(turns: list[Turn], loss_roles: tuple[str, ...] = ("assistant",)) -> Chat:
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        before, after = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
        body = escape(text)
        parts += [before, body, after]
        spans.append((at + len(before), at + len(before) + len(body)))
        at += len(before) + len(body) + len(after)
    return Chat("".join(parts), np.array(spans, np.int64).reshape(-1, 2), np.array([r in loss_roles for r, _ in turns], bool))


def read_back(text: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    opening = {b: (r, a) for r, (b, a) in MARKS.items()}
    out, pos = [], 0
    while pos < len(text):
        m = _READ.match(text, pos)
        if m[0] in opening:
            role, close = opening[m[0]]
            pos = m.end()
        else:
            middle = text.index(OTHER[1], m.end())
            role, close, pos = unescape(text[m.end() : middle]), OTHER[2], middle + len(OTHER[1])
        end = text.index(close, pos)
        out.append((role, unescape(text[pos:end])))
        pos = end + len(close)
    return out


@functools.cache
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
    return t


def loss_mask(chat: Chat, offsets: np.ndarray) -> np.ndarray:
    """Which tokens lie in the text of a loss turn. Both span lists are sorted: binary search finds each turn's first and last token."""
    lo = np.searchsorted(offsets[:, 1], chat.spans[:, 0], "right")
    hi = np.searchsorted(offsets[:, 0], chat.spans[:, 1], "left")
    mask = np.zeros(len(offsets), bool)
    for a, b, on in zip(lo.tolist(), hi.tolist(), chat.loss.tolist(), strict=True):
        if on:
            mask[a:b] = True
    return mask


def masked_texts(chat: Chat, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped, read from the token offsets; a character that several tokens share is read once."""
    out, end, open_run = [], 0, []
    for (a, b), on in zip(offsets.tolist(), mask.tolist(), strict=True):
        if on:
            a = max(a, end)
            if a < b:
                open_run.append(chat.text[a:b])
                end = b
        elif open_run:
            out.append(unescape("".join(open_run)))
            open_run = []
    if open_run:
        out.append(unescape("".join(open_run)))
    return "".join(out)


def format_conversations(rows: DataFrame, tokenizer_path: str = TOKENIZER, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)``: ``conv_id``, ``formatted``, ``token_ids``, ``loss_mask``,
    and read back from them ``roles``, ``texts`` and ``loss_text``.

    Turns go by ``turn``, nulls first, then role and text; repeated rows are repeated turns. A null role is written as an
    empty one; null text is empty. Rows without conv_id form one conversation. Any role or text is allowed, control
    strings and backslashes included. An empty table gives an empty result; other columns are not read. A conversation
    becomes one row, so its turns meet in one task: that is the output asked for, bounded by the row.
    """
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    schema = T.StructType([grouped.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType())), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("loss_text", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.slice(lo, 200)
                out: list[list] = [[] for _ in range(6)]
                for turns in part.column(1).to_pylist():
                    chat = render([(t["role"], t["text"]) for t in turns], loss_roles)
                    coded = encode(chat.text, add_special_tokens=False)
                    offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
                    mask = loss_mask(chat, offsets)
                    back = read_back(chat.text)
                    for column, value in zip(out, (chat.text, coded.ids, mask.tolist(), [r for r, _ in back], [t for _, t in back], masked_texts(chat, offsets, mask)), strict=True):
                        column.append(value)
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], schema.names)

    return grouped.mapInArrow(scan, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and one more, formatted and read back. Null texts and roles are empty; rows without conv_id are one
    conversation; repeated rows are repeated turns; extra columns are not read."""
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    done = format_conversations(rows.unionByName(own))
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '([\[<])(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>)', '\1\\\2', 'g')"
OP3_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 19 + length({_ESCAPED.format("role")}) END) AS chars
    FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
