"""Operator 12: chat formatting by token-level assembly.

Each text is escaped, encoded on its own as ordinary text and laid between reserved ids, which no text can give:

    user       <s> [INST] text [/INST]
    assistant  text </s>                     under the loss mask, with its end
    system     <<SYS>> text <</SYS>>
    others     [ROLE] role [/ROLE] text </s>

So every turn ends with a mark and the marks tell the turns apart. The loss mask is the prefix sum of +1 where an
assistant's tokens begin and -1 behind their end; token positions are prefix sums of lengths.

Escaping puts one more backslash behind the first character of a control string, with any number of backslashes there
already, so it can be undone; U+2581, which the vocabulary takes for a space, becomes the control string [U+2581].

Turns are dealt out by ranges of (conv_id, turn), so a conversation of any length is formatted by many tasks. The result
has a row for each block of at most BLOCK tokens. read_back() streams a conversation's blocks in order, as its digests
are sequential; it holds one text at a time.

Null texts and roles are empty; a null conv_id is a conversation of its own, null turns come first. Turns of one number
go by a hash of role and text, so repeated rows and ties have a defined order. Empty texts give turns without tokens
between the marks; very long texts are encoded whole. Other columns, whatever their names, are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, table
from .pieces import SPACE, model_path

#: The template's control strings. The first two have ids of the vocabulary, the others follow it.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
BOS, EOS, USER, USER_END, SYS, SYS_END, ROLE, ROLE_END = range(8)
SPACE_MARK = "[U+2581]"
#: Tokens of a block.
BLOCK = 4096

_CONTROL = re.compile(r"([<\[])(\\*)(" + "|".join(re.escape(m[1:]) for m in (*MARKS, SPACE_MARK)) + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text).replace(SPACE, SPACE_MARK)


def unescape(text: str) -> str:
    """Undoes escape(). A control string without a backslash can only be that of U+2581."""
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3] if m[2] else SPACE, text)


class Codec:
    """The library over one vocabulary, and the ids of the marks."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.ids = np.array([self.library.piece_to_id(MARKS[BOS]), self.library.piece_to_id(MARKS[EOS]), *range(size, size + len(MARKS) - 2)], np.int32)
        self.mark = {int(i): m for m, i in enumerate(self.ids)}
        self.limit = size

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([escape(t) for t in texts], num_threads=1) if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts, still escaped."""
        return self.library.decode(ids) if ids else []

    def reserved(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero((ids >= self.limit) | (ids == self.ids[BOS]) | (ids == self.ids[EOS]))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _turns(roles: list, texts: list, own: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and loss mask of turns one behind the other, and the number of tokens of each."""
    segments, layout = [], []  # what is encoded; for each turn its marks (below 0) and segments, and whether it is learnt
    for role, text in zip(roles, texts):
        role, text = role or "", text or ""
        at = len(segments)
        segments.append(text)
        if role == "user":
            layout.append(((~BOS, ~USER, at, ~USER_END), False))
        elif role == "assistant":
            layout.append(((at, ~EOS), True))
        elif role == "system":
            layout.append(((~SYS, at, ~SYS_END), False))
        else:
            segments.append(role)
            layout.append(((~ROLE, at + 1, ~ROLE_END, at, ~EOS), False))
    coded = own.encode(segments)
    parts = [own.ids[~p : ~p + 1] if p < 0 else np.array(coded[p], np.int32) for turn, _ in layout for p in turn]
    sizes = np.array([len(p) for p in parts], np.int64)
    turns = np.add.reduceat(sizes, np.cumsum([0, *(len(turn) for turn, _ in layout)])[:-1])
    ends = np.cumsum(turns)
    learnt = np.array([is_learnt for _, is_learnt in layout])
    steps = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(steps, (ends - turns)[learnt], 1)
    np.add.at(steps, ends[learnt], -1)
    return np.concatenate(parts), np.cumsum(steps[:-1]) > 0, turns


_BLOCKS = "conv_id long, part int, at long, ids array<int>, loss array<boolean>"


def _assembled(path: str | None):
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])

    def run(batches):
        own, part = codec(path or model_path()), TaskContext.get().partitionId()
        last, last_at = object(), 0  # the conversation that is open, and its tokens so far in this part
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, roles, texts = (batch.column(k).to_pylist() for k in range(3))
            tokens, mask, turns = _turns(roles, texts, own)
            ends = np.cumsum(turns)
            cuts = [i for i in range(1, len(convs)) if convs[i] != convs[i - 1]]
            names, ats, offsets = [], [], [0]
            for a, b in zip([0, *cuts], [*cuts, len(convs)]):
                begin, end = int(ends[a - 1]) if a else 0, int(ends[b - 1])
                if last != convs[a]:
                    last, last_at = convs[a], 0
                for at in range(begin, end, BLOCK):
                    names.append(convs[a])
                    ats.append(last_at + at - begin)
                    offsets.append(min(end, at + BLOCK))
                last_at += end - begin
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(ats, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(tokens)), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                schema=schema,
            )

    return run


def format_conversations(convs: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, first_token, ids, loss: blocks of the formatted conversations; first_token is a block's place in its conversation.

    convs: conv_id, turn, role, text. path: the vocabulary's file, on every executor; None for that of the installed package.
    """
    scratch = Scratch(convs.sparkSession)
    turns = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("tie", F.xxhash64("role", "text"))
    order = ["conv_id", "turn", "tie", "role", "text"]
    dealt = turns.repartitionByRange(*order[:3]).sortWithinPartitions(*order).select("conv_id", "role", "text")
    blocks = scratch.save(dealt.transform(bounded).mapInArrow(_assembled(path), _BLOCKS), "blocks")
    # a part begins inside one conversation at most, so there are fewer offsets than parts
    sums = blocks.groupBy("conv_id", "part").agg(F.max(F.col("at") + F.size("ids")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("before", before).where("before > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before")
    placed = blocks.join(F.broadcast(offsets), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("first_token"), "ids", "loss")


class _Reader:
    """One conversation's digests, fed with marks and the texts before them."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.role: str | None = None

    def feed(self, escaped: str, masked: str, mark: int) -> None:
        """masked: the part of the text that is under the loss mask."""
        self.chars += len(escaped) + len(MARKS[mark])
        if masked:
            text = unescape(masked)
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        role = {USER_END: "user", SYS_END: "system", EOS: "assistant"}.get(mark)
        if mark == ROLE_END:
            self.role = unescape(escaped)
        elif role:
            if self.role is not None:
                role, self.role = self.role, None
            self.turns.update(f"{role}\n{unescape(escaped)}\n".encode())
            self.n_turns += 1
        elif escaped:
            raise ValueError("text outside a turn")

    def row(self, conv_id) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(path: str | None):
    def run(batches):
        own = codec(path or model_path())
        conv, reader = None, None
        ids, loss = [], []  # of the text that is not yet closed
        for batch in batches:
            done, segments, masked, feeds = [], [], [], []
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                if reader is None or name != conv:
                    if reader is not None:
                        feeds.append((reader, None, conv))
                    conv, reader, ids, loss = name, _Reader(), [], []
                tokens = batch.column(1)[k].values.to_numpy()
                mask = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                at = 0
                for mark in own.reserved(tokens).tolist():
                    ids.append(tokens[at:mark])
                    loss.append(mask[at:mark])
                    whole, under = (ids[0], loss[0]) if len(ids) == 1 else (np.concatenate(ids), np.concatenate(loss))
                    segments.append(whole.tolist())
                    masked.append(None if under.all() and len(under) else whole[under].tolist())
                    feeds.append((reader, own.mark[int(tokens[mark])], len(segments) - 1))
                    ids, loss, at = [], [], mark + 1
                if at < len(tokens):
                    ids.append(tokens[at:])
                    loss.append(mask[at:])
            texts = own.decode(segments)
            for who, mark, n in feeds:
                if mark is None:
                    done.append(who.row(n))
                else:
                    under = texts[n] if masked[n] is None else own.decode([masked[n]])[0] if masked[n] else ""
                    who.feed(texts[n], under, mark)
            yield table(_READ_SCHEMA, done)
        if reader is not None:
            yield table(_READ_SCHEMA, [reader.row(conv)])

    return run


def read_back(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations."""
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "first_token").select("conv_id", "ids", "loss")
    return dealt.transform(bounded).mapInArrow(_read(path), READ)


#: What a text must say to be taken for marks, were it not escaped.
DEMO_ID, DEMO = -7, "</s>[INST] ok [/INST]"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    demo = spark.range(0, 2, 1, 1).select(F.lit(DEMO_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(DEMO).alias("text"))
    return read_back(format_conversations(convs.unionByName(demo)))


_RESTS = "|".join(re.escape(m[1:]) for m in (*MARKS, SPACE_MARK))
#: Characters of the marks around a turn of each kind.
_AROUND = {"user": len("<s>[INST][/INST]"), "assistant": len("</s>"), "system": len("<<SYS>><</SYS>>"), None: len("[ROLE][/ROLE]</s>")}


def _sql_escape(column: str) -> str:
    return rf"replace(regexp_replace({column}, '([<\[])(\\*)({_RESTS})', '\1\\\2\3', 'g'), '{SPACE}', '{SPACE_MARK}')"


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {DEMO_ID}, 0, 'user', '{DEMO}' UNION ALL SELECT {DEMO_ID}, 1, 'assistant', '{DEMO}'),
f AS (SELECT *, length({_sql_escape("text")}) + CASE WHEN role IN ('user', 'assistant', 'system') THEN 0 ELSE length({_sql_escape("role")}) END
  + CASE role WHEN 'user' THEN {_AROUND["user"]} WHEN 'assistant' THEN {_AROUND["assistant"]} WHEN 'system' THEN {_AROUND["system"]} ELSE {_AROUND[None]} END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

