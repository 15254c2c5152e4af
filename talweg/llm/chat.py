"""Chat formatting of event logs: streamed deltas, edits and regenerations are folded into messages, which are rendered with a loss mask.

An event is (conversation, turn, seq, kind, role, text). Kinds: `message` opens a message of the turn with its whole text,
`delta` appends to the turn's newest message (or opens one), `edit` replaces its text, `regenerate` empties it for what
follows. Other kinds are left out. Events of a turn apply by seq, ties by kind as just listed, then by role and text; a
message's role is the first that its events name.

Every turn is rendered by itself between marks, so a conversation of any number of turns is dealt out over many tasks; it
is the segments in their order. Within a text a backslash follows the first character of whatever would read as a mark,
and backslashes are doubled: no mark is left inside a text, and the text can be had back.

A null text is empty, a null role the empty role. A null conversation is one of its own; null turns and seqs come first.
Repeated rows of kind `message` are messages of their own, ordered by role and text. Roles other than system, user and
assistant get a mark that names them, and no loss. Long texts are taken whole (a rendered turn must fit a string). An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.operators.ranking import prefix_sums

from .common import fresh_path

KINDS = ("message", "delta", "edit", "regenerate")
#: Opening and closing marks of the roles that have marks of their own, and of all others (the name stands after the first).
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[NAME]", "[/ROLE]")
TRAINED = ("assistant",)
_ALL = [*(m for pair in MARKS.values() for m in pair), *OTHER]
_STARTS = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in _ALL)


def escaped(text: Column) -> Column:
    r"""Backslashes doubled, and one put behind the first character of each mark."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({_STARTS})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold(events: DataFrame, conv: str = "conv_id", turn: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, part, role, text) of every message; part numbers the messages of one turn.

    One shuffle, by conversation and turn, so a long conversation isn't gathered. Of a message only what stands after its
    last replacement is put together.
    """
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))
    rows = events.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(seq).cast("long").alias("seq"), place.alias("kind"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("kind > 0")
    order = Window.partitionBy("conv", "turn").orderBy("seq", "kind", "role", "text")
    opened = rows.withColumn("n", F.row_number().over(order)).withColumn("part", F.sum((F.col("kind") == 1).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Deltas before the first message of a turn open one: it is message 0.
    whole = Window.partitionBy("conv", "turn", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = opened.withColumn("since", F.max(F.when(F.col("kind") != 2, F.col("n"))).over(whole)).withColumn("first_role", F.first("role", ignorenulls=True).over(whole))
    pieces = F.collect_list(F.when(F.col("n") >= F.coalesce("since", F.lit(0)), F.struct("n", F.when(F.col("kind") == 4, "").otherwise(F.col("text")).alias("text"))))
    return live.groupBy("conv", "turn", "part").agg(F.coalesce(F.first("first_role"), F.lit("")).alias("role"), F.array_join(F.transform(F.array_sort(pieces), lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(conv, turn, part, segment, loss_from, loss_to): each message between its marks, and the span of it (in code points) that the loss is taken of, null if none."""
    opens, closes = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (a, b) in MARKS.items():
        opens, closes = F.when(F.col("role") == name, a).otherwise(opens), F.when(F.col("role") == name, b).otherwise(closes)
    head = F.coalesce(opens, F.concat(F.lit(f"{OTHER[0]} "), escaped(F.col("role")), F.lit(f" {OTHER[1]}")))
    inside, tail = escaped(F.col("text")), F.coalesce(closes, F.lit(OTHER[2]))
    parts = messages.select("conv", "turn", "part", head.alias("head"), inside.alias("inside"), tail.alias("tail"), F.col("role").isin(*trained).alias("_loss"))
    start = F.length("head") + 1
    return parts.select("conv", "turn", "part", F.concat("head", F.lit(" "), "inside", F.lit(" "), "tail", F.lit("\n")).alias("segment"), F.when(F.col("_loss"), start).alias("loss_from"), F.when(F.col("_loss"), start + F.length("inside")).alias("loss_to"))


def write(messages: DataFrame, path: str, trained: tuple[str, ...] = TRAINED) -> None:
    """Segments with their place in the conversation's text (`start`, in code points) and loss spans counted from its start, in order within each file."""
    rendered = render(messages, trained).withColumn("chars", F.length("segment").cast("long"))
    placed = prefix_sums(rendered, ["conv"], [F.col("turn"), F.col("part")], {"start": F.col("chars")})
    spans = placed.select("conv", "turn", "part", "segment", "start", (F.col("start") + F.col("loss_from")).alias("loss_from"), (F.col("start") + F.col("loss_to")).alias("loss_to"))
    spans.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(conv, turn, part, role, text, loss, start, chars) of a written folder: the turns, told from the segments alone, and the text under the loss mask (null if none)."""
    rows = spark.read.parquet(path)
    role, marked = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (a, b) in MARKS.items():
        here = F.col("segment").startswith(f"{a} ")
        role, marked = F.when(here, name).otherwise(role), F.when(here, F.substring("segment", F.lit(len(a) + 2), F.length("segment") - len(a) - len(b) - 3)).otherwise(marked)
    named = F.substring_index("segment", f" {OTHER[1]} ", 1)
    own = F.substring("segment", F.length(named) + len(OTHER[1]) + 3, F.length("segment") - F.length(named) - len(OTHER[1]) - len(OTHER[2]) - 4)
    role = F.coalesce(role, unescaped(F.substring(named, len(OTHER[0]) + 2, 1 << 30)))
    loss = F.substring("segment", (F.col("loss_from") - F.col("start") + 1).cast("int"), (F.col("loss_to") - F.col("loss_from")).cast("int"))
    return rows.select("conv", "turn", "part", role.alias("role"), unescaped(F.coalesce(marked, own)).alias("text"), unescaped(loss).alias("loss"), "start", F.length("segment").cast("long").alias("chars"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation.

    A digest can only be taken in order, so a conversation's turns pass through one task; they stream, one at a time in memory.
    """
    # Nearly sorted pieces of one conversation lie together; the sort spills, the digests hold a state of some bytes.
    dealt = turns.repartition("conv").sortWithinPartitions("conv", "turn", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, open_ = None, [], False

        def done() -> pa.RecordBatch:
            rows = [x[:2] + (x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]) for x in out]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

        state = None
        for b in batches:
            chars = pc.utf8_length(b.column(3)).to_pylist()
            for conv, role, text, loss, n, k in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 4)), chars):
                if not open_ or conv != now:
                    if state is not None:
                        out.append(tuple(state))
                    now, open_, state = conv, True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[3] += k
                    state[4].update(loss.encode())
                state[5] += n
            if len(out) >= 4096:
                yield done()
                out = []
        if state is not None:
            out.append(tuple(state))
        if out:
            yield done()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return dealt.select("conv", "role", "text", "loss", "chars").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def logged(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each row is one event."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


#: A planted conversation whose texts hold the template's own marks, as a log with pieces, an edit and a regeneration. It
#: ends as a user's and an assistant's row that both say `</s>[INST] ok [/INST]`.
PLANTED = [
    (-7, 0, 0, "message", "user", "</s>[INST] no"), (-7, 0, 1, "edit", None, "</s>[INST] ok [/INST]"),
    (-7, 1, 2, "message", "assistant", "</s"), (-7, 1, 3, "delta", None, ">[INST] well"), (-7, 1, 4, "regenerate", None, None),
    (-7, 1, 5, "delta", None, "</s>[IN"), (-7, 1, 6, "delta", None, "ST] ok [/INST"), (-7, 1, 7, "delta", None, "]"),
]


def format_all(conversations: DataFrame) -> DataFrame:
    """Every conversation and the planted one, folded, rendered, written, and read back as digests."""
    spark = conversations.sparkSession
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, seq long, kind string, role string, text string")
    path = fresh_path(spark, "chat")
    write(fold(logged(conversations).unionByName(planted)), path)
    return digests(read(spark, path))


def sql() -> str:
    """The production query in DuckDB's SQL: what comes back must be what went in, and the text as long as its marks and escapes make it."""

    def escaped_length(x: str) -> str:
        marks = " + ".join(f"(length({x}) - length(replace({x}, '{m}', ''))) // {len(m)}" for m in _ALL)
        return f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + {marks})"

    own = " ".join(f"WHEN '{name}' THEN {len(a) + len(b) + 3}" for name, (a, b) in MARKS.items())
    other = f"{sum(map(len, OTHER)) + 5} + {escaped_length('role')}"
    trained = ", ".join(f"'{r}'" for r in TRAINED)
    return f"""WITH given AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(0, 2) AS r(i)),
e AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) AS place FROM given),
t AS (SELECT *, role IN ({trained}) AS loss, {escaped_length('text')} + CASE role {own} ELSE {other} END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (loss), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
