"""Transcript parsing: a hidden Markov model over lines recovers the speaker of each line.

The states are (role, first line of a turn or not). A line shows two features: its marker (which
role's marker it starts with, an unknown one, or none, crossed with whether a row starts here) and
its shape (length, question mark, list or code look, first-person words). Both emission tables and
the transitions are counted over all rows whose role is known and whose conversation is outside
the held-out fold; what is collected has a fixed size.

Lines are dealt by ranges of (conversation, turn), so a conversation of any length spreads over
tasks. Each task reduces the conversations that reach over its ends to one max-plus matrix (at
most two for each range); the driver chains these few matrices, which fixes the state at each range's
end, and every task then runs its Viterbi search between fixed ends. The path is the global one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ._common import bounded_batches, cut_lineage, held_out, tidy

ROLES = ("system", "user", "assistant", "tool")
STATES = 2 * len(ROLES)  # role * 2 + (0 first line, 1 later line)

#: Names that transcripts use for each role.
NAMES = {
    "system": "system", "instructions": "system", "user": "user", "human": "user", "q": "user", "customer": "user", "question": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "gpt": "assistant", "answer": "assistant", "tool": "tool", "function": "tool",
}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|(?:im_start\|>)?|\[)?([A-Za-z]{1,12})(?:\*\*:|:\*\*|\|>|\]:?|:)\s*")
_LIST = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s|^\s{4}|```")
_MARKS = len(ROLES) + 2  # none, one for each role, unknown
_SHAPES = 5 * 2 * 2 * 2
#: Pseudo-counts: a marker nearly always speaks for its role and opens a turn.
_TRUE_MARK, _OTHER = 200.0, 0.5


def marker(line: str) -> tuple[int, int]:
    """(0 none, 1.. role, last unknown; length of the marker)."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    role = NAMES.get(m.group(1).lower())
    return (1 + ROLES.index(role), m.end()) if role else (_MARKS - 1, 0)


def shape(line: str) -> int:
    n = len(line)
    size = 0 if not line.strip() else 1 if n < 40 else 2 if n < 120 else 3 if n < 400 else 4
    return ((size * 2 + ("?" in line)) * 2 + bool(_LIST.search(line))) * 2 + (line[:1].islower())


def lines_of(text: str | None) -> list[str]:
    """Lines of a row; a null or empty text is one empty line."""
    return (text or "").split("\n")


def symbols(lines: list[str]) -> list[tuple[int, int]]:
    """(marker symbol, shape symbol) of each line of a row."""
    return [(marker(x)[0] * 2 + (k == 0), shape(x)) for k, x in enumerate(lines)]


def fit_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log tables (marks [state, symbol], shapes [state, symbol], transitions [state, state]).

    rows(role, text, before, lines): before is the role of the conversation's row before, null if there
    is none or none known, and lines how many lines that row has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, shapes, steps = np.zeros((STATES, _MARKS * 2)), np.zeros((STATES, _SHAPES)), np.zeros((STATES, STATES))
        last = None
        for batch in batches:
            for role, text, before, lines in zip(*(batch.column(k).to_pylist() for k in ("role", "text", "before", "lines"))):
                if role not in ROLES:
                    continue
                for k, (m, s) in enumerate(symbols(lines_of(text))):
                    state = ROLES.index(role) * 2 + (k > 0)
                    marks[state, m] += 1
                    shapes[state, s] += 1
                    if k or before is not None:
                        steps[last if k else ROLES.index(before) * 2 + (lines > 1), state] += 1
                    last = state
        for kind, table in enumerate((marks, shapes, steps)):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(table.ravel()[at])], ["kind", "at", "n"])

    counted = rows.mapInArrow(tidy(run), "kind bigint, at bigint, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    marks, shapes, steps = prior_marks(), np.full((STATES, _SHAPES), 0.5), np.full((STATES, STATES), 0.5)
    for r in counted:
        (marks, shapes, steps)[r.kind].ravel()[r["at"]] += r.n
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                steps[a, b] = 1e-9  # a turn's later line follows a line of its own role
    return tuple(np.log(t / t.sum(axis=1, keepdims=True)) for t in (marks, shapes, steps))


def prior_marks() -> np.ndarray:
    out = np.full((STATES, _MARKS * 2), _OTHER)
    for r in range(len(ROLES)):
        out[2 * r, (1 + r) * 2] += _TRUE_MARK / 4
        out[2 * r, (1 + r) * 2 + 1] += _TRUE_MARK
        out[2 * r, 1] += _TRUE_MARK / 4
        out[2 * r + 1, 0] += _TRUE_MARK
    return out


class Chain:
    """Viterbi over the lines of one conversation's rows in a range."""

    def __init__(self, model):
        self.marks, self.shapes, self.steps = model

    def emissions(self, texts: list[str | None]) -> np.ndarray:
        got = [s for t in texts for s in symbols(lines_of(t))]
        m, s = np.array(got).T
        return self.marks[:, m].T + self.shapes[:, s].T

    def reduce(self, e: np.ndarray, total: np.ndarray | None) -> np.ndarray:
        """Max-plus product of total with the line matrices; rows are the state before, columns the state at the end."""
        for row in e:
            total = self.steps + row if total is None else (total[:, :, None] + self.steps[None]).max(axis=1) + row
        return total

    def path(self, e: np.ndarray, start: np.ndarray, end: int | None) -> np.ndarray:
        """Best states: start holds the scores before the first line's emission, end the last state if known."""
        score, back = start + e[0], np.zeros((len(e), STATES), np.int8)
        for k in range(1, len(e)):
            both = score[:, None] + self.steps
            back[k] = both.argmax(axis=0)
            score = both.max(axis=0) + e[k]
        out = np.zeros(len(e), int)
        out[-1] = score.argmax() if end is None else end
        for k in range(len(e) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out


#: A conversation begins as if an assistant's line came before it.
START_ROW = 2 * ROLES.index("assistant") + 1
#: Rows of a range, about.
RANGE_ROWS = 50_000
#: Rows are searched in stretches of about so many lines, so that a task's memory is bounded.
STRETCH = 20_000


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[list], list]]:
    """(conversation, stretch number, [row number, conv_id, turn] of the rows, texts) of consecutive rows of one conversation in a range."""
    key, number, rows, texts, size = object(), 0, [], [], 0
    for batch in batches:
        for c, t, *at in zip(*(batch.column(k).to_pylist() for k in ("conv_key", "text", "at", "conv_id", "turn"))):
            if c != key or size >= STRETCH:
                if rows:
                    yield key, number, rows, texts
                number, rows, texts, size = (number + 1 if c == key else 0), [], [], 0
                key = c
            rows.append(at)
            texts.append(t)
            size += 1 + (t or "").count("\n")
    if rows:
        yield key, number, rows, texts


def _with_row_before(rows: DataFrame) -> DataFrame:
    """rows(conv_id, conv_key, role, text, at) with the role and the lines of the conversation's row before.

    Inside a range by a window over the range's order; a range's first row gets those of the last
    row before it, of which there are as many as ranges.
    """
    known = F.when(F.col("role").isin(*ROLES), F.col("role"))
    n = (F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), "\n", "")) + 1).alias("n")
    slim = rows.select("conv_id", "conv_key", known.alias("role"), "text", "at", F.shiftright("at", 33).alias("part"), n)
    state = F.struct("conv_key", "role", "n")
    last = slim.groupBy("part").agg(F.max_by(state, "at").alias("end")).orderBy("part").collect()  # one row for each range
    ends = rows.sparkSession.createDataFrame([(b.part, a.end) for a, b in zip(last, last[1:])], "part bigint, end struct<conv_key string, role string, n int>")
    inside = F.lag(state).over(Window.partitionBy("part").orderBy("at"))
    out = slim.withColumn("was", inside).join(F.broadcast(ends), "part", "left").withColumn("was", F.coalesce("was", "end"))
    same = F.col("was.conv_key") == F.col("conv_key")
    return out.select("conv_id", "role", "text", F.when(same, F.col("was.role")).alias("before"), F.col("was.n").alias("lines"))


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """Roles of all rows of lines(conv_id, turn, text[, role]) and their canonical rendering.

    Rows of a conversation are read in the order of turn, then of text (a null is lowest); rows
    with a null conv_id are one conversation, which is not that of an empty one; repeated rows stay. role, where known, is only
    learnt from, and only outside the held-out fold (crc32 of conv_id mod 5 is 0); other columns are ignored.

    Returns conv_id, turn, held_out, role_pred (role of the row's first line), n_switches (changes
    of speaker inside the row) and rendered: each speaker's lines without their marker as
    <|role|>, line feed, content, line feed, <|end|>, line feed. A row that only goes on in its
    predecessor's turn is rendered as a turn of its own. A null or empty text is one empty line, texts
    of any length are read whole, an empty table gives no rows.
    """
    spark = lines.sparkSession
    bounded_batches(spark)
    role = F.col("role") if "role" in lines.columns else F.lit(None).cast("string")
    rows = lines.select("conv_id", "turn", "text", role.alias("role"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv_key"))
    mark = F.xxhash64("text")  # spreads the rows of one (conversation, turn)
    # ranges of about RANGE_ROWS rows: a task holds the rows of one conversation in its range
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    rows = rows.repartitionByRange(parts, "conv_key", "turn", mark).sortWithinPartitions("conv_key", "turn", mark, "text")
    rows = cut_lineage(rows.withColumn("at", F.monotonically_increasing_id()))
    learnt = _with_row_before(rows).where(~held_out("conv_id", 5, 0))
    model = fit_counts(learnt)
    shared = spark.sparkContext.broadcast(model)

    def reduce_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, got, total, key = Chain(shared.value), [], None, None
        for c, _, at, texts in _stretches(batches):
            if c != key:
                if total is not None:
                    got.append((key, first, total))
                    del got[1:-1]  # only the first and the last conversation can reach over the range's ends
                total, key, first = None, c, at[0][0]
            total = chain.reduce(chain.emissions(texts), total)
        if total is not None:
            got.append((key, first, total))
        for c, first, total in got:
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([first]), pa.array([total.tobytes()], pa.binary())], ["conv_key", "at", "m"])

    read = rows.select("conv_key", "text", "at", "conv_id", "turn")
    ends = read.mapInArrow(tidy(reduce_ends), "conv_key string, at bigint, m binary").orderBy("at").collect()
    fixed = _fix_ends([(r.conv_key, r["at"] >> 33, np.frombuffer(r.m).reshape(STATES, STATES)) for r in ends])
    links = spark.sparkContext.broadcast(fixed)
    types = [to_arrow_type(rows.schema[n].dataType) for n in ("conv_id", "turn")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(shared.value)
        held: list = []

        def settle(part: list, final: int | None, before: int | None) -> Iterator[pa.RecordBatch]:
            # stretches are chained like ranges: their matrices fix the states at their ends
            mats = [chain.reduce(chain.emissions(texts), None) for _, texts in part] if len(part) > 1 else []
            stops = _chain_states(mats, before, final) if mats else [final]
            for (at, texts), stop in zip(part, stops):
                start = chain.steps[START_ROW if before is None else before]
                states = chain.path(chain.emissions(texts), start, stop)
                before = int(states[-1])
                yield _render(at, texts, states, types)

        key = None
        for c, _, at, texts in _stretches(batches):
            if c != key and held:
                yield from settle(held, *links.value.get((key, held[0][0][0][0] >> 33), (None, None)))
                held = []
            key = c
            held.append((at, texts))
        if held:
            yield from settle(held, *links.value.get((key, held[0][0][0][0] >> 33), (None, None)))

    kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("conv_id", "turn"))
    decoded = read.mapInArrow(tidy(decode), f"{kept}, role_pred string, n_switches int, rendered string")
    return decoded.select("conv_id", "turn", held_out("conv_id", 5, 0).alias("held_out"), "role_pred", "n_switches", "rendered")


def _chain_states(mats: list[np.ndarray], before: int | None, final: int | None) -> list[int]:
    """The state at the end of each of a row of matrices, on the best path."""
    score, back = None, []
    for m in mats:
        if score is None:
            score = m[START_ROW if before is None else before]
        else:
            both = score[:, None] + m
            back.append(both.argmax(axis=0))
            score = both.max(axis=0)
    out = [int(score.argmax()) if final is None else final]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _fix_ends(ends: list[tuple[str, int, np.ndarray]]) -> dict[tuple[str, int], tuple[int, int | None]]:
    """(conversation, range) -> (its last state, the state before it) for conversations in several ranges."""
    out, run = {}, []
    for k, (key, part, m) in enumerate(ends):
        run.append((key, part, m))
        if k + 1 == len(ends) or ends[k + 1][0] != key:
            if len(run) > 1:
                before = None
                for (c, p, _), state in zip(run, _chain_states([r[2] for r in run], None, None)):
                    out[c, p] = (state, before)
                    before = state
            run = []
    return out


def _render(at: list[list], texts: list[str | None], states: np.ndarray, types: list[pa.DataType]) -> pa.RecordBatch:
    roles, switches, rendered, k = [], [], [], 0
    for t in texts:
        turns: list[tuple[str, list[str]]] = []
        for line in lines_of(t):
            role = ROLES[states[k] // 2]
            if not turns or states[k] % 2 == 0 and (marker(line)[0] or turns[-1][0] != role):
                turns.append((role, []))
            opened = marker(line)[1]
            if opened < len(line) or not opened:  # a marker alone on its line leaves nothing
                turns[-1][1].append(line[opened:])
            k += 1
        roles.append(turns[0][0])
        switches.append(sum(a[0] != b[0] for a, b in zip(turns, turns[1:])))
        rendered.append("".join(f"<|{r}|>\n" + "\n".join(x) + "\n<|end|>\n" for r, x in turns))
    given = [pa.array([r[1 + k] for r in at], types[k]) for k in range(2)]
    own = [pa.array(roles, pa.string()), pa.array(switches, pa.int32()), pa.array(rendered, pa.string())]
    return pa.RecordBatch.from_arrays(given + own, ["conv_id", "turn", "role_pred", "n_switches", "rendered"])


def with_markers(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as transcripts: each row's text opened by a speaker marker.

    The style of marker goes by the conversation, and one row in eight has none, both by crc32.
    """
    style = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 3
    bare = F.crc32(F.concat_ws("/", F.col("conv_id"), F.col("turn")).cast("binary")) % 8 == 0
    name = F.when(style == 1, F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise(F.initcap("role")))
    name = F.coalesce(name, F.initcap("role"), F.lit("Unknown"))
    opened = F.when(style == 2, F.concat(F.lit("### "), name, F.lit(":\n"))).otherwise(F.concat(name, F.lit(": ")))
    text = F.coalesce(F.col("text"), F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.when(bare | F.col("role").isNull(), text).otherwise(F.concat(opened, text)).alias("text"))
