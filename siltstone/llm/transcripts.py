"""Transcript parsing: a hidden Markov model over speaker markers and line features, decoded by Viterbi."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siltstone.llm.common import Scratch, text_blocks
from siltstone.operators.order import with_position

#: Turns in one part of a transcript. A longer conversation has several parts, which are parsed as one transcript.
PART_TURNS = 256
#: Parts (or groups of parts) whose summaries one task holds at a time.
GROUP = 256
#: Labelled turns that the model is fitted on, at most (about; a hash of the conversation's id picks them).
TRAIN_TURNS = 40_000

#: Speaker names at the start of a line, by kind.
SPEAKERS = {
    "user": 0, "human": 0, "q": 0, "question": 0, "customer": 0, "me": 0,
    "assistant": 1, "ai": 1, "a": 1, "answer": 1, "bot": 1, "agent": 1,
    "system": 2, "instructions": 2, "context": 2,
}
OTHER_NAME, NO_MARKER = 3, 4
MARKERS, LENGTHS = 5, 12

_MARKER = re.compile(r"\s{0,8}(?:\[|<|\*\*|#+ ?)?([A-Za-z]{1,14})(?:\]|>|\*\*)?\s?(?::|>|\]|-)(?: ?\*\*)?(?=\s|$)[ \t]*")

#: How the test transcripts write the roles, by style; the last style has no markers.
STYLES = [
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Human: ", "assistant": "AI: ", "system": "Instructions: "},
    {"user": "Q: ", "assistant": "A: ", "system": "Context: "},
    {},
]

SUMMARY = "conv_id bigint, at bigint, spoken boolean, blanks bigint, close binary, apart binary"
BOUNDS = "conv_id bigint, at bigint, before int, blanks_before bigint, after int"
SCHEMA = "conv_id bigint, part bigint, n_lines bigint, n_turns bigint, roles string, rendered_sha256 string, rendered string"


def read_line(line: str) -> tuple[int, str]:
    """The marker's kind and the line without it."""
    if (m := _MARKER.match(line)) is None:
        return NO_MARKER, line
    kind = SPEAKERS.get(m[1].lower())
    return (OTHER_NAME, line) if kind is None else (kind, line[m.end() :])


def features(lines: list[str], gap: int = 1) -> tuple[list[int], list[str], np.ndarray]:
    """Numbers of the lines that are not blank, their texts without markers, and a row of features of each.

    Features: marker kind, whether the line starts the transcript or follows a blank one (``gap`` for
    the first), length on a log scale, and whether it asks.
    """
    at, texts, rows = [], [], []
    for i, line in enumerate(lines):
        if not line.strip():
            gap = 1
            continue
        kind, text = read_line(line)
        at.append(i)
        texts.append(text)
        rows.append((kind, gap, min(LENGTHS - 1, len(text).bit_length()), int(text.rstrip().endswith("?"))))
        gap = 0
    return at, texts, np.array(rows, np.int64).reshape(-1, 4)


def part_lines(text: str | None, part: int) -> list[str]:
    """Lines of one part; a later part starts with the end of the line before it."""
    lines = (text or "").split("\n")
    return lines[1:] if part else lines


SIZES = (MARKERS, 2, LENGTHS, 2)


class Hmm:
    """States: for each role its first line and a further line. All parameters are logarithms."""

    def __init__(self, roles: list[str], start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.roles, self.start, self.step, self.emit = roles, start, step, emit

    @classmethod
    def from_counts(cls, roles: list[str], counts: dict[tuple[str, int, int], int]) -> Hmm:
        """counts: ("start", 0, state), ("step", state, state) and ("f0".."f3", state, value)."""
        n = 2 * len(roles)
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        start, step, emit = np.zeros(n), np.zeros((n, n)), [np.full((n, k), 0.5) for k in SIZES]
        for (kind, a, b), c in counts.items():
            if kind == "start":
                start[b] += c
            elif kind == "step":
                step[a, b] += c
            else:
                emit[int(kind[1])][a, b] += c
        start[::2] += 0.5  # a transcript starts with a turn's first line
        step[:, ::2] += 0.5
        step[np.arange(n), np.arange(n) | 1] += 0.5  # only the same role goes on
        with np.errstate(divide="ignore"):
            return cls(roles, log(start), log(step), [log(e) for e in emit])

    @property
    def none(self) -> int:
        """What stands for the state before the first line."""
        return len(self.start)

    def _seen(self, rows: np.ndarray) -> np.ndarray:
        return sum(e[:, rows[:, k]] for k, e in enumerate(self.emit)).T

    def _into(self) -> np.ndarray:
        """Scores of the next line's state, by the state before; the last row is that before the first line."""
        return np.vstack([self.step, self.start])

    def decode(self, rows: np.ndarray, before: int | None = None, after: int | None = None) -> np.ndarray:
        """The likeliest states (Viterbi), behind state ``before`` and ending with ``after`` if these are given; of equal ones the first."""
        n = len(rows)
        if not n:
            return np.empty(0, np.int64)
        seen = self._seen(rows)
        back = np.empty((n, len(self.start)), np.int64)
        score = self._into()[self.none if before is None else before] + seen[0]
        for i in range(1, n):
            to = score[:, None] + self.step
            back[i] = to.argmax(0)
            score = to.max(0) + seen[i]
        path = np.empty(n, np.int64)
        path[-1] = score.argmax() if after is None else after
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def transfer(self, rows: np.ndarray) -> np.ndarray:
        """Best scores from each state before the lines to each state at their end, ``none`` included."""
        seen = self._seen(rows)
        score = self._into() + seen[0]
        for line in seen[1:]:
            score = (score[:, :, None] + self.step).max(1) + line
        out = np.full((self.none + 1, self.none + 1), -np.inf)
        out[:, :-1] = score
        return out


def parse(text: str | None, model: Hmm) -> list[tuple[str, str]]:
    """The turns (role, text) of a whole transcript. Blank lines inside a turn stay, those at its ends go."""
    at, texts, rows = features((text or "").split("\n"))
    turns: list[tuple[str, list[str]]] = []
    last = 0
    for i, line, state in zip(at, texts, model.decode(rows).tolist(), strict=True):
        if state % 2 == 0 or not turns:
            turns.append((model.roles[state // 2], [line]))
        else:
            turns[-1][1].extend([""] * (i - last - 1) + [line])
        last = i
    return [(role, "\n".join(body)) for role, body in turns]


def show(model: Hmm, at: list[int], texts: list[str], states: list[int], before: int, blanks: int, last: bool) -> tuple[str, list[str]]:
    """Canonical turns of a part, one piece of its conversation's, and the roles of those that start in it.

    A turn is closed by the next one or the conversation's end. Blank lines inside a turn stay,
    ``blanks`` of the parts before included; those at its ends go. What looks like a delimiter inside a
    text is broken up.
    """
    out, roles, open_, seen = [], [], before != model.none, -1
    for i, line, state in zip(at, texts, states, strict=True):
        line = line.replace("<|", "< |")
        if state % 2 and open_:
            out.append("\n" * (i - seen + (blanks if seen < 0 else 0)) + line)
        else:
            role = model.roles[state // 2]
            out.append(("<|im_end|>\n" if open_ else "") + f"<|im_start|>{role}\n{line}")
            roles.append(role)
            open_ = True
        seen = i
    return "".join(out) + ("<|im_end|>\n" if last and open_ else ""), roles


# -- conversations of several parts: summaries are folded, groups of GROUP at a time --------------


def summary(text: str | None, part: int, model: Hmm) -> tuple[bool, int, bytes, bytes]:
    """What a part does to the states before it: whether it has lines that are not blank, its blank lines behind
    them (all, if none), and the transfer where the first line follows another and where it follows a blank one."""
    lines = part_lines(text, part)
    at, _, rows = features(lines, 0)
    if not at:
        return False, len(lines), b"", b""
    close = model.transfer(rows)
    rows[0, 1] = 1
    return True, len(lines) - 1 - at[-1], close.tobytes(), (model.transfer(rows) if at[0] == 0 else close).tobytes()


def _chosen(one: dict, gap: bool, n: int) -> np.ndarray:
    return np.frombuffer(one["apart" if gap else "close"], np.float64).reshape(n, n)


def fold(parts: list[dict], model: Hmm) -> tuple[bool, int, bytes, bytes]:
    """The summary of consecutive parts."""
    n, out, after = model.none + 1, [], 0
    spoken = any(p["spoken"] for p in parts)
    for gap in (False, True):
        total, blank, after = None, gap, 0
        for p in parts:
            if p["spoken"]:
                own = _chosen(p, blank, n)
                total = own if total is None else (total[:, :, None] + own).max(1)
                after = p["blanks"]
            else:
                after += p["blanks"]
            blank = after > 0 or blank and not p["spoken"]
        out.append(b"" if total is None else total.tobytes())
    return spoken, after, *out


def bounds(parts: list[dict], model: Hmm, before: int, blanks: int, after: int | None) -> list[tuple[int, int, int]]:
    """(state before, blank lines before, state at the end) of consecutive parts on the likeliest path from
    ``before`` to ``after`` (to the best end, if None)."""
    n = model.none + 1
    score = np.full(n, -np.inf)
    score[before] = 0
    pending, back = [], []
    for p in parts:
        pending.append(blanks)
        if p["spoken"]:
            to = score[:, None] + _chosen(p, blanks > 0, n)
            back.append(to.argmax(0))
            score, blanks = to.max(0), p["blanks"]
        else:
            back.append(np.arange(n))
            blanks += p["blanks"]
    state = int(score.argmax()) if after is None else after
    out = []
    for number, step in zip(reversed(pending), reversed(back), strict=True):
        out.append((int(step[state]), number, state))
        state = int(step[state])
    return out[::-1]


def raw_turn(role: Column, text: Column, style: Column, bare: Column) -> Column:
    """A turn as a transcript writes it: the style's marker, unless the turn is a bare one."""
    mark = F.lit("")
    for i, names in enumerate(STYLES):
        for name, written in names.items():
            mark = F.when((style == i) & (role == name) & ~bare, F.lit(written)).otherwise(mark)
    return F.concat(mark, F.coalesce(text, F.lit("")))


def write_transcripts(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, parts, transcript, roles, line_counts, spaced) of labelled conversations.

    Turns are written one below another, by turn, role and text (nulls first), with markers of a style
    that a hash of the conversation picks; every fourth turn (by a hash) and one style have none. A
    blank line parts two turns in half of the conversations. A conversation's text comes in ``parts``
    of PART_TURNS turns, however turns are numbered; a later part starts with the line break between
    two turns, so all of them one after another are the whole. Equal rows count once, null texts are
    empty, rows with a null id are one conversation, an empty table gives an empty one.
    """
    c, scratch = F.col, Scratch(conversations.sparkSession, "transcripts")
    rows = conversations.select(c(f"`{id_col}`").cast("bigint").alias("conv_id"), c(f"`{turn_col}`").cast("bigint").alias("turn"), c(f"`{role_col}`").alias("role"), c(f"`{text_col}`").alias("text")).distinct()
    placed = with_position(rows, "conv_id", *(c(x).asc_nulls_first() for x in ("turn", "role", "text")))
    # as a written table both sides of the next join are shuffled for it, and a very long conversation is split
    sizes = scratch.save(placed.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count("*").alias("turns")).withColumnRenamed("conv_id", "__id"), "sizes")
    placed = placed.join(sizes, placed.conv_id.eqNullSafe(sizes["__id"])).withColumn("at", c("pos") - c("first"))
    placed = placed.withColumn("part", F.floor(c("at") / PART_TURNS).cast("bigint")).withColumn("parts", F.ceil(c("turns") / PART_TURNS).cast("bigint"))
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(2 * len(STYLES)))
    written = raw_turn(c("role"), c("text"), F.floor(pick / 2), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0)
    turn = F.struct("at", "role", written.alias("written"))
    told = placed.groupBy("conv_id", "part", "parts").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    between = F.when(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0, "\n\n").otherwise("\n")
    text = F.concat(F.when(c("part") > 0, between).otherwise(""), F.call_function("array_join", F.transform("turns", lambda t: t["written"]), between))
    return told.select("conv_id", "part", "parts", text.alias("transcript"), F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: F.size(F.split(t["written"], "\n", -1))).alias("line_counts"), (between == "\n\n").alias("spaced"))


def held_out(column: str) -> Column:
    """The conversations that no model learns from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def fit(transcripts: DataFrame, bound: int = TRAIN_TURNS) -> Hmm:
    """The model of labelled transcripts (see ``write_transcripts``) that are not held out.

    Learns from about ``bound`` turns. Only counts by state reach the driver.
    """
    rows = transcripts.filter(~held_out("conv_id") & F.col("conv_id").isNotNull())
    total = rows.agg(F.sum(F.size("roles"))).first()[0] or 0
    share = int(min(1.0, bound / max(1, total)) * (1 << 32))
    rows = rows.filter(F.pmod(F.xxhash64("conv_id", F.lit(7)), F.lit(1 << 32)) < share)
    roles = sorted(r[0] for r in rows.select(F.explode("roles").alias("role")).filter("role IS NOT NULL").distinct().collect())
    if not roles:
        roles = ["user"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        number = {r: i for i, r in enumerate(roles)}

        def add(kind: str, a: int, b: int) -> None:
            counts[kind, a, b] = counts.get((kind, a, b), 0) + 1

        for part, texts in text_blocks(batches, "transcript"):
            for text, number_of_part, names, sizes, spaced in zip(texts, *(part.column(c).to_pylist() for c in ("part", "roles", "line_counts", "spaced")), strict=True):
                owner, at = {}, int(spaced and number_of_part > 0)
                for k, size in enumerate(sizes):
                    owner |= {i: k for i in range(at, at + size)}
                    at += size + int(spaced)
                lines, _, feats = features(part_lines(text, number_of_part), int(number_of_part == 0))
                before = seen = None
                for i, row in zip(lines, feats.tolist(), strict=True):
                    k = owner.get(i)
                    if k is None or names[k] is None:
                        before = None
                        continue
                    state = 2 * number[names[k]] + int(k == seen)
                    if before is not None:
                        add("step", before, state)
                    elif number_of_part == 0:
                        add("start", 0, state)
                    for j, value in enumerate(row):
                        add(f"f{j}", state, value)
                    before, seen = state, k
        if counts:
            kinds, a, b = zip(*counts, strict=True)
            yield pa.RecordBatch.from_pydict({"kind": list(kinds), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    counted = rows.select("transcript", "part", "roles", "line_counts", "spaced").mapInArrow(count, "kind string, a bigint, b bigint, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return Hmm.from_counts(roles, {(r["kind"], r["a"], r["b"]): r["n"] for r in counted.collect()})


def _over_groups(groups: DataFrame, ddl: str, work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """work(row) gives rows of ``ddl`` for each row of ``groups``, a few at a time."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if rows := list(work(batch.slice(i, 1).to_pylist()[0])):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return groups.mapInArrow(run, ddl)


def _grouped(summaries: DataFrame) -> DataFrame:
    """(conv_id, at, items): GROUP summaries a row, in their order."""
    item = F.struct(F.col("at").alias("place"), "spoken", "blanks", "close", "apart")
    return summaries.groupBy("conv_id", F.floor(F.col("at") / GROUP).cast("bigint").alias("at")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def part_bounds(parts: DataFrame, model: Hmm, scratch: Scratch) -> DataFrame:
    """BOUNDS of each part of (conv_id, part, transcript): the state and blank lines before it and its last state,
    on the likeliest path through the whole conversation.

    Viterbi over parts: each part's transfer between its ends is a small matrix; GROUP of these are
    folded to one until a conversation has a single group, then paths are fixed from the top down. So
    no task holds more than GROUP matrices, however long a conversation is.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, "transcript"):
            rows = [summary(t, n, model) for t, n in zip(texts, part.column("part").to_pylist(), strict=True)]
            spoken, blanks, close, apart = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"conv_id": part.column("conv_id"), "at": part.column("part"), "spoken": pa.array(spoken, pa.bool_()), "blanks": pa.array(blanks, pa.int64()), "close": pa.array(close, pa.binary()), "apart": pa.array(apart, pa.binary())})

    levels = [scratch.save(parts.select("conv_id", "part", "transcript").mapInArrow(summarise, SUMMARY), "summaries")]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= GROUP:
        folded = _over_groups(_grouped(levels[-1]), SUMMARY, lambda g: iter([(g["conv_id"], g["at"], *fold(g["items"], model))]))
        levels.append(scratch.save(folded, "summaries"))
    out = None
    for level in reversed(levels):
        groups = _grouped(level)
        if out is None:
            groups = groups.select("*", F.lit(model.none).alias("before"), F.lit(1).cast("bigint").alias("blanks_before"), F.lit(None).cast("int").alias("after"))
        else:
            above = out.withColumnsRenamed({"conv_id": "__id", "at": "__at"})
            groups = groups.join(above, groups.conv_id.eqNullSafe(above["__id"]) & (groups["at"] == above["__at"])).drop("__id", "__at")

        def work(g: dict) -> Iterator[tuple]:
            found = bounds(g["items"], model, g["before"], g["blanks_before"], g["after"])
            return ((g["conv_id"], item["place"], *b) for item, b in zip(g["items"], found, strict=True))

        out = scratch.save(_over_groups(groups, BOUNDS, work), "bounds")
    return out


def parse_transcripts(transcripts: DataFrame, model: Hmm, id_col: str = "conv_id", part_col: str = "part", parts_col: str = "parts", text_col: str = "transcript") -> DataFrame:
    """Roles and canonical turns of raw transcripts, one row per row.

    Returns conv_id, part, n_lines (not blank), n_turns and roles (comma-joined) of the turns that start
    in the part, the rendered piece and its SHA-256. Parts of a conversation (numbered from 0, each id's
    parts once) are decoded as one text: their pieces one after another are what the whole transcript
    gives. Conversations of one part are a map without a shuffle.

    Null and empty transcripts have no turns; null ids stay null; other columns are ignored, whatever
    their names; equal rows of single parts get equal results; an empty table gives an empty one.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_lines", pa.int64()), ("n_turns", pa.int64()), ("roles", pa.string()), ("rendered_sha256", pa.string()), ("rendered", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in text_blocks(batches, "text"):
            lines, roles, shown = [], [], []
            for text, part, last, before, blanks, after in zip(texts, *(block.column(c).to_pylist() for c in ("part", "last", "before", "blanks_before", "after")), strict=True):
                at, bodies, rows = features(part_lines(text, part), int(blanks > 0))
                states = model.decode(rows, before, after).tolist()
                piece, started = show(model, at, bodies, states, before, blanks, last)
                lines.append(len(at))
                roles.append(started)
                shown.append(piece)
            yield pa.record_batch([block.column("conv_id"), block.column("part"), pa.array(lines, pa.int64()), pa.array(map(len, roles), pa.int64()), pa.array([",".join(r) for r in roles]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown]), pa.array(shown)], schema=schema)

    scratch = Scratch(transcripts.sparkSession, "parse")
    c = F.col
    rows = transcripts.select(c(f"`{id_col}`").cast("bigint").alias("conv_id"), c(f"`{part_col}`").cast("bigint").alias("part"), c(f"`{parts_col}`").cast("bigint").alias("parts"), c(f"`{text_col}`").alias("text"))
    whole = rows.filter("parts = 1").select("conv_id", "part", "text", F.lit(True).alias("last"), F.lit(model.none).alias("before"), F.lit(1).cast("bigint").alias("blanks_before"), F.lit(None).cast("int").alias("after"))
    several = rows.filter("parts > 1")
    if several.take(1):
        found = part_bounds(several.withColumnRenamed("text", "transcript"), model, scratch).withColumnsRenamed({"conv_id": "__id", "at": "__at"})
        several = several.join(found, several.conv_id.eqNullSafe(found["__id"]) & (several["part"] == found["__at"]))
        whole = whole.unionByName(several.select("conv_id", "part", "text", (c("part") == c("parts") - 1).alias("last"), "before", "blanks_before", "after"))
    return whole.mapInArrow(run, SCHEMA)
