"""Operator 3, chat formatting: transcripts parsed by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines without message borders.  A hidden state is a role; each line of text either goes on
with the turn or starts a new one of some role.  What is seen of a line is its speaker marker (a word such as
``User:`` in many spellings, or none), whether blank lines precede it, and its form (length, question, list or code).
All probabilities are counted over labelled messages by Spark (:func:`fit`), with add-one smoothing: markers missing
or wrong at turn starts and found inside turns, blank lines, forms, lengths of turns, and who follows whom.  Viterbi
gives the most likely roles and starts; each turn is rendered canonically, without its marker, and turn marks
inside a text are escaped so that no message can forge a turn.

Rows of a transcript (:func:`parse` takes any number, in the order of ``turn_col``) are range-partitioned by conversation
and order, so a conversation of any length is spread.  A task cuts its rows into pieces of about PIECE lines at
rows' ends.  A conversation that is one piece is decoded at once.  Of other pieces the task gives the best scores from each
state before it to each state at its end (a small matrix); one pass over the matrices of a conversation finds the states at
its pieces' ends, and all pieces are decoded with these, so roles are those of decoding in one go and depend neither on
pieces nor on partitions (but for exact ties).  A message's text is never cut.

Defined cases: a null role writes no marker; null texts count as empty, and an empty message without marker leaves no
trace in a transcript; null conversation ids form one conversation; null turns come first; rows that agree in
conversation and turn follow each other in the order of a hash of their text, then of the text; ties go to the role named
first in ROLES; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, require, table

ROLES = ("system", "user", "assistant")
#: Marker words of each role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model", "chatbot"),
}
_ROLE_OF = {w: r for r, (_, words) in enumerate(MARKERS.items()) for w in words}
_S = r"[ \t\r\f\v]"
MARKER = rf"^{_S}*(?:<\|(?:im_start\|>)?|\[|#{{1,4}}{_S}*|\*\*)?{_S}*({'|'.join(sorted(_ROLE_OF, key=len, reverse=True))}){_S}*(?:\|>|\]|\*\*{_S}*:|:{_S}*\*\*|[:>]|$){_S}*"
LIST_OR_CODE = rf"^{_S}*(?:[-*0-9]+[.)]?{_S}|```)"
_MARKER, _LIST_OR_CODE = re.compile(MARKER, re.I), re.compile(LIST_OR_CODE)
_SPACE = " \t\r\f\v"
#: How raw transcripts write a marker; which one a message gets follows from a hash.
SPELLINGS = ("{0}: ", "{0}:\n", "### {0}:\n", "<|{0}|>", "[{0}] ", "**{0}:** ")
_TURN_MARK = re.compile(r"<(\\*)\|im_(start|end)\|>")

PIECE = 4096
NONE = len(ROLES)  # no marker
N_FORMS = 12


def marker(line: str) -> tuple[int, str]:
    """(role or NONE, line without its marker)."""
    m = _MARKER.match(line)
    return (_ROLE_OF[m[1].lower()], line[m.end() :]) if m else (NONE, line)


def form(line: str) -> int:
    """Length, and question, list or code, or nothing, as a number below N_FORMS."""
    size = 0 if len(line) < 40 else 1 if len(line) < 160 else 2
    bare = line.rstrip(_SPACE)
    return size * 4 + (3 if not bare else 1 if bare.endswith("?") else 2 if _LIST_OR_CODE.match(line) else 0)


def seen(lines: Iterable[str], blank: int = 0) -> tuple[list[tuple[int, int, int, str, str]], int]:
    """(marker, blank lines before, form, line, line without marker) of lines that aren't blank; blank lines at the end."""
    out = []
    for line in lines:
        if line.strip(_SPACE):
            m, rest = marker(line)
            out.append((m, blank, form(rest), line, rest))
            blank = 0
        else:
            blank += 1
    return out, blank


class Model:
    """Log probabilities from counts.

    start[role]; follow[role, role]; turns[role, (starts, goes on)] of lines; and of lines that go on with or start a
    role's turn: marks[role, starts, marker], gaps[role, starts, blank lines before], forms[role, starts, form].
    """

    def __init__(self, start, follow, turns, marks, gaps, forms):
        def log(x) -> np.ndarray:
            y = np.asarray(x, float) + 1.0  # add-one smoothing
            return np.log(y / y.sum(axis=-1, keepdims=True))

        self.start, self.follow, self.turns, self.marks, self.gaps, self.forms = map(log, (start, follow, turns, marks, gaps, forms))
        k = range(len(ROLES))
        self._start = self.start.tolist()
        self._new = [[float(self.turns[r, 0] + self.follow[r, q]) for q in k] for r in k]
        self._on = self.turns[:, 1].tolist()
        emit = self.marks[:, :, :, None, None] + self.gaps[:, :, None, :, None] + self.forms[:, :, None, None, :]
        self._emit = {(m, g, f): (emit[:, 0, m, g, f].tolist(), emit[:, 1, m, g, f].tolist()) for m in range(NONE + 1) for g in range(2) for f in range(N_FORMS)}

    def forward(self, lines: Sequence[tuple], entry: Sequence[float] | None) -> tuple[list[float], list]:
        """Scores of the roles at the last line, and (role before, line starts a turn) for each line and role.

        ``entry`` are the scores of the roles before the first line, None at a conversation's beginning.
        """
        k, score, back = range(len(ROLES)), entry, []
        for m, gap, f, *_ in lines:
            goes, starts = self._emit[m, min(gap, 1), f]
            if score is None:
                score = [self._start[q] + starts[q] for q in k]
                back.append([(-1, True)] * len(k))
                continue
            new, ways = [], []
            for q in k:
                fresh, origin = max((score[r] + self._new[r][q], -r) for r in k)
                fresh, stay = fresh + starts[q], score[q] + self._on[q] + goes[q]
                new.append(fresh if fresh > stay else stay)
                ways.append((-origin, True) if fresh > stay else (q, False))
            score = new
            back.append(ways)
        return list(score) if score is not None else [], back

    def transfer(self, lines: Sequence[tuple]) -> list[float]:
        """Best scores at the end of the lines by role, from each role before them, and from a conversation's beginning."""
        entries = [[0.0 if q == r else -math.inf for q in range(len(ROLES))] for r in range(len(ROLES))]
        return [x for entry in (*entries, None) for x in self.forward(lines, entry)[0]]

    def decode(self, lines: Sequence[tuple], entry: int | None = None, leave: int | None = None) -> list[tuple[int, bool]]:
        """(role, starts a turn) of each line, by Viterbi; from the role ``entry`` and to the role ``leave`` where they are known."""
        if not lines:
            return []
        score, back = self.forward(lines, None if entry is None else [0.0 if q == entry else -math.inf for q in range(len(ROLES))])
        role = max(range(len(ROLES)), key=lambda q: (score[q], -q)) if leave is None else leave
        out = []
        for ways in reversed(back):
            before, starts = ways[role]
            out.append((role, starts))
            role = before
        return out[::-1]


def escape(text: str) -> str:
    """Turn marks inside a text get a backslash more; taking one away gives the text back."""
    return _TURN_MARK.sub(r"<\1\\|im_\2|>", text)


def render(role: str, text: str) -> str:
    """One canonical turn."""
    return f"<|im_start|>{role}\n{escape(text)}<|im_end|>\n"


def turns(lines: Sequence[tuple], states: Sequence[tuple[int, bool]]) -> list[tuple[int, int, bool, str]]:
    """(first line's number, role, starts, text) of each run of lines of one turn; only the first run may not start one."""
    out: list[list] = []
    for n, ((_, gap, _, line, rest), (role, starts)) in enumerate(zip(lines, states)):
        if starts or not out:
            out.append([n, role, starts, [rest] if starts else ["\n" * (gap + 1), line]])
        else:
            out[-1][3] += ["\n" * (gap + 1), line]
    return [(n, role, starts, "".join(parts)) for n, role, starts, parts in out]


def parse_transcript(model: Model, transcript: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of one whole transcript."""
    lines, _ = seen(transcript.split("\n"))
    return [(ROLES[role], text.strip(_SPACE + "\n")) for _, role, _, text in turns(lines, model.decode(lines))]


def fit(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", raw_col: str = "raw") -> Model:
    """Count over all messages with a role, as transcripts write them."""
    require(df, conv_col, turn_col, role_col, raw_col)

    def counted(batches):
        total: dict[tuple[int, int, int, int, int], int] = {}
        for b in batches:
            for role, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if role in MARKERS:
                    for n, (m, gap, f, *_) in enumerate(seen((raw or "").split("\n"))[0]):
                        key = ROLES.index(role), int(n == 0), m, min(gap, 1), f
                        total[key] = total.get(key, 0) + 1
        cols = list(zip(*((*k, n) for k, n in total.items()))) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:5]), pa.array(cols[5], pa.int64())], names=["r", "s", "m", "g", "f", "n"])

    # a fixed number of rows from each task, and in all
    lines = df.select(role_col, raw_col).mapInArrow(counted, "r int, s int, m int, g int, f int, n long").groupBy("r", "s", "m", "g", "f").agg(F.sum("n").alias("n")).collect()
    k = len(ROLES)
    tabs = {"m": np.zeros((k, 2, NONE + 1)), "g": np.zeros((k, 2, 2)), "f": np.zeros((k, 2, N_FORMS))}
    kept = np.zeros((k, 2))
    for x in lines:
        for name, tab in tabs.items():
            tab[x["r"], x["s"], x[name]] += x["n"]
        kept[x["r"], 1 - x["s"]] += x["n"]
    index = F.coalesce(*(F.when(F.col(role_col) == r, F.lit(i)) for i, r in enumerate(ROLES)), F.lit(-1))
    # a message meets the one before it by turn number: an equi-join, not a window over a whole conversation
    here = df.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), index.alias("r")).where("r >= 0 AND c IS NOT NULL AND t IS NOT NULL").groupBy("c", "t").agg(F.min("r").alias("r"))
    after = here.select("c", (F.col("t") - 1).alias("t"), F.col("r").alias("s"))
    follow = np.zeros((k, k))
    for x in here.join(after, ["c", "t"]).groupBy("r", "s").count().collect():
        follow[x["r"], x["s"]] = x["count"]
    start = np.zeros(k)
    for x in here.where("t = 0").groupBy("r").count().collect():
        start[x["r"]] = x["count"]
    return Model(start, follow, kept, tabs["m"], tabs["g"], tabs["f"])


_TURNS = {"conv": None, "line": pa.int64(), "role": pa.int32(), "text": pa.string(), "starts": pa.bool_(), "edge": pa.bool_()}
_CUT = {"part": pa.int32(), "piece": pa.int64(), "lines": pa.list_(pa.string()), "n": pa.int64(), "blank": pa.int64(), "inner": pa.int64(), "plain": pa.list_(pa.float64()), "gapped": pa.list_(pa.float64())}
_ENDS = {"part": pa.int32(), "piece": pa.int64(), "before": pa.int64(), "blank": pa.int64(), "entry": pa.int32(), "leave": pa.int32()}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>", pa.list_(pa.float64()): "array<double>"}


def _schema(kinds: dict, conv: str) -> str:
    return ", ".join(f"{c} {conv if t is None else _SQL[t]}" for c, t in kinds.items())


def _batch(rows: list[dict], kinds: dict, conv) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], conv if t is None else t) for c, t in kinds.items()], names=list(kinds))


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _cut(model: Model, size: int, conv_type):
    """Over (conversation, raw) in order: turns of conversations that are one piece, else the pieces and what they do to scores."""

    def whole(conv, raw_lines: list[str]) -> list[dict]:
        lines, _ = seen(raw_lines)
        return [{"conv": conv, "line": n, "role": role, "text": text} for n, role, _, text in turns(lines, model.decode(lines))]

    def cut(batches):
        part, number = TaskContext.get().partitionId(), itertools.count()

        def piece(conv, raw_lines: list[str]) -> dict:
            lines, blank = seen(raw_lines)
            row = {"conv": conv, "part": part, "piece": next(number), "lines": raw_lines, "n": len(lines), "blank": blank}
            if lines:  # blank lines of the piece before may stand in front of the first line
                row |= {"inner": lines[0][1], "plain": model.transfer(lines), "gapped": model.transfer([(lines[0][0], 1, *lines[0][2:]), *lines[1:]])}
            return row

        out: list[dict] = []
        held = None  # a conversation so far in one piece, which may go on in the next task
        for k, (conv, own) in enumerate(itertools.groupby(_rows(batches), key=lambda r: r[0])):
            if held:
                out += whole(*held)
            lines: list[str] = []
            begun = k == 0  # the first conversation may have begun in the task before
            for _, raw in own:
                if len(lines) >= size:
                    out.append(piece(conv, lines))
                    lines, begun = [], True
                    yield _batch(out, _TURNS | _CUT, conv_type)
                    out.clear()
                lines += raw.split("\n")
            held = None if begun else (conv, lines)
            if begun:
                out.append(piece(conv, lines))
            if len(out) >= 1000:
                yield _batch(out, _TURNS | _CUT, conv_type)
                out.clear()
        if held:
            out.append(piece(*held))
        yield _batch(out, _TURNS | _CUT, conv_type)

    return cut


def _chained(batches):
    """Over the pieces of conversations in order: lines and blank lines before each, and the roles that the best path has before it and at its end."""
    k = len(ROLES)
    for _, own in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        score, steps, lines, blank = None, [], 0, 0
        for _, part, piece, n, after, inner, plain, gapped in own:
            if n:
                ways = np.array(gapped if blank or inner else plain).reshape(k + 1, k)
                ways = ways[k:] if score is None else score[:, None] + ways[:k]
                steps.append((part, piece, lines, blank, None if score is None else ways.argmax(axis=0)))
                score, lines, blank = ways.max(axis=0), lines + n, after
            else:
                blank += after
        if score is not None:
            role, out = int(score.argmax()), []
            for part, piece, before, gap, back in reversed(steps):
                entry = None if back is None else int(back[role])
                out.append({"part": part, "piece": piece, "before": before, "blank": gap, "entry": entry, "leave": role})
                role = entry
            yield _batch(out, _ENDS, None)


def _decoded(model: Model, conv_type):
    def decode(batches):
        for conv, raw_lines, before, blank, entry, leave in _rows(batches):
            lines, _ = seen(raw_lines, blank)
            got = turns(lines, model.decode(lines, entry, leave))
            yield _batch([{"conv": conv, "line": before + n, "role": role, "text": text, "starts": starts, "edge": k in (0, len(got) - 1)} for k, (n, role, starts, text) in enumerate(got)], _TURNS, conv_type)

    return decode


def _joined(runs: DataFrame) -> DataFrame:
    """Turns that go on over pieces' ends put together; only the first and last run of each piece can be parts of one."""
    number = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("conv").orderBy("line"))
    ends = runs.where("edge").withColumn("number", number)
    parts = ends.groupBy("conv", "number").agg(F.array_sort(F.collect_list(F.struct("line", "role", "text"))).alias("runs"))
    text = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    return runs.where("NOT edge").select("conv", "line", "role", "text").union(parts.select("conv", F.col("runs")[0]["line"], F.col("runs")[0]["role"], text))


def parse(df: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", raw_col: str = "raw", piece: int = PIECE) -> DataFrame:
    """One row a recovered turn: conversation, line (its first line's number among the transcript's lines of text), role, text, rendered.

    A transcript is the ``raw_col`` of a conversation's rows in the order of ``turn_col``, joined by line feeds.
    """
    require(df, conv_col, turn_col, raw_col)
    kind = df.schema[conv_col].dataType
    conv_type, conv = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()], kind.simpleString()
    raw = F.coalesce(F.col(raw_col).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(raw).alias("hash"), raw.alias("raw"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "conv", "turn", "hash").sortWithinPartitions("conv", "turn", "hash", "raw").select("conv", "raw")
    got = cut_lineage(dealt.mapInArrow(_cut(model, piece, conv_type), _schema(_TURNS | _CUT, conv)))
    done, pieces = got.where("part IS NULL").select("conv", "line", "role", "text"), got.where("part IS NOT NULL")
    # a small row for each piece, streamed conversation by conversation
    small = pieces.select("conv", "part", "piece", "n", "blank", "inner", "plain", "gapped").repartition(n, "conv").sortWithinPartitions("conv", "part", "piece")
    ends = small.mapInArrow(_chained, _schema(_ENDS, conv))
    told = pieces.select("conv", "part", "piece", "lines").join(ends, ["part", "piece"]).select("conv", "lines", "before", "blank", "entry", "leave")
    found = done.union(_joined(told.mapInArrow(_decoded(model, conv_type), _schema(_TURNS, conv))))
    space = r"[ \t\r\f\x0B\n]+"
    text = F.regexp_replace("text", rf"\A{space}|{space}\z", "")
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role") + 1)
    escaped = F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")
    rendered = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), escaped, F.lit("<|im_end|>\n"))
    return found.select(F.col("conv").alias(conv_col), "line", role.alias("role"), text.alias("text"), rendered.alias("rendered"))


#: Of the transcripts that :func:`with_raw` writes: one message in HIDDEN has no marker, one in WRONG that of another role.
HIDDEN, WRONG = 4, 50


def with_raw(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The messages and ``raw``, what raw transcripts have of them: markers in many spellings, some missing or wrong.

    A blank line stands before messages without marker and half of the others.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(conv_col).cast("string"), F.lit("")), F.coalesce(F.col(turn_col).cast("string"), F.lit("")), body).cast("binary"))
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    hidden, wrong = F.pmod(h, F.lit(HIDDEN)) == 0, F.pmod(F.floor(h / HIDDEN), F.lit(WRONG)) == 0
    following = F.create_map(*(F.lit(x) for k, r in enumerate(ROLES) for x in (r, ROLES[(k + 1) % len(ROLES)])))
    written = F.when(wrong, following[F.col(role_col)]).otherwise(F.col(role_col))
    words = F.create_map(*(x for r in ROLES for x in (F.lit(r), F.array(*(F.lit(w.capitalize()) for w in MARKERS[r])))))[written]
    word = F.try_element_at(words, (F.pmod(F.floor(h / 1024), F.size(words)) + 1).cast("int"))
    spelling = F.pmod(F.floor(h / 32768), F.lit(len(SPELLINGS)))
    mark = F.coalesce(*(F.when(spelling == k, F.concat(F.lit(s.split("{0}")[0]), word, F.lit(s.split("{0}")[1]))) for k, s in enumerate(SPELLINGS)), F.lit(""))
    shown = F.when(hidden, F.lit("")).otherwise(mark)
    blank = F.when((shown == "") | (F.pmod(F.floor(h / 7), F.lit(2)) == 0), F.lit("\n")).otherwise(F.lit(""))
    return df.select(conv_col, turn_col, role_col, F.concat(blank, shown, body).alias("raw"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = with_raw(table(spark, sf_dir, "conversations"))
    return parse(messages, fit(messages))


def _sql() -> str:
    """The same model and Viterbi in DuckDB SQL, line by line over whole conversations."""
    k = range(len(ROLES))
    text_end = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    role = lambda x: "CASE " + x + "".join(f" WHEN '{r}' THEN {i}" for i, r in enumerate(ROLES)) + " END"
    words = "CASE written" + "".join(f" WHEN '{r}' THEN [{', '.join(repr(w.capitalize()) for w in MARKERS[r])}]" for r in ROLES) + " END"
    spelled = "CASE h // 32768 % " + str(len(SPELLINGS)) + "".join(f" WHEN {i} THEN '{x.split('{0}')[0]}' || word || replace('{x.split('{0}')[1]}', '\\n', chr(10))".replace("\n", "\\n") for i, x in enumerate(SPELLINGS)) + " END"
    word_role = "CASE lower(regexp_extract(line, $m$" + MARKER + "$m$, 1, 'i'))" + "".join(f" WHEN '{w}' THEN {r}" for w, r in _ROLE_OF.items()) + f" ELSE {NONE} END"
    log = lambda n, total, size: f"ln((coalesce({n}, 0) + 1.0) / (coalesce({total}, 0) + {size}.0))"
    emits = ", ".join(f"max(e) FILTER (r = {r} AND s = {s}) AS e{r}{s}" for r in k for s in (0, 1))
    fresh = lambda q: f"greatest({', '.join(f'v.s{r} + a{r}{q}' for r in k)})"
    origin = lambda q: "CASE " + " ".join(f"WHEN v.s{r} + a{r}{q} = {fresh(q)} THEN v.p{r}" for r in k) + " END"
    starts = lambda q: f"{fresh(q)} + e{q}1 > v.s{q} + b{q} + e{q}0"
    step = ", ".join(f"CASE WHEN {starts(q)} THEN {fresh(q)} + e{q}1 ELSE v.s{q} + b{q} + e{q}0 END" for q in k)
    paths = ", ".join(f"CASE WHEN {starts(q)} THEN list_append({origin(q)}, {2 * q + 1}) ELSE list_append(v.p{q}, {2 * q}) END" for q in k)
    return rf"""
WITH RECURSIVE hashed AS (SELECT conv_id, turn, role, coalesce(text, '') AS body, CAST('0x' || substr(md5(concat(conv_id, ':', turn, ':', coalesce(text, ''))), 1, 8) AS BIGINT) AS h FROM conversations),
marked AS (SELECT *, CASE WHEN h // {HIDDEN} % {WRONG} = 0 THEN CASE role{"".join(f" WHEN '{r}' THEN '{ROLES[(i + 1) % len(ROLES)]}'" for i, r in enumerate(ROLES))} END ELSE role END AS written FROM hashed),
worded AS (SELECT *, {words} AS words FROM marked),
chosen AS (SELECT *, words[h // 1024 % len(words) + 1] AS word FROM worded),
shown AS (SELECT *, CASE WHEN h % {HIDDEN} = 0 THEN '' ELSE coalesce({spelled}, '') END AS mark FROM chosen),
raws AS (SELECT conv_id, turn, role, CASE WHEN mark = '' OR h // 7 % 2 = 0 THEN chr(10) ELSE '' END || mark || body AS raw FROM shown),
split AS (SELECT conv_id, turn, role, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM raws),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos FROM split),
texts AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY conv_id ORDER BY pos), 0) - 1 AS blank, i - coalesce(lag(i) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) - 1 AS own_blank,
  row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) = 1 AS first
  FROM placed WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
rests AS (SELECT *, {word_role} AS m, regexp_replace(line, $m${MARKER}$m$, '', 'i') AS rest FROM texts),
obs AS (SELECT *, CASE WHEN length(rest) < 40 THEN 0 WHEN length(rest) < 160 THEN 4 ELSE 8 END + CASE WHEN rtrim(rest, {text_end}) = '' THEN 3
  WHEN rtrim(rest, {text_end}) LIKE '%?' THEN 1 WHEN regexp_matches(rest, $m${LIST_OR_CODE}$m$) THEN 2 ELSE 0 END AS f FROM rests),
told AS (SELECT {role("role")} AS r, CAST(first AS INT) AS s, m, CASE WHEN own_blank > 0 THEN 1 ELSE 0 END AS g, f FROM obs WHERE role IN ({", ".join(map(repr, ROLES))})),
states AS (SELECT r, s FROM range({len(ROLES)}) a(r), range(2) b(s)),
marks AS (SELECT r, s, v, {log("n", "sum(n) OVER (PARTITION BY r, s)", NONE + 1)} AS p FROM states CROSS JOIN range({NONE + 1}) x(v) LEFT JOIN (SELECT r, s, m AS v, count(*) AS n FROM told GROUP BY ALL) USING (r, s, v)),
gaps AS (SELECT r, s, v, {log("n", "sum(n) OVER (PARTITION BY r, s)", 2)} AS p FROM states CROSS JOIN range(2) x(v) LEFT JOIN (SELECT r, s, g AS v, count(*) AS n FROM told GROUP BY ALL) USING (r, s, v)),
forms AS (SELECT r, s, v, {log("n", "sum(n) OVER (PARTITION BY r, s)", N_FORMS)} AS p FROM states CROSS JOIN range({N_FORMS}) x(v) LEFT JOIN (SELECT r, s, f AS v, count(*) AS n FROM told GROUP BY ALL) USING (r, s, v)),
kept AS (SELECT r, s, {log("n", "sum(n) OVER (PARTITION BY r)", 2)} AS p FROM states LEFT JOIN (SELECT r, s, count(*) AS n FROM told GROUP BY ALL) USING (r, s)),
here AS (SELECT conv_id, turn, min({role("role")}) AS r FROM conversations WHERE role IN ({", ".join(map(repr, ROLES))}) GROUP BY ALL),
follow AS (SELECT r, q, {log("n", "sum(n) OVER (PARTITION BY r)", len(ROLES))} AS p FROM (SELECT a.r, b.r AS q FROM range({len(ROLES)}) a(r), range({len(ROLES)}) b(r)) LEFT JOIN (SELECT x.r, y.r AS q, count(*) AS n FROM here x JOIN here y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 GROUP BY ALL) USING (r, q)),
opens AS (SELECT r, {log("n", "sum(n) OVER ()", len(ROLES))} AS p FROM range({len(ROLES)}) a(r) LEFT JOIN (SELECT r, count(*) AS n FROM here WHERE turn = 0 GROUP BY ALL) USING (r)),
moves AS (SELECT {", ".join(f"max(f.p + k.p) FILTER (f.r = {r} AND f.q = {q}) AS a{r}{q}" for r in k for q in k)} FROM follow f JOIN kept k ON k.r = f.r AND k.s = 1),
stays AS (SELECT {", ".join(f"max(p) FILTER (r = {r} AND s = 0) AS b{r}" for r in k)}, {", ".join(f"(SELECT p FROM opens WHERE r = {r}) AS o{r}" for r in k)} FROM kept),
emitted AS (SELECT conv_id, n, {emits} FROM (SELECT conv_id, n, x.r, x.s, x.p + y.p + z.p AS e FROM obs JOIN marks x ON x.v = m JOIN gaps y ON y.v = CASE WHEN blank > 0 THEN 1 ELSE 0 END AND (y.r, y.s) = (x.r, x.s) JOIN forms z ON z.v = f AND (z.r, z.s) = (x.r, x.s)) GROUP BY ALL),
given AS MATERIALIZED (SELECT * FROM emitted, moves, stays),
v(conv_id, n, {", ".join(f"s{q}" for q in k)}, {", ".join(f"p{q}" for q in k)}) AS (
  SELECT conv_id, n, {", ".join(f"o{q} + e{q}1" for q in k)}, {", ".join(f"[{2 * q + 1}]" for q in k)} FROM given WHERE n = 0
  UNION ALL SELECT g.conv_id, g.n, {step}, {paths} FROM v JOIN given g ON g.conv_id = v.conv_id AND g.n = v.n + 1),
best AS (SELECT conv_id, CASE {" ".join(f"WHEN s{q} = greatest(s0, s1, s2) THEN p{q}" for q in k)} END AS path FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
lined AS (SELECT o.conv_id, o.n, o.line, o.rest, o.blank, path[o.n + 1] // 2 AS r, path[o.n + 1] % 2 AS s FROM obs o JOIN best USING (conv_id)),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY n) AS number FROM lined),
joined AS (SELECT conv_id, min(n) AS line, any_value(r) AS r, trim(string_agg(CASE WHEN s = 1 THEN rest ELSE repeat(chr(10), CAST(blank + 1 AS INT)) || line END, '' ORDER BY n), {text_end}) AS text FROM numbered GROUP BY conv_id, number)
SELECT conv_id, CAST(line AS BIGINT) AS line, [{", ".join(map(repr, ROLES))}][r + 1] AS role, text,
  '<|im_start|>' || [{", ".join(map(repr, ROLES))}][r + 1] || chr(10) || regexp_replace(text, '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') || '<|im_end|>' || chr(10) AS rendered FROM joined"""


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {"op3_chat_format": _sql()}
