"""Chat transcripts: roles by a hidden Markov model over lines, then canonical turns.

A transcript is a sequence of lines. Each line shows a speaker marker (none, or one of a role's), whether a blank line
stands before it, a length class and whether it ends with a question mark. Hidden states are role x (first line of a turn,
later line). Transitions and emissions are counted over labelled transcripts, all of them, with one added to each count.
Viterbi gives the states; a first-line state, a change of role or a marker begins a turn, and markers are cut from it.

Long transcripts are decoded in pieces of about `PIECE` lines (blank ones counted; lines at one place of a text stay
together): a piece's best scores between any two states are a matrix, the matrices of a transcript give the states at the
seams, and each piece is then decoded between its seams. Turns are numbered piece by piece too. So a task holds a piece's
lines, a turn's lines, or a transcript's matrices (36 numbers for a piece), and the result is that of decoding it whole.

Defined cases: a null or empty text is one empty line; a null role in labelled rows is not counted; a row with a null
transcript key is a transcript of its own (rows with equal texts are one); a null position comes first; rows at one
position have their lines by number, then by text, so repeated rows interleave; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import materialize
from tracewell.session import table

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
PIECE = 2048
# Words that name a speaker in transcripts.
MARKERS = {
    "system": "system|instructions?|context|system prompt",
    "user": "user|human|question|q|customer|prompter|you|input",
    "assistant": "assistant|ai|bot|answer|a|agent|model|gpt|response|output",
}


def marker_pattern(words: str) -> str:
    """A speaker at the beginning of a line: `User: ...`, `### User`, `<|user|>`, `[user] ...`, `**User:** ...`."""
    return rf"(?i)^\s*(?:(?:#+\s*|\*\*)?(?:{words})\s*:(?:\*\*)?|#+\s*(?:{words})\s*$|<\|?(?:{words})\|?>|\[(?:{words})\])\s*"


def marker(line: Column) -> Column:
    found = F.lit(0)
    for i, role in enumerate(ROLES):
        found = F.when(line.rlike(marker_pattern(MARKERS[role])), i + 1).otherwise(found)
    return found


def without_marker(line: Column) -> Column:
    return F.regexp_replace(line, marker_pattern("|".join(MARKERS.values())), "")


def conversation(key: Column, text: Column) -> Column:
    """The name of a row's transcript; a row without a key is a transcript of its own, as nothing ties it to others."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(text, F.lit("")))))


def lines_of(transcripts: DataFrame, key: str, position: str, text: str, *keep: str) -> DataFrame:
    """conv, pos, sub (line within the text), line, seen (what the line shows, as one number), and kept columns.

    Blank lines are not lines of their own; the line after one shows it.
    """
    blank = lambda c: F.trim(c) == ""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    before = F.concat(F.array(F.lit("-")), lines)  # each line beside the one before it; the last has none after it
    cut = F.posexplode(F.arrays_zip(lines.alias("line"), before.alias("before")))
    rows = transcripts.select(conversation(F.col(key), F.col(text)).alias("conv"), F.coalesce(F.col(position).cast("long"), F.lit(-1)).alias("pos"), *keep, cut.alias("sub", "both"))
    rows = rows.select("conv", "pos", *keep, "sub", F.col("both.line").alias("line"), F.col("both.before").alias("before")).where("line IS NOT NULL")
    rows = rows.where(~blank(F.col("line")) | (F.col("sub") == 0))
    size = F.char_length("line")
    length = F.when(size < 40, 0).when(size < 120, 1).when(size < 320, 2).when(size < 900, 3).otherwise(4)
    seen = ((marker(F.col("line")) * 2 + F.coalesce(blank(F.col("before")), F.lit(False)).cast("int")) * 5 + length) * 2 + F.rtrim("line").endswith("?").cast("int")
    return rows.withColumn("seen", seen.cast("int")).drop("before")


SEEN = 4 * 2 * 5 * 2


def factors(seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(marker with blank before, length, question) of what lines show."""
    return seen // 10, seen // 2 % 5, seen % 2


def fit(lines: DataFrame) -> dict[str, np.ndarray]:
    """Log scores from labelled lines: lines_of(...) with `role` and `first` (whether the line begins a turn).

    Counts are sums over all lines: at most states x shown values and states x states numbers reach the driver.
    """
    state = F.lit(None).cast("int")
    for i, (role, first) in enumerate(STATES):
        state = F.when((F.col("role") == role) & (F.col("first") == first), i).otherwise(state)
    known = materialize(lines.withColumn("state", state).where("state IS NOT NULL").select("conv", "pos", "sub", "seen", "state"), "labelled")
    emit = np.ones((len(STATES), SEEN))
    for r in known.groupBy("state", "seen").count().collect():
        emit[r["state"], r["seen"]] += r["count"]
    # Moves are counted within blocks of texts; the seams are few.
    order = W.partitionBy("conv", F.floor(F.col("pos") / PIECE)).orderBy("pos", "sub", "seen")
    moves = known.withColumn("before", F.lag("state").over(order))
    move, start = np.ones((len(STATES), len(STATES))), np.ones(len(STATES))
    for r in moves.where("before IS NOT NULL").groupBy("before", "state").count().collect():
        move[r["before"], r["state"]] += r["count"]
    # A transcript begins where its first line stands, whatever its positions count from.
    heads = moves.where("before IS NULL").groupBy("conv").agg(F.min(F.struct("pos", "sub", "seen", "state")).alias("first"))
    for r in heads.groupBy("first.state").count().collect():
        start[r["state"]] += r["count"]
    shown = factors(np.arange(SEEN))
    score = np.zeros((len(STATES), SEEN))
    for f in shown:
        total = np.stack([np.bincount(f, e, f.max() + 1) for e in emit])
        score += np.log(total / total.sum(1, keepdims=True))[:, f]
    return {"emit": score, "move": np.log(move / move.sum(1, keepdims=True)), "start": np.log(start / start.sum())}


def between(seen: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """[state before, state at the end]: the best score of a piece's lines."""
    best = np.where(np.eye(len(STATES)) > 0, 0.0, -np.inf)
    for s in seen:
        best = (best[:, :, None] + model["move"][None]).max(1) + model["emit"][:, s]
    return best


def onward(seen: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """[state at the end]: the best score of the lines of a transcript's first piece."""
    best = model["start"] + model["emit"][:, seen[0]]
    for s in seen[1:]:
        best = (best[:, None] + model["move"]).max(0) + model["emit"][:, s]
    return best


def viterbi(seen: np.ndarray, model: dict[str, np.ndarray], before: int | None, last: int | None) -> list[int]:
    """The best states of lines, after state `before` (None: at the start) and, if given, with state `last` at the end."""
    entry = model["start"] if before is None else model["move"][before]
    best = entry + model["emit"][:, seen[0]]
    back = []
    for s in seen[1:]:
        all_ = best[:, None] + model["move"]
        back.append(all_.argmax(0))
        best = all_.max(0) + model["emit"][:, s]
    path = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def in_pieces(lines: DataFrame) -> DataFrame:
    """lines with `piece`: the number of a line in its transcript, over PIECE; sums run over texts, in blocks of them."""
    rows = lines.groupBy("conv", "pos").agg((F.max("sub") + 1).cast("long").alias("n")).withColumn("block", F.floor(F.col("pos") / PIECE))
    blocks = rows.groupBy("conv", "block").agg(F.sum("n").alias("n"))
    earlier = lambda *part, by: F.coalesce(F.sum("n").over(W.partitionBy(*part).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("base", earlier("conv", "block", by="pos"))
    blocks = blocks.withColumn("block_base", earlier("conv", by="block")).drop("n")
    base = rows.join(blocks, ["conv", "block"]).select("conv", "pos", (F.col("base") + F.col("block_base")).alias("base"))
    return lines.join(base, ["conv", "pos"]).withColumn("piece", F.floor((F.col("base") + F.col("sub")) / PIECE).cast("long")).drop("base")


ORDER = ["pos", "sub", "line"]


def decode(lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """lines with `piece`, `state` and `earlier`, the state of the line before (null at the start)."""
    pieces = in_pieces(lines)
    shared = lines.sparkSession.sparkContext.broadcast(model)
    several = pieces.groupBy("conv").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).where("lo < hi").select("conv")
    long_ = pieces.join(several, "conv", "left_semi")

    def measure(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ORDER, kind="stable")
        seen, model_ = part["seen"].to_numpy(), shared.value
        return pd.DataFrame({"conv": [key[0]], "piece": [key[1]], "best": [between(seen, model_).ravel()], "head": [onward(seen, model_)]})

    def seams(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("piece")
        best, back = np.asarray(part["head"].iloc[0]), []
        for m in part["best"].iloc[1:]:
            all_ = best[:, None] + np.asarray(m).reshape(len(STATES), len(STATES))
            back.append(all_.argmax(0))
            best = all_.max(0)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        return pd.DataFrame({"conv": key[0], "piece": part["piece"], "before": [None, *path[:-1]], "last": path}).astype({"before": "Int64"})

    matrices = long_.groupBy("conv", "piece").applyInPandas(measure, "conv string, piece long, best array<double>, head array<double>")
    fixed = matrices.groupBy("conv").applyInPandas(seams, "conv string, piece long, before long, last long")
    rows = pieces.join(fixed, ["conv", "piece"], "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ORDER, kind="stable")
        before, last = (None if pd.isna(x) else int(x) for x in (part["before"].iloc[0], part["last"].iloc[0]))
        state = viterbi(part["seen"].to_numpy(), shared.value, before, last)
        return part.assign(state=state, earlier=pd.array([before, *state[:-1]], "Int32")).drop(columns=["before", "last"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", state int, earlier int"
    return rows.select(*pieces.columns, "before", "last").groupBy("conv", "piece").applyInPandas(run, schema)


def turns(decoded: DataFrame) -> DataFrame:
    """conv, turn (from 0), role, text of each turn; markers are cut from their lines."""
    role = F.get(F.array(*map(F.lit, ROLES)), F.floor(F.col("state") / 2).cast("int"))
    changes = F.col("earlier").isNull() | (F.floor(F.col("state") / 2) != F.floor(F.col("earlier") / 2))
    new = (F.col("state") % 2 == 0) | (marker(F.col("line")) > 0) | changes
    rows = decoded.select("conv", "piece", "pos", "sub", "line", role.alias("role"), new.cast("int").alias("new"), without_marker(F.col("line")).alias("content"))
    within = F.sum("new").over(W.partitionBy("conv", "piece").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    begun = rows.groupBy("conv", "piece").agg(F.sum("new").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("within", within).join(begun.select("conv", "piece", before.alias("before")), ["conv", "piece"])
    rows = rows.withColumn("turn", F.col("before") + F.col("within") - 1)
    lines = F.array_sort(F.collect_list(F.struct("pos", "sub", "line", "content")))
    text = F.trim(F.array_join(F.filter(F.transform(lines, lambda x: x["content"]), lambda x: x != ""), "\n"))
    return rows.groupBy("conv", "turn", "role").agg(text.alias("text"), F.min("pos").alias("pos"))


def render(turns_: DataFrame) -> DataFrame:
    """turns with `rendered`: the canonical form of a turn."""
    return turns_.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, raw: conversations written as raw transcripts, in a marker style per conversation.

    About a fifth of the turns carry no marker, only a blank line before them.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    name = F.coalesce("role", F.lit("user"))
    names = F.when(style == 1, F.when(name == "user", "Human").when(name == "assistant", "AI").otherwise("System")).otherwise(F.initcap(name))
    mark = F.when(style == 2, F.concat(F.lit("### "), names, F.lit("\n"))).when(style == 3, F.concat(F.lit("<|"), F.lower(names), F.lit("|> ")))
    mark = mark.when(style == 4, F.concat(F.lit("["), F.lower(names), F.lit("] "))).otherwise(F.concat(names, F.lit(": ")))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    raw = F.concat(F.when(bare, F.lit("\n")).otherwise(mark), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", raw.alias("raw"))


def recover(transcripts: DataFrame, labelled: DataFrame, key: str = "conv_id", position: str = "turn", text: str = "raw") -> DataFrame:
    """Turns of transcripts, with a model fitted on labelled ones (columns key, position, role, text).

    A row holds consecutive lines of a transcript; rows of one transcript follow each other by position.
    """
    lines = lines_of(labelled, key, position, text, "role")
    model = fit(lines.withColumn("first", F.col("sub") == 0))  # a text's first line stays even if it is blank
    return turns(materialize(decode(lines_of(transcripts, key, position, text), model), "decoded"))


def op7_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of the table, written raw and recovered; learnt from those whose crc32(conv_id) mod 3 is not 1."""
    raw = raw_transcripts(table(spark, sf_dir, "conversations"))
    learnable = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(3)) != 1
    found = render(recover(raw, raw.where(learnable)))
    return found.select(F.col("conv").try_cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", F.col("pos").alias("first_source_turn"), "text", "rendered")
