"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

Two lines are within one edit (a character put in, taken out or changed) if taking one character
out of one or both leaves the same text at the same place. The neighbourhood of a line has as
many variants as it has characters, so it is emitted only where it can meet another: a line is
cut into segments, the edit lies in one segment of the shorter line, and all before and
behind that segment is equal. First halves, then segments are joined by the hash of what is
outside them, and variants are made only inside segments whose outside another line shares. Both
filters lose nothing. Groups of equal variants are reduced to their earliest line, never to pairs,
and the distance to that line is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import SECOND_SEED, stage, without

#: Characters of a segment at most, and at least: short lines are cut into three, so that what is outside tells them apart.
SEGMENT, LEAST_SEGMENT = 64, 8
#: A table with so many rows and values in its arrays at most (64 bytes each) is sent to all executors rather than shuffled.
SMALL_VALUES = 1_000_000


def lines_of(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_id, _line_no, _line) for all lines between line feeds, counted from 0."""
    return docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_line_no", "_line"))


def has_text(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\r\f\x0b"))) > 0


def _line_key() -> list[Column]:
    return [F.xxhash64("_line").alias("_h1"), F.xxhash64("_line", F.lit(SECOND_SEED)).alias("_h2")]


def _bounded(df: DataFrame, array: str) -> DataFrame:
    """`df`, a staged table with an array for each row, marked for broadcast if it is counted to be small."""
    values = df.agg(F.sum(F.size(array).cast("long") + 1)).first()[0] or 0
    return F.broadcast(df) if values <= SMALL_VALUES else df


def _half_keys(n: Column) -> Column:
    """Hashes of either half, as a line of n characters and as one with a character more than the other."""
    out = []
    for more in (0, 1):
        size = n - more
        half = F.floor(size / 2).cast("int")
        out.append(F.xxhash64(F.lit("first"), size, F.substring(F.col("_line"), F.lit(1), half)))
        out.append(F.xxhash64(F.lit("last"), size, F.substring(F.col("_line"), n - (size - half) + 1, size - half)))
    return F.array(*out)


def _segments() -> Column:
    """For each segment, as either role: (role, key of the outside, inside). role 0: a line as it is; 1: one with a character more."""
    n = F.length("_line")

    def one(role: int) -> Column:
        shorter = F.greatest(n - role, F.lit(1))
        segment = F.least(F.lit(SEGMENT), F.greatest(F.lit(LEAST_SEGMENT), F.ceil(shorter / 3))).cast("int")
        last = F.floor((shorter - 1) / segment).cast("int")

        def at(j: Column) -> Column:
            begin = j * segment
            outside = F.xxhash64(j, n - role, F.substring(F.col("_line"), F.lit(1), begin), F.substring(F.col("_line"), begin + segment + 1 + role, n))
            return F.struct(F.lit(role).alias("role"), outside.alias("outside"), F.substring(F.col("_line"), begin + 1, segment + role).alias("inside"))

        return F.transform(F.sequence(F.lit(0), last), at)

    return F.concat(one(0), one(1))


def _variants() -> Column:
    """(side, key): side 0: with a character changed; 1: whole; 2: with a character taken out."""
    size = F.length("inside")
    cut = lambda i: F.concat(F.substring(F.col("inside"), F.lit(1), i), F.substring(F.col("inside"), i + 2, size))
    entry = lambda side, *parts: F.struct(F.lit(side).alias("side"), F.xxhash64(F.col("outside"), *parts).alias("key"))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    same = F.concat(F.transform(places, lambda i: entry(0, F.lit("changed"), i, cut(i))), F.array(entry(1, F.lit("moved"), F.col("inside"))))
    return F.when(F.col("role") == 0, same).otherwise(F.transform(places, lambda i: entry(2, F.lit("moved"), cut(i))))


def near_lines(docs: DataFrame, firsts: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_h1, _h2, keeper): distinct lines with an earlier distinct line within one edit, and the earliest such line's place."""
    halves = firsts.select("_h1", "_h2", F.explode("_halves").alias("_half"))
    shared = halves.groupBy("_half").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_half")
    met = halves.join(shared, "_half", "left_semi").select("_h1", "_h2").distinct()
    wanted = stage(firsts.join(met, ["_h1", "_h2"], "left_semi").select("_h1", "_h2", "first"), "lines-wanted")
    places = wanted.select(F.col("first._id").alias("_at"), F.col("first._line_no").alias("_no"), "_h1", "_h2", "first")
    # the texts of those lines, from the documents they first stand in
    home = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    sought = places.groupBy("_at").agg(F.collect_list(F.struct("_no", "_h1", "_h2", "first")).alias("_sought"))
    found = home.join(_bounded(stage(sought, "lines-sought"), "_sought"), F.col("_id").eqNullSafe(F.col("_at")))
    rows = found.select(F.split(F.coalesce("_text", F.lit("")), "\n").alias("_lines"), F.explode("_sought").alias("s"))
    texts = rows.select(F.get("_lines", F.col("s._no")).alias("_line"), "s._h1", "s._h2", "s.first")
    a, b = _line_key()
    lines = stage(texts.where((a == F.col("_h1")) & (b == F.col("_h2"))).dropDuplicates(["_h1", "_h2"]), "lines-texts")

    parts = lines.select("_h1", "_h2", "first", F.explode(_segments()).alias("p")).select("_h1", "_h2", "first", "p.*")
    outsides = parts.groupBy("outside").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("outside")
    meeting = stage(parts.join(outsides, "outside", "left_semi"), "lines-segments")
    variants = stage(meeting.select("_h1", "_h2", "first", F.explode(_variants()).alias("v")).select("_h1", "_h2", "first", "v.*"), "lines-variants")
    least = lambda side: F.min(F.when(F.col("side") == side, F.col("first"))).alias(f"m{side}")
    groups = variants.groupBy("key").agg(*map(least, range(3)), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    other = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    best = variants.join(groups, "key").groupBy("_h1", "_h2").agg(F.min("first").alias("first"), F.min(other).alias("keeper")).where("keeper < first")
    kept = lines.select(F.col("first").alias("keeper"), F.col("_line").alias("_kept"))
    verified = best.join(lines.select("_h1", "_h2", "_line"), ["_h1", "_h2"]).join(kept, "keeper").where(F.levenshtein("_line", "_kept", 1) >= 0)
    return verified.select("_h1", "_h2", "keeper")


def line_verdicts(docs: DataFrame, min_chars: int = 20, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(_id, _line_no, _n_chars, kind) for all lines that are not blank, kind: kept, exact or near.

    Lines are judged on the input in the order of (id, line number). exact: the same line stands
    earlier. near: a first occurrence of at least `min_chars` characters, with a different line of
    at least so many within one edit that stands earlier, whether or not that is kept itself.
    Nulls order first; rows that repeat an id count as one document, so of equal lines at one
    place all are kept.
    """
    size = F.length("_line")
    halves = F.when(size >= min_chars, _half_keys(size)).otherwise(F.array().cast("array<bigint>"))
    lines = lines_of(docs, text, id_col).where(has_text(F.col("_line")))
    keyed = lines.select("_id", "_line_no", size.alias("_n_chars"), *_line_key(), halves.alias("_halves"))
    firsts = stage(keyed.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_line_no")).alias("first"), F.first("_halves").alias("_halves")), "lines-first")
    near = stage(near_lines(docs, firsts, text, id_col), "lines-near")
    marked = firsts.select("_h1", "_h2", "first").join(near, ["_h1", "_h2"], "left")
    own = keyed.drop("_halves").join(marked, ["_h1", "_h2"])
    earliest = F.col("first._id").eqNullSafe(F.col("_id")) & (F.col("first._line_no") == F.col("_line_no"))
    kind = F.when(~earliest, "exact").when(F.col("keeper").isNotNull(), "near").otherwise("kept")
    return own.select("_id", "_line_no", "_n_chars", kind.alias("kind"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with the lines of `line_verdicts` that are not kept taken out of the text.

    Blank lines between kept ones stay. A document whose lines with text all go leaves with them,
    since it holds nothing of its own; one that had none to begin with stays as it is. Null texts
    stay null, repeated rows are treated alike, no rows give no rows, other columns stay.
    """
    verdicts = line_verdicts(docs, min_chars, text, id_col)
    gone = verdicts.groupBy("_id").agg(F.sort_array(F.collect_set(F.when(F.col("kind") != "kept", F.col("_line_no")))).alias("_gone"), F.bool_or(F.col("kind") == "kept").alias("_left"))
    touched = stage(gone.where(F.size("_gone") > 0), "lines-gone")
    joined = docs.join(_bounded(touched, "_gone"), docs[id_col].eqNullSafe(F.col("_id")), "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    cleaned = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest)
    columns = [cleaned.alias(text) if x == text else F.col(x) for x in without(docs, ["_id", "_gone", "_left"])]
    return joined.where(F.col("_left").isNull() | F.col("_left")).select(*columns)
