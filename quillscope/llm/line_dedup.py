"""Operator 9, line deduplication: a segment-partition edit join, in DataFrame
and SQL functions only.

Equal lines are folded into one first. A line that differs from another by at
most t edits keeps at least one of t + 1 segments unharmed, shifted by at most
t; so every distinct line files its t + 1 segments under (length, segment
number, content), and looks up, for its own length and up to t less, the
substrings that can be such a segment (the length-aware windows of the
published segment-join method). Lines that meet are compared by sixteen letter
counts, which t edits can change by no more than 2 t in all, then by banded
bit-parallel edit distance: for each number of edits up to t, the bits of one
number tell which of the 2 t + 1 diagonals of the band can be reached, and a
character moves all of them at once.

A line is removed if an equal line, or one within ``max_edits`` edits, stands
earlier, by (doc_id, line number); lines at one place of rows that share a doc_id
are none of them earlier than the others. Lengths are counted without outer blanks:
equal lines are folded from ``exact_chars`` characters, lines that differ are
compared from ``min_chars``, since two edits make other words of a short line.
Lines under both, and blank lines, are never removed. Defined results: a null or
empty text has no such line; documents with a null doc_id are left alone; equal
rows of one doc_id lose the same lines, and rows of one doc_id with other texts
each lose their own, as the mark of the text tells them apart; an
empty table gives an empty one; further columns pass through, whatever their
names; a line may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import among, free_name, release, stash

MAX_EDITS, MIN_CHARS, EXACT_CHARS = 2, 30, 1
_LETTERS = "eantirsohdlucmpg"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, mark, pos, line, k1, k2) of the lines that count."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = lines.select("doc_id", "mark", "pos", F.btrim("raw", F.lit(" \t\r\f\x0b")).alias("line")).where(F.length("line") >= min_chars)
    # 128 bits stand for a line
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(7), "line")})


def _rank() -> Column:
    """(doc_id, pos) as one number that hash aggregation can keep in place."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")


def _with_segments(lines: DataFrame, t: int) -> DataFrame:
    """``lines`` with the 1-based start and length of each of t + 1 segments, of
    lines of their length and of up to t less: columns by (less, segment), so
    that integers are worked out once for all keys."""
    parts, columns = t + 1, {}
    for less in range(t + 1):
        base, even = F.expr(f"CAST((n - {less}) div {parts} AS INT)"), F.expr(f"CAST({parts} - (n - {less}) % {parts} AS INT)")
        for i in range(parts):
            columns[f"start{less}_{i}"] = 1 + i * base + F.greatest(F.lit(0), i - even)
            columns[f"size{less}_{i}"] = base + (F.lit(i) >= even).cast("int")
    return lines.withColumns(columns)


def _key(less: int, i: int, shift: int) -> Column:
    """Of characters kept as four bytes each, so that a cut is an offset."""
    start, size = F.col(f"start{less}_{i}"), F.col(f"size{less}_{i}")
    return F.xxhash64(F.col("n") - less, F.lit(i), F.substr("wide", (start + shift) * 4 - 3, size * 4))


def _filed(t: int) -> Column:
    return F.array(*(_key(0, i, 0) for i in range(t + 1)))


def _sought(t: int) -> Column:
    """Substrings that can be a segment of a line of the same or a smaller
    length. All lie inside a line of 2 t + 1 characters or more: a segment can
    shift by its number to the left, and by those behind it to the right."""
    return F.array(*(_key(less, i, shift) for less in range(t + 1) for i in range(t + 1) for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1)))


def _letters() -> Column:
    """Counts of sixteen letters modulo 16, four bits each, in one number."""
    text, out = F.col("line"), F.lit(0).cast("long")
    for k, c in enumerate(_LETTERS):
        n = (F.octet_length("line") - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(15), 4 * k))
    return out


def _apart(a: Column, b: Column) -> Column:
    """Sum over the letters of the distance of counts on the circle of 16:
    no more than the counts really differ."""

    def circle(k: int) -> Column:
        d = (F.shiftright(a, 4 * k).bitwiseAND(15) - F.shiftright(b, 4 * k).bitwiseAND(15)).bitwiseAND(15)
        return F.least(d, 16 - d)

    return sum((circle(k) for k in range(1, len(_LETTERS))), circle(0))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _characters(line: Column) -> Column:
    """A line's characters, four bytes each."""
    wide = F.encode(line, "UTF-32")
    return _let(wide, lambda w: F.transform(F.sequence(F.lit(0), (F.octet_length(w) / 4).cast("int") - 1), lambda i: F.substr(w, i * 4 + 1, F.lit(4))))


def within_edits(a: Column, b: Column, t: int) -> Column:
    """Whether two lines, not empty, differ by at most ``t`` edits. Bit d of
    number e is set if the first j + d - t characters of one line can be made
    from the first j of the other with e edits."""
    mask = (1 << (2 * t + 1)) - 1

    def step(x: Column, y: Column):
        def move(reached: Column, j: Column) -> Column:
            same, out = F.lit(0), []
            for d in range(2 * t + 1):
                same = same.bitwiseOR(F.when(F.get(x, j + (d - t)) == F.get(y, j), F.lit(1 << d)).otherwise(0))
            for e in range(t + 1):
                now = reached[f"e{e}"].bitwiseAND(same)
                if e:  # a character replaced, put in or left out
                    fewer = reached[f"e{e - 1}"]
                    now = now.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(mask))
                out.append(now)
            return F.struct(*(v.alias(f"e{e}") for e, v in enumerate(out)))

        return move

    start = F.struct(*(F.lit(((1 << (e + 1)) - 1) << t).alias(f"e{e}") for e in range(t + 1)))

    def reached(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        end = F.size(x) - F.size(y) + t
        last = F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step(x, y), lambda r: r[f"e{t}"])
        return (end >= 0) & (end <= 2 * t) & (F.call_function("shiftright", last, end).bitwiseAND(F.lit(1)) == 1)

    return _let(F.struct(_characters(a).alias("x"), _characters(b).alias("y")), reached)


def duplicate_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """(doc_id, mark, pos) of each line that an earlier line makes redundant; the
    mark is the hash of its row's text."""
    if min_chars < 2 * max_edits + 1:
        raise ValueError("lines that are compared by edits must have 2 * max_edits + 1 characters")
    lines = _lines(docs, max(1, min(min_chars, exact_chars)))
    folded = lines.groupBy("k1", "k2", "line").agg(F.min(_rank()).alias("rank"))
    distinct = stash(folded.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "rank", F.length("line").alias("n"), _letters().alias("letters"), "line"))
    wide = _with_segments(distinct.where(F.col("n") >= min_chars).select("id", "n", "letters", F.encode("line", "UTF-32").alias("wide")), max_edits)
    filed = wide.select("id", "letters", F.explode(_filed(max_edits)).alias("key"))
    sought = wide.select(F.col("id").alias("id2"), F.col("letters").alias("letters2"), F.explode(_sought(max_edits)).alias("key"))
    near = (F.col("id") != F.col("id2")) & (_apart(F.col("letters"), F.col("letters2")) <= 2 * max_edits)
    pairs = stash(filed.join(sought.hint("merge"), "key").where(near).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
    asked = among(distinct.select("id", "rank", "line"), "id", pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = asked.select(F.col("id").alias("a"), F.col("rank").alias("rank_a"), F.col("line").alias("line_a"))
    right = asked.select(F.col("id").alias("b"), F.col("rank").alias("rank_b"), F.col("line").alias("line_b"))
    both = pairs.join(left, "a").join(right, "b").where(within_edits(F.col("line_a"), F.col("line_b"), max_edits))
    later = both.where("rank_a <> rank_b").select(F.when(F.col("rank_a") < F.col("rank_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    fate = stash(distinct.select("id", "k1", "k2", "rank").join(later.withColumn("near", F.lit(True)), "id", "left").drop("id"))
    release(distinct, pairs)
    found = lines.select("doc_id", "mark", "pos", "k1", "k2").join(fate, ["k1", "k2"])
    return found.where(F.col("near").isNotNull() | (_rank() > F.col("rank"))).select("doc_id", "mark", "pos")


def removed_by_document(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """(doc_id, mark, removed): the sorted line numbers that each text loses."""
    found = duplicate_lines(docs, max_edits, min_chars, exact_chars)
    return found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """``docs`` with redundant lines gone from the text. A document that had
    text and loses all but blanks is dropped; all others stay."""
    name = free_name(docs.columns, "_removed_lines")
    of, mark = (free_name([*docs.columns, name], c) for c in ("_line_owner", "_line_mark"))
    removed = removed_by_document(docs, max_edits, min_chars, exact_chars).select(F.col("doc_id").alias(of), F.col("mark").alias(mark), F.col("removed").alias(name))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(name, i)), "\n")
    out = docs.join(removed, (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(mark)), "left")
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(kept)
    out = out.withColumn("text", text).where(F.col(name).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(docs.columns)
