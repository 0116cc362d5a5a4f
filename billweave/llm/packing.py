"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents become pieces: one of at most `size` tokens, or, cut from the end, pieces of
`size` tokens and a first one with the rest.  Full pieces are sequences.  Two pieces of more
than half a sequence never fit together, so each of them opens a sequence at the start.  The
other pieces and the gaps of open sequences are then matched in rounds:

1.  If the pieces left have more tokens than the gaps have places, as many sequences as
    that needs are opened; every packing needs them.
2.  Gaps and pieces are range-sorted by size, largest first, gaps before pieces of their size.
3.  Each range is swept: a piece goes to its successor, the smallest gap of the range that is
    large enough, and what is left of the gap stays in the sweep.  Only the first range opens
    sequences, because no gap lies before it.
4.  Pieces that found no gap in their range go to untouched gaps of the ranges before it, the
    nearest range and the smallest gap first.  Which piece gets which gap is settled by their
    ranks; a gap takes as many pieces of a range as surely fit.
5.  The gaps get their new sizes, those below the smallest piece left are closed, and the
    next round begins.  The first range is always placed whole, so the rounds end, and what
    fits in one range ends in one round: that is best fit by decreasing size.

Every round is a table in the shared folder.  The driver sees counts by range.  Ranges hold
about `range_rows` rows, so many pieces of one length are spread over ranges.

A null or empty text is one piece, the end id alone.  Rows with equal or null ids are
documents of their own.  A long text makes many full pieces and is encoded whole.  An empty
table gives no rows.  Only the id and text columns are read, so other columns may have any
name.  Piece numbers follow the rows of the piece table that is written first, so the result
stands for a run; another run may pack ties another way, into as many sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.rans import Encoder
from billweave.session import checkpoint

RANGE_ROWS = 250_000
_PLACED, _REST, _GAP, _LEFT, _RANGE = range(5)
_COUNTS = "n_gaps long, least_gap int, n_left long, most_left int, fresh long"
_SWEPT = f"kind int, part int, turn long, id long, seq long, size int, offset int, counts struct<{_COUNTS}>"


class Range(NamedTuple):
    """What a sweep left of its range: untouched gaps, pieces without a gap, and the next
    sequence number to open."""

    part: int
    n_gaps: int
    least_gap: int
    n_left: int
    most_left: int
    fresh: int


def cuts(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `length` tokens."""
    if length <= size:
        return [(0, length)]
    head = length % size
    return [(0, head)] * (head > 0) + [(at, size) for at in range(head, length, size)]


def pieces(
    docs: DataFrame,
    encoder: Callable[[], Encoder],
    size: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of every document, and with
    `keep_ids` their ids.  The end id is the last one of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for low in range(0, len(batch), 256):
                some = batch.slice(low, 256)
                owner, number, start, length, crc, held = [], [], [], [], [], []
                for row, ids in enumerate(encode([t or "" for t in some.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, (at, n) in enumerate(cuts(len(ids), size)):
                        own = ids[at : at + n]
                        owner.append(row)
                        number.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(own.tobytes()))
                        if keep_ids:
                            held.append(own.astype(np.int64))
                out = {
                    "doc_id": some.column("doc_id").take(pa.array(owner, pa.int32())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if keep_ids:
                    out["ids"] = pa.array(held, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


class Sweep:
    """Best fit over one range of gaps and pieces that come in the order of their size."""

    def __init__(self, size: int, fresh: int | None):
        self.size, self.fresh = size, fresh  # fresh: the next sequence to open, None: open none
        self.gaps: list[list[tuple]] = [[] for _ in range(size + 1)]
        self.open = 0  # bit r: a gap of r places is there
        self.placed: list[tuple] = []  # (id, seq, offset)
        self.left: list[tuple] = []  # (id, length), no gap

    def gap(self, seq: int, room: int, touched: bool = False) -> None:
        if room:
            self.gaps[room].append((seq, touched))
            self.open |= 1 << room

    def piece(self, key: int, length: int) -> None:
        fitting = self.open >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            seq = self.gaps[room].pop()[0]
            if not self.gaps[room]:
                self.open ^= 1 << room
        elif self.fresh is not None:
            room, seq = self.size, self.fresh
            self.fresh -= 1
        else:
            self.left.append((key, length))
            return
        self.placed.append((key, seq, self.size - room))
        self.gap(seq, room - length, True)

    def rows(self, part: int) -> pd.DataFrame:
        """All outcomes; pieces without a gap and untouched gaps have their rank as turn.  The
        last row counts the range."""
        out = [(_PLACED, part, 0, key, seq, 0, offset) for key, seq, offset in self.placed]
        turn = least = 0
        for room in range(self.size, 0, -1):
            for seq, touched in self.gaps[room]:
                if touched:
                    out.append((_REST, part, 0, 0, seq, room, 0))
                else:
                    out.append((_GAP, part, turn, 0, seq, room, 0))
                    turn, least = turn + 1, room
        out += [(_LEFT, part, k, key, 0, length, 0) for k, (key, length) in enumerate(self.left)]
        out.append((_RANGE, part, 0, 0, 0, 0, 0))
        names = ("kind", "part", "turn", "id", "seq", "size", "offset")
        frame = pd.DataFrame({n: np.array(c, np.int64) for n, c in zip(names, zip(*out))})
        counts = (turn, least, len(self.left), self.left[0][1] if self.left else 0, 0 if self.fresh is None else self.fresh)
        frame["counts"] = [None] * (len(out) - 1) + [dict(zip(Range._fields[1:], counts))]
        return frame


def _swept(gaps: DataFrame, left: DataFrame, size: int, parts: int, fresh: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        sweep = Sweep(size, fresh if part == 0 else None)
        for batch in batches:
            for is_piece, key, n in zip(batch["is_piece"].tolist(), batch["key"].tolist(), batch["size"].tolist()):
                if is_piece:
                    sweep.piece(key, n)
                else:
                    sweep.gap(key, n)
        yield sweep.rows(part)

    rows = gaps.select(F.col("seq").alias("key"), F.col("room").alias("size"), F.lit(False).alias("is_piece")).unionByName(
        left.select(F.col("id").alias("key"), F.col("length").alias("size"), F.lit(True).alias("is_piece"))
    )
    # equal sizes may fall into several ranges
    order = [F.col("size").desc(), F.col("is_piece").asc(), F.xxhash64("key").asc()]
    ranged = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    return ranged.sortWithinPartitions(*order).mapInPandas(run, _SWEPT)


def handed_out(ranges: list[Range]) -> list[tuple]:
    """Stretches of ranks for pieces that found no gap in their range.

    Ranges come in order, largest sizes first.  A stretch (part, first, last, gap_part, gap_turn, each) deals the
    pieces with the ranks first to last - 1 of part, `each` at a time, to the gaps gap_turn,
    gap_turn - 1 and so on of gap_part.  There are at most twice as many stretches as ranges.
    """
    stack: list[list] = []  # [part, gaps left, least gap], the nearest range on top
    out = []
    for r in ranges:
        done = 0
        while stack and done < r.n_left:
            part, n_gaps, least = stack[-1]
            each = least // r.most_left
            n = min(r.n_left - done, n_gaps * each)
            out.append((r.part, done, done + n, part, n_gaps - 1, each))
            done += n
            stack[-1][1] -= -(-n // each)
            if not stack[-1][1]:
                stack.pop()
        if r.n_gaps:
            stack.append([r.part, r.n_gaps, r.least_gap])
    return out


def pack(lengths: DataFrame, size: int = 2048, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, sequence_id, offset) for pieces (id, length) with distinct ids of 0 or more and
    lengths of 1 to `size`.  The ranges of a round hold about `range_rows` rows."""
    spark = lengths.sparkSession
    todo = checkpoint(lengths.select("id", F.col("length").cast("int").alias("length")))
    large = F.col("length") * 2 > size
    done = [todo.where(large).select("id", F.col("id").alias("sequence_id"), F.lit(0).alias("offset"))]
    gaps = todo.where(large).select(F.col("id").alias("seq"), (F.lit(size) - F.col("length")).alias("room"))
    left = todo.where(~large)
    fresh = -1  # opened sequences have negative numbers
    while True:
        need = left.agg(F.count(F.lit(1)), F.sum("length"), F.min("length")).head()
        if not need[0]:
            break
        gaps = gaps.where(F.col("room") >= need[2])
        have = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum("room"), F.lit(0))).head()
        opened = max(0, -(-(need[1] - have[1]) // size))
        if opened:
            new = spark.range(opened).select((F.lit(fresh) - F.col("id")).alias("seq"), F.lit(size).alias("room"))
            gaps, fresh = gaps.unionByName(new), fresh - opened
        parts = 1 + (need[0] + have[0] + opened) // range_rows
        swept = checkpoint(_swept(gaps, left, size, parts, fresh))
        ranges = [Range(*r) for r in swept.where(F.col("kind") == _RANGE).select("part", "counts.*").collect()]
        fresh = min([fresh, *(r.fresh for r in ranges)])
        done.append(swept.where(F.col("kind") == _PLACED).select("id", F.col("seq").alias("sequence_id"), "offset"))
        rest = swept.where(F.col("kind") == _REST).select("seq", F.col("size").alias("room"))
        aimed = _aimed(swept, handed_out(sorted(ranges)))
        dealt = checkpoint(_dealt(swept, aimed.where("gap_part is not null"), size))
        one = dealt.select("seq", F.explode("taken").alias("one"))
        done.append(one.select("one.id", F.col("seq").alias("sequence_id"), "one.offset"))
        gaps = rest.unionByName(dealt.select("seq", "room"))
        left = aimed.where("gap_part is null").select("id", "length")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _aimed(swept: DataFrame, stretches: list[tuple]) -> DataFrame:
    """(id, length, turn, gap_part, gap_turn) of the pieces without a gap in their range; the
    gap is null where no range before has one for them."""
    schema = "part int, first long, last long, gap_part int, gap_turn long, each int"
    # a stretch or two for each range: the size of the broadcast is that of the range counts
    plan = F.broadcast(swept.sparkSession.createDataFrame(stretches, schema)).alias("s")
    waiting = swept.where(F.col("kind") == _LEFT).select("part", "turn", "id", F.col("size").alias("length")).alias("w")
    mine = (F.col("w.part") == F.col("s.part")) & (F.col("turn") >= F.col("first")) & (F.col("turn") < F.col("last"))
    place = ((F.col("turn") - F.col("first")) / F.col("each")).cast("long")
    return waiting.join(plan, mine, "left").select(
        "id", "length", "turn", "gap_part", (F.col("gap_turn") - place).alias("gap_turn")
    )


def _dealt(swept: DataFrame, aimed: DataFrame, size: int) -> DataFrame:
    """(seq, room, taken) of the untouched gaps after the pieces aimed at them, with the (id,
    offset) of each.  A gap and its pieces meet in one aggregation."""
    none = F.lit(None).cast("struct<turn: long, id: long, length: int>")
    untouched = swept.where(F.col("kind") == _GAP).select(
        F.col("part").alias("gap_part"), F.col("turn").alias("gap_turn"), "seq", F.col("size").alias("room"), none.alias("one")
    )
    pieces = aimed.select(
        "gap_part", "gap_turn", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("room"),
        F.struct("turn", "id", "length").alias("one"),
    )
    met = untouched.unionByName(pieces).groupBy("gap_part", "gap_turn").agg(
        F.max("seq").alias("seq"),
        F.max("room").alias("was"),
        F.array_sort(F.collect_list("one")).alias("some"),  # at most size of them
    )

    def before(n):
        return F.aggregate(F.slice("some", F.lit(1), n), F.lit(0), lambda s, x: s + x["length"])

    offset = F.lit(size) - F.col("was")
    taken = F.transform("some", lambda x, k: F.struct(x["id"].alias("id"), (offset + before(k)).alias("offset")))
    return met.select("seq", (F.col("was") - before(F.size("some"))).alias("room"), taken.alias("taken"))


def packed(found: DataFrame, size: int = 2048, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of a piece table with their sequence_id and offset."""
    rows = checkpoint(found.withColumn("_piece", F.monotonically_increasing_id()))
    placed = pack(rows.select(F.col("_piece").alias("id"), "length"), size, range_rows)
    placed = placed.select(F.col("id").alias("_piece"), "sequence_id", F.col("offset").cast("long").alias("offset"))
    return rows.join(placed, "_piece").drop("_piece")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that kept their ids: the training sequences."""
    one = F.struct("offset", "ids")
    # a sequence has at most its size in tokens
    return packed_pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["ids"])).alias("ids")
    )
