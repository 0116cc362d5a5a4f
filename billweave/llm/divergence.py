"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are runs of letters: ASCII letters, A-Z as a-z, and all non-ASCII characters.  A task
works on the Arrow buffers of its texts.  The start of every term is a pointer into the
buffer; the pointers of a slice are sorted by the terms that begin there with a multikey
quicksort whose characters are eight bytes wide: sort by the first eight bytes, keep the runs
of equal ones, sort inside the runs whose terms go on by the next eight, and so on.  What is
left in a run of equal terms gives the occurrences and the documents by source.  Spark
adds these up over all slices.

  kept terms   of a language: those in at least `min_docs` of its documents; there are V
  p            of a (language, source) group or a whole language, for each kept term:
               1 + floor(scale * (count + 1) / (N + V)), N the occurrences of kept terms there
  f            floor((p - q) ** 2 / q), p of the group

All arithmetic is in integers or decimals, so it is exact.  The pairs of sources are summed
in shards of terms: a shard is a table of terms by sources whose cells are filled with the p
of absent terms, and gives one partial sum for each pair of sources.  Languages with more
terms have more shards.  A sum fits a long, since the p of a group sum up to scale + V.

Null texts, languages and sources count as ''.  Every row is a document, so rows with equal
ids count each for itself.  A language without kept terms gives its pairs with value 0, a
language with one source no pair.  A text is held whole, with some ten numbers for each of
its terms; terms of any length are compared whole.  An empty table gives no rows.  Only the
columns lang, source and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.operators.dedup import join_hot
from billweave.session import checkpoint

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
SLICE_BYTES = 6 << 20  # text of a slice, about
SHARD_ROWS = 200_000  # (term, source) rows in a shard, about
_CELLS = 1 << 19  # cells of a table of terms by sources
_WIDTH, _LEVELS = 8, 32  # bytes of a sorting character; characters before the rest is compared whole

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
# the bytes of a character that belong to a term with 0 to 8 bytes left
_MASK = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(_WIDTH + 1)], np.uint64)


def sorted_runs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): pointers in the order of their terms, and the number of the run of equal
    terms that each place of that order belongs to.

    `buffer` has eight more bytes than its text."""
    characters = np.ndarray((len(buffer) - _WIDTH + 1,), ">u8", buffer=buffer, strides=(1,))

    def character(pointers: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(ends[pointers] - starts[pointers] - depth, 0, _WIDTH)
        at = np.where(left > 0, starts[pointers] + depth, 0)
        return characters[at].astype(np.uint64) & _MASK[left]

    lengths = ends - starts
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    new[:1] = True
    live = np.arange(len(starts))  # places of runs that still have to be sorted
    for level in range(_LEVELS):
        if not len(live):
            break
        slices = np.cumsum(new)[live]
        keys = character(order[live], _WIDTH * level)
        # the first slice is everything; later ones are kept apart by their number
        turn = np.argsort(keys) if level == 0 else np.lexsort((keys, slices))
        order[live] = order[live][turn]
        keys = keys[turn]
        new[live[1:]] |= (keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])
        live = _unfinished(order, new, live, lengths, _WIDTH * (level + 1))
    if len(live):
        # terms equal in their first 256 bytes: the runs that are left are compared directly
        slices = np.cumsum(new)[live]
        rest = [bytes(buffer[starts[p] : ends[p]]) for p in order[live]]
        turn = np.array(sorted(range(len(live)), key=lambda k: (slices[k], rest[k])))
        order[live] = order[live][turn]
        rest = [rest[k] for k in turn]
        new[live[1:]] |= np.fromiter((a != b for a, b in zip(rest[1:], rest)), bool, len(rest) - 1)
        new[live[1:]] |= slices[1:] != slices[:-1]
    return order, np.cumsum(new) - 1


def _unfinished(order: np.ndarray, new: np.ndarray, live: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The places, among `live`, of runs of two or more with a term longer than `depth`."""
    run = np.cumsum(new)[live]
    run -= run[:1]
    longer = np.bincount(run, lengths[order[live]] > depth) > 0
    return live[longer[run] & (np.bincount(run)[run] > 1)]


def count_slice(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, ...]:
    """(term, group, occurrences, documents) of the documents data[offsets[i]:offsets[i + 1]]
    with the group numbers `groups`."""
    buffer = np.zeros(len(data) + _WIDTH, np.uint8)
    np.take(_FOLDED, data, out=buffer[: len(data)])
    letter = _LETTER[data]
    # documents lie side by side in the buffer, so a term also ends where its document ends
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = edges[0] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edges[:-1]))
    ends = np.flatnonzero(letter & (~after | edges[1:])) + 1
    order, run = sorted_runs(buffer, starts, ends)
    # documents numbered in the order of their groups, so that runs fall apart by group as well
    by_group = np.argsort(groups, kind="stable")
    number = np.empty_like(by_group)
    number[by_group] = np.arange(len(by_group))
    owner = number[np.searchsorted(offsets, starts, "right") - 1]
    keys = np.sort(run * len(groups) + owner[order])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    times = np.diff(np.append(first, len(keys)))
    term, doc = keys[first] // len(groups), keys[first] % len(groups)
    group = groups[by_group][doc]
    change = np.append(True, (term[1:] != term[:-1]) | (group[1:] != group[:-1]))[: len(term)]
    cells = np.flatnonzero(change)
    occurrences = np.add.reduceat(times, cells) if len(cells) else times
    documents = np.diff(np.append(cells, len(term)))
    heads = order[np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])]
    return _gather(buffer, starts[heads], ends[heads]).take(pa.array(term[cells])), group[cells], occurrences, documents


def _gather(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings buffer[starts[i]:ends[i]]."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(buffer[at]))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of the batches (lang, source, text)."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        langs, sources = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
        width = max(1, len(sources.dictionary))
        groups = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
        low = 0
        while low < len(text):
            # as many documents as fit, at least one
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
            own = offsets[low : high + 1]
            term, group, n, docs = count_slice(data[own[0] : own[-1]], own - own[0], groups[low:high])
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(group // width)).cast(pa.string()),
                    sources.dictionary.take(pa.array(group % width)).cast(pa.string()),
                    term.cast(pa.string()),
                    pa.array(n, pa.int64()),
                    pa.array(docs, pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
            low = high


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    slices = texts.mapInArrow(count_batches, "lang string, source string, term string, n long, docs long")
    return slices.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, scale: int = SCALE) -> Column:
    """p of a term that occurs `count` times among `total` occurrences of `terms` kept terms."""
    wide = (count + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return (F.call_function("div", wide, (total + terms).cast("decimal(19,0)")) + 1).cast("long")


def pair_sums(sources: np.ndarray, absent: np.ndarray, term: np.ndarray, source: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of f over the terms of a shard, by source and other source.

    `absent` has the p of absent terms by source; (term, source, p) are the terms that occur,
    terms and sources numbered."""
    n_sources = len(sources)
    sums = np.zeros((n_sources, n_sources), np.int64)
    n_terms = int(term.max()) + 1 if len(term) else 0
    step = max(1, _CELLS // max(1, n_sources))
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], source[order], p[order]
    for low in range(0, n_terms, step):
        a, b = np.searchsorted(term, [low, low + step])
        table = np.tile(absent[:, None], min(step, n_terms - low))
        table[source[a:b], term[a:b] - low] = p[a:b]
        for s in range(n_sources):
            d = table[s] - table
            sums[s] += (d * d // table).sum(axis=1)
    return sums


def _shard(key: tuple, table: pa.Table) -> pa.Table:
    """One shard: rows without a term are the sources with the p of absent terms."""
    heads = table.filter(pc.is_null(table.column("term")))
    names = heads.column("source").to_numpy(zero_copy_only=False)
    # a language without kept terms has no p at all, and nothing is divided by it then
    absent = pc.fill_null(heads.column("p"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = table.filter(pc.is_valid(table.column("term")))
    place = pc.index_in(rows.column("source"), value_set=heads.column("source").combine_chunks())
    term = pc.dictionary_encode(rows.column("term").combine_chunks())
    indices = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices
    sums = pair_sums(
        names,
        absent,
        indices.to_numpy().astype(np.int64),
        place.to_numpy(zero_copy_only=False).astype(np.int64),
        rows.column("p").to_numpy(zero_copy_only=False).astype(np.int64),
    )
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(a), pa.string()),
            "source": pa.array(names[a], pa.string()),
            "item": pa.array(names[b], pa.string()),
            "value": pa.array(sums[a, b], pa.int64()),
        }
    )


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, scale: int = SCALE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Part `pair`: the other sources of the language by the sum of f over all kept terms.  Part
    `term`: the `top` terms that the group has more of than the language, by f against the
    language.  Ranks go by value, largest first, then by item.
    """
    counts = checkpoint(term_counts(docs))
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("in_docs"))
    kept = by_term.where(F.col("in_docs") >= min_docs).select("lang", "term", "n_lang")
    present = checkpoint(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    # one row per group: as many as the result has blocks
    per_group = present.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_rows"))
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    zero = F.lit(0).cast("long")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "n_rows", "terms", "total_lang")]
    )
    rows_of_lang = F.sum("n_rows").over(Window.partitionBy("lang"))
    shards = (F.floor(rows_of_lang / SHARD_ROWS) + 1).cast("int")
    # the key of a group in one column, so that hot groups can be salted
    groups = checkpoint(groups.withColumn("shards", shards).withColumn("key", F.struct("lang", "source")))
    facts = groups.select("key", "n_rows", "total", "terms", "total_lang", "shards")
    rows = join_hot(present.withColumn("key", F.struct("lang", "source")), facts, "key")
    p = share(F.col("n"), F.col("total"), F.col("terms"), scale)
    rows = rows.select("lang", "source", "term", "n_lang", "terms", "total_lang", "shards", p.alias("p"))

    q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms"), scale)
    gain = F.col("p") - F.col("q")
    value = F.call_function("div", gain * gain, F.col("q"))
    told = rows.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q")
    terms = _ranked(told.select("lang", "source", "item", value.alias("value"))).where(F.col("rank") <= top)

    nothing = F.lit(None).cast("string")
    absent = F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"), scale))
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", nothing.alias("term"),
        absent.alias("p"),
    )
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    dealt = rows.select("lang", shard.alias("shard"), "source", "term", "p").unionByName(heads)
    sums = dealt.groupBy("lang", "shard").applyInArrow(_shard, "lang string, source string, item string, value long")
    pairs = _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns)
    )


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def oracle() -> str:
    """The audit in DuckDB SQL, with every kept term joined to every source."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), '{upper}', '{lower}') as t from documents
), words as (
  select r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) as term from docs
), kept as (
  select lang, term, count(*) as n from words group by lang, term having count(distinct r) >= 3
), lang_total as (
  select lang, sum(n)::hugeint as n, count(*) as v from kept group by lang
), counts as (
  select w.lang, w.source, w.term, count(*) as n from words w join kept using (lang, term) group by all
), groups as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n
  from (select distinct lang, source from docs) g left join counts c on c.lang = g.lang and c.source = g.source
  group by all
), shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + t.v) as p,
    1 + (1000000000::hugeint * (k.n + 1)) // (t.n + t.v) as q
  from groups g join kept k on k.lang = g.lang join lang_total t on t.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from shares where n > 0 and p > q
), ranked as (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (
    select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from terms
  ) where rank <= 200
)
select lang, source, part, item, value, rank::int as rank from ranked
"""
