"""De-duplication and consolidation of documents.

Groups of copies may be huge (one digest can hold a third of all rows), so no operator
collects a group: the first of a group is a min() with map-side combining, and going back
from the group to its rows is a join whose heavy keys are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as tx
from ..sources.scan import outside_folders
from ..session import checkpoint

# A key is heavy when it holds at least this share of all rows; so there are at most
# 1 / HEAVY_SHARE heavy keys, which bounds what is broadcast.
HEAVY_SHARE = 1 / 100
SALTS = 64


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key that knows its size (column n_rows).

    The per-key table is computed once and written; the search for heavy keys then reads
    little more than the statistics of its files.  Rows of heavy keys are spread over SALTS partitions and their single per-key row is
    repeated for each salt; all other keys join plainly.  The result drops n_rows.
    """
    per_key = checkpoint(per_key)
    total = per_key.agg(F.sum("n_rows")).scalar()
    heavy = per_key.where(F.col("n_rows") >= total * HEAVY_SHARE).select(
        F.col(key).alias("_heavy")
    )
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int")
    salted = marked.withColumn(
        "_salt", F.when(F.col("_heavy").isNotNull(), spread).otherwise(0)
    ).drop("_heavy")
    salts = F.when(
        F.col("n_rows") >= total * HEAVY_SHARE, F.sequence(F.lit(0), F.lit(SALTS - 1))
    ).otherwise(F.array(F.lit(0)))
    repeated = per_key.withColumn("_salt", F.explode(salts)).drop("n_rows")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def first_of_group(rows: DataFrame, key: str, order: str, name: str = "kept") -> DataFrame:
    """One row per key: the first value of `order` and the number of rows."""
    return rows.groupBy(key).agg(F.min(order).alias(name), F.count(F.lit(1)).alias("n_rows"))


def index_documents(docs: DataFrame, keys=("digest", "stem", "fingerprint")) -> DataFrame:
    """docs(path, content, pages) -> path and the wanted keys.

    The bodies are read and hashed once; the small index is written and used from there.
    """
    have = set(docs.columns)
    rest = [c for c in docs.columns if c not in ("content", "pages")]
    made = {
        "digest": tx.content_hash(F.col("content")),
        "stem": tx.stem_key(F.col("path")),
        "fingerprint": tx.fingerprint(F.col("pages") if "pages" in have else F.array("content")),
    }
    return checkpoint(docs.select(*rest, *[made[k].alias(k) for k in keys]))


def corpus_indexes(docs: DataFrame) -> DataFrame:
    """index, key, path, files: the three indexes of an existing corpus.

    docs(path, content, pages).  Each index has the first path of every content hash, name
    stem and text, and how many files have that key.  The hash index passes over fewer
    folders than the others.  Files without a text have one entry with a NULL key.
    """
    listed = index_documents(docs)
    kinds = {"hash": ("digest", R.SKIP_DIRS_HASH_INDEX), "stem": ("stem", R.SKIP_DIRS), "text": ("fingerprint", R.SKIP_DIRS)}
    keys = F.array_compact(
        F.array(
            *[
                F.when(outside_folders(F.col("path"), skipped), F.struct(F.lit(kind).alias("index"), F.col(key).alias("key")))
                for kind, (key, skipped) in kinds.items()
            ]
        )
    )
    entries = listed.select("path", F.inline(keys))
    return entries.groupBy("index", "key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("files"))


def exact_duplicates(index: DataFrame) -> DataFrame:
    """path, kept_path of every document whose content was seen before in path order."""
    repeated = first_of_group(index, "digest", "path", "kept_path").where("n_rows > 1")
    pairs = join_hot(index.select("path", "digest"), repeated, "digest")
    return pairs.where("path <> kept_path").select("path", "kept_path")


def keep_first(index: DataFrame, key: str = "digest", order: str = "path") -> DataFrame:
    """The kept row of each group, whole rows, without a window over the group.

    Rows without a key (unreadable documents) are in no group.
    """
    rest = [c for c in index.columns if c not in (key, order)]
    best = index.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r"))
    return best.select(F.col(key), F.col("r.*")).select(*index.columns)


def greedy_keep(
    rows: DataFrame, keys=("digest", "stem", "fingerprint"), order: str = "path"
) -> DataFrame:
    """Sequential first-seen de-duplication on several keys, as a set of rounds.

    In order, a row is dropped when one of its keys belongs to a row kept before it; dropped
    rows register nothing, NULL keys match nothing.  What is kept is the lexicographically
    first set of rows that share no key.  Rows equal in all keys are first reduced to their
    first one.  Each round keeps every undecided row that is first in all of its key groups
    and drops the rows that share a key with those; the first undecided row always wins, so
    the rounds end.  Returns the kept values of `order`.
    """
    tagged = [F.concat(F.lit(f"{i}:"), F.col(k)) for i, k in enumerate(keys)]
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("ord"))
    undecided = checkpoint(
        firsts.select("ord", F.explode(F.array_compact(F.array(*tagged))).alias("key"))
    )
    kept = firsts.where(F.coalesce(*tagged).isNull()).select("ord")
    while not undecided.isEmpty():
        groups = first_of_group(undecided, "key", "ord", "first")
        ballots = join_hot(undecided, groups, "key")
        winners = checkpoint(
            ballots.groupBy("ord")
            .agg(F.bool_and(F.col("ord") == F.col("first")).alias("wins"))
            .where("wins")
            .select("ord")
        )
        kept = kept.unionByName(winners)
        # a key is taken when the first of its group won; all keys are there with their sizes
        won = groups.join(winners, F.col("first") == F.col("ord"), "left")
        taken = won.select("key", "n_rows", F.col("ord").isNotNull().alias("taken"))
        hit = join_hot(undecided, taken, "key").where("taken").select("ord").distinct()
        undecided = checkpoint(undecided.join(hit, "ord", "left_anti"))
    return kept.withColumnRenamed("ord", order)


def ordered_keep(pairs: DataFrame) -> DataFrame:
    """Sequential keeping where checking a key and registering it are two things.

    pairs(ord, key, checks, registers), one row for each key of a row.  In order, a row is
    dropped when a key that it checks was registered by a row kept before it; a kept row then
    registers its own keys.  Each round decides every row whose checked keys depend on no
    undecided row before it: it is dropped when one of them is taken, else kept.  The first
    undecided row depends on nothing, so the rounds end; their number is the length of the
    longest chain of rows that depend on each other.  Returns the kept values of `ord`.
    """
    undecided = checkpoint(pairs.select("ord", "key", "checks", "registers"))
    bare = undecided.groupBy("ord").agg(F.bool_or("checks").alias("checks")).where("not checks").select("ord")
    kept = bare
    taken = checkpoint(_registered(undecided, bare))
    while not undecided.isEmpty():
        groups = undecided.groupBy("key").agg(
            F.min(F.when(F.col("registers"), F.col("ord"))).alias("first"), F.count(F.lit(1)).alias("n_rows")
        )
        groups = groups.join(taken, "key", "left")
        ballots = join_hot(undecided.where("checks"), groups, "key")
        free = F.coalesce(F.col("holder") >= F.col("ord"), F.lit(True))
        decided = checkpoint(
            ballots.groupBy("ord")
            .agg(
                F.bool_and(free).alias("free"),
                F.bool_and(F.coalesce(F.col("first") >= F.col("ord"), F.lit(True))).alias("ready"),
            )
            .where("ready or not free")
            .select("ord", "free")
        )
        winners = decided.where("free").select("ord")
        kept = kept.unionByName(winners)
        more = taken.unionByName(_registered(undecided, winners))
        taken = checkpoint(more.groupBy("key").agg(F.min("holder").alias("holder")))
        undecided = checkpoint(undecided.join(decided, "ord", "left_anti").join(bare, "ord", "left_anti"))
    return kept


def _registered(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """key, holder: the first kept row that registers a key."""
    held = pairs.where("registers").join(kept, "ord", "left_semi")
    return held.groupBy("key").agg(F.min("ord").alias("holder"))


def dedupe_documents(index: DataFrame) -> DataFrame:
    """path, kept of the three-key de-duplication of a corpus.

    Unreadable documents (NULL digest) register no key and are not kept.
    """
    kept = greedy_keep(index.where("digest is not null")).withColumn("kept", F.lit(True))
    return index.select("path").join(kept, "path", "left").select(
        "path", F.coalesce("kept", F.lit(False)).alias("kept")
    )


def dedupe_stats(index: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scanned, kept, moved, removed and errors (unreadable content)."""
    return (
        index.select("path", F.col("digest").isNull().alias("bad"))
        .join(verdicts, "path", "left")
        .agg(
            F.count(F.lit(1)).alias("scanned"),
            F.count_if(F.col("kept") & ~F.col("bad")).alias("kept"),
            F.count_if(~F.col("kept") & ~F.col("bad")).alias("moved"),
            F.count_if(~F.col("kept") & ~F.col("bad")).alias("removed"),
            F.count_if("bad").alias("errors"),
            F.lit("hash+stem+text").alias("dedup_by"),
        )
    )


def consolidate(sources: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Documents to copy into the consolidated corpus: one per new digest.

    sources(source_rank, path, digest, …) in list order; existing(digest) is the corpus.
    A rerun against its own result copies nothing.
    """
    rest = [c for c in sources.columns if c not in ("source_rank", "path", "digest")]
    fresh = sources.where("digest is not null")  # unreadable documents are not copied
    first = fresh.groupBy("digest").agg(F.min(F.struct("source_rank", "path", *rest)).alias("r"))
    if existing is not None:
        # one row per digest on both sides: no key can be hot
        first = first.join(existing.select("digest").distinct(), "digest", "left_anti")
    return first.select("digest", "r.*")


def consolidation_stats(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """copied, duplicates, sources, existing; repeats are counted, never materialised."""
    per_digest = sources.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    known = existing.where("digest is not null").select("digest").distinct().withColumn("known", F.lit(True))
    counted = per_digest.join(known, "digest", "left").agg(
        F.count_if(F.col("known").isNull()).alias("copied"),
        F.sum(F.when(F.col("known").isNull(), F.col("n") - 1).otherwise(F.col("n"))).alias(
            "duplicates"
        ),
    )
    return counted.select(
        "copied",
        F.coalesce("duplicates", F.lit(0)).cast("bigint").alias("duplicates"),
        sources.agg(F.countDistinct("source_rank")).scalar().alias("sources"),
        known.agg(F.count(F.lit(1))).scalar().alias("existing"),
    )


def lookup_duplicates(
    candidates: DataFrame, corpus: DataFrame, key: str, keep: str = "first"
) -> DataFrame:
    """candidates with duplicate_of: the corpus path with the same key, NULL keys never match.

    The corpus is reduced to one path per key (first or last in path order) before the
    join, so a candidate never multiplies; hot candidate keys are salted.
    """
    pick = F.min if keep == "first" else F.max
    index = corpus.where(F.col(key).isNotNull()).groupBy(key).agg(pick("path").alias("duplicate_of"))
    keyed = candidates.where(F.col(key).isNotNull())
    # sizes of all candidate keys, so that hot keys without a partner are salted as well
    sizes = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    found = join_hot(keyed, sizes.join(index, key, "left"), key, "left")
    bare = candidates.where(F.col(key).isNull()).withColumn("duplicate_of", F.lit(None).cast("string"))
    return found.unionByName(bare)


def skip_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the known ones; rows without a key stay.

    Heavy keys (at most 1 / HEAVY_SHARE of them) are looked up once each, and their rows kept
    or dropped where they are, without a shuffle; only the other rows meet the known keys.
    """
    sizes = checkpoint(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")))
    known = known.select(key).distinct()
    total = sizes.agg(F.sum("n_rows")).scalar()
    heavy = sizes.where(F.col("n_rows") >= total * HEAVY_SHARE).select(key)
    fresh = heavy.join(known, key, "left_anti")
    heavy, fresh = checkpoint(heavy), checkpoint(fresh)
    light = rows.join(F.broadcast(heavy), key, "left_anti").join(known, key, "left_anti")
    return light.unionByName(rows.join(F.broadcast(fresh), key, "left_semi"))


# Numbers of one name that a task looks at together.
NUMBER_RANGE = 1 << 16


def unique_names(
    files: DataFrame, existing: DataFrame | None = None, tag: str | None = None
) -> DataFrame:
    """Collision-free output names: stem[__tag].ext, then __2, __3 ...

    files(directory, path, name).  Files that want the same name are numbered in the order
    of md5(path), skipping numbers the directory uses already.
    """
    wanted = files.withColumn(
        "wanted",
        tx.tagged_name(F.col("name"), F.col(tag))
        if tag
        else _with_extension(tx.sanitize_filename(F.col("name"))),
    )
    stem, ext = tx.file_stem(F.col("wanted")), tx.file_extension(F.col("wanted"))
    ranked = ranked_by_digest(wanted, ["directory", "wanted"], "path").withColumn("rank", F.col("rank").cast("long"))
    if existing is None:
        numbered = ranked.withColumn("number", F.col("rank"))
    else:
        numbered = free_numbers(ranked, used_numbers(existing), ["directory", "wanted"])
    return numbered.select(
        *files.columns,
        F.when(F.col("number") == 1, F.col("wanted"))
        .otherwise(F.concat(stem, F.lit("__"), F.col("number").cast("string"), ext))
        .alias("output_name"),
    )


def used_numbers(existing: DataFrame) -> DataFrame:
    """directory, wanted, n: the numbers in use; the plain name counts as number 1."""
    digits = F.regexp_extract(tx.file_stem(F.col("name")), r"__(\d+)\z", 1)
    return existing.select(
        "directory",
        _base_name(F.col("name")).alias("wanted"),
        F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(1)).alias("n"),
    ).where("n >= 1").distinct()


def _carried(rows: DataFrame, keys: list[str], value: Column, order: list[Column], how, include: int) -> Column:
    """A running aggregate over the rows of a group, in the order of `place` and `order`.

    rows has a `place` number; a window sees one range of places, and what the ranges before
    come to is added from a table with one row per range.  Returns rows with `local` and
    `before`."""
    ranged = rows.withColumn("_range", F.floor(F.col("place") / NUMBER_RANGE))
    inside = W.partitionBy(*keys, "_range").orderBy("place", *order).rowsBetween(W.unboundedPreceding, include)
    ranges = ranged.groupBy(*keys, "_range").agg(how(value).alias("_all"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = ranges.select(*keys, "_range", F.coalesce(how("_all").over(earlier), F.lit(0)).alias("before"))
    local = ranged.withColumn("local", F.coalesce(how(value).over(inside), F.lit(0)))
    return local.join(before, [*keys, "_range"]).drop("_range")


def free_numbers(ranked: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """ranked(keys, rank) with the number of each rank: the rank-th one that is not used.

    used(keys, n).  The j-th used number has n - j free ones below it.  So the rank-th free
    number lies above those used numbers with n - j < rank, and is rank plus their count: the
    last j among them, found by an as-of search along rank and n - j.
    """
    place = used.withColumn("place", F.col("n"))
    counted = _carried(place, keys, F.lit(1), [], F.sum, 0)
    skipped = counted.withColumn("j", (F.col("local") + F.col("before")).cast("long"))
    # a run of used numbers has one value of n - j: its last number counts
    steps = skipped.groupBy(*keys, (F.col("n") - F.col("j")).alias("place")).agg(F.max("j").alias("j"))
    wanted = ranked.select(F.col("rank").alias("place"), F.struct(*ranked.columns).alias("file"), *keys)
    none = F.lit(None).cast(wanted.schema["file"].dataType)
    # names that nobody wants are left out; files come before steps at their place
    steps = steps.join(ranked.select(*keys).distinct(), keys, "left_semi")
    both = wanted.withColumn("j", F.lit(None).cast("long")).unionByName(steps.withColumn("file", none))
    found = _carried(both, keys, F.col("j"), [F.col("file").isNull().asc()], F.max, 0)
    found = found.where("file is not null").withColumn("skip", F.greatest("local", "before"))
    return found.select("file.*", "skip").withColumn("number", F.col("rank") + F.col("skip")).drop("skip")


def _with_extension(name: Column) -> Column:
    return F.when(tx.file_extension(name) == "", F.concat(name, F.lit(".pdf"))).otherwise(name)


def _base_name(name: Column) -> Column:
    return F.concat(
        F.regexp_replace(tx.file_stem(name), r"__\d+\z", ""), tx.file_extension(name)
    )


def ranked_by_digest(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """1-based rank within a group in the order of md5(column).

    No task sees a whole group: a group is cut into ranges by the leading digits of the
    digest, as many as the largest group needs, ranked inside a range, and the counts of the
    ranges before are added.
    """
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    # 16 ** digits ranges of the largest group hold some NUMBER_RANGE rows each
    digits = F.coalesce(F.greatest(F.lit(1), F.ceil(F.log(16.0, largest / NUMBER_RANGE))), F.lit(1)).cast("int")
    ranged = rows.withColumn("_order", F.md5(column)).withColumn("_range", F.left("_order", digits))
    local = ranged.withColumn(
        "_local", F.row_number().over(W.partitionBy(*keys, "_range").orderBy("_order"))
    )
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        local.join(before, [*keys, "_range"])
        .withColumn("rank", (F.col("_local") + F.col("_before")).cast("int"))
        .drop("_order", "_range", "_local", "_before")
    )
