"""License scan: an exact set-similarity join of text blocks with license notices.

A block is a window of words over the whole text, whatever its line breaks: twice as many as the
longest template has, in steps of half, so a notice always stands whole in some block.  Its
tokens are the distinct words (A-Z lower-cased).  A block matches a template when it holds at
least `threshold` of the template's distinct tokens.  Where templates of one block are nested,
the larger one counts: a notice of CC BY-NC 4.0 is none of CC BY 4.0.  Tokens are ordered by how many blocks of all documents hold them, rarest first.
Prefix filter: a match shares one of the first |T| - need + 1 template tokens, so only these
are joined by equality.  Length filter: the block needs `need` template tokens at least.
Positional filter: counted from the joined token on, enough tokens of the block must be
left.  What remains is verified on the whole sets.  Only tokens of any template can count,
so blocks carry just those.  Everything is DataFrame functions.

Base phrases are counted on the words of the whole text.  Null texts are empty.  Rows are
told apart by a row number, so repeated ids get a row each.  The blocks of a long text are an
array of its row.  An empty table gives no rows.  Blocks with equal matches count alike: labels
are distinct and the score is the largest.  Output columns are those documented; other columns
of the input are not read, so they may have any name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.session import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# notices as public licenses and their users word them, by label
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "Released under the MIT License"),
]
THRESHOLD = 0.9


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def block_step(templates) -> int:
    """Words from the start of a block to that of the next one, half the words of a block."""
    return max((len(re.findall("[0-9a-z]+", t.lower())) for _, t in templates), default=1)


def _places(words, phrase: str):
    """Starts (from 0) of the consecutive words of a phrase."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i):
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    return F.when(F.size(words) >= len(parts), F.filter(at, here))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    `matches` lists (label, block, containment) of the matching blocks; the score is the
    largest containment, or 1 where a base phrase stands.
    """
    step = block_step(templates or TEMPLATES)
    templates = [(label, template_tokens(t)) for label, t in (templates or TEMPLATES)]
    vocabulary = sorted({t for _, tokens in templates for t in tokens})
    known = F.array(*[F.lit(t) for t in vocabulary])

    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    words = docs.select(F.col(id_col), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("_words"))
    words = words.withColumn("_hint", F.array_contains("_words", "license"))
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step)))
    blocks = F.transform(
        starts, lambda at: F.array_intersect(F.slice("_words", at + 1, F.lit(2 * step)), known)
    )
    none = F.array().cast("array<int>")
    found = [
        F.coalesce(F.when(F.col("_hint"), _places(F.col("_words"), phrase)), none).alias(f"_at_{label}")
        for phrase, label in BASE
    ]
    scanned = words.select(
        F.col(id_col),
        F.size("_words").cast("long").alias("n_words"),
        *found,
        F.coalesce(blocks, F.array().cast("array<array<string>>")).alias("_blocks"),
    )
    scanned = checkpoint(scanned.withColumn("_row", F.monotonically_increasing_id()))

    # at most one row for each template token
    counts = scanned.select(F.explode(F.flatten("_blocks")).alias("t")).groupBy("t").count().collect()
    held = {r["t"]: r["count"] for r in counts}
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (held.get(t, 0), t)))}
    ranks = F.create_map(*[F.lit(x) for item in order.items() for x in item])

    prefixes, smallest, rare = [], min((len(t) for _, t in templates), default=0), set()
    for no, (label, tokens) in enumerate(templates):
        need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        smallest = min(smallest, need)
        ordered = sorted(tokens, key=order.get)
        whole = F.array(*[F.lit(order[t]) for t in ordered])
        for t in ordered[: len(ordered) - need + 1]:
            rare.add(t)
            named = {"rank": order[t], "no": no, "label": label, "need": need}
            prefixes.append(F.struct(*[F.lit(x).alias(n) for n, x in named.items()], whole.alias("whole")))
    # a few rows for each template: the size of the broadcast is that of the parameter
    index = docs.sparkSession.range(1).select(F.inline(F.array(*prefixes)))
    blocks = (
        scanned.select("_row", F.posexplode("_blocks").alias("block", "_tokens"))
        .where((F.size("_tokens") >= smallest) & F.arrays_overlap("_tokens", F.array(*map(F.lit, sorted(rare)))))
        .select("_row", "block", F.array_sort(F.transform("_tokens", lambda t: F.element_at(ranks, t))).alias("held"))
    )
    candidates = (
        blocks.select("_row", "block", "held", F.posexplode("held").alias("place", "rank"))
        .join(F.broadcast(index), "rank")
        .where((F.size("held") >= F.col("need")) & (F.size("held") - F.col("place") >= F.col("need")))
    )
    shared = F.size(F.array_intersect("held", "whole"))
    # templates that hold all tokens of a template and more
    larger = F.array(
        *[F.array(*[F.lit(k) for k, (_, o) in enumerate(templates) if set(t) < set(o)]).cast("array<int>") for _, t in templates]
    )
    one = F.struct("label", "block", (shared / F.size("whole")).alias("containment"), "no")
    of_block = (
        candidates.where(shared >= F.col("need"))
        .groupBy("_row", "block")
        .agg(F.collect_set(one).alias("_some"))  # at most one for each template
    )
    numbers = F.transform("_some", lambda m: m["no"])
    kept = F.filter("_some", lambda m: ~F.arrays_overlap(F.get(larger, m["no"]), numbers))
    matches = (
        of_block.select("_row", F.explode(kept).alias("m"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.struct("m.label", "m.block", "m.containment"))).alias("matches"))
    )
    at = F.flatten(F.array(*[F.col(f"_at_{label}") for _, label in BASE]))
    base = F.array_compact(
        F.array(*[F.when(F.size(f"_at_{label}") > 0, F.lit(label)) for label in sorted(x for _, x in BASE)])
    )
    out = scanned.join(matches, "_row", "left")
    found_labels = F.coalesce(F.transform("matches", lambda m: m["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return out.select(
        F.col(id_col),
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found_labels)), ",").alias("labels"),
        F.when(F.size(at) > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "matches",
    )


def oracle() -> str:
    """The scan in DuckDB SQL, by comparing every block with every template."""
    rows = ", ".join(f"({no}, '{label}', {template_tokens(t)!r})" for no, (label, t) in enumerate(TEMPLATES))
    step = block_step(TEMPLATES)
    spots = [
        f"list_filter(range(0, greatest(len(w) - {len(p.split()) - 1}, 0)), lambda i: "
        + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        + f") as at_{label}"
        for p, label in BASE
    ]
    names = sorted(label for _, label in BASE)
    base = "list_filter([" + ", ".join(f"case when len(at_{x}) > 0 then '{x}' end" for x in names) + "], lambda x: x is not null)"
    everywhere = "list_concat(at_mit, list_concat(at_apache, at_gpl))"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
with lowered as (
  select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents
), places as (
  select r, doc_id, w, {", ".join(spots)}
  from (select r, doc_id, regexp_extract_all(t, '{word}') as w from lowered)
), blocks as (
  select r, k, list_distinct(list_slice(w, k + 1, k + {2 * step})) as b
  from (select r, w, unnest(range(0, len(w), {step})) as k from places)
), templates(no, label, tokens) as (values {rows}), met as (
  select r, k, no, label, tokens, c
  from (select r, k, no, label, tokens, len(list_intersect(b, tokens))::double / len(tokens) as c,
               len(list_intersect(b, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9) as ok
        from blocks, templates)
  where ok
), matches as (
  select r, list(distinct label) as found, max(c) as best from met m
  where not exists (select 1 from met o where o.r = m.r and o.k = m.k and len(o.tokens) > len(m.tokens) and list_has_all(o.tokens, m.tokens))
  group by r
)
select doc_id, len(w)::bigint as n_words, len({everywhere})::bigint as n_base,
  list_min({everywhere})::bigint as first_word, list_max({everywhere})::bigint as last_word,
  array_to_string({base}, ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(found, [])))), ',') as labels,
  case when len({everywhere}) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from places left join matches using (r)
"""
