"""Fill-in-the-middle texts by repeated-capture matching.

One full match of (unit)* against a text keeps every repetition of its group, so the ends of
the group are the ends of all units: their number is n, and the two cuts of a document are
two of them.  A unit is a word with the white space before it, or white space at the end.

The cuts and the form of a document follow from hashes of its id, so reruns agree:

  h1 to h4   the first four groups of 8 hex digits of sha256("<seed>:<id>"), a null id as ''
  prefix     the units before the smaller of h1 and h2 modulo n + 1
  middle     from there up to the larger one; the suffix is the rest
  form       plain if the text is empty, holds a marker or h3 % 100 >= changed;
             else spm if h4 % 100 < suffix_first, else psm

A text is a row of its own whatever its id, so rows with equal ids are cut at the same h1 and
h2.  Null and empty texts are plain with n = 0.  A text that is one word, or all white space,
is one unit.  Long texts are matched whole, one at a time: an integer for each unit of one
text is held.  An empty table gives no rows.  Only the id and text columns are read, so
other columns may have any name.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_UNITS = regex.compile(f"({UNIT})*")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKER = "<[PSM]>"


def cut(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle); ends are code points."""
    ends = _UNITS.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def _cuts(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cut(*row) for row in zip(texts, h1, h2)], columns=["n", "first", "second"], dtype="int64")


def transform(
    docs: DataFrame,
    seed: int = 42,
    changed: int = 50,
    suffix_first: int = 80,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: (id, n, form, prefix_chars, middle_chars, output).

    Of 100 documents about `changed` are rearranged, of 100 of those `suffix_first` into the
    form with the suffix first.  The lengths are null for plain ones.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), digest.alias("d")
    )
    cuts = F.pandas_udf(_cuts, "n long, first long, second long")
    h = [F.conv(F.substring("d", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    plain = (F.col("t") == "") | F.col("t").rlike(_MARKER) | (h[2] % 100 >= changed)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("id", "t", form.alias("form"), cuts("t", h[0], h[1]).alias("c"))
    first, second = F.col("c.first"), F.col("c.second")
    prefix = F.substring("t", F.lit(1), first.cast("int"))
    middle = F.substring("t", (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring("t", (second + 1).cast("int"), F.length("t"))
    output = (
        F.when(F.col("form") == "plain", F.col("t"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias(id_col),
        F.col("c.n").alias("n"),
        "form",
        F.when(moved, first).alias("prefix_chars"),
        F.when(moved, second - first).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that a rearranged one was made of.

    No marker can arise where parts meet, because none begins with the end of another, so
    the three markers of an output are the ones that were put in.
    """
    parts = F.split(output, _MARKER, -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle() -> str:
    """The digests of all outputs in DuckDB SQL, by slices of the list of all units."""
    return f"""
with hashed as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as d from documents
), cut as (
  select doc_id, t, u, len(u) as n,
    ('0x' || d[1:8])::bigint % (len(u) + 1) as x, ('0x' || d[9:16])::bigint % (len(u) + 1) as y,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}')
           or ('0x' || d[17:24])::bigint % 100 >= 50 then 'plain'
         when ('0x' || d[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from (select *, regexp_extract_all(t, '{UNIT}') as u from hashed)
), parts as (
  select doc_id, t, n, form,
    case when least(x, y) = 0 then '' else array_to_string(list_slice(u, 1, least(x, y)), '') end as pre,
    case when x = y then '' else array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') end as mid,
    case when greatest(x, y) = n then '' else array_to_string(list_slice(u, greatest(x, y) + 1, n), '') end as suf
  from cut
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(pre)::bigint end as prefix_chars,
  case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t
    when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
