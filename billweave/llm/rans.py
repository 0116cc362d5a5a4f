"""Token-id files coded with static range asymmetric numeral systems.

A file is a table of segments in ascending order of the documents; a segment holds the ids of
consecutive documents, one frequency table shared by its blocks, and the blocks:

  part, segment   place in the order: part first
  first           ids of the part before the segment
  doc_ids, lengths  the documents and how many ids each has
  n_ids           all ids of the segment
  table           frequencies: symbols (uint32), then frequencies (uint32), summing to 2**20
  blocks          array of (n_ids, payload, states, offsets, payload_crc32, ids_crc32)

A block interleaves LANES coders over up to BLOCK_IDS ids and can be decoded alone.  Inside it
every STEPS steps there is a checkpoint: the lanes' states and the offset into the payload, so
all stretches between checkpoints are decoded side by side.  Checksums cover payload and ids.
States lie in [2**31, 2**63) and give out 32-bit words.

Null and empty texts have the end id alone.  Documents are ordered by id, rows with equal ids
by the hash of the text, null ids first.  An empty table gives no segment.  A long text is coded
whole and may make a segment larger.  Only the id and text columns are read, so other columns
may have any name.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 20
LANES, STEPS = 128, 256
STRETCH = LANES * STEPS
BLOCK_IDS = 4 * STRETCH
SEGMENT_IDS = 16 * BLOCK_IDS
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)

SCHEMA = (
    "part int, segment int, first long, doc_ids array<long>, lengths array<int>, n_ids long, table binary, "
    "blocks array<struct<n_ids: int, payload: binary, states: binary, offsets: array<int>, "
    "payload_crc32: long, ids_crc32: long>>"
)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies) with sum 2**SCALE; every symbol that occurs gets at least 1.

    Ids are places in a vocabulary, so a count for each fits in memory."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, total = counts[symbols], 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more distinct ids than the frequency table has places")
    # proportional shares on top of one place each, the rest to the most frequent symbol
    freqs = 1 + counts * (total - len(symbols)) // counts.sum()
    freqs[counts.argmax()] += total - freqs.sum()
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def _encode_equal(coded: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> list[dict]:
    """Blocks of equal size; coded is (block, step, lane) of symbol numbers."""
    n_blocks, n_steps, _ = coded.shape
    coded = np.ascontiguousarray(coded.transpose(1, 0, 2))
    x = np.full((n_blocks, LANES), _LOW)
    words, owners, at = [], [], []
    states: dict[int, np.ndarray] = {}
    for step in range(n_steps - 1, -1, -1):
        f, c = freqs[coded[step]], starts[coded[step]]
        full = x >= f << np.uint64(63 - SCALE)
        emitted = full.sum(1)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        owners.append(np.repeat(np.arange(n_blocks, dtype=np.int32), emitted))
        at.append(emitted)
        x = np.where(full, x >> _WORD, x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
        if step % STEPS == 0:
            states[step] = x
    words, owners = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    words = words[np.argsort(owners, kind="stable")]
    per_step = np.array(at[::-1]).reshape(n_steps, n_blocks)
    offsets = np.cumsum(per_step, axis=0) - per_step
    ends = np.cumsum(per_step.sum(0))
    out = []
    for b in range(n_blocks):
        payload = words[ends[b] - per_step[:, b].sum() : ends[b]].tobytes()
        out.append(
            {
                "payload": payload,
                "states": np.concatenate([states[s][b] for s in sorted(states)]).astype("<u8").tobytes(),
                "offsets": [int(offsets[s, b]) for s in sorted(states)],
                "payload_crc32": zlib.crc32(payload),
            }
        )
    return out


def encode(ids: np.ndarray) -> tuple[bytes, list[dict]]:
    """(frequency table, blocks) of the ids of a segment."""
    symbols, freqs = frequencies(ids)
    number_of = np.zeros(int(symbols[-1]) + 1, np.int32)
    number_of[symbols] = np.arange(len(symbols))
    numbers = number_of[ids]
    most = int(freqs.argmax())
    wide = freqs.astype(np.uint64)
    starts = np.cumsum(wide) - wide
    blocks: list[dict] = []
    n_full = len(ids) // BLOCK_IDS
    if n_full:
        whole = numbers[: n_full * BLOCK_IDS].reshape(n_full, BLOCK_IDS // LANES, LANES)
        blocks += _encode_equal(whole, wide, starts)
    rest = numbers[n_full * BLOCK_IDS :]
    if len(rest):
        filled = np.full(-(-len(rest) // LANES) * LANES, most)
        filled[: len(rest)] = rest
        blocks += _encode_equal(filled.reshape(1, -1, LANES), wide, starts)
    for k, block in enumerate(blocks):
        own = ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS]
        block |= {"n_ids": len(own), "ids_crc32": zlib.crc32(own.astype("<u4").tobytes())}
    return np.concatenate([symbols, freqs]).astype("<u4").tobytes(), blocks


def decode(table: bytes, blocks: list) -> np.ndarray:
    """The ids (uint32) of the blocks, all stretches side by side; checksums are verified."""
    symbols, freqs = np.frombuffer(table, "<u4").reshape(2, -1)
    wide = freqs.astype(np.uint64)
    starts = np.cumsum(wide) - wide
    number_at = np.repeat(np.arange(len(symbols)), freqs)
    payloads, states, offsets, steps, base = [], [], [], [], 0
    for k, b in enumerate(blocks):
        if zlib.crc32(b["payload"]) != b["payload_crc32"]:
            raise ValueError(f"block {k}: the payload's checksum differs")
        payloads.append(np.frombuffer(b["payload"], "<u4"))
        n_steps = -(-b["n_ids"] // LANES)
        own = np.frombuffer(b["states"], "<u8").reshape(-1, LANES)
        states.append(own)
        offsets.append(np.asarray(b["offsets"], np.int64) + base)
        steps.append(np.minimum(STEPS, n_steps - STEPS * np.arange(len(own))))
        base += len(payloads[-1])
    stream = np.append(np.concatenate(payloads), np.zeros(1, "<u4")).astype(np.uint64)
    x, at, steps = np.concatenate(states), np.concatenate(offsets), np.concatenate(steps)
    # the longest stretches first, so that those which have ended are cut off at the tail
    order = np.argsort(-steps, kind="stable")
    x, at, left = x[order].copy(), at[order].copy(), steps[order]
    found = np.zeros((len(order), STEPS, LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for step in range(int(left[0])):
        live = int(np.searchsorted(-left, -step, "left"))
        slot = x[:live] & mask
        n = number_at[slot.astype(np.int64)]
        found[:live, step] = symbols[n]
        y = wide[n] * (x[:live] >> np.uint64(SCALE)) + slot - starts[n]
        low = y < _LOW
        place = at[:live, None] + np.cumsum(low, axis=1) - 1
        y[low] = (y[low] << _WORD) | stream[place[low]]
        x[:live] = y
        at[:live] += low.sum(1)
    ordered = np.empty_like(found)
    ordered[order] = found
    out, first = [], 0
    for k, b in enumerate(blocks):
        n = len(b["offsets"])
        ids = ordered[first : first + n].reshape(-1)[: b["n_ids"]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != b["ids_crc32"]:
            raise ValueError(f"block {k}: the ids' checksum differs")
        out.append(ids)
        first += n
    return np.concatenate(out)


Encoder = Callable[[list], list]


def write(docs: DataFrame, path: str, encoder: Callable[[], Encoder], end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode the texts and write the file table to `path`.

    `encoder()` is called once in a task and gives a function from texts to uint32 arrays.
    A task holds one segment of ids at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_texts = encoder()
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, size, first = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            ids = np.concatenate(held)
            table, blocks = encode(ids)
            row = {"part": part, "segment": segment, "first": first, "doc_ids": doc_ids, "lengths": lengths, "n_ids": len(ids)}
            return pd.DataFrame([row | {"table": table, "blocks": blocks}])

        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                coded = encode_texts([t if isinstance(t, str) else "" for t in some["_text"]])
                for doc, ids in zip(some["_id"], coded):
                    ids = np.append(ids, np.uint32(end_id))
                    doc_ids.append(None if pd.isna(doc) else int(doc))
                    lengths.append(len(ids))
                    held.append(ids)
                    size += len(ids)
                    if size >= SEGMENT_IDS:
                        yield flush()
                        first, segment = first + size, segment + 1
                        doc_ids, lengths, held, size = [], [], [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    ordered = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h").select("_id", "_text")
    ordered.mapInPandas(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in a file table; start counts all ids before it.

    Only one total per part goes through the driver.
    """
    return _decoded(spark, path, "doc_id long, start long, ids array<long>", lambda ids: {"ids": [x.astype(np.int64) for x in ids]})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""

    def digest(ids: list[np.ndarray]) -> dict:
        return {"n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}

    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


def _decoded(spark: SparkSession, path: str, schema: str, columns: Callable[[list], dict]) -> DataFrame:
    file = spark.read.schema(SCHEMA).parquet(path)
    parts = sorted((r["part"], r["n"]) for r in file.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in parts)])
    start_of = {part: int(before[k]) for k, (part, _) in enumerate(parts)}
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = decode(r.table, list(r.blocks))
                lengths = np.asarray(r.lengths, np.int64)
                ends = np.cumsum(lengths)
                pieces = np.split(ids, ends[:-1])
                starts = start_of[r.part] + r.first + ends - lengths
                yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), "Int64"), "start": starts, **columns(pieces)})

    return file.drop("segment", "n_ids").mapInPandas(run, schema)


_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_MARKS = "!#$%&*+,-./:;<=>?@^_|~"
_CACHE_WORDS = 700_000
_cache: dict[tuple[str, bool], tuple[dict, ...]] = {}


def _odd(text: str) -> bool:
    """White space other than single spaces and line feeds between visible characters."""
    return (
        text[:1] in " \n"
        or text[-1:] in " \n"
        or any(pair in text for pair in ("  ", "\n\n", " \n", "\n "))
        or any(c in text for c in _OTHER_SPACES)
    )


class _Words(dict):
    """Coded words by word; unknown ones are coded when they are asked for.

    A word with marks behind its letters is the word without them, which is remembered as well,
    and the marks."""

    def __init__(self, code: Callable[[str], bytes], marks: dict[str, bytes]):
        self.code, self.marks = code, marks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        body = word.rstrip(_MARKS)
        if len(body) < len(word) and body[-1:].isalpha():
            got = self[body] + self.marks[word[len(body) :]]
        else:
            got = self.code(word)
        self[word] = got
        return got


def _byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself where it is visible,
    else the next letter from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in visible else chr(next(hidden)) for b in range(256))


def byte_bpe(path: str, markers: bool = False) -> Callable[[], Encoder]:
    """An encoder for a byte-level BPE file of the tokenizers library, without special tokens.

    With `markers`, the text of an added token of the file, such as <|endoftext|>, gives its id,
    as in the library's plain call; without, it is spelled like other text.

    The library splits a text before every space that a visible character follows, around a
    line feed between visible characters, and between a letter and a mark.  So words between
    single spaces and line feeds are encoded apart, letters apart from the marks behind them,
    and remembered.  Words of letters go to the library's model, other words and texts with
    other white space through its splitter.
    """

    def make() -> Encoder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not markers
        marked = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if markers else []
        model, letters = tokenizer.model, _byte_letters()

        def packed(ids: list[int]) -> bytes:
            return array("I", ids).tobytes()

        def raw(text: str) -> bytes:
            return packed(tokenizer.encode(text, add_special_tokens=False).ids)

        def coder(lead: str) -> Callable[[str], bytes]:
            tokenize, spelled_lead = model.tokenize, lead.translate(letters)

            def code(word: str) -> bytes:
                if not word.isalpha():
                    return raw(lead + word)
                # ASCII letters are written as themselves
                spelled = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(letters)
                return array("I", [t.id for t in tokenize(spelled_lead + spelled)]).tobytes()

            return code

        if (path, markers) not in _cache:
            marks = _Words(raw, {})
            _cache[path, markers] = _Words(coder(""), marks), _Words(coder(" "), marks)
        first, later = (words.__getitem__ for words in _cache[path, markers])
        newline = raw("\n")

        def line(text: str) -> bytes:
            head, *tail = text.split(" ")
            return first(head) + b"".join(map(later, tail))

        def whole(text: str) -> bool:
            return _odd(text) or any(m in text for m in marked)

        def encode_texts(texts: list[str]) -> list[np.ndarray]:
            coded = [raw(t) if whole(t) else newline.join(map(line, t.split("\n"))) for t in texts]
            return [np.frombuffer(c, np.uint32) for c in coded]

        return encode_texts

    return make
