"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The compiled transducer holds the normaliser (spaces become the mark, one mark in front), the
pieces as arcs over a trie of characters, and byte fallback arcs for characters without a
piece.  An input is composed with it position by position and the path of least weight is
taken in the tropical semiring.  The states of the piece arcs remember the last piece:

* unigram models: an arc weighs minus the piece's score;
* BPE models: an arc weighs 0 after a piece which BPE would leave standing before it, and
  infinity otherwise.  Exactly one path of weight 0 is left, the merge result, so the ids are
  those of the library.  (Minus the scores as weights would give other ids: they are merge
  ranks, not log probabilities.)  Whether two pieces stand side by side follows from undoing
  their merges, later ones first.

No piece has the mark after another character, so a text is cut in front of every word; equal
words are solved once, many words at a time, one numpy step a position.  Pieces made of marks
alone merge last, so runs of marks are merged apart.

Null and empty texts have no ids.  A text is decoded to itself, but for the mark, which comes
back as a space.  Models with a character map are refused.  Of equally good paths of a unigram
model the one found first stands, the same in every run.  A long text is cut into its words; a
word takes a step for each of its characters, so a very long one is slow.  The operator is a
column: an empty table gives no rows, and other columns may have any name.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
_ODD = ("  ", "\n ", " \n", MARK)
_RUN = re.compile(rf"({MARK}*)([^{MARK}\n]*)(\n?)")
_CACHE_WORDS = 250_000
_INF = np.inf


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[str]
    scores: list[float]
    unknown: int
    byte_ids: list[int] | None  # ids of the 256 byte pieces
    special: set[int]  # control, byte and unknown pieces: no arcs
    bpe: bool


def read_spec(path: str) -> Spec:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only the identity normaliser with a leading mark is compiled")
    kinds = [p.type for p in model.pieces]
    normal = proto.ModelProto.SentencePiece.NORMAL
    bytes_ = [i for i, k in enumerate(kinds) if k == proto.ModelProto.SentencePiece.BYTE]
    return Spec(
        [p.piece for p in model.pieces],
        [p.score for p in model.pieces],
        kinds.index(proto.ModelProto.SentencePiece.UNKNOWN),
        bytes_ if len(bytes_) == 256 else None,
        {i for i, k in enumerate(kinds) if k != normal},
        model.trainer_spec.model_type == proto.TrainerSpec.BPE,
    )


def merged(text: str, score_of: dict[str, float]) -> list[str]:
    """Plain byte-pair merging: the best-scored neighbouring pair first, leftmost on ties."""
    symbols: list[str | None] = list(text)
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    queue: list[tuple] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(symbols):
            pair = symbols[i] + symbols[after[i]]
            if pair in score_of:
                heapq.heappush(queue, (-score_of[pair], i, pair))

    for i in range(len(symbols)):
        offer(i)
    while queue:
        _, i, pair = heapq.heappop(queue)
        j = after[i]
        if symbols[i] is None or j >= len(symbols) or symbols[i] + symbols[j] != pair:
            continue  # one of the two has merged since
        symbols[i], symbols[j], after[i] = pair, None, after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s is not None]


class Transducer:
    """The compiled model; made on the driver, shared by broadcast."""

    def __init__(self, spec: Spec):
        self.spec = spec
        for p in spec.pieces:
            if MARK in p.lstrip(MARK):
                raise ValueError("a piece has the mark after another character")
        self.runs = {len(p): i for i, p in enumerate(spec.pieces) if i not in spec.special and p.strip(MARK) == ""}
        self.mark_ids: dict[int, list[int]] = {}
        arcs = {
            p: i for i, p in enumerate(spec.pieces) if i not in spec.special and p and (p == MARK or p.strip(MARK))
        }
        self.unk = len(spec.pieces)
        if spec.bpe:
            arcs = self._compile_pairs(arcs)
        self._compile_trie(arcs)
        self.cost = np.append(-np.array(spec.scores), -min(spec.scores, default=0.0) + 10.0)
        self.surface = [p.replace(MARK, " ").encode() for p in spec.pieces]
        for byte, i in enumerate(spec.byte_ids or ()):
            self.surface[i] = bytes([byte])
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def _compile_trie(self, arcs: dict[str, int]) -> None:
        states: dict[tuple[int, str], int] = {}
        final: dict[int, int] = {}
        for p, i in arcs.items():
            at = 0
            for ch in p:
                at = states.setdefault((at, ch), len(states) + 1)
            final[at] = i
        keys = np.array([s * 0x110000 + ord(ch) for s, ch in states], np.int64)
        order = np.argsort(keys)
        self.trie_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.trie_next = np.append(np.array(list(states.values()), np.int64)[order], 0)
        self.final = np.full(len(states) + 1, -1, np.int64)
        self.final[list(final)] = list(final.values())
        self.longest = max(map(len, arcs), default=0)

    def _compile_pairs(self, arcs: dict[str, int]) -> dict[str, int]:
        """Ranks, last merges and mergeable pairs; pieces that merging never reaches go."""
        scores = self.spec.scores
        ranked = sorted(arcs.items(), key=lambda x: (len(x[0]) > 1, -scores[x[1]], x[1]))
        rank = {p: k for k, (p, _) in enumerate(ranked)}
        score_of = {p: scores[i] for p, i in arcs.items() if len(p) > 1}
        left, right, kept = list(range(len(ranked) + 1)), list(range(len(ranked) + 1)), {}
        for p, i in ranked:
            if len(p) > 1:
                own = score_of.pop(p)
                halves = merged(p, score_of)
                score_of[p] = own
                if len(halves) != 2 or merged(p, score_of) != [p]:
                    continue
                left[rank[p]], right[rank[p]] = rank[halves[0]], rank[halves[1]]
            kept[p] = i
        self.rank = np.full(self.unk + 1, len(ranked), np.int64)
        for p, i in kept.items():
            self.rank[i] = rank[p]
        self.left, self.right, self.width = np.array(left), np.array(right), len(ranked) + 1
        merges = {}
        for p in arcs:
            for k in range(1, len(p)):
                if p[:k] in rank and p[k:] in rank:
                    merges[rank[p[:k]] * self.width + rank[p[k:]]] = rank[p]
        keys = np.array(sorted(merges), np.int64)
        self.merge_keys = np.append(keys, np.iinfo(np.int64).max)
        self.merge_rank = np.append([merges[k] for k in keys.tolist()], 0).astype(np.int64)
        return kept

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For distinct rank pairs: would merging leave them as they are."""
        ok, a, b = np.ones(len(a), bool), a.copy(), b.copy()
        limit, live = np.full(len(a), np.iinfo(np.int64).max), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.width + y
            at = np.searchsorted(self.merge_keys, key)
            bad = (self.merge_keys[at] == key) & (self.merge_rank[at] < limit[live])
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            first = x > y
            down_x, down_y = self.right[x], self.left[y]
            whole_x, whole_y = down_x == x, down_y == y
            # undo the later merge; where that side is a single character, the other one
            undo_x = np.where(first, ~whole_x, whole_y & ~whole_x)
            undo_y = np.where(first, whole_x & ~whole_y, ~whole_y)
            a[live] = np.where(undo_x, down_x, x)
            b[live] = np.where(undo_y, down_y, y)
            limit[live] = np.where(undo_x, x, y + 1)
            live = live[undo_x | undo_y]
        return ok

    def _allowed(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        keys = self.rank[last] * self.width + self.rank[piece]
        wanted, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, wanted)
        known = np.zeros(len(wanted), bool)
        inside = at < len(self.pair_keys)
        known[inside] = self.pair_keys[at[inside]] == wanted[inside]
        found = np.zeros(len(wanted), bool)
        found[known] = self.pair_ok[at[known]]
        new = wanted[~known]
        if len(new):
            found[~known] = self._side_by_side(new // self.width, new % self.width)
            if len(self.pair_keys) > 4_000_000:
                self.pair_keys, self.pair_ok = new, found[~known]
            else:
                merged_keys = np.concatenate([self.pair_keys, new])
                order = np.argsort(merged_keys, kind="stable")
                self.pair_keys = merged_keys[order]
                self.pair_ok = np.concatenate([self.pair_ok, found[~known]])[order]
        return found[back]

    def shortest(self, units: list[str]) -> list[np.ndarray]:
        """Ids of the best path of each unit, all units side by side."""
        n = len(units)
        lengths = np.fromiter(map(len, units), np.int64, n)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(n), lengths)
        first = np.cumsum(lengths) - lengths
        end_of = (first + lengths)[owner]
        here = np.arange(len(chars))
        starts, ends, pieces = [], [], []
        pos, state = here, np.zeros(len(chars), np.int64)
        covered = np.zeros(len(chars), bool)
        for size in range(1, self.longest + 1):
            inside = pos + size <= end_of[pos]
            pos, state = pos[inside], state[inside]
            key = state * 0x110000 + chars[pos + size - 1]
            at = np.searchsorted(self.trie_keys, key)
            hit = self.trie_keys[at] == key
            pos, state = pos[hit], self.trie_next[at[hit]]
            piece = self.final[state]
            done = piece >= 0
            if size == 1:
                covered[pos[done]] = True
            starts.append(pos[done])
            ends.append(pos[done] + size)
            pieces.append(piece[done])
        bare = here[~covered]
        starts, ends = np.concatenate([*starts, bare]), np.concatenate([*ends, bare + 1])
        pieces = np.concatenate([*pieces, np.full(len(bare), self.unk)])
        unit = owner[starts]
        # a unit of m characters has m + 1 nodes
        from_node, to_node = starts + unit, ends + unit
        turn = ends - first[unit]
        order = np.argsort(turn, kind="stable")
        from_node, to_node, pieces, turn = from_node[order], to_node[order], pieces[order], turn[order]
        cuts = np.searchsorted(turn, np.arange(1, int(lengths.max(initial=0)) + 2))
        best = np.full(len(chars) + n, _INF)
        back = np.full(len(chars) + n, -1)
        head = first + np.arange(n)
        best[head] = 0
        for k in range(len(cuts) - 1):
            arc = np.arange(cuts[k], cuts[k + 1])
            source, target, piece = from_node[arc], to_node[arc], pieces[arc]
            weight = best[source]
            if self.spec.bpe:
                inner = back[source] >= 0
                check = np.flatnonzero(inner & ~np.isinf(weight))
                bad = ~self._allowed(pieces[back[source[check]]], piece[check])
                weight[check[bad]] = _INF
            else:
                weight = weight + self.cost[piece]
            order = np.lexsort((weight, target))
            lead = np.append(True, np.diff(target[order]) != 0) if len(order) else np.zeros(0, bool)
            order = order[lead]
            order = order[~np.isinf(weight[order])]
            best[target[order]] = weight[order]
            back[target[order]] = arc[order]
        steps, at, live = [], head + lengths, np.arange(n)
        while len(live):
            live = live[at[live] != head[live]]
            arc = back[at[live]]
            if (arc < 0).any():
                raise ValueError("no path through the transducer")
            steps.append((live, pieces[arc], from_node[arc]))
            at[live] = from_node[arc]
        who = np.concatenate([s[0] for s in steps[::-1]]) if steps else np.zeros(0, np.int64)
        what = np.concatenate([s[1] for s in steps[::-1]]) if steps else np.zeros(0, np.int64)
        place = np.concatenate([s[2] for s in steps[::-1]]) if steps else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        who, what, place = who[order], what[order], place[order]
        bounds = np.searchsorted(who, np.arange(n + 1))
        missing = what == self.unk
        out = []
        for u in range(n):
            a, b = bounds[u], bounds[u + 1]
            if missing[a:b].any():
                out.append(self._spelled(units[u], what[a:b], place[a:b] - head[u]))
            else:
                out.append(what[a:b])
        return out

    def _spelled(self, text: str, what: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Unknown characters as byte ids, or as one unknown id for a run of them."""
        ids: list[int] = []
        before = False
        for piece, at in zip(what.tolist(), place.tolist()):
            if piece != self.unk:
                ids.append(piece)
            elif self.spec.byte_ids:
                ids += [self.spec.byte_ids[x] for x in text[at].encode("utf-8", "replace")]
            elif not before:
                ids.append(self.spec.unknown)
            before = piece == self.unk
        return np.array(ids, np.int64)

    def _marks(self, n: int) -> list[int]:
        """Ids of n marks in a row, by plain merging."""
        if n not in self.mark_ids:
            parts = merged(MARK * n, {MARK * k: self.spec.scores[i] for k, i in self.runs.items() if k > 1})
            self.mark_ids[n] = [self.runs.get(len(p), self.spec.unknown) for p in parts]
        return self.mark_ids[n]

    def encode(self, texts: list[str | None], cache: dict[str, bytes]) -> list[np.ndarray]:
        """Ids (uint32) of the texts; `cache` keeps solved words between calls."""
        plans, wanted = [], {"\n"}
        for t in texts:
            t = t if isinstance(t, str) else ""
            if not t:
                plans.append(None)
            elif t[0] == " " or t[-1] == " " or any(x in t for x in _ODD):
                runs = [m.groups() for m in _RUN.finditer(MARK + t.replace(" ", MARK)) if m.group()]
                plans.append(runs)
                wanted.update((MARK if marks else "") + word for marks, word, _ in runs if word)
            else:
                lines = [line.replace(" ", " " + MARK).split(" ") for line in t.split("\n")]
                lines[0][0] = MARK + lines[0][0]
                plans.append(lines)
                for words in lines:
                    wanted.update(words)
        wanted.add(MARK)
        wanted.discard("")
        missing = list(wanted.difference(cache))
        if len(cache) + len(missing) > _CACHE_WORDS:
            cache.clear()
            missing = list(wanted)
        cache[""] = b""
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for word, ids in zip(some, self.shortest(some)):
                cache[word] = ids.astype("<u4").tobytes()
        newline, alone = cache["\n"], cache[MARK]
        out = []
        for plan in plans:
            if plan is None:
                raw = b""
            elif isinstance(plan[0], list):
                raw = newline.join([b"".join([cache[w] for w in words]) for words in plan])
            else:
                raw = b"".join([self._run(*run, cache, newline, alone) for run in plan])
            out.append(np.frombuffer(raw, "<u4"))
        return out

    def _run(self, marks: str, word: str, line: str, cache: dict[str, bytes], newline: bytes, alone: bytes) -> bytes:
        n, ids = len(marks), b""
        if word:
            ids = cache[(MARK if n else "") + word]
            if n and ids[: len(alone)] == alone:
                ids = ids[len(alone) :]  # the last mark stands alone and joins the others
            elif n:
                n -= 1
        return np.array(self._marks(n), "<u4").tobytes() + ids + (newline if line else b"")

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the leading space of the normaliser."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids.tolist()])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


#: what token_columns can return, with its type
OUTPUTS = {
    "ids": "array<int>",
    "n_tokens": "long",
    "ids_crc32": "long",
    "decoded": "string",
    "round_trip": "boolean",
}


def token_columns(spark: SparkSession, text: Column, transducer: Transducer, outputs: tuple[str, ...]) -> Column:
    """A struct column of a text column: its ids, their number and CRC-32 (as little-endian
    unsigned 32-bit integers), the text decoded from them, and whether that is the text."""
    shared = spark.sparkContext.broadcast(transducer)
    held: dict[str, bytes] = {}

    def row(text: str | None, ids: np.ndarray, model: Transducer) -> dict:
        decoded = model.decode(ids) if "decoded" in outputs or "round_trip" in outputs else None
        return {
            "ids": ids.astype(np.int32) if "ids" in outputs else None,
            "n_tokens": len(ids),
            "ids_crc32": zlib.crc32(ids.tobytes()),
            "decoded": decoded,
            "round_trip": decoded == (text or "").replace(MARK, " "),
        }

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            # results leave in small pieces, so only these are held besides the texts
            for at in range(0, len(texts), 256):
                some = [t if isinstance(t, str) else None for t in texts.iloc[at : at + 256]]
                rows = [row(t, ids, shared.value) for t, ids in zip(some, shared.value.encode(some, held))]
                yield pd.DataFrame(
                    {c: pd.Series([r[c] for r in rows], dtype=object if c == "ids" else None) for c in outputs}
                )

    schema = ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)
    return F.pandas_udf(run, schema)(text.cast("string"))
