"""Byte-level BPE over length-bucketed padded numpy matrices.

`RankBPE.encode_pieces` takes many pre-tokens at once. They are sorted into
buckets by byte length; a bucket is a matrix with one pre-token a row. Each
round every row merges its leftmost pair of least rank, the pair's rank being
looked up in an open-addressing hash table; rows without a pair to merge leave
the matrix (compaction), and the columns to the right of a merge move left.
Pre-tokens over LONG bytes follow the same rule with a heap, since a matrix
would take a number of rounds and a width that both grow with their length.

`TextCoder` encodes whole texts: it cuts them at every space before a non-space
and encodes only the distinct segments of a chunk.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestrata.llm.common import ship, text_chunks

#: Bytes above which a pre-token is merged with a heap.
LONG = 256
#: Bytes of text whose distinct segments are encoded together.
CHUNK = 6 << 20
#: Cells of a matrix that are worked on at a time.
CELLS = 1 << 20

_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pairs_of_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id << 32 | right id -> merged id, for each pair whose bytes together are a token."""
    out, get = {}, ranks.get
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left = get(token[:cut])
            if left is not None:
                right = get(token[cut:])
                if right is not None:
                    out[left << 32 | right] = rank
    return out


def read_merges(path: str) -> tuple[dict[bytes, int], dict[int, int]]:
    """Tokens and pairs of a byte-level BPE file of the tokenizers library. Its
    merged ids ascend with the merges' priority, so an id serves as a rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    written = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    spell = lambda token: bytes(written[c] for c in token)
    vocab, pairs, last = model["vocab"], {}, -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merged = vocab[left + right]
        if merged <= last:
            raise ValueError(f"{path}: ids don't ascend with the merges")
        pairs[vocab[left] << 32 | vocab[right]] = last = merged
    return {spell(token): i for token, i in vocab.items() if all(c in written for c in token)}, pairs


class PairTable:
    """Merged id of (left id, right id), hashed with linear probing."""

    def __init__(self, pairs: dict[int, int]):
        keys, values = list(pairs), list(pairs.values())
        self.bits = max(8, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int32)
        pending, held = np.array(keys, np.int64), np.array(values, np.int32)
        slots, self.probes = self._slot(pending), 0
        while len(pending):
            self.probes += 1
            free = self.keys[slots] == -1
            taken, first = np.unique(slots[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = pending[chosen], held[chosen]
            rest = np.ones(len(pending), bool)
            rest[chosen] = False
            pending, held, slots = pending[rest], held[rest], (slots[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE if it doesn't merge or an id is negative."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        found[(left < 0) | (right < 0)] = _NONE
        return found


class RankBPE:
    """Encoding and decoding; a merged token's id is also the rank of the pair."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int]):
        self.merged = pairs
        self.pairs = PairTable(pairs)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.array([len(x) for x in tokens])
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens that lie at `starts` in `data`, one after
        the other, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        widths = np.where(lengths <= 16, np.maximum(2, lengths + 1 & ~1), 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
        widths[lengths == 0] = 0
        widths[lengths > LONG] = -1
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            if width < 0:
                for i in rows:
                    ids = np.array(self._by_heap(data[starts[i] : starts[i] + lengths[i]]), np.int32)
                    counts[i] = len(ids)
                    found.append((np.array([i]), ids))
            elif width:
                step = max(1, CELLS // width)
                for start in range(0, len(rows), step):
                    part = rows[start : start + step]
                    ids, counts[part] = self._by_matrix(data, starts[part], lengths[part], width)
                    found.append((part, ids))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, ids in found:
            out[spans(ends[rows] - counts[rows], counts[rows])] = ids
        return out, counts

    def _by_matrix(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        columns = np.arange(width)
        ids = self.single[data[np.minimum(starts[:, None] + columns, len(data) - 1)]]
        ids[columns >= lengths[:, None]] = -1
        ranks = np.full((len(starts), width), _NONE, np.int32)  # of the pair that begins at a column
        ranks[:, :-1] = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        done = np.full((len(starts), width), -1, np.int32)
        alive = np.arange(len(starts))
        while len(alive):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(alive)), at]
            over = least == _NONE
            if over.any():
                done[alive[over]] = ids[over]
                stay = ~over
                alive, ids, ranks, at, least = alive[stay], ids[stay], ranks[stay], at[stay], least[stay]
                if not len(alive):
                    break
            rows = np.arange(len(alive))
            source = columns + (columns > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            gone = at < width - 1  # always: a pair begins before the last column
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ids[gone, -1], ranks[gone, -1] = -1, _NONE
            ids[rows, at] = least
            following = ids[rows, np.minimum(at + 1, width - 1)]
            ranks[rows, at] = self.pairs.ranks(least, np.where(at + 1 < width, following, -1))
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pairs.ranks(ids[inner, at[inner] - 1], least[inner])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)

    def _by_heap(self, piece: np.ndarray) -> list[int]:
        """Merge the leftmost pair of least rank again and again, in a linked list of tokens."""
        get, n = self.merged.get, len(piece)
        ids = self.single[piece].tolist()
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return self.token_data[spans(self.token_starts[ids], self.token_lengths[ids])]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def pieces_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and byte lengths of an array of strings without nulls."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return data if len(data) else np.zeros(1, np.uint8), offsets[:-1], np.diff(offsets)


#: Characters that str patterns may call white space, as a class of RE2.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LOOSE = f" {_SPACE}| $"
_CUT = re.compile(r" (?=[^\s\x1c-\x1f\x85\u180e])")


class CrossingToken(ValueError):
    """The pattern lets a token cross a segment's end."""


class TextCoder:
    """Ids of whole texts. A text is cut at every space before a non-space: in
    every pattern of this family a token begins there, whatever stands before.
    Only the distinct segments of a chunk are encoded. Under a pattern of another
    kind, where a token does cross a cut, the chunk's texts are encoded uncut."""

    def __init__(self, encode_parts):
        self.encode_parts = encode_parts  # strings, whether they may be joined -> ids, how many each has

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one text after the other, and how many each has."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        try:
            return self._by_segment(texts)
        except CrossingToken:
            ids, counts = self.encode_parts(texts, False)
            return ids.astype("<u4"), counts

    def _by_segment(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        loose = pc.match_substring_regex(texts, _LOOSE)
        place = np.concatenate([np.flatnonzero(~loose.to_numpy(zero_copy_only=False)), np.flatnonzero(loose.to_numpy(zero_copy_only=False))])
        tight = pc.split_pattern(texts.filter(pc.invert(loose)), " ")
        words, at = tight.flatten(), np.diff(tight.offsets.to_numpy())
        first = np.zeros(len(words), bool)
        first[tight.offsets.to_numpy()[:-1]] = True
        later = words.filter(pa.array(~first)).dictionary_encode()
        cut = [_cut(x) for x in texts.filter(loose).to_pylist()]
        more = pa.array([x for row in cut for x in row[1:]], pa.large_string()).dictionary_encode()
        heads = pa.concat_arrays([words.filter(pa.array(first)), pa.array([row[0] for row in cut], pa.large_string())]).dictionary_encode()
        joinable = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), later.dictionary, pa.scalar("", pa.large_string())), more.dictionary.cast(pa.large_string())])
        ids, counts = map(np.concatenate, zip(self.encode_parts(joinable, True), self.encode_parts(heads.dictionary, False)))
        starts = np.cumsum(counts) - counts
        sizes = np.concatenate([at, np.array([len(row) for row in cut], np.int64)])
        which = np.empty(int(sizes.sum()), np.int64)
        is_head = np.zeros(len(which), bool)
        is_head[np.cumsum(sizes) - sizes] = True
        head_index = heads.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        which[is_head] = head_index + len(joinable)
        which[~is_head] = np.concatenate([later.indices.to_numpy(zero_copy_only=False).astype(np.int64), more.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(later.dictionary)])
        order = np.empty(len(place), np.int64)  # where a text's segments lie in `which`
        order[place] = np.arange(len(place))
        which = which[spans((np.cumsum(sizes) - sizes)[order], sizes[order])]
        ends = np.concatenate([[0], np.cumsum(counts[which])])
        rows = np.concatenate([[0], np.cumsum(sizes[order])])
        return ids[spans(starts[which], counts[which])].astype("<u4"), np.diff(ends[rows])


def _cut(text: str) -> list[str]:
    places = [m.start() for m in _CUT.finditer(text)]
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]


_CODERS: dict = {}


def own_coder(path: str, pattern: str) -> tuple[RankBPE, TextCoder]:
    """A worker's coder for a rank file or a JSON file, made once. Strings of
    special tokens in a text are ordinary text."""
    if (path, pattern) not in _CODERS:
        import regex

        if path.endswith(".json"):
            model = RankBPE(*read_merges(path))
        else:
            ranks = read_ranks(path)
            model = RankBPE(ranks, pairs_of_ranks(ranks))
        split = regex.compile(pattern)

        def encode_parts(strings: pa.Array, together: bool) -> tuple[np.ndarray, np.ndarray]:
            parts = strings.to_pylist()
            found = split.findall("".join(parts)) if together else list(chain.from_iterable(map(split.findall, parts)))
            found = pa.array(found, pa.large_string()).dictionary_encode()
            ids, counts = model.encode_pieces(*pieces_of(found.dictionary))
            which = found.indices.to_numpy(zero_copy_only=False)
            ids = ids[spans((np.cumsum(counts) - counts)[which], counts[which])]
            return ids, by_string(model, ids, strings)

        _CODERS[path, pattern] = (model, TextCoder(encode_parts))
    return _CODERS[path, pattern]


def library_coder(path: str, pattern: str, added: bool = False) -> tuple[RankBPE, TextCoder]:
    """The same for the vocabulary of a JSON or rank file, merged by the tiktoken
    library. With `added`, the added tokens of a JSON file are found in a text as
    the tokenizers library finds them by default; else they are ordinary text."""
    if (path, pattern, "library", added) not in _CODERS:
        import tiktoken

        ranks, tokens = ({k: v for k, v in read_merges(path)[0].items() if k}, read_added(path)) if path.endswith(".json") else (read_ranks(path), {})
        ranks = {k: v for k, v in ranks.items() if v not in tokens.values()}
        model = RankBPE(ranks, {})
        core = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode_parts(strings: pa.Array, together: bool) -> tuple[np.ndarray, np.ndarray]:
            parts = strings.to_pylist()
            ids = np.array(core.encode_ordinary("".join(parts)) if together else list(chain.from_iterable(map(core.encode_ordinary, parts))), np.int64)
            return ids, by_string(model, ids, strings)

        coder = TextCoder(encode_parts)
        _CODERS[path, pattern, "library", added] = (model, with_added(coder, tokens) if added and tokens else coder)
    return _CODERS[path, pattern, "library", added]


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a JSON file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(x[flag] for x in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: an added token takes in or looks at the characters around it")
    return {x["content"]: x["id"] for x in tokens}


def with_added(encode: TextCoder, tokens: dict[str, int]):
    """A coder that cuts texts at the added tokens, which give their own ids; what
    lies between is encoded as a text of its own. Of tokens that overlap the
    leftmost counts, of those that begin at one place the longest."""
    cut = re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")")

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(column, "").cast(pa.large_string())
        holds = np.zeros(len(texts), bool)
        for token in tokens:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not holds.any():
            return encode(texts)
        rows = [cut.split(x) if y else [x] for x, y in zip(texts.to_pylist(), holds.tolist())]
        sizes = np.array([len(row) for row in rows])
        starts = np.cumsum(sizes) - sizes
        parts = list(chain.from_iterable(rows))
        own = np.flatnonzero((np.arange(len(parts)) - np.repeat(starts, sizes)) % 2)  # every second part is a token
        found = [tokens[parts[k]] for k in own]
        for k in own:
            parts[k] = ""
        ids, counts = encode(pa.array(parts, pa.large_string()))
        ids = np.insert(ids, np.cumsum(counts)[own], np.array(found, ids.dtype))
        counts[own] = 1
        return ids, np.add.reduceat(counts, starts)

    return run


def by_string(model: RankBPE, ids: np.ndarray, strings: pa.Array) -> np.ndarray:
    """How many of the ids each string has, by the lengths in bytes."""
    ends = np.cumsum(pieces_of(strings)[2])
    reach = np.concatenate([[0], np.cumsum(model.token_lengths[ids])])
    upto = np.searchsorted(reach, ends)
    if (reach[np.minimum(upto, len(ids))] != ends).any():
        raise CrossingToken
    return np.diff(upto, prepend=0)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every whole text (null: empty) of docs.

    Returns one row per row of docs: doc_id, n_tokens, ids (little-endian
    unsigned 32-bit), decoded (the ids' bytes). Rows don't depend on each other,
    so ties and repeated rows give equal results, empty tables give none, and
    columns other than doc_id and text play no part. One scan, no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches):
        model, encode = own_coder(path, pattern)
        for part in text_chunks(batches, "text", CHUNK):
            ids, counts = encode(part.column(1))
            decoded = model.decode(ids)
            ends = np.concatenate([[0], np.cumsum(counts)])
            reach = np.concatenate([[0], np.cumsum(model.token_lengths[ids])])[ends]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), cut_bytes(ids.view(np.uint8), 4 * ends), cut_bytes(decoded, reach)],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def cut_bytes(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values from one run of bytes and where they end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
