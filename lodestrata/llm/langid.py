"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one. A word (a run of non-space characters, with
the vocabulary's word mark before it) has many segmentations into pieces; its
probability in a language is the sum over all of them of the product of the
language's piece probabilities, by the forward algorithm. No piece of the
vocabulary crosses a word's start, so a text's log probability is the sum over its
words, and each distinct word of a chunk is scored once.

Training is one expectation step: with equal weights for all pieces, forward and
backward sums give each piece's expected count in each word; the counts of a
language's words weigh them. A character outside the vocabulary is the unknown
piece.

Words of any length are summed whole. They are worked on in stretches of positions;
from one to the next goes a window of forward (or backward) sums as wide as the
longest piece, so memory doesn't grow with a word's length but for a window at the
start of each stretch in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.common import ship, text_chunks

MARK = "▁"
#: Positions worked on together, and starts of pieces in them, at most.
STRETCH, STARTS = 64, 1 << 18
#: Sums that the windows of words scored together hold.
CELLS = 1 << 20
#: Added to each expected count.
SMOOTHING = 0.1
CHUNK = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a sentencepiece model, and a hashed table of their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.unknown = model.unk_id()
        pieces = {model.id_to_piece(i): i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        pieces = {x: i for x, i in pieces.items() if MARK not in x[1:]}
        self.longest = max(map(len, pieces))
        nodes: dict[str, int] = {}
        for x, i in pieces.items():
            for n in range(1, len(x)):
                nodes.setdefault(x[:n], -1)
            nodes[x] = i
        keys = np.array([_hash(x) for x in nodes], np.uint64)
        order = np.argsort(keys)
        self.bits = (4 * len(keys)).bit_length()
        self.table = np.full(1 << self.bits, -1, np.int64)  # open addressing
        self.keys, self.values = keys[order], np.array(list(nodes.values()), np.int64)[order]
        if (np.diff(self.keys.astype(object)) == 0).any():
            raise ValueError("two prefixes share a hash")
        todo, slot = np.arange(len(keys)), (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.table[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.table[taken] = todo[free[first]]
            rest = np.ones(len(todo), bool)
            rest[free[first]] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (len(self.table) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1 for a mere prefix, -2 for neither."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.table[slot]
        hit = (at >= 0) & (self.keys[at] == keys)
        out = np.where(hit, self.values[at], -2)
        open_ = np.flatnonzero(~hit & (at >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            at = self.table[slot[open_]]
            hit = (at >= 0) & (self.keys[at] == keys[open_])
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (at >= 0)]
        return out

class Group:
    """Words that are scored together, longest first, and the pieces in them."""

    def __init__(self, voc: Vocabulary, words: list[str]):
        self.voc = voc
        self.lengths = np.array([len(x) for x in words], np.int64)
        if (np.diff(self.lengths) > 0).any():
            raise ValueError("words have to come longest first")
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.top = int(self.lengths[0]) if len(words) else 0
        self.width = voc.longest + 1

    def longer(self, i: int) -> int:
        """How many words have more than i characters; they are the first ones."""
        return int(np.searchsorted(-self.lengths, -i, side="left"))

    def stretches(self) -> list[tuple[int, int]]:
        out, a = [], 0
        while a < self.top:
            b = min(self.top, a + max(1, min(STRETCH, STARTS // max(1, self.longer(a)))))
            out.append((a, b))
            a = b
        return out

    def edges(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece that starts at a position from a to before b: word, size and
        piece, ordered by position and then word; and where each position's begin."""
        voc, alive = self.voc, np.array([self.longer(i) for i in range(a, b)], np.int64)
        position = np.repeat(np.arange(a, b), alive)
        word = np.arange(len(position)) - np.repeat(np.cumsum(alive) - alive, alive)
        at, left = self.offsets[word] + position, self.lengths[word] - position
        active, hashes = np.arange(len(position)), np.zeros(len(position), np.uint64)
        known = np.zeros(len(position), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, voc.longest + 1):
            stay = left[active] >= n
            active, hashes = active[stay], hashes[stay]
            if not len(active):
                break
            hashes = _step(hashes, self.points[at[active] + n - 1])
            piece = voc.find(hashes)
            is_piece = piece >= 0
            if n == 1:
                known[active[is_piece]] = True
            found.append((active[is_piece], np.full(int(is_piece.sum()), n), piece[is_piece]))
            stay = piece > -2
            active, hashes = active[stay], hashes[stay]
        lone = np.flatnonzero(~known)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), voc.unknown)))
        start, size, piece = map(np.concatenate, zip(*found))
        order = np.argsort(start, kind="stable")
        start = start[order]
        return word[start], size[order], piece[order], np.searchsorted(start, np.concatenate([[0], np.cumsum(alive)]))

    def begin(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A window of forward sums at position 0, and its logarithmic scale."""
        window = np.zeros((self.width, len(self.lengths), k))
        window[0] = 1
        return window, np.zeros((len(self.lengths), k))

    def advance(self, state, edges, a: int, b: int, table: np.ndarray, totals: np.ndarray, kept: list | None = None) -> None:
        """Carry the forward sums from position a to b. Slot i % width of the window
        holds the sums at position i; words that end get their totals."""
        (window, scale), (word, size, piece, bounds) = state, edges
        for i in range(a, b):
            lo, hi = bounds[i - a], bounds[i - a + 1]
            slot, n = i % self.width, self.longer(i)
            if kept is not None:
                kept.append((window[slot, :n].copy(), scale[:n].copy()))
            window[(i + size[lo:hi]) % self.width, word[lo:hi]] += window[slot, word[lo:hi]] * table[piece[lo:hi]]
            window[slot] = 0
            rest = self.longer(i + 1)
            if rest < n:
                totals[rest:n] = np.log(window[(i + 1) % self.width, rest:n]) + scale[rest:n]
                window[:, rest:n] = 0
            if i % 8 == 7 and rest:
                peak = window[:, :rest].max(axis=0)
                window[:, :rest] /= peak
                scale[:rest] += np.log(peak)


def _step(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    x = (hashes ^ points) * _BASE
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) + points + np.uint64(1)


def _hash(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = _step(h, np.array([ord(c)], np.uint64))
    return int(h[0])


def forward(group: Group, weights: np.ndarray) -> np.ndarray:
    """The logarithm of each word's sum over all segmentations in each language
    (word, language). weights: languages x pieces."""
    table, totals = np.ascontiguousarray(weights.T), np.zeros((len(group.lengths), len(weights)))
    state = group.begin(len(weights))
    for a, b in group.stretches():
        group.advance(state, group.edges(a, b), a, b, table, totals)
    return totals


def expected(group: Group, weights: np.ndarray):
    """Yield word, size, piece and probability of each piece in its word's segmentations, for one set of weights."""
    table, totals = weights[:, None], np.zeros((len(group.lengths), 1))
    state, starts, stretches = group.begin(1), [], group.stretches()
    for a, b in stretches:
        if len(stretches) > 1:
            starts.append((state[0].copy(), state[1].copy()))
        edges = group.edges(a, b)
        group.advance(state, edges, a, b, table, totals)
    window, scale = np.zeros((group.width, len(group.lengths))), np.zeros(len(group.lengths))
    for a, b in stretches[::-1]:
        if len(stretches) > 1:
            edges = group.edges(a, b)
        word, size, piece, bounds = edges
        alphas: list = []
        group.advance(starts.pop() if starts else group.begin(1), edges, a, b, table, np.zeros_like(totals), alphas)
        share = np.zeros(len(word))
        for i in range(b - 1, a - 1, -1):
            lo, hi = bounds[i - a], bounds[i - a + 1]
            n, slot = group.longer(i), i % group.width
            window[(i + 1) % group.width, group.longer(i + 1) : n] = 1  # words that end here
            w = word[lo:hi]
            after = window[(i + size[lo:hi]) % group.width, w] * weights[piece[lo:hi]]
            alpha, logs = alphas[i - a]
            share[lo:hi] = alpha[w, 0] * after * np.exp(logs[w, 0] + scale[w] - totals[w, 0])
            window[slot] = 0
            window[slot, :n] = np.add.reduceat(after, np.flatnonzero(np.diff(w, prepend=-1)))
            if i % 8 == 0:
                peak = window[:, :n].max(axis=0)
                window[:, :n] /= peak
                scale[:n] += np.log(peak)
        yield word, size, piece, share


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and distinct word of each word of the texts, and the distinct words, marked."""
    lists = pc.utf8_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    found = lists.flatten().dictionary_encode()
    which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    distinct = found.dictionary.to_pylist()
    stay = which >= 0
    filled = np.array([bool(x) for x in distinct], bool)
    if len(distinct):
        stay &= filled[which]
    return row[stay], which[stay], [MARK + x for x in distinct]


def _groups(voc: Vocabulary, words: list[str], languages: int):
    """The words in groups of bounded size, longest first: their places, and the group."""
    order = np.argsort([-len(x) for x in words], kind="stable")
    step = max(64, CELLS // (languages * (voc.longest + 1)))
    for k in range(0, len(words), step):
        chosen = order[k : k + step]
        yield chosen, Group(voc, [words[i] for i in chosen])


def train(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (languages x pieces), from all
    rows of docs with a text and a lang. What reaches the driver is bounded by the
    vocabulary times the number of languages."""
    ship(docs.sparkSession)

    def run(batches):
        voc = vocabulary(path)
        uniform = np.full(voc.size, 1.0 / voc.size)
        sums: dict[str, np.ndarray] = {}
        for part in text_chunks(batches, "text", CHUNK):
            row, which, words = _words(part.column(0))
            langs = part.column(1).dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
            names = langs.dictionary.to_pylist()
            if not len(which):
                continue
            counts = np.bincount(which * len(names) + lang, minlength=len(words) * len(names)).reshape(-1, len(names))
            for chosen, group in _groups(voc, words, 1):
                mine = counts[chosen]
                for word, _, piece, share in expected(group, uniform):
                    for i, name in enumerate(names):
                        into = sums.setdefault(name, np.zeros(voc.size))
                        into += np.bincount(piece, share * mine[word, i], minlength=voc.size)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "piece", "n"])

    usable = docs.where("text is not null and lang is not null").select("text", "lang")
    found = usable.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(found["lang"]))
    counts = np.zeros((len(langs), vocabulary(path).size))
    index = {x: i for i, x in enumerate(langs)}
    counts[[index[x] for x in found["lang"]], found["piece"]] = found["n"]
    counts += SMOOTHING
    return langs, counts / counts.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, path: str, langs: list[str], weights: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every row: the language under which the whole
    text is most probable (ties: the first by name) and its posterior with equal
    priors. `und`, score 0, where the text is null or has no letter, or where
    nothing was learned. Rows don't depend on each other; an empty table gives
    none; only doc_id and text are read."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # languages x vocabulary numbers

    def run(batches):
        voc, weights = vocabulary(path), shared.value
        for part in text_chunks(batches, "text", CHUNK):
            column = part.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = ["und"] * len(column), np.zeros(len(column))
            if langs and lettered.any():
                row, which, words = _words(column)
                by_word = np.zeros((len(words), len(langs)))
                for chosen, group in _groups(voc, words, len(langs)):
                    by_word[chosen] = forward(group, weights)
                logs = np.stack([np.bincount(row, by_word[which, i], minlength=len(column)) for i in range(len(langs))], axis=1)
                best = logs.argmax(axis=1)
                posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(lettered):
                    names[i], scores[i] = langs[best[i]], posterior[i]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    """crc32 of doc_id as text, modulo 4, is 2 (false for a null doc_id)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn_and_predict(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows
    that aren't held out and have a lang."""
    langs, weights = train(docs.where(~held_out()), path)
    return predict(docs, path, langs, weights).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
